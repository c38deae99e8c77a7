"""``spark.read.format("gtf")`` and ``split_transfrag`` for SQL: registered by ``register(spark)``."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf


class GtfFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GtfReader(DataSourceReader):
    """A partition for every file; for large files read text and use ``text.parse_gtf``, which splits them."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[GtfFile]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [GtfFile(self.path)]
        head = self.path[: len(self.path) - len(at)]
        return [GtfFile(head + f.path) for f in store.get_file_info(fs.FileSelector(at)) if f.is_file]

    def read(self, partition: GtfFile) -> Iterator[tuple]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(at) as raw:
            rest = b""
            while chunk := raw.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from filter(None, map(feature, lines))
            if found := feature(rest):
                yield found


def feature(line: bytes) -> tuple | None:
    """The fields of a GTF line, or None where ``text.parse_gtf`` skips it."""
    f = line.decode("utf-8", "replace").rstrip().split("\t")
    if len(f) < 9 or f[0].startswith("#"):
        return None
    try:
        start, end = int(f[3]) - 1, int(f[4])
    except ValueError:
        return None
    attrs = {}
    for part in f[8].split(";"):
        key, _, value = part.strip().partition(" ")
        if key and key != ".":
            attrs[key] = value.replace('"', "").strip()
    return (f[0], f[1], f[2], start, end, f[5], f[6], f[7], attrs)


class GtfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gtf"

    def schema(self) -> str:
        return "seqid string, source string, feature string, start long, end long, score string, strand string, phase string, attrs map<string,string>"

    def reader(self, schema) -> GtfReader:
        return GtfReader(self.options["path"])


@udtf(returnType="node_start: bigint, node_end: bigint")
class SplitTransfrag:
    """Nodes (neighbouring ``bounds``, sorted) that overlap any exon, in order."""

    def eval(self, starts: list, ends: list, bounds: list):
        at = 0
        for start, end in sorted(zip(starts, ends)):
            first = max(at, bisect_right(bounds, start) - 1)
            at = bisect_left(bounds, end)
            for k in range(max(first, 0), min(at, len(bounds) - 1)):
                yield bounds[k], bounds[k + 1]


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(GtfSource)
    spark.udtf.register("split_transfrag", SplitTransfrag)
    return spark

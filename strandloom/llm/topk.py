"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are held in blocks of bounded size.  In a block every dimension is a list of its vectors
sorted by value; a query reads its lists in equal steps, from the end that helps it.  After each
step every vector has a lower and an upper bound of its score: what was read in full, what was not
read at the list's far end and at the place last read.  Reading stops when few vectors are left
whose upper bound reaches the k-th best lower bound; their scores are then resolved.  All queries
of a query block read in step, so a bound of all of them is a product of matrices.

The k-th best resolved score of a query is carried from block to block, so that later blocks are
left earlier.  Query blocks meet vector blocks as a stated set against all rows; blocks and the k
best of each block are bounded, and the final rank is a window whose group limit works before the
shuffle.

Results for odd input: vectors that are null, or hold null, NaN or infinite components, take no
part, nor do rows without an id; shorter vectors count as padded with zeros; an empty vector scores
0 with everything; repeated ids stay separate candidates, the least vector of a repeated query id
is the query; scores beyond 64 bits are clipped to the range of a long; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 4096
QUERY_BLOCK = 256
#: A block's bytes, which cut its rows where vectors are long.
BLOCK_BYTES = 4 << 20
#: Reading a whole list takes so many steps.
STEPS = 16
#: A block's first rows are read alone: their best scores are the first bar.
PILOT = 512
#: Rows whose bounds tell whether those of all rows are worth working out.
PROBED = 512
#: Query blocks whose best scores a task carries; others start each block without a bar.
CARRIED = 1024
LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part, components floor(scale * x)."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
        .select("vec_id", F.transform(x, lambda e: e * F.lit(float(scale))).alias("v"))
    )


def _blocks(df: DataFrame, rows: int, shards: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors and BLOCK_BYTES (ids and a matrix of doubles, as bytes), dealt in turn."""

    def run(batches):
        number = TaskContext.get().partitionId()
        for batch in batches:
            lists = batch.column("v")
            ends = np.asarray(lists.offsets)
            values, ids = np.asarray(lists.values), np.asarray(batch.column("vec_id"))
            most = max(1, min(rows, BLOCK_BYTES // (8 * max(1, int(np.diff(ends).max(initial=0))))))
            for start in range(0, batch.num_rows, most):
                at = ends[start : start + most + 1]
                sizes = np.diff(at)
                matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
                row = np.repeat(np.arange(len(sizes)), sizes)
                matrix[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], sizes)] = np.floor(values[at[0] : at[-1]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([ids[start : start + most].astype(np.int64).tobytes()], pa.binary()),
                        "matrix": pa.array([matrix.tobytes()], pa.binary()),
                        "width": pa.array([matrix.shape[1]], pa.int32()),
                        "shard": pa.array([number % shards], pa.int32()),
                    }
                )
                number += 1

    return df.mapInArrow(run, "ids binary, matrix binary, width int, shard int")


class SortedLists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids = ids
        self.matrix = matrix
        self.sorted = np.sort(matrix, axis=0)
        self.largest = np.abs(matrix).max(initial=0.0)
        self.shift = int(np.frexp(self.largest)[1])
        self.fractions: tuple[np.ndarray, np.ndarray] | None = None
        self.read = 0  # places read of one list, summed over queries

    def _fractions(self) -> tuple[np.ndarray, np.ndarray]:
        """Components and lists as fractions, for scores beyond exact doubles."""
        if self.fractions is None:
            self.fractions = np.ldexp(self.matrix, -self.shift), np.ldexp(self.sorted, -self.shift)
        return self.fractions

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query, rows and scores of its k best, ties to smaller ids.

        ``bars`` are scores that k other vectors are known to reach.
        """
        n, width = self.matrix.shape
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(queries)
        if not n:
            return out
        top = np.abs(queries).max(initial=0.0)
        exact = float(max(self.largest, 1.0)) * float(max(top, 1.0)) * max(width, 1) < 2**52
        slack, high, low, asked = 0.0, np.inf, -np.inf, queries
        unit, ordered = self.matrix, self.sorted
        if not exact:
            unit, ordered = self._fractions()
            shift = int(np.frexp(top)[1])
            asked = np.ldexp(queries, -shift)
            slack = width * (width + 8) * 2.0**-52
            high, low = np.ldexp([float(LONG.max), float(LONG.min)], -shift - self.shift)
            bars = np.ldexp(bars, -shift - self.shift)
        live, rows, given = np.arange(len(queries)), np.arange(n), bool(np.isfinite(bars).all())
        bars = np.minimum(bars - slack, high)
        for step in range(1, STEPS + 1):
            depth = -(-n * step // STEPS)
            plus, minus = np.maximum(asked[live], 0.0), np.minimum(asked[live], 0.0)
            down, up = ordered[n - depth], ordered[depth - 1]
            if given and PROBED < len(rows) and depth < n:
                x = unit[rows[:: len(rows) // PROBED]]
                upper = plus @ np.maximum(x, down).T + minus @ np.minimum(x, up).T
                # Bounds of all rows are worked out where those of a few say that reading may stop.
                if np.median(np.mean(upper + slack >= bars[live][:, None], axis=1)) * len(rows) > 16 * k:
                    continue
            x = unit[rows]
            upper = plus @ np.maximum(x, down).T + minus @ np.minimum(x, up).T
            lower = plus @ np.where(x >= down, x, ordered[0]).T + minus @ np.where(x <= up, x, ordered[-1]).T
            other = self.ids[rows][None, :] != own[live][:, None]
            if len(rows) >= k:
                kth = np.partition(np.where(other, lower, -np.inf), len(rows) - k, axis=1)[:, len(rows) - k]
                bars[live] = np.maximum(bars[live], np.minimum(kth - slack, high))
            open_ = other & (np.maximum(upper + slack, low) >= bars[live][:, None])
            # Outsiders cannot qualify any more: what remains are candidates.
            done = (open_.sum(axis=1) <= 4 * k) | (depth == n)
            for q, mask in zip(live[done], open_[done]):
                self.read += depth
                out[q] = self._resolved(rows[mask], queries[q], k, exact)
            live, open_ = live[~done], open_[~done]
            if not len(live):
                break
            needed = open_.any(axis=0)
            if needed.mean() < 0.8:
                rows = rows[needed]
        return out

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        if exact:
            scores = np.rint(self.matrix[rows] @ query).astype(np.int64)
        else:  # whole numbers of any size
            q = [int(v) for v in query]
            scores = np.array([min(max(sum(int(a) * b for a, b in zip(self.matrix[r], q)), LONG.min), LONG.max) for r in rows], np.int64)
        top = np.lexsort((self.ids[rows], ~scores))[:k]  # ~ turns the order of all longs around
        return rows[top], scores[top]


class Carried:
    """The k best scores so far of the queries that a task has met."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[bytes, np.ndarray] = {}

    def bars(self, block: bytes, size: int) -> np.ndarray:
        return self.held[block].min(axis=1) if block in self.held else np.full(size, -np.inf)

    def add(self, block: bytes, found: list) -> None:
        if block not in self.held:
            if len(self.held) >= CARRIED:
                return
            self.held[block] = np.full((len(found), self.k), -np.inf)
        best = np.full((len(found), self.k), -np.inf)
        for row, (_, scores) in zip(best, found):
            row[: len(scores)] = scores
        best = np.concatenate([self.held[block], best], axis=1)
        self.held[block] = np.partition(best, self.k, axis=1)[:, self.k :]


def _padded(matrix: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(matrix), width))
    out[:, : min(width, matrix.shape[1])] = matrix[:, :width]
    return out


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of every query but its own."""
    spark = vectors.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = integer_vectors(vectors, id_col, vector_col, scale)
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    stored = _blocks(every, block, shards).repartition(shards, "shard")
    asked = (
        _blocks(asked, QUERY_BLOCK, 1)
        .select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .repartition(shards, "shard")
    )
    pairs = stored.join(asked, "shard").select("ids", "matrix", "width", "q_ids", "q_matrix", "q_width")

    def run(batches):
        carried = Carried(k)
        held: tuple[bytes, list[SortedLists]] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                raw, data, width, q_raw, q_data, q_width = (batch.column(c)[row].as_py() for c in range(6))
                if held is None or held[0] != raw:
                    ids = np.frombuffer(raw, np.int64)
                    matrix = np.frombuffer(data, np.float64).reshape(len(ids), width)
                    held = (raw, [SortedLists(ids[part], matrix[part]) for part in (slice(PILOT), slice(PILOT, None))])
                q_ids = np.frombuffer(q_raw, np.int64)
                share = _padded(np.frombuffer(q_data, np.float64).reshape(len(q_ids), q_width), width)
                for lists in held[1]:
                    found = lists.best(share, q_ids, k, carried.bars(q_raw, len(q_ids)))
                    carried.add(q_raw, found)
                    sizes = [len(rows) for rows, _ in found]
                    places, scores = (np.concatenate(x) for x in zip(*found))
                    columns = np.repeat(q_ids, sizes), lists.ids[places], scores
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

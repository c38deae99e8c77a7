"""GTF files that keep arriving in a folder, as a stream of parsed features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.text import parse_gtf


def stream_gtf(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return parse_gtf(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))

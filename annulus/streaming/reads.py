"""Alignments as a stream: SAM files that arrive in a folder, counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Alignment lines of the files in a folder; `files_per_trigger` bounds a batch."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return rows.where(~F.col("value").startswith("@") & (F.trim("value") != ""))


def placements(stream: DataFrame) -> DataFrame:
    """id, flags, reference_name, reference_start, mapping_quality."""
    field = F.split("value", "\t")
    return stream.select(
        field[0].alias("id"),
        field[1].cast("int").alias("flags"),
        field[2].alias("reference_name"),
        field[3].cast("int").alias("reference_start"),
        field[4].cast("int").alias("mapping_quality"),
    )


def quality_histogram(stream: DataFrame) -> DataFrame:
    """mapping_quality, n: a running count over all that has come."""
    return stream.groupBy("mapping_quality").agg(F.count("*").alias("n"))

"""Intermediate tables of the corpus operators: the library's, under one name, and documents with a row number."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.operators.shared import dropped, free_name, new_path, shared_dir, temporary, written

__all__ = ["dropped", "free_name", "keyed", "new_path", "shared_dir", "temporary", "written"]


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc): the documents with a row number that stays the same however often they are read."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "documents", "zstd")

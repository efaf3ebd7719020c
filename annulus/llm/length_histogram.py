"""Token counts by exact length histogram.

Documents are encoded once and aggregated by their encoded length; suffix sums
over the lengths then answer totals, quantiles and truncated totals for every
context limit without another pass over the corpus.

Nulls and empty texts have length 0; repeated rows count each time; an empty
table gives an empty histogram, whose answers are 0 (quantiles: null). Only the
text column is read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.workspace import written

#: Lengths are summed within buckets of this width and then over the buckets, so
#: that no task holds more than the lengths of one bucket.
BUCKET = 1024


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row (n_tokens) per document."""

    def lengths(batches):
        from annulus.llm.tokens import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            n = np.fromiter((len(x) for x in enc.encode(batch.column(0).to_pylist())), "int64", batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Rows by distinct length: n_tokens, n_docs, docs_ge and tokens_ge (documents of that length or
    more, and their tokens), docs_le, total_docs, total_tokens, truncated_tokens (what is left of the
    corpus when each document is cut to n_tokens)."""
    counts = (
        token_lengths(docs, tokenizer, text)
        .groupBy("n_tokens")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("bucket", F.expr(f"n_tokens div {BUCKET}"))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    )
    counts = written(counts, "lengths")  # read twice below; encoding is the costly part
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    parts = counts.select(
        "*",
        F.sum("n_docs").over(within).alias("docs_here"),
        F.sum("tokens").over(within).alias("tokens_here"),
        F.row_number().over(within).alias("rank"),
        F.count("*").over(Window.partitionBy("bucket")).alias("lengths"),
    )
    # The last row of a bucket carries the bucket's sums; only those rows meet in one task.
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = parts.where("rank = lengths").select(
        "bucket",
        zero(F.sum("docs_here").over(later)).alias("docs_later"),
        zero(F.sum("tokens_here").over(later)).alias("tokens_later"),
        F.sum("docs_here").over(whole).alias("total_docs"),
        F.sum("tokens_here").over(whole).alias("total_tokens"),
    )
    docs_ge = F.col("docs_here") + F.col("docs_later")
    tokens_ge = F.col("tokens_here") + F.col("tokens_later")
    return parts.join(sums, "bucket").select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("total_docs") - docs_ge + F.col("n_docs")).alias("docs_le"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_tokens"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit`."""
    row = histogram.agg(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")).alias("n")).first()
    return row["n"] or 0


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents don't exceed."""
    return histogram.where(F.col("docs_le") >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens")).first()[0]

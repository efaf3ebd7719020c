"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); run() writes a stage's
rows as Parquet into the shared folder and reads them as the next one's
documents. A stage sees all that its predecessor kept, and nothing else.

Nulls, ties, repeated rows and empty tables are as each operator's docstring
says: documents without text fail the quality rules, rows that share a doc_id or
have none are judged each by its own text, and empty documents give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm import compression_bands, line_runs, packing, poisson_mix, simhash
from annulus.llm.queries import tokenizer_path
from annulus.llm.workspace import dropped, temporary, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return compression_bands.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated runs of lines deleted but in their first place; n_chars follows the text."""
    done = line_runs.deduplicated(docs).where("not gone").select("doc.*")
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8."""
    return simhash.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn for the sources' target weights, shuffled."""
    return poisson_mix.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids in sequences of up to 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packed),
]

#: The quality stage's compression ratios can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):  # a stage's own tables go once its documents are written
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            dropped(last)  # a stage's documents, once the next ones are written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

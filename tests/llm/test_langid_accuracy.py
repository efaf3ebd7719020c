"""Held-out accuracy of the language query on the driver's documents, and that it learns from nothing else."""

from pyspark.sql import functions as F

from annulus.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op5_hierarchical_langid(spark, FOLDER).join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null")
    told = rows.where("held_out and length(text) > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert told.n > 100 and told.share > 0.97
    assert rows.count() == docs.where("lang is not null").count()


def test_held_out_labels_are_never_used(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(x).collect()} for x in (docs, wrong))
    assert a == b and "zz" not in {lang for lang, _ in a.values()}

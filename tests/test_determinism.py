"""The same query on one core and on several, and on permuted input."""

import hashlib
import json
import subprocess
import sys

import pytest

import __spark_entry__ as entry

NAMES = ["bh_fdr", "lineage_calls", "phase_links", "junction_clusters", "jaccard_pairs", "substitution_calls", "architecture_assignments", "matched_deletions", "molecule_lanes"]
CODE = """
import json, sys, hashlib
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("DIGESTS " + json.dumps({n: hashlib.md5(repr(sorted(map(repr, entry.queries()[n](spark, "/root/testdata/sf0.001").collect()))).encode()).hexdigest() for n in sys.argv[1:]}))
"""


@pytest.fixture(scope="module")
def alone():
    done = subprocess.run([sys.executable, "-c", CODE, *NAMES], capture_output=True, text=True, timeout=900)
    return json.loads(next(x for x in done.stdout.splitlines() if x.startswith("DIGESTS "))[8:])


@pytest.mark.parametrize("name", NAMES)
def test_one_core_gives_what_several_give(spark, alone, name):
    rows = sorted(map(repr, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    assert hashlib.md5(repr(rows).encode()).hexdigest() == alone[name]


@pytest.mark.parametrize("name", ["wilson_ci", "lineage_calls", "phase_links", "deletion_impact", "cluster_summary"])
def test_permuted_input_gives_the_same_rows(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    for table in ("lineitem", "orders", "part", "supplier"):
        rows = spark.read.parquet(f"{source}/{table}.parquet")
        rows.repartition(5).sortWithinPartitions(rows.columns[-1]).write.parquet(f"{tmp_path}/{table}.parquet")
    query = entry.queries()[name]
    assert sorted(map(repr, query(spark, str(tmp_path)).collect())) == sorted(map(repr, query(spark, source).collect()))

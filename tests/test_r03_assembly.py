"""What is sorted by name for an assembly holds no sequence."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from annulus.config import Config
from annulus.operators import molecules
from annulus.plans import carriers as C


def test_rows_that_are_aggregated_hold_no_sequence(spark):
    tags = F.create_map(F.lit("MI"), F.col("id"), F.lit("RX"), F.lit("U0"))
    reads = C.made_reads(spark, "/root/testdata/sf0.001").withColumn("aux_tags", tags)
    found = molecules.assembly(reads, Config(result_schema="0.6", molecule_id_tag="MI", umi_tag="RX"), 600)
    with redirect_stdout(io.StringIO()) as told:
        found.explain("formatted")
    nodes = [n for n in told.getvalue().split("\n\n") if "Aggregate\n" in n or "Aggregate (" in n.split("\n")[0] or "Sort\n" in n]
    inputs = [line for n in nodes for line in n.split("\n") if line.startswith("Input")]
    assert inputs and not any("sequence#" in line or "qualities#" in line or "cigar_operations#" in line for line in inputs)

"""Views of the driver's tables in the shape of the engine's relations, by integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.functions import text
from annulus.functions.genome import GENES

ALN_SQL = """aln AS (
  SELECT l_orderkey AS molecule, l_linenumber AS frag,
         (l_partkey * 83 + l_suppkey * 7 + l_linenumber * 997) % 16569 + 1 AS start,
         CAST(floor(l_quantity) AS BIGINT) * 20 AS len,
         CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END AS strand,
         CAST(round(l_discount * 100) AS BIGINT) * 6 AS mapq,
         CASE WHEN l_linenumber = 6 THEN 1024 WHEN l_linenumber = 7 THEN 256 ELSE 0 END AS flags,
         l_linestatus AS status
  FROM lineitem
)"""
PIECES_SQL = ALN_SQL + """, ranged AS (SELECT *, (start + len - 2) % 16569 + 1 AS "end" FROM aln),
pieces AS (
  SELECT molecule, frag, CAST(0 AS BIGINT) AS piece, start, CASE WHEN start <= "end" THEN "end" ELSE 16569 END AS "end" FROM ranged
  UNION ALL SELECT molecule, frag, CAST(1 AS BIGINT), 1, "end" FROM ranged WHERE start > "end"
)"""
OBS_SQL = """obs AS (
  SELECT molecule, event, state, quality, strand FROM (
    SELECT l_orderkey AS molecule, p_brand AS event,
           CASE l_returnflag WHEN 'R' THEN 'ALTERNATE' WHEN 'N' THEN 'REFERENCE' ELSE 'LOW_QUALITY' END AS state,
           CAST(floor(l_quantity) AS BIGINT) AS quality, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
           row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber, l_returnflag, l_quantity, l_linestatus) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n = 1
)"""
GENES_SQL = "genes(gene, gene_start, gene_end, gene_strand, biotype) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, '{d}', '{e}')" for a, b, c, d, e in GENES) + ")"
DEPTH_SQL = PIECES_SQL + """, changes AS (
  SELECT p, CAST(sum(d) AS BIGINT) AS d FROM (SELECT start AS p, 1 AS d FROM pieces UNION ALL SELECT "end" + 1, -1 FROM pieces) GROUP BY p
), depths AS (
  SELECT r.p AS position, CAST(sum(coalesce(c.d, 0)) OVER (ORDER BY r.p) AS BIGINT) AS depth
  FROM (SELECT unnest(range(1, 16570)) AS p) r LEFT JOIN changes c ON r.p = c.p
)"""
BASES_SQL = """bases AS (
  SELECT l_orderkey % 200 AS molecule, l_linenumber AS fragment, l_partkey % 60 + 1 AS position,
         substr('ACGT', CAST((l_suppkey + l_partkey) % 4 AS INTEGER) + 1, 1) AS base, CAST(floor(l_quantity) AS BIGINT) AS quality, l_orderkey AS query
  FROM lineitem
)"""

#: Cells of a pileup: a molecule's first base at each position, by strand.
CELLS_SQL = BASES_SQL + """, firsts AS (
  SELECT position, base, query % 2 AS strand FROM bases QUALIFY row_number() OVER (PARTITION BY molecule, position ORDER BY fragment, query, base) = 1
), cells AS (SELECT position, base, count(*) FILTER (strand = 0) AS forward, count(*) FILTER (strand = 1) AS reverse FROM firsts GROUP BY 1, 2)"""
#: An insertion for suppliers with an odd key, a deletion for the others, and alignments in which something is inserted.
SITES_SQL = """sites AS (SELECT s_suppkey AS event, s_suppkey % 2 = 1 AS insertion, s_suppkey * 7919 % 16569 + 1 AS start,
    CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 7919 % 16569 + 1 ELSE s_suppkey * 7919 % 16569 + s_suppkey % 40 + 1 END AS "end" FROM supplier),
broken AS (SELECT molecule, frag AS alignment, start + 5 AS anchor FROM aln WHERE mapq < 30)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("molecule"),
        n.alias("frag"),
        (F.pmod(F.col("l_partkey") * 83 + F.col("l_suppkey") * 7 + n * 997, F.lit(16569)) + 1).alias("start"),
        (F.floor("l_quantity") * 20).cast("long").alias("len"),
        F.when(F.col("l_returnflag") == "N", "+").otherwise("-").alias("strand"),
        (F.round(F.col("l_discount") * 100).cast("long") * 6).alias("mapq"),
        F.when(n == 6, 1024).when(n == 7, 256).otherwise(0).alias("flags"),
        F.col("l_linestatus").alias("status"),
    )


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aln(spark, sf_dir).withColumn("end", F.pmod(F.col("start") + F.col("len") - 2, F.lit(16569)) + 1)


def obs(spark: SparkSession, sf_dir: str, event: str = "p_brand") -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(
        F.col("l_orderkey").alias("molecule"),
        F.col(event).alias("event"),
        F.when(F.col("l_returnflag") == "R", "ALTERNATE").when(F.col("l_returnflag") == "N", "REFERENCE").otherwise("LOW_QUALITY").alias("state"),
        F.floor("l_quantity").cast("long").alias("quality"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.row_number().over(Window.partitionBy("l_orderkey", event).orderBy("l_linenumber", "l_returnflag", "l_quantity", "l_linestatus")).alias("n"),
    )
    return rows.where("n = 1").drop("n")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.pmod("l_orderkey", F.lit(200)).alias("molecule"),
        F.col("l_linenumber").alias("fragment"),
        (F.pmod("l_partkey", F.lit(60)) + 1).alias("position"),
        F.substring(F.lit("ACGT"), (F.pmod(F.col("l_suppkey") + F.col("l_partkey"), F.lit(4)) + 1).cast("int"), F.lit(1)).alias("base"),
        F.floor("l_quantity").cast("long").alias("quality"),
        F.col("l_orderkey").alias("query"),
    )


def read_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases as a pileup takes them."""
    rows = bases(spark, sf_dir).withColumnRenamed("fragment", "record_index").withColumn("strand", F.pmod("query", F.lit(2)).cast("int"))
    bin_ = F.least(F.floor(F.col("quality") / 5), F.lit(7)).cast("int")
    return rows.withColumn("quality_bin", bin_).withColumn("proximity_bin", F.pmod("query", F.lit(5)).cast("int")).withColumn("near_gap", F.pmod("query", F.lit(11)) == 0)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.pmod(key * 7919, F.lit(16569)) + 1
    insertion = F.pmod(key, F.lit(2)) == 1
    rows = table(spark, sf_dir, "supplier")
    return rows.select(key.alias("event"), insertion.alias("insertion"), start.alias("start"), F.when(insertion, start).otherwise(start + F.pmod(key, F.lit(40))).alias("end"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aln(spark, sf_dir).where("mapq < 30").select("molecule", F.col("frag").alias("alignment"), (F.col("start") + 5).alias("anchor"))


#: A made circular genome: its bases follow a rule with many short repeats.
GENOME_SIZE = 900
_BASE = lambda p: "ACGT"[((p // 3) * 5 + (p // 7) * (p // 11)) % 4]
GENOME = "".join(map(_BASE, range(1, GENOME_SIZE + 1)))
GENOME_SQL = f"""genome AS (SELECT string_agg(substr('ACGT', CAST((p // 3 * 5 + (p // 7) * (p // 11)) % 4 AS INTEGER) + 1, 1), '' ORDER BY p) AS g FROM range(1, {GENOME_SIZE + 1}) t(p))"""
#: Reads of it, one for each line item: a bases, x inserted ones, 30 more, y deleted ones (60 at five places, or up to 3), 110 more.
READS_SQL = GENOME_SQL + """, parts AS (
  SELECT l_orderkey AS molecule, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) AS record_index, l_linenumber AS line, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 16 END AS flags,
         CAST(round(l_discount * 100) AS BIGINT) * 6 AS mapq, 105 + CAST(floor(l_quantity) AS BIGINT) AS a, l_partkey % 4 AS x, l_suppkey % 5 = 0 AS large,
         CASE WHEN l_suppkey % 5 = 0 THEN 60 ELSE l_suppkey % 4 END AS y, 200 + 100 * (l_suppkey // 5 % 5) + l_partkey % 3 AS kept, (l_partkey * 7 + l_suppkey) % 500 + 1 AS own,
         l_orderkey % 3 = 0 AS changed, l_suppkey AS supp, l_partkey AS part
  FROM lineitem
), placed AS (SELECT *, CASE WHEN large THEN kept - a - 29 ELSE own END AS start FROM parts),
made AS (SELECT p.*, CASE WHEN molecule % 2 = 0 THEN substr(g, start + a, x) ELSE substr('GATTACA', 1, x) END AS ins, mapq >= 20 AS usable FROM placed p, genome)"""


def made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads above without their bases: places, CIGARs, and the lengths of their parts."""
    key, line, part, supp = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    a, x, large = (F.floor("l_quantity") + 105).cast("int"), F.pmod(part, F.lit(4)).cast("int"), F.pmod(supp, F.lit(5)) == 0
    y = F.when(large, 60).otherwise(F.pmod(supp, F.lit(4))).cast("int")
    kept = 200 + 100 * F.pmod(F.floor(supp / 5), F.lit(5)) + F.pmod(part, F.lit(3))
    start = F.when(large, kept - a - 29).otherwise(F.pmod(part * 7 + supp, F.lit(500)) + 1).cast("int")
    of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")  # some lines each
    rows = table(spark, sf_dir, "lineitem").select(key.alias("molecule"), (key * 1000 + F.row_number().over(of_order)).alias("record_index"), line.alias("line"), (F.round(F.col("l_discount") * 100) * 6).cast("int").alias("mapping_quality"),
                                                   F.when(F.col("l_returnflag") == "N", 0).otherwise(16).alias("flags"), supp.alias("supp"), part.alias("part"), a.alias("a"), x.alias("x"), y.alias("y"), start.alias("reference_start"))
    a, x, y = (F.col(c) for c in ("a", "x", "y"))
    piece = lambda n, code: F.when(n > 0, F.concat(n.cast("string"), F.lit(code)))
    cigar = F.concat_ws("", piece(a, "M"), piece(x, "I"), F.lit("30M"), piece(y, "D"), F.lit("110M"))
    return rows.withColumn("cigar", cigar).withColumn("cigar_operations", text.cigar_operations(F.col("cigar")))


def made_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads above as alignments, with CIGARs, bases and qualities."""
    return with_bases(made_rows(spark, sf_dir))


def with_bases(rows: DataFrame) -> DataFrame:
    """`made_rows` with bases and qualities; inserted bases of a first line are bad."""
    cut = lambda at, n: F.substring(F.lit(GENOME), at, n)
    s, a, x, y = (F.col(c) for c in ("reference_start", "a", "x", "y"))
    first = cut(s, a)
    swapped = F.concat(F.substring(first, 1, 10), F.translate(F.substring(first, 11, 1), "ACGT", "CGTA"), F.substring(first, F.lit(12), a))
    head = F.when(F.pmod("molecule", F.lit(3)) == 0, swapped).otherwise(first)
    inserted = F.when(F.pmod("molecule", F.lit(2)) == 0, cut(s + a, x)).otherwise(F.substring(F.lit("GATTACA"), F.lit(1), x))
    fine = lambda n: F.repeat(F.lit("I"), n)
    return rows.select(
        "molecule",
        "record_index",
        "line",
        "supp",
        "part",
        F.concat(F.lit("m"), F.col("molecule").cast("string")).alias("id"),
        "flags",
        "mapping_quality",
        F.lit("MT").alias("reference_name"),
        "reference_start",
        "cigar",
        F.concat(head, inserted, cut(s + a, F.lit(30)), cut(s + a + 30 + y, F.lit(110))).alias("sequence"),
        F.concat(fine(a), F.repeat(F.when(F.col("line") == 1, "!").otherwise("I"), x), fine(F.lit(140))).alias("qualities"),
        "cigar_operations",
    ).withColumn("supplementary_alignments", F.array().cast("array<struct<reference_name:string,position:int,strand:string,cigar:string>>"))

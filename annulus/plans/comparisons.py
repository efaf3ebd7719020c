"""Queries of call sets against each other and a truth, event rows, clusters and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import coords
from annulus.operators import comparison, intervals, reports
from annulus.plans import carriers as C
from annulus.plans.registry import query as _query

# Two call sets: changes of lineitem on either status, by position and base, with the mean level.
_SETS_SQL = """sets AS (SELECT l_linestatus AS side, l_partkey AS position, l_returnflag AS alt, avg(l_discount * 10) AS level, CAST(count(*) AS BIGINT) AS depth FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT * FROM sets WHERE side = 'F'), b AS (SELECT * FROM sets WHERE side = 'O')"""


def _sets(spark, d) -> tuple[DataFrame, DataFrame]:
    """The levels are summed in the table's own order: a sum of doubles depends on its order, and levels lie on the limits."""
    keys = ("side", "position", "alt")
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    rows = C.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("side"), F.col("l_partkey").alias("position"), F.col("l_returnflag").alias("alt"), (F.col("l_discount") * 10).alias("x"), at)
    running = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("so_far", F.sum("x").over(running)).groupBy(*keys)
    sets = summed.agg((F.max_by("so_far", "at") / F.count("x")).alias("level"), F.count("*").alias("depth"))
    return sets.where("side = 'F'").drop("side"), sets.where("side = 'O'").drop("side")


@_query(
    f"""WITH {_SETS_SQL} SELECT coalesce(a.position, b.position) AS position, coalesce(a.alt, b.alt) AS alt, CASE WHEN b.position IS NULL THEN 'only_first' WHEN a.position IS NULL THEN 'only_second' ELSE 'both' END AS side,
  round(a.level, 6) AS first_level, round(b.level, 6) AS second_level, round(a.level - b.level, 6) + 0.0 AS difference FROM a FULL JOIN b ON a.position = b.position AND a.alt = b.alt"""
)
def callset_levels(spark, d):
    rows = comparison.differential(*_sets(spark, d), ["position", "alt"], "level")
    return rows.select("position", "alt", "side", *((F.round(c, 6) + 0.0).alias(c) for c in ("first_level", "second_level", "difference")))


@_query(
    f"""WITH {_SETS_SQL}, j AS (SELECT coalesce(a.alt, b.alt) AS alt, a.position IS NOT NULL AS x, b.position IS NOT NULL AS y, abs(a.level - b.level) AS e FROM a FULL JOIN b ON a.position = b.position AND a.alt = b.alt)
SELECT alt, count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (y AND NOT x) AS only_second, round(avg(e), 6) AS level_error, round(count(*) FILTER (x AND y) * 1.0 / count(*), 6) AS agreement FROM j GROUP BY alt"""
)
def callset_agreement(spark, d):
    rows = comparison.differential_summary(comparison.differential(*_sets(spark, d), ["position", "alt"], "level"), "alt")
    return rows.select("alt", "both", "only_first", "only_second", F.round("level_error", 6).alias("level_error"), F.round("agreement", 6).alias("agreement"))


def _scores_sql(calls: str) -> str:
    return f"""WITH {_SETS_SQL}, calls AS ({calls}), j AS (SELECT c.position IS NOT NULL AS x, b.position IS NOT NULL AS y, coalesce(b.level >= 0.4, false) AS w, abs(c.level - b.level) AS e FROM calls c FULL JOIN b ON c.position = b.position AND c.alt = b.alt),
n AS (SELECT count(*) FILTER (x AND y AND w) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (y AND NOT x AND w) AS fn, round(avg(e) FILTER (x AND y AND w), 6) AS level_error FROM j),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 1.0 END AS q FROM n)
SELECT tp, fp, fn, level_error, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r"""


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("level_error", "precision", "recall", "f1")))


@_query(_scores_sql("SELECT * FROM a"))
def set_scores(spark, d):
    calls, truth = _sets(spark, d)
    return _rounded(comparison.set_scores(calls, truth, ["position", "alt"], "level", 0.4))


@_query(_scores_sql("SELECT * FROM a WHERE level >= 0.5 AND depth >= 2"))
def threshold_scores(spark, d):
    calls, truth = _sets(spark, d)
    scored = comparison.set_scores(comparison.above(calls, "level", 0.5, 2), truth, ["position", "alt"], "level", 0.4)
    return _rounded(scored)


def _deletions(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = C.table(spark, d, "orders")
    one = lambda t: rows.where(t).select(F.col("o_orderkey").alias("event"), F.pmod(F.col("o_orderkey") * 7919, F.lit(coords.L)).alias("start"), (F.pmod("o_custkey", F.lit(3)) + 50).alias("length"))
    return one("o_orderstatus = 'F'"), one("o_orderstatus = 'O'")


@_query()
def matched_deletions(spark, d):
    return comparison.matched_deletions(*_deletions(spark, d))


@_query(
    """WITH m AS (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_size <> 5), f AS (SELECT p_partkey AS k, md5(CASE WHEN p_size = 7 THEN 'x' ELSE p_name END) AS h FROM part WHERE p_size <> 9)
SELECT coalesce(m.k, f.k) AS k, CASE WHEN f.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unlisted' ELSE 'changed' END AS problem FROM m FULL JOIN f ON m.k = f.k WHERE m.h IS DISTINCT FROM f.h"""
)
def manifest_differences(spark, d):
    part = C.table(spark, d, "part")
    manifest = part.where("p_size <> 5").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("h"))
    files = part.where("p_size <> 9").select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_size") == 7, "x").otherwise(F.col("p_name"))).alias("h"))
    return comparison.files_against_manifest(manifest, files, "k", "h")


# Event rows: substitutions, deletions and insertions of parts, structural events of suppliers.
_ROWS_SQL = """v AS (SELECT CAST(p_partkey AS BIGINT) AS position, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'ACC' ELSE 'A' END AS ref, CASE p_size % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'A' ELSE 'ATT' END AS alt, p_size % 20 AS alternate, p_size % 20 + p_partkey % 30 AS callable FROM part),
rows AS (SELECT position || ':' || ref || ':' || alt AS event, CASE WHEN length(ref) = length(alt) THEN 'substitution' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'insertion' END AS kind, position, position + length(ref) - 1 AS last,
  CASE WHEN callable > 0 THEN alternate * 1.0 / callable END AS level, alternate, callable FROM v
UNION ALL SELECT 'sv' || s_suppkey, 'inversion', s_suppkey, s_suppkey + 100, CASE WHEN floor(s + (l + r) / 2.0 + 0.5) > 0 THEN s / floor(s + (l + r) / 2.0 + 0.5) END, s, CAST(floor(s + (l + r) / 2.0 + 0.5) AS BIGINT)
  FROM (SELECT s_suppkey, s_suppkey % 5 AS s, s_suppkey % 7 AS l, s_suppkey % 4 AS r FROM supplier))"""


def _rows(spark, d) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    n = F.pmod(size, F.lit(3))
    ref, alt = F.when(n == 1, "ACC").otherwise("A"), F.when(n == 0, "G").when(n == 1, "A").otherwise("ATT")
    few = F.pmod(size, F.lit(20))
    variants = C.table(spark, d, "part").select(key.alias("position"), ref.alias("ref"), alt.alias("alt"), few.cast("long").alias("alternate"), (few + F.pmod(key, F.lit(30))).cast("long").alias("callable"))
    s = F.col("s_suppkey")
    part = lambda k: F.pmod(s, F.lit(k))
    events = C.table(spark, d, "supplier").select(F.concat(F.lit("sv"), s.cast("string")).alias("event"), F.lit("inversion").alias("kind"), s.alias("start"), (s + 100).alias("end"), part(5).alias("support"), part(7).alias("left_spanning"), part(4).alias("right_spanning"))
    return reports.event_rows(variants, events)


@_query(f"WITH {_ROWS_SQL} SELECT event, kind, position, last, round(level, 6) AS level, CAST(alternate AS BIGINT) AS alternate, CAST(callable AS BIGINT) AS callable FROM rows")
def event_rows(spark, d):
    return _rows(spark, d).withColumn("level", F.round("level", 6))


@_query(f"WITH {_ROWS_SQL} SELECT event, kind, position FROM rows WHERE kind IN ('substitution', 'inversion') AND level >= 0.3 AND position % 7 <> 0 AND position % 4 = 1 AND (contains(lower(event), '1') OR contains(kind, '1') OR contains('mt-g' || position % 4, '1'))")
def shown_events(spark, d):
    gene = F.concat(F.lit("MT-G"), F.pmod("position", F.lit(4)).cast("string"))
    flags = F.when(F.pmod("position", F.lit(7)) == 0, F.array(F.lit("LOW"))).otherwise(F.array().cast("array<string>"))
    rows = _rows(spark, d).withColumn("genes", F.array(gene)).withColumn("flags", flags)
    return reports.shown_events(rows, ["substitution", "inversion"], "MT-G1", 0.3, True, " 1 ").select("event", "kind", "position")


@_query(f"WITH {_ROWS_SQL} SELECT count(*) AS events, count(*) FILTER (alternate > 5) AS passing, count(*) FILTER (level < 0.5) AS low_level, count(*) FILTER (kind = 'inversion') AS structural, count(*) FILTER (position % 7 = 0) AS flagged FROM rows")
def key_counts(spark, d):
    flags = F.when(F.pmod("position", F.lit(7)) == 0, F.array(F.lit("LOW"))).otherwise(F.array().cast("array<string>"))
    return reports.key_counts(_rows(spark, d).withColumn("pass", F.col("alternate") > 5).withColumn("flags", flags))


_CALLS_SQL = """calls AS (SELECT CAST(p_partkey AS BIGINT) AS position, 'A' AS ref, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'G' END AS alt, CAST(p_size + 20 AS BIGINT) AS depth, CAST(p_size % 15 AS BIGINT) AS alternate_depth, p_size % 15 / (p_size + 20.0) AS fraction, p_size % 4 <> 0 AS pass, p_size / 100.0 AS p FROM part),
originals AS (SELECT position, ref, alt, CAST(position % 30 AS BIGINT) AS ref_depth, CAST(position % 3 AS BIGINT) AS other_depth FROM calls WHERE position % 5 <> 0)"""


def _calls(spark, d) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size")
    few = F.pmod(size, F.lit(15)).cast("long")
    calls = C.table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.lit("A").alias("ref"), F.when(F.pmod(size, F.lit(2)) == 0, "C").otherwise("G").alias("alt"), (size + 20).cast("long").alias("depth"), few.alias("alternate_depth"), (few / (size + 20.0)).alias("fraction"), (F.pmod(size, F.lit(4)) != 0).alias("pass"), (size / 100.0).alias("p"))
    p = F.col("position")
    return calls, calls.where(p % 5 != 0).select("position", "ref", "alt", F.pmod(p, F.lit(30)).alias("ref_depth"), F.pmod(p, F.lit(3)).alias("other_depth"))


@_query(
    f"""WITH {_CALLS_SQL} SELECT position, ref, alt, depth, alternate_depth, round(fraction, 6) AS fraction, coalesce(ref_depth, depth - alternate_depth) AS ref_depth, coalesce(other_depth, 0) AS other_depth FROM calls LEFT JOIN originals USING (position, ref, alt) WHERE pass"""
)
def substitution_projection(spark, d):
    return reports.substitution_projection(*_calls(spark, d)).withColumn("fraction", F.round("fraction", 6))


@_query(
    f"""WITH {_CALLS_SQL} SELECT position || ':' || ref || ':' || alt AS id, 'substitution' AS kind, position, ref, alt, CAST(1 AS BIGINT) AS length, round(fraction, 6) AS fraction, depth, alternate_depth FROM calls WHERE pass
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'pdel:' ELSE 'pins:' END || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'deletion' ELSE 'insertion' END, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ACC' ELSE 'A' END, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'ACC' END, 2, 0.25, 40, 10 FROM supplier WHERE s_suppkey % 3 <> 0"""
)
def supported_calls(spark, d):
    calls, originals = _calls(spark, d)
    key = F.col("s_suppkey")
    gone = F.pmod(key, F.lit(2)) == 0
    long = lambda n: F.lit(n).cast("long")
    indels = C.table(spark, d, "supplier").select(
        F.concat(F.when(gone, "pdel:").otherwise("pins:"), key.cast("string")).alias("id"), gone.alias("deletion"), key.alias("vcf_position"), F.when(gone, "ACC").otherwise("A").alias("vcf_ref"), F.when(gone, "A").otherwise("ACC").alias("vcf_alt"),
        long(2).alias("length"), F.lit(0.25).alias("fraction"), long(40).alias("depth"), long(10).alias("raw_alternate"), (F.pmod(key, F.lit(3)) != 0).alias("pass"),
    )
    return reports.supported_calls(calls, originals, indels).withColumn("fraction", F.round("fraction", 6))


@_query(f"WITH {_CALLS_SQL} SELECT position, alt, p FROM calls WHERE NOT pass ORDER BY p, position, alt LIMIT 25")
def top_filtered_calls(spark, d):
    return reports.top_filtered(_calls(spark, d)[0]).select("position", "alt", "p")


_READS_SQL = """reads AS (SELECT o_orderkey AS read, o_custkey % 30 AS cluster, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderstatus <> 'P' AS pass FROM orders), marks AS (SELECT DISTINCT l_orderkey AS read, 'e' || l_partkey % 12 AS event FROM lineitem)"""


def _reads(spark, d) -> DataFrame:
    return C.table(spark, d, "orders").select(F.col("o_orderkey").alias("read"), F.pmod("o_custkey", F.lit(30)).alias("cluster"), F.floor("o_totalprice").cast("long").alias("length"), (F.col("o_orderstatus") != "P").alias("pass"))


def _events(spark, d, name: str) -> DataFrame:
    return C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.concat(F.lit("e"), F.pmod("l_partkey", F.lit(12)).cast("string")).alias(name))


@_query(
    f"""WITH {_READS_SQL}, sizes AS (SELECT cluster, count(*) AS reads, CAST(sum(length) AS BIGINT) AS bases FROM reads GROUP BY 1), counts AS (SELECT cluster, event, count(*) AS n FROM reads JOIN marks USING (read) GROUP BY 1, 2),
kinds AS (SELECT cluster, count(*) AS signatures, max(n) AS of_reads FROM counts GROUP BY 1), top AS (SELECT cluster, event AS commonest FROM counts QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, event DESC) = 1)
SELECT cluster, reads, bases, coalesce(signatures, 0) AS signatures, commonest, coalesce(of_reads, 0) AS of_reads FROM sizes LEFT JOIN kinds USING (cluster) LEFT JOIN top USING (cluster)"""
)
def cluster_summary(spark, d):
    return reports.cluster_summary(_reads(spark, d), _events(spark, d, "event"))


@_query(f"WITH {_READS_SQL} SELECT cluster, event AS change, count(*) AS carriers, round(count(*) * 1.0 / any_value(n), 6) AS share FROM reads JOIN marks USING (read) JOIN (SELECT cluster, count(*) AS n FROM reads GROUP BY 1) USING (cluster) GROUP BY 1, 2")
def cluster_frequency(spark, d):
    return reports.cluster_frequency(_reads(spark, d), _events(spark, d, "change")).withColumn("share", F.round("share", 6))


@_query(f"WITH {_READS_SQL} SELECT event AS change, cluster, count(*) AS n FROM marks LEFT JOIN (SELECT * FROM reads WHERE pass) USING (read) GROUP BY 1, 2")
def supporter_clusters(spark, d):
    return reports.supporter_clusters(_events(spark, d, "change"), _reads(spark, d).where("pass"))


@_query(f"WITH {_READS_SQL}, p AS (SELECT * FROM reads WHERE pass) SELECT event AS change, count(*) AS support, round(count(*) * 1.0 / (SELECT count(*) FROM p), 6) AS share FROM marks JOIN p USING (read) GROUP BY 1")
def plain_variants(spark, d):
    return reports.plain_variants(_reads(spark, d), _events(spark, d, "change")).withColumn("share", F.round("share", 6))


@_query("SELECT event, n, CASE WHEN event IN ('e1', 'e2', 'e3') THEN 'deletion' ELSE 'unknown' END AS kind FROM (SELECT 'e' || l_partkey % 12 AS event, count(*) AS n FROM lineitem GROUP BY 1)")
def counts_with_default(spark, d):
    dimension = spark.createDataFrame([("e1", "deletion"), ("e2", "deletion"), ("e3", "deletion")], "event string, kind string")
    return reports.with_default(_events(spark, d, "event").groupBy("event").agg(F.count("*").alias("n")), dimension, "event", "unknown")


_COVER_SQL = C.DEPTH_SQL + """, binned AS (SELECT (position * 200 - 1) // 16569 AS bin, min(position) AS start, max(position) AS "end", CAST((sum(depth) + count(*) // 2) // count(*) AS BIGINT) AS mean_depth FROM depths GROUP BY 1)"""


def _molecule_bins(spark, d) -> DataFrame:
    return reports.molecule_bins(intervals.depth(intervals.split_at_origin(C.ranged(spark, d).select("start", "end"))), 200)


@_query(f'WITH {_COVER_SQL} SELECT bin, start, "end", mean_depth FROM binned')
def molecule_bins(spark, d):
    return _molecule_bins(spark, d)


@_query(
    f"""WITH {_COVER_SQL}, l AS (SELECT *, "end" - start + 1 AS n FROM binned)
SELECT round(sum(mean_depth * n) * 1.0 / sum(n), 6) AS mean_depth, round(sum(CASE WHEN mean_depth > 20 THEN n ELSE 0 END) * 100.0 / sum(n), 6) AS percent_over_20, max(mean_depth) AS max_depth, count(*) FILTER (mean_depth = 0) AS zero_bins, count(*) FILTER (mean_depth > 0 AND mean_depth < 20) AS low_bins FROM l"""
)
def coverage_summary(spark, d):
    rows = reports.coverage_summary(_molecule_bins(spark, d))
    return rows.withColumn("mean_depth", F.round("mean_depth", 6)).withColumn("percent_over_20", F.round("percent_over_20", 6))


@_query(
    """WITH a AS (SELECT s_suppkey AS residue, s_suppkey % 23 * 1.5 AS x, s_suppkey % 17 * 1.5 AS y, s_suppkey % 11 * 1.5 AS z FROM supplier), p AS (SELECT a.residue, b.residue AS neighbour, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS distance FROM a JOIN a b ON a.residue <> b.residue GROUP BY 1, 2)
SELECT residue, neighbour, round(distance, 6) AS distance FROM p WHERE distance <= 10"""
)
def residue_contacts(spark, d):
    key = F.col("s_suppkey")
    at = lambda k: F.pmod(key, F.lit(k)) * 1.5
    atoms = C.table(spark, d, "supplier").select(key.alias("residue"), at(23).alias("x"), at(17).alias("y"), at(11).alias("z"))
    return reports.contacts(atoms, atoms, 10.0).withColumn("distance", F.round("distance", 6))


@_query('SELECT molecule, min(start) AS start, max("end") AS "end" FROM (WITH ' + C.PIECES_SQL + ' SELECT * FROM pieces) GROUP BY molecule')
def molecule_extents(spark, d):
    return reports.molecule_extents(intervals.split_at_origin(C.ranged(spark, d).select("molecule", "start", "end")))


@_query()
def molecule_lanes(spark, d):
    extents = reports.molecule_extents(intervals.split_at_origin(C.ranged(spark, d).select("molecule", "start", "end"))).withColumn("view", F.pmod("molecule", F.lit(50)))
    return reports.lanes(extents, "view", "start", "end", gap=82)


@_query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3")
def first_of_each(spark, d):
    return reports.first_of_each(C.table(spark, d, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"], 3).select("o_custkey", "o_orderkey")

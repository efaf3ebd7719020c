"""Registered queries: each operator applied to the driver's tables, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords, genome, stats, text
from annulus.operators import alignments, annotation, architectures, calls, comparison, events, evidence, exports, intervals, ordered, paths, similarity
from annulus.operators.shared import dealt, written
from annulus.plans import annotations, comparisons, documents, reads, scalars  # noqa: F401 - they register their queries
from annulus.plans import carriers as C
from annulus.plans.registry import oracle_sql, queries  # noqa: F401 - what the driver's entry reads
from annulus.plans.registry import query as _query

def _w(k: str, n: str, bound: str) -> str:
    """Wilson bounds in SQL."""
    z, p = stats.Z, f"({k} * 1.0 / {n})"
    center, scale = f"({p} + {z * z} / (2 * {n}))", f"(1 + {z * z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})))"
    return f"greatest(0.0, ({center} - {half}) / {scale})" if bound == "low" else f"least(1.0, ({center} + {half}) / {scale})"


@_query(f"WITH {C.ALN_SQL} SELECT molecule, frag, start, mapq FROM aln WHERE flags = 0 AND mapq >= 20")
def aln_filter(spark, d):
    rows = C.aln(spark, d).select("*", F.col("mapq").alias("mapping_quality"), F.col("start").alias("reference_start"), F.lit("MT").alias("reference_name"))
    return rows.where(alignments.passes_filters(Config())).select("molecule", "frag", "start", "mapq")


@_query(
    f"""WITH {C.ALN_SQL} SELECT coalesce(reason, 'NONE') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN flags & 256 <> 0 THEN 'SECONDARY_ALIGNMENT' WHEN flags & 1024 <> 0 THEN 'DUPLICATE_ALIGNMENT'
              WHEN mapq < 20 THEN 'LOW_MAPPING_QUALITY' WHEN molecule % 11 = 0 THEN 'NON_MITOCHONDRIAL_ALIGNMENT'
              WHEN molecule % 13 = 0 THEN 'MISSING_CIGAR' END AS reason FROM aln) GROUP BY 1"""
)
def exclusion_reason(spark, d):
    rows = C.aln(spark, d).select(
        "flags",
        F.col("mapq").alias("mapping_quality"),
        F.col("start").alias("reference_start"),
        F.when(F.pmod("molecule", F.lit(11)) == 0, "chr7").otherwise("MT").alias("reference_name"),
        text.cigar_operations(F.when(F.pmod("molecule", F.lit(13)) == 0, "*").otherwise("10M")).alias("cigar_operations"),
        F.lit("ACGT").alias("sequence"),
        F.lit("IIII").alias("qualities"),
    )
    return rows.groupBy(F.coalesce(alignments.exclusion_reason(Config()), F.lit("NONE")).alias("reason")).agg(F.count("*").alias("n"))


@_query(f'WITH {C.PIECES_SQL} SELECT molecule, frag, piece, start, "end" FROM pieces')
def circular_wrap_split(spark, d):
    return intervals.split_at_origin(C.ranged(spark, d).select("molecule", "frag", "start", "end"))


def _depth(spark, d):
    return intervals.depth(intervals.split_at_origin(C.ranged(spark, d).select("start", "end")))


_BINS_SQL = f"""WITH {C.DEPTH_SQL}, binned AS (
  SELECT least((position - 1) // 92, 179) AS bin, min(position) AS start, max(position) AS "end", CAST(floor(sum(depth) / count(*) + 0.5) AS BIGINT) AS mean_depth
  FROM depths GROUP BY 1)"""


@_query(_BINS_SQL + ' SELECT bin, start, "end", mean_depth FROM binned')
def coverage_bins(spark, d):
    return intervals.bins(_depth(spark, d))


@_query(
    _BINS_SQL
    + """ SELECT CASE WHEN mean_depth = 0 THEN '0' WHEN mean_depth < 10 THEN '1-9' WHEN mean_depth < 100 THEN '10-99' WHEN mean_depth < 1000 THEN '100-999' ELSE '1000+' END AS depth_class,
  CAST(sum("end" - start + 1) AS BIGINT) AS positions FROM binned GROUP BY 1"""
)
def coverage_distribution(spark, d):
    return intervals.depth_classes(intervals.bins(_depth(spark, d)))


@_query(f"WITH {C.DEPTH_SQL} SELECT round(avg(depth), 6) AS mean_depth, max(depth) AS max_depth, round(100.0 * count(*) FILTER (depth > 20) / count(*), 6) AS percent_over_20 FROM depths")
def coverage_metrics(spark, d):
    return _depth(spark, d).agg(
        F.round(F.avg("depth"), 6).alias("mean_depth"), F.max("depth").alias("max_depth"), F.round(F.count_if(F.col("depth") > 20) * 100.0 / F.count("*"), 6).alias("percent_over_20")
    )


def _merged_sql(gap: int) -> str:
    return f"""WITH {C.PIECES_SQL}, reach AS (
  SELECT molecule, start, "end", max("end") OVER (PARTITION BY molecule ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pieces
), numbered AS (
  SELECT *, sum(CASE WHEN r IS NULL OR start > r + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY molecule ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM reach
) SELECT molecule, min(start) AS start, max("end") AS "end" FROM numbered GROUP BY molecule, i"""


@_query(_merged_sql(1))
def callable_ranges(spark, d):
    return intervals.merged(intervals.split_at_origin(dealt(C.ranged(spark, d).select("molecule", "start", "end"), "molecule")), ["molecule"])


@_query(_merged_sql(26))
def bridged_ranges(spark, d):
    return intervals.merged(intervals.split_at_origin(dealt(C.ranged(spark, d).select("molecule", "start", "end"), "molecule")), ["molecule"], gap=26)


@_query(
    f"""WITH {C.DEPTH_SQL}, deep AS (
  SELECT position, position - row_number() OVER (ORDER BY position) AS run FROM depths
  WHERE depth >= (SELECT greatest(3.0, 0.1 * list_sort(list(depth))[count(*) // 2 + 1]) FROM depths)
) SELECT min(position) AS start, max(position) AS "end" FROM deep GROUP BY run"""
)
def deep_ranges(spark, d):
    return intervals.deep_ranges(_depth(spark, d))


@_query(f"WITH {C.ALN_SQL} SELECT mapq, count(*) AS n FROM aln GROUP BY mapq")
def mapq_histogram(spark, d):
    return C.aln(spark, d).groupBy("mapq").agg(F.count("*").alias("n"))


@_query(f"WITH {C.ALN_SQL} SELECT molecule, frag, mapq, start FROM aln QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY mapq DESC, frag, start) = 1")
def molecule_representative(spark, d):
    return evidence.representative(C.aln(spark, d).select("molecule", "frag", "mapq", "start"), "molecule", "mapq", "frag", "start")


_BEST_SQL = f"""WITH {C.BASES_SQL}, best AS (
  SELECT molecule, position, fragment, quality, CASE WHEN two THEN 'N' ELSE base END AS base, two AS conflict FROM (
    SELECT *, min(base) OVER w <> max(base) OVER w AS two, row_number() OVER (PARTITION BY molecule, position ORDER BY quality DESC, fragment, query) AS n
    FROM bases WINDOW w AS (PARTITION BY molecule, position)) WHERE n = 1)"""


@_query(_BEST_SQL + " SELECT molecule, position, fragment, quality, base, conflict FROM best")
def best_observation(spark, d):
    return evidence.best_observation(C.bases(spark, d)).select("molecule", "position", "fragment", "quality", "base", "conflict")


_LEVELS_SQL = (
    _BEST_SQL
    + ", levels AS (SELECT position, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base <> 'N') AS callable FROM best GROUP BY position)"
)


@_query(_LEVELS_SQL + " SELECT * FROM levels")
def locus_pivot(spark, d):
    return evidence.locus_levels(evidence.best_observation(C.bases(spark, d)))


def _reference(levels: DataFrame) -> DataFrame:
    return levels.select("position", F.substring(F.lit("ACGT"), (F.pmod("position", F.lit(4)) + 1).cast("int"), F.lit(1)).alias("ref"))


@_query(
    _LEVELS_SQL
    + f""", long AS (SELECT position, callable, 'A' AS alt, a AS support FROM levels UNION ALL SELECT position, callable, 'C', c FROM levels
  UNION ALL SELECT position, callable, 'G', g FROM levels UNION ALL SELECT position, callable, 'T', t FROM levels)
SELECT position, substr('ACGT', CAST(position % 4 AS INTEGER) + 1, 1) AS ref, alt, support, callable, round(support * 1.0 / callable, 6) AS level,
  round({_w("support", "callable", "low")}, 6) AS ci_low, round({_w("support", "callable", "high")}, 6) AS ci_high
FROM long WHERE support > 0 AND alt <> substr('ACGT', CAST(position % 4 AS INTEGER) + 1, 1)"""
)
def wilson_ci(spark, d):
    levels = evidence.locus_levels(evidence.best_observation(C.bases(spark, d)))
    found = evidence.variants(levels, _reference(levels))
    return found.select("position", "ref", "alt", "support", "callable", *(F.round(c, 6).alias(c) for c in ("level", "ci_low", "ci_high")))


@_query(
    f"""WITH {C.OBS_SQL} SELECT event, count(*) FILTER (state = 'ALTERNATE') AS alternate, count(*) FILTER (state = 'REFERENCE') AS reference,
  count(*) FILTER (state IN ('ALTERNATE', 'REFERENCE', 'EVENT_ABSENT')) AS callable, count(*) FILTER (state = 'ALTERNATE' AND strand = '+') AS forward,
  round(avg(quality) FILTER (state = 'ALTERNATE'), 6) AS quality_mean, min(quality) FILTER (state = 'ALTERNATE') AS quality_min, max(quality) FILTER (state = 'ALTERNATE') AS quality_max
FROM obs GROUP BY event"""
)
def allele_summary(spark, d):
    return evidence.allele_summary(C.obs(spark, d), "event").withColumn("quality_mean", F.round("quality_mean", 6))


@_query(f"WITH {C.OBS_SQL} SELECT event, count(*) FILTER (state = 'ALTERNATE') AS \"ALTERNATE\", count(*) FILTER (state = 'REFERENCE') AS \"REFERENCE\", count(*) FILTER (state = 'LOW_QUALITY') AS \"LOW_QUALITY\" FROM obs GROUP BY event")
def state_pivot(spark, d):
    return C.obs(spark, d).groupBy("event").pivot("state", ["ALTERNATE", "REFERENCE", "LOW_QUALITY"]).count().fillna(0)


_PHASE = "(\"both\" * 1.0 / callable)"


@_query(
    f"""WITH {C.OBS_SQL}, t AS (
  SELECT a.event AS event_a, b.event AS event_b, count(*) FILTER (a.state = 'ALTERNATE' OR b.state = 'ALTERNATE') AS seen,
    count(*) FILTER (a.state = 'ALTERNATE' AND b.state = 'ALTERNATE') AS "both", count(*) FILTER (a.state = 'ALTERNATE' AND b.state = 'REFERENCE') AS only_a,
    count(*) FILTER (a.state = 'REFERENCE' AND b.state = 'ALTERNATE') AS only_b, count(*) FILTER (a.state = 'REFERENCE' AND b.state = 'REFERENCE') AS neither,
    count(*) FILTER (a.state = 'LOW_QUALITY' OR b.state = 'LOW_QUALITY') AS uncertain
  FROM obs a JOIN obs b ON a.molecule = b.molecule AND a.event < b.event GROUP BY 1, 2
), n AS (SELECT *, nullif("both" + only_a + only_b + neither, 0) AS callable FROM t WHERE seen > 0)
SELECT event_a, event_b, "both", only_a, only_b, neither, uncertain, coalesce(callable, 0) AS callable, round({_PHASE}, 6) AS fraction,
  coalesce(round({_w('"both"', "callable", "low")}, 6), 0.0) AS ci_low, CASE WHEN callable IS NULL THEN 0.0 ELSE round({_w('"both"', "callable", "high")}, 6) END AS ci_high,
  round(("both" + only_a) * 1.0 / callable * (("both" + only_b) * 1.0 / callable), 6) AS expected,
  round({_PHASE} - ("both" + only_a) * 1.0 / callable * (("both" + only_b) * 1.0 / callable), 6) AS delta FROM n"""
)
def phase_links(spark, d):
    rows = evidence.phase_links(C.obs(spark, d))
    exact = ["event_a", "event_b", "both", "only_a", "only_b", "neither", "uncertain", "callable"]
    return rows.select(*exact, *(F.round(c, 6).alias(c) for c in ("fraction", "ci_low", "ci_high", "expected", "delta")))


@_query(f"WITH {C.GENES_SQL}, {C.PIECES_SQL} SELECT gene, count(*) AS fragments, CAST(sum(least(\"end\", gene_end) - greatest(start, gene_start) + 1) AS BIGINT) AS positions FROM pieces JOIN genes ON start <= gene_end AND \"end\" >= gene_start GROUP BY gene")
def gene_overlap(spark, d):
    pieces = intervals.split_at_origin(C.ranged(spark, d).select("molecule", "frag", "start", "end"))
    joined = intervals.overlapping(pieces, F.broadcast(genome.genes(spark)), "start", "end", "gene_start", "gene_end")  # 37 rows
    shared = F.least("end", "gene_end") - F.greatest("start", "gene_start") + 1
    return joined.groupBy("gene").agg(F.count("*").alias("fragments"), F.sum(shared).alias("positions"))


@_query(
    f"""WITH {C.GENES_SQL}, {C.PIECES_SQL}, shared AS (
  SELECT molecule, frag, gene, biotype, gene_end - gene_start + 1 AS whole, sum(least("end", gene_end) - greatest(start, gene_start) + 1) AS shared
  FROM pieces JOIN genes ON start <= gene_end AND "end" >= gene_start GROUP BY ALL)
SELECT molecule, frag, count(*) FILTER (shared = whole) AS lost, count(*) FILTER (shared < whole) AS partial, count(*) FILTER (shared = whole AND biotype = 'tRNA') AS trna_lost
FROM shared GROUP BY molecule, frag"""
)
def gene_lost_partial(spark, d):
    pieces = intervals.split_at_origin(C.ranged(spark, d).select("molecule", "frag", "start", "end"))
    joined = intervals.overlapping(pieces, F.broadcast(genome.genes(spark)), "start", "end", "gene_start", "gene_end")
    shared = joined.groupBy("molecule", "frag", "gene", "biotype", (F.col("gene_end") - F.col("gene_start") + 1).alias("whole")).agg(
        F.sum(F.least("end", "gene_end") - F.greatest("start", "gene_start") + 1).alias("shared")
    )
    lost = F.col("shared") == F.col("whole")
    return shared.groupBy("molecule", "frag").agg(F.count_if(lost).alias("lost"), F.count_if(F.col("shared") < F.col("whole")).alias("partial"), F.count_if(lost & (F.col("biotype") == "tRNA")).alias("trna_lost"))


@_query(
    f"""WITH {C.PIECES_SQL}, points AS (SELECT p * 500 + 26 AS point FROM (SELECT unnest(range(0, 33)) AS p)),
carriers AS (SELECT molecule, point FROM (SELECT DISTINCT molecule FROM aln) m JOIN points p ON (molecule + point) % 10 = 0)
SELECT point, count(DISTINCT x.molecule) AS n FROM points LEFT JOIN (
  SELECT p.point AS at, i.molecule FROM pieces i JOIN points p ON i.start <= p.point - 25 AND i."end" >= p.point + 25 ANTI JOIN carriers c ON c.molecule = i.molecule AND c.point = p.point) x ON x.at = point
GROUP BY point"""
)
def spanning_count(spark, d):
    pieces = intervals.split_at_origin(C.ranged(spark, d).select("molecule", "start", "end"))
    points = spark.range(33).select((F.col("id") * 500 + 26).alias("point"))
    molecules = C.aln(spark, d).select("molecule").distinct().withColumn("point", F.explode(F.array(*(F.lit(p * 500 + 26).cast("long") for p in range(33)))))
    return evidence.spanning(pieces, points, molecules.where((F.col("molecule") + F.col("point")) % 10 == 0))


_TOKENS_SQL = "tokens AS (SELECT DISTINCT doc_id AS k, unnest(string_split(text, chr(10))) AS t FROM documents), sets AS (SELECT k, list_sort(list(t)) AS s FROM tokens GROUP BY k), profiles AS (SELECT min(k) AS p, s, count(*) AS members FROM sets GROUP BY s)"


def _pairs_sql(epsilon: float) -> str:
    distance = "1.0 - len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s)))"
    return f"pairs AS (SELECT a.p AS a, b.p AS b, {distance} AS distance FROM profiles a JOIN profiles b ON a.p < b.p WHERE list_has_any(a.s, b.s) AND {distance} <= {epsilon} + 1e-12)"


def _line_sets(spark, d) -> DataFrame:
    """Documents as sets of lines, each by its SHA-256: what is shuffled is as long for any line."""
    lines = C.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("t"))
    return similarity.profiles(lines.select("doc_id", F.unhex(F.sha2("t", 256)).alias("t")), "doc_id", "t")


@_query(f"WITH {_TOKENS_SQL}, {_pairs_sql(0.5)} SELECT a, b, round(distance, 6) AS distance FROM pairs")
def jaccard_pairs(spark, d):
    return similarity.similar_pairs(_line_sets(spark, d), 0.5).withColumn("distance", F.round("distance", 6))


@_query(
    f"""WITH RECURSIVE {_TOKENS_SQL}, {_pairs_sql(0.72)}, edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(n, r) AS (SELECT p, p FROM profiles UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.n WHERE reach.r < e.b),
labels AS (SELECT n, min(r) AS root FROM reach GROUP BY n)
SELECT n AS profile, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM labels"""
)
def dbscan_labels(spark, d):
    return similarity.density_clusters(_line_sets(spark, d), Config().cluster_epsilon, Config().min_cluster_size)


_ASSERT_SQL = """assertions AS (SELECT event_id % 997 AS variant, event_type || ' ' || CASE event_id % 7 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely-Pathogenic' WHEN 2 THEN 'benign' WHEN 3 THEN 'Uncertain significance'
  WHEN 4 THEN 'conflicting' WHEN 5 THEN 'Benign/Likely benign' ELSE 'association' END AS raw FROM events),
tokens AS (SELECT *, lower(regexp_replace(trim(raw), '[ _-]+', '_', 'g')) AS v FROM assertions),
normal AS (SELECT *, CASE WHEN contains(v, 'conflict') OR (contains(v, 'pathogenic') AND contains(v, 'benign')) THEN 'conflicting' WHEN contains(v, 'likely_pathogenic') THEN 'likely_pathogenic'
  WHEN contains(v, 'pathogenic') THEN 'pathogenic' WHEN contains(v, 'benign/likely_benign') THEN 'benign_or_likely_benign' WHEN contains(v, 'likely_benign') THEN 'likely_benign' WHEN contains(v, 'benign') THEN 'benign'
  WHEN contains(v, 'uncertain') THEN 'uncertain_significance' WHEN contains(v, 'association') THEN 'association' ELSE 'other' END AS significance FROM tokens),
grouped AS (SELECT *, CASE WHEN significance IN ('pathogenic', 'likely_pathogenic') THEN 'pathogenic' WHEN significance IN ('benign', 'likely_benign', 'benign_or_likely_benign') THEN 'benign'
  WHEN significance = 'uncertain_significance' THEN 'uncertain' WHEN significance = 'conflicting' THEN 'conflicting' WHEN significance = 'other' THEN 'unclassified' ELSE 'other_assertion' END AS "group" FROM normal)"""


def _assertions(spark, d) -> DataFrame:
    words = ("Pathogenic", "Likely-Pathogenic", "benign", "Uncertain significance", "conflicting", "Benign/Likely benign", "association")
    word = F.element_at(F.array(*map(F.lit, words)), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    rows = C.table(spark, d, "events").select(F.pmod("event_id", F.lit(997)).alias("variant"), F.concat_ws(" ", "event_type", word).alias("raw"))
    named = rows.withColumn("significance", text.significance(F.col("raw")))
    return named.withColumn("group", text.significance_group(F.col("significance")))


@_query(f'WITH {_ASSERT_SQL} SELECT significance, "group", count(*) AS n FROM grouped GROUP BY ALL')
def clinical_vocabulary(spark, d):
    return _assertions(spark, d).groupBy("significance", "group").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {_ASSERT_SQL}, sets AS (SELECT variant, count(*) AS assertions, list_sort(list_distinct(list(significance))) AS s, list_sort(list_distinct(list("group"))) AS g FROM grouped GROUP BY variant)
SELECT variant, assertions, CASE WHEN list_contains(g, 'conflicting') OR len(list_filter(g, lambda x: x <> 'conflicting')) > 1 THEN 'conflicting' WHEN assertions = 1 THEN 'single_assertion' ELSE 'consistent' END AS conflict_status,
  CASE WHEN len(s) = 1 THEN s[1] WHEN g = ['pathogenic'] THEN 'pathogenic_or_likely_pathogenic' WHEN g = ['benign'] THEN 'benign_or_likely_benign' ELSE s[1] END AS significance FROM sets"""
)
def clinical_consensus(spark, d):
    return evidence.clinical_consensus(_assertions(spark, d), ["variant"])


_P = "abs(c_acctbal) / 10000.0"


@_query(
    f"""WITH p AS (SELECT c_custkey, {_P} AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS rank, count(*) OVER () AS m FROM p)
SELECT c_custkey, rank, round(min(least(1.0, p * m / rank)) OVER (ORDER BY rank DESC), 6) AS q FROM r"""
)
def bh_fdr(spark, d):
    rows = C.table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000.0).alias("p"))
    return ordered.benjamini_hochberg(rows, "p", ["c_custkey"]).select("c_custkey", "rank", F.round("q", 6).alias("q"))


@_query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, greatest(l_discount * l_tax, 1e-300) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(1.0, p * (1 - ln(p))), 6) AS p FROM x"""
)
def fisher_combined(spark, d):
    rows = C.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(stats.fisher_combined(F.col("l_discount"), F.col("l_tax")), 6).alias("p"))


@_query(
    """WITH c AS (SELECT list_sort(list(c_acctbal))[count(*) // 2 + 1] AS center FROM customer), s AS (SELECT list_sort(list(abs(c_acctbal - center)))[count(*) // 2 + 1] AS spread FROM customer, c)
SELECT c_custkey, c_acctbal > center + greatest(8.8956 * 0.1 * spread, 0.02) AS outlier FROM customer, c, s"""
)
def mad_outliers(spark, d):
    return ordered.outliers(C.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", scale=8.8956 * 0.1).select("c_custkey", "outlier")


@_query(
    """WITH x AS (SELECT s_suppkey, CAST(s_suppkey % 7 AS INTEGER) AS k, 12 AS n, 0.1 AS mean, 0.05 AS rho FROM supplier), ab AS (SELECT *, mean * (1 - rho) / rho AS a, (1 - mean) * (1 - rho) / rho AS b FROM x)
SELECT s_suppkey, round(sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + lgamma(i + a) + lgamma(n - i + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b))), 6) AS p
FROM ab, (SELECT unnest(range(0, 13)) AS i) WHERE i >= k GROUP BY s_suppkey"""
)
def beta_binomial_tail(spark, d):
    k = F.pmod("s_suppkey", F.lit(7)).cast("int")
    return C.table(spark, d, "supplier").select("s_suppkey", F.round(stats.beta_binomial_survival(k, F.lit(12), F.lit(0.1), F.lit(0.05)), 6).alias("p"))


@_query(
    """SELECT l_returnflag, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 6) AS slope
FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, l_linenumber AS w FROM lineitem) GROUP BY 1"""
)
def weighted_regression(spark, d):
    x, y, w = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_linenumber")
    return C.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(ordered.weighted_slope(x, y, w), 6).alias("slope"))


@_query("SELECT (event_id // 4096) AS page, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total FROM events GROUP BY 1")
def evidence_page(spark, d):
    paged = exports.pages(C.table(spark, d, "events").select("event_id", "value"), "event_id")
    ids, values = F.col("columns.event_id"), F.col("columns.value")
    total = F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4)
    return paged.select("page", "n", F.col("first").alias("first_id"), F.array_max(ids).alias("last_id"), total.alias("total"))


@_query("SELECT event_id, user_id, event_type, n, total, CASE WHEN total > 110 THEN CAST(110 AS BIGINT) END AS next_cursor FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS total FROM events WHERE event_type = 'click') WHERE n BETWEEN 11 AND 110")
def evidence_search(spark, d):
    found = C.table(spark, d, "events").where("event_type = 'click'")
    return ordered.page(found, "event_id", 10, 100).select("event_id", "user_id", "event_type", "n", "total", "next_cursor")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_totalprice, o_orderkey LIMIT 200)")
def top_filtered_union(spark, d):
    rows = C.table(spark, d, "orders")
    return ordered.best_of_the_rest(rows, F.col("o_orderstatus") == "F", ["o_totalprice", "o_orderkey"], 200).select("o_orderkey", "o_orderstatus")


@_query("SELECT o_custkey, o_orderkey, n, total * 1.0 / ((total + 2) // 3) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE (n - 1) % 3 = 0")
def systematic_sample(spark, d):
    return ordered.systematic_sample(C.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@_query("SELECT 'part' AS kind, p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier")
def event_rows_union(spark, d):
    parts = C.table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return parts.unionByName(C.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@_query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey) AS n FROM customer")
def sort_nulls_last(spark, d):
    value = F.when(F.pmod("c_custkey", F.lit(5)) != 0, F.col("c_acctbal"))
    rows = C.table(spark, d, "customer").select("c_custkey", value.alias("v"))
    return ordered.numbered(rows, F.desc_nulls_last("v"), "c_custkey", name="n").select("c_custkey", "n")


@_query("SELECT p_partkey, reverse(translate(upper(replace(p_name, ' ', '')), 'ACGT', 'TGCA')) AS rc FROM part")
def reverse_complement(spark, d):
    return C.table(spark, d, "part").select("p_partkey", text.reverse_complement(F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).alias("rc"))


@_query("SELECT c_custkey, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1) * 1.0 / count(*) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer")
def percentile_rank(spark, d):
    return ordered.share_below(C.table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", F.round("share", 6).alias("share"))


@_query(f"""WITH {C.ALN_SQL} SELECT start // 300 AS event, count(DISTINCT molecule) AS support, bool_or(status = 'F') AS known, max(len) AS longest, string_agg(DISTINCT strand, ',' ORDER BY strand) AS strands FROM aln GROUP BY 1""")
def merge_events(spark, d):
    rows = C.aln(spark, d).select(F.expr("start div 300").alias("event"), "molecule", (F.col("status") == "F").alias("known"), F.col("len").alias("length"), "strand")
    return paths.merged_supports(rows, "event", "molecule")


@_query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def text_digests(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@_query(
    """WITH x AS (SELECT o_orderpriority AS band, l_returnflag = 'R' AS called, l_linestatus = 'F' AS truth FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
c AS (SELECT band, count(*) FILTER (called AND truth) AS tp, count(*) FILTER (called AND NOT truth) AS fp, count(*) FILTER (NOT called AND truth) AS fn FROM x GROUP BY band)
SELECT band, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c"""
)
def prf_by_band(spark, d):
    lines = C.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("called"), (F.col("l_linestatus") == "F").alias("truth"))
    orders = C.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("band"))
    counts = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("band").agg(
        F.count_if(F.expr("called and truth")).alias("tp"), F.count_if(F.expr("called and not truth")).alias("fp"), F.count_if(F.expr("not called and truth")).alias("fn")
    )
    p, r, f1 = evidence.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("band", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@_query(
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_first' WHEN a.k IS NULL THEN 'only_second' ELSE 'both' END AS side
FROM (SELECT DISTINCT l_partkey || ':' || l_returnflag AS k FROM lineitem WHERE l_linestatus = 'F') a FULL JOIN (SELECT DISTINCT l_partkey || ':' || l_returnflag AS k FROM lineitem WHERE l_linestatus = 'O') b ON a.k = b.k"""
)
def callset_differential(spark, d):
    key = F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag").alias("k")
    side = lambda n: C.table(spark, d, "lineitem").where(F.col("l_linestatus") == n).select(key, F.lit(1.0).alias("level")).distinct()
    return comparison.differential(side("F"), side("O"), ["k"], "level").select("k", "side")


@_query(
    f"""WITH {C.OBS_SQL}, callable AS (SELECT molecule, list_sort(list(event)) AS s FROM obs WHERE state = 'ALTERNATE' GROUP BY molecule)
SELECT array_to_string(s, '|') AS signature, count(*) AS members FROM callable GROUP BY s HAVING count(*) >= 2"""
)
def seed_signatures(spark, d):
    observed = C.obs(spark, d)
    signed = architectures.signatures(observed.where("state = 'ALTERNATE'").select("molecule").distinct(), observed)
    return architectures.supported(signed, Config()).select(F.array_join("signature", "|").alias("signature"), F.col("n").alias("members"))


@_query(
    f"""WITH {C.OBS_SQL} SELECT molecule % 20 AS cluster, event, count(*) FILTER (state = 'ALTERNATE') AS carriers, count(*) FILTER (state <> 'LOW_QUALITY') AS callable,
  count(*) FILTER (state = 'ALTERNATE') * 2 > count(*) FILTER (state <> 'LOW_QUALITY') AS majority FROM obs GROUP BY 1, 2"""
)
def majority_markers(spark, d):
    alt, sure = F.count_if(F.col("state") == "ALTERNATE"), F.count_if(F.col("state") != "LOW_QUALITY")
    rows = C.obs(spark, d).groupBy(F.pmod("molecule", F.lit(20)).alias("cluster"), "event")
    return rows.agg(alt.alias("carriers"), sure.alias("callable"), (alt * 2 > sure).alias("majority"))


@_query(
    """WITH o AS (SELECT DISTINCT l_orderkey AS cluster, l_partkey % 400 AS marker FROM lineitem),
e AS (SELECT DISTINCT s_suppkey AS definition, (s_suppkey * 7 + i * i) % 400 AS marker FROM supplier, (SELECT unnest(range(0, 12)) AS i)),
eo AS (SELECT cluster, count(*) AS observed FROM o GROUP BY 1), ee AS (SELECT definition, count(*) AS expected FROM e GROUP BY 1),
m AS (SELECT cluster, definition, count(*) AS matched FROM o JOIN e USING (marker) GROUP BY 1, 2)
SELECT cluster, definition, matched, expected - matched AS missing, observed - matched AS extra, round(50.0 * matched / expected + 50.0 * matched / observed, 6) AS score, n AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(50.0 * matched / expected + 50.0 * matched / observed, 6) DESC, definition) AS n FROM m JOIN eo USING (cluster) JOIN ee USING (definition)) WHERE n <= 3"""
)
def candidate_score_top3(spark, d):
    seen = C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.pmod("l_partkey", F.lit(400)).alias("marker")).distinct()
    steps = F.explode(F.sequence(F.lit(0), F.lit(11)))
    defined = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("definition"), steps.alias("i"))
    defined = defined.select("definition", F.pmod(F.col("definition") * 7 + F.col("i") * F.col("i"), F.lit(400)).alias("marker")).distinct()
    from annulus.operators.lineage import ranked_candidates

    return ranked_candidates(seen, defined, 3).withColumn("rank", F.col("rank").cast("long"))


@_query(
    """WITH dim AS (SELECT p_partkey AS position, min(p_type) AS assertion, count(*) AS assertions FROM part WHERE p_size > 20 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey AS position, assertion, coalesce(assertions, 0) AS assertions FROM lineitem LEFT JOIN dim ON l_partkey = position"""
)
def clinical_left_join(spark, d):
    dim = C.table(spark, d, "part").where("p_size > 20").groupBy(F.col("p_partkey").alias("position")).agg(F.min("p_type").alias("assertion"), F.count("*").alias("assertions"))
    rows = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("position"))
    return annotation.with_assertions(rows, dim, ["position"]).select("l_orderkey", "l_linenumber", "position", "assertion", "assertions")


@_query(
    """WITH model AS (SELECT p_brand AS gene, p_partkey % 300 AS first, p_partkey % 300 + p_size AS last FROM part),
differs AS (SELECT DISTINCT p_brand AS gene, p_partkey % 350 AS residue FROM part WHERE p_size = 7),
asked AS (SELECT DISTINCT p_brand AS gene, l_suppkey * 13 % 350 AS residue FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.gene, a.residue, count(*) AS models FROM asked a JOIN model m ON a.gene = m.gene AND a.residue BETWEEN m.first AND m.last ANTI JOIN differs x ON x.gene = a.gene AND x.residue = a.residue GROUP BY 1, 2"""
)
def structure_map(spark, d):
    part, n = C.table(spark, d, "part"), F.col("p_partkey")
    gene = F.col("p_brand").alias("gene")
    model = part.select(gene, F.pmod(n, F.lit(300)).alias("first"), (F.pmod(n, F.lit(300)) + F.col("p_size")).alias("last"))
    differs = part.where("p_size = 7").select(gene, F.pmod(n, F.lit(350)).alias("residue")).distinct()
    lines = C.table(spark, d, "lineitem").select("l_partkey", F.pmod(F.col("l_suppkey") * 13, F.lit(350)).alias("residue"))
    asked = lines.join(part, lines.l_partkey == part.p_partkey).select(gene, "residue").distinct()
    return annotation.modelled(asked, model, differs)


@_query(
    """WITH RECURSIVE j AS (SELECT o_orderkey AS id, o_orderkey * 7919 % 1000003 AS place, o_custkey * 104729 % 50021 AS len FROM orders),
e AS (SELECT a.id AS a, b.id AS b FROM j a JOIN j b ON a.id <> b.id AND abs(a.place - b.place) <= 30 AND abs(a.len - b.len) <= 800),
reach(n, r) AS (SELECT id, id FROM j UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n WHERE reach.r < e.b)
SELECT n AS id, min(r) AS component FROM reach GROUP BY n"""
)
def junction_clusters(spark, d):
    orders = C.table(spark, d, "orders")
    place = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000003))
    junctions = orders.select(F.col("o_orderkey").alias("id"), place.alias("place"), F.pmod(F.col("o_custkey") * 104729, F.lit(50021)).alias("len"))
    return evidence.band_components(junctions, "id", {"place": 30, "len": 800})


_PROFILE_SQL = f"""WITH {C.OBS_SQL}, profile AS (SELECT molecule % 8 AS architecture, event, count(*) FILTER (state = 'ALTERNATE') AS alternate, count(*) FILTER (state = 'REFERENCE') AS absent,
  count(*) FILTER (state = 'LOW_QUALITY') AS uncertain FROM obs GROUP BY 1, 2)"""


def _profile(spark, d) -> DataFrame:
    return evidence.event_profile(C.obs(spark, d).withColumn("architecture", F.pmod("molecule", F.lit(8))), "architecture", Config())


@_query(
    _PROFILE_SQL
    + """ SELECT architecture, event, alternate, absent, uncertain, CASE WHEN alternate + absent >= 2 THEN round(alternate * 1.0 / (alternate + absent), 6) END AS fraction,
  alternate + absent >= 2 AND alternate * 1.0 / (alternate + absent) >= 0.8 AS expected_alternate, alternate + absent >= 2 AND alternate * 1.0 / (alternate + absent) <= 0.2 AS expected_absent FROM profile"""
)
def event_profile(spark, d):
    return _profile(spark, d).withColumn("fraction", F.round("fraction", 6))


@_query(
    f"""WITH {C.PIECES_SQL}, changes AS (SELECT c, p, CAST(sum(d) AS BIGINT) AS d FROM (
  SELECT molecule % 5 AS c, start AS p, 1 AS d FROM pieces UNION ALL SELECT molecule % 5, "end" + 1, -1 FROM pieces) GROUP BY 1, 2)
SELECT c AS cluster, p AS position, CAST(sum(d) OVER (PARTITION BY c ORDER BY p) AS BIGINT) AS active FROM changes"""
)
def callable_counts(spark, d):
    pieces = intervals.split_at_origin(C.ranged(spark, d).select("molecule", "start", "end"))
    return intervals.active_counts(pieces.withColumn("cluster", F.pmod("molecule", F.lit(5))), ["cluster"])


@_query(
    """WITH b AS (SELECT p_partkey AS position, substr('ACGT', CAST((p_size + p_partkey % 3) % 4 AS INTEGER) + 1, 1) AS ref FROM part),
r AS (SELECT *, position - row_number() OVER (PARTITION BY ref ORDER BY position) AS run FROM b)
SELECT ref, min(position) AS start, max(position) AS "end" FROM r GROUP BY ref, run HAVING count(*) >= 2"""
)
def homopolymer_runs(spark, d):
    base = F.substring(F.lit("ACGT"), (F.pmod(F.col("p_size") + F.pmod("p_partkey", F.lit(3)), F.lit(4)) + 1).cast("int"), F.lit(1))
    bases = C.table(spark, d, "part").select(F.col("p_partkey").alias("position"), base.alias("ref"))
    return ordered.islands(bases, ["ref"], "position").where("end > start")


@_query(
    f"""WITH {C.OBS_SQL}, items AS (SELECT DISTINCT CASE WHEN molecule % 2 = 0 THEN 'even' ELSE 'odd' END AS side, event || ':' || quality AS item, CASE WHEN quality > 40 THEN 3.0 WHEN quality > 20 THEN 2.0 ELSE 1.0 END AS weight FROM obs)
SELECT round(sum(CASE WHEN n = 2 THEN weight ELSE 0 END) / sum(weight), 6) AS similarity FROM (SELECT item, max(weight) AS weight, count(*) AS n FROM items GROUP BY item)"""
)
def weighted_jaccard(spark, d):
    rows = C.obs(spark, d)
    weight = F.when(F.col("quality") > 40, 3.0).when(F.col("quality") > 20, 2.0).otherwise(1.0)
    side = F.when(F.pmod("molecule", F.lit(2)) == 0, "even").otherwise("odd")
    items = rows.select(side.alias("side"), F.concat_ws(":", "event", F.col("quality").cast("string")).alias("item"), weight.alias("weight")).distinct()
    return similarity.weighted_jaccard(items, "even", "odd", "side", "item", "weight").select(F.round("similarity", 6).alias("similarity"))


@_query(
    f"""WITH {C.CELLS_SQL}, refs AS (SELECT p AS position, substr('ACGT', CAST(p % 4 AS INTEGER) + 1, 1) AS ref FROM (SELECT unnest(range(1, 61)) AS p)),
top AS (SELECT position, base FROM cells JOIN refs USING (position) QUALIFY row_number() OVER (PARTITION BY position ORDER BY forward + reverse DESC, base = ref DESC, base) = 1)
SELECT position, ref, coalesce(base, ref) AS major FROM refs LEFT JOIN top USING (position)"""
)
def pileup_consensus(spark, d):
    return calls.consensus(calls.pileup(C.read_bases(spark, d)), _genome(spark))


def _genome(spark) -> DataFrame:
    """position, ref of a genome as long as the bases' positions."""
    return _reference(spark.range(1, 61).select(F.col("id").alias("position")))


@_query(f"WITH {C.CELLS_SQL} SELECT position, base, forward, reverse FROM cells")
def pileup_cells(spark, d):
    return calls.pileup(C.read_bases(spark, d)).select("position", "base", "forward", "reverse")


@_query()
def substitution_calls(spark, d):
    cells = calls.pileup(C.read_bases(spark, d))
    found = calls.substitutions(cells, calls.consensus(cells, _genome(spark)))
    return found.select("position", "ref", "alt", "depth", "alternate_depth", *(F.round(c, 6).alias(c) for c in ("fraction", "ci_low", "ci_high", "p", "q")), F.array_join("filters", ",").alias("filters"), "pass")


@_query(
    f"""WITH {C.PIECES_SQL}, {C.SITES_SQL}, asked AS (SELECT *, CASE WHEN insertion THEN start WHEN start = 1 THEN 16569 ELSE start - 1 END AS l, CASE WHEN "end" = 16569 THEN 1 ELSE "end" + 1 END AS r FROM sites WHERE "end" <= 16569),
whole AS (SELECT DISTINCT event, molecule, frag FROM asked a JOIN pieces p ON p.start <= a.start AND p."end" >= a."end"),
lefts AS (SELECT DISTINCT event, molecule, frag FROM asked a JOIN pieces p ON a.l BETWEEN p.start AND p."end"),
rights AS (SELECT DISTINCT event, molecule, frag FROM asked a JOIN pieces p ON a.r BETWEEN p.start AND p."end"),
kept AS (SELECT w.* FROM whole w JOIN lefts USING (event, molecule, frag) JOIN rights USING (event, molecule, frag))
SELECT DISTINCT k.event, k.molecule FROM kept k JOIN asked a ON a.event = k.event
WHERE NOT (a.insertion AND EXISTS (SELECT 1 FROM broken b WHERE b.molecule = k.molecule AND b.alignment = k.frag AND b.anchor = a.start))"""
)
def reference_paths(spark, d):
    pieces = intervals.split_at_origin(C.ranged(spark, d).select("molecule", F.col("frag").alias("alignment"), "start", "end"))
    return events.reference_paths(C.sites(spark, d), pieces, C.broken(spark, d))


_ARCHITECTURE_SQL = """WITH obs AS (
  SELECT molecule, event, state FROM (
    SELECT l_orderkey AS molecule, p_type AS event, CASE l_returnflag WHEN 'R' THEN 'ALTERNATE' WHEN 'N' THEN 'REFERENCE' ELSE 'LOW_QUALITY' END AS state,
           row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY l_linenumber, l_returnflag, l_quantity, l_linestatus) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n = 1),
weights AS (SELECT DISTINCT event, CASE WHEN event < 'M' THEN 2.0 ELSE 1.0 END AS weight FROM obs),
signed AS (SELECT molecule, coalesce(string_agg(event, '|' ORDER BY event) FILTER (state = 'ALTERNATE'), '') AS signature FROM obs GROUP BY 1),
seeds AS (SELECT signature FROM signed GROUP BY 1 HAVING count(*) >= 2),
counts AS (SELECT signature, event, count(*) FILTER (state = 'ALTERNATE') AS a, count(*) FILTER (state = 'REFERENCE') AS r FROM seeds JOIN signed USING (signature) JOIN obs USING (molecule) GROUP BY 1, 2),
profile AS (SELECT signature, event, a * 1.0 / (a + r) AS f, weight FROM counts JOIN weights USING (event) WHERE a + r >= 2),
firm AS (SELECT * FROM profile WHERE f >= 0.8 OR f <= 0.2), totals AS (SELECT signature, sum(weight) AS total FROM firm GROUP BY 1),
met AS (SELECT molecule, p.signature, sum(weight) AS joint, sum(weight * CASE WHEN state = 'ALTERNATE' THEN 1 - f ELSE f END) AS differs FROM obs JOIN firm p USING (event) WHERE state <> 'LOW_QUALITY' GROUP BY 1, 2),
shown AS (SELECT molecule, sum(weight) AS shown FROM obs JOIN weights USING (event) WHERE state = 'ALTERNATE' GROUP BY 1),
known AS (SELECT molecule, p.signature, sum(weight) AS known FROM obs JOIN profile p USING (event) WHERE state = 'ALTERNATE' GROUP BY 1, 2),
bare AS (SELECT signature FROM seeds WHERE signature NOT IN (SELECT signature FROM profile)),
grid AS (SELECT s.molecule, c.signature, total, coalesce(joint, 0) AS joint, coalesce(differs, 0) AS differs, coalesce(shown, 0) - coalesce(known, 0) AS extra, b.signature IS NOT NULL AS bare, s.signature AS own
  FROM signed s CROSS JOIN seeds c LEFT JOIN totals t ON t.signature = c.signature LEFT JOIN met m ON m.molecule = s.molecule AND m.signature = c.signature
  LEFT JOIN shown h ON h.molecule = s.molecule LEFT JOIN known k ON k.molecule = s.molecule AND k.signature = c.signature LEFT JOIN bare b ON b.signature = c.signature)"""


def _architecture_input(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    observed = written(C.obs(spark, d, "p_type").select("molecule", "event", "state"), "observed")
    weights = observed.select("event").distinct().withColumn("weight", F.when(F.col("event") < "M", 2.0).otherwise(1.0))
    return observed.select("molecule").distinct(), observed, weights


@_query(
    _ARCHITECTURE_SQL
    + """, scored AS (SELECT molecule, signature, CASE WHEN bare AND signature = '' AND own = '' THEN 0.0 WHEN joint + extra > 0 AND total > 0 THEN (differs + extra) / (joint + extra) END AS distance,
  CASE WHEN bare THEN 1.0 ELSE least(1.0, joint / total) END AS overlap FROM grid)
SELECT molecule, signature, round(distance, 6) AS distance, round(overlap, 6) AS overlap, round(distance + 0.25 * (1 - overlap), 6) AS score FROM scored WHERE distance IS NOT NULL"""
)
def architecture_scores(spark, d):
    molecules, observed, weights = _architecture_input(spark, d)
    signed = written(architectures.signatures(molecules, observed), "signed")
    members = architectures.seeds(signed, Config())
    named = members.select("architecture", "signature").distinct()
    rows = architectures.pattern_scores(signed, observed, named, architectures.member_profiles(members, observed, Config()), weights)
    named = named.select("architecture", F.array_join("signature", "|").alias("signature"))
    return rows.join(F.broadcast(named), "architecture").select("molecule", "signature", *(F.round(c, 6).alias(c) for c in ("distance", "overlap", "score")))


@_query()
def architecture_assignments(spark, d):
    found = architectures.infer(*_architecture_input(spark, d), Config()).assignments
    return found.select("molecule", "status", "architecture", F.array_join("candidates", " ").alias("candidates"), *(F.round(c, 6).alias(c) for c in ("distance", "overlap", "score", "confidence")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locus levels with intervals, and the genes at their positions."""
    levels = evidence.locus_levels(evidence.best_observation(C.bases(spark, sf_dir).withColumn("position", F.col("position") * 270)))
    found = evidence.variants(levels, _reference(levels)).withColumn("last", F.col("position"))
    return intervals.overlapping(found, F.broadcast(genome.genes(spark)), "position", "last", "gene_start", "gene_end").drop("last")

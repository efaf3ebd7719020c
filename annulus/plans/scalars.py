"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from annulus.config import Config
from annulus.functions import coords, stats, text
from annulus.operators import alignments, architectures, calls, comparison, indel_calls, lineage, molecules, reports
from annulus.plans import carriers as C
from annulus.plans.registry import query as _query

_L = coords.L


@_query(
    """SELECT p_partkey, p_partkey || ':' || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'C' END || ':' || 'G' AS variant_key, regexp_replace(p_name || ' a=b;c', '[ \\t\\r\\n;=,]', '_', 'g') AS token, regexp_replace(p_name || '/x', '[^A-Za-z0-9._-]', '_', 'g') AS file,
  trim(translate(' ' || p_name || chr(9), chr(9), ' ')) AS clean, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS strict, p_size % 2 = 0 AS tag_valid, p_size % 25 BETWEEN 1 AND 22 AS nuclear, p_size % 3 = 0 AS mitochondrial,
  CASE WHEN p_size % 2 = 0 THEN 'L' || p_size % 10 ELSE 'H' END AS macro, 2 AS parts, p_size % 4 = 0 AS restores, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'x' || p_size END AS search, p_size % 2 = 0 AS allele FROM part"""
)
def text_functions(spark, d):
    n, size = F.col("p_size"), F.col("p_size").cast("string")
    even = F.pmod(n, F.lit(2)) == 0
    strict = F.when(F.pmod(n, F.lit(3)) == 0, size).otherwise(F.concat(size, F.lit("x")))
    contig = F.concat(F.lit("chr"), F.pmod(n, F.lit(25)).cast("string"))
    group = F.when(even, F.concat(F.lit("L"), F.pmod(n, F.lit(10)).cast("string"), F.lit("a"))).otherwise(F.lit("H2a"))
    return C.table(spark, d, "part").select(
        "p_partkey",
        text.variant_key(F.col("p_partkey"), F.when(even, "A").otherwise("C"), F.lit("G")).alias("variant_key"),
        text.vcf_token(F.concat("p_name", F.lit(" a=b;c"))).alias("token"),
        text.file_name(F.concat("p_name", F.lit("/x"))).alias("file"),
        text.clean_field(F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("clean"),
        text.strict_unsigned(strict).alias("strict"),
        text.sam_tag_name_is_valid(F.when(even, "X1").otherwise("1X")).alias("tag_valid"),
        text.nuclear_contig(contig).alias("nuclear"),
        text.mitochondrial_contig(F.when(F.pmod(n, F.lit(3)) == 0, "NC_012920.1").otherwise("chr1")).alias("mitochondrial"),
        text.macro_group(group).alias("macro"),
        F.size(text.semicolon_list(F.concat(F.lit(" a ;;"), size, F.lit("; ")))).alias("parts"),
        lineage.restores_reference(F.when(F.pmod(n, F.lit(4)) == 0, size).otherwise(F.concat(size, F.lit("G")))).alias("restores"),
        reports.search_filter(F.when(F.pmod(n, F.lit(5)) == 0, "  ").otherwise(F.concat(F.lit(" x"), size))).alias("search"),
        comparison.is_allele(F.when(even, "AC-N").otherwise("ACU")).alias("allele"),
    )


@_query(
    f"""WITH {C.ALN_SQL}, r AS (SELECT molecule, frag, start, (start + len - 2) % {_L} + 1 AS "end" FROM aln)
SELECT molecule, frag, start, CASE WHEN start <= "end" THEN "end" - start + 1 ELSE {_L} - start + 1 + "end" END AS length, (start + CASE WHEN start <= "end" THEN "end" - start ELSE {_L} - start + "end" END // 2 - 1) % {_L} + 1 AS midpoint,
  round((start - 1) * 360.0 / {_L}, 6) AS angle, CASE WHEN start = 1 THEN {_L} ELSE start - 1 END AS previous, CASE WHEN start = {_L} THEN 1 ELSE start + 1 END AS following, start - 1 AS zero_start, (start + 20000 - 1) % {_L} + 1 AS folded,
  greatest(0, least("end", 3000) - greatest(start, 1000) + 1) * CAST(start <= "end" AS INTEGER) + CAST(start > "end" AS INTEGER) * (greatest(0, 3000 - greatest(start, 1000) + 1) + greatest(0, least("end", 3000) - 1000 + 1)) AS shared FROM r"""
)
def circular_functions(spark, d):
    a, b = F.col("start"), F.col("end")
    return C.ranged(spark, d).select(
        "molecule",
        "frag",
        "start",
        coords.interval_length(a, b).alias("length"),
        coords.midpoint(a, b).alias("midpoint"),
        F.round(coords.angle(a), 6).alias("angle"),
        coords.previous_position(a).alias("previous"),
        coords.next_position(a).alias("following"),
        coords.zero_based_spans(a, b)[0]["start"].alias("zero_start"),
        coords.fold(a + 20000).alias("folded"),
        coords.overlap(a, b, F.lit(1000).cast("long"), F.lit(3000).cast("long")).alias("shared"),
    )




@_query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 + 10 AS n, l_partkey % 10 AS k, l_returnflag AS f FROM lineitem), e AS (SELECT *, n / (1 + (n - 1) * 0.02) AS m FROM x), p AS (SELECT *, k * 1.0 / n AS p FROM e)
SELECT l_orderkey, l_linenumber, round(greatest(0.0, (p + {stats.Z**2} / (2 * m) - {stats.Z} * sqrt(p * (1 - p) / m + {stats.Z**2} / (4 * m * m))) / (1 + {stats.Z**2} / m)), 6) AS low,
  round(least(1.0, (p + {stats.Z**2} / (2 * m) + {stats.Z} * sqrt(p * (1 - p) / m + {stats.Z**2} / (4 * m * m))) / (1 + {stats.Z**2} / m)), 6) AS high,
  CAST(CASE f WHEN 'R' THEN 3.0 WHEN 'N' THEN 2.0 ELSE 1.5 END AS DOUBLE) AS weight, n BETWEEN 10 AND 20 AS hard FROM p"""
)
def numeric_functions(spark, d):
    n, k = F.pmod("l_suppkey", F.lit(50)) + 10, F.pmod("l_partkey", F.lit(10))
    low, high = stats.overdispersed_wilson(k.cast("double"), n.cast("double"), 0.02)
    kind = F.when(F.col("l_returnflag") == "R", "COMPLEX_SV_PATH").when(F.col("l_returnflag") == "N", "SV_DELETION").otherwise("SMALL_DELETION")
    hard = comparison.in_hard_region(n, 1, ((10, 20),))
    return C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), architectures.event_weight(kind).alias("weight"), hard.alias("hard"))


@_query(
    """WITH s AS (SELECT p_partkey, upper(regexp_replace(translate(lower(p_name), 'bdefhijklmnopqrsuvwxyz ', 'acgtacgtacgtacgtacgtacg'), '[^acgt]', '', 'g')) AS s FROM part)
SELECT p_partkey, CASE WHEN length(s) > 0 THEN round(length(regexp_replace(s, '[^GC]', '', 'g')) * 1.0 / length(s), 6) ELSE 0.0 END AS gc, CASE WHEN length(s) > 0 THEN CAST(20 + p_partkey % 10 AS DOUBLE) END AS phred, regexp_matches(s, '^A+$') AS unit FROM s"""
)
def sequence_functions(spark, d):
    made = F.upper(F.regexp_replace(F.translate(F.lower("p_name"), "bdefhijklmnopqrsuvwxyz ", "acgtacgtacgtacgtacgtacg"), "[^acgt]", ""))
    quality = F.repeat(F.char(F.pmod("p_partkey", F.lit(10)) + 53), F.length(made))
    return C.table(spark, d, "part").select("p_partkey", F.round(text.gc_fraction(made), 6).alias("gc"), text.mean_phred(quality).alias("phred"), text.one_base(made, F.lit("A")).alias("unit"))


@_query(
    """WITH a AS (SELECT l_orderkey AS molecule, l_linenumber AS frag, l_partkey % 16000 + 1 AS start, l_suppkey % 30 + 5 AS m1, l_linenumber % 4 AS ins, l_suppkey % 6 AS del, CASE l_returnflag WHEN 'R' THEN 16 WHEN 'N' THEN 256 ELSE 2048 END AS flags FROM lineitem)
SELECT molecule, frag, start + m1 + del + 4 - 1 AS last, m1 + del + 4 AS span, m1 + ins + 4 + 3 AS bases, m1 + 4 AS aligned, CASE flags WHEN 256 THEN 'secondary' WHEN 2048 THEN 'supplementary' ELSE 'primary' END AS role,
  'MT,' || start || ',' || CASE flags WHEN 16 THEN '-' ELSE '+' END || ',' || m1 || 'M' || CASE WHEN ins > 0 THEN ins || 'I' ELSE '' END || CASE WHEN del > 0 THEN del || 'D' ELSE '' END || '4M3S,60,0;' AS sa FROM a"""
)
def alignment_functions(spark, d):
    m1, ins, gone = F.pmod("l_suppkey", F.lit(30)) + 5, F.pmod("l_linenumber", F.lit(4)), F.pmod("l_suppkey", F.lit(6))
    part = lambda n, code: F.when(n > 0, F.concat(n.cast("string"), F.lit(code))).otherwise("")
    cigar = F.concat(part(m1, "M"), part(ins, "I"), part(gone, "D"), F.lit("4M3S"))
    flags = F.when(F.col("l_returnflag") == "R", 16).when(F.col("l_returnflag") == "N", 256).otherwise(2048)
    start = F.pmod("l_partkey", F.lit(16000)) + 1
    rows = C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("molecule"), F.col("l_linenumber").alias("frag"), start.alias("start"), cigar.alias("cigar"), flags.alias("flags"))
    ops = text.cigar_operations(F.col("cigar"))
    return rows.select(
        "molecule",
        "frag",
        alignments.end_position(F.col("start"), ops).cast("long").alias("last"),
        text.reference_span(ops).cast("long").alias("span"),
        text.query_span(ops).cast("long").alias("bases"),
        text.aligned_bases(ops).cast("long").alias("aligned"),
        molecules.role(F.col("flags")).alias("role"),
        alignments.as_supplementary(F.lit("MT"), F.col("start"), F.col("flags"), F.col("cigar"), F.lit(60)).alias("sa"),
    )


@_query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'REFERENCE' WHEN 1 THEN 'ALTERNATE' WHEN 2 THEN 'EVENT_ABSENT' WHEN 3 THEN 'NOT_CALLABLE' WHEN 4 THEN 'LOW_QUALITY' ELSE 'CONFLICT' END AS state,
  CASE l_linenumber % 3 WHEN 0 THEN 'Too few molecules' WHEN 1 THEN 'Strands differ' ELSE 'own rule' END AS label,
  array_to_string(list_filter([CASE WHEN l_suppkey % 2 = 0 THEN 'NUMT_NOT_ASSESSABLE' END, CASE WHEN l_suppkey % 3 = 0 THEN 'SUPPORT_ONLY_EVENT' END, CASE WHEN l_suppkey % 5 = 0 THEN 'CONFLICTING_MOLECULE' END, CASE WHEN l_suppkey % 7 <> 0 THEN 'LOW_QUALITY_OBSERVATIONS' END,
    CASE WHEN l_partkey % 3 = 0 AND l_partkey % 4 <> 0 OR l_partkey % 3 <> 0 AND l_partkey % 4 = 0 THEN 'SINGLE_STRAND_ALT_SUPPORT' END, CASE WHEN l_partkey % 5 = 0 THEN 'MULTI_ALLELIC_LOCUS' END, CASE WHEN l_partkey % 6 > 1 THEN 'HOMOPOLYMER_CONTEXT' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN l_partkey % 30 >= 22 THEN 'densely packed' WHEN l_partkey % 30 >= 14 THEN 'intermediate' ELSE 'loosely packed' END AS packing, greatest(0, l_suppkey % 9 - l_partkey % 9) AS hidden FROM lineitem"""
)
def report_functions(spark, d):
    s, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    m = lambda c, k: F.pmod(c, F.lit(k))
    rule = F.when(m(n, 3) == 0, "low_support").when(m(n, 3) == 1, "strand_bias").otherwise("own_rule")
    flags = reports.qc_flags(m(s, 2) != 0, m(s, 3) != 0, (m(s, 5) == 0).cast("int"), m(s, 7), m(p, 3), m(p, 4), m(p, 5) == 0, m(p, 6))
    return C.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", reports.state_name(m(n, 6).cast("int")).alias("state"), reports.filter_label(rule).alias("label"),
        F.array_join(flags, ",").alias("flags"), reports.packing_class(m(p, 30)).alias("packing"), reports.hidden_count(m(s, 9), m(p, 9)).alias("hidden"),
    )


@_query(
    f"""WITH b AS (SELECT l_orderkey AS read, l_partkey % {_L} + 1 AS position, substr('ACGTN', CAST(l_suppkey % 5 AS INTEGER) + 1, 1) AS base, CAST(floor(l_quantity) AS BIGINT) AS quality FROM lineitem), r AS (SELECT *, substr('ACGT', CAST(position % 4 AS INTEGER) + 1, 1) AS ref FROM b)
SELECT read, position, ref, min(base) AS alt FROM r WHERE quality >= 10 AND base <> 'N' GROUP BY read, position, ref HAVING min(base) = max(base) AND min(base) <> ref"""
)
def aligned_mismatches(spark, d):
    position = F.pmod("l_partkey", F.lit(_L)) + 1
    base = F.substring(F.lit("ACGTN"), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("int"), F.lit(1))
    read = F.col("l_orderkey")
    rows = C.table(spark, d, "lineitem").select(read.alias("record_index"), read.alias("id"), position.alias("position"), base.alias("base"), F.floor("l_quantity").cast("long").alias("quality"))
    reference = spark.range(1, _L + 1).select(F.col("id").alias("position"), F.substring(F.lit("ACGT"), (F.pmod("id", F.lit(4)) + 1).cast("int"), F.lit(1)).alias("ref"))
    return alignments.mismatches(rows, reference, Config()).select(F.col("id").alias("read"), "position", "ref", "alt")


@_query(
    f"""WITH r AS (SELECT p AS position, substr('AAACCGTTTTTG', CAST((p * 7 // 5) % 12 AS INTEGER) + 1, 1) AS base FROM (SELECT unnest(range(1, 1001)) AS p)), x AS (SELECT *, position - row_number() OVER (PARTITION BY base ORDER BY position) AS g FROM r),
runs AS (SELECT base, g, count(*) AS n, min(position) AS a, max(position) AS b FROM x GROUP BY 1, 2), ends AS (SELECT sum(n) AS joint FROM runs WHERE (a = 1 OR b = 1000) AND (SELECT count(DISTINCT base) FROM runs WHERE a = 1 OR b = 1000) = 1)
SELECT position, CASE WHEN (a = 1 OR b = 1000) AND (SELECT joint FROM ends) IS NOT NULL THEN CAST((SELECT joint FROM ends) AS BIGINT) ELSE n END AS run FROM x JOIN runs USING (base, g)"""
)
def circular_runs(spark, d):
    """Runs of equal bases around the origin of a made reference."""
    made = "".join("AAACCGTTTTTG"[(p * 7 // 5) % 12] for p in range(1, 1001))
    return calls.run_lengths(spark, made).select("position", "run")


@_query(
    """WITH t AS (SELECT count(*) AS n FROM part) SELECT p_partkey, CASE WHEN p_size % 12 + 1 >= 12 THEN 12 ELSE p_size % 12 + 1 END AS bin FROM part, t"""
)
def repeat_bins(spark, d):
    """The class of a one-base deletion inside a run, over runs of 1 to 12 and more."""
    sequence, at = "", {}
    for n in range(1, 14):
        at[n] = len(sequence) + 2
        sequence += "G" + "A" * n + "C"
    context = indel_calls.Context.of(sequence)
    size = F.pmod("p_size", F.lit(12)) + 1
    left = F.element_at(F.array(*(F.lit(at[n]) for n in range(1, 13))), size.cast("int"))
    rows = C.table(spark, d, "part").select("p_partkey", F.lit(True).alias("deletion"), left.alias("left"), F.lit("A").alias("allele"))
    return indel_calls.classed(rows, context).select("p_partkey", F.col("repeat_bin").alias("bin"))



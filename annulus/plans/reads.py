"""Queries over made alignments: indels in the tree's notation, features of reads, counts before fits, calls, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.operators import deletions, evidence, features, haplotypes, indel_calls, intervals, molecules
from annulus.operators.calls import aligned_pieces, run_lengths, spanning_depths
from annulus.operators.shared import written
from annulus.plans import carriers as C
from annulus.plans.registry import query as _query

_SHIFT = "coalesce(list_filter(range(0, {most}), lambda i: {differs})[1], {most})"
_INSERT_SHIFT = _SHIFT.format(most=f"({C.GENOME_SIZE} - pos)", differs="substr(bases, CAST(i % unit AS INTEGER) + 1, 1) <> substr(g, CAST(pos + 1 + i AS INTEGER), 1)")
_DELETE_SHIFT = _SHIFT.format(most=f"({C.GENOME_SIZE} - pos - unit + 1)", differs="substr(g, CAST(pos + i AS INTEGER), 1) <> substr(g, CAST(pos + unit + i AS INTEGER), 1)")
# Markers of indels: each place is moved right base by base.
_MARKERS_SQL = f"""{C.READS_SQL}, inserts AS (SELECT pos, unit, bases, CAST({_INSERT_SHIFT} AS BIGINT) AS shift FROM (SELECT DISTINCT start + a - 1 AS pos, x AS unit, ins AS bases FROM made WHERE x > 0), genome),
deletes AS (SELECT pos, unit, CAST({_DELETE_SHIFT} AS BIGINT) AS shift FROM (SELECT DISTINCT start + a + 30 AS pos, y AS unit FROM made WHERE y BETWEEN 1 AND 50), genome),
indels AS (
  SELECT record_index, pos + shift AS position, 2 AS kind, '1' AS idx, (pos + shift) || '.1' || substr(bases || bases, CAST(shift % unit AS INTEGER) + 1, CAST(unit AS INTEGER)) AS encoded
  FROM made JOIN inserts ON pos = start + a - 1 AND unit = x AND bases = ins WHERE usable AND line <> 1
  UNION ALL SELECT record_index, pos + shift + i AS position, 1, NULL, (pos + shift + i) || 'd' FROM made JOIN deletes ON pos = start + a + 30 AND unit = y, range(0, 3) t(i) WHERE usable AND i < unit
)"""


@_query(f"WITH {_MARKERS_SQL} SELECT record_index, position, encoded FROM indels")
def tree_indels(spark, d) -> DataFrame:
    return features.tree_indels(C.made_reads(spark, d), C.GENOME, Config()).select("record_index", "position", "encoded")


@_query(
    f"""WITH {_MARKERS_SQL}, snps AS (SELECT record_index, start + 10 AS position, substr(g, CAST(start + 10 AS INTEGER), 1) AS ref FROM made, genome WHERE usable AND changed),
marks AS (SELECT * FROM indels UNION ALL SELECT record_index, position, 0, NULL, position || translate(ref, 'ACGT', 'CGTA') FROM snps),
listed AS (SELECT record_index, string_agg(encoded, ' ' ORDER BY position, kind, idx NULLS FIRST, encoded) AS markers FROM marks GROUP BY 1)
SELECT m.record_index, a + x + 140 AS length, coalesce(markers, '') AS markers, coalesce(s.position || ':' || ref || '>' || translate(ref, 'ACGT', 'CGTA'), '') AS snps, usable AS range_known,
       CASE WHEN NOT usable THEN '' WHEN large THEN start || '-' || (start + a + 29) || ' ' || (start + a + 90) || '-' || (start + a + 199) ELSE start || '-' || (start + a + y + 139) END AS ranges,
       CASE WHEN large THEN 'deletion:' || (start + a + 30) || '-' || (start + a + 89) ELSE '' END AS sv_ids, '' AS complex_event_ids
FROM made m LEFT JOIN listed l ON l.record_index = m.record_index LEFT JOIN snps s ON s.record_index = m.record_index"""
)
def read_features(spark, d) -> DataFrame:
    # a read takes much time for its size, so reads go to all tasks while they are narrow
    rows = C.made_rows(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_index")
    found = features.read_features(C.with_bases(rows), C.GENOME, Config())
    joined = lambda c, f: F.array_join(F.transform(c, f), " ").alias(c)
    return found.select(
        "record_index",
        "length",
        joined("markers", lambda m: m["encoded"]),
        joined("snps", lambda s: F.concat(s["position"].cast("string"), F.lit(":"), s["ref"], F.lit(">"), s["alt"])),
        "range_known",
        joined("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))),
        F.array_join("sv_ids", " ").alias("sv_ids"),
        F.array_join("complex_event_ids", " ").alias("complex_event_ids"),
    )


# Places on the circle, moved left and right one base at a time; the made events lie far from the origin.
_BACK = "coalesce(list_filter(range(0, 150), lambda i: {0})[1], 150)"
_PLACES_SQL = f"""moved AS (
  SELECT *, CASE WHEN deletion THEN {_BACK.format("substr(g, CAST(pos - 1 - i AS INTEGER), 1) <> substr(g, CAST(pos + unit - 1 - i AS INTEGER), 1)")}
            ELSE {_BACK.format("substr(g, CAST(pos - i AS INTEGER), 1) <> substr(bases, CAST(unit - i % unit AS INTEGER), 1)")} END AS back,
         CASE WHEN deletion THEN {_BACK.format("substr(g, CAST(pos + i AS INTEGER), 1) <> substr(g, CAST(pos + unit + i AS INTEGER), 1)")}
            ELSE {_BACK.format("substr(g, CAST(pos + 1 + i AS INTEGER), 1) <> substr(bases, CAST(i % unit AS INTEGER) + 1, 1)")} END AS ahead
  FROM events, genome
)"""


@_query(
    f"""WITH {C.READS_SQL}, shown AS (
  SELECT molecule, flags, false AS deletion, start + a - 1 AS pos, x AS unit, ins AS bases FROM made WHERE x > 0
  UNION ALL SELECT molecule, flags, true, start + a + 30, y, NULL FROM made WHERE y BETWEEN 1 AND 49
), events AS (SELECT DISTINCT deletion, pos, unit, bases FROM shown), {_PLACES_SQL},
named AS (SELECT deletion, pos, unit, bases, pos - back AS "left", pos + ahead AS "right",
    CASE WHEN deletion THEN substr(g, CAST(pos - back AS INTEGER), CAST(unit AS INTEGER)) ELSE substr(bases || bases, CAST((unit - back % unit) % unit AS INTEGER) + 1, CAST(unit AS INTEGER)) END AS allele FROM moved),
once AS (SELECT molecule, n.deletion, "left", "right", allele, min(flags) AS flags FROM shown s JOIN named n ON n.deletion = s.deletion AND n.pos = s.pos AND n.unit = s.unit AND n.bases IS NOT DISTINCT FROM s.bases GROUP BY ALL)
SELECT deletion, "left", "right", allele, count(*) FILTER (flags = 0) AS forward, count(*) FILTER (flags = 16) AS reverse FROM once GROUP BY ALL"""
)
def indel_counts(spark, d) -> DataFrame:
    return indel_calls.counted(C.made_reads(spark, d), C.GENOME)


@_query()
def indel_calls_of_reads(spark, d) -> DataFrame:
    """The counts above as calls: error fits, tests and filters."""
    reads = written(C.made_reads(spark, d), "made")
    spans = spanning_depths(aligned_pieces(reads, C.GENOME_SIZE, guard=8), C.GENOME_SIZE)
    found = indel_calls.call_indels(indel_calls.counted(reads, C.GENOME), written(spans, "spans"), C.GENOME, C.GENOME)
    return found.select("id", "depth", "raw_alternate", "repeat_bin", F.array_join("filters", ",").alias("filters"), "pass")


@_query(
    f"""WITH {C.READS_SQL}, gaps AS (SELECT molecule, flags, (kept - 150) // 100 AS site, kept FROM made WHERE large AND a + 30 >= 100),
events AS (SELECT DISTINCT true AS deletion, kept + 1 AS pos, 60 AS unit, CAST(NULL AS VARCHAR) AS bases, kept FROM gaps), {_PLACES_SQL},
sides AS (SELECT site, molecule, max(CASE WHEN flags = 0 THEN 0 ELSE 1 END) AS most, min(CASE WHEN flags = 0 THEN 0 ELSE 1 END) AS least FROM gaps GROUP BY 1, 2)
SELECT s.site, count(*) AS support, count(*) FILTER (least = 0) AS forward, count(*) FILTER (least = 1) AS reverse, any_value(v.n) AS breakpoint_variants
FROM sides s JOIN (SELECT site, count(DISTINCT pos - back) AS n FROM gaps JOIN moved USING (kept) GROUP BY 1) v ON v.site = s.site GROUP BY s.site HAVING count(*) >= 2"""
)
def deletion_support(spark, d) -> DataFrame:
    """Large deletions by the site they were made at, after the placement search: what supports each."""
    # bases are made of what is written, for the reads that are asked for them
    reads = C.with_bases(written(C.made_rows(spark, d), "made"))
    junctions = written(deletions.cigar_junctions(reads, C.GENOME_SIZE), "junctions")
    pieces = written(aligned_pieces(reads, C.GENOME_SIZE).select("molecule", "start", "end"), "pieces")
    depths = intervals.depth(intervals.merged(pieces, ["molecule"]), C.GENOME_SIZE)
    found = deletions.large_deletions(junctions, pieces, C.GENOME, reads.select("molecule").distinct().count(), depths, reads)
    site = F.floor((F.col("start") - 151) / 100).cast("long")
    return found.select(site.alias("site"), "support", "forward", "reverse", "breakpoint_variants")


@_query()
def haplotype_mixture(spark, d) -> DataFrame:
    """Orders as molecules of two lineages, told apart by the bases at twelve sites."""
    key = F.col("l_orderkey")
    minor, site = F.pmod(key, F.lit(4)) == 0, F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(12))
    wrong = F.pmod(F.col("l_suppkey") * 31 + key, F.lit(97)) == 0
    carries = (minor & (site >= 6)) | (~minor & (site < 6))
    rows = C.table(spark, d, "lineitem").select(
        key.alias("molecule"),
        F.col("l_linenumber").alias("record_index"),
        F.col("l_suppkey").alias("query"),
        (site * 50 + 20).cast("long").alias("position"),
        F.when(carries != wrong, "T").otherwise("C").alias("base"),
    )
    levels = rows.groupBy("position").agg(F.avg((F.col("base") == "T").cast("int")).alias("fraction"))
    calls = levels.select("position", F.lit("C").alias("ref"), F.lit("T").alias("alt"), "fraction", F.lit(True).alias("pass"))
    return haplotypes.haplotypes(written(rows, "bases"), written(calls, "levels"), run_lengths(spark, "ACGT" * 200)).members


# Reads with tags: a molecule is two orders, some lines lack its tag, some orders have none or two.
_TAGGED_SQL = C.READS_SQL + """, tagged AS (
  SELECT record_index, 'q' || molecule AS id, flags + CASE line WHEN 2 THEN 2048 WHEN 3 THEN 256 WHEN 4 THEN 1024 ELSE 0 END AS flags, mapq, CASE WHEN supp % 7 = 0 THEN 'chr1' ELSE 'MT' END AS contig,
         CASE WHEN molecule % 11 = 0 OR line = 6 THEN NULL WHEN molecule % 13 = 0 AND line = 5 THEN 'Z' ELSE 'M' || (molecule // 2) END AS mi,
         CASE WHEN supp % 5 = 0 THEN NULL WHEN molecule % 17 = 0 THEN 'U' || (part % 2) ELSE 'U0' END AS rx, start + a + y + 139 > 600 AS over
  FROM made), sided AS (SELECT *, flags & 2304 = 0 AS prime FROM tagged),
names AS (SELECT id, count(*) FILTER (prime) AS primaries, count(*) FILTER (mi IS NULL) AS lacking, CASE WHEN min(mi) IS NULL THEN 'missing' WHEN min(mi) <> max(mi) THEN 'conflict' ELSE 'tag' END AS state, min(mi) AS mi FROM sided GROUP BY id),
keyed AS (SELECT s.* EXCLUDE (mi), state, primaries, lacking, CASE state WHEN 'missing' THEN 'UNASSIGNED:MI:' || s.id WHEN 'conflict' THEN 'CONFLICT:MI:' || s.id ELSE 'MI:' || n.mi END AS molecule_id FROM sided s JOIN names n ON n.id = s.id),
whole AS (SELECT molecule_id, min(state) AS state, count(*) AS fragments, count(DISTINCT id) AS qnames, count(*) FILTER (prime) AS primaries, count(*) FILTER (prime AND flags & 1540 = 0) AS usable,
    list(record_index ORDER BY prime DESC, CASE WHEN prime THEN mapq ELSE 0 END DESC, record_index)[1] AS representative, bool_or(flags & 256 <> 0) AS secondary, bool_or(flags & 2048 <> 0) AS supplementary, bool_or(flags & 1024 <> 0) AS duplicate,
    min(rx) AS low, max(rx) AS high, count(*) FILTER (rx IS NULL) AS bare, count(DISTINCT contig) AS contigs, bool_or(over) AS over, bool_or(primaries <> 1) AS unclear, bool_or(lacking > 0) AS partial FROM keyed GROUP BY 1),
told AS (SELECT *, CASE WHEN state <> 'tag' THEN state WHEN unclear THEN 'malformed' END AS problem FROM whole),
reasoned AS (SELECT *, [CASE problem WHEN 'missing' THEN 'MISSING_MOLECULE_ID_TAG' WHEN 'conflict' THEN 'CONFLICTING_MOLECULE_ID_TAG' WHEN 'malformed' THEN 'INVALID_PRIMARY_COUNT_PER_QNAME' END,
    CASE WHEN low <> high THEN 'CONFLICTING_UMI_TAG_VALUES' END, CASE WHEN primaries > 0 AND usable = 0 THEN 'NO_ELIGIBLE_PRIMARY_EVIDENCE' END] AS reasons FROM told)
SELECT molecule_id, CASE problem WHEN 'missing' THEN 'missing_explicit_molecule_id' WHEN 'conflict' THEN 'conflicting_explicit_molecule_id' WHEN 'malformed' THEN 'invalid_tagged_fragment_group' ELSE CASE WHEN qnames > 1 THEN 'explicit_tag_multi_qname_group' ELSE 'explicit_tag_single_qname_group' END END AS assembly_status,
  representative, fragments, qnames, primaries, problem IS NOT NULL OR coalesce(low <> high, false) AS ambiguous, len(list_filter(reasons, lambda x: x IS NOT NULL)) = 0 AS analysis_eligible,
  array_to_string(list_sort(list_filter(reasons, lambda x: x IS NOT NULL)), ',') AS exclusion_reasons,
  array_to_string(list_sort(list_filter(list_concat(reasons, [CASE WHEN low IS NULL THEN 'MISSING_UMI_TAG' END, CASE WHEN low = high AND bare > 0 THEN 'PARTIAL_UMI_TAG_INHERITED' END, CASE WHEN state = 'tag' AND partial THEN 'PARTIAL_MOLECULE_ID_TAG_INHERITED' END]), lambda x: x IS NOT NULL)), ',') AS warnings,
  array_to_string(list_sort(list_filter(['EXPLICIT_MOLECULE_ID', CASE WHEN low = high THEN 'UMI_RECORDED' END, CASE WHEN qnames > 1 THEN 'MULTI_QNAME_MOLECULE' END, CASE WHEN secondary THEN 'SECONDARY_EVIDENCE_PRESENT' END, CASE WHEN supplementary THEN 'SUPPLEMENTARY_EVIDENCE_PRESENT' END,
    CASE WHEN duplicate THEN 'SAM_DUPLICATE_FLAG_PRESENT' END, CASE WHEN contigs > 1 THEN 'MULTI_REFERENCE_ALIGNMENT' END, CASE WHEN over THEN 'ORIGIN_SPANNING_ALIGNMENT' END], lambda x: x IS NOT NULL)), ',') AS protocol_flags
FROM reasoned"""


@_query("WITH " + _TAGGED_SQL)
def molecule_assembly(spark, d) -> DataFrame:
    order, line = F.col("molecule"), F.col("line")
    extra = F.when(line == 2, 2048).when(line == 3, 256).when(line == 4, 1024).otherwise(0)
    none = F.lit(None).cast("string")
    mi = F.when((F.pmod(order, F.lit(11)) == 0) | (line == 6), none).when((F.pmod(order, F.lit(13)) == 0) & (line == 5), "Z").otherwise(F.concat(F.lit("M"), F.floor(order / 2).cast("string")))
    rx = F.when(F.pmod("supp", F.lit(5)) == 0, none).when(F.pmod(order, F.lit(17)) == 0, F.concat(F.lit("U"), F.pmod("part", F.lit(2)).cast("string"))).otherwise("U0")
    rows = C.made_reads(spark, d).withColumns(
        {
            "id": F.concat(F.lit("q"), order.cast("string")),
            "flags": F.col("flags") + extra,
            "reference_name": F.when(F.pmod("supp", F.lit(7)) == 0, "chr1").otherwise("MT"),
            "aux_tags": F.map_filter(F.create_map(F.lit("MI"), mi, F.lit("RX"), rx), lambda k, v: v.isNotNull()),
        }
    )
    found = molecules.assembly(rows, Config(result_schema="0.6", molecule_id_tag="MI", umi_tag="RX"), 600)
    joined = (F.array_join(c, ",").alias(c) for c in ("exclusion_reasons", "warnings", "protocol_flags"))
    return found.select("molecule_id", "assembly_status", "representative", "fragments", "qnames", "primaries", "ambiguous", "analysis_eligible", *joined)


_TARGETS_SQL = C.BASES_SQL.replace("l_orderkey AS query", "l_orderkey % 100 AS query, CAST(round(l_discount * 100) AS BIGINT) * 6 AS mapq, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand") + """, targets AS (
  SELECT DISTINCT 'snv:' || position || ':' || ref || '>' || alt AS event, position, ref, alt FROM (
    SELECT p_partkey * 7 % 60 + 1 AS position, substr('ACGT', CAST((p_partkey * 7 % 60 + 1) % 4 AS INTEGER) + 1, 1) AS ref, substr('ACGT', CAST((p_partkey * 7 % 60 + 2 + p_partkey % 3) % 4 AS INTEGER) + 1, 1) AS alt FROM part WHERE p_size < 20)
), near AS (SELECT *, quality >= 10 AS good, 2.0 * least(query, 99 - query) / 99 AS center FROM bases WHERE position IN (SELECT position FROM targets)),
one AS (SELECT molecule, position, min(base) FILTER (good) AS low, max(base) FILTER (good) AS high,
    list({'q': quality, 'b': base, 'm': mapq, 's': strand, 'c': center} ORDER BY quality DESC, fragment, query, base DESC, mapq DESC, strand DESC) FILTER (good)[1] AS best,
    list({'m': mapq, 's': strand} ORDER BY fragment, mapq, strand)[1] AS first FROM near GROUP BY 1, 2),
seen AS (SELECT molecule, event, CASE WHEN best IS NULL THEN 'LOW_QUALITY' WHEN low <> high THEN 'CONFLICT' WHEN best.b = alt THEN 'ALTERNATE' WHEN best.b = ref THEN 'REFERENCE' ELSE 'EVENT_ABSENT' END AS state,
    CASE WHEN low = high THEN best.q END AS quality, coalesce(best.m, first.m) AS mapq, coalesce(best.s, first.s) AS strand, CASE WHEN low = high THEN best.c END AS center FROM one JOIN targets USING (position))
SELECT event, count(*) FILTER (state = 'ALTERNATE') AS alternate, count(*) FILTER (state = 'REFERENCE') AS reference, count(*) FILTER (state = 'EVENT_ABSENT') AS other, count(*) FILTER (state = 'LOW_QUALITY') AS low_quality, count(*) FILTER (state = 'CONFLICT') AS conflict,
  count(*) FILTER (state IN ('ALTERNATE', 'REFERENCE', 'EVENT_ABSENT')) AS callable, count(*) FILTER (state = 'ALTERNATE' AND strand = '+') AS alternate_forward, count(*) FILTER (state = 'REFERENCE' AND strand = '-') AS reference_reverse,
  round(avg(quality) FILTER (state = 'ALTERNATE'), 6) AS alternate_quality_mean, min(mapq) FILTER (state = 'ALTERNATE') AS alternate_mapq_min, max(mapq) FILTER (state = 'REFERENCE') AS reference_mapq_max,
  round(avg(mapq) FILTER (state = 'EVENT_ABSENT'), 6) AS other_mapq_mean, round(avg(center) FILTER (state = 'ALTERNATE'), 6) AS alternate_read_position FROM seen GROUP BY event"""


@_query("WITH " + _TARGETS_SQL)
def event_evidence(spark, d) -> DataFrame:
    """Depths, qualities and places of alleles at target positions, by the state that each molecule shows."""
    rows = C.table(spark, d, "lineitem")
    bases = rows.select(
        F.pmod("l_orderkey", F.lit(200)).alias("molecule"),
        F.col("l_linenumber").alias("fragment"),
        (F.pmod("l_partkey", F.lit(60)) + 1).alias("position"),
        F.substring(F.lit("ACGT"), (F.pmod(F.col("l_suppkey") + F.col("l_partkey"), F.lit(4)) + 1).cast("int"), F.lit(1)).alias("base"),
        F.floor("l_quantity").cast("long").alias("quality"),
        F.pmod("l_orderkey", F.lit(100)).alias("query"),
        (F.round(F.col("l_discount") * 100).cast("long") * 6).alias("mapping_quality"),
        F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "+").otherwise("-").alias("strand"),
        F.lit(100).alias("size"),
    )
    at = F.pmod(F.col("p_partkey") * 7, F.lit(60)) + 1
    letter = lambda n: F.substring(F.lit("ACGT"), (F.pmod(n, F.lit(4)) + 1).cast("int"), F.lit(1))
    targets = C.table(spark, d, "part").where("p_size < 20").select(at.alias("position"), letter(at).alias("ref"), letter(at + 1 + F.pmod("p_partkey", F.lit(3))).alias("alt"))
    targets = targets.withColumn("event", F.concat(F.lit("snv:"), F.col("position").cast("string"), F.lit(":"), "ref", F.lit(">"), "alt")).distinct()
    found = evidence.event_evidence(evidence.target_observations(bases, targets, 10))
    six = lambda c: F.round(c, 6).alias(c)
    return found.select("event", "alternate", "reference", "other", "low_quality", "conflict", "callable", "alternate_forward", "reference_reverse", six("alternate_quality_mean"),
                        "alternate_mapq_min", "reference_mapq_max", six("other_mapq_mean"), six("alternate_read_position"))


@_query(
    f"""WITH {C.OBS_SQL}, t AS (
  SELECT a.event AS event_a, b.event AS event_b, count(*) FILTER (a.state = 'ALTERNATE' OR b.state = 'ALTERNATE') AS seen, count(*) FILTER (a.state = 'ALTERNATE' AND b.state = 'ALTERNATE') AS "both", count(*) FILTER (a.state = 'LOW_QUALITY' OR b.state = 'LOW_QUALITY') AS uncertain
  FROM obs a JOIN obs b ON a.molecule = b.molecule AND a.event < b.event GROUP BY 1, 2), linked AS (SELECT *, CAST(right(event_a, 1) AS INTEGER) % 2 = 0 AND CAST(right(event_b, 1) AS INTEGER) % 2 = 0 AS complete FROM t WHERE seen > 0)
SELECT event_a, event_b, "both", uncertain, complete, CASE WHEN complete THEN 'COMPLETE_FOR_BOTH_EVENTS' ELSE 'SUPPORT_CONDITIONED' END AS assessability,
  concat_ws(',', CASE WHEN NOT complete THEN 'SUPPORT_CONDITIONED' END, CASE WHEN uncertain > 0 THEN 'UNCERTAIN_COOCCURRENCE_EXCLUDED' END) AS qc_flags FROM linked"""
)
def assessed_links(spark, d) -> DataFrame:
    seen = C.obs(spark, d)
    events = seen.select("event").distinct().withColumn("absence_assessable", F.pmod(F.expr("right(event, 1)").cast("int"), F.lit(2)) == 0)
    limits = Config(max_phase_work=10**15, max_phase_links=10**12, max_phase_molecule_references=10**15)
    found = evidence.assessed_links(seen, events, limits)
    return found.select("event_a", "event_b", "both", "uncertain", "complete", "assessability", F.array_join("qc_flags", ",").alias("qc_flags"))

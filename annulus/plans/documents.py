"""Queries of exports, pages, search, documents, contracts and resource tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.functions import coords, stats
from annulus.operators import contracts, documents, exports, ordered, result_contracts, search
from annulus.plans import carriers as C
from annulus.plans.registry import query as _query
from annulus.sources import tables

_VARIANTS_SQL = """v AS (SELECT p_partkey AS position, 'A' AS ref, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'G' END AS alt, p_size AS support, p_size * 2 + 1 AS callable, p_size * 1.0 / (p_size * 2 + 1) AS level,
  CASE WHEN p_partkey % 3 = 0 THEN 'MT-' || p_type END AS gene, CASE WHEN p_partkey % 4 = 0 THEN 'likely ' || p_brand END AS significance FROM part)"""


def _variants(spark, d) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    level = size / (size * 2 + 1)
    return C.table(spark, d, "part").select(
        key.alias("position"), F.lit("A").alias("ref"), F.when(F.pmod(size, F.lit(2)) == 0, "C").otherwise("G").alias("alt"), size.cast("long").alias("support"), (size * 2 + 1).cast("long").alias("callable"), level.alias("level"),
        (level / 2).alias("ci_low"), ((1 + level) / 2).alias("ci_high"), F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.lit("MT-"), "p_type")).alias("gene"), F.when(F.pmod(key, F.lit(4)) == 0, F.concat(F.lit("likely "), "p_brand")).alias("significance"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.array(F.lit("a b"), F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )


_TAIL_SQL = "CASE WHEN gene IS NOT NULL THEN ';GENE=' || regexp_replace(gene, '[ \\t\\r\\n;=,]', '_', 'g') ELSE '' END || CASE WHEN significance IS NOT NULL THEN ';CLNSIG=' || regexp_replace(significance, '[ \\t\\r\\n;=,]', '_', 'g') ELSE '' END"


@_query(
    f"""WITH {_VARIANTS_SQL} SELECT position, ref, alt, 'NC_012920.1' || chr(9) || position || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'AC=' || support || ';DP=' || callable || ';HF=' || printf('%.6f', level)
  || {_TAIL_SQL} || CASE WHEN position % 5 = 0 THEN ';CLNSRC=a_b,c' ELSE '' END || ';HF_CI95=' || printf('%.6f', level / 2) || ',' || printf('%.6f', (1 + level) / 2) || chr(9) || 'GT:HF' || chr(9) || '0/1:' || printf('%.6f', level) AS line FROM v"""
)
def vcf_lines(spark, d):
    return exports.vcf_lines(_variants(spark, d))


@_query(
    f"""WITH {_VARIANTS_SQL} SELECT position, ref, alt, 'NC_012920.1' || chr(9) || position || chr(9) || 'e' || position || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || '.' || chr(9) || 'AC=' || support || ';DP=' || callable || ';HF=' || printf('%.6f', level)
  || ';AD=' || (callable - support) || ',' || support || ';ODC=0;LOWQ=' || position % 7 || ';CONFLICT=0;MOLECULE_SUPPORT=' || support || ';MQ=' || printf('%.4f', position / 3.0) || CASE WHEN position % 2 = 0 THEN ';STRAND_SUPPORT=1,2,3,4' ELSE '' END || ';NUMT_ASSESSABLE=not_known;QC_FLAGS=A,B'
  || {_TAIL_SQL} || CASE WHEN position % 4 = 0 THEN ';CLNCONFLICT' ELSE '' END || ';HF_CI95=' || printf('%.6f', level / 2) || ',' || printf('%.6f', (1 + level) / 2) || ';EVENT_TYPE=SNV' || chr(9) || 'GT:DP:AD:HF' || chr(9) || '.:' || callable || ':' || (callable - support) || ',' || support || ':' || printf('%.6f', level) AS line FROM v"""
)
def evidence_vcf_lines(spark, d):
    p, none = F.col("position"), F.lit(None)
    rows = _variants(spark, d).withColumns({
        "vcf_position": p, "event": F.concat(F.lit("e"), p.cast("string")), "type": F.lit("SNV"), "reference": F.col("callable") - F.col("support"), "other": F.lit(0), "low_quality": F.pmod(p, F.lit(7)), "conflict": F.lit(0),
        "mapping_quality": p / 3.0, "base_quality": none.cast("double"), "strands": F.when(F.pmod(p, F.lit(2)) == 0, F.array(*map(F.lit, (1, 2, 3, 4)))), "numt": F.lit("not known"), "flags": F.array(F.lit("A"), F.lit("B")),
        "normalization": none.cast("string"), "conflicting": F.pmod(p, F.lit(4)) == 0, "sources": F.array().cast("array<string>"), "representable": F.lit(True),
    })
    return exports.evidence_vcf_lines(rows)


@_query(
    f"""WITH {_VARIANTS_SQL} SELECT 'legacy:' || position || ':' || ref || ':' || alt AS event_id, 'SNV' AS type, CAST(position AS VARCHAR) AS position, '' AS start, '' AS "end", ref, alt, CAST(support AS VARCHAR) AS alt_molecules, '' AS ref_molecules, '' AS other_molecules, CAST(callable AS VARCHAR) AS callable_molecules,
  printf('%.8f', level) AS heteroplasmy, '' AS ci95_low, '' AS ci95_high, '' AS alt_forward, '' AS alt_reverse, '' AS ref_forward, '' AS ref_reverse, '' AS alt_mean_mapq, printf('%.4f', position / 7.0) AS alt_mean_baseq, CASE WHEN position % 2 = 0 THEN 'true' ELSE 'false' END AS multi_allelic, '' AS homopolymer_run, '' AS numt_assessability, '' AS filter_status,
  CASE WHEN position % 5 = 0 THEN 'a b;c' ELSE '' END AS qc_flags, '' AS supporting_molecule_ids, coalesce(gene, '') AS gene, '' AS consequence, coalesce(significance, '') AS clinical_significance FROM v"""
)
def variant_table(spark, d):
    p = F.col("position")
    rows = _variants(spark, d).withColumnsRenamed({"support": "alt_molecules", "callable": "callable_molecules", "level": "heteroplasmy", "significance": "clinical_significance", "sources": "qc_flags"}).drop("ci_low", "ci_high")
    return exports.variant_table(rows.withColumn("alt_mean_baseq", p / 7.0).withColumn("multi_allelic", F.pmod(p, F.lit(2)) == 0))


@_query(
    """SELECT '{"metadata":{"schema_version": "0.5"},"regions":[' || (SELECT string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) FROM region) || '],"segments":['
  || (SELECT string_agg('{"c_mktsegment":"' || c_mktsegment || '","n":' || n || ',"none":null}', ',' ORDER BY c_mktsegment) FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)) || ']}' AS json"""
)
def result_document(spark, d):
    regions = C.table(spark, d, "region").select("r_regionkey", "r_name")
    segments = C.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("none", F.lit(None).cast("double"))
    return documents.document(spark, {"schema_version": "0.5"}, {"regions": (regions, ["r_regionkey"]), "segments": (segments, ["c_mktsegment"])})


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN x = 0 THEN 0.0 ELSE round(x * pow(10, 5 - floor(log10(abs(x))))) / pow(10, 5 - floor(log10(abs(x)))) END AS six, NULL::DOUBLE AS none FROM (SELECT *, l_extendedprice * l_discount / 7 AS x FROM lineitem)")
def six_digits(spark, d):
    x = F.col("l_extendedprice") * F.col("l_discount") / 7
    nan = F.lit(float("nan"))
    return C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", documents.six_digits(x).alias("six"), documents.six_digits(nan).alias("none"))


@_query("SELECT o_orderstatus, '{\"a\":\"' || o_orderstatus || '\",\"b\":\"' || count(*) || '\"}' AS json FROM orders GROUP BY 1")
def text_maps(spark, d):
    rows = C.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    held = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.col("n").cast("string"), F.col("o_orderstatus")))
    return rows.select("o_orderstatus", documents.text_map(held).alias("json"))


@_query(
    """WITH a AS (SELECT l_partkey % 50 AS id, l_returnflag AS flag FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey % 50 AS id, l_returnflag AS flag FROM lineitem WHERE l_linestatus = 'O')
SELECT * FROM (SELECT 'rows' AS section, 'first' AS only, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'rows', 'second', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) WHERE n > 0"""
)
def projection_differences(spark, d):
    side = lambda s: documents.projected(C.table(spark, d, "lineitem").where(F.col("l_linestatus") == s).select(F.pmod("l_partkey", F.lit(50)).alias("id"), F.col("l_returnflag").alias("flag"), "l_tax"), ["id", "flag"])
    return documents.same({"rows": side("F")}, {"rows": side("O")})


_POSTED_SQL = "o AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, event_id, user_id % 5 AS molecule, event_type AS event, CASE event_id % 3 WHEN 0 THEN 'ALTERNATE' WHEN 1 THEN 'REFERENCE' ELSE 'LOW_QUALITY' END AS state FROM events)"


def _posted(spark, d) -> DataFrame:
    state = F.when(F.pmod("event_id", F.lit(3)) == 0, "ALTERNATE").when(F.pmod("event_id", F.lit(3)) == 1, "REFERENCE").otherwise("LOW_QUALITY")
    rows = C.table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(5)).alias("molecule"), F.col("event_type").alias("event"), state.alias("state"))
    return ordered.numbered(rows, "event_id", name="id").withColumn("id", F.col("id") - 1).drop("_total")


@_query(f"WITH {_POSTED_SQL} SELECT id, event_id, n, total, CASE WHEN total > 70 THEN CAST(70 AS BIGINT) END AS next_cursor FROM (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM o WHERE event = 'click' AND state = 'ALTERNATE' AND molecule = 2) WHERE n BETWEEN 21 AND 70")
def posting_search(spark, d):
    rows = _posted(spark, d)
    found = search.search(rows, search.postings(rows, "id"), "id", {"event": " click ", "state": "ALTERNATE", "molecule": "2"}, 20, 50)
    return found.select("id", "event_id", "n", "total", "next_cursor")


@_query(f"WITH {_POSTED_SQL} SELECT 'molecule' AS field, CAST(molecule AS VARCHAR) AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'event', event, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM o GROUP BY 2")
def search_dictionary(spark, d):
    return search.dictionary(search.postings(_posted(spark, d), "id"))


@_query(f"WITH {_POSTED_SQL} SELECT id, event, state FROM o WHERE id // 512 = 1")
def page_rows(spark, d):
    """The rows of one page, from its parallel arrays."""
    paged = exports.page_at(exports.pages(_posted(spark, d).select("id", "event", "state"), "id", 512), 1)
    return exports.unpaged(paged, ["id", "event", "state"])


@_query(
    """WITH m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 0), r AS (SELECT l_orderkey AS k, l_partkey AS s, l_partkey + l_linenumber - 3 AS e FROM lineitem)
SELECT CAST(o_custkey AS VARCHAR) AS what, 'repeated' AS rule FROM orders GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'dangling' FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM m)
UNION ALL SELECT CAST(k AS VARCHAR), 'disordered' FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE s > e OR s <= b"""
)
def contract_breaks(spark, d):
    orders, lines = C.table(spark, d, "orders"), C.table(spark, d, "lineitem")
    known = orders.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("k"))
    ranges = lines.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") - 3).alias("end"))
    checks = (contracts.repeated(orders, ["o_custkey"]), contracts.dangling(lines, "l_orderkey", known, "k"), contracts.disordered(ranges, ["k"]))
    return reduce(DataFrame.unionByName, checks)



@_query("SELECT CAST(p_partkey AS VARCHAR) AS what, 'statistics' AS rule FROM part WHERE p_size % 10 = 0 OR p_partkey % 9 = 0")
def statistics_breaks(spark, d):
    """Variants whose counts or intervals were made wrong are found, and no others."""
    k, n = F.col("p_size").cast("long"), (F.col("p_size") * 2 + 3).cast("long")
    low, high = stats.wilson(k, n)
    off = F.when(F.pmod("p_size", F.lit(10)) == 0, 1e-6).otherwise(0.0)
    other = F.when(F.pmod("p_partkey", F.lit(9)) == 0, F.lit(1)).otherwise(F.lit(0))
    rows = C.table(spark, d, "part").select(F.col("p_partkey").alias("event"), k.alias("alternate"), (n - k).alias("reference"), other.alias("other"), n.alias("callable"), (k / n).alias("level"), (low + off).alias("ci_low"), high.alias("ci_high"))
    return contracts.variant_statistics(rows)


@_query(
    """SELECT o_orderkey || '' AS what, rule FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['schema', 'filter_stats', 'reads', 'variants', 'svs', 'complex_events', 'clusters']
  WHEN 2 THEN ['reads'] ELSE ['evidence_encoding', 'alignments', 'molecules', 'callability', 'events', 'observation_pages', 'phase_links', 'architecture_inference', 'architectures', 'observations'] END) AS rule FROM orders)"""
)
def document_breaks(spark, d):
    plain = '"filter_stats":{},"variants":[],"svs":[],"complex_events":[],"clusters":[]'
    n = F.pmod("o_orderkey", F.lit(4))
    sound = F.lit('{"metadata":{"schema_version":"0.5"},"reads":[],' + plain + "}")
    text = F.when(n == 0, sound).when(n == 1, '{"metadata":{}}').when(n == 2, '{"metadata":{"schema_version":"0.5"},"reads":{},' + plain + "}")
    text = text.otherwise('{"metadata":{"schema_version":"0.6"},"reads":[],"observations":[1],' + plain + "}")
    return contracts.document(C.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"), text.alias("json")))


@_query(
    """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'ClinVar' ELSE 'x' END AS k FROM supplier)
SELECT CAST(p_partkey AS VARCHAR) AS position, 'A' AS ref, 'G' AS alt, trim(p_brand) AS gene, 'RCV1;RCV2' AS accession, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.ncbi.nlm.nih.gov/clinvar/variation/' || p_partkey || '/' ELSE '' END AS url, 'ClinVar' AS source, '' AS codon, 'unix:7' AS retrieved
FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0"""
)
def clinical_summary(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    m = lambda k: F.pmod(size, F.lit(k)) == 0
    rows = C.table(spark, d, "part").select(
        F.when(m(3), "GRCh37").otherwise("GRCh38").alias("Assembly"), F.when(m(5), "1").otherwise("MT").alias("Chromosome"), key.cast("string").alias("PositionVCF"), F.lit("A").alias("ReferenceAlleleVCF"), F.when(m(7), "na").otherwise("G").alias("AlternateAlleleVCF"),
        F.when(F.pmod(key, F.lit(2)) == 0, key.cast("string")).otherwise("v1").alias("VariationID"), F.concat(F.lit("\t"), "p_brand").alias("GeneSymbol"), F.lit("RCV1|RCV2").alias("RCVaccession"),
    )
    return tables.clinical_summary(rows, 7).select("position", "ref", "alt", "gene", "accession", "url", "source", "codon", "retrieved")


@_query(
    f"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '1-' || p_size || ',' || ({coords.L} - p_size) || '-{coords.L}' ELSE p_size || '-' || (p_size + 10) || ',' || (p_size + 20) || '-' || (p_size + 20) END AS ranges, CASE WHEN p_size % 2 = 0 THEN p_size || 'd' ELSE p_size || 'G' END AS marker FROM part"""
)
def profile_fields(spark, d):
    size = F.col("p_size")
    text = lambda x: x.cast("string")
    wrapped = F.concat(F.lit('"'), text(coords.L - size), F.lit("-"), text(size), F.lit('"'))
    plain = F.concat(text(size + 20), F.lit("; "), text(size), F.lit(" - "), text(size + 10), F.lit(";"))
    raw = F.when(F.pmod(size, F.lit(4)) == 0, wrapped).otherwise(plain)
    ranges = F.array_join(F.transform(tables.profile_ranges(raw), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    marker = tables.profile_marker(F.concat(F.lit(" "), text(size), F.when(F.pmod(size, F.lit(2)) == 0, "del").otherwise("G")))
    return C.table(spark, d, "part").select("p_partkey", ranges.alias("ranges"), marker.alias("marker"))


@_query(
    """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part)
SELECT p_partkey, 100 + n AS position, 1 AS deleted, 'G' AS inserted FROM p UNION ALL SELECT p_partkey, 101 + n, 0, 'TT' FROM p UNION ALL SELECT p_partkey, 104 + n, 2, '' FROM p UNION ALL SELECT p_partkey, 109 + n, 1, 'C' FROM p"""
)
def difference_edits(spark, d):
    cs = F.concat(F.lit("="), F.repeat(F.lit("A"), F.col("p_size")), F.lit("*ag+tt=CCC-cc*na=G-n*tc"))
    rows = C.table(spark, d, "part").select("p_partkey", cs.alias("cs"), F.lit(100).alias("start"))
    return tables.difference_edits(rows).select("p_partkey", "position", "deleted", "inserted")


@_query("SELECT n, v, max(v) OVER (PARTITION BY g ORDER BY n) AS m FROM (SELECT p_size AS n, p_brand AS g, min(p_retailprice) AS v FROM part GROUP BY 1, 2)")
def monotone_rates(spark, d):
    rows = C.table(spark, d, "part").groupBy(F.col("p_size").alias("n"), F.col("p_brand").alias("g")).agg(F.min("p_retailprice").alias("v"))
    return ordered.monotone(rows.withColumn("m", F.col("v")), ["g"], "n", "m").select("n", "v", "m")


@_query("""SELECT row_number() OVER (ORDER BY p_partkey, line) AS n, line FROM (
  SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || ',"none":null}' AS line FROM part)""")
def section_lines(spark, d):
    """A section of a document of any size, as numbered lines."""
    rows = C.table(spark, d, "part").select("p_partkey", "p_brand", "p_size").withColumn("none", F.lit(None).cast("double"))
    return documents.lines(rows, ["p_partkey"])


@_query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS name FROM supplier)
SELECT name, 'metadata.schema_version' AS path, CASE WHEN k % 11 = 0 THEN 'not JSON' ELSE 'unknown schema' END AS rule FROM s WHERE k % 11 = 0 OR k % 5 = 0
UNION ALL SELECT name, 'reads', 'must be array' FROM s WHERE k % 3 = 1 AND k % 11 <> 0 AND k % 5 <> 0
UNION ALL SELECT name, 'metadata.reference_length', 'must be unsigned' FROM s WHERE k % 7 = 0 AND k % 11 <> 0 AND k % 5 <> 0""")
def contract_violations(spark, d):
    """Result documents, one for each supplier, some of them broken: what breaks."""
    k = F.col("s_suppkey")
    versions = "".join(f'"{name}":"1.0",' for name in ("sv_event_schema_version", "complex_sv_event_schema_version", "clinical_annotation_schema_version", "engine_version"))
    parts = [
        F.lit('{"metadata":{"schema_version":"'), F.when(F.pmod(k, F.lit(5)) == 0, "0.7").otherwise("0.5"), F.lit(f'",{versions}"resources":[],"reference_length":'), F.when(F.pmod(k, F.lit(7)) == 0, "-1").otherwise("16569"),
        F.lit('},"filter_stats":{"passed_reads":1,"numt_assessment":{}},"variants":[],"svs":[],"complex_events":[],"clusters":[],"reads":'), F.when(F.pmod(k, F.lit(3)) == 1, "{}").otherwise("[]"), F.lit("}"),
    ]
    text = F.when(F.pmod(k, F.lit(11)) == 0, "{").otherwise(F.concat(*parts))
    docs = C.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), text.alias("json"))
    return result_contracts.broken(docs)

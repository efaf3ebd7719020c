"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm import (
    chunk_store,
    compression_bands,
    filter_audit,
    langid,
    length_histogram,
    license_rules,
    line_runs,
    packing,
    poisson_mix,
    projection_forest,
    sentencepiece_bpe,
    simhash,
    vector_codes,
)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_histogram(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = chunk_store.store_path(spark)
    chunk_store.write_store(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    read = chunk_store.read_digests(spark, path)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = compression_bands.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.drop("text")


def op5_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.digest(license_rules.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_runs.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_lines",
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join("deleted", ",").alias("deleted"),
        "gone",
        F.col("doc.text").alias("text"),
    )


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # target weights by a rule that any table's sources have: the number at the end of the name, from 1 to 8
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    targets = docs.select("source").distinct().select("source", (1 + F.pmod(number, F.lit(8))).alias("weight"))
    mixed = poisson_mix.mix(docs, targets)
    return mixed.select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key")


def op9_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.encode(docs, piece_model_path(), verify=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "verified",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_length_histogram,
        op2_chunk_store,
        op3_projection_forest,
        op4_compression_bands,
        op5_hierarchical_langid,
        op6_license_rules,
        op7_line_runs,
        op8_poisson_mix,
        op9_byte_index_simhash,
        op10_hierarchical_packing,
        op11_va_file_codes,
        op12_filter_audit,
        op13_sentencepiece_agenda,
        pipeline,
    )
    return {f.__name__: f for f in own}


# A run is deleted if the same lines, in the same order, start at an earlier (doc_id, line).
_LINE_RUNS_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line, l, len(list_filter(regexp_split_to_array(l, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
         sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto
  FROM lines WHERE words > 0
), spans AS (
  SELECT doc_id, pos, min(pos) OVER ahead AS f, max(pos) OVER ahead AS t, sum(words) OVER ahead AS w,
         min(pos) OVER back AS bf, max(pos) OVER back AS bt, sum(words) OVER back AS bw
  FROM (SELECT *, upto - words AS since FROM worded)
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN 0 PRECEDING AND 49 FOLLOWING),
         back AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)
), runs AS (
  SELECT doc_id, f, t FROM spans WHERE w >= 50 UNION SELECT doc_id, bf, bt FROM spans WHERE bw >= 50
), content AS (
  SELECT r.doc_id, r.f, r.t, string_agg(w.l, chr(10) ORDER BY w.pos) AS c
  FROM runs r JOIN worded w ON w.doc_id = r.doc_id AND w.pos BETWEEN r.f AND r.t GROUP BY ALL
), later AS (
  SELECT * FROM content QUALIFY row_number() OVER (PARTITION BY c, t - f ORDER BY doc_id, f) > 1
), deleted AS (
  SELECT DISTINCT w.doc_id, w.line FROM later d JOIN worded w ON w.doc_id = d.doc_id AND w.pos BETWEEN d.f AND d.t
), marked AS (
  SELECT l.doc_id, l.line, l.l, l.words, d.line IS NOT NULL AS cut FROM lines l LEFT JOIN deleted d USING (doc_id, line)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (cut) AS BIGINT) AS n_deleted,
       coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (cut), '') AS deleted,
       count(*) FILTER (cut) > 0 AND count(*) FILTER (NOT cut AND words > 0) = 0 AS gone,
       coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT cut), '') AS text
FROM marked GROUP BY doc_id
"""

_MIX_SQL = f"""
WITH sizes AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN CAST(weight AS DOUBLE) / CAST(sum(weight) OVER () AS DOUBLE) * sum(size) OVER () / size ELSE 1.0 END AS rate
  FROM (SELECT *, 1 + coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 8 AS weight FROM sizes)
), points AS (
  SELECT doc_id, d.source, text, rate,
         CAST(('0x' || substr(md5('{poisson_mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / pow(2, 52) AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), steps AS (
  SELECT source, rate, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k)) AS p
  FROM rates, range(0, 2000) t(k)
), cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)) GROUP BY source
), drawn AS (
  SELECT p.*, CAST(len(list_filter(cs, lambda c: c <= u)) AS BIGINT) AS n_copies FROM points p JOIN cdf ON p.source IS NOT DISTINCT FROM cdf.source
)
SELECT doc_id, source, text, round(rate, 9) AS rate, n_copies, copy,
       md5('order {poisson_mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM drawn)
"""


# Brute force over all pairs of a label, and reachability by recursion.
_FOREST_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {projection_forest.THRESHOLD}
), reach(n, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n WHERE reach.r < l.b
), parts AS (SELECT n, min(r) AS r FROM reach GROUP BY n), counts AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT e.vec_id, coalesce(k, 0) AS n_links, r AS component_id, e.vec_id = r AS kept
FROM embeddings e JOIN parts ON n = e.vec_id LEFT JOIN counts ON a = e.vec_id
"""


def _round_sql(k: int) -> str:
    """Assignment by the codebooks of round k, and those of the next round."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, q, entry, d FROM (
    SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.q, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{k} b USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
), b{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, e) AS e FROM b{k} LEFT JOIN (
    SELECT part, entry, list(v ORDER BY i) AS m FROM (
      SELECT part, entry, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
      FROM (SELECT part, entry, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM a{k}) GROUP BY ALL) GROUP BY ALL
  ) USING (part, entry)
)"""


_CODES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * len(q) // {vector_codes.PARTS} + 1 : (part + 1) * len(q) // {vector_codes.PARTS}] AS q FROM v, range(0, {vector_codes.PARTS}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS e FROM parts
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {vector_codes.ENTRIES})
), {",".join(_round_sql(k) for k in range(vector_codes.ROUNDS + 1))}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{vector_codes.ROUNDS} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i))
  FROM (SELECT part, entry, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM b{vector_codes.ROUNDS})) AS codebooks_sha256
FROM coded
"""


_AUDIT_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents
), said AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN said USING (doc_id)
), masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL
), orders(filter_order) AS (VALUES {", ".join(f"('{o}')" for o in filter_audit.ORDERS)}
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1 : step - 1] AS earlier FROM orders, range(1, 6) t(step)
), seen AS (
  SELECT part, filter_order, step, f, contains(fails, f) AS failed, len(list_filter(string_split(earlier, ''), lambda c: c <> '' AND contains(fails, c))) > 0 AS gone, fails, n, good, toxic
  FROM masks, steps
), told AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f,
         coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_va_file_codes": _CODES_SQL, "op12_filter_audit": _AUDIT_SQL, "op3_projection_forest": _FOREST_SQL, "op7_line_runs": _LINE_RUNS_SQL, "op8_poisson_mix": _MIX_SQL}

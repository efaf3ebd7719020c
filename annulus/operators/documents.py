"""Result documents: sections as JSON with a fixed order of rows, numbers with six digits, projections of fields.

A section is a table. `write_sections` writes each as lines in the order of its key, dealt by ranges,
with a manifest of the sections: that is the form of any size. A document as one value is put together from sections of at most
MOST_ROWS rows, which is checked first; what may be large (observations) belongs into pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.errors import AnalysisError


#: Rows of a section that may go into one value.
MOST_ROWS = 100_000


def six_digits(x: Column) -> Column:
    """A number with six significant digits; null if it isn't finite."""
    value = x.cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    digits = F.when(value == 0, F.lit(5)).otherwise(5 - F.floor(F.log10(F.abs(value))).cast("int"))
    scaled = F.when(digits >= 0, F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).otherwise(F.round(value / F.pow(F.lit(10.0), -digits)) * F.pow(F.lit(10.0), -digits))
    return F.when(finite, scaled)


def rounded(df: DataFrame) -> DataFrame:
    """The table with its doubles as a document has them."""
    return df.select(*(six_digits(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def lines(df: DataFrame, order: list[str]) -> DataFrame:
    """n (from 1), line: the table's rows as JSON in order of the key, numbered over ranges of it; no row meets all others."""
    from annulus.operators.ordered import numbered

    rows = rounded(df)
    return numbered(rows.select(*order, _json(rows.columns).alias("line")), *order, "line", name="n").select("n", "line")


def section(df: DataFrame, order: list[str]) -> DataFrame:
    """One row (json, n): the rows of a small table as a JSON array in order of the key; an empty table gives []."""
    rows = rounded(df)
    every = F.array_sort(F.collect_list(F.struct(*order, _json(rows.columns).alias("_row"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(every, lambda x: x["_row"]), ","), F.lit("]")).alias("json"), F.count("*").alias("n"))


def document(spark: SparkSession, metadata: dict, sections: dict[str, tuple[DataFrame, list[str]]], objects: dict[str, dict] | None = None, most: int = MOST_ROWS) -> DataFrame:
    """One row (json): metadata, objects (name: mapping) and the sections (name: table and key), in the order given. A section of more
    than `most` rows is refused: it goes into files, see `write_sections`."""
    import json

    held = {"metadata": metadata, **(objects or {})}
    out = spark.range(1).select(*(F.lit(json.dumps(v, ensure_ascii=False)).alias(f"_m{i}") for i, v in enumerate(held.values())))
    parts = [F.concat(F.lit("{" if i == 0 else ","), F.lit(f"{json.dumps(name)}:"), F.col(f"_m{i}")) for i, name in enumerate(held)]
    for i, (name, (table, order)) in enumerate(sections.items()):
        if table.limit(most + 1).count() > most:
            raise AnalysisError("E1601", f"section {name} has more than {most} rows")
        out = out.crossJoin(section(table, order).select(F.col("json").alias(f"_s{i}")))  # one row each
        parts.append(F.concat(F.lit(f",{json.dumps(name)}:"), F.col(f"_s{i}")))
    return out.select(F.concat(*parts, F.lit("}")).alias("json"))


def write_sections(spark: SparkSession, folder: str, metadata: dict, sections: dict[str, tuple[DataFrame, list[str]]], objects: dict[str, dict] | None = None) -> None:
    """A document of any size: `head` with the metadata and objects, a folder of JSON lines in order for each section, and a
    manifest (section, rows)."""
    import json

    head = json.dumps({"metadata": metadata, **(objects or {})}, ensure_ascii=False)
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/head")
    counts = []
    for name, (table, order) in sections.items():
        rows = rounded(table)
        ordered = rows.orderBy(*order).select(_json(rows.columns).alias("value"))
        ordered.write.text(f"{folder}/sections/{name}")
        counts.append((name, spark.read.text(f"{folder}/sections/{name}").count()))
    spark.createDataFrame(counts, "section string, rows long").coalesce(1).write.json(f"{folder}/manifest")


def valid_text(raw: Column) -> Column:
    """Bytes as text for a document: invalid sequences are replaced, control characters are escaped by the JSON writer."""
    return F.make_valid_utf8(raw.cast("string"))


def projected(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields alone; one that the table doesn't have is an error."""
    if missing := [f for f in fields if f.split(".")[0] not in df.columns]:
        raise AnalysisError("E9001", f"fields are missing: {', '.join(missing)}")
    return df.select(*(F.col(f).alias(f.replace(".", "_")) for f in fields))


# Fields of the projections that are compared between runs.
EVIDENCE_VARIANT = (
    "position", "ref", "alt", "alt_depth", "ref_depth", "other_depth", "callable_depth", "heteroplasmy", "ci95_low", "ci95_high",
    "molecule_support", "strand_support", "strand_bias_delta", "allele_quality", "read_position", "supporting_reads",
)
EVIDENCE_READ = ("id", "flags", "mapping_quality")
GRAPH = {
    "molecules": ("id", "analysis_eligible"),
    "events": ("id", "type", "position", "start", "end", "ref", "alt", "absence_assessable"),
    "observations": ("molecule_id", "event_id", "state", "observed_allele"),
    "phase_links": ("event_a", "event_b", "both", "only_a", "only_b", "neither", "uncertain"),
}


def evidence_projection(variants: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    """What two runs of the plain schema are compared by."""
    return {"variants": projected(variants, list(EVIDENCE_VARIANT)), "reads": projected(reads, list(EVIDENCE_READ))}


def graph_projection(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What two runs of the evidence graph are compared by: each table's fields that don't depend on how it was stored."""
    return {name: projected(tables[name], list(fields)) for name, fields in GRAPH.items()}


def same(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> DataFrame:
    """section, only (first, second), n: rows that one run has and the other hasn't, whatever their order."""
    out = None
    for name, a in first.items():
        b = second[name]
        for side, x, y in (("first", a, b), ("second", b, a)):
            rows = x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.lit(side).alias("only"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out.where("n > 0")


def text_map(m: Column) -> Column:
    """A map as a JSON object, its keys in order."""
    entries = F.array_sort(F.map_entries(m))
    return F.to_json(F.map_from_entries(entries))


def clinical_struct(variants: DataFrame, assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Variants with annotation: the consensus and the assertions of their change as an array of structs; null without any."""
    fields = [c for c in assertions.columns if c not in keys]
    grouped = assertions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("assertions"))
    return variants.join(grouped, keys, "left").withColumn("annotation", F.when(F.col("assertions").isNotNull(), F.struct(F.size("assertions").alias("n"), "assertions"))).drop("assertions")


def annotated(variants: DataFrame) -> DataFrame:
    """Only variants with an annotation."""
    return variants.where("annotation is not null")


def first_reads(reads: DataFrame, cluster: str, order: list[str], keep: int, supports: DataFrame, calls: DataFrame, filtered: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A result cut down for showing: the first reads of each cluster, their supports, all passing calls and some filtered ones."""
    from annulus.operators.ordered import best_of_the_rest
    from annulus.operators.reports import first_of_each

    kept = first_of_each(reads, cluster, order, keep)
    return kept, supports.join(kept.select("read"), "read", "left_semi"), best_of_the_rest(calls, F.col("pass"), ["p", "position", "alt"], filtered)

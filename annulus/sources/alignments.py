"""SAM and FASTQ text as tables of reads; FASTA as a string or a table of positions.

Files are read by Spark's text source, so they may be split and lie in any
store. Records are numbered in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import text


def _numbered(lines: DataFrame, column: str) -> DataFrame:
    """Adds the row's number from 0: places within partitions plus the rows of earlier partitions."""
    placed = lines.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    dense = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1)
    return dense.join(starts, "_p").withColumn(column, F.col("_start") + F.col("_k")).drop("_p", "_i", "_n", "_first", "_start", "_k")


def _refuse(df: DataFrame, bad, what: str) -> DataFrame:
    """`df`, failing with E1103 when a row is reached for which `bad` holds."""
    message = F.concat(F.lit(f"E1103: {what}: "), F.coalesce(F.col("id"), F.lit("?")))
    return df.withColumn("id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message)).otherwise(F.col("id")))


def header_contigs(spark: SparkSession, path: str) -> list[str]:
    """Names of the `@SQ` lines at the head of SAM files, each once, sorted. A task reads no further than the first line that is none
    of the header, so that files are not read for it."""

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            lines = batch.column(0).to_pylist()
            head = next((i for i, x in enumerate(lines) if not x.startswith("@")), len(lines))
            fields = [f for x in lines[:head] if x.startswith("@SQ\t") for f in x.rstrip("\r").split("\t") if f.startswith("SN:")]
            yield pa.RecordBatch.from_arrays([pa.array([f[3:] for f in fields], pa.string())], ["name"])
            if head < len(lines):
                return

    rows = spark.read.text(path).mapInArrow(named, "name string").distinct()
    return sorted(r["name"] for r in rows.collect())  # the contigs of a genome


def nuclear(spark: SparkSession, names: list[str]) -> bool:
    """Whether one of the contigs is a nuclear one."""
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.where(text.nuclear_contig(F.col("name"))).limit(1).count() > 0


def require_budget(spent: dict, config) -> None:
    """Fail if what was charged (records, bases) while reading is more than the options allow."""
    for name, most in (("records", config.max_input_records), ("bases", config.max_input_bases)):
        if (spent.get(name) or 0) > most:
            raise AnalysisError("E1601", f"the input has {spent[name]} {name}, {most} are allowed")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """reads: record_index, id, flags, reference_name, reference_start (1-based, 0: none), mapping_quality, cigar,
    cigar_operations, sequence, qualities, aux_tags, supplementary_alignments, cost (what a record counts against the budget: its
    bases, a quarter of its text, or its reference span, whichever is most)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    field = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    at = lambda i: F.get(field, F.lit(i))
    raw = _numbered(lines, "record_index").select(
        "record_index",
        at(0).alias("id"),
        text.strict_unsigned(at(1)).alias("flags"),
        at(2).alias("reference_name"),
        text.strict_unsigned(at(3)).alias("reference_start"),
        text.strict_unsigned(at(4)).alias("mapping_quality"),
        at(5).alias("cigar"),
        at(9).alias("sequence"),
        at(10).alias("qualities"),
        F.slice(field, F.lit(12), F.greatest(F.size(field) - 11, F.lit(0))).alias("tags"),
        F.length("value").alias("line_length"),
    )
    has_bases = F.col("sequence") != "*"
    ops = text.cigar_operations(F.col("cigar"))
    bad = (
        F.col("qualities").isNull()
        | F.col("flags").isNull()
        | (F.col("flags") > 65535)
        | F.col("mapping_quality").isNull()
        | (F.col("mapping_quality") > 255)
        | F.col("reference_start").isNull()
        | ~text.cigar_is_valid(F.col("cigar"))
        | (has_bases & (F.col("qualities") != "*") & (F.length("sequence") != F.length("qualities")))
        | (has_bases & (F.col("cigar") != "*") & (text.query_span(ops) != F.length("sequence")))
    )
    checked = _refuse(raw, bad, "malformed alignment record")
    entry = "^([A-Za-z][A-Za-z0-9]):([A-Za-z]):(.*)$"
    sound = F.filter("tags", lambda t: F.regexp(t, F.lit(entry)))
    pairs = F.transform(sound, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_extract(t, entry, 3).alias("v")))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    out = checked.select(
        "record_index",
        "id",
        F.col("flags").cast("int").alias("flags"),
        "reference_name",
        F.col("reference_start").cast("int").alias("reference_start"),
        F.col("mapping_quality").cast("int").alias("mapping_quality"),
        "cigar",
        ops.alias("cigar_operations"),
        F.when(has_bases, F.upper("sequence")).otherwise("").alias("sequence"),
        F.when(F.col("qualities") != "*", F.col("qualities")).otherwise(F.repeat(F.lit("!"), F.when(has_bases, F.length("sequence")).otherwise(0))).alias("qualities"),
        F.map_from_entries(last).alias("aux_tags"),
        F.greatest(F.when(has_bases, F.length("sequence")).otherwise(0), F.ceil(F.col("line_length") / 4), text.reference_span(ops)).cast("long").alias("cost"),
    )
    return out.withColumn("supplementary_alignments", supplementary(F.try_element_at("aux_tags", F.lit("SA"))))


def supplementary(tag):
    """An SA tag's entries: (reference_name, position, strand, cigar, mapping_quality, edit_distance); others with 6 sound fields fail."""
    entries = F.filter(F.split(tag, ";"), lambda e: e != "")
    f = lambda e, i: F.get(F.split(e, ","), F.lit(i))

    def parsed(e):
        ok = (F.size(F.split(e, ",")) == 6) & F.regexp(e, F.lit("^[^,]+,[1-9][0-9]*,[+-],(?:[0-9]+[MIDNSHP=X])+,(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]),[0-9]+$"))
        return F.when(
            ok,
            F.struct(
                f(e, 0).alias("reference_name"),
                f(e, 1).cast("int").alias("position"),
                f(e, 2).alias("strand"),
                f(e, 3).alias("cigar"),
                f(e, 4).cast("int").alias("mapping_quality"),
                f(e, 5).cast("int").alias("edit_distance"),
            ),
        ).otherwise(F.raise_error(F.concat(F.lit("E1103: malformed supplementary alignment: "), e)))

    return F.coalesce(F.transform(entries, parsed), F.array().cast("array<struct<reference_name:string,position:int,strand:string,cigar:string,mapping_quality:int,edit_distance:int>>"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """record_index, id, header, sequence, qualities of 4-line records; blank lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where("line <> ''")
    numbered = _numbered(lines, "n").withColumn("record_index", F.expr("n div 4")).withColumn("k", F.expr("n % 4"))
    rows = numbered.groupBy("record_index").agg(*(F.max(F.when(F.col("k") == k, F.col("line"))).alias(c) for k, c in enumerate(("header", "sequence", "plus", "qualities"))))
    rows = rows.withColumn("id", F.regexp_extract("header", "^@([^ \t]+)", 1))
    bad = ~F.col("header").startswith("@") | ~F.col("plus").startswith("+") | (F.length("sequence") != F.length("qualities"))
    return _refuse(rows, bad, "malformed FASTQ record").select("record_index", "id", "header", F.upper("sequence").alias("sequence"), "qualities", F.length("sequence").cast("long").alias("cost"))


def read_reference(spark: SparkSession, path: str, length: int | None = None) -> str:
    """The one sequence of a FASTA file: a small file, read on the driver. `length` is what it must have: the genome that
    genes and lineages are told by has coords.L bases."""
    whole = spark.read.text(path, wholetext=True).first()
    lines = [x.strip() for x in (whole.value if whole else "").splitlines() if x.strip()]
    sequence = "".join(lines[1:]).upper()
    if not lines or not lines[0].startswith(">") or any(x.startswith(">") for x in lines[1:]) or not sequence or set(sequence) - set("ACGTN"):
        raise AnalysisError("E1202", f"{path} isn't one sequence of A, C, G, T and N")
    if length is not None and len(sequence) != length:
        raise AnalysisError("E1202", f"{path} has {len(sequence)} bases, {length} are needed")
    return sequence


def reference_table(spark: SparkSession, sequence: str) -> DataFrame:
    """position (from 1), ref."""
    one = spark.createDataFrame([(sequence,)], "s string")
    return one.select(F.posexplode(F.split("s", "")).alias("p", "ref")).select((F.col("p") + 1).cast("long").alias("position"), "ref")


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension; what has no decoder here is refused."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".sam"):
        return read_sam(spark, path)
    if name.endswith((".fastq", ".fq")):
        return read_fastq(spark, path)
    if name.endswith((".bam", ".cram")):
        from annulus.sources.bam import read_bam

        return read_bam(spark, path)  # CRAM is refused by its first bytes
    raise AnalysisError("E1102", path)


def contigs(spark: SparkSession, path: str) -> list[str]:
    """The contigs that the header of an alignment names; none of other files."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".sam"):
        return header_contigs(spark, path)
    if name.endswith(".bam"):
        from annulus.sources.bam import reference_names

        return sorted(set(reference_names(path)))
    return []


def numt_assessment(spark: SparkSession, path: str) -> dict:
    """Whether nuclear copies can be told apart: mode, nuclear_contigs_present, specificity_assessable, provenance_status and
    provenance_reason, from the header's contigs and the manifest beside the file."""
    from annulus.sources.tables import numt_provenance

    aligned = path.lower().removesuffix(".gz").endswith((".sam", ".bam"))
    present = aligned and nuclear(spark, contigs(spark, path))
    status, sure, reason = numt_provenance(spark, path, present, aligned)
    mode = "competitive_alignment" if sure else "mt_only_or_unknown" if aligned else "unaligned_fastq"
    return {"mode": mode, "nuclear_contigs_present": present, "specificity_assessable": sure, "provenance_status": status, "provenance_reason": reason}

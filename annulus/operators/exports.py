"""Text forms of results: VCF and TSV lines, evidence pages, a manifest of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import coords, text

VCF_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def _six(x: Column) -> Column:
    return F.format_string("%.6f", x)


def vcf_lines(variants: DataFrame, contig: str = "NC_012920.1") -> DataFrame:
    """position, ref, alt, line: one VCF record for each of (position, ref, alt, support, callable, level, ci_low, ci_high,
    gene, significance, sources), where gene, significance and sources may be null."""
    optional = lambda name, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{name}="), text.vcf_token(F.col(c))))
    info = F.concat_ws(
        ";",
        F.concat(F.lit("AC="), F.col("support").cast("string")),
        F.concat(F.lit("DP="), F.col("callable").cast("string")),
        F.concat(F.lit("HF="), _six(F.col("level"))),
        optional("GENE", "gene"),
        optional("CLNSIG", "significance"),
        F.when(F.size("sources") > 0, F.concat(F.lit("CLNSRC="), F.array_join(F.transform("sources", text.vcf_token), ","))),
        F.concat(F.lit("HF_CI95="), _six(F.col("ci_low")), F.lit(","), _six(F.col("ci_high"))),
    )
    call = F.concat(F.when(F.col("level") >= 1, "1/1").otherwise("0/1"), F.lit(":"), _six(F.col("level")))
    line = F.concat_ws("\t", F.lit(contig), F.col("position").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info, F.lit("GT:HF"), call)
    return variants.select("position", "ref", "alt", line.alias("line"))


def vcf_header(sample: str, contig: str = "NC_012920.1", length: int = coords.L) -> list[str]:
    return ["##fileformat=VCFv4.3", f"##contig=<ID={contig},length={length}>", "\t".join([*VCF_COLUMNS, sample])]


def write_vcf(variants: DataFrame, path: str, sample: str) -> None:
    """Header and records in order of position, ref and alt as text files; Spark's commit makes them appear at once."""
    spark = variants.sparkSession
    head = spark.createDataFrame([(0, i, "", "", x) for i, x in enumerate(vcf_header(sample))], "part int, position long, ref string, alt string, line string")
    body = vcf_lines(variants).select(F.lit(1).alias("part"), F.col("position").cast("long").alias("position"), "ref", "alt", "line")
    head.unionByName(body).orderBy("part", "position", "ref", "alt").select("line").write.text(path)


def tsv_lines(df: DataFrame, decimals: int = 8) -> DataFrame:
    """line: the columns with tabs between, doubles with fixed decimals, nulls empty, no tab or line end inside a field."""
    kinds = dict(df.dtypes)
    field = lambda c: F.format_string(f"%.{decimals}f", F.col(c)) if kinds[c] == "double" else text.clean_field(F.col(c).cast("string"))
    return df.select(F.concat_ws("\t", *(F.coalesce(F.when(F.col(c).isNotNull(), field(c)), F.lit("")) for c in df.columns)).alias("line"))


def pages(observations: DataFrame, index: str, size: int = 4096) -> DataFrame:
    """page, first, n, columns: rows by page as parallel arrays, in order of the index."""
    others = [c for c in observations.columns if c != index]
    rows = observations.groupBy(F.floor(F.col(index) / size).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct(index, *others))).alias("rows"))
    arrays = F.struct(*(F.col("rows")[c].alias(c) for c in [index, *others]))
    return rows.select("page", F.get("rows", F.lit(0))[index].alias("first"), F.size("rows").cast("long").alias("n"), arrays.alias("columns"))


def unpaged(paged: DataFrame, names: list[str]) -> DataFrame:
    """The rows of pages again."""
    zipped = paged.select(F.explode(F.arrays_zip(*(F.col("columns")[c].alias(c) for c in names))).alias("r"))
    return zipped.select(*(F.col("r")[c].alias(c) for c in names))


def digests(spark, paths: list[str]) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def evidence_vcf_lines(variants: DataFrame, contig: str = "NC_012920.1") -> DataFrame:
    """position, ref, alt, line of variants in the evidence dialect, which carries counts by state, strand and quality:
    vcf_position, ref, alt, event, type, support, reference, other, callable, low_quality, conflict, mapping_quality,
    base_quality, strands (array of four or null), numt, flags, normalization, ci_low, ci_high, gene, significance,
    conflicting, sources, representable. A variant over the origin has no linear form: that is an error."""
    lost = variants.where("not representable").select("event").limit(1).collect()
    if lost:
        raise AnalysisError("E1302", f"variant {lost[0].event} crosses the circular origin and has no lossless linear form; use the table or the document")
    number = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    token = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), text.vcf_token(F.col(c))))
    four = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.format_string("%.4f", F.col(c))))
    tokens = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), F.array_join(F.transform(c, text.vcf_token), ",")))
    level = F.when(F.col("callable") > 0, F.col("support") / F.col("callable")).otherwise(0.0)
    both = F.concat_ws(",", F.col("reference").cast("string"), F.col("support").cast("string"))
    info = F.concat_ws(
        ";",
        number("AC", "support"),
        number("DP", "callable"),
        F.concat(F.lit("HF="), _six(level)),
        F.concat(F.lit("AD="), both),
        number("ODC", "other"),
        number("LOWQ", "low_quality"),
        number("CONFLICT", "conflict"),
        number("MOLECULE_SUPPORT", "support"),
        four("MQ", "mapping_quality"),
        four("BQ", "base_quality"),
        F.when(F.size("strands") == 4, F.concat(F.lit("STRAND_SUPPORT="), F.array_join(F.transform("strands", lambda x: x.cast("string")), ","))),
        token("NUMT_ASSESSABLE", "numt"),
        tokens("QC_FLAGS", "flags"),
        token("NORMALIZATION", "normalization"),
        token("GENE", "gene"),
        token("CLNSIG", "significance"),
        F.when(F.col("conflicting"), "CLNCONFLICT"),
        tokens("CLNSRC", "sources"),
        F.when(F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull(), F.concat(F.lit("HF_CI95="), _six(F.col("ci_low")), F.lit(","), _six(F.col("ci_high")))),
        token("EVENT_TYPE", "type"),
    )
    name = F.coalesce(text.vcf_token(F.col("event")), F.lit("."))
    call = F.concat_ws(":", F.lit("."), F.col("callable").cast("string"), both, _six(level))
    line = F.concat_ws("\t", F.lit(contig), F.col("vcf_position").cast("string"), name, text.vcf_token(F.col("ref")), text.vcf_token(F.col("alt")), F.lit("."), F.lit("."), info, F.lit("GT:DP:AD:HF"), call)
    sound = variants.where("ref <> '' and alt <> '' and callable > 0")
    return sound.select(F.col("vcf_position").alias("position"), "ref", "alt", line.alias("line"))


# The columns of the table of variants, and how their numbers are written.
VARIANT_TABLE = (
    "event_id", "type", "position", "start", "end", "ref", "alt", "alt_molecules", "ref_molecules", "other_molecules", "callable_molecules",
    "heteroplasmy", "ci95_low", "ci95_high", "alt_forward", "alt_reverse", "ref_forward", "ref_reverse", "alt_mean_mapq", "alt_mean_baseq",
    "multi_allelic", "homopolymer_run", "numt_assessability", "filter_status", "qc_flags", "supporting_molecule_ids", "gene", "consequence", "clinical_significance",
)
DECIMALS = {"heteroplasmy": 8, "ci95_low": 8, "ci95_high": 8, "alt_mean_mapq": 4, "alt_mean_baseq": 4}


def variant_table(variants: DataFrame) -> DataFrame:
    """VARIANT_TABLE as strings: missing columns and nulls empty, lists joined by semicolons, no tab or line end inside a field."""
    kinds = dict(variants.dtypes)

    def field(name: str) -> Column:
        if name not in kinds:
            if name == "event_id":
                return F.concat_ws(":", F.lit("legacy"), F.col("position").cast("string"), "ref", "alt")
            return F.lit("SNV") if name == "type" else F.lit("")
        if name in DECIMALS:
            value = F.format_string(f"%.{DECIMALS[name]}f", F.col(name).cast("double"))
        elif kinds[name].startswith("array"):
            value = F.array_join(F.transform(name, lambda x: text.clean_field(x.cast("string"))), ";")
        else:
            value = text.clean_field(F.col(name).cast("string"))
        return F.coalesce(F.when(F.col(name).isNotNull(), value), F.lit(""))

    return variants.select(*(field(c).alias(c) for c in VARIANT_TABLE))


def write_variant_table(variants: DataFrame, path: str) -> None:
    """The table with its header, tab-separated, in order of position, ref and alt."""
    rows = variant_table(variants).orderBy(F.col("position").cast("long"), "ref", "alt")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_pages(observations: DataFrame, index: str, path: str, size: int = 4096) -> DataFrame:
    """Pages as JSON lines, a folder for each page, and the manifest: page, first, n, sha256 of its line."""
    lines = pages(observations, index, size).withColumn("line", F.to_json(F.struct("page", "first", "n", "columns")))
    lines.select("page", "line").repartition("page").write.partitionBy("page").text(path)
    spark = observations.sparkSession
    back = spark.read.text(path).select(F.col("page").cast("long").alias("page"), F.col("value").alias("line"))
    parsed = F.from_json("line", "first long, n long")
    manifest = back.select("page", parsed["first"].alias("first"), parsed["n"].alias("n"), F.sha2("line", 256).alias("sha256"))
    manifest.write.parquet(f"{path}-manifest")
    return spark.read.parquet(f"{path}-manifest")


def page_at(paged: DataFrame, page: int) -> DataFrame:
    """One page, by its number."""
    return paged.where(F.col("page") == page)


def noncontiguous(paged: DataFrame, size: int) -> DataFrame:
    """Pages that aren't full, but for the last, or don't start where the one before ends, or whose columns differ in length."""
    last = paged.agg(F.max("page").alias("_last"))
    names = paged.schema["columns"].dataType.names
    uneven = F.lit(False)
    for c in names:
        uneven = uneven | (F.size(F.col("columns")[c]) != F.col("n"))
    odd = ((F.col("page") < F.col("_last")) & (F.col("n") != size)) | (F.col("n") > size) | (F.col("first") != F.col("page") * size) | uneven
    return paged.crossJoin(F.broadcast(last)).where(odd).select(F.col("page").cast("string").alias("what"), F.lit("not contiguous").alias("rule"))

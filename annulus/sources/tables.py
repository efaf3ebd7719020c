"""Resource tables as text: profiles, callers' tables, clinical summaries, manifests, model catalogues, difference strings.

All are read with Spark's text and CSV readers, whatever store they are in. A
table that breaks its rules raises an error that names them; the checks are
aggregates, so nothing is read row by row on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import coords, text
from annulus.operators.comparison import is_allele

COMPARATOR = ("ID", "Filter", "Pos", "Ref", "Variant", "VariantLevel", "MajorBase", "MajorLevel", "MinorBase", "MinorLevel", "Coverage", "CoverageFWD", "CoverageREV", "Type", "Mutation")  # fixed values
MANIFEST = ("name", "version", "path", "sha256", "source", "license", "retrieved")  # fixed values


def _require(df: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    """`df`, once every rule holds for each of its rows; null counts as broken."""
    broken = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items())).first().asDict()
    if found := [f"{name} ({n})" for name, n in broken.items() if n]:
        raise AnalysisError("E1302", f"{what}: rows that break a rule: " + ", ".join(found))
    return df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the file's lines that aren't blank, without carriage returns."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.where(F.trim("line") != "")


def profile_marker(raw: Column) -> Column:
    """A profile's marker: `PDEL` in any case as `Pd`, if the position is on the genome; null if it isn't a marker."""
    m = F.trim(raw)
    place = F.regexp_extract(m, "(?i)^([0-9]+)DEL$", 1).try_cast("long")
    gone = F.length(m) > 3
    deletion = F.when((place > 0) & (place <= coords.L), F.concat(place.cast("string"), F.lit("d")))
    return F.when(gone & F.regexp(m, F.lit("(?i)DEL$")), deletion).when((m != "") & ~F.regexp(m, F.lit(r"\s")), m)


def profile_ranges(raw: Column, length: int = coords.L) -> Column:
    """Array of (start, end) of `S-E;S;...`, sorted and distinct; a range over the origin is two; null where an item is no range."""
    items = F.filter(F.transform(F.split(F.regexp_replace(raw, r'^\s*"*|"*\s*$', ""), ";"), lambda x: F.regexp_replace(x, r"\s", "")), lambda x: x != "")

    # Each value is an argument of the next function: what is only named in a function's body is computed at each use.
    def ends(x):
        parts = F.split(x, "-")
        return F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("start"), F.get(parts, F.size(parts) - 1).try_cast("long").alias("end"))

    def spans(x):
        fits = x["start"].between(1, length) & x["end"].between(1, length)
        return F.when(fits, coords.spans(x["start"], x["end"], length))

    parsed = F.transform(items, lambda x: F.when(F.regexp(x, F.lit("^[0-9]+(-[0-9]+)?$")), ends(x)))
    found = F.filter(F.array(F.transform(parsed, spans)), lambda s: (F.size(s) > 0) & F.forall(s, lambda x: x.isNotNull()))
    return F.get(F.transform(found, lambda s: F.array_sort(F.array_distinct(F.flatten(s)))), F.lit(0))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """sample, ranges (array of start, end), markers (array): tab-separated sample, ranges, metadata, markers."""
    fields = F.split("line", "\t", -1)
    rows = _lines(spark, path).select(fields.alias("f")).select(
        F.trim(F.get("f", F.lit(0))).alias("sample"),
        profile_ranges(F.get("f", F.lit(1))).alias("ranges"),
        F.transform(F.filter(F.expr("slice(f, 4, greatest(size(f) - 3, 0))"), lambda x: F.trim(x) != ""), profile_marker).alias("markers"),
        F.size("f").alias("n"),
    )
    marks = F.col("markers")
    rules = {
        "four columns": F.col("n") >= 4,
        "sample": F.regexp("sample", F.lit(r"^\S+$")),
        "ranges": F.col("ranges").isNotNull(),
        "markers": (F.size(marks) > 0) & F.forall(marks, lambda x: x.isNotNull()),
        "no marker twice": F.size(F.array_distinct(marks)) == F.size(marks),
    }
    out = _require(rows, rules, path).select("sample", "ranges", "markers")
    if out.isEmpty():
        raise AnalysisError("E1302", f"{path}: no profiles")
    if not out.groupBy("sample").count().where("count > 1").isEmpty():
        raise AnalysisError("E1302", f"{path}: a sample has two profiles")
    return out


def read_comparator(spark: SparkSession, path: str) -> DataFrame:
    """sample, filter, position, ref, alt, level, coverage, forward, reverse, mutation of another caller's table, by column name."""
    table = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if missing := [c for c in COMPARATOR if c not in table.columns]:
        raise AnalysisError("E1302", f"{path}: no column {', '.join(missing)}")
    rows = table.select(*(F.trim(c).alias(c) for c in COMPARATOR))
    count = {c: text.strict_unsigned(F.col(c)) for c in ("Pos", "Coverage", "CoverageFWD", "CoverageREV")}
    share = {c: F.col(c).try_cast("double") for c in ("VariantLevel", "MajorLevel", "MinorLevel")}
    rules = {c: v.isNotNull() for c, v in count.items()} | {c: v.between(0, 1) for c, v in share.items()}
    rules |= {c: is_allele(F.upper(F.col(c))) for c in ("Ref", "Variant", "MajorBase", "MinorBase")}
    rules |= {c: F.col(c) != "" for c in ("ID", "Filter", "Type", "Mutation")}
    rules["position on the genome"] = count["Pos"].between(1, coords.L)
    rules["both strands make the coverage"] = (count["CoverageFWD"] + count["CoverageREV"] == count["Coverage"]) & (count["Coverage"] > 0)
    return _require(rows, rules, path).select(
        F.col("ID").alias("sample"),
        F.col("Filter").alias("filter"),
        count["Pos"].alias("position"),
        F.upper("Ref").alias("ref"),
        F.upper("Variant").alias("alt"),
        share["VariantLevel"].alias("level"),
        count["Coverage"].alias("coverage"),
        count["CoverageFWD"].alias("forward"),
        count["CoverageREV"].alias("reverse"),
        F.col("Mutation").alias("mutation"),
    )


def result_variants(result: DataFrame) -> DataFrame:
    """event, position, ref, alt, level, callable, alternate, filter: the variants of result documents (an array of structs)."""
    rows = result.select(F.explode("variants").alias("v")).select(
        F.col("v.event_id").alias("event"),
        F.col("v.position").cast("long").alias("position"),
        F.upper("v.ref").alias("ref"),
        F.upper("v.alt").alias("alt"),
        F.col("v.heteroplasmy").cast("double").alias("level"),
        F.col("v.callable_depth").cast("long").alias("callable"),
        F.col("v.alt_depth").cast("long").alias("alternate"),
        F.col("v.filter_status").alias("filter"),
    )
    return _require(rows, {"level": F.col("level").between(0, 1), "names": F.col("event").isNotNull() & F.col("ref").isNotNull() & F.col("alt").isNotNull()}, "result")


#: Columns of a table of clinical assertions.
ASSERTION = (
    "position", "ref", "alt", "gene", "consequence", "codon", "amino_acid", "haplogroup", "frequency", "score", "pathogenicity", "source", "accession",
    "allele_id", "condition", "significance", "review_status", "last_evaluated", "url", "evidence", "release", "retrieved",
)


def clinical_summary(table: DataFrame, retrieved: int) -> DataFrame:
    """ASSERTION columns of a summary of variants (columns by name): one-base changes of the mitochondrial contig on the current assembly."""
    value = lambda c: text.clean_field(F.coalesce(F.col(c), F.lit(""))) if c in table.columns else F.lit("")
    one = lambda c: (F.length(value(c)) == 1) & (value(c) != "na")
    wanted = (value("Assembly") == "GRCh38") & value("Chromosome").isin("MT", "M") & (value("PositionVCF") != "")
    rows = table.where(wanted & one("ReferenceAlleleVCF") & one("AlternateAlleleVCF"))
    number = value("VariationID")
    url = F.when(F.regexp(number, F.lit("^[0-9]+$")), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/clinvar/variation/"), number, F.lit("/"))).otherwise("")
    accession = F.replace(value("RCVaccession"), F.lit("|"), F.lit(";"))
    given = {
        "position": value("PositionVCF"),
        "ref": value("ReferenceAlleleVCF"),
        "alt": value("AlternateAlleleVCF"),
        "gene": value("GeneSymbol"),
        "source": F.lit("ClinVar"),
        "accession": accession,
        "allele_id": value("AlleleID"),
        "condition": value("PhenotypeList"),
        "significance": value("ClinicalSignificance"),
        "review_status": value("ReviewStatus"),
        "last_evaluated": value("LastEvaluated"),
        "url": url,
        "evidence": accession,
        "release": F.lit("clinvar-variant-summary-grch38"),
        "retrieved": F.lit(f"unix:{retrieved}"),
    }
    return rows.select(*(given.get(c, F.lit("")).alias(c) for c in ASSERTION))


def read_clinical_summary(spark: SparkSession, path: str, retrieved: int, curated: DataFrame | None = None) -> DataFrame:
    """`clinical_summary` of a tab-separated file (gzip is read by its name), with curated rows behind it."""
    table = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    table = table.withColumnRenamed("#" + table.columns[0].lstrip("#"), table.columns[0].lstrip("#"))
    found = clinical_summary(table, retrieved)
    return found if curated is None else found.unionByName(curated.select(*ASSERTION))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST columns of a tab-separated list of resources with a header; seven fields in every row, one row at least."""
    fields = F.split("value", "\t", -1)
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")
    first = lines.withColumn("_n", F.monotonically_increasing_id()).orderBy("_n").limit(1).drop("_n").first()
    rows = lines.where(F.col("value") != (first.value if first else "")).select(fields.alias("f"))
    if rows.isEmpty():
        raise AnalysisError("E1302", f"{path}: no resources")
    return _require(rows, {"seven fields": F.size("f") == 7}, path).select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(MANIFEST)))


def overridden(manifest: DataFrame, name: str, path: str) -> DataFrame:
    """The manifest with one resource replaced by an outside file, which nothing is known about."""
    mine = F.col("name") == name
    if manifest.where(mine).isEmpty():
        raise AnalysisError("E1302", f"the manifest has no {name}")
    new = {"version": "external-unpinned", "path": path, "sha256": "not-verified", "source": "override", "license": "not-recorded", "retrieved": "not-recorded"}
    return manifest.select(*(F.when(mine, F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in MANIFEST))


def read_fields(spark: SparkSession, path: str) -> DataFrame | None:
    """field, value of a two-column file under the header `field<TAB>value`; None if a field stands twice or a row has another shape."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    parts = F.split("value", "\t", -1)
    head = F.min_by("value", "n").alias("head")
    other = F.row_number().over(Window.orderBy("n")) > 1  # a manifest of a few lines
    body = rows.withColumn("_other", other).where("_other").select(parts.alias("f"))
    sound = F.count_if((F.size("f") != 2) | (F.get("f", F.lit(0)) == "")) == 0
    once = F.count("*") == F.countDistinct(F.get("f", F.lit(0)))
    if rows.agg(head).first().head != "field\tvalue" or not body.agg((sound & once).alias("ok")).first().ok:
        return None
    return body.select(F.get("f", F.lit(0)).alias("field"), F.get("f", F.lit(1)).alias("value"))


def digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of files in any store Spark reads, by path as given."""
    out = {}
    for p in paths:  # a chain of five files
        row = spark.read.format("binaryFile").load(p).select(F.sha2("content", 256).alias("d")).first()
        out[p] = row.d if row else ""
    return out


def competitive_reference_is_sound(spark: SparkSession, manifest: str, digest: str, index: str, index_digest: str) -> bool:
    """Whether a reference's manifest and index have the stated digests and name each other."""
    fields = read_fields(spark, manifest)
    have = {r.field: r.value for r in fields.collect()} if fields is not None else {}
    is_digest = lambda x: len(x or "") == 64 and all(c in "0123456789abcdefABCDEF" for c in x)
    named = [have.get(k) for k in ("nuclear_fasta_sha256", "mitochondrial_fasta_sha256", "reference_index_sha256")]
    if have.get("schema_version") != "competitive-reference-1.0" or not all(map(is_digest, [*named, digest, index_digest])):
        return False
    if have.get("reference_index_path") != index or named[2].lower() != index_digest.lower():
        return False
    found = digests(spark, [manifest, index])
    return found[manifest] == digest.lower() and found[index] == index_digest.lower()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: The statuses and reasons of numt_provenance are fixed values: a result shows them as they are.
def numt_provenance(spark: SparkSession, alignment: str, nuclear_contigs: bool, is_alignment: bool = True) -> tuple[str, bool, str]:
    """(status, assessable, reason): whether nuclear copies competed for the reads of an alignment, by the chain of digests in
    the manifest beside it."""
    if not is_alignment:
        return "NOT_APPLICABLE", False, "input is not an alignment"
    if not nuclear_contigs:
        return "NOT_VERIFIED", False, "alignment header has no nuclear contigs"
    folder = alignment.rsplit("/", 1)[0]
    manifest = f"{folder}/competitive-mapping-manifest.tsv"
    fields = read_fields(spark, manifest) if exists(spark, manifest) else None
    if fields is None:
        return "NOT_VERIFIED", False, "competitive mapping manifest is absent or malformed"
    have = {r.field: r.value for r in fields.collect()}
    needed = ("output_bam_sha256", "output_bai_sha256", "reference_manifest_path", "reference_manifest_sha256", "reference_index_path", "reference_index_sha256")
    fits = have.get("schema_version") == "competitive-mapping-1.1" and have.get("numt_assessability") == "ASSESSABLE_BY_VERSIONED_COMPETITIVE_ALIGNMENT_INPUT"
    if not fits or any(k not in have for k in needed) or not alignment.endswith("/competitive.bam"):
        return "NOT_VERIFIED", False, "competitive mapping manifest does not match the input contract"
    found = digests(spark, [alignment, alignment + ".bai"])
    if found[alignment] != have["output_bam_sha256"].lower() or found[alignment + ".bai"] != have["output_bai_sha256"].lower():
        return "NOT_VERIFIED", False, "competitive mapping artifact checksum does not match its manifest"
    if not competitive_reference_is_sound(spark, have["reference_manifest_path"], have["reference_manifest_sha256"], have["reference_index_path"], have["reference_index_sha256"]):
        return "NOT_VERIFIED", False, "competitive reference provenance cannot be verified"
    return "VERIFIED", True, "versioned competitive mapping and reference checksums verified"


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """gene, model, chain, complex, first, last, differs (array of residues), a row for each modelled range: eight tab-separated
    columns under a header; ranges `S-E,S`, differences such as A52T."""
    table = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if len(table.columns) != 8:
        raise AnalysisError("E1302", f"{path}: eight columns are needed")
    c = table.columns
    number = lambda x: F.regexp_extract(x, "^.([0-9]+).$", 1).try_cast("int")
    changes = F.filter(F.split(F.coalesce(F.col(c[7]), F.lit("")), ","), lambda x: x != "")
    rows = table.select(F.col(c[0]).alias("gene"), F.col(c[2]).alias("model"), F.col(c[3]).alias("chain"), F.col(c[4]).alias("complex"), F.transform(changes, number).alias("differs"), F.explode(F.split(c[6], ",")).alias("range"))
    first = F.regexp_extract("range", "^([0-9]+)(?:-[0-9]+)?$", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract("range", "^[0-9]+-([0-9]+)$", 1).try_cast("int"), first)
    rows = rows.withColumn("first", first).withColumn("last", last)
    rules = {"ranges": F.col("first") <= F.col("last"), "differences": F.forall("differs", lambda x: x.isNotNull())}
    return _require(rows, rules, path).select("gene", "model", "chain", "complex", "first", "last", "differs")


#: Items whose sizes are summed together.
_BLOCK = 64
_CS = "(=[A-Za-z]+|[*][a-z][a-z]|[+][a-z]+|-[a-z]+)"


def difference_edits(df: DataFrame, cs: str = "cs", start: str = "start") -> DataFrame:
    """The columns of `df` with position, deleted (bases), inserted for each edit of a long difference string that starts at
    `start`; unknown bases are no edits, but take their places."""
    parts = F.regexp_extract_all(F.col(cs), F.lit(_CS), F.lit(1))
    size = lambda x: F.when(F.startswith(x, F.lit("*")), 1).when(F.startswith(x, F.lit("+")), 0).otherwise(F.length(x) - 1)
    own = [*df.columns]
    table = df.withColumn("_parts", parts).withColumn("_sizes", F.transform("_parts", size))
    # Offsets in blocks: sums of blocks before, and of a block's own items before, so that a long string costs in proportion to its edits.
    total = lambda items, at, n: F.aggregate(F.slice(items, at, n), F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / _BLOCK)), lambda b: total("_sizes", (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))
    table = table.where(F.size("_parts") > 0).withColumn("_blocks", blocks)
    table = table.withColumn("_starts", F.transform("_blocks", lambda _, i: total("_blocks", F.lit(1), i)))
    place = lambda i: F.floor(i / _BLOCK).cast("int")
    before = F.transform("_sizes", lambda _, i: F.get("_starts", place(i)) + total("_sizes", place(i) * _BLOCK + 1, i - place(i) * _BLOCK))
    rows = table.select(*own, F.explode(F.arrays_zip(F.col("_parts").alias("op"), before.alias("before"))).alias("_x"))
    op, known = F.col("_x.op"), lambda c: ~F.regexp(c, F.lit("n"))
    changed = F.startswith(op, F.lit("*")) & known(op)
    added = F.startswith(op, F.lit("+"))
    gone = F.startswith(op, F.lit("-")) & ~F.regexp(op, F.lit("^-n+$"))
    edits = rows.where(changed | added | gone)
    deleted = F.when(F.startswith(op, F.lit("*")), 1).when(added, 0).otherwise(F.length(op) - 1)
    inserted = F.when(F.startswith(op, F.lit("*")), F.upper(F.substring(op, 3, 1))).when(added, F.upper(F.expr("substring(_x.op, 2)"))).otherwise("")
    return edits.select(*df.columns, (F.col(start) + F.col("_x.before")).cast("long").alias("position"), deleted.cast("int").alias("deleted"), inserted.alias("inserted"))

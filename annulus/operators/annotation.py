"""Effects of changes on genes: codons, RNA genes, regions, deletions and what they fuse.

A substitution meets its gene by position: the genes' codons are a table of one
row for each position of a gene, built from the reference and as long as the
genome, so that the join is an equi-join whatever the number of changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions import coords, genome
from annulus.operators import intervals

# Regions of the circular reference.
HEAVY_ORIGIN, LIGHT_ORIGIN = (110, 441), (5721, 5798)
CONTROL_START, CONTROL_END = 16024, 576
MAJOR_ARC = (5799, 16569)
CONTACT_LEFT, CONTACT_RIGHT = (6000, 9000), (13000, 16000)

_COMPLEMENT = dict(zip("ACGTN", "TGCAN"))


def in_control_region(position: Column) -> Column:
    return (position >= CONTROL_START) | (position <= CONTROL_END)


def region_effect(position: Column) -> tuple[Column, Column, Column]:
    """gene, biotype, consequence of a change outside all genes."""
    control = in_control_region(position)
    name = lambda a, b: F.when(control, a).otherwise(b)
    return F.when(control, "MT-CR"), name("control_region", "intergenic"), name("control_region_variant", "intergenic_variant")


def rna_consequence(biotype: Column) -> Column:
    return F.when(biotype == "tRNA", "tRNA_variant").otherwise("rRNA_variant")


def codons(spark: SparkSession, reference: str) -> DataFrame:
    """gene, position, strand, biotype, codon (its index from 0), phase, bases: a row for each position of each gene; a last
    codon cut short is completed with A, on the coding strand."""
    rows = []
    for gene, start, end, strand, biotype in genome.GENES:
        coding = reference[start - 1 : end]
        if strand == "-":
            coding = "".join(_COMPLEMENT.get(b, "N") for b in reversed(coding))
        coding += "AA"
        for position in range(start, end + 1):
            offset = position - start if strand == "+" else end - position
            codon, phase = divmod(offset, 3)
            rows.append((gene, position, strand, biotype, codon, phase, coding[3 * codon : 3 * codon + 3]))
    return spark.createDataFrame(rows, "gene string, position long, strand string, biotype string, codon long, phase int, bases string")


def grantham(a: Column, b: Column) -> Column:
    """Grantham's distance of two amino acids; null where one isn't one of the twenty."""

    def property_(i: int, code: Column) -> Column:
        table = F.create_map(*(F.lit(x) for k, v in genome.AMINO_ACIDS.items() for x in (k, v[i])))
        return F.try_element_at(table, code)

    squares = [F.pow(property_(i, a) - property_(i, b), F.lit(2.0)) * F.lit(w) for i, w in enumerate((1.833, 0.1018, 0.000399))]
    return F.floor(F.lit(50.723) * F.sqrt(squares[0] + squares[1] + squares[2]) + 0.5).cast("long")


def grantham_band(distance: Column) -> Column:
    """conservative up to 50, moderately conservative up to 100, moderately radical up to 150, radical."""
    out = F.when(distance <= 50, "conservative").when(distance <= 100, "moderately conservative")
    return out.when(distance <= 150, "moderately radical").when(distance.isNotNull(), "radical")


def protein_change(change: Column) -> Column:
    """(kind, position, ref, alt) of a protein change's name, the amino acids with three letters; null if it isn't one."""
    pattern = r"^p\.\(?([A-Z][a-z]{2})([0-9]+)([A-Za-z]{3}|=|\?|fs|del|ins)?"
    plain = F.trim(change)
    part = lambda i: F.regexp_extract(plain, pattern, i)
    ref, end, known = part(1), part(3), F.array(*(F.lit(v[3]) for v in genome.AMINO_ACIDS.values()))
    more = F.length(plain) > F.length(part(0))
    kind = F.when(ref == "Ter", "stop_lost").when(end == "=", "synonymous").when(end == "?", "start_lost").when(end == "Ter", "nonsense")
    kind = kind.when(end == "fs", "frameshift").when(end.isin("del", "ins"), "inframe").when(more, "other")
    kind = kind.when(F.array_contains(known, end), "missense").otherwise("other")
    alt = F.when(kind == "synonymous", ref).when(kind.isin("missense", "stop_lost") & F.array_contains(known, end), end)
    position = part(2).try_cast("long")
    fields = F.struct(kind.alias("kind"), position.alias("position"), F.when(ref != "Ter", ref).alias("ref"), alt.alias("alt"))
    return F.when(F.regexp(plain, F.lit(pattern)) & (position > 0), fields)


def residue_matches(expected: Column, found: Column) -> Column:
    """Whether a model's residue (three letters, any case) is the expected one; methionine may be modelled in its formylated
    or selenium form."""
    want, have = F.upper(expected), F.upper(found)
    return F.when(want == "MET", have.isin("MET", "FME", "MSE")).otherwise(F.coalesce(want == have, F.lit(False)))


def _named(effect: DataFrame, keys: list[str]) -> DataFrame:
    columns = ("gene", "biotype", "consequence", "residue", "codon_change", "ref_aa", "alt_aa", "hgvs_protein", "grantham")
    kinds = {"residue": "long", "grantham": "long"}
    return effect.select(*keys, *(F.col(c) if c in effect.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns))


def _regional(changes: DataFrame, met: DataFrame, keys: list[str]) -> DataFrame:
    gene, biotype, consequence = region_effect(F.col("position"))
    alone = changes.join(met.select(*keys).distinct(), keys, "left_anti")
    return _named(alone.select(*keys, gene.alias("gene"), biotype.alias("biotype"), consequence.alias("consequence")), keys)


def substitution_effects(changes: DataFrame, reference: str) -> DataFrame:
    """An effect of each change (position, alt) on each gene over it, or on its region."""
    keys = ["position", "alt"]
    changes = changes.select(*keys).distinct()
    table = codons(changes.sparkSession, reference)
    rows = changes.join(F.broadcast(table), "position")  # a row for each position of a gene
    other = F.when(F.col("strand") == "+", F.col("alt")).otherwise(F.translate("alt", "ACGT", "TGCA"))
    rows = rows.withColumn("changed", F.overlay("bases", other, F.col("phase") + 1, F.lit(1)))
    first = F.col("codon") == 0
    own, new = genome.translate_codon(F.col("bases")), genome.translate_codon(F.col("changed"))
    rows = rows.withColumn("ref_aa", F.when(first, "M").otherwise(own))
    rows = rows.withColumn("alt_aa", F.when(first & F.col("changed").isin(*genome.START_CODONS), "M").otherwise(new))
    a, b, n = F.col("ref_aa"), F.col("alt_aa"), (F.col("codon") + 1).cast("string")
    coding = F.col("biotype") == "protein_coding"
    p = lambda *parts: F.concat(F.lit("p."), *parts)
    kinds = [
        (first & (b == "M"), "start_retained_variant", F.lit("p.Met1=")),
        (first, "start_lost", F.lit("p.Met1?")),
        ((a == b) & (a == "*"), "stop_retained_variant", p(genome.three_letter(a), n, F.lit("="))),
        (a == b, "synonymous_variant", p(genome.three_letter(a), n, F.lit("="))),
        (b == "*", "stop_gained", p(genome.three_letter(a), n, F.lit("Ter"))),
        (a == "*", "stop_lost", p(F.lit("Ter"), n, genome.three_letter(b), F.lit("extTer?"))),
        (F.lit(True), "missense_variant", p(genome.three_letter(a), n, genome.three_letter(b))),
    ]
    consequence, name = F.when(~coding, rna_consequence(F.col("biotype"))), F.when(~coding, F.lit(None).cast("string"))
    for test, kind, hgvs in kinds:
        consequence, name = consequence.when(test, kind), name.when(test, hgvs)
    only = lambda c: F.when(coding, c)
    missense = F.col("consequence") == "missense_variant"
    met = rows.withColumn("consequence", consequence).withColumn("hgvs_protein", name)
    met = met.withColumn("grantham", F.when(missense, grantham(a, b))).withColumn("residue", only(F.col("codon") + 1))
    met = met.withColumn("codon_change", only(F.concat_ws(">", "bases", "changed"))).withColumn("ref_aa", only(a)).withColumn("alt_aa", only(b))
    return _named(met, keys).unionByName(_regional(changes, rows, keys))


def indel_effects(changes: DataFrame, reference: str) -> DataFrame:
    """An effect of each small change (position, size, insertion) on each gene it touches, or on its region. An insertion
    stands behind its position, so one behind a gene's last base is outside."""
    keys = ["position", "size", "insertion"]
    changes = changes.select(*keys).distinct().withColumn("last", F.when(F.col("insertion"), F.col("position")).otherwise(F.col("position") + F.col("size") - 1))
    genes = F.broadcast(genome.genes(changes.sparkSession))  # 37 rows
    met = intervals.overlapping(changes, genes, "position", "last", "gene_start", "gene_end").where(~F.col("insertion") | (F.col("position") < F.col("gene_end")))
    edge = F.when(F.col("gene_strand") == "+", F.col("position")).otherwise(F.col("last"))
    affected = F.when(F.col("insertion"), F.col("position")).otherwise(F.greatest("gene_start", F.least("gene_end", edge)))
    table = codons(changes.sparkSession, reference).where("biotype = 'protein_coding'").select("gene", F.col("position").alias("affected"), "codon", "bases")
    rows = met.withColumn("affected", affected).join(F.broadcast(table), ["gene", "affected"], "left")
    coding = F.col("biotype") == "protein_coding"
    amino = F.when(F.col("codon") == 0, "M").otherwise(genome.translate_codon(F.col("bases")))
    name = F.concat(F.lit("p."), genome.three_letter(amino), (F.col("codon") + 1).cast("string"))
    frame = F.col("size") % 3 != 0
    kind = F.when(~coding, rna_consequence(F.col("biotype"))).when(frame, "frameshift_variant").when(F.col("insertion"), "inframe_insertion").otherwise("inframe_deletion")
    tail = F.when(frame, "fs").when(F.col("insertion"), "ins").otherwise("del")
    only = lambda c: F.when(coding, c)
    met = rows.select(*keys, "gene", "biotype", kind.alias("consequence"), only(F.col("codon") + 1).alias("residue"), only(amino).alias("ref_aa"), only(F.concat(name, tail)).alias("hgvs_protein"))
    return _named(met, keys).unionByName(_regional(changes, rows, keys))


def deletion_impact(deletions: DataFrame, length: int = coords.L) -> DataFrame:
    """Of circular deletions (event, start, end): genes lost and partial (arrays in genome order), trnas, fusion, heavy_origin,
    light_origin, major_arc, contact_zone.

    A fusion joins the plus-strand coding genes on both sides of the gap; in frame if both break at the same codon phase.
    """
    rows = deletions.select("event", "start", "end")
    pieces = intervals.split_at_origin(rows).select("event", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    genes = F.broadcast(genome.genes(deletions.sparkSession))  # 37 rows
    met = intervals.overlapping(pieces, genes, "p_start", "p_end", "gene_start", "gene_end")
    shared = F.sum(F.least("p_end", "gene_end") - F.greatest("p_start", "gene_start") + 1)
    by_gene = met.groupBy("event", "gene", "gene_start", "gene_end", "gene_strand", "biotype").agg(shared.alias("shared")).join(rows, "event")
    whole = F.col("shared") == F.col("gene_end") - F.col("gene_start") + 1
    before, after = coords.previous_position("start", length), coords.next_position("end", length)
    plus = ~whole & (F.col("biotype") == "protein_coding") & (F.col("gene_strand") == "+")
    holds = lambda p: plus & p.between(F.col("gene_start"), F.col("gene_end"))
    order = F.struct("gene_start", "gene_end", "gene")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, order))), lambda x: x["gene"])
    sums = by_gene.groupBy("event").agg(
        listed(whole).alias("genes_lost"),
        listed(~whole).alias("genes_partial"),
        F.count_if(F.col("biotype") == "tRNA").alias("trnas"),
        F.max(F.when(holds(before), order)).alias("left"),  # of overlapping genes the last, on the other side the first
        F.min(F.when(holds(after), order)).alias("right"),
    )
    touches = lambda span: coords.overlap("start", "end", *(F.lit(x).cast("long") for x in span), length=length) > 0
    same = F.pmod(F.col("start") - F.col("left.gene_start"), F.lit(3)) == F.pmod(F.col("end") + 1 - F.col("right.gene_start"), F.lit(3))
    joint = F.when(F.col("left.gene") == F.col("right.gene"), F.concat(F.col("left.gene"), F.lit(" internal deletion"))).otherwise(F.concat_ws("::", "left.gene", "right.gene"))
    fusion = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.concat(joint, F.when(same, " (in frame)").otherwise(" (out of frame)")))
    none = F.array().cast("array<string>")
    inside = lambda c, span: F.col(c).between(*span)
    return rows.join(sums, "event", "left").select(
        "event",
        F.coalesce("genes_lost", none).alias("genes_lost"),
        F.coalesce("genes_partial", none).alias("genes_partial"),
        F.coalesce("trnas", F.lit(0)).cast("long").alias("trnas"),
        fusion.alias("fusion"),
        touches(HEAVY_ORIGIN).alias("heavy_origin"),
        touches(LIGHT_ORIGIN).alias("light_origin"),
        ((F.col("start") <= F.col("end")) & (F.col("start") >= MAJOR_ARC[0]) & (F.col("end") <= MAJOR_ARC[1])).alias("major_arc"),
        (inside("start", CONTACT_LEFT) & inside("end", CONTACT_RIGHT)).alias("contact_zone"),
    )


def primary_effect(effects: Column) -> Column:
    """Of an array of effects: the first with a structure that isn't synonymous, else the first on a coding gene, else the first."""
    shown = F.filter(effects, lambda e: e["structure"].isNotNull() & (e["consequence"] != "synonymous_variant"))
    coded = F.filter(effects, lambda e: e["biotype"] == "protein_coding")
    return F.coalesce(F.get(shown, F.lit(0)), F.get(coded, F.lit(0)), F.get(effects, F.lit(0)))


def on_structure(effects: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Effects with structure (model, chain, complex) where the catalogue (gene, model, chain, complex, first, last, differs)
    models their residue; not for stops, nor where the model's residue differs."""
    spans = catalogue.withColumn("residue", F.explode(F.sequence("first", "last"))).where(~F.array_contains("differs", F.col("residue")))
    models = spans.groupBy("gene", "residue").agg(F.min(F.struct("model", "chain", "complex")).alias("structure"))
    joined = effects.join(models, ["gene", "residue"], "left")
    return joined.withColumn("structure", F.when(F.coalesce(F.col("ref_aa") != "*", F.lit(True)), F.col("structure")))


def modelled(asked: DataFrame, model: DataFrame, differs: DataFrame) -> DataFrame:
    """gene, residue, models: asked residues with the number of models that hold them (first, last), without those at which
    a model's residue differs. A gene's ranges are spelt out by residue, so the join is an equi-join."""
    residues = model.select("gene", F.explode(F.sequence("first", "last")).alias("residue"))
    models = residues.groupBy("gene", "residue").agg(F.count("*").alias("models"))  # counted first: the join meets a row for each residue
    return asked.join(differs, ["gene", "residue"], "left_anti").join(models, ["gene", "residue"])


def with_assertions(rows: DataFrame, assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the assertions of their change (one row for each key, with `assertions`, their number), 0 without any."""
    return rows.join(assertions, keys, "left").withColumn("assertions", F.coalesce("assertions", F.lit(0)).cast("long"))

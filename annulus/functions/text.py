"""Scalar functions over strings: bases, CIGARs, keys, clinical vocabulary, export cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR_ENTRY = "([0-9]+)([MIDNSHP=X])"


def reverse_complement(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGTacgt", "TGCAtgca"))


def gc_fraction(x: Column) -> Column:
    n = F.length(x)
    return F.when(n > 0, (n - F.length(F.translate(x, "GCgc", ""))) / n).otherwise(F.lit(0.0))


def mean_phred(qualities: Column) -> Column:
    q = F.transform(F.split(qualities, ""), lambda c: F.ascii(c) - 33)
    return F.when(F.length(qualities) > 0, F.aggregate(q, F.lit(0), lambda s, x: s + x) / F.length(qualities))


def cigar_operations(cigar: Column) -> Column:
    """array of (length, code); `*` and null have none."""
    lengths = F.regexp_extract_all(cigar, F.lit(CIGAR_ENTRY), F.lit(1))
    codes = F.regexp_extract_all(cigar, F.lit(CIGAR_ENTRY), F.lit(2))
    pairs = F.zip_with(lengths, codes, lambda n, c: F.struct(n.cast("int").alias("length"), c.alias("code")))
    return F.when(cigar.isNull() | (cigar == "*"), F.array().cast("array<struct<length:int,code:string>>")).otherwise(pairs)


def cigar_is_valid(cigar: Column) -> Column:
    return (cigar == "*") | (F.regexp(cigar, F.lit(f"^(?:{CIGAR_ENTRY})+$")) & ~F.regexp(cigar, F.lit("(?:^|[A-Z=])0+[A-Z=]")))


def _span(ops: Column, codes: str) -> Column:
    kept = F.filter(ops, lambda o: o["code"].isin(*codes))
    return F.aggregate(kept, F.lit(0), lambda s, o: s + o["length"])


def reference_span(ops: Column) -> Column:
    return _span(ops, "MDN=X")


def query_span(ops: Column) -> Column:
    return _span(ops, "MIS=X")


def aligned_bases(ops: Column) -> Column:
    return _span(ops, "M=X")


def one_base(allele: Column, base: Column) -> Column:
    """Whether an allele consists of one base alone."""
    return F.coalesce((F.length(allele) > 0) & (F.replace(allele, base, F.lit("")) == ""), F.lit(False))


def base_index(base: Column) -> Column:
    """0 to 3 of A, C, G, T; null of anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def phred_at(qualities: Column, i: Column) -> Column:
    """The quality of a base (from 0); null outside the string or the printable range."""
    code = F.ascii(F.substring(qualities, i + 1, F.lit(1)))
    return F.when((i >= 0) & (i < F.length(qualities)) & code.between(33, 126), code - 33)


def tag_value_is_valid(x: Column) -> Column:
    """1 to 256 characters, none of them a control character."""
    return F.length(x).between(1, 256) & ~F.regexp(x, F.lit(r"[\x00-\x1f\x7f]"))


def variant_key(position: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", position.cast("string"), ref, alt)


def token(x: Column) -> Column:
    """Lower case, with spaces and hyphens as single underscores."""
    return F.lower(F.regexp_replace(F.trim(x), "[ _-]+", "_"))


def semicolon_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ";"), lambda v: F.trim(v)), lambda v: v != "")  # F.trim itself would take the index for what to trim


def strict_unsigned(x: Column) -> Column:
    return F.when(F.regexp(x, F.lit("^[0-9]+$")), x.try_cast("long"))


def clean_field(x: Column) -> Column:
    return F.trim(F.translate(x, "\t\r\n", "   "))


def vcf_token(x: Column) -> Column:
    return F.regexp_replace(x, "[ \t\r\n;=,]", "_")


def file_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")


def sam_tag_name_is_valid(x: Column) -> Column:
    return F.regexp(x, F.lit("^[A-Za-z][A-Za-z0-9]$"))


def nuclear_contig(name: Column) -> Column:
    return F.regexp(F.lower(name), F.lit("^(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|x|y)$"))


def mitochondrial_contig(name: Column) -> Column:
    return F.regexp(F.lower(name), F.lit("^(?:mt|chrm|m|nc_012920(?:[.]1)?)$"))


def macro_group(name: Column) -> Column:
    """L and its digit, else the first letter."""
    return F.when(F.regexp(name, F.lit("^L[0-9]")), F.substring(name, 1, 2)).otherwise(F.substring(name, 1, 1))


def significance(x: Column) -> Column:
    """A clinical significance in the fixed vocabulary; the first rule that fits decides."""
    v = F.coalesce(token(x), F.lit(""))
    has = lambda *parts: F.lit(False) if not parts else _any(F.contains(v, F.lit(p)) for p in parts)
    out = F.when(v.isin("", "not_provided", "not_specified"), "not_provided")
    out = out.when(has("conflict") | (has("pathogenic") & has("benign")), "conflicting")
    out = out.when(has("pathogenic/likely_pathogenic", "pathogenic,_likely_pathogenic"), "pathogenic_or_likely_pathogenic")
    for word in ("likely_pathogenic", "pathogenic"):
        out = out.when(has(word), word)
    out = out.when(has("benign/likely_benign", "benign,_likely_benign"), "benign_or_likely_benign")
    for word in ("likely_benign", "benign"):
        out = out.when(has(word), word)
    out = out.when(has("uncertain") | (v == "vus"), "uncertain_significance")
    for word in ("risk_factor", "association", "drug_response", "protective", "affects"):
        out = out.when(has(word), word)
    return out.otherwise("other")


def significance_group(normalized: Column) -> Column:
    out = F.when(normalized.isin("pathogenic", "likely_pathogenic", "pathogenic_or_likely_pathogenic"), "pathogenic")
    out = out.when(normalized.isin("benign", "likely_benign", "benign_or_likely_benign"), "benign")
    out = out.when(normalized == "uncertain_significance", "uncertain").when(normalized == "conflicting", "conflicting")
    return out.when(normalized.isin("not_provided", "other"), "unclassified").otherwise("other_assertion")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out

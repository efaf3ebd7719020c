"""The annotated genome: genes, genetic code, amino acids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Gene, start, end, strand, kind, on the revised Cambridge reference sequence.
GENES = tuple(
    (name, int(a), int(b), strand, {"t": "tRNA", "r": "rRNA", "p": "protein_coding"}[kind])
    for name, a, b, strand, kind in (
        x.split()
        for x in """
MT-TF 577 647 + t
MT-RNR1 648 1601 + r
MT-TV 1602 1670 + t
MT-RNR2 1671 3229 + r
MT-TL1 3230 3304 + t
MT-ND1 3307 4262 + p
MT-TI 4263 4331 + t
MT-TQ 4329 4400 - t
MT-TM 4402 4469 + t
MT-ND2 4470 5511 + p
MT-TW 5512 5579 + t
MT-TA 5587 5655 - t
MT-TN 5657 5729 - t
MT-TC 5761 5826 - t
MT-TY 5826 5891 - t
MT-CO1 5904 7445 + p
MT-TS1 7446 7514 - t
MT-TD 7518 7585 + t
MT-CO2 7586 8269 + p
MT-TK 8295 8364 + t
MT-ATP8 8366 8572 + p
MT-ATP6 8527 9207 + p
MT-CO3 9207 9990 + p
MT-TG 9991 10058 + t
MT-ND3 10059 10404 + p
MT-TR 10405 10469 + t
MT-ND4L 10470 10766 + p
MT-ND4 10760 12137 + p
MT-TH 12138 12206 + t
MT-TS2 12207 12265 + t
MT-TL2 12266 12336 + t
MT-ND5 12337 14148 + p
MT-ND6 14149 14673 - p
MT-TE 14674 14742 - t
MT-CYB 14747 15887 + p
MT-TT 15888 15953 + t
MT-TP 15956 16023 - t
""".strip().splitlines()
    )
)

# Translation table 2 over codons in the order T, C, A, G.
CODE = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"
START_CODONS = ("ATG", "ATA", "ATT", "ATC", "GTG")

# Composition, polarity and volume (Grantham 1974, table 1), and three-letter names.
AMINO_ACIDS = {
    "S": (1.42, 9.2, 32.0, "Ser"),
    "R": (0.65, 10.5, 124.0, "Arg"),
    "L": (0.0, 4.9, 111.0, "Leu"),
    "P": (0.39, 8.0, 32.5, "Pro"),
    "T": (0.71, 8.6, 61.0, "Thr"),
    "A": (0.0, 8.1, 31.0, "Ala"),
    "V": (0.0, 5.9, 84.0, "Val"),
    "G": (0.74, 9.0, 3.0, "Gly"),
    "I": (0.0, 5.2, 111.0, "Ile"),
    "F": (0.0, 5.2, 132.0, "Phe"),
    "Y": (0.20, 6.2, 136.0, "Tyr"),
    "C": (2.75, 5.5, 55.0, "Cys"),
    "H": (0.58, 10.4, 96.0, "His"),
    "Q": (0.89, 10.5, 85.0, "Gln"),
    "N": (1.33, 11.6, 56.0, "Asn"),
    "K": (0.33, 11.3, 119.0, "Lys"),
    "D": (1.38, 13.0, 54.0, "Asp"),
    "E": (0.92, 12.3, 83.0, "Glu"),
    "M": (0.0, 5.7, 105.0, "Met"),
    "W": (0.13, 5.4, 170.0, "Trp"),
}


def genes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENES, "gene string, gene_start long, gene_end long, gene_strand string, biotype string")


def report_genes(spark):
    """The 15 genes of a report: those of proteins and ribosomal RNA."""
    return genes(spark).where("biotype <> 'tRNA'")


def labels(spark):
    """label, gene, n: the report's gene labels in the order in which they are placed, the longest genes first, then by start."""
    length = F.col("gene_end") - F.col("gene_start") + 1
    order = Window.orderBy(F.desc(length), "gene_start")  # 15 rows
    return report_genes(spark).select(F.row_number().over(order).cast("long").alias("n"), "gene", F.regexp_replace("gene", "^MT-", "").alias("label"))


def translate_codon(codon: Column) -> Column:
    """The amino acid of a codon; X with an unknown base."""
    at = lambda i: F.instr(F.lit("TCAG"), F.substring(codon, i, 1))
    index = 16 * (at(1) - 1) + 4 * (at(2) - 1) + at(3)
    return F.when(F.regexp(codon, F.lit("^[TCAG]{3}$")), F.substring(F.lit(CODE), index, F.lit(1))).otherwise("X")


def codon_of(position: Column, start: Column, end: Column, strand: Column) -> tuple[Column, Column]:
    """Codon index and phase, from 0."""
    offset = F.when(strand == "+", position - start).otherwise(end - position)
    return F.floor(offset / 3).cast("long"), F.pmod(offset, F.lit(3)).cast("long")


def three_letter(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in AMINO_ACIDS.items() for x in (k, v[3])), F.lit("*"), F.lit("Ter"))
    return F.coalesce(F.try_element_at(table, code), F.lit("Xaa"))


def grantham(a: str, b: str) -> int | None:
    if a not in AMINO_ACIDS or b not in AMINO_ACIDS:
        return None
    c, p, v = (x - y for x, y in zip(AMINO_ACIDS[a][:3], AMINO_ACIDS[b][:3]))
    return math.floor(50.723 * math.sqrt(1.833 * c * c + 0.1018 * p * p + 0.000399 * v * v) + 0.5)


def protein(reference: str, gene: str) -> str:
    """The gene's amino acids; a last codon cut short is completed with A."""
    _, start, end, strand, _ = next(g for g in GENES if g[0] == gene)
    bases = reference[start - 1 : end]
    if strand == "-":
        bases = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    bases += "A" * (-len(bases) % 3)
    index = lambda c: 16 * "TCAG".index(c[0]) + 4 * "TCAG".index(c[1]) + "TCAG".index(c[2])
    codons = [bases[i : i + 3] for i in range(0, len(bases), 3)]
    return "".join(CODE[index(c)] if set(c) <= set("TCAG") else "X" for c in codons)

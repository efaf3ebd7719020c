"""Lineage trees, marker weights and alignment rules: small resources, read on the driver into tables."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.errors import AnalysisError
from annulus.functions import coords

TOKEN = re.compile("([1-9][0-9]*)(?:([ACGT])|([dD])|[.]([1-9][0-9]*|X)([ACGT]+))(!?)", re.IGNORECASE)
LARGEST_TREE = 64 << 20


def parse_token(token: str) -> tuple[tuple[int, str], str, bool]:
    """(locus, marker, back). Insertions have loci of their own; a base and its deletion share one."""
    m = TOKEN.fullmatch(token.strip())
    if not m or int(m[1]) > coords.L or m[4] == "x":
        raise AnalysisError("E1302", f"unsupported marker {token!r}")
    position, base, gone, index, bases, back = m.groups()
    marker = f"{position}{base.upper()}" if base else f"{position}d" if gone else f"{position}.{index}{bases.upper()}"
    return (int(position), index or ""), marker, bool(back)


def tree_definitions(xml: str) -> list[tuple[str, int, int, str]]:
    """(definition, source_order, position, marker): a node has its parent's markers, with its own in place of those at
    the same locus, and without those it takes back."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise AnalysisError("E1302", f"the tree can't be parsed: {e}") from e
    rows: list[tuple[str, int, int, str]] = []
    order = 0

    def own(node):
        for child in node:
            if child.tag == "poly":
                yield child.text or ""
            elif child.tag != "haplogroup":
                yield from own(child)

    todo = [(node, {}) for node in reversed(root.findall("haplogroup") if root.tag != "haplogroup" else [root])]
    while todo:
        node, markers = todo.pop()
        name = node.get("name")
        if not name:
            raise AnalysisError("E1302", "a node has no name")
        for token in own(node):
            locus, marker, back = parse_token(token)
            markers.pop(locus, None)
            if not back:
                markers[locus] = marker
        rows += [(name, order, position, marker) for (position, _), marker in sorted(markers.items())] or [(name, order, None, None)]
        order += 1
        todo += [(child, dict(markers)) for child in reversed(node.findall("haplogroup"))]
    if not any(marker for *_, marker in rows):
        raise AnalysisError("E1302", "the tree has no markers")
    return rows


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """definition, source_order, position, marker; a node without markers is one row with nulls."""
    file = spark.read.format("binaryFile").load(path).where(F.col("length") <= LARGEST_TREE).select("content").first()
    if file is None:
        raise AnalysisError("E1301", f"{path} is missing or larger than {LARGEST_TREE} bytes")
    return spark.createDataFrame(tree_definitions(bytes(file.content).decode()), "definition string, source_order long, position long, marker string")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """marker, weight of tab-separated lines; lines without a positive finite weight are skipped, the last of equals holds."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("n"))
    weight = F.get("f", F.lit(1)).try_cast("double")
    good = lines.select(F.get("f", F.lit(0)).alias("marker"), weight.alias("weight"), "n").where("weight > 0 and weight < double('infinity')")
    return good.groupBy("marker").agg(F.max_by("weight", "n").alias("weight"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(error markers, expected markers) of a CSV with header `error,expected`; lists are separated by spaces or commas."""
    rows = spark.read.option("header", True).csv(path)
    if rows.columns != ["error", "expected"]:
        raise AnalysisError("E1302", f"{path} has columns {rows.columns}")
    tokens = lambda x: [t for t in re.split("[\\s,]+", x or "") if t]
    return [(tokens(r.error), tokens(r.expected)) for r in rows.toLocalIterator() if tokens(r.error)]


def apply_rules(markers: list[str], rules: list[tuple[list[str], list[str]]]) -> list[str]:
    """Markers after rules in their order, over and over until none fits: where all of a rule's error markers are there,
    the expected ones take their place. At most as many rounds as there are rules."""
    have = set(markers)
    for _ in range(len(rules) + 1):
        before = set(have)
        for error, expected in rules:
            if have.issuperset(error):
                have = have.difference(error).union(expected)
        if have == before:
            break
    return sorted(have)


def corrected(observed: DataFrame, rules: list[tuple[list[str], list[str]]], key: str = "cluster") -> DataFrame:
    """key, marker: each key's markers after the rules."""
    sets = observed.groupBy(key).agg(F.collect_set("marker").alias("markers"))

    def apply(batches):
        for x in batches:
            yield x.assign(markers=[apply_rules(list(m), rules) for m in x.markers])

    done = sets.mapInPandas(apply, sets.schema)
    return done.select(key, F.explode("markers").alias("marker"))

"""Molecules, locus levels, observations and what links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import stats
from annulus.operators.shared import written

CALLABLE = ("REFERENCE", "ALTERNATE", "EVENT_ABSENT")


def representative(fragments: DataFrame, molecule: str, quality: str, *index: str) -> DataFrame:
    """The fragment of highest quality of each molecule, the first of equals."""
    order = Window.partitionBy(molecule).orderBy(F.desc(quality), *index)
    return fragments.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_observation(bases: DataFrame, molecule: str = "molecule", position: str = "position") -> DataFrame:
    """One row for each molecule and position: its best base by quality, fragment and place; N if two good bases differ."""
    key = Window.partitionBy(molecule, position)
    order = key.orderBy(F.desc("quality"), "fragment", "query")
    ranked = bases.withColumn("_n", F.row_number().over(order)).withColumn("_two", F.min("base").over(key) != F.max("base").over(key))
    return ranked.where("_n = 1").withColumn("conflict", F.col("_two")).withColumn("base", F.when(F.col("_two"), "N").otherwise(F.col("base"))).drop("_n", "_two")


def locus_levels(best: DataFrame, position: str = "position") -> DataFrame:
    """position, a, c, g, t, callable: molecules by their base."""
    counts = [F.count_if(F.col("base") == b).alias(b.lower()) for b in "ACGT"]
    return best.groupBy(position).agg(*counts, F.count_if(F.col("base").isin(*"ACGT")).alias("callable"))


def variants(levels: DataFrame, reference: DataFrame) -> DataFrame:
    """position, ref, alt, support, callable, level and its interval for every base that isn't the reference's."""
    bases = F.array(*(F.struct(F.lit(b).alias("alt"), F.col(b.lower()).alias("support")) for b in "ACGT"))
    rows = levels.select("position", "callable", F.explode(bases).alias("x")).select("position", "callable", "x.*").where("support > 0")
    joined = rows.join(reference, "position").where("alt <> ref")
    low, high = stats.wilson(F.col("support"), F.col("callable"))
    return joined.withColumn("level", F.col("support") / F.col("callable")).withColumn("ci_low", low).withColumn("ci_high", high)


def allele_summary(observations: DataFrame, event: str) -> DataFrame:
    """Counts by state, and the qualities of the alternate ones."""
    alt = F.col("state") == "ALTERNATE"
    return observations.groupBy(event).agg(
        F.count_if(alt).alias("alternate"),
        F.count_if(F.col("state") == "REFERENCE").alias("reference"),
        F.count_if(F.col("state").isin(*CALLABLE)).alias("callable"),
        F.count_if(alt & (F.col("strand") == "+")).alias("forward"),
        F.avg(F.when(alt, F.col("quality"))).alias("quality_mean"),
        F.min(F.when(alt, F.col("quality"))).alias("quality_min"),
        F.max(F.when(alt, F.col("quality"))).alias("quality_max"),
    )


def phase_links(observations: DataFrame, molecule: str = "molecule", event: str = "event") -> DataFrame:
    """event_a < event_b that some molecule stores together with one of them ALTERNATE: the 2x2 table over all
    molecules that store both, its share, interval, expectation and difference.

    The pairs come from a join on the molecule; a molecule stores few events. Counts are summed
    before they are shuffled by pair.
    """
    a = observations.select(molecule, F.col(event).alias("event_a"), F.col("state").alias("sa"))
    b = observations.select(molecule, F.col(event).alias("event_b"), F.col("state").alias("sb"))
    both = a.join(b, molecule).where("event_a < event_b")
    sure = F.col("sa").isin(*CALLABLE) & F.col("sb").isin(*CALLABLE)
    alt_a, alt_b = F.col("sa") == "ALTERNATE", F.col("sb") == "ALTERNATE"
    table = both.groupBy("event_a", "event_b").agg(
        F.count_if(alt_a | alt_b).alias("_seen"),
        F.count_if(sure & alt_a & alt_b).alias("both"),
        F.count_if(sure & alt_a & ~alt_b).alias("only_a"),
        F.count_if(sure & ~alt_a & alt_b).alias("only_b"),
        F.count_if(sure & ~alt_a & ~alt_b).alias("neither"),
        F.count_if(~sure).alias("uncertain"),
    )
    n = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    linked = table.where("_seen > 0").drop("_seen").withColumn("callable", n)
    share = F.col("both") / F.nullif("callable", F.lit(0))
    expected = (F.col("both") + F.col("only_a")) / F.nullif("callable", F.lit(0)) * ((F.col("both") + F.col("only_b")) / F.nullif("callable", F.lit(0)))
    low, high = stats.wilson(F.col("both"), F.col("callable"))
    rows = linked.withColumn("fraction", share).withColumn("ci_low", low).withColumn("ci_high", high).withColumn("expected", expected)
    return rows.withColumn("delta", F.col("fraction") - F.col("expected"))


def phase_work(observations: DataFrame, molecule: str = "molecule") -> DataFrame:
    """One row (work): what linking the observations takes, counted before anything is joined: a unit for each observation, molecule,
    partner of an alternate one and pair of a molecule."""
    each = observations.groupBy(molecule).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "ALTERNATE").alias("a"))
    units = F.col("n") + 1 + F.col("a") * F.col("n") + F.col("n") * (F.col("n") - 1) / 2
    return each.agg(F.coalesce(F.sum(units), F.lit(0)).cast("long").alias("work"))


def assessed_links(observations: DataFrame, events: DataFrame, config, molecule: str = "molecule", event: str = "event") -> DataFrame:
    """`phase_links` within the limits of an analysis, with complete (absence of both events can be assessed), assessability and qc_flags.

    events (event, absence_assessable). The work is counted first and refused if it is too much, so that a pair explosion
    never starts; the number of links and of molecules that they name is checked on the links. Molecules that
    aren't eligible must be left out before.
    """
    from annulus.errors import AnalysisError

    def within(spent, most: int, what: str) -> None:
        if (spent or 0) > most:
            raise AnalysisError("E1601", f"{what}: {spent} of {most} allowed")

    within(phase_work(observations, molecule).first().work, config.max_phase_work, "phase work")
    links = written(phase_links(observations, molecule, event), "links")
    total = links.agg(F.count("*").alias("n"), F.sum(F.col("both") + F.col("uncertain")).alias("named")).first()
    within(total.n, config.max_phase_links, "phase links")
    within(total.named, config.max_phase_molecule_references, "molecules named by phase links")
    side = lambda x: events.select(F.col(event).alias(f"event_{x}"), F.col("absence_assessable").alias(f"_{x}"))
    full = F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))
    rows = links.join(side("a"), "event_a", "left").join(side("b"), "event_b", "left").withColumn("complete", full).drop("_a", "_b")
    flags = F.array_compact(F.array(F.when(~F.col("complete"), "SUPPORT_CONDITIONED"), F.when(F.col("uncertain") > 0, "UNCERTAIN_COOCCURRENCE_EXCLUDED")))
    level = F.when(F.col("complete"), "COMPLETE_FOR_BOTH_EVENTS").otherwise("SUPPORT_CONDITIONED")
    return rows.withColumn("assessability", level).withColumn("qc_flags", flags)


def target_observations(bases: DataFrame, targets: DataFrame, least_quality: int) -> DataFrame:
    """molecule, event, state, observed_allele, base_quality, mapping_quality, strand, center_proximity, fragment: what each molecule shows
    at the positions of events.

    bases (molecule, fragment, query, position, base, quality, mapping_quality, strand, size) are all aligned bases, good or not;
    targets (event, position, ref, alt) are bounded by the genome, so bases are cut down to their positions by a semi-join before
    anything is shuffled. One aggregation by molecule and position then finds the first fragment over it, whether two good
    bases differ (CONFLICT), and the best good base by quality, fragment and place; without a good one the state is LOW_QUALITY.
    A base that is neither the reference nor the alternate is EVENT_ABSENT. Null qualities are not good.
    """
    at = targets.select("position").distinct()
    near = bases.join(at, "position", "left_semi")
    good = F.coalesce((F.col("quality") >= least_quality) & F.col("base").isin(*"ACGT"), F.lit(False))
    last = F.col("size") - 1
    center = F.when(last > 0, 2.0 * F.least(F.col("query"), last - F.col("query")) / last).otherwise(0.0)
    best = F.struct("quality", (-F.col("fragment")).alias("f"), (-F.col("query")).alias("q"), "base", "mapping_quality", "strand", center.alias("center"))
    one = near.groupBy("molecule", "position").agg(
        F.min(F.struct("fragment", "mapping_quality", "strand")).alias("first"),
        F.max(F.when(good, best)).alias("best"),
        F.min(F.when(good, F.col("base"))).alias("low"),
        F.max(F.when(good, F.col("base"))).alias("high"),
    )
    met = one.join(targets, "position")
    sure = F.col("best").isNotNull() & (F.col("low") == F.col("high"))
    state = F.when(F.col("best").isNull(), "LOW_QUALITY").when(F.col("low") != F.col("high"), "CONFLICT")
    state = state.when(F.col("best.base") == F.col("alt"), "ALTERNATE").when(F.col("best.base") == F.col("ref"), "REFERENCE").otherwise("EVENT_ABSENT")
    seen = lambda c: F.coalesce(F.col(f"best.{c}"), F.col(f"first.{c}")).alias(c)
    return met.select(
        "molecule",
        "event",
        state.alias("state"),
        F.when(sure, F.col("best.base")).alias("observed_allele"),
        F.when(sure, F.col("best.quality")).alias("base_quality"),
        seen("mapping_quality"),
        seen("strand"),
        F.when(sure, F.col("best.center")).alias("center_proximity"),
        F.coalesce(-F.col("best.f"), F.col("first.fragment")).alias("fragment"),
    )


def event_evidence(observations: DataFrame) -> DataFrame:
    """A row for each event of `target_observations`: depths by state (alternate, reference, other, low_quality, conflict, callable), level
    and its interval; and for alternates, references and others each: forward, reverse, the least, greatest and mean base quality
    and mapping quality, and the mean place in the read. Nulls where there is none. All are sums and extremes, so they merge."""
    sides = {"alternate": F.col("state") == "ALTERNATE", "reference": F.col("state") == "REFERENCE", "other": F.col("state") == "EVENT_ABSENT"}
    aggs = [F.count_if(c).alias(name) for name, c in sides.items()]
    aggs += [F.count_if(F.col("state") == s).alias(s.lower()) for s in ("LOW_QUALITY", "CONFLICT")]
    for name, c in sides.items():
        at = lambda x: F.when(c, F.col(x))  # noqa: E731, B023 - used at once
        aggs += [F.count_if(c & (F.col("strand") == "+")).alias(f"{name}_forward"), F.count_if(c & (F.col("strand") == "-")).alias(f"{name}_reverse")]
        for column, short in (("base_quality", "quality"), ("mapping_quality", "mapq")):
            aggs += [f(at(column)).alias(f"{name}_{short}_{what}") for what, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
        aggs.append(F.avg(at("center_proximity")).alias(f"{name}_read_position"))
    rows = observations.groupBy("event").agg(*aggs).withColumn("callable", F.col("alternate") + F.col("reference") + F.col("other"))
    low, high = stats.wilson(F.col("alternate"), F.col("callable"))
    level = F.when(F.col("callable") > 0, F.col("alternate") / F.col("callable")).otherwise(0.0)
    return rows.withColumn("level", level).withColumn("ci_low", F.when(F.col("callable") > 0, low).otherwise(0.0)).withColumn("ci_high", F.when(F.col("callable") > 0, high).otherwise(0.0))


def spanning(intervals: DataFrame, points: DataFrame, carriers: DataFrame, flank: int = 25) -> DataFrame:
    """point, n: molecules with an interval over the point and its flanks that aren't carriers of it."""
    from annulus.operators.intervals import overlapping

    wide = points.select("point", (F.col("point") - flank).alias("p_start"), (F.col("point") + flank).alias("p_end"))
    over = overlapping(intervals, wide, "start", "end", "p_start", "p_end").where("start <= p_start and end >= p_end")
    left = over.select("point", "molecule").distinct().join(carriers, ["point", "molecule"], "left_anti")
    return points.join(left.groupBy("point").agg(F.count("*").alias("n")), "point", "left").select("point", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def clinical_consensus(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Per variant: assertions, conflict_status and the joint significance of (significance, group)."""
    sets = assertions.groupBy(*keys).agg(
        F.count("*").alias("assertions"),
        F.array_sort(F.collect_set("significance")).alias("all"),
        F.array_sort(F.collect_set("group")).alias("groups"),
    )
    plain = F.size(F.filter("groups", lambda g: g != "conflicting"))
    conflict = F.array_contains("groups", "conflicting") | (plain > 1)
    status = F.when(conflict, "conflicting").when(F.col("assertions") == 1, "single_assertion").otherwise("consistent")
    joint = F.when(F.size("all") == 0, "not_provided").when(F.size("all") == 1, F.get("all", F.lit(0)))
    joint = joint.when(F.forall("groups", lambda g: g == "pathogenic"), "pathogenic_or_likely_pathogenic")
    joint = joint.when(F.forall("groups", lambda g: g == "benign"), "benign_or_likely_benign").otherwise(F.get("all", F.lit(0)))
    return sets.select(*keys, "assertions", status.alias("conflict_status"), joint.alias("significance"))


def band_components(df: DataFrame, key: str, widths: dict[str, int]) -> DataFrame:
    """key, component: rows whose values are all within their width of each other's, and what they connect to.

    `widths` names two columns, keys are distinct; rows with a null connect with nothing. Rows are dealt to cells as wide
    as the widths, so those of a cell are near each other and are one node, named by the smallest key. Whether two
    cells touch is told by their outmost rows: side by side by the extremes, at a corner by the rows that no other
    one of the cell is nearer to that corner in both values. No pair of rows of a cell is ever formed, so the
    work grows with the rows, however dense they lie.
    """
    from annulus.operators.graph import components

    (x, wx), (y, wy) = widths.items()
    cell = lambda c, w: F.floor(F.col(c) / w)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.where(known).select(key, F.col(x).alias("x"), F.col(y).alias("y"), cell(x, wx).alias("cx"), cell(y, wy).alias("cy"))
    extremes = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("least", F.min), ("most", F.max))]
    cells = written(rows.groupBy("cx", "cy").agg(F.min(key).alias("node"), *extremes), "cells")
    one, other = cells.alias("p"), cells.alias("q")
    beside = one.join(other, F.expr("q.cx = p.cx + 1 and q.cy = p.cy")).where(F.col("q.least_x") - F.col("p.most_x") <= wx)
    above = one.join(other, F.expr("q.cx = p.cx and q.cy = p.cy + 1")).where(F.col("q.least_y") - F.col("p.most_y") <= wy)
    edges = beside.select("p.node", "q.node").union(above.select("p.node", "q.node"))

    points = written(rows.select("cx", "cy", "x", "y").distinct(), "points")
    before = Window.partitionBy("cx", "cy").rowsBetween(Window.unboundedPreceding, -1)
    for side in (1, -1):  # the upper and the lower corner to the right
        towards = F.col("y") * side
        high = F.max(towards).over(before.orderBy(F.desc("x"), F.desc(towards)))
        low = F.min(towards).over(before.orderBy("x", towards))
        ahead = points.withColumn("_reach", high).where(F.col("_reach").isNull() | (towards > F.col("_reach"))).alias("a")
        behind = points.withColumn("_reach", low).where(F.col("_reach").isNull() | (towards < F.col("_reach"))).alias("b")
        met = ahead.join(behind, F.expr(f"b.cx = a.cx + 1 and b.cy = a.cy + {side}"))
        near = met.where((F.col("b.x") - F.col("a.x") <= wx) & ((F.col("b.y") - F.col("a.y")) * side <= wy))
        touching = near.select("a.cx", "a.cy", F.col("b.cx").alias("dx"), F.col("b.cy").alias("dy")).distinct().alias("t")
        named = touching.join(one, F.expr("p.cx = t.cx and p.cy = t.cy")).join(other, F.expr("q.cx = t.dx and q.cy = t.dy"))
        edges = edges.union(named.select("p.node", "q.node"))
    found = components(cells.select("node"), edges.toDF("a", "b"))
    labels = written(cells.join(found, "node").select("cx", "cy", "component"), "labels")
    alone = df.where(~known).select(key, F.col(key).alias("component"))
    return rows.join(labels, ["cx", "cy"]).select(key, "component").unionByName(alone)


def event_profile(observations: DataFrame, group: str, config, number: str | None = None) -> DataFrame:
    """For each group and event: states, the share of ALTERNATE where enough members are callable, and what is expected.
    `number` is a column that says how many members a row stands for."""
    count = F.count_if if number is None else lambda test: F.sum(F.when(test, F.col(number)).otherwise(0))
    alt, absent = count(F.col("state") == "ALTERNATE"), count(F.col("state").isin("REFERENCE", "EVENT_ABSENT"))
    uncertain = count(~F.col("state").isin(*CALLABLE))
    rows = observations.groupBy(group, "event").agg(alt.alias("alternate"), absent.alias("absent"), uncertain.alias("uncertain"))
    n = F.col("alternate") + F.col("absent")
    shared = rows.withColumn("fraction", F.when(n >= config.min_architecture_molecules, F.col("alternate") / n))
    expected = lambda c: F.coalesce(c, F.lit(False))
    return shared.withColumn("expected_alternate", expected(F.col("fraction") >= config.architecture_consensus_fraction)).withColumn(
        "expected_absent", expected(F.col("fraction") <= config.architecture_optional_fraction)
    )


def outliers(df: DataFrame, value: str, scale: float = 6 * 1.4826, least: float = 0.02) -> DataFrame:
    """Adds center (upper median), spread (upper median of distances) and outlier; a value per molecule, not per base."""
    center = df.agg(stats.upper_median(F.col(value)).alias("center"))
    near = df.crossJoin(F.broadcast(center))
    spread = near.agg(stats.upper_median(F.abs(F.col(value) - F.col("center"))).alias("spread"))
    limit = F.col("center") + F.greatest(F.lit(scale) * F.col("spread"), F.lit(least))
    return near.crossJoin(F.broadcast(spread)).withColumn("outlier", F.col(value) > limit)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return p, r, F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))

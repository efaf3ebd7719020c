"""Candidate architectures: molecules that share a pattern of events, found by seeds and reassignment.

Observations stay a table; molecules with equal ones are a class with their number n,
and rounds see classes alone. Candidates are few (a configured limit), so a round
is a join of observations with the candidates' profiles and a sum for each
class and candidate. Rounds are cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.errors import AnalysisError
from annulus.functions import stats
from annulus.operators.evidence import CALLABLE, event_profile
from annulus.operators.shared import written

ROUNDS = 8
#: An event's weight by how its type begins; other types weigh 1.
WEIGHTS = {"COMPLEX_SV_PATH": 3.0, "SV_": 2.0, "SMALL_": 1.5}
#: Fixed value: what a molecule without any of a candidate's weight pays.
MISSING_PENALTY = 0.25


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "architectures")


@dataclass
class Inference:
    status: str
    flags: list[str]
    architectures: DataFrame | None
    assignments: DataFrame


def event_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for prefix, w in reversed(WEIGHTS.items()):
        out = F.when(F.startswith(kind, F.lit(prefix)), w).otherwise(out)
    return out


def architecture_name(signature: Column) -> Column:
    """Length-prefixed event names behind a version; the empty signature has a name of its own."""
    parts = F.array_join(F.transform(signature, lambda e: F.concat(F.octet_length(e).cast("string"), F.lit("#"), e)), "")
    return F.when(F.size(signature) == 0, "architecture:v1:reference-like").otherwise(F.concat(F.lit("architecture:v1:"), parts))


def signatures(molecules: DataFrame, observations: DataFrame) -> DataFrame:
    """molecule, signature: the events an eligible molecule shows, in order."""
    shown = observations.where("state = 'ALTERNATE'").groupBy("molecule").agg(F.array_sort(F.collect_set("event")).alias("signature"))
    return molecules.select("molecule").join(shown, "molecule", "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))


def _number(rows: DataFrame) -> Column:
    """How many molecules rows are: a row each, or n."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def supported(signed: DataFrame, config: Config) -> DataFrame:
    """signature, n: the signatures that enough molecules show, however many they are."""
    return signed.groupBy("signature").agg(_number(signed).alias("n")).where(F.col("n") >= config.min_architecture_molecules)


def seeds(signed: DataFrame, config: Config) -> DataFrame:
    """architecture, signature, molecule (and n, if there): signatures with enough molecules; if none has, single events with enough."""
    rows, kept_columns = signed, [c for c in ("molecule", "n") if c in signed.columns]
    kept = _cut(supported(rows, config).drop("n"))
    if kept.isEmpty():
        rows = signed.select(*kept_columns, F.explode("signature").alias("e")).select(*kept_columns, F.array("e").alias("signature"))
        kept = _cut(supported(rows, config).drop("n"))
    if kept.limit(config.max_candidate_architectures + 1).count() > config.max_candidate_architectures:
        raise AnalysisError("E1601", f"candidate architecture limit exceeded (max_candidate_architectures={config.max_candidate_architectures})")
    return rows.join(kept, "signature").select(architecture_name(F.col("signature")).alias("architecture"), "signature", *kept_columns)


def scores(signed: DataFrame, observations: DataFrame, candidates: DataFrame, profiles: DataFrame, weights: DataFrame) -> DataFrame:
    """molecule, architecture, distance, overlap, score for every molecule and candidate that can be compared.

    Events of a profile that are expected to be there or not are compared with callable observations; events that a
    molecule shows and no profile has count as full disagreement.
    """
    weighed = observations.join(weights, "event").where(F.col("state").isin(*CALLABLE))
    firm = profiles.where("expected_alternate or expected_absent").join(weights, "event")
    total = firm.groupBy("architecture").agg(F.sum("weight").alias("candidate_weight"))
    alt = F.col("state") == "ALTERNATE"
    compared = weighed.join(firm.drop("weight"), "event").groupBy("molecule", "architecture").agg(
        F.sum("weight").alias("joint"), F.sum(F.col("weight") * F.when(alt, 1 - F.col("fraction")).otherwise(F.col("fraction"))).alias("differs")
    )
    shown = weighed.where(alt)
    all_shown = shown.groupBy("molecule").agg(F.sum("weight").alias("shown"))
    known = shown.join(profiles.select("architecture", "event"), "event").groupBy("molecule", "architecture").agg(F.sum("weight").alias("known"))
    # each molecule with the candidates, whose number is limited and which are checked before
    grid = signed.select("molecule", F.size("signature").alias("_n")).crossJoin(F.broadcast(candidates.select("architecture", (F.size("signature") == 0).alias("_empty")).join(total, "architecture", "left")))
    rows = grid.join(compared, ["molecule", "architecture"], "left").join(known, ["molecule", "architecture"], "left").join(all_shown, "molecule", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    extra = zero("shown") - zero("known")
    base = zero("joint") + extra
    profiled = profiles.select("architecture").distinct().withColumn("_profiled", F.lit(True))
    rows = rows.join(F.broadcast(profiled), "architecture", "left")
    distance = F.when(F.col("_profiled").isNull() & F.col("_empty") & (F.col("_n") == 0), F.lit(0.0)).when((base > 0) & (F.col("candidate_weight") > 0), (zero("differs") + extra) / F.nullif(base, F.lit(0.0)))
    overlap = F.when(F.col("_profiled").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), zero("joint") / F.col("candidate_weight")))
    out = rows.select("molecule", "architecture", distance.alias("distance"), overlap.alias("overlap")).where("distance is not null")
    return out.withColumn("score", F.col("distance") + MISSING_PENALTY * (1 - F.col("overlap")))


def pattern_scores(signed: DataFrame, observations: DataFrame, candidates: DataFrame, profiles: DataFrame, weights: DataFrame) -> DataFrame:
    """`scores` with molecules of equal observations scored once; the classes' scores are written, so that a small table of them is
    broadcast to the molecules and the result needs no shuffle."""
    alike, few, seen = classes(signed, observations)
    first = signed.join(few, "molecule", "left_semi")
    scored = _cut(scores(first, seen, candidates, profiles, weights).withColumnRenamed("molecule", "first"))
    return alike.join(scored, "first").drop("first")


def assigned(signed: DataFrame, scored: DataFrame, config: Config) -> DataFrame:
    """molecule, status (ASSIGNED, AMBIGUOUS, UNASSIGNED), architecture, candidates, distance, overlap, score, confidence."""
    fits = (F.col("distance") <= config.architecture_max_distance) & (F.col("overlap") >= config.architecture_min_overlap_fraction)
    ranked = scored.groupBy("molecule").agg(F.array_sort(F.collect_list(F.struct("score", "architecture", "distance", "overlap", fits.alias("fits")))).alias("all"))
    best, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    margin = config.architecture_ambiguity_margin
    near = F.filter("all", lambda x: x["fits"] & (x["score"] - best["score"] <= margin))
    good = F.coalesce(best["fits"], F.lit(False))
    twice = F.coalesce(second["fits"] & (second["score"] - best["score"] <= margin), F.lit(False))
    status = F.when(~good, "UNASSIGNED").when(twice, "AMBIGUOUS").otherwise("ASSIGNED")
    gap = F.least(F.lit(1.0), (second["score"] - best["score"]) / max(margin, 1e-12))
    # a candidate that could not be compared is as far as can be
    separation = F.when(second.isNotNull(), gap).otherwise(F.lit(1.0))
    rows = signed.select("molecule").join(ranked, "molecule", "left")
    sure = status == "ASSIGNED"
    return rows.select(
        "molecule",
        status.alias("status"),
        F.when(sure, best["architecture"]).alias("architecture"),
        F.when(status == "AMBIGUOUS", F.transform(near, lambda x: x["architecture"])).otherwise(F.array().cast("array<string>")).alias("candidates"),
        F.when(good, best["distance"]).alias("distance"),
        F.when(good, best["overlap"]).alias("overlap"),
        F.when(good, best["score"]).alias("score"),
        F.when(sure, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - best["distance"]) * best["overlap"] * separation))).otherwise(0.0).alias("confidence"),
    )


def member_profiles(members: DataFrame, observations: DataFrame, config: Config) -> DataFrame:
    """Each candidate's events that enough of its members are callable at, with the share that shows them."""
    own = members.select("architecture", "molecule", *(c for c in members.columns if c == "n"))
    rows = event_profile(observations.join(own, "molecule"), "architecture", config, "n" if "n" in own.columns else None)
    return rows.where("fraction is not null")


def classes(molecules: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Molecules with the same observations are one class, named by the smallest: (molecule, first) of all, (molecule, n) and
    (molecule, event, state) of the classes. Observations are shuffled once, by molecule; the classes are counted first."""
    own = observations.select("molecule", "event", "state", F.lit(True).alias("_seen"))
    every = molecules.select("molecule").distinct().join(own, "molecule", "left")
    seen = F.array_sort(F.collect_list(F.when(F.col("_seen"), F.struct("event", "state"))))
    listed = every.groupBy("molecule").agg(seen.alias("seen"))
    listed = _cut(listed.withColumn("pattern", F.unhex(F.sha2(F.to_json("seen"), 256))))
    counted = _cut(listed.groupBy("pattern").agg(F.min("molecule").alias("first"), F.count("*").alias("n")))
    alike = listed.select("molecule", "pattern").join(counted.select("pattern", "first"), "pattern").select("molecule", "first")
    few = counted.select(F.col("first").alias("molecule"), "n")
    shown = _cut(listed.join(few, "molecule", "left_semi").select("molecule", F.explode("seen").alias("o")).select("molecule", "o.*"))
    return alike, few, shown


def _no_scores(signed: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return signed.select("molecule", F.lit("").alias("architecture"), *(none.alias(c) for c in ("distance", "overlap", "score"))).where("false")


def infer(molecules: DataFrame, observations: DataFrame, weights: DataFrame, config: Config, callability: DataFrame | None = None) -> Inference:
    """Architectures of eligible molecules (molecule) from their observations (molecule, event, state) and the events'
    weights (event, weight). With fewer molecules or no seed with support, all are UNASSIGNED. `callability` (molecule,
    callable_fraction) adds the median of an architecture's members to its summary."""
    alike, few, observations = classes(molecules, observations)
    signed = _cut(signatures(few, observations).join(few, "molecule"))
    spread = lambda rows: alike.join(rows.drop("n").withColumnRenamed("molecule", "first"), "first").drop("first")
    nothing = lambda: spread(assigned(signed, _no_scores(signed), config))
    if (few.agg(F.sum("n")).first()[0] or 0) < config.min_architecture_molecules:
        return Inference("INSUFFICIENT_ELIGIBLE_MOLECULES", ["INSUFFICIENT_INDEPENDENT_MOLECULE_SUPPORT"], None, nothing())
    members = _cut(seeds(signed, config))
    if members.isEmpty():
        return Inference("NO_SUPPORTED_SEEDS", ["NO_SIGNATURE_REACHED_MINIMUM_SUPPORT"], None, nothing())
    candidates = _cut(members.select("architecture", "signature").distinct())
    stable = False
    for _ in range(ROUNDS):
        profiles = _cut(member_profiles(members, observations, config))
        judged = assigned(signed, scores(signed, observations, candidates, profiles, weights), config)
        result = _cut(judged.join(few, "molecule"))
        enough = result.where("status = 'ASSIGNED'").groupBy("architecture").agg(F.sum("n").alias("n")).where(F.col("n") >= config.min_architecture_molecules)
        kept = _cut(candidates.join(enough.select("architecture"), "architecture", "left_semi"))
        if kept.isEmpty():
            return Inference("NO_STABLE_ARCHITECTURES", ["ASSIGNMENTS_DID_NOT_RETAIN_MINIMUM_SUPPORT"], None, nothing())
        names = F.broadcast(kept.agg(F.collect_list("architecture").alias("_kept")))  # as many as the limit allows
        result = _without_dropped(result.crossJoin(names))
        now = _cut(result.where("status = 'ASSIGNED'").select("architecture", "molecule", "n").join(kept, "architecture"))
        was, is_ = members.select("architecture", "molecule"), now.select("architecture", "molecule")
        stable = was.exceptAll(is_).isEmpty() and is_.exceptAll(was).isEmpty()
        members, candidates = now, kept
        if stable:
            break
    flags = [] if stable else ["MAXIMUM_ASSIGNMENT_ITERATIONS_REACHED"]
    result = spread(_cut(result))
    return Inference("CANDIDATES_INFERRED" if stable else "CANDIDATES_INFERRED_WITH_WARNING", flags, summary(members, result, observations, config, callability), result)


def _without_dropped(rows: DataFrame) -> DataFrame:
    """Assignments to candidates that lost their support are taken back; fewer than two left are no ambiguity."""
    gone = (F.col("status") == "ASSIGNED") & ~F.array_contains("_kept", F.col("architecture"))
    left = F.array_intersect("candidates", "_kept")
    status = F.when(gone | ((F.col("status") == "AMBIGUOUS") & (F.size(left) < 2)), "UNASSIGNED").otherwise(F.col("status"))
    fields = {"status": status, "architecture": F.when(~gone, F.col("architecture")), "candidates": left, "confidence": F.when(gone, 0.0).otherwise(F.col("confidence"))}
    return rows.select(*(fields.get(c, F.col(c)).alias(c) for c in rows.columns if c != "_kept"))


def summary(members: DataFrame, assignments: DataFrame, observations: DataFrame, config: Config, callability: DataFrame | None = None) -> DataFrame:
    """architecture, members, fraction and its interval, mean and least confidence, five representatives, defining and
    optional events, median_callable_fraction (the true median; null without `callability`)."""
    eligible = assignments.agg(F.count("*").alias("eligible"))
    rows = assignments.where("status = 'ASSIGNED'").groupBy("architecture").agg(F.count("*").alias("members"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"))
    order = Window.partitionBy("architecture").orderBy(F.desc("confidence"), "molecule")
    first = assignments.where("status = 'ASSIGNED'").withColumn("_n", F.row_number().over(order)).where("_n <= 5")
    first = first.groupBy("architecture").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "molecule"))), lambda x: x["molecule"]).alias("representatives"))
    share = member_profiles(members, observations, config)
    optional = ~F.col("expected_alternate") & (F.col("alternate") > 0) & (F.col("fraction") >= config.architecture_optional_fraction)
    lists = share.groupBy("architecture").agg(F.array_sort(F.collect_list(F.when(F.col("expected_alternate"), F.col("event")))).alias("defining"), F.array_sort(F.collect_list(F.when(optional, F.col("event")))).alias("optional"))
    low, high = stats.wilson(F.col("members"), F.col("eligible"))
    rows = rows.crossJoin(F.broadcast(eligible)).withColumn("fraction", F.col("members") / F.col("eligible")).withColumn("ci_low", low).withColumn("ci_high", high)
    if callability is None:
        middle = rows.select("architecture", F.lit(None).cast("double").alias("median_callable_fraction"))
    else:
        shares = assignments.where("status = 'ASSIGNED'").select("architecture", "molecule").join(callability, "molecule")
        middle = shares.groupBy("architecture").agg(F.median("callable_fraction").alias("median_callable_fraction"))
    return reduce(lambda a, b: a.join(b, "architecture", "left"), (rows.drop("eligible"), first, lists, middle))

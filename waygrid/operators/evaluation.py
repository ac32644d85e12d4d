"""Accuracy measures over verification evidence: one pass over rows, any threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.capture import texture_bucket
from ..functions.geometry import LOCATION_TOLERANCE_M
from .ordered import scan

# Acceptance limits and the sweep grid.
MIN_MATCHES = 15
INLIER_RATIO = 0.5
MIN_SPREAD = 0.0
SWEEP_THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
PR_STEPS = 20


def inlier_evidence(matches: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """Evidence per pair from match rows.

    ``matches``: query_id, candidate_id, inlier, qx, qy, cx, cy, q_width, q_height,
    c_width, c_height. Too few matches give zeros.
    """
    span = lambda v, size: (
        F.max(F.when(F.col("inlier"), F.col(v))) - F.min(F.when(F.col("inlier"), F.col(v)))
    ) / F.greatest(F.max(size) - 1, F.lit(1))
    agg = matches.groupBy("query_id", "candidate_id").agg(
        F.count("*").alias("num_matches"), F.count_if(F.col("inlier")).alias("n_in"),
        F.least(span("qx", "q_width"), span("qy", "q_height"), span("cx", "c_width"), span("cy", "c_height")).alias("span"))
    enough = F.col("num_matches") >= min_matches
    return agg.select(
        "query_id", "candidate_id", "num_matches",
        F.when(enough, F.col("n_in")).otherwise(0).alias("num_inliers"),
        F.when(enough, F.col("n_in") / F.col("num_matches")).otherwise(0.0).alias("inlier_ratio"),
        F.when(enough, F.coalesce("span", F.lit(0.0))).otherwise(0.0).alias("inlier_spread"))


def _status(error: Column) -> Column:
    return F.when(error.isNull(), "no_match").when(error <= LOCATION_TOLERANCE_M, "correct").otherwise("wrong_location")


def _passes(threshold, min_matches: int, min_spread: float) -> Column:
    return (
        (F.col("num_matches") >= min_matches) & (F.col("inlier_ratio") >= threshold)
        & (F.col("inlier_spread") >= min_spread)
    )


def resolve_at_threshold(
    evidence: DataFrame, queries: DataFrame, threshold: float = INLIER_RATIO, min_matches: int = MIN_MATCHES,
    min_spread: float = MIN_SPREAD,
) -> DataFrame:
    """The first candidate by rank that passes decides; none gives ``no_match``."""
    won = F.struct("candidate_id", "error_m", "inlier_ratio")
    first = evidence.where(_passes(threshold, min_matches, min_spread)).groupBy("query_id").agg(
        F.min_by(won, "rank").alias("won"))
    out = queries.select("query_id").join(first, "query_id", "left")
    return out.select(
        "query_id", _status(F.col("won.error_m")).alias("status"),
        F.col("won.candidate_id").alias("matched_id"), F.col("won.error_m").alias("error_m"),
        F.col("won.inlier_ratio").alias("inlier_ratio"))


def eval_summary(resolved: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    rate = lambda s: F.avg(F.when(is_(s), 1.0).otherwise(0.0))
    hit = F.when(is_("correct"), F.col("inlier_ratio"))
    return resolved.agg(
        F.count("*").alias("total"),
        F.count_if(is_("correct")).alias("correct"), F.count_if(is_("wrong_location")).alias("wrong_location"),
        F.count_if(is_("no_match")).alias("no_match"), rate("correct").alias("correct_rate"),
        F.avg(hit).alias("inlier_mean"), F.min(hit).alias("inlier_min"), F.max(hit).alias("inlier_max"))


def threshold_sweep(
    evidence: DataFrame, queries: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    primary: float = INLIER_RATIO, min_matches: int = MIN_MATCHES, min_spread: float = MIN_SPREAD,
) -> DataFrame:
    """Outcome counts at every threshold, from one pass over the evidence.

    A query's outcome only depends on its passing candidates, so each query is reduced
    to one row with the winner per threshold before anything is counted.
    """
    ts = sorted({round(float(t), 2) for t in thresholds} | {INLIER_RATIO, primary})
    won = F.struct("rank", "error_m")
    per_query = evidence.groupBy("query_id").agg(*[
        F.min(F.when(_passes(t, min_matches, min_spread), won))["error_m"].alias(f"t{i}") for i, t in enumerate(ts)])
    count = lambda i, s: F.count_if(_status(F.col(f"t{i}")) == s)
    wide = per_query.agg(*[
        F.struct(F.lit(t).alias("threshold"), count(i, "correct").alias("correct"),
                 count(i, "wrong_location").alias("wrong_location")).alias(f"r{i}") for i, t in enumerate(ts)])
    rows = wide.select(F.inline(F.array(*[f"r{i}" for i in range(len(ts))])))
    total = queries.agg(F.count("*").alias("total"))
    # both sides are single aggregates turned into at most a few dozen rows
    rows = rows.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return rows.select(
        "threshold", "correct", "wrong_location",
        (F.col("total") - F.col("correct") - F.col("wrong_location")).alias("no_match"),
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("correct_rate"))


def evidence_separation(evidence: DataFrame) -> DataFrame:
    """Inlier ratio and spread of same-place and other-place candidates."""
    own = F.col("error_m") <= LOCATION_TOLERANCE_M
    cols = []
    for name, cond in (("genuine", own), ("impostor", ~own)):
        cols.append(F.count_if(cond).alias(f"{name}_count"))
        for short, c in (("", "inlier_ratio"), ("spread_", "inlier_spread")):
            v = F.when(cond, F.col(c))
            cols += [F.avg(v).alias(f"{name}_{short}mean"), F.stddev_pop(v).alias(f"{name}_{short}std")]
    return evidence.agg(*cols).withColumn("mean_gap", F.col("genuine_mean") - F.col("impostor_mean"))


def confusion_pairs(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Wrong matches rolled up by (true place, matched place)."""
    side = lambda key, name: records.select(F.col("image_id").alias(key), F.col("location_id").alias(name))
    wrong = resolved.where("status = 'wrong_location'")
    return (
        wrong.join(side("query_id", "true_location"), "query_id").join(side("matched_id", "matched_location"), "matched_id")
        .groupBy("true_location", "matched_location")
        .agg(F.count("*").alias("n"), F.avg("error_m").alias("mean_error_m"))
    )


def per_location_breakdown(resolved: DataFrame, records: DataFrame) -> DataFrame:
    r = records.select(F.col("image_id").alias("query_id"), "floor", "zone",
                       F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"))
    return resolved.join(r, "query_id").groupBy("floor", "zone", "x", "y").agg(
        F.count_if(F.col("status") == "correct").alias("correct"), F.count("*").alias("n"))


def latency_stats(df: DataFrame, value: str, by: Sequence[str] = (), share: float = 0.95, parts: int | None = None) -> DataFrame:
    """Mean, exact percentile (between the two nearest ranks, as ``percentile`` does) and maximum; nulls do not count.

    Equal values are counted first; the counts are summed up in order of value over range partitions, and the two values
    whose ranks are asked for are picked from them. No task sees all values of a group.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    groups = df.groupBy(*by).agg(F.avg(value).alias("mean_ms"), F.count(value).alias("_all"), F.max(value).alias("max_ms"))
    renamed = groups.select(*[F.col(k).alias(f"_on_{k}") for k in by], ((F.col("_all") - 1) * share).alias("_rank"))
    upto = scan(counts, by, ["_v"], {"_upto": F.col("_n")}, parts=parts)
    same = F.lit(True)
    for k in by:
        same = same & upto[k].eqNullSafe(renamed[f"_on_{k}"])
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v").cast("double")))
    low, high = F.floor("_rank"), F.ceil("_rank")
    picked = upto.join(renamed, same).groupBy(*by).agg(at(low).alias("_a"), at(high).alias("_b"), F.first("_rank").alias("_rank"))
    picked = picked.select(*[F.col(k).alias(f"_on_{k}") for k in by], (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))).alias("p95_ms"))
    same = F.lit(True)
    for k in by:
        same = same & groups[k].eqNullSafe(picked[f"_on_{k}"])
    return groups.join(picked, same, "left").select(*by, "mean_ms", "p95_ms", "max_ms")


def _counts(is_true: Column, hit: Column) -> dict[str, Column]:
    return {"tp": F.count_if(is_true & hit), "fn": F.count_if(is_true & ~hit),
            "fp": F.count_if(~is_true & hit), "tn": F.count_if(~is_true & ~hit)}


def verifier_confusion(pairs: DataFrame, threshold: float = INLIER_RATIO) -> DataFrame:
    """Confusion counts and rates; a rate with an empty denominator is NULL."""
    c = _counts(F.col("is_true_match"), F.col("inlier_ratio") >= threshold)
    got = pairs.agg(*[v.alias(k) for k, v in c.items()])
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return got.withColumns({"true_positive_rate": rate("tp", "fn"), "false_positive_rate": rate("fp", "tn"),
                            "precision": rate("tp", "fp")})


def pr_sweep(pairs: DataFrame, steps: int = PR_STEPS) -> DataFrame:
    """Precision and recall at evenly spaced thresholds 0..1.

    Pairs are first counted per highest threshold they pass, so the sweep itself works on
    ``steps + 1`` rows.
    """
    top = F.least(F.floor(F.round(F.col("inlier_ratio") * steps, 9)), F.lit(steps))
    binned = pairs.where("inlier_ratio >= 0").groupBy(top.alias("bin")).agg(
        F.count_if("is_true_match").alias("t"), F.count_if(~F.col("is_true_match")).alias("f"))
    hist = binned.agg(F.collect_list(F.struct("bin", "t", "f")).alias("bins"))
    all_true = pairs.agg(F.count_if("is_true_match").alias("positives"))
    hist = hist.withColumn("_k", F.lit(1)).join(all_true.withColumn("_k", F.lit(1)), "_k")
    rows = hist.select("positives", "bins", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    above = lambda field: F.aggregate(
        F.filter("bins", lambda b: b["bin"] >= F.col("i")), F.lit(0).cast("long"), lambda s, b: s + b[field])
    rows = rows.select((F.col("i") / steps).alias("threshold"), above("t").alias("tp"), above("f").alias("fp"), "positives")
    return rows.select(F.bround("threshold", 3).alias("threshold"),
                       F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                       F.try_divide(F.col("tp"), F.col("positives")).alias("recall"))


def best_f1(sweep: DataFrame) -> DataFrame:
    """Sweep row with the highest F1; the lowest threshold wins ties."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(-1.0)
    scored = sweep.where(p.isNotNull() & r.isNotNull()).withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.round("f1", 12), -F.col("threshold")))
    return scored.agg(best.alias("b")).where("b is not null").select("b.*")


def by_texture(pairs: DataFrame, keypoints: str = "keypoints", threshold: float = INLIER_RATIO) -> DataFrame:
    c = _counts(F.col("is_true_match"), F.col("inlier_ratio") >= threshold)
    g = pairs.groupBy(texture_bucket(keypoints).alias("bucket")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in c.items()])
    rate = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return g.select("bucket", "n", rate("tp", "fn").alias("true_positive_rate"), rate("fp", "tn").alias("false_positive_rate"))


def leaderboard(reports: DataFrame) -> DataFrame:
    """Methods by recall@1, best first."""
    return reports.orderBy(F.desc("recall_at_1"), "method")

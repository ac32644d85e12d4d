"""Session reports, miss analysis and client events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.capture import age_days
from ..functions.geometry import LOCATION_TOLERANCE_M
from .ordered import numbered

# Report warning limits.
LOW_MATCH_RATE, FEW_POSITIONS, FEW_MATCHES, SLOW_MS = 0.7, 5, 10, 1500


def live_log_summary(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """One report row per session.

    ``rows``: source, tracking (bool), latency_ms, confidence, x, y, steps_since_fix, drift_m.
    """
    vpr = F.col("source").isin("VPR", "VPR_MISS")
    hit, pdr = vpr & F.col("tracking"), F.col("source") == "PDR"
    spot = F.struct(F.bround("x", 1).alias("x"), F.bround("y", 1).alias("y"))
    # distinct positions are counted per (session, position) first: no per-session sets
    per_spot = rows.where(hit).groupBy(key, spot.alias("spot")).agg(F.lit(1).alias("one"))
    distinct = per_spot.groupBy(key).agg(F.count("*").alias("distinct_positions"))
    g = rows.groupBy(key).agg(
        F.count_if(vpr).alias("attempts"), F.count_if(hit).alias("matched"), F.avg(F.when(vpr, F.col("latency_ms"))).alias("avg_latency_ms"),
        F.max(F.when(vpr, F.col("latency_ms"))).alias("max_latency_ms"), F.avg(F.when(hit, F.col("confidence"))).alias("avg_confidence"),
        F.count_if(pdr).alias("step_updates"), F.max(F.when(pdr, F.col("steps_since_fix"))).alias("max_steps_between_fixes"),
        F.avg(F.when(hit, F.col("drift_m"))).alias("avg_drift_m"), F.max(F.when(hit, F.col("drift_m"))).alias("max_drift_m"),
    ).where("attempts > 0").join(distinct, key, "left").fillna(0, ["distinct_positions"])
    rate = F.col("matched") / F.col("attempts")
    low, few, slow = rate < LOW_MATCH_RATE, (F.col("distinct_positions") <= FEW_POSITIONS) & (F.col("matched") > FEW_MATCHES), F.col("avg_latency_ms") > SLOW_MS
    return g.withColumns({"match_rate": rate, "warn_match_rate": low, "warn_few_positions": few, "warn_latency": slow,
                          "no_red_flags": ~low & (F.col("distinct_positions") > FEW_POSITIONS) & ~slow})


def top_positions(rows: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent rounded positions."""
    return rows.groupBy(F.bround("x", 1).alias("x"), F.bround("y", 1).alias("y")).agg(F.count("*").alias("times")).orderBy(
        F.desc("times"), "x", "y").limit(n)


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def blur_skips(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event") == "frame_skipped_blur").alias("blur_skips"))


def ground_truth_retrieved(misses: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Per miss with a known place: was it among the candidates, by id or within half a metre?

    ``misses``: miss_id, truth_location. ``candidates``: miss_id, location_id, x, y. A place
    is reduced to its distinct record positions, cell-joined to the candidates.
    """
    known = misses.where("truth_location is not null").select("miss_id", "truth_location")
    cand = candidates.join(known, "miss_id")
    by_id = cand.where(F.col("location_id") == F.col("truth_location")).select("miss_id")
    r = LOCATION_TOLERANCE_M
    cell = lambda c: F.floor(F.col(c) / r)
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    spots = records.select(F.col("location_id").alias("truth_location"), F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    spots = spots.withColumn("dx", near).withColumn("dy", near).withColumns({"gx": cell("rx") + F.col("dx"), "gy": cell("ry") + F.col("dy")})
    by_place = cand.withColumns({"gx": cell("x"), "gy": cell("y")}).join(spots, ["truth_location", "gx", "gy"]).where(
        F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")) <= r).select("miss_id")
    hit = by_id.unionByName(by_place).distinct().withColumn("hit", F.lit(True))
    return known.join(hit, "miss_id", "left").select("miss_id", F.coalesce("hit", F.lit(False)).alias("retrieved"))


def failure_stage(n_candidates: Column, truth: Column, retrieved: Column) -> Column:
    known = F.coalesce(truth.cast("string"), F.lit("")) != ""
    return (F.when(n_candidates == 0, "no_candidates").when(known & ~F.coalesce(retrieved, F.lit(False)), "retrieval_failure")
            .when(known, "verification_rejection").otherwise("verification_rejected_ground_truth_unknown"))


def classify_misses(misses: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    got = ground_truth_retrieved(misses, candidates, records)
    n = candidates.groupBy("miss_id").agg(F.count("*").alias("candidate_count"))
    out = misses.join(n, "miss_id", "left").join(got, "miss_id", "left").fillna(0, ["candidate_count"])
    return out.withColumn("failure_stage", failure_stage(F.col("candidate_count"), F.col("truth_location"), F.col("retrieved")))


def candidate_vs_reference(misses: DataFrame, records: DataFrame) -> DataFrame:
    """Each miss's candidates next to their reference photo.

    ``misses``: miss_id, received_at, truth_location, candidates ARRAY<STRUCT(image_id,
    location_id, rank, similarity, timestamp)>. ``records``: image_id, quality columns.
    """
    c = misses.select("miss_id", "received_at", "truth_location", F.explode("candidates").alias("c"))
    flat = c.select("miss_id", "received_at", "truth_location", "c.*")
    tag = F.when(F.col("truth_location").isNull(), F.lit(None)).when(
        F.col("location_id") == F.col("truth_location"), "ground-truth location").otherwise("other location")
    return flat.join(records, "image_id", "left").withColumns({"tag": tag, "age_days": age_days("received_at", "timestamp")})


def first_n_samples(rows: DataFrame, n: int, keys=("site_id",), order=("t", "event_id"), newest: bool = False) -> DataFrame:
    """The first (or latest) n rows per key: a sampling limit, the rows themselves all stay logged."""
    w = Window.partitionBy(*keys).orderBy(*[(F.desc if newest else F.asc)(c) for c in order])
    return rows.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


def strided_sample(rows: DataFrame, size: int, order, keys=(), **slicing) -> DataFrame:
    """Every (count / size)-th row per key in order, at most ``size`` of them."""
    keys = list(keys)
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    if keys:
        src = rows.join(total, keys)
    else:
        src = rows.withColumn("_n", F.lit(total.first()["_n"]))
    r = numbered(src, keys, list(order), "_i", **slicing)
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / size))
    place = F.col("_i") - 1
    return r.where((place % step == 0) & (place / step < size)).drop("_n", "_i")

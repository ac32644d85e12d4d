"""Streams give the rows of their batch twins."""

import tempfile

from pyspark.sql import functions as F

from waygrid.operators.ordered import fold_ordered
from waygrid.streaming import drift, machines as M, pipelines as P

ROUTE = "array(struct(0e0 AS x, 0e0 AS y), struct(20e0 AS x, 0e0 AS y), struct(20e0 AS x, 20e0 AS y))"


def walk(spark, n=60, devices=3):
    rows = [(d, d * 1000 + i, i) for d in range(devices) for i in range(n)]
    df = spark.createDataFrame(rows, "device_id long, event_id long, i int")
    return df.withColumns({
        "ts": F.timestamp_millis(F.lit(1_700_000_000_000).cast("long") + F.col("i") * 500), "t": (F.col("i") * 500).cast("double"),
        "x": F.col("i") * 0.5, "y": F.when(F.col("device_id") == 1, F.col("i") * 0.2).otherwise(0.1), "heading": F.lit(90.0),
        "kind": F.when(F.col("i") % 20 == 0, "b_fix").otherwise("a_pose"), "matched": F.lit(True), "confidence": F.lit(0.8), "floor": F.lit("G"),
        "route": F.expr(ROUTE)}).drop("i")


def files(df, parts=4):
    """The rows as a folder of files, oldest first, one file per micro-batch."""
    folder = tempfile.mkdtemp(prefix="waygrid-st-")
    times = sorted({r[0] for r in df.select("ts").collect()})
    step = max(1, len(times) // parts)
    for k in range(0, len(times), step):
        df.where(F.col("ts").isin(times[k:k + step])).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, make, df, name, flush):
    """Drain a stream; ``flush`` moves the watermark past everything."""
    folder = files(df)
    late = df.limit(1).withColumns({"device_id": F.lit(999).cast("long"), "ts": F.lit(flush).cast("timestamp")})
    late.coalesce(1).write.mode("append").parquet(folder)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(src).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="waygrid-cp-")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def rows(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect() if r[0] != 999)


def test_smoothed_fuser_stream_equals_batch(spark):
    df = walk(spark)
    cols = ["device_id", "event_id", "x", "y", "confidence"]
    keep = df.drop("route", "t")
    got = run(spark, lambda s: P.stream_machine(s, M.smooth_fix, M.SMOOTH_SCHEMA, order=("kind", "event_id")), keep, "smooth_out", "2023-11-15 12:00:00")
    want = fold_ordered(df.drop("route", "ts"), ["device_id"], ["t", "kind", "event_id"], M.smooth_fix, M.SMOOTH_SCHEMA)
    assert rows(got, cols) == rows(want, cols)


def test_drift_stream_equals_batch(spark):
    df = walk(spark)
    cols = ["device_id", "event_id", "state", "kind", "reroute"]
    got = run(spark, lambda s: P.stream_machine(s, drift.detect_drift, drift.DRIFT_SCHEMA), df, "drift_out", "2023-11-15 12:00:00")
    want = fold_ordered(df.drop("ts"), ["device_id"], ["t", "event_id"], drift.detect_drift, drift.DRIFT_SCHEMA)
    key = lambda rs: sorted((tuple(str(v) for v in r) for r in rs))
    pick = lambda d: key(r for r in d.select(*cols).collect() if r[0] != 999)
    assert pick(got) == pick(want)
    assert any(r[2] == "rerouting" for r in pick(want))


def test_live_devices_expire_and_end(spark):
    base = 1_700_000_000_000
    data = [(1, base, "fix"), (1, base + 100_000, "heartbeat"), (2, base, "fix"), (2, base + 5_000, "end"), (3, base, "heartbeat")]
    df = spark.createDataFrame(data, "device_id long, ms long, event string").select("device_id", F.timestamp_millis("ms").alias("ts"), "event")
    got = run(spark, lambda s: P.live_device_changes(s, 300.0), df, "live_out", "2023-11-15 12:00:00")
    assert rows(got, ["device_id", "at_ms", "change"]) == [(1, base, "live"), (1, base + 400_000, "expired"), (2, base, "live"), (2, base + 5_000, "ended")]


def test_counts_sessions_and_duplicates(spark):
    base = 1_700_000_000_000
    data = [(1, 1, base, "a"), (1, 2, base + 60_000, "a"), (1, 2, base + 60_000, "a"), (1, 3, base + 900_000, "b")]
    df = spark.createDataFrame(data, "device_id long, event_id long, ms long, event_type string").select(
        "device_id", "event_id", F.timestamp_millis("ms").alias("ts"), "event_type")
    flush = "2023-11-16 12:00:00"
    counts = run(spark, lambda s: P.event_counts(s, size="30 minutes"), df, "count_out", flush)
    assert sorted(r["n"] for r in counts.collect())[:2] == [1, 3] or sum(r["n"] for r in counts.where("event_type = 'a'").collect()) == 3
    ses = run(spark, lambda s: P.device_sessions(s, "300 seconds"), df, "session_out", flush)
    assert sorted(r["events"] for r in ses.where("device_id = 1").collect()) == [1, 3]
    once = run(spark, lambda s: P.dedupe_events(s, ["device_id", "event_id"]), df, "dedupe_out", flush)
    assert once.where("device_id = 1").count() == 3


def test_miss_stream(spark):
    rec = spark.createDataFrame([("A", 0.0, 0.0), ("B", 9.0, 9.0)], "location_id string, x double, y double")
    data = [(1, "A", [("A", 5.0, 5.0)]), (2, "B", [("A", 9.2, 9.1)]), (3, "B", [("A", 0.0, 0.0)]), (4, None, [("A", 0.0, 0.0)]), (5, "A", [])]
    m = spark.createDataFrame(data, "miss_id long, truth_location string, candidates array<struct<location_id:string,x:double,y:double>>")
    got = {r[0]: r[1] for r in P.classify_miss_stream(m, rec).select("miss_id", "failure_stage").collect()}
    assert got == {1: "verification_rejection", 2: "verification_rejection", 3: "retrieval_failure",
                   4: "verification_rejected_ground_truth_unknown", 5: "no_candidates"}

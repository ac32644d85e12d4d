"""Queries: the event table run as a stream into files, then read back.

In append mode a result appears once the watermark has passed it, so the newest rows
(within the delay) are still open when the input ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trajectory import SEED_CONFIDENCE
from ..streaming import machines as M
from ..streaming import pipelines as P
from .catalog import query, rounded
from .q_sources import scratch
from .q_trajectory import FUSED
from .views import SIMPLE

DELAY = "10 minutes"


def event_stream(t):
    # a file stream watches a folder: the table's own, or, where the table is one file, that around it
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/events.parquet")
    folder = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = t.spark.readStream.schema(t.events.schema)
    rows = reader.parquet(f"{t.dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(t, df, name: str):
    out = scratch(t, name)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("event_counts_stream", """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def _(t):
    c = drained(t, P.event_counts(event_stream(t), delay=DELAY), "counts")
    return c.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("device_sessions_stream", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS st FROM events),
n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id AS device_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def _(t):
    e = event_stream(t).withColumnRenamed("user_id", "device_id")
    s = drained(t, P.device_sessions(e, "1 hour", delay=DELAY), "sessions")
    return s.select("device_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("dedupe_events_stream", "SELECT event_id FROM events")
def _(t):
    # every event arrives twice
    e = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drained(t, P.dedupe_events(e, ["event_id"], delay=DELAY), "once").select("event_id")


CLOSED = "epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events) - 600000"  # the watermark has passed them


def fixes_stream(t):
    e = event_stream(t).selectExpr(*SIMPLE["v_points"][1])
    trust = F.when(F.col("source") == "SEED", SEED_CONFIDENCE).otherwise(F.col("confidence"))
    return e.select("event_id", "device_id", "ts", "x", "y", "floor", "heading", trust.alias("confidence"), F.when(F.col("source") == "PDR", "a_pose").otherwise("b_fix").alias("kind"),
                    F.col("source").isin("VPR", "SEED").alias("matched"))


@query("fuse_positions_stream", f"""WITH {FUSED} SELECT z.device_id, z.event_id, coalesce(k_floor, '1') AS floor, round(CASE WHEN moved THEN ox + x*cos(radians(turn)) - y*sin(radians(turn)) ELSE x END, 5) AS x,
  round(CASE WHEN moved THEN oy + x*sin(radians(turn)) + y*cos(radians(turn)) ELSE y END, 5) AS y, CASE WHEN moved THEN mod(heading + turn, 360) ELSE mod(heading, 360) END AS heading,
  round(CASE WHEN kind = 'b_fix' THEN confidence ELSE greatest(coalesce(conf, 0) * power(98e-2, n_pose - coalesce(n, 0)), 1e-1) END, 5) AS confidence
  FROM z JOIN (SELECT event_id FROM events WHERE {CLOSED}) USING (event_id)""")
def _(t):
    return rounded(drained(t, P.stream_machine(fixes_stream(t), M.reset_fix, M.RESET_SCHEMA, order=("kind", "event_id"), delay=DELAY), "fused"), 5)


@query("fuse_positions_smoothed_stream")
def _(t):
    return rounded(drained(t, P.stream_machine(fixes_stream(t), M.smooth_fix, M.SMOOTH_SCHEMA, order=("kind", "event_id"), delay=DELAY), "smoothed"))


@query("live_devices_stream")
def _(t):
    kind = F.when(F.col("event_type") == "error", "end").when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "pose").otherwise("fix")
    e = event_stream(t).select(F.col("user_id").alias("device_id"), "ts", kind.alias("event"))
    return drained(t, P.live_device_changes(e, 3600.0, delay=DELAY), "live")

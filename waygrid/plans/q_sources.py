"""Queries: files written from the tables and read back, snapshots, registries, streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import registry as X
from ..session import shared_dir
from ..sources import files as S
from ..sources import snapshots
from .catalog import query, rounded
from .q_evaluation import EVIDENCE, evidence
from .q_retrieval import SIMS


def scratch(t, name: str) -> str:
    """A fresh folder in the shared directory."""
    return os.path.join(shared_dir(t.spark), "io", f"{name}-{uuid.uuid4().hex[:12]}")


@query("read_reference_images", "SELECT CAST(image_id AS VARCHAR) AS image_id, CASE WHEN image_id % 4 = 0 THEN '1' ELSE floor END AS floor, x, y, CASE WHEN image_id % 3 = 0 THEN '' ELSE CAST(location_id AS VARCHAR) END AS location_id FROM v_images")
def _(t):
    p = scratch(t, "images")
    rec = t.v_images.select(F.col("image_id").cast("string").alias("image_id"), F.when(F.col("image_id") % 4 != 0, F.concat(F.lit(" "), "floor")).alias("floor"), "zone", "x", "y", "orientation",
                            F.when(F.col("image_id") % 3 != 0, F.col("location_id").cast("string")).alias("location_id"))
    half = F.col("image_id").cast("int") < 250
    S.overwrite_reference_images(rec.where(half), p)
    S.append_reference_images(rec.where(~half), p)
    return S.read_reference_images(t.spark, p).select("image_id", "floor", "x", "y", "location_id")


@query("read_locations", "SELECT 'L' || CAST(c_custkey AS VARCHAR) AS location_id, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE 'G' END AS floor, 'Z' AS zone, c_custkey / 4e0 AS x, c_custkey / 8e0 AS y FROM customer")
def _(t):
    p = scratch(t, "locations")
    loc = t.customer.selectExpr("' L' || CAST(c_custkey AS STRING) || ' ' AS location_id", "CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'G' END AS floor", "' Z' AS zone", "c_custkey / 4e0 AS x", "c_custkey / 8e0 AS y")
    S.write_locations(loc, p)
    return S.read_locations(t.spark, p)


@query("read_pixel_csvs", "SELECT CAST(l_partkey % 1000 AS DOUBLE) AS pixel_x, CAST(l_orderkey % 800 AS DOUBLE) AS pixel_y, l_quantity AS real_x, l_tax AS real_y FROM lineitem")
def _(t):
    p = scratch(t, "control")
    t.lineitem.selectExpr("l_tax AS ` real_y`", "l_partkey % 1000 AS `pixel_x `", "l_orderkey % 800 AS pixel_y", "l_quantity AS real_x").write.option("header", True).csv(p)
    return S.read_pixel_csvs(t.spark, p, "control_points")


@query("read_embeddings", "SELECT vec_id AS image_id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, 'v1' AS dataset_version FROM embeddings")
def _(t):
    p = scratch(t, "vectors")
    S.write_embeddings(t.v_images, p, "v1")
    e = S.read_embeddings(t.spark, p, "v1")
    return rounded(e.select("image_id", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v).alias("total"), "dataset_version"), 5)


@query("dataset_fingerprint")
def _(t):
    return S.dataset_fingerprint(t.v_images)


@query("read_site_configs", "SELECT CAST(site_id AS VARCHAR) AS site_id, floor, seg_no, x1, y1, x2, y2, width FROM v_corridors")
def _(t):
    # one YAML text per supplier (JSON is YAML)
    p = scratch(t, "sites")
    seg = t.v_corridors.groupBy("site_id", "floor").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "x1", "y1", "x2", "y2", "width"))), lambda s: F.struct(s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2"), s["width"].alias("width"))).alias("walkable_segments"))
    site = seg.groupBy("site_id").agg(F.collect_list(F.struct("floor", "walkable_segments")).alias("floors"))
    doc = site.select("site_id", F.to_json(F.struct(F.col("site_id").cast("string").alias("site_id"), "floors")).alias("value"))
    doc.repartition("site_id").write.partitionBy("site_id").text(p)
    return S.read_site_configs(t.spark, f"{p}/*/*.txt")["segments"].select("site_id", "floor", "seg_no", "x1", "y1", "x2", "y2", "width")


@query("read_live_log", "SELECT event_id AS step_count, floor, x, y, source, source = 'VPR' AS tracking, latency_ms FROM v_points")
def _(t):
    p = scratch(t, "log")
    cols = ["timestamp", "floor", "x", "y", "heading", "confidence", "tracking", "latency_ms", "trigger", "source", "step_count", "steps_since_fix", "drift_m"]
    log = t.v_points.selectExpr("CAST(ts AS STRING) AS timestamp", "floor", "x", "y", "heading", "confidence", "source = 'VPR' AS tracking", "latency_ms", "'motion' AS trigger", "source", "event_id AS step_count", "0 AS steps_since_fix", "1e0 AS drift_m")
    log.select(*cols).write.option("header", True).csv(p)
    return S.read_live_log(t.spark, p).select("step_count", "floor", "x", "y", "source", "tracking", "latency_ms")


@query("read_misses", "SELECT CAST(image_id AS VARCHAR) AS device_id, 2 AS candidates, image_id / 2e0 AS similarity FROM v_images")
def _(t):
    p = scratch(t, "misses")
    c = F.struct(F.lit(1).alias("rank"), F.col("image_id").cast("string").alias("image_id"), (F.col("image_id") / 2.0).alias("similarity"))
    t.v_images.select(F.col("image_id").cast("string").alias("device_id"), F.array(c, c).alias("candidates")).write.json(p)
    return S.read_misses(t.spark, p).select("device_id", F.size("candidates").alias("candidates"), F.get("candidates", F.lit(0))["similarity"].alias("similarity"))


@query("read_client_events", "SELECT CAST(user_id AS VARCHAR) AS device_id, event_type AS event, CAST(event_id AS BIGINT) AS extra FROM events")
def _(t):
    p = scratch(t, "events")
    t.events.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("event"), F.col("event_id").alias("extra"))).alias("value")).write.text(p)
    return S.read_client_events(t.spark, p).select("device_id", "event", F.try_variant_get("body", "$.extra", "long").alias("extra"))


@query("read_point_cloud", "SELECT round(o_orderkey / 8e0, 4) AS x, o_custkey / 4e0 AS y, 5e-1 AS z, 52 AS r, 199 AS g, 89 AS b FROM orders")
def _(t):
    p = scratch(t, "cloud")
    S.write_point_cloud(t.orders.selectExpr("o_orderkey / 8e0 AS x", "o_custkey / 4e0 AS y", "5e-1 AS z").unionByName(t.orders.selectExpr("double('NaN') AS x", "1e0 AS y", "0e0 AS z")), p)
    return rounded(S.read_point_cloud(t.spark, p), 4)


@query("read_eval_reports", "SELECT CAST(image_id AS VARCHAR) AS image_id, CASE WHEN image_id % 3 = 0 THEN 'no_match' ELSE 'correct' END AS status, CASE WHEN image_id % 3 <> 0 THEN x END AS location_error_m FROM v_images")
def _(t):
    p = scratch(t, "reports")
    r = F.struct(F.col("image_id").cast("string").alias("image_id"), F.when(F.col("image_id") % 3 == 0, "no_match").otherwise("correct").alias("status"), F.when(F.col("image_id") % 3 != 0, F.col("x")).alias("location_error_m"))
    t.v_images.groupBy("location_id").agg(F.collect_list(r).alias("results")).drop("location_id").repartition(10).write.option("maxRecordsPerFile", 1).json(p)
    results, _ = S.read_eval_reports(t.spark, p)
    return results.select("image_id", "status", "location_error_m")


@query("publish_snapshot", "SELECT landmark_id, floor, x FROM v_landmarks WHERE landmark_id % 2 = 1")
def _(t):
    base = scratch(t, "map")
    l = t.v_landmarks.select("landmark_id", "floor", "x")
    snapshots.publish_snapshot(l, base, 1)
    snapshots.publish_snapshot(l.where("landmark_id % 2 = 1"), base, 2)
    return snapshots.read_current(t.spark, base)


@query("per_floor_export", "SELECT session_id AS site_id, floor AS floor_id, count(*) AS n FROM v_landmarks GROUP BY 1, 2")
def _(t):
    p = scratch(t, "floors")
    S.per_floor_export(t.v_landmarks.withColumnsRenamed({"session_id": "site_id", "floor": "floor_id"}), p)
    return t.spark.read.parquet(p).groupBy("site_id", "floor_id").agg(F.count("*").alias("n"))


@query("register_scorer", f"WITH {SIMS} SELECT query_id, candidate_id, rank FROM r WHERE rank <= 3")
def _(t):
    return X.score("cosine", t.v_images, 3).select("query_id", "candidate_id", "rank")


@query("register_evidence", f"WITH {EVIDENCE} SELECT query_id, candidate_id, num_matches FROM e")
def _(t):
    X.register_evidence("derived", lambda: evidence(t))
    return X.evidence("derived").select("query_id", "candidate_id", "num_matches")


@query("embed_with", "SELECT doc_id AS image_id, CAST(length(text) AS DOUBLE) AS chars FROM documents")
def _(t):
    e = X.embed_with(t.documents.select(F.col("doc_id").alias("image_id"), "text"), "text", lambda s: [[len(v), 1.0] for v in s])
    return e.select("image_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"))

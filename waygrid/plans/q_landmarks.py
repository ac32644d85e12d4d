"""Queries: landmark maps and map building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import landmarks as L
from .catalog import query, rounded


@query("filter_landmarks", "SELECT landmark_id, floor, x, y FROM v_landmarks WHERE floor = 'B1' AND sqrt((x-25)*(x-25)+(y-25)*(y-25)) <= 12")
def _(t):
    return L.filter_landmarks(t.v_landmarks, "B1", (25.0, 25.0), 12.0).select("landmark_id", "floor", "x", "y")


@query("prune_landmarks", """SELECT landmark_id, CASE WHEN floor = 'G' AND x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 30 AND landmark_id % 2 = 0 THEN 'deleted' ELSE 'kept' END AS state FROM v_landmarks""")
def _(t):
    ids = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("landmark_id"))
    kept, gone = L.prune_landmarks(t.v_landmarks, "G", ids, (5, 5, 30, 30))
    return kept.select("landmark_id", F.lit("kept").alias("state")).unionByName(gone.select("landmark_id", F.lit("deleted").alias("state")))


@query("exportable_landmarks", "SELECT landmark_id FROM v_landmarks WHERE landmark_id % 7 <> 0 AND landmark_id % 11 <> 0 AND session_id IN (SELECT event_id % 3 + 1 FROM events WHERE event_type <> 'error')")
def _(t):
    l = t.v_landmarks.withColumns({"descriptor": F.when(F.col("landmark_id") % 7 != 0, F.lit("d")), "x": F.when(F.col("landmark_id") % 11 == 0, float("nan")).otherwise(F.col("x"))})
    return L.exportable_landmarks(l, t.events.where("event_type <> 'error'").selectExpr("CAST(event_id % 3 + 1 AS INT) AS session_id")).select("landmark_id")


@query("min_size_gate", "SELECT o_orderkey AS landmark_id FROM orders WHERE (o_custkey % 200) IN (SELECT o_custkey % 200 FROM orders GROUP BY 1 HAVING count(*) >= 80)")
def _(t):
    return L.min_size_gate(t.orders.selectExpr("o_orderkey AS landmark_id", "o_custkey % 200 AS floor")).select("landmark_id")


@query("merge_landmarks", """SELECT landmark_id, x, 'mem' AS src FROM v_landmarks WHERE landmark_id % 3 <> 0 UNION ALL SELECT o_orderkey, -1e0, 'disk' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def _(t):
    mem = t.v_landmarks.where("landmark_id % 3 <> 0").selectExpr("landmark_id", "x", "'mem' AS src")
    return L.merge_landmarks(mem, t.orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS landmark_id", "-1e0 AS x", "'disk' AS src"))


@query("cloud_layers", """WITH r AS (SELECT landmark_id, floor, row_number() OVER (PARTITION BY floor ORDER BY landmark_id) - 1 AS i, count(*) OVER (PARTITION BY floor) AS n FROM v_landmarks)
SELECT landmark_id, floor FROM r WHERE i % (CASE WHEN n > 300 THEN greatest(1, n // 300) ELSE 1 END) = 0 AND i // (CASE WHEN n > 300 THEN greatest(1, n // 300) ELSE 1 END) < 300""")
def _(t):
    return L.cloud_layers(t.v_landmarks, 300).select("landmark_id", "floor")


# walks: every customer is a session; orders are keyframes, events near them are tags
FR = ["o_custkey AS session_id", "o_orderkey AS frame_id", "CAST((o_orderkey * 7919) % 100000 AS DOUBLE) AS frame_t", "CAST((o_orderkey * 13) % 400 AS DOUBLE) / 10 AS map_x", "CAST((o_orderkey * 29) % 400 AS DOUBLE) / 10 AS map_z"]
TG = ["l_partkey % 1700 AS session_id", "l_orderkey * 10 + l_linenumber AS tag_id", "CAST((l_orderkey * 104729 + l_linenumber * 31) % 100000 AS DOUBLE) AS tag_t",
      "CAST((l_partkey * 17) % 500 AS DOUBLE) / 10 AS facility_x", "CAST((l_suppkey * 23 + l_linenumber) % 500 AS DOUBLE) / 10 AS facility_y", "CASE WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'B1' END AS floor"]
TAGS_SQL = f"fr AS (SELECT {', '.join(FR)} FROM orders), tg AS (SELECT DISTINCT ON (tag_id) * FROM (SELECT {', '.join(TG)} FROM lineitem) z ORDER BY tag_id, tag_t, session_id, facility_x, facility_y)"


def frames(t):
    return t.orders.selectExpr(*FR)


def tags(t):
    z = t.lineitem.selectExpr(*TG)
    rest = F.min(F.struct("tag_t", "session_id", "facility_x", "facility_y", "floor")).alias("r")
    return z.groupBy("tag_id").agg(rest).select("tag_id", "r.*")


NEAR = TAGS_SQL + """, nr AS (SELECT tg.*, fr.frame_id, map_x, map_z, abs(frame_t - tag_t) AS dt, row_number() OVER (PARTITION BY tag_id ORDER BY abs(frame_t - tag_t), frame_id) AS k FROM tg JOIN fr USING (session_id))"""


@query("nearest_keyframe", f"WITH {NEAR} SELECT tag_id, session_id, frame_id, dt FROM nr WHERE k = 1")
def _(t):
    n = L.nearest_in_time(tags(t), frames(t)).where("frame_id is not null")
    return n.select("tag_id", "session_id", "frame_id", "dt")


@query("reattach_orphan_tags", f"""WITH {TAGS_SQL}, al AS (SELECT c_custkey AS session_id FROM customer WHERE c_custkey % 5 = 0), ofr AS (SELECT * FROM fr WHERE session_id NOT IN (SELECT session_id FROM al)),
ot AS (SELECT tag_id, tag_t FROM tg WHERE session_id NOT IN (SELECT session_id FROM fr) AND session_id NOT IN (SELECT session_id FROM al)),
c AS (SELECT ot.tag_id, ofr.session_id AS ns, abs(frame_t - tag_t) AS dt, row_number() OVER (PARTITION BY tag_id ORDER BY abs(frame_t - tag_t), frame_id) AS k FROM ot JOIN ofr ON abs(frame_t - tag_t) <= 300)
SELECT tg.tag_id, coalesce(ns, tg.session_id) AS session_id FROM tg LEFT JOIN c ON c.tag_id = tg.tag_id AND k = 1""")
def _(t):
    al = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("session_id"))
    return L.reattach_orphan_tags(tags(t), frames(t), al).select("tag_id", "session_id")


@query("tag_anchors")
def _(t):
    return L.tag_anchors(tags(t), frames(t))


def walk_landmarks(t):
    return t.orders.selectExpr("o_orderkey AS landmark_id", "o_custkey AS session_id", "CAST((o_orderkey * 3) % 400 AS DOUBLE) / 10 AS x", "CAST(o_orderkey % 30 AS DOUBLE) / 10 AS y",
                               "CAST((o_orderkey * 41) % 400 AS DOUBLE) / 10 AS z", "'1' AS floor", "'d' AS descriptor")


@query("align_sessions")
def _(t):
    p = L.session_pieces(L.tag_anchors(tags(t), frames(t)))
    return rounded(L.align_sessions(walk_landmarks(t), p).select("landmark_id", "session_id", "aligned", "x", "y", "z"), 5)


@query("drop_far_landmarks")
def _(t):
    a = L.tag_anchors(tags(t), frames(t))
    return rounded(L.drop_far_landmarks(L.align_sessions(walk_landmarks(t), L.session_pieces(a)), a).select("landmark_id", "aligned", "x", "y"), 5)


@query("finalize_map")
def _(t):
    al = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("session_id"))
    disk = walk_landmarks(t).withColumns({"landmark_id": F.col("landmark_id") + 7, "session_id": F.lit(-1).cast("long")})
    return rounded(L.finalize_map(walk_landmarks(t), disk, tags(t), frames(t), al).select("landmark_id", "session_id", "floor", "x", "y", "z"), 5)


@query("infer_floor", f"""WITH {TAGS_SQL}, l AS (SELECT session_id, arg_max(floor, tag_t * 1e7 + tag_id) AS f FROM tg GROUP BY 1)
SELECT o_orderkey AS landmark_id, coalesce(f, '1') AS floor FROM orders LEFT JOIN l ON session_id = o_custkey""")
def _(t):
    return L.infer_floor(walk_landmarks(t), tags(t)).select("landmark_id", "floor")


@query("tags_3d", f"""WITH {NEAR}, al AS (SELECT c_custkey AS session_id FROM customer WHERE c_custkey % 5 = 0), q AS (SELECT tg.*, n.map_x, n.map_z, tg.session_id IN (SELECT session_id FROM al) AS ok FROM tg LEFT JOIN nr n ON n.tag_id = tg.tag_id AND n.k = 1)
SELECT tag_id, session_id, ok AS aligned, round_even(CASE WHEN ok THEN facility_x ELSE coalesce(map_x, facility_x) END, 3) AS x, round_even(CASE WHEN ok THEN facility_y ELSE 0e0 END, 3) AS y, round_even(CASE WHEN ok THEN 0e0 ELSE coalesce(map_z, 0e0) END, 3) AS z FROM q""")
def _(t):
    al = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("session_id"))
    return L.tags_3d(tags(t), frames(t), al)


@query("landmark_filter", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 2 BETWEEN 3e-1 AND 20 AND abs((l_partkey % 100) / 1e1 - 5) <= 45e-1 AND abs((l_suppkey % 90) / 1e1 - 45e-1) <= 4""")
def _(t):
    p = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "1e0 AS cam_x", "(l_suppkey % 90) / 1e1 - 45e-1 AS cam_y", "l_quantity / 2 AS cam_z", "(l_partkey % 100) / 1e1 - 5 AS world_y")
    return L.landmark_filter(p, True).select("l_orderkey", "l_linenumber")


@query("keyframe_motion", f"""WITH f AS (SELECT *, (frame_id % 30) / 2e0 AS flow FROM (SELECT {', '.join(FR)} FROM orders) z), d AS (SELECT *, sqrt((map_x/50-lag(map_x/50) OVER w)*(map_x/50-lag(map_x/50) OVER w)+(map_z/50-lag(map_z/50) OVER w)*(map_z/50-lag(map_z/50) OVER w)) AS odo, abs(frame_t/10000-lag(frame_t/10000) OVER w) AS dt FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_t, frame_id))
SELECT session_id, frame_id, round(CASE WHEN odo >= 12e-2 THEN odo WHEN flow >= 8 AND dt >= 25e-2 THEN least(greatest(105e-2 * dt, 25e-2), 14e-1) END, 6) AS baseline, CASE WHEN odo >= 12e-2 THEN 'odometry' WHEN flow >= 8 AND dt >= 25e-2 THEN 'visual' ELSE 'skip' END AS source FROM d WHERE odo IS NOT NULL""")
def _(t):
    f = frames(t).selectExpr("session_id", "frame_id", "frame_t / 10000 AS t", "map_x / 50 AS x", "0e0 AS y", "map_z / 50 AS z", "(frame_id % 30) / 2e0 AS median_flow")
    return rounded(L.keyframe_motion(f))


# cloud and photos: parts are cloud points, images are cameras, order lines keypoints
CLOUD = ["p_partkey AS point_id", "((p_partkey * 37) % 3000) / 1e2 AS x", "((p_partkey * 91) % 1500) / 1e2 AS y", "((p_partkey * 13) % 300) / 1e2 AS z"]
KEYS = ["l_orderkey % 500 AS image_id", "l_orderkey * 10 + l_linenumber AS kp_idx", "CAST((l_partkey * 71 + l_linenumber) % 640 AS DOUBLE) AS u", "CAST((l_orderkey * 97 + l_suppkey) % 480 AS DOUBLE) AS v", "CAST(l_partkey AS STRING) AS desc"]


def cloud_inputs(t):
    photos = t.v_images.selectExpr("image_id", "x", "y", "orientation", "640 AS width", "480 AS height")
    return t.part.selectExpr(*CLOUD), photos, t.lineitem.selectExpr(*KEYS)


@query("nearest_landmark_keypoint", f"""WITH cl AS (SELECT {', '.join(CLOUD)} FROM part), kp AS (SELECT {', '.join(KEYS).replace('STRING) AS desc', 'VARCHAR) AS dsc')} FROM lineitem),
s0 AS (SELECT point_id, image_id, (cl.x-i.x)*cos(radians(orientation)) - (cl.y-i.y)*sin(radians(orientation)) AS r, (cl.x-i.x)*sin(radians(orientation)) + (cl.y-i.y)*cos(radians(orientation)) AS d, 155e-2 - z AS dn FROM cl JOIN v_images i ON sqrt((cl.x-i.x)*(cl.x-i.x)+(cl.y-i.y)*(cl.y-i.y)) < 12),
s1 AS (SELECT point_id, image_id, 544*r/d + 320 AS pu, 544*dn/d + 240 AS pv FROM s0 WHERE d > 4e-1 AND d < 18),
h AS (SELECT point_id, image_id, kp_idx, round(sqrt((pu-u)*(pu-u)+(pv-v)*(pv-v)), 9) AS px_err FROM s1 JOIN kp USING (image_id) WHERE pu >= 0 AND pu < 640 AND pv >= 0 AND pv < 480 AND abs(pu-u) <= 6 AND abs(pv-v) <= 6),
b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY px_err, image_id, kp_idx) AS k FROM h WHERE px_err <= 6)
SELECT point_id, round(px_err, 6) AS px_err, image_id FROM b WHERE k = 1""")
def _(t):
    return rounded(L.nearest_landmark_keypoint(*cloud_inputs(t)).select("point_id", "px_err", "image_id"))


@query("build_map_from_cloud")
def _(t):
    return rounded(L.build_map_from_cloud(*cloud_inputs(t)))


SIGHT = ["o_custkey AS sighting_id", "o_orderkey AS pose_no", "20e0 + o_custkey % 160 AS side_px", "(o_orderkey % 50) / 1e1 AS err", "o_orderkey % 9 <> 0 AS in_front", "(o_orderkey % 30) / 1e1 AS cam_z",
         "CAST(o_orderkey % 140 - 70 AS DOUBLE) AS pitch", "CAST(o_orderkey % 40 - 20 AS DOUBLE) AS roll", "CAST((o_custkey * 7 + o_orderkey % 3 * 6) % 360 AS DOUBLE) AS heading", "CAST(o_custkey % 80 AS DOUBLE) AS view_deg", "(o_custkey % 90) / 1e1 AS dist"]


@query("marker_pose_accept", f"""WITH c AS (SELECT * FROM (SELECT {', '.join(SIGHT)} FROM orders) z), p AS (SELECT *, row_number() OVER (PARTITION BY sighting_id ORDER BY err, pose_no) AS k FROM c WHERE in_front AND cam_z BETWEEN 3e-1 AND 25e-1 AND abs(pitch) <= 65),
s AS (SELECT DISTINCT sighting_id, side_px FROM c), j AS (SELECT s.sighting_id, s.side_px, a.err AS ae, b.err AS be, a.pose_no AS ap, b.pose_no AS bp, abs(mod(b.heading - a.heading + 540, 360) - 180) AS turn, abs(a.roll)+5e-1*abs(a.pitch) AS la, abs(b.roll)+5e-1*abs(b.pitch) AS lb, a.view_deg, a.dist,
  3e0 - 17e-1 * least(greatest((s.side_px - 80) / 7e1, 0e0), 1e0) AS need FROM s LEFT JOIN p a ON a.sighting_id = s.sighting_id AND a.k = 1 LEFT JOIN p b ON b.sighting_id = s.sighting_id AND b.k = 2),
q AS (SELECT *, coalesce(be < need * greatest(ae, 1e-6), false) AS amb FROM j), r AS (SELECT *, CASE WHEN amb AND lb < la THEN be ELSE ae END AS e, CASE WHEN amb AND lb < la THEN bp ELSE ap END AS pn FROM q),
u AS (SELECT *, CASE WHEN side_px < 36 THEN 'small' WHEN ae IS NULL THEN 'implausible' WHEN amb AND turn > 10 THEN 'ambiguous' WHEN e > greatest(3e0, 25e-3 * side_px) THEN 'reproj' WHEN view_deg > 70 THEN 'angle' WHEN dist > 8 THEN 'far' ELSE 'ok' END AS reason FROM r)
SELECT sighting_id, reason, CASE WHEN reason = 'ok' THEN pn END AS pose_no, round(CASE WHEN reason = 'ok' THEN least(greatest(95e-2 - 4e-2 * greatest(0e0, dist - 15e-1) - CASE WHEN amb THEN 1e-1 ELSE 0e0 END, 55e-2), 95e-2) END, 6) AS confidence FROM u""")
def _(t):
    return rounded(L.marker_pose_accept(t.orders.selectExpr(*SIGHT)))

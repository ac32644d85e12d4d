"""Queries: detectors and state machines over whole logs. Their SQL walks the rows of a device by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import steps as S, trajectory as T
from ..operators.corridors import walk_axis_error
from ..operators.ordered import fold_ordered, numbered
from ..streaming import drift, machines as M
from .catalog import query, rounded
from .q_network import walk_pieces
from .q_trajectory import EPOCH, FIXES, align_pairs, points, step_rows

def samples(t):
    """Motion samples: every event is a 1.5 s burst at 20 Hz of a bouncing walk."""
    e = t.events.select("event_id", F.col("user_id").alias("device_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double").alias("t0"), "value")
    s = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    swing = F.sin(F.col("i") * 0.05 * 2 * 3.141592653589793 / (0.45 + (F.col("event_id") % 3) * 0.1)) * (1.0 + (F.col("event_id") % 5))
    return s.select("device_id", "event_id", (F.col("t0") + F.col("i") * 50).alias("t"), F.lit(0.1).alias("ax"), F.lit(0.2).alias("ay"),
                    (9.81 + swing).alias("az"), F.when(F.col("event_id") % 11 == 0, 200.0).otherwise(10.0).alias("rot"))


# one sample after another: r carries a device's state, o is its next row
SAMPLES = """s AS (SELECT user_id AS device_id, event_id, floor(epoch_us(ts) / 1e3) + i * 5e1 AS t, 1e-1 AS ax, 2e-1 AS ay,
  981e-2 + sin(i * 5e-2 * 2 * 3.141592653589793e0 / (45e-2 + (event_id % 3) * 1e-1)) * (1e0 + event_id % 5) AS az, CASE WHEN event_id % 11 = 0 THEN 2e2 ELSE 1e1 END AS rot FROM events, range(30) x(i)),
o AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS mag, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS k FROM s)"""


@query("pdr_steps", f"""WITH RECURSIVE {SAMPLES},
r AS (SELECT DISTINCT device_id, 0 AS k, 981e-2 AS g, false AS armed, 0e0 AS peak, 0e0 AS valley, -1e18 AS last, 0 AS n, CAST(NULL AS DOUBLE) AS stride, 0e0 AS t FROM s
UNION ALL SELECT device_id, k + 1, g2, CASE WHEN hi THEN armed OR t2 - last > 280 ELSE armed AND NOT fires END, CASE WHEN NOT hi THEN peak WHEN armed THEN greatest(peak, dyn) WHEN t2 - last > 280 THEN dyn ELSE peak END,
  CASE WHEN hi AND NOT armed AND t2 - last > 280 THEN 0 WHEN NOT hi AND armed THEN least(valley, dyn) ELSE valley END, CASE WHEN fires THEN t2 ELSE last END, n + CASE WHEN fires THEN 1 ELSE 0 END,
  CASE WHEN fires THEN least(greatest(43e-2 * power(greatest(1e-1, peak - least(valley, dyn)), 25e-2), 42e-2), 105e-2) END, t2
  FROM (SELECT *, dyn > 12e-1 AS hi, armed AND dyn < 1e-1 AS fires FROM (SELECT r.*, o.t AS t2, 92e-2 * g + 8e-2 * mag AS g2, mag - (92e-2 * g + 8e-2 * mag) AS dyn FROM r JOIN o ON o.device_id = r.device_id AND o.k = r.k + 1)))
SELECT device_id, t, CAST(n AS BIGINT) AS step_no, round(stride, 6) AS stride_m FROM r WHERE stride IS NOT NULL""")
def _(t):
    return rounded(S.pdr_steps(samples(t)))


@query("gait_steps", f"""WITH RECURSIVE {SAMPLES},
r AS (SELECT DISTINCT device_id, 0 AS k, CAST(NULL AS DOUBLE) AS gx, CAST(NULL AS DOUBLE) AS gy, CAST(NULL AS DOUBLE) AS gz, 0e0 AS v, -1e18 AS hold, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS cand, 0e0 AS dt, 0 AS streak,
  false AS sure, 0 AS n, 0 AS credit, 0e0 AS t FROM s
UNION ALL SELECT device_id, k + 1, gx2, gy2, gz2, v2, CASE WHEN turns THEN t2 + 450 ELSE hold END,
  CASE WHEN turns THEN NULL WHEN NOT live THEN up WHEN up IS NULL THEN CASE WHEN v2 > 9e-1 THEN t2 END WHEN t2 - up > 650 OR v2 <= -6e-1 THEN NULL ELSE up END,
  CASE WHEN beat THEN t2 ELSE cand END, CASE WHEN turns THEN 0 WHEN NOT beat THEN dt WHEN slow THEN 0 ELSE gap END,
  CASE WHEN turns THEN 0 WHEN NOT beat THEN streak WHEN slow OR off THEN 1 ELSE streak + 1 END, CASE WHEN turns THEN false WHEN NOT beat THEN sure WHEN slow OR off THEN false ELSE sure OR streak + 1 >= 3 END,
  n + earned, earned, t2 FROM (SELECT *, CASE WHEN NOT beat OR slow OR off THEN 0 WHEN sure THEN 1 WHEN streak + 1 >= 3 THEN streak + 1 ELSE 0 END AS earned
  FROM (SELECT *, beat AND (gap IS NULL OR gap > 1200) AS slow, beat AND dt > 0 AND gap IS NOT NULL AND (gap / dt < 1 / 16e-1 OR gap / dt > 16e-1) AS off
  FROM (SELECT *, live AND up IS NOT NULL AND t2 - up <= 650 AND v2 <= -6e-1 AND (gap IS NULL OR gap >= 300) AS beat
  FROM (SELECT *, CASE WHEN gn >= 5 THEN 7e-1 * v + 3e-1 * ((ax - gx2) * gx2 + (ay - gy2) * gy2 + (az - gz2) * gz2) / gn ELSE v END AS v2, gn >= 5 AND rot > 140 AS turns, gn >= 5 AND rot <= 140 AND t2 >= hold AS live, t2 - cand AS gap
  FROM (SELECT *, sqrt(gx2*gx2 + gy2*gy2 + gz2*gz2) AS gn FROM (SELECT r.*, o.t AS t2, ax, ay, az, rot, coalesce(9e-1 * gx + 1e-1 * ax, ax) AS gx2, coalesce(9e-1 * gy + 1e-1 * ay, ay) AS gy2, coalesce(9e-1 * gz + 1e-1 * az, az) AS gz2
    FROM r JOIN o ON o.device_id = r.device_id AND o.k = r.k + 1)))))))
SELECT device_id, t, CAST(n - q.i AS BIGINT) AS step_no, 7e-1 AS stride_m FROM r, range(3) q(i) WHERE q.i < credit""")
def _(t):
    return rounded(S.gait_steps(samples(t)))


@query("fuse_positions_smoothed", f"""WITH RECURSIVE {FIXES}, o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, kind, event_id) AS k, mod(heading, 360) AS hd FROM r),
z AS (SELECT DISTINCT device_id, CAST(NULL AS BIGINT) AS event_id, 0 AS k, 1e0 AS p, 0e0 AS conf, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS h, CAST(NULL AS VARCHAR) AS floor,
  0e0 AS vx, 0e0 AS vy, 0e0 AS vh, CAST(NULL AS DOUBLE) AS lx, 0e0 AS ly, 0e0 AS turn, false AS used FROM o
UNION ALL SELECT device_id, e2, k + 1, p2, c2, x2, y2, h2, CASE WHEN fix THEN f2 ELSE floor END, CASE WHEN pose THEN ox ELSE vx END, CASE WHEN pose THEN oy ELSE vy END, CASE WHEN pose THEN hd ELSE vh END,
  CASE WHEN fix THEN x2 - (vx * cos(radians(turn2)) - vy * sin(radians(turn2))) ELSE lx END, CASE WHEN fix THEN y2 - (vx * sin(radians(turn2)) + vy * cos(radians(turn2))) ELSE ly END, CASE WHEN fix THEN turn2 ELSE turn END, pose OR fix
  FROM (SELECT *, mod(h2 - vh + 720, 360) AS turn2 FROM (SELECT *, CASE WHEN pose THEN p + 5e-2 WHEN first THEN 5e-1 WHEN fix THEN (1 - gain) * p ELSE p END AS p2,
    CASE WHEN pose THEN greatest(conf * 98e-2, 1e-1) WHEN first THEN oc WHEN fix THEN greatest(conf, oc) ELSE conf END AS c2,
    CASE WHEN pose THEN CASE WHEN lx IS NULL THEN ox ELSE lx + ox * cos(radians(turn)) - oy * sin(radians(turn)) END WHEN first THEN ox WHEN fix THEN x + gain * (ox - x) ELSE x END AS x2,
    CASE WHEN pose THEN CASE WHEN lx IS NULL THEN oy ELSE ly + ox * sin(radians(turn)) + oy * cos(radians(turn)) END WHEN first THEN oy WHEN fix THEN y + gain * (oy - y) ELSE y END AS y2,
    CASE WHEN pose THEN CASE WHEN lx IS NULL THEN hd ELSE mod(hd + turn, 360) END WHEN first THEN hd WHEN fix THEN mod(h + gain * (mod(oh - h + 1260, 360) - 180) + 720, 360) ELSE h END AS h2
    FROM (SELECT z.*, o.event_id AS e2, o.kind = 'a_pose' AS pose, o.kind = 'b_fix' AND o.matched AS fix, o.kind = 'b_fix' AND o.matched AND z.x IS NULL AS first, o.x AS ox, o.y AS oy, o.heading AS oh, o.hd, o.confidence AS oc, o.floor AS f2,
      p / (p + 2 / least(greatest(o.confidence, 1e-1), 1e0)) AS gain FROM z JOIN o ON o.device_id = z.device_id AND o.k = z.k + 1))))
SELECT device_id, event_id, coalesce(floor, '1') AS floor, round(x, 4) AS x, round(y, 4) AS y, round(h, 4) AS heading, round(conf, 4) AS confidence, round(p, 4) AS doubt FROM z WHERE used""")
def _(t):
    return rounded(fold_ordered(points(t), ["device_id"], ["t", "kind", "event_id"], M.smooth_fix, M.SMOOTH_SCHEMA), 4)


@query("refine_stride", f"""WITH RECURSIVE {FIXES}, q AS (SELECT *, kind = 'b_fix' AND matched AS is_fix, count(*) FILTER (kind = 'a_pose') OVER w AS n, sqrt(power(x - lag(x) OVER z, 2) + power(y - lag(y) OVER z, 2)) AS drift FROM r
  WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY device_id ORDER BY t, event_id)),
f AS (SELECT *, n - lag(n) OVER w AS steps, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS fix_m, lag(event_id) OVER w AS before FROM q WHERE is_fix WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id)),
o AS (SELECT *, 2 * steps AS path_m, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS k FROM f WHERE before IS NOT NULL),
s AS (SELECT DISTINCT device_id, CAST(NULL AS BIGINT) AS event_id, 0 AS k, 1e0 AS scale FROM o
UNION ALL SELECT s.device_id, o.event_id, s.k + 1, CASE WHEN steps > 0 AND path_m >= 3e-1 AND NOT coalesce(drift > path_m, false) AND fix_m / nullif(path_m, 0) > 4e-1 AND fix_m / nullif(path_m, 0) < 25e-1
  THEN least(greatest(scale * 7e-1 + fix_m / nullif(path_m, 0) * 3e-1, 5e-1), 18e-1) ELSE scale END FROM s JOIN o ON o.device_id = s.device_id AND o.k = s.k + 1)
SELECT device_id, event_id, round(scale, 6) AS scale FROM s WHERE k > 0""")
def _(t):
    r = step_rows(t).withColumn("step_m", F.lit(2.0))
    segs = T.infer_walking_offset(r).join(T.steps_since_fix(r).select("event_id", "drift_m"), "event_id")
    return rounded(fold_ordered(segs, ["device_id"], ["t", "event_id"], M.stride_scale, M.SCALE_SCHEMA))


ROUTE = "array(struct(0e0 AS x, 0e0 AS y), struct(20e0 AS x, 0e0 AS y), struct(20e0 AS x, 20e0 AS y), struct(40e0 AS x, 20e0 AS y))"


def walkers(t):
    """Devices along an L-shaped route, half a metre per event, some drifting sideways."""
    e = t.events.select("event_id", F.col("user_id").alias("device_id"), "ts")
    k = numbered(e, ["device_id"], [F.col("ts"), F.col("event_id")], "k").withColumn("s", F.col("k") * 0.5)
    side = F.when((F.col("device_id") % 3 == 0) & (F.col("s") > 10), (F.col("s") - 10) * 0.4).otherwise((F.col("event_id") % 5 - 2) / 10.0)
    return k.withColumns({
        "x": F.when(F.col("s") <= 20, F.col("s")).when(F.col("s") <= 40, 20.0 + side).otherwise(F.col("s") - 20),
        "y": F.when(F.col("s") <= 20, side).when(F.col("s") <= 40, F.col("s") - 20).otherwise(20.0 + side),
        "t": F.col("k") * 400.0, "floor": F.lit("G"), "route": F.expr(ROUTE), "heading": (F.col("event_id") * 53 % 360).cast("double")})


@query("step_along_route")
def _(t):
    w = walkers(t).withColumns({"is_fix": F.col("event_id") % 17 == 0, "stride_m": F.lit(0.7), "confidence": F.lit(0.6)})
    return rounded(fold_ordered(w, ["device_id"], ["t", "event_id"], M.route_step, M.ROUTE_STEP_SCHEMA))


@query("detect_drift")
def _(t):
    return rounded(fold_ordered(walkers(t), ["device_id"], ["t", "event_id"], drift.detect_drift, drift.DRIFT_SCHEMA))


@query("capture_trigger", f"""WITH RECURSIVE {SAMPLES},
r AS (SELECT DISTINCT device_id, 0 AS k, CAST(NULL AS DOUBLE) AS mag, 0e0 AS total, CAST(NULL AS DOUBLE) AS sent, -1e18 AS allowed, 0e0 AS t, CAST(NULL AS VARCHAR) AS trigger, 0e0 AS motion FROM s
UNION ALL SELECT device_id, k + 1, mag2, CASE WHEN due AND NOT blurred THEN 0 ELSE total2 END, CASE WHEN due AND NOT blurred THEN t2 ELSE sent2 END, CASE WHEN due AND blurred THEN t2 + 400 ELSE allowed END, t2,
  CASE WHEN due THEN CASE WHEN blurred THEN 'frame_skipped_blur' WHEN total2 > 6 THEN 'motion' ELSE 'timeout' END END, total2
  FROM (SELECT *, t2 - sent2 >= 800 AND t2 >= allowed AND (total2 > 6 OR t2 - sent2 >= 4000) AS due FROM (
    SELECT r.*, o.t AS t2, o.mag AS mag2, o.event_id % 200 < 80 AS blurred, total + coalesce(abs(o.mag - r.mag), 0) AS total2, coalesce(sent, o.t) AS sent2 FROM r JOIN o ON o.device_id = r.device_id AND o.k = r.k + 1)))
SELECT device_id, t, trigger, round(motion, 6) AS motion FROM r WHERE trigger IS NOT NULL""")
def _(t):
    s = samples(t).withColumns({"mag": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), "mode": F.lit("motion"), "motion_threshold": F.lit(6.0),
                                "min_ms": F.lit(800.0), "max_ms": F.lit(4000.0), "sharpness": (F.col("event_id") % 200).cast("double")})
    return rounded(fold_ordered(s.drop("ax", "ay", "az", "rot"), ["device_id"], ["t", "event_id"], M.capture_trigger, M.CAPTURE_SCHEMA))


@query("lift_transition_state", """WITH RECURSIVE e AS (SELECT event_id, user_id AS device_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
o AS (SELECT *, k * 1e3 AS t, 20e0 - k % 25 AS door, CASE WHEN k % 25 > 22 AND device_id % 2 = 0 THEN 'B1' ELSE 'G' END AS floor FROM e),
r AS (SELECT DISTINCT device_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'walk' AS mode, 0e0 AS since, 0e0 AS motion, 0e0 AS t, CAST(NULL AS VARCHAR) AS event FROM e
UNION ALL SELECT device_id, e2, k + 1, CASE event2 WHEN 'enter' THEN 'ride' WHEN 'auto_land' THEN 'landed' WHEN 'land' THEN 'walk' ELSE now END, CASE event2 WHEN 'enter' THEN t2 ELSE since END, CASE event2 WHEN 'enter' THEN 0 ELSE motion2 END, t2, event2
  FROM (SELECT *, CASE WHEN now = 'walk' AND door <= 3 AND floor = 'G' THEN 'enter' WHEN now = 'ride' AND floor = 'B1' THEN 'land' WHEN now = 'ride' AND t2 - since >= 7000 AND motion2 >= 16e-1 THEN 'auto_land' END AS event2
  FROM (SELECT r.*, o.event_id AS e2, o.t AS t2, o.door, o.floor, CASE WHEN mode = 'landed' AND o.door > 3 THEN 'walk' ELSE mode END AS now, CASE WHEN mode = 'ride' THEN motion + 3e-1 ELSE motion END AS motion2 FROM r JOIN o ON o.device_id = r.device_id AND o.k = r.k + 1)))
SELECT device_id, event_id, t, event FROM r WHERE event IS NOT NULL""")
def _(t):
    e = numbered(t.events.select("event_id", F.col("user_id").alias("device_id"), "ts"), ["device_id"], [F.col("ts"), F.col("event_id")], "k")
    e = e.withColumns({"t": F.col("k") * 1000.0, "door_m": (20 - F.col("k") % 25).cast("double"), "from_floor": F.lit("G"), "to_floor": F.lit("B1"),
                       "floor": F.when((F.col("k") % 25 > 22) & (F.col("device_id") % 2 == 0), "B1").otherwise("G"), "motion": F.lit(0.3)})
    return fold_ordered(e, ["device_id"], ["t", "event_id"], M.lift_state, M.LIFT_SCHEMA)


@query("alignment_tracker")
def _(t):
    p = align_pairs(t).withColumnsRenamed({"session_id": "device_id", "fx": "x", "fy": "y"})
    far = F.when(F.col("event_id") % 9 == 0, 6.0).otherwise(0.0)
    p = p.withColumns({"dx": F.col("dx") + far, "dest_x": F.lit(40.0), "dest_y": F.lit(20.0)})
    return rounded(fold_ordered(p, ["device_id"], ["t", "event_id"], M.align_fix, M.ALIGN_SCHEMA))


@query("heading_consensus", """WITH RECURSIVE o AS (SELECT event_id, user_id AS device_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ((event_id % 15) + 9e1) * pi() / 180 - 3e-1 AS th, event_id % 23 = 0 AS strong, event_id % 29 = 0 AS fixed FROM events),
p AS (SELECT *, 9000 * k + CASE WHEN k % 10 > 6 THEN 40000 * (k % 10) ELSE 0 END AS t FROM o),
r AS (SELECT DISTINCT device_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(th DOUBLE, t BIGINT)[]) AS votes, CAST(NULL AS DOUBLE) AS rot, CAST(NULL AS DOUBLE) AS spread FROM p
UNION ALL SELECT device_id, e2, k + 1, CASE WHEN agrees THEN [] ELSE held END, CASE WHEN agrees THEN mean + list_sort(devs)[2] END, CASE WHEN agrees THEN spread2 END
  FROM (SELECT *, voted AND len(held) = 3 AND spread2 <= 10 AS agrees FROM (SELECT *, degrees(list_max(list_transform(devs, lambda d: abs(d)))) AS spread2
  FROM (SELECT *, list_transform(held, lambda v: atan2(sin(v.th - mean), cos(v.th - mean))) AS devs
  FROM (SELECT *, atan2(list_sum(list_transform(held, lambda v: sin(v.th))), list_sum(list_transform(held, lambda v: cos(v.th)))) AS mean
  FROM (SELECT r.*, p.event_id AS e2, NOT p.fixed AND NOT p.strong AS voted, CASE WHEN p.fixed THEN [] WHEN p.strong THEN votes
    ELSE list_append(list_filter(votes, lambda v: p.t - v.t < 25000), {'th': p.th, 't': p.t})[-3:] END AS held FROM r JOIN p ON p.device_id = r.device_id AND p.k = r.k + 1))))))
SELECT device_id, event_id, round(rot, 6) AS rot, round(spread, 6) AS spread_deg FROM r WHERE rot IS NOT NULL""")
def _(t):
    # a device's events nine seconds apart, with longer pauses now and then
    e = numbered(t.events.select("event_id", F.col("user_id").alias("device_id"), "ts"), ["device_id"], [F.col("ts"), F.col("event_id")], "k").drop("ts")
    pause = F.when(F.col("k") % 10 > 6, 40000 * (F.col("k") % 10)).otherwise(0)
    e = e.withColumns({"t": 9000 * F.col("k") + pause, "heading": (F.col("event_id") % 15).cast("double") + 90, "yaw": F.lit(0.3),
                       "strong": F.col("event_id") % 23 == 0, "fixed": F.col("event_id") % 29 == 0})
    return rounded(fold_ordered(e, ["device_id"], ["k"], M.heading_vote, M.VOTE_SCHEMA))


@query("straight_walk_axis_error")
def _(t):
    w = fold_ordered(walkers(t), ["device_id"], ["t", "event_id"], M.straight_walk, M.STRAIGHT_SCHEMA)
    # a device walks the building of the supplier with its number
    w = w.withColumn("site_id", F.col("device_id"))
    return rounded(walk_axis_error(w, walk_pieces(t), ["site_id", "floor"]))

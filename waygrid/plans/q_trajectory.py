"""Queries: fixes, odometry, sessions, calibration and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import diagnostics as D
from ..operators import trajectory as T
from ..operators.ordered import placed, scan
from .catalog import query, rounded

EPOCH = "CAST(epoch_us(ts) AS DOUBLE) / 1e6"
FIXES = f"""r AS (SELECT event_id, device_id, {EPOCH} AS t, CASE source WHEN 'PDR' THEN 'a_pose' ELSE 'b_fix' END AS kind, source IN ('VPR', 'SEED') AS matched,
  x, y, heading, floor, CASE source WHEN 'SEED' THEN 2e-1 ELSE confidence END AS confidence, source FROM v_points)"""


def points(t):
    """Events as fixes (matched or missed), seeds and odometry poses per device."""
    p = t.v_points.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")
    return p.withColumns({
        "kind": F.when(F.col("source") == "PDR", "a_pose").otherwise("b_fix"), "matched": F.col("source").isin("VPR", "SEED"),
        "confidence": F.when(F.col("source") == "SEED", T.SEED_CONFIDENCE).otherwise(F.col("confidence"))})


FUSED = f"""{FIXES}, v AS (SELECT *, last_value(CASE WHEN kind = 'a_pose' THEN event_id END IGNORE NULLS) OVER w AS vio_id,
  count(*) FILTER (kind = 'a_pose') OVER w AS n_pose, last_value(CASE WHEN kind = 'b_fix' AND matched THEN event_id END IGNORE NULLS) OVER w AS fix_id
  FROM r WINDOW w AS (PARTITION BY device_id ORDER BY t, kind, event_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT f.event_id AS fix_id, f.floor AS k_floor, f.confidence AS conf, f.n_pose AS n, mod(f.heading - coalesce(p.heading, 0e0) + 720, 360) AS turn, f.x AS kx, f.y AS ky, coalesce(p.x, 0e0) AS vx, coalesce(p.y, 0e0) AS vy
  FROM v f LEFT JOIN r p ON p.event_id = f.vio_id),
l AS (SELECT *, kx - (vx*cos(radians(turn)) - vy*sin(radians(turn))) AS ox, ky - (vx*sin(radians(turn)) + vy*cos(radians(turn))) AS oy FROM k),
z AS (SELECT v.*, l.turn, l.ox, l.oy, l.conf, l.n, l.k_floor, v.kind = 'a_pose' AND v.fix_id IS NOT NULL AS moved FROM v LEFT JOIN l USING (fix_id) WHERE v.kind = 'a_pose' OR v.matched)"""


@query("fuse_positions", f"""WITH {FUSED} SELECT device_id, event_id, coalesce(k_floor, '1') AS fused_floor,
  round(CASE WHEN moved THEN ox + x*cos(radians(turn)) - y*sin(radians(turn)) ELSE x END, 5) AS fused_x, round(CASE WHEN moved THEN oy + x*sin(radians(turn)) + y*cos(radians(turn)) ELSE y END, 5) AS fused_y,
  CASE WHEN moved THEN mod(heading + turn, 360) ELSE mod(heading, 360) END AS fused_heading,
  round(CASE WHEN kind = 'b_fix' THEN confidence WHEN n_pose - coalesce(n, 0) = 0 THEN conf ELSE greatest(coalesce(conf, 0) * power(98e-2, n_pose - coalesce(n, 0)), 1e-1) END, 5) AS fused_confidence FROM z""")
def _(t):
    return rounded(T.fuse_positions(points(t)).drop("t", "kind"), 5)


@query("se2_lock", f"""WITH {FUSED} SELECT device_id, event_id, round(CASE WHEN moved THEN ox + x*cos(radians(turn)) - y*sin(radians(turn)) ELSE x END, 5) AS fused_x,
  round(CASE WHEN moved THEN oy + x*sin(radians(turn)) + y*cos(radians(turn)) ELSE y END, 5) AS fused_y FROM z WHERE kind = 'a_pose'""")
def _(t):
    return rounded(T.fuse_positions(points(t)).where("kind = 'a_pose'").select("device_id", "event_id", "fused_x", "fused_y"), 5)


@query("seed_positions", f"""WITH {FUSED} SELECT device_id, event_id, round(CASE WHEN moved THEN ox + x*cos(radians(turn)) - y*sin(radians(turn)) ELSE x END, 5) AS fused_x,
  round(CASE WHEN moved THEN oy + x*sin(radians(turn)) + y*cos(radians(turn)) ELSE y END, 5) AS fused_y,
  round(CASE WHEN kind = 'b_fix' THEN confidence ELSE greatest(conf * power(98e-2, n_pose - n), 1e-1) END, 5) AS fused_confidence FROM z WHERE conf = 2e-1""")
def _(t):
    # what is reported while the last place of a device is a seed
    p = points(t)
    fed = p.where("source <> 'SEED'").unionByName(T.seed_positions(p.where("source = 'SEED'")), allowMissingColumns=True)
    order = ["t", "kind", "event_id"]
    last = scan(fed, ["device_id"], order, lasts={"seeded": (F.coalesce("seed", F.lit(False)), (F.col("kind") == "b_fix") & F.col("matched"))}).where("seeded").select("event_id")
    fused = T.fuse_positions(fed).join(last, "event_id", "left_semi")
    return rounded(fused.select("device_id", "event_id", "fused_x", "fused_y", "fused_confidence"), 5)


@query("confidence_decay", f"""WITH {FUSED} SELECT event_id, round(CASE WHEN n_pose - n = 0 THEN conf ELSE greatest(conf * power(985e-3, n_pose - n), 8e-2) END, 6) AS confidence FROM z WHERE n IS NOT NULL""")
def _(t):
    order = ["t", "kind", "event_id"]
    r = placed(points(t), ["device_id"], order)
    r = scan(r, ["device_id"], order, {"n": F.when(F.col("kind") == "a_pose", 1).otherwise(0)})
    r = scan(r, ["device_id"], order, lasts={"f": (F.struct("confidence", "n"), (F.col("kind") == "b_fix") & F.col("matched"))})
    r = r.where(((F.col("kind") == "a_pose") | F.col("matched")) & F.col("f").isNotNull())
    return rounded(r.select("event_id", T.confidence_decay(F.col("f.confidence"), F.col("n") - F.col("f.n"), T.STEP_DECAY, T.STEP_FLOOR).alias("confidence")))


def step_rows(t):
    return points(t).withColumns({"is_fix": F.col("kind").eqNullSafe("b_fix") & F.col("matched"), "is_step": F.col("kind") == "a_pose"})


@query("steps_since_fix", f"""WITH {FIXES}, s AS (SELECT *, kind = 'b_fix' AND matched AS is_fix, count(*) FILTER (kind = 'a_pose') OVER w AS n, lag(x) OVER z AS px, lag(y) OVER z AS py FROM r
  WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY device_id ORDER BY t, event_id)),
q AS (SELECT *, coalesce(last_value(CASE WHEN is_fix THEN n END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS at_fix FROM s)
SELECT device_id, event_id, n - at_fix AS steps_since_fix, round(CASE WHEN is_fix THEN sqrt((x-px)*(x-px)+(y-py)*(y-py)) END, 6) AS drift_m FROM q""")
def _(t):
    return rounded(T.steps_since_fix(step_rows(t)))


@query("consecutive_floor_hits", f"""WITH h AS (SELECT event_id, user_id AS device_id, {EPOCH} AS t, event_type <> 'error' AND event_id % 3 <> 0 AS hit FROM events),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY t, event_id) AS grp FROM h),
c AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, grp ORDER BY t, event_id) AS n FROM g)
SELECT device_id, event_id, CAST(n AS BIGINT) AS hits, hit AND n = 2 AS seed FROM c""")
def _(t):
    seen = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_id") % 3 == 0, "B9").otherwise("G")
    r = t.events.select("event_id", F.col("user_id").alias("device_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
                        seen.alias("seen_floor"), F.lit(" G").alias("landing_floor"))
    return T.consecutive_floor_hits(r)


@query("infer_walking_offset", f"""WITH {FIXES}, s AS (SELECT *, kind = 'b_fix' AND matched AS is_fix, sum(CASE WHEN kind = 'a_pose' THEN 1e0 ELSE 0e0 END) OVER w AS n, sum(CASE WHEN kind = 'a_pose' THEN 2e0 ELSE 0e0 END) OVER w AS path,
  sum(CASE WHEN kind = 'a_pose' THEN sin(radians(heading / 20)) ELSE 0e0 END) OVER w AS ss, sum(CASE WHEN kind = 'a_pose' THEN cos(radians(heading / 20)) ELSE 0e0 END) OVER w AS cs FROM r WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lag(x) OVER z AS px, lag(y) OVER z AS py, lag(floor) OVER z AS pf, lag(n) OVER z AS pn, lag(path) OVER z AS pp, lag(ss) OVER z AS ps, lag(cs) OVER z AS pc FROM s WHERE is_fix WINDOW z AS (PARTITION BY device_id ORDER BY t, event_id)),
d AS (SELECT *, n - pn AS steps, path - pp AS path_m, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS fix_m FROM f WHERE px IS NOT NULL),
e AS (SELECT *, floor = pf AND confidence >= 45e-2 AND steps >= 6 AND path_m >= 2 AND fix_m >= 2 AND fix_m BETWEEN 65e-2 * path_m AND 18e-1 * path_m AND sqrt((ss-ps)*(ss-ps)+(cs-pc)*(cs-pc)) / steps >= 85e-2 AS ok,
  degrees(atan2(x-px, y-py)) - degrees(atan2(ss-ps, cs-pc)) AS dd FROM d)
SELECT device_id, event_id, CAST(steps AS BIGINT) AS steps, round(fix_m, 6) AS fix_m, round(CASE WHEN ok THEN mod(dd + 540, 360) - 180 END, 4) AS offset_deg FROM e""")
def _(t):
    r = step_rows(t).withColumns({"heading": F.col("heading") / 20, "step_m": F.lit(2.0)})
    o = T.infer_walking_offset(r)
    return o.select("device_id", "event_id", "steps", F.round("fix_m", 6).alias("fix_m"), (F.round("offset_deg", 4) + 0.0).alias("offset_deg"))


@query("route_change_log", f"""WITH s AS (SELECT event_id, user_id AS device_id, {EPOCH} AS t, (CAST(floor(value) AS INT) % 3) || ';' || printf('%.1f', round_even(((user_id % 5) / 5e0) * 2, 0) / 2) AS sig FROM events),
l AS (SELECT *, lag(sig) OVER (PARTITION BY device_id ORDER BY t, event_id) AS p FROM s) SELECT device_id, event_id FROM l WHERE p IS NULL OR p <> sig""")
def _(t):
    r = t.events.select("event_id", F.col("user_id").alias("device_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
                        (F.floor("value").cast("int") % 3).alias("slot_id"), F.array(F.struct(((F.col("user_id") % 5) / 5.0).alias("x"), F.lit(1.0).alias("y"))).alias("waypoints"))
    return T.route_change_log(r).select("device_id", "event_id")


@query("next_free_session", "SELECT greatest((SELECT max(session_id) FROM v_landmarks), (SELECT max(user_id) FROM events)) + 1 AS next_session")
def _(t):
    return T.next_free_session(t.v_landmarks.select(F.col("session_id").cast("long").alias("session_id")), t.events.select(F.col("user_id").alias("session_id")))


@query("session_stats", """SELECT coalesce(l.session_id, g.session_id) AS session_id, coalesce(n, 0) AS landmarks, coalesce(m, 0) AS tags FROM (SELECT CAST(session_id AS BIGINT) AS session_id, count(*) AS n FROM v_landmarks GROUP BY 1) l
FULL JOIN (SELECT user_id AS session_id, count(*) AS m FROM events GROUP BY 1) g USING (session_id)""")
def _(t):
    return T.session_stats(t.v_landmarks.withColumn("session_id", F.col("session_id").cast("long")), t.events.select(F.col("user_id").alias("session_id")))


LIVE_AT = 1705276800.0  # a moment inside the event month
EVENTS = f"""ev AS (SELECT event_id, user_id AS device_id, {EPOCH} AS t, CASE event_type WHEN 'error' THEN 'end' WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'pose' ELSE 'fix' END AS event FROM events)"""


def live_events(t):
    e = F.when(F.col("event_type") == "error", "end").when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "pose").otherwise("fix")
    return t.events.select("event_id", F.col("user_id").alias("device_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
                           e.alias("event"), (F.col("event_id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit("1").alias("floor"))


@query("live_devices", f"""WITH {EVENTS}, s AS (SELECT * FROM ev WHERE t <= {LIVE_AT}), l AS (SELECT device_id, arg_max(event, t) AS last_e, max(t) AS last_t, arg_max(event_id, t) FILTER (event IN ('fix', 'pose')) AS p FROM s GROUP BY 1)
SELECT device_id, CAST(p AS DOUBLE) AS x, round({LIVE_AT} - last_t, 6) AS age_s FROM l WHERE p IS NOT NULL AND last_e <> 'end' AND {LIVE_AT} - last_t <= 36000""")
def _(t):
    return rounded(T.live_devices(live_events(t), LIVE_AT, 36000.0).select("device_id", "x", "age_s"))


@query("device_sessions", f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN t - lag(t) OVER z < 36000 THEN 0 ELSE 1 END AS st FROM ev WINDOW z AS (PARTITION BY device_id ORDER BY t, event_id)),
n AS (SELECT *, sum(st) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM s)
SELECT device_id, CAST(session_no AS BIGINT) AS session_no, min(t) AS start_t, max(t) AS end_t, count(*) AS events FROM n GROUP BY 1, 2""")
def _(t):
    return T.device_sessions(live_events(t), 36000.0)


@query("event_counts", """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("dedupe_events", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.pipelines import dedupe_batch
    return dedupe_batch(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


SENSOR = ["l_suppkey AS session_id", "(l_quantity - 25) / 10 AS ax", "(l_discount - 5e-2) * 10 AS ay", "98e-1 AS az", "l_tax AS gyro",
          "l_quantity AS mx", "l_discount * 300 AS my", "l_extendedprice / 1e3 AS mz"]


@query("stillness_calibration", """SELECT l_suppkey AS session_id, round(avg(sqrt(((l_quantity - 25) / 10)*((l_quantity - 25) / 10) + ((l_discount - 5e-2) * 10)*((l_discount - 5e-2) * 10) + 98e-1*98e-1)), 6) AS gravity, round(avg(l_tax), 6) AS gyro_bias FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(T.stillness_calibration(t.lineitem.selectExpr(*SENSOR)))


@query("magnetometer_calibration", """WITH g AS (SELECT l_suppkey AS session_id, min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount * 300) AS c, max(l_discount * 300) AS d, min(l_extendedprice / 1e3) AS e, max(l_extendedprice / 1e3) AS f FROM lineitem GROUP BY 1 HAVING count(*) >= 10),
h AS (SELECT *, (b-a)/2 AS rx, (d-c)/2 AS ry, (f-e)/2 AS rz FROM g)
SELECT session_id, round((a+b)/2, 6) AS hard_mx, round((c+d)/2, 6) AS hard_my, round((e+f)/2, 6) AS hard_mz, round((rx+ry+rz)/3/rx, 6) AS soft_mx, round((rx+ry+rz)/3/ry, 6) AS soft_my, round((rx+ry+rz)/3/rz, 6) AS soft_mz FROM h""")
def _(t):
    return rounded(T.magnetometer_calibration(t.lineitem.selectExpr(*SENSOR)))


PAIR = ["user_id AS session_id", "event_id", "(event_id * 7 % 400) / 1e1 AS fx", "(event_id * 11 % 400) / 1e1 AS fy", "CAST((event_id * 53) % 360 AS DOUBLE) AS heading"]


def align_pairs(t):
    """Building points seen from a device frame turned by 0.6 rad, with a little noise."""
    p = t.events.selectExpr(*PAIR, "ts").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")
    c, s, n = F.cos(F.lit(0.6)), F.sin(F.lit(0.6)), (F.col("event_id") % 7 - 3) / 50.0
    return p.withColumns({"dx": F.col("fx") * c - F.col("fy") * s + 3 + n, "dy": F.col("fx") * s + F.col("fy") * c - 2 - n,
                          "yaw": F.radians("heading") - 0.55})


@query("rigid_alignment", f"""WITH p AS (SELECT {', '.join(PAIR)}, {EPOCH} AS t, (event_id % 7 - 3) / 5e1 AS n FROM events),
d AS (SELECT *, fx*cos(6e-1) - fy*sin(6e-1) + 3 + n AS dx, fx*sin(6e-1) + fy*cos(6e-1) - 2 - n AS dy, 55e-2 AS th, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, event_id DESC) AS back FROM p),
k AS (SELECT *, count(*) OVER (PARTITION BY session_id) - back + 1 AS w FROM d WHERE back <= 6),
m AS (SELECT session_id, sum(w*fx)/sum(w) AS mfx, sum(w*fy)/sum(w) AS mfy, sum(w*dx)/sum(w) AS mdx, sum(w*dy)/sum(w) AS mdy, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT session_id, any_value(m.n) AS n, any_value(mfx) AS mfx, any_value(mfy) AS mfy, any_value(mdx) AS mdx, any_value(mdy) AS mdy, sum(w*((fx-mfx)*(dy-mdy)-(fy-mfy)*(dx-mdx))) AS sc, sum(w*((fx-mfx)*(dx-mdx)+(fy-mfy)*(dy-mdy))) AS sd FROM k JOIN m USING (session_id) GROUP BY 1),
sp AS (SELECT a.session_id, max(sqrt((a.fx-b.fx)*(a.fx-b.fx)+(a.fy-b.fy)*(a.fy-b.fy))) AS span FROM k a JOIN k b USING (session_id) GROUP BY 1),
r AS (SELECT c.*, span, CASE WHEN n >= 2 AND span >= 3 THEN 55e-2 + least(8e-1, (span-3)/12 + 2e-1) * (atan2(sc, sd) - 55e-2) ELSE 55e-2 END AS rot FROM c JOIN sp USING (session_id))
SELECT session_id, CAST(n AS INT) AS n, round(rot, 6) AS rot, round(span, 6) AS span, round(mdx - (mfx*cos(rot) - mfy*sin(rot)), 5) AS tx, round(mdy - (mfx*sin(rot) + mfy*cos(rot)), 5) AS ty FROM r""")
def _(t):
    a = T.rigid_alignment(align_pairs(t))
    return a.select("session_id", "n", F.round("rot", 6).alias("rot"), F.round("span", 6).alias("span"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


# ------------------------------------------------------------------ reports
LOG = f"lg AS (SELECT device_id AS session_id, event_id, source, source = 'VPR' AS tracking, latency_ms, confidence, x, y, event_id % 40 AS steps_since_fix, CASE WHEN event_id % 3 = 0 THEN (event_id % 50) / 1e1 END AS drift_m FROM v_points)"


def live_log(t):
    return t.v_points.selectExpr("device_id AS session_id", "event_id", "source", "source = 'VPR' AS tracking", "latency_ms", "confidence", "x", "y",
                                 "event_id % 40 AS steps_since_fix", "CASE WHEN event_id % 3 = 0 THEN (event_id % 50) / 1e1 END AS drift_m")


@query("live_log_summary", f"""WITH {LOG}, a AS (SELECT session_id, count(*) FILTER (source IN ('VPR','VPR_MISS')) AS attempts, count(*) FILTER (tracking) AS matched, avg(latency_ms) FILTER (source IN ('VPR','VPR_MISS')) AS lat,
  max(latency_ms) FILTER (source IN ('VPR','VPR_MISS')) AS max_latency_ms, avg(confidence) FILTER (tracking) AS conf, count(*) FILTER (source = 'PDR') AS step_updates, max(steps_since_fix) FILTER (source = 'PDR') AS max_steps_between_fixes,
  avg(drift_m) FILTER (tracking) AS ad, max(drift_m) FILTER (tracking) AS md, count(DISTINCT (round_even(x, 1), round_even(y, 1))) FILTER (tracking) AS distinct_positions FROM lg GROUP BY 1)
SELECT session_id, attempts, matched, round(lat, 6) AS avg_latency_ms, max_latency_ms, round(conf, 6) AS avg_confidence, step_updates, max_steps_between_fixes, round(ad, 6) AS avg_drift_m, round(md, 6) AS max_drift_m, distinct_positions,
  round(matched / CAST(attempts AS DOUBLE), 6) AS match_rate, matched < 7e-1 * attempts AS warn_match_rate, distinct_positions <= 5 AND matched > 10 AS warn_few_positions, lat > 1500 AS warn_latency,
  NOT (matched < 7e-1 * attempts) AND distinct_positions > 5 AND NOT (lat > 1500) AS no_red_flags FROM a WHERE attempts > 0""")
def _(t):
    return rounded(D.live_log_summary(live_log(t)))


@query("top_positions", """SELECT round_even(x, 1) AS x, round_even(y, 1) AS y, count(*) AS times FROM (SELECT x / 10 AS x, y / 10 AS y FROM v_points WHERE source = 'VPR') GROUP BY 1, 2 ORDER BY times DESC, x, y LIMIT 10""")
def _(t):
    return D.top_positions(t.v_points.where("source = 'VPR'").selectExpr("x / 10 AS x", "y / 10 AS y"))


@query("trigger_counts", "SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS trigger, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return D.counts_by(t.events.select(F.nullif("event_type", F.lit("view")).alias("trigger")), "trigger")


@query("blur_skips", "SELECT count(*) FILTER (event_type = 'click') AS blur_skips FROM events")
def _(t):
    return D.blur_skips(t.events.select(F.when(F.col("event_type") == "click", "frame_skipped_blur").otherwise("other").alias("event")))


# misses: images asked under a false place; their candidates come from neighbouring ids
MISS = """ms AS (SELECT image_id AS miss_id, CASE WHEN image_id % 4 = 0 THEN NULL ELSE (location_id + image_id) % 10 END AS truth FROM v_images),
cd AS (SELECT i.image_id AS miss_id, c.location_id, c.x, c.y + CASE WHEN c.image_id % 2 = 0 THEN 3e-1 ELSE 7e-1 END AS y, c.image_id FROM v_images i JOIN v_images c ON c.image_id BETWEEN i.image_id + 1 AND i.image_id + 3 WHERE i.image_id % 5 <> 0),
tr AS (SELECT ms.miss_id, truth, count(cd.miss_id) AS n, bool_or(coalesce(cd.location_id + 100 = truth OR EXISTS (SELECT 1 FROM v_images r WHERE r.location_id = truth AND sqrt((r.x-cd.x)*(r.x-cd.x)+(r.y-cd.y)*(r.y-cd.y)) <= 5e-1), false)) AS got
  FROM ms LEFT JOIN cd USING (miss_id) GROUP BY 1, 2)"""


def misses(t):
    return t.v_images.select(F.col("image_id").alias("miss_id"), F.when(F.col("image_id") % 4 != 0, (F.col("location_id") + F.col("image_id")) % 10).alias("truth_location"))


def miss_candidates(t):
    i = t.v_images.where("image_id % 5 <> 0").select(F.col("image_id").alias("miss_id"), F.explode(F.array(*[F.col("image_id") + k for k in (1, 2, 3)])).alias("image_id"))
    c = t.v_images.select("image_id", (F.col("location_id") + 100).alias("location_id"), "x", (F.col("y") + F.when(F.col("image_id") % 2 == 0, 0.3).otherwise(0.7)).alias("y"))
    return i.join(c, "image_id")


@query("ground_truth_retrieved", f"WITH {MISS} SELECT miss_id, got AS retrieved FROM tr WHERE truth IS NOT NULL")
def _(t):
    return D.ground_truth_retrieved(misses(t), miss_candidates(t), t.v_images)


@query("classify_misses", f"""WITH {MISS} SELECT miss_id, n AS candidate_count, CASE WHEN n = 0 THEN 'no_candidates' WHEN truth IS NOT NULL AND NOT got THEN 'retrieval_failure' WHEN truth IS NOT NULL THEN 'verification_rejection'
  ELSE 'verification_rejected_ground_truth_unknown' END AS failure_stage FROM tr""")
def _(t):
    return D.classify_misses(misses(t), miss_candidates(t), t.v_images).select("miss_id", "candidate_count", "failure_stage")


@query("miss_stage_counts", f"""WITH {MISS}, s AS (SELECT CASE WHEN n = 0 THEN 'no_candidates' WHEN truth IS NOT NULL AND NOT got THEN 'retrieval_failure' WHEN truth IS NOT NULL THEN 'verification_rejection'
  ELSE 'verification_rejected_ground_truth_unknown' END AS failure_stage FROM tr) SELECT failure_stage, count(*) AS n FROM s GROUP BY 1""")
def _(t):
    return D.counts_by(D.classify_misses(misses(t), miss_candidates(t), t.v_images), "failure_stage")


@query("candidate_vs_reference", """WITH m AS (SELECT image_id AS miss_id, CASE WHEN image_id % 4 <> 0 THEN location_id END AS truth FROM v_images), c AS (SELECT miss_id, truth, miss_id + k AS image_id, (miss_id + k) % 10 AS loc FROM m, (SELECT range + 1 AS k FROM range(2)) r)
SELECT miss_id, c.image_id, CASE WHEN truth IS NULL THEN NULL WHEN loc = truth THEN 'ground-truth location' ELSE 'other location' END AS tag, orientation AS sharpness, round((17e8 - 1690848000) / 86400, 6) AS age_days FROM c LEFT JOIN v_images i ON i.image_id = c.image_id""")
def _(t):
    c = lambda k: F.struct((F.col("image_id") + k).alias("image_id"), ((F.col("image_id") + k) % 10).cast("int").alias("location_id"), F.lit("2023-08-01T00:00:00Z").alias("timestamp"))
    m = t.v_images.select(F.col("image_id").alias("miss_id"), F.lit(1.7e9).alias("received_at"), F.when(F.col("image_id") % 4 != 0, F.col("location_id")).alias("truth_location"), F.array(c(1), c(2)).alias("candidates"))
    r = D.candidate_vs_reference(m, t.v_images.select("image_id", F.col("orientation").alias("sharpness")))
    return rounded(r.select("miss_id", "image_id", "tag", "sharpness", "age_days"))


@query("first_n_samples", "SELECT device_id, event_id, k AS sample_no FROM (SELECT user_id AS device_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS k FROM events) WHERE k <= 5")
def _(t):
    e = t.events.select(F.col("user_id").alias("device_id"), "event_id", F.col("ts").alias("t"))
    return D.first_n_samples(e, 5, ["device_id"]).select("device_id", "event_id", "sample_no")


@query("last_n", "SELECT device_id, event_id, k AS sample_no FROM (SELECT user_id AS device_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS k FROM events) WHERE k <= 20")
def _(t):
    e = t.events.select(F.col("user_id").alias("device_id"), "event_id", F.col("ts").alias("t"))
    return D.first_n_samples(e, 20, ["device_id"], newest=True).select("device_id", "event_id", "sample_no")


@query("strided_sample", "WITH n AS (SELECT greatest(1, count(*) // 40) AS step FROM v_images), r AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM v_images) SELECT image_id FROM r, n WHERE i % step = 0 AND i // step < 40")
def _(t):
    return D.strided_sample(t.v_images, 40, [F.col("image_id")]).select("image_id")

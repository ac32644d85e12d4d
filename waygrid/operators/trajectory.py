"""Device trajectories: fixes, odometry, steps, calibration and live state (batch form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.floors import normalize_floor
from ..functions.geometry import signed_heading_delta
from .ordered import placed, scan

# Confidence decay per pose and per step, seed confidence, live time.
POSE_DECAY, POSE_FLOOR = 0.98, 0.1
STEP_DECAY, STEP_FLOOR = 0.985, 0.08
SEED_CONFIDENCE = 0.2
LIVE_TTL_S = 300.0
# Walking offset and stride limits.
OFFSET_MIN_STEPS, OFFSET_MIN_M, OFFSET_MIN_CONFIDENCE = 6, 2.0, 0.45
OFFSET_RATIO, OFFSET_CONCENTRATION = (0.65, 1.8), 0.85
# Rigid alignment keeps this many fixes and needs this span.
ALIGN_KEEP, ALIGN_SPAN_MIN_M = 6, 3.0

DEVICE = ["device_id"]


def confidence_decay(at_fix: Column, k: Column, rate: float = POSE_DECAY, floor: float = POSE_FLOOR) -> Column:
    """Confidence ``k`` updates after a fix; no fix yet means the floor."""
    aged = F.greatest(F.coalesce(at_fix, F.lit(0.0)) * F.pow(F.lit(rate), k), F.lit(floor))
    return F.when(k == 0, at_fix).otherwise(aged)


def fuse_positions(rows: DataFrame, t: str = "t", order: Sequence[str] = ("t", "kind", "event_id"), parts: int | None = None) -> DataFrame:
    """Fixes reset the position, odometry moves it and wears the confidence down.

    ``rows``: device_id, event_id, t, kind ('a_pose' sorts before 'b_fix' at one time),
    matched, x, y, heading, floor, confidence. A pose holds local coordinates; the offset
    to the building is frozen at the last fix. Before any fix poses are reported as they are.
    """
    order = list(order)
    pose = F.col("kind") == "a_pose"
    fix = (F.col("kind") == "b_fix") & F.col("matched")
    local = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.pmod("heading", F.lit(360.0)).alias("h"))
    r = scan(placed(rows, DEVICE, order, parts), DEVICE, order, {"n_pose": F.when(pose, 1).otherwise(0)}, {"vio": (local, pose)})
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"))
    v = F.coalesce(F.col("vio"), zero)
    turn = F.pmod(F.col("heading") - v["h"] + 360.0, F.lit(360.0))
    a = F.radians(turn)
    lock = F.struct(
        turn.alias("turn"), (F.col("x") - (v["x"] * F.cos(a) - v["y"] * F.sin(a))).alias("ox"),
        (F.col("y") - (v["x"] * F.sin(a) + v["y"] * F.cos(a))).alias("oy"),
        F.col("confidence").alias("conf"), F.col("n_pose").alias("n"), normalize_floor("floor").alias("floor"))
    r = scan(r, DEVICE, order, lasts={"lock": (lock, fix)})
    k, rad = F.col("lock"), F.radians(F.col("lock.turn"))
    has = k.isNotNull()
    fx = k["ox"] + F.col("x") * F.cos(rad) - F.col("y") * F.sin(rad)
    fy = k["oy"] + F.col("x") * F.sin(rad) + F.col("y") * F.cos(rad)
    moved = pose & has
    out = r.where(pose | fix).withColumns({
        "fused_x": F.when(moved, fx).otherwise(F.col("x")), "fused_y": F.when(moved, fy).otherwise(F.col("y")),
        "fused_heading": F.when(moved, F.pmod(F.col("heading") + k["turn"], F.lit(360.0))).otherwise(F.pmod("heading", F.lit(360.0))),
        "fused_floor": F.coalesce(k["floor"], F.lit("1")),
        "fused_confidence": F.when(fix, F.col("confidence")).otherwise(
            confidence_decay(k["conf"], F.col("n_pose") - F.coalesce(k["n"], F.lit(0)))),
    })
    return out.select("device_id", "event_id", t, "kind", "fused_floor", "fused_x", "fused_y", "fused_heading", "fused_confidence")


def seed_positions(seeds: DataFrame) -> DataFrame:
    """Seeds (kiosk or door: device_id, event_id, t, x, y, heading, floor) as input events of the fuser: they place the device
    with little confidence. ``seed`` tells corridor matching that it is a new place, with no corridor to hold on to.
    """
    return seeds.withColumns({"kind": F.lit("b_fix"), "matched": F.lit(True), "confidence": F.lit(SEED_CONFIDENCE), "seed": F.lit(True)})


def steps_since_fix(rows: DataFrame, t: str = "t", parts: int | None = None) -> DataFrame:
    """Steps since the last fix, and at a fix the distance from the carried position.

    ``rows``: device_id, event_id, t, is_fix, is_step, x, y.
    """
    order = [t, "event_id"]
    r = scan(placed(rows, DEVICE, order, parts), DEVICE, order, {"n_steps": F.when(F.col("is_step"), 1).otherwise(0)}, prevs=["x", "y"])
    r = scan(r, DEVICE, order, lasts={"at_fix": (F.col("n_steps"), F.col("is_fix"))})
    drift = F.when(F.col("is_fix"), F.hypot(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")))
    return r.select("device_id", "event_id", (F.col("n_steps") - F.coalesce("at_fix", F.lit(0))).alias("steps_since_fix"), drift.alias("drift_m"))


def consecutive_floor_hits(rows: DataFrame, t: str = "t", need: int = 2, parts: int | None = None) -> DataFrame:
    """Count of colour readings in a row that name the landing floor; ``seed`` at the ``need``-th.

    ``rows``: device_id, event_id, t, seen_floor, landing_floor. A reading of another floor,
    or none, starts again.
    """
    hit = F.coalesce(normalize_floor("seen_floor") == normalize_floor("landing_floor"), F.lit(False)) & F.col("seen_floor").isNotNull()
    order = [t, "event_id"]
    r = scan(placed(rows.withColumn("_hit", hit), DEVICE, order, parts), DEVICE, order, {"n_hit": F.when(F.col("_hit"), 1).otherwise(0)})
    r = scan(r, DEVICE, order, lasts={"base": (F.col("n_hit"), ~F.col("_hit"))})
    hits = F.col("n_hit") - F.coalesce("base", F.lit(0))
    return r.select("device_id", "event_id", hits.alias("hits"), (F.col("_hit") & (hits == need)).alias("seed"))


def infer_walking_offset(rows: DataFrame, t: str = "t", parts: int | None = None) -> DataFrame:
    """Angle between sensed heading and walked direction, from consecutive fixes.

    ``rows``: device_id, event_id, t, is_fix, is_step, x, y, floor, confidence, heading,
    step_m. Gives one row per fix after a fix; the offset is NULL when it cannot be trusted.
    """
    order = [t, "event_id"]
    step = lambda e: F.when(F.col("is_step"), e).otherwise(F.lit(0.0))
    sums = {"n": step(F.lit(1.0)), "path": step(F.col("step_m")), "ss": step(F.sin(F.radians("heading"))), "cs": step(F.cos(F.radians("heading")))}
    r = scan(placed(rows, DEVICE, order, parts), DEVICE, order, sums).where("is_fix")
    r = scan(r, DEVICE, order, prevs=["x", "y", "floor", "n", "path", "ss", "cs"])
    d = lambda c: F.col(c) - F.col(f"prev_{c}")
    r = r.where("prev_x is not null").withColumns({
        "steps": d("n"), "path_m": d("path"), "fix_m": F.hypot(d("x"), d("y")),
        "conc": F.try_divide(F.hypot(d("ss"), d("cs")), d("n")), "mean_h": F.degrees(F.atan2(d("ss"), d("cs"))), "walk_h": F.degrees(F.atan2(d("x"), d("y")))})
    ratio = F.try_divide(F.col("fix_m"), F.col("path_m"))
    ok = ((F.col("floor") == F.col("prev_floor")) & (F.col("confidence") >= OFFSET_MIN_CONFIDENCE) & (F.col("steps") >= OFFSET_MIN_STEPS)
          & (F.col("path_m") >= OFFSET_MIN_M) & (F.col("fix_m") >= OFFSET_MIN_M) & ratio.between(*OFFSET_RATIO) & (F.col("conc") >= OFFSET_CONCENTRATION))
    offset = F.when(ok, signed_heading_delta(F.col("walk_h"), F.col("mean_h")))
    return r.select("device_id", "event_id", t, F.col("steps").cast("long").alias("steps"), "path_m", "fix_m", offset.alias("offset_deg"))


def route_change_log(routes: DataFrame, t: str = "t", parts: int | None = None) -> DataFrame:
    """Only routes that differ from the device's previous one, at half-metre resolution.

    ``routes``: device_id, event_id, t, slot_id, waypoints ARRAY<STRUCT(x, y)>.
    """
    half = lambda v: F.format_string("%.1f", F.bround(v * 2, 0) / 2 + F.lit(0.0))
    sig = F.concat_ws(";", F.col("slot_id").cast("string"), F.array_join(F.transform(
        "waypoints", lambda w: F.concat_ws(",", half(w["x"]), half(w["y"]))), ";"))
    r = scan(routes.withColumn("signature", sig), DEVICE, [t, "event_id"], prevs=["signature"], parts=parts)
    return r.where(F.col("prev_signature").isNull() | (F.col("prev_signature") != F.col("signature"))).drop("prev_signature")


def next_free_session(*tables: DataFrame) -> DataFrame:
    """One past the largest session id of all tables; 0 when there is none."""
    ids = tables[0].select("session_id")
    for df in tables[1:]:
        ids = ids.unionByName(df.select("session_id"))
    return ids.agg((F.coalesce(F.max("session_id"), F.lit(-1)) + 1).alias("next_session"))


def session_stats(landmarks: DataFrame, tags: DataFrame) -> DataFrame:
    n = lambda d, name: d.groupBy("session_id").agg(F.count("*").alias(name))
    return n(landmarks, "landmarks").join(n(tags, "tags"), "session_id", "full_outer").fillna(0, ["landmarks", "tags"])


def live_devices(events: DataFrame, as_of: float, ttl_s: float = LIVE_TTL_S) -> DataFrame:
    """Devices live at a moment: last heartbeat within the time limit and not ended since.

    ``events``: device_id, t, event ('fix', 'pose', 'heartbeat', 'end'), x, y, floor.
    """
    seen = events.where(F.col("t") <= as_of)
    pos = F.when(F.col("event").isin("fix", "pose"), F.struct("t", "x", "y", "floor"))
    g = seen.groupBy("device_id").agg(F.max(pos).alias("p"), F.max(F.struct("t", "event")).alias("last"))
    live = F.col("p").isNotNull() & (F.col("last.event") != "end") & (F.lit(as_of) - F.col("last.t") <= ttl_s)
    return g.where(live).select("device_id", F.col("p.floor").alias("floor"), F.col("p.x").alias("x"), F.col("p.y").alias("y"),
                                (F.lit(as_of) - F.col("last.t")).alias("age_s"))


def device_sessions(events: DataFrame, gap_s: float = LIVE_TTL_S, t: str = "t", parts: int | None = None) -> DataFrame:
    """Runs of events per device without a pause longer than the gap."""
    order = [t, "event_id"]
    r = scan(placed(events, DEVICE, order, parts), DEVICE, order, prevs=[t])
    start = F.when(F.col(f"prev_{t}").isNull() | (F.col(t) - F.col(f"prev_{t}") >= gap_s), 1).otherwise(0)
    r = scan(r, DEVICE, order, {"session_no": start})
    return r.groupBy("device_id", "session_no").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("events"))


# ------------------------------------------------------------------ calibration
def stillness_calibration(samples: DataFrame, keys=("session_id",)) -> DataFrame:
    mag = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    return samples.groupBy(*keys).agg(F.avg(mag).alias("gravity"), F.avg("gyro").alias("gyro_bias"))


def magnetometer_calibration(samples: DataFrame, keys=("session_id",), min_samples: int = 10) -> DataFrame:
    """Hard-iron centre and soft-iron scale per axis."""
    g = samples.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("mx", "my", "mz") for n, f in (("lo", F.min), ("hi", F.max))])
    g = g.where(F.col("n") >= min_samples)
    half = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2.0
    rng = {c: F.when(half(c) == 0, 1.0).otherwise(half(c)) for c in ("mx", "my", "mz")}
    avg = (rng["mx"] + rng["my"] + rng["mz"]) / 3.0
    return g.select(*keys, *[((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2.0).alias(f"hard_{c}") for c in rng],
                    *[(avg / r).alias(f"soft_{c}") for c, r in rng.items()])


def rigid_alignment(pairs: DataFrame, keys=("session_id",), order=("t", "event_id"), keep: int = ALIGN_KEEP) -> DataFrame:
    """Weighted rotation and shift that carries building points onto device points.

    ``pairs``: fx, fy (building), dx, dy (device plane), heading, yaw (radians). The last
    ``keep`` pairs count, newer ones more; headings and positions are blended by how far
    the positions are apart.
    """
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = pairs.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= keep)
    fields = ["back", "fx", "fy", "dx", "dy", "heading", "yaw"]
    g = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("ps"))
    p = g.select(*keys, F.size("ps").alias("n"), F.posexplode("ps").alias("i", "q"), F.col("ps"))
    w = (F.col("i") + 1).cast("double")
    th = F.radians(F.col("q.heading")) - F.col("q.yaw")
    m = p.groupBy(*keys, "n").agg(
        F.sum(w).alias("W"), *[(F.sum(w * F.col(f"q.{c}")) / F.sum(w)).alias(f"m_{c}") for c in ("fx", "fy", "dx", "dy")],
        F.sum(w * F.sin(th)).alias("hs"), F.sum(w * F.cos(th)).alias("hc"), F.count(th).alias("hn"), F.first("ps").alias("ps"))
    far = lambda a: F.array_max(F.transform("ps", lambda b: F.hypot(a["fx"] - b["fx"], a["fy"] - b["fy"])))
    total = lambda fn: F.aggregate(F.transform("ps", lambda q, i: (i + 1).cast("double") * fn(
        q["fx"] - F.col("m_fx"), q["fy"] - F.col("m_fy"), q["dx"] - F.col("m_dx"), q["dy"] - F.col("m_dy"))), F.lit(0.0), lambda s, v: s + v)
    m = m.withColumns({
        "span": F.array_max(F.transform("ps", far)), "sc": total(lambda a, b, c, d: a * d - b * c), "sd": total(lambda a, b, c, d: a * c + b * d)})
    pos = F.when((F.col("n") >= 2) & (F.col("span") >= ALIGN_SPAN_MIN_M), F.atan2("sc", "sd"))
    head = F.when(F.col("hn") > 0, F.atan2("hs", "hc"))
    share = F.least(F.lit(0.8), (F.col("span") - ALIGN_SPAN_MIN_M) / 12.0 + 0.2)
    diff = F.atan2(F.sin(pos - head), F.cos(pos - head))
    rot = F.when(head.isNotNull() & pos.isNotNull(), head + share * diff).otherwise(F.coalesce(head, pos, F.lit(0.0)))
    m = m.withColumn("rot", rot)
    c, s = F.cos("rot"), F.sin("rot")
    return m.select(*keys, "n", "rot", "span", (F.col("m_dx") - (F.col("m_fx") * c - F.col("m_fy") * s)).alias("tx"),
                    (F.col("m_dy") - (F.col("m_fx") * s + F.col("m_fy") * c)).alias("ty"))

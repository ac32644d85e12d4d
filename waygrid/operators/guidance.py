"""Guidance along a route polyline held as ARRAY<STRUCT(x, y)>.

A route has a bounded number of waypoints, so these are array expressions per row: no
shuffle, any number of positions in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import bearing, clamp, num, signed_heading_delta, turn_label
from ..functions.vectors import bind
from .ordered import scan
from .routing import drop_near, path_length

# Joining the walkway, lanes, turns, arrival, lifts and facing.
JOIN_MIN_OFF_M, JOIN_MIN_M, JOIN_MAX_M = 0.75, 3.0, 8.0
LANE_STRAIGHT_DEG, LANE_ON_LINE_M = 20.0, 0.3
TURN_POINT_GAP_M = 0.1
ARRIVE_M, ARRIVE_SLOT_M, ARRIVE_SPUR_MAX_M, ARRIVE_ABREAST_M = 2.0, 3.0, 8.0, 1.0
LIFT_NEAR_M, ENTER_CONNECTOR_M = 12.0, 3.0
FACE_TURN_DEG, FACE_UTURN_DEG, FACE_UTURN_CLEAR_DEG = 60.0, 120.0, 100.0
MERGE_MIN_OFF_M, MERGE_MIN_M, MERGE_MAX_M = 0.75, 3.0, 8.0
REJOIN_NEXT_GAIN_M, REJOIN_NEXT_RATIO = 1.0, 1.5


def _c(points) -> Column:
    return F.col(points) if isinstance(points, str) else points


def pt(x, y) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"))


def gap(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def at(p: Column, i) -> Column:
    """Waypoint by zero-based index; negative counts from the end; NULL outside."""
    if isinstance(i, int) and i < 0:
        return F.get(p, F.size(p) + i)
    return F.get(p, F.lit(i) if isinstance(i, int) else i)


def tail(p: Column, i) -> Column:
    """Waypoints from zero-based index on."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.slice(p, i + 1, F.greatest(F.size(p) - i, F.lit(0)))


def cumulative(points) -> Column:
    """Metres along the polyline at each waypoint."""
    p = _c(points)
    start = F.struct(F.array().cast("array<double>").alias("s"), F.lit(None).cast("struct<x:double,y:double>").alias("q"))
    step = lambda acc, q: F.struct(
        F.concat(acc["s"], F.array(F.coalesce(F.get(acc["s"], F.size(acc["s"]) - 1) + gap(acc["q"], q), F.lit(0.0)))).alias("s"),
        F.struct(q["x"].alias("x"), q["y"].alias("y")).alias("q"))
    return F.aggregate(p, start, step, lambda acc: acc["s"])


def _project(p: Column, x: Column, y: Column) -> Column:
    """Nearest place on a polyline: STRUCT(off, i, t, fx, fy); the first stretch wins ties."""
    def one(i):
        a, b = at(p, i), at(p, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, clamp(((x - a["x"]) * dx + (y - a["y"]) * dy) / len2, 0.0, 1.0)).otherwise(0.0)
        return bind(F.struct(t.alias("t"), a.alias("a"), dx.alias("dx"), dy.alias("dy")), lambda k: bind(
            F.struct((k["a"]["x"] + k["t"] * k["dx"]).alias("fx"), (k["a"]["y"] + k["t"] * k["dy"]).alias("fy")),
            lambda f: F.struct(F.round(F.hypot(x - f["fx"], y - f["fy"]), 9).alias("off"), i.alias("i"), k["t"].alias("t"),
                               f["fx"].alias("fx"), f["fy"].alias("fy"))))
    return F.when(F.size(p) >= 2, F.array_min(F.transform(F.sequence(F.lit(0), F.size(p) - 2), one)))


def route_progress(points, x, y) -> Column:
    """STRUCT(along, remaining, off, i, t, fx, fy) of a position on a route."""
    p, x, y = _c(points), num(x), num(y)
    return bind(F.struct(_project(p, x, y).alias("n"), cumulative(p).alias("s")), lambda k: bind(
        F.get(k["s"], k["n"]["i"]) + k["n"]["t"] * (F.get(k["s"], k["n"]["i"] + 1) - F.get(k["s"], k["n"]["i"])),
        lambda along: F.struct(
            along.alias("along"), F.greatest(F.get(k["s"], F.size(p) - 1) - along, F.lit(0.0)).alias("remaining"),
            k["n"]["off"].alias("off"), k["n"]["i"].alias("i"), k["n"]["t"].alias("t"), k["n"]["fx"].alias("fx"), k["n"]["fy"].alias("fy"))))


def point_at(points, s) -> Column:
    """STRUCT(x, y, dir) at ``s`` metres, held to the ends of the polyline."""
    p, s = _c(points), F.greatest(num(s), F.lit(0.0))
    def find(cum):
        inner = F.sequence(F.lit(0), F.size(p) - 2)
        ok = F.filter(inner, lambda i: ((s <= F.get(cum, i + 1)) | (i == F.size(p) - 2)) & (F.get(cum, i + 1) - F.get(cum, i) >= 1e-6))
        return F.get(ok, F.lit(0))
    def place(cum):
        return bind(find(cum), lambda i: bind(F.least(F.lit(1.0), (s - F.get(cum, i)) / (F.get(cum, i + 1) - F.get(cum, i))), lambda t: F.struct(
            (at(p, i)["x"] + (at(p, i + 1)["x"] - at(p, i)["x"]) * t).alias("x"),
            (at(p, i)["y"] + (at(p, i + 1)["y"] - at(p, i)["y"]) * t).alias("y"),
            bearing(at(p, i)["x"], at(p, i)["y"], at(p, i + 1)["x"], at(p, i + 1)["y"]).alias("dir"))))
    return F.when(F.size(p) >= 2, bind(cumulative(p), place))


def look_ahead(points, x, y, metres: float = 6.0) -> Column:
    """Point ``metres`` further along the route than the position."""
    return bind(route_progress(points, x, y), lambda g: point_at(points, g["along"] + metres))


def remaining_waypoints(points, x, y) -> Column:
    """The route from the foot of the position on."""
    p = _c(points)
    cutoff = lambda n: F.concat(F.array(F.struct(n["fx"].alias("x"), n["fy"].alias("y"))), tail(p, n["i"] + 1))
    return F.when(F.size(p) < 2, p).otherwise(bind(_project(p, num(x), num(y)), cutoff))


def clamp_to_dest(points, dx, dy) -> Column:
    """Route that stops beside the destination: no spur into it, nothing past it."""
    p0, x, y = _c(points), num(dx), num(dy)
    spur = (F.size(p0) >= 3) & (F.hypot(at(p0, -1)["x"] - x, at(p0, -1)["y"] - y) < 0.3)
    def trim(p):
        def close(n):
            foot = F.struct(n["fx"].alias("x"), n["fy"].alias("y"))
            head = F.slice(p, F.lit(1), n["i"] + 1)
            body = F.when(gap(at(p, n["i"]), foot) > 0.05, head).otherwise(F.slice(p, F.lit(1), n["i"]))
            out = F.concat(body, F.array(foot))
            return F.when(F.size(out) >= 2, out).otherwise(p)
        return bind(_project(p, x, y), close)
    short = bind(F.when(spur, F.slice(p0, F.lit(1), F.size(p0) - 1)).otherwise(p0), trim)
    return F.when((F.size(p0) < 2) | x.isNull() | y.isNull(), p0).otherwise(short)


def join_walkway(points, x, y) -> Column:
    """STRUCT(points, added): start at the user and merge a little way ahead."""
    p, x, y = _c(points), num(x), num(y)
    a, b = at(p, 0), at(p, 1)
    off, seg = F.hypot(x - a["x"], y - a["y"]), gap(a, b)
    want = clamp(2.0 * off, JOIN_MIN_M, JOIN_MAX_M)
    k = want / seg
    short = seg <= want
    merge = F.when(short, F.struct(b["x"].alias("x"), b["y"].alias("y"))).otherwise(
        pt(a["x"] + (b["x"] - a["x"]) * k, a["y"] + (b["y"] - a["y"]) * k))
    rest = F.when(short, tail(p, 2)).otherwise(tail(p, 1))
    skipped = F.when(short, seg).otherwise(want)
    out = bind(merge, lambda m: F.struct(
        F.concat(F.array(pt(x, y), F.struct(m["x"].alias("x"), m["y"].alias("y"))), rest).alias("points"),
        (F.hypot(m["x"] - x, m["y"] - y) - skipped).alias("added")))
    keep = (F.size(p) < 2) | (off < JOIN_MIN_OFF_M)
    return F.when(keep, F.struct(p.alias("points"), F.lit(0.0).alias("added"))).otherwise(out)


def lane_walkway(points, x, y) -> Column:
    """STRUCT(points, added, mode): walk in one's own lane up to the first corner.

    Modes: none (already on the line), direct, L (one sideways step), end (no corner).
    """
    p, x, y = _c(points), num(x), num(y)
    ox, oy = x - at(p, 0)["x"], y - at(p, 0)["y"]
    n = F.size(p)

    def corner(i):
        a, b, c = at(p, i - 1), at(p, i), at(p, i + 1)
        l1, l2 = gap(a, b), gap(b, c)
        unit = (l1 > 1e-9) & (l2 > 1e-9)
        cos = ((b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"])) / (l1 * l2)
        ang = F.degrees(F.acos(clamp(F.when(unit, cos).otherwise(0.0), -1.0, 1.0)))
        return ang >= LANE_STRAIGHT_DEG

    inner = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    first = F.get(F.filter(inner, corner), F.lit(0))

    def ahead(k):
        b, c = at(p, k), at(p, k + 1)
        slen = gap(b, c)
        sx = F.when(slen > 1e-9, (c["x"] - b["x"]) / slen).otherwise(0.0)
        sy = F.when(slen > 1e-9, (c["y"] - b["y"]) / slen).otherwise(0.0)
        t, h = ox * sx + oy * sy, F.abs(ox * sy - oy * sx)
        lane_end = F.array(pt(b["x"] + ox, b["y"] + oy))
        direct = F.concat(lane_end, F.when(t >= slen - 0.05, tail(p, k + 2)).otherwise(tail(p, k + 1)))
        tc = clamp(t, 0.0, slen)
        step = F.concat(lane_end, F.array(pt(b["x"] + sx * tc, b["y"] + sy * tc)), tail(p, k + 1))
        on_line = h < LANE_ON_LINE_M
        return F.struct(F.when(on_line, direct).otherwise(step).alias("rest"), F.when(on_line, "direct").otherwise("L").alias("mode"))

    last = at(p, -1)
    end = F.struct(F.array(pt(last["x"] + ox, last["y"] + oy), pt(last["x"], last["y"])).alias("rest"), F.lit("end").alias("mode"))
    plan = bind(first, lambda k: F.when(k.isNull(), end).otherwise(ahead(k)))
    done = bind(plan, lambda q: bind(drop_near(F.concat(F.array(pt(x, y)), q["rest"])), lambda w: F.struct(
        w.alias("points"), (path_length(w) - path_length(p)).alias("added"), q["mode"].alias("mode"))))
    keep = (n < 2) | (F.hypot(ox, oy) < JOIN_MIN_OFF_M)
    return F.when(keep, F.struct(p.alias("points"), F.lit(0.0).alias("added"), F.lit("none").alias("mode"))).otherwise(done)


def _merge_from(p: Column, x: Column, y: Column) -> Column:
    a, b = at(p, 0), at(p, 1)
    off, ln = F.hypot(x - a["x"], y - a["y"]), gap(a, b)
    want = clamp(2.0 * off, MERGE_MIN_M, MERGE_MAX_M)
    k = want / ln
    near = F.concat(F.array(pt(x, y)), F.when(ln <= want, tail(p, 1)).otherwise(F.concat(
        F.array(pt(a["x"] + (b["x"] - a["x"]) * k, a["y"] + (b["y"] - a["y"]) * k)), tail(p, 1))))
    return F.when((F.size(p) < 2) | (off < MERGE_MIN_OFF_M), p).otherwise(near)


def rejoin_waypoints(points, x, y) -> Column:
    """Way back onto the route from beside it: the nearest stretch, or the next one inside a bend."""
    p, x, y = _c(points), num(x), num(y)
    here = pt(x, y)

    def plan(rem0):
        rem = F.when((F.size(rem0) >= 2) & (gap(at(rem0, 0), at(rem0, 1)) < 0.05), tail(rem0, 1)).otherwise(rem0)
        return bind(rem, lambda r: F.when(
            F.exists(tail(p, 1), lambda w: gap(w, at(r, 0)) < 0.05), F.concat(F.array(here), r)).otherwise(bind(
                F.struct(_merge_from(r, x, y).alias("near"), F.when(F.size(r) >= 3, _project(F.slice(r, 2, 2), x, y)).alias("f")),
                lambda q: choose(r, q))))

    def choose(r, q):
        foot = F.struct(q["f"]["fx"].alias("x"), q["f"]["fy"].alias("y"))
        at_end = (gap(foot, at(r, 1)) < 0.05) | (gap(foot, at(r, 2)) < 0.05)
        far = gap(foot, here) > gap(at(r, 0), here) * REJOIN_NEXT_RATIO
        nxt = bind(_merge_from(F.concat(F.array(foot), tail(r, 2)), x, y), lambda m: F.when(
            path_length(m) < path_length(q["near"]) - REJOIN_NEXT_GAIN_M, m).otherwise(q["near"]))
        return F.when((F.size(r) < 3) | at_end | far, q["near"]).otherwise(nxt)

    return F.when(F.size(p) >= 2, bind(remaining_waypoints(p, x, y), plan))


def turn_instructions(points) -> Column:
    """ARRAY<STRUCT(label, along, is_arrival)>: turns of 30 degrees or more, then the arrival."""
    p = _c(points)
    kept = F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct(
        at(p, i)["x"].alias("x"), at(p, i)["y"].alias("y"),
        F.coalesce(gap(at(p, i), at(p, i - 1)) >= TURN_POINT_GAP_M, F.lit(True)).alias("keep"))), lambda q: q["keep"])
    row = lambda label, along, arrive: F.struct(label.alias("label"), along.alias("along"), F.lit(arrive).alias("is_arrival"))

    def build(q):
        def with_cum(cum):
            def turn(i):
                a, b, c = at(q, i - 1), at(q, i), at(q, i + 1)
                ix, iy, ux, uy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
                return row(turn_label(F.degrees(F.atan2(ix * uy - iy * ux, ix * ux + iy * uy))), F.get(cum, i), False)
            inner = F.when(F.size(q) >= 3, F.sequence(F.lit(1), F.size(q) - 2)).otherwise(F.array().cast("array<int>"))
            turns = F.filter(F.transform(inner, turn), lambda r: r["label"].isNotNull())
            total = F.get(cum, F.size(q) - 1)
            return bind(turns, lambda ts: F.concat(ts, F.array(row(
                F.when(F.size(ts) == 0, "Continue straight to your destination").otherwise("Arrive at your destination"), total, True))))
        here = F.array(row(F.lit("At your destination"), F.lit(0.0), True))
        return F.when(F.size(q) < 2, here).otherwise(bind(cumulative(q), with_cum))
    return bind(kept, build)


def arrival_flag(points, x, y, remaining) -> Column:
    """True beside the bay: level with it along the aisle, not merely near it."""
    # 9 dp so that a value on a limit falls on the same side everywhere
    p, x, y, rem = _c(points), num(x), num(y), F.round(num(remaining), 9)
    p0, a, b = at(p, -3), at(p, -2), at(p, -1)
    slot = F.round(F.hypot(x - b["x"], y - b["y"]), 9)
    spur, into = gap(a, b), gap(p0, a)
    u = F.round(F.try_divide((x - a["x"]) * (a["x"] - p0["x"]) + (y - a["y"]) * (a["y"] - p0["y"]), into), 9)
    shaped = F.coalesce((F.size(p) >= 3) & (spur > 0.5) & (spur <= ARRIVE_SPUR_MAX_M) & (into > 0.5), F.lit(False))
    level = (slot <= spur + 3.5) & (rem <= spur + 8) & (u >= -ARRIVE_ABREAST_M)
    plain = (rem <= ARRIVE_M) | ((slot <= ARRIVE_SLOT_M) & (rem <= ARRIVE_SPUR_MAX_M))
    by_shape = F.when(level, F.lit(True)).when(~(u >= -ARRIVE_ABREAST_M), (slot <= ARRIVE_SLOT_M) & (u >= -ARRIVE_SLOT_M)).otherwise(plain)
    return F.when(rem.isNull(), slot <= ARRIVE_SLOT_M).when(shaped, by_shape).otherwise(plain)


def landing_pose(points) -> Column:
    """Lift door: first waypoint, facing the first one at least half a metre away."""
    p = _c(points)
    a = at(p, 0)
    far = F.get(F.filter(p, lambda q: gap(q, a) >= 0.5), F.lit(0))
    return F.when((F.size(p) >= 2) & far.isNotNull(), F.struct(
        a["x"].alias("x"), a["y"].alias("y"), bearing(a["x"], a["y"], far["x"], far["y"]).alias("heading")))


def next_guidance(points, along, lift: Column | None = None, remaining: Column | None = None, direction: Column | None = None) -> Column:
    """STRUCT(label, distance, is_arrival, is_floor_change) of the next thing to do.

    ``lift``: connector id ahead on this leg, or NULL. ``direction``: up, down or straight.
    """
    along = num(along)
    todo = F.get(F.filter(turn_instructions(points), lambda r: r["is_arrival"] | (r["along"] - along >= -1.0)), F.lit(0))
    row = lambda label, d, arrive, change: F.struct(label.alias("label"), d.alias("distance"), arrive.alias("is_arrival"), F.lit(change).alias("is_floor_change"))
    if lift is None:
        return bind(todo, lambda r: row(r["label"], F.greatest(r["along"] - along, F.lit(0.0)), r["is_arrival"], False))
    go = F.when(direction == "down", "Go down").when(direction == "up", "Go up").otherwise("Change floor")
    door = remaining <= ENTER_CONNECTOR_M
    lift_row = row(F.when(door, go).otherwise(F.concat(F.lit("Walk to "), lift)), F.when(door, 0.0).otherwise(remaining), F.lit(False), True)
    plain = bind(todo, lambda r: row(
        F.when(r["is_arrival"] & lift.isNotNull(), F.concat(F.lit("Walk to "), lift)).otherwise(r["label"]),
        F.greatest(r["along"] - along, F.lit(0.0)), r["is_arrival"] & lift.isNull(), False))
    return F.when(lift.isNotNull() & (remaining < LIFT_NEAR_M), lift_row).otherwise(plain)


def facing_relative(points, x, y, heading) -> Column:
    """How far the route's direction here is from where the user faces; NULL at the end."""
    def rel(g):
        return bind(F.struct(point_at(points, g["along"] + 0.5).alias("a"), point_at(points, g["along"] + 3.5).alias("b")), lambda q: F.when(
            gap(q["a"], q["b"]) >= 0.5, signed_heading_delta(bearing(q["a"]["x"], q["a"]["y"], q["b"]["x"], q["b"]["y"]), heading)))
    return bind(route_progress(points, x, y), rel)


def facing_override(df: DataFrame, rel: str, keys, order, parts=None) -> DataFrame:
    """``facing``: Turn around from 120 degrees until under 100, Turn left/right from 60.

    Between the two limits the last clear reading decides, which a "last value" gives
    without a row-by-row walk.
    """
    a = F.abs(F.col(rel))
    said = F.when(a >= FACE_UTURN_DEG, F.lit(True)).when(a < FACE_UTURN_CLEAR_DEG, F.lit(False))
    out = scan(df, keys, order, lasts={"_u": (said, said.isNotNull())}, parts=parts)
    turned = F.coalesce("_u", F.lit(False))
    return out.withColumn("facing", F.when(F.col(rel).isNull(), F.lit(None)).when(turned, "Turn around").when(
        (a >= FACE_TURN_DEG) & (F.col(rel) > 0), "Turn right").when(a >= FACE_TURN_DEG, "Turn left")).drop("_u")

"""Matching positions to walkable corridors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import band_place, segment_key
from ..functions.vectors import bind
from ..session import cut
from .ordered import fold_ordered
from .spatial import across, nearest_piece, nine_places, piece_distance, prepare_pieces, project_on

# Cost of leaving the current corridor, of facing across one, and weights.
SWITCH_PENALTY_M = 1.2
HEADING_PENALTY_M = 0.6
HEADING_PENALTY_FROM_DEG = 50.0
CENTRE_WEIGHT = 0.05


def _cost(px: Column, py: Column, heading: Column | None):
    def cost(s: Column) -> Column:
        c = bind(piece_distance(px, py, s), lambda d: d["outside"] + CENTRE_WEIGHT * d["dist"])
        if heading is not None:
            c = c + F.when(across(heading, s["axis"]) > HEADING_PENALTY_FROM_DEG, HEADING_PENALTY_M).otherwise(0.0)
        return nine_places(c)
    return cost


def match_corridor(
    points: DataFrame, pieces: DataFrame, keys: Sequence[str] = ("floor",), order: str = "seg_ord",
    heading: str | None = "heading", x: str = "x", y: str = "y", cell_m: float = 8.0,
) -> DataFrame:
    """Place each point inside the cheapest corridor of its floor.

    Adds placed_x, placed_y, seg_key, centre_x, centre_y. Points on floors without
    corridors keep their position and get a NULL key.
    """
    prepared = cut(prepare_pieces(pieces, keys, order))
    widest = prepared.agg(F.max(F.greatest("left", "right"))).first()[0] or 0.0
    px, py = F.col(x), F.col(y)
    cost = _cost(px, py, F.col(heading) if heading else None)
    # a piece further than r is at least r - widest outside its band
    unseen = lambda r: F.lit(max(r - widest, 0.0) + CENTRE_WEIGHT * r)
    rows = nearest_piece(points, prepared, keys, cost, unseen, x, y, cell_m)
    # a zero-length piece is a disc: its "band" is the radius round the point
    rows = project_on(rows, "piece", x, y)
    g = lambda f: F.col(f"piece.seg.{f}")
    rows = rows.withColumn("_held", F.least(F.greatest("_lat", -g("right")), g("left")))
    rows = rows.withColumn("_dist", F.hypot("_over", "_lat"))
    disc, wide = g("len") == 0, F.greatest(g("left"), g("right"))
    inside = F.when(disc, F.col("_dist") <= wide).otherwise(F.hypot(F.col("_over"), F.col("_lat") - F.col("_held")) <= 1e-9)
    rows = rows.withColumns({"_in": F.coalesce(inside, F.lit(True)), "_k": F.try_divide(wide, F.col("_dist"))})
    edge = lambda p, n, d: F.when(F.col("_in"), p).when(disc, F.col(n) + (p - F.col(n)) * F.col("_k")).otherwise(F.col(n) + d * F.col("_held"))
    return rows.withColumns({
        "placed_x": edge(px, "_nx", -g("uy")), "placed_y": edge(py, "_ny", g("ux")),
        "seg_key": F.when(F.col("piece").isNotNull(), segment_key(g("x1"), g("y1"), g("x2"), g("y2"))),
        "centre_x": F.col("_nx"), "centre_y": F.col("_ny"), "match_cost": F.col("piece.cost"),
    }).drop("_along", "_lat", "_t", "_over", "_nx", "_ny", "_held", "_dist", "_in", "_k")


def snap_to_walkable(
    points: DataFrame, segments: DataFrame, keys: Sequence[str] = ("floor",), order: str = "seg_ord",
    x: str = "x", y: str = "y", cell_m: float = 8.0,
) -> DataFrame:
    """Nearest point on any segment of the floor: snap_x, snap_y, snap_dist, snap_ord, piece."""
    prepared = prepare_pieces(segments, keys, order)
    px, py = F.col(x), F.col(y)
    cost = lambda s: nine_places(piece_distance(px, py, s)["dist"])
    rows = nearest_piece(points, prepared, keys, cost, lambda r: F.lit(r), x, y, cell_m)
    rows = project_on(rows, "piece", x, y)
    return rows.withColumns({
        "snap_x": F.coalesce("_nx", px), "snap_y": F.coalesce("_ny", py), "snap_dist": F.hypot("_over", "_lat"),
        "snap_ord": F.col("piece.ord")}).drop("_along", "_lat", "_t", "_over", "_nx", "_ny")


# ------------------------------------------------------------------ sticky matching per device
def corridor_cost(x: float, y: float, heading: float | None, seg: dict) -> float:
    """Cost of one known corridor for one position (the held one, in the per-device fold)."""
    vx, vy = x - seg["x1"], y - seg["y1"]
    along, lateral = vx * seg["ux"] + vy * seg["uy"], vy * seg["ux"] - vx * seg["uy"]
    over = along - min(max(along, 0.0), seg["len"])
    dist = math.hypot(over, lateral)
    if seg["len"] == 0:
        outside = max(dist - max(seg["left"], seg["right"]), 0.0)
    else:
        outside = math.hypot(over, lateral - min(max(lateral, -seg["right"]), seg["left"]))
    cost = (0.0 if outside <= 1e-9 else outside) + CENTRE_WEIGHT * dist
    if heading is not None and math.isfinite(heading):
        axis = math.degrees(math.atan2(seg["x2"] - seg["x1"], seg["y2"] - seg["y1"]))
        d = abs((heading - axis + 180.0) % 360.0 - 180.0)
        if min(d, 180.0 - d) > HEADING_PENALTY_FROM_DEG:
            cost += HEADING_PENALTY_M
    return cost


SEG_FIELDS = ("ord", "x1", "y1", "x2", "y2", "left", "right", "len", "ux", "uy")


def hold_corridor(state: dict, row: dict) -> dict:
    """One fix: stay in the held corridor unless the best other one is clearly cheaper."""
    best = {f: row[f"s_{f}"] for f in SEG_FIELDS} if row["s_ord"] is not None else None
    held = state.get("seg") if state.get("floor") == row["floor"] else None
    pick = None if row.get("seed") else best  # a seed stands where it says, and ends the memory
    if held is not None and pick is not None and held["ord"] != best["ord"]:
        stay = corridor_cost(row["x"], row["y"], row.get("heading"), held)
        move = row["s_cost"] + SWITCH_PENALTY_M
        if stay < move or (stay == move and held["ord"] < best["ord"]):
            pick = held
    state["seg"], state["floor"] = pick, row["floor"]
    out = {k: row[k] for k in ("device_id", "event_id", "floor", "x", "y")}
    out.update({f"k_{f}": (pick or {}).get(f) for f in SEG_FIELDS})
    return out


STICKY_SCHEMA = ("device_id long, event_id long, floor string, x double, y double, k_ord long, k_x1 double, k_y1 double, "
                 "k_x2 double, k_y2 double, k_left double, k_right double, k_len double, k_ux double, k_uy double")


def sticky_corridor(
    fixes: DataFrame, pieces: DataFrame, keys: Sequence[str] = ("floor",), order: str = "seg_ord",
    time: str = "t", parts: int | None = None, cell_m: float = 8.0,
) -> DataFrame:
    """Corridor matching with memory per device; the memory ends on a floor change and at a seed (a true ``seed`` column).

    The cheapest corridor without memory is found first (a join). The switch penalty can
    only favour the held corridor over it, so the fold compares just those two.
    """
    matched = match_corridor(fixes, pieces, keys, order, cell_m=cell_m)
    flat = matched.select(
        "device_id", "event_id", time, "floor", "x", "y", "heading", *(["seed"] if "seed" in fixes.columns else []), F.col("piece.cost").alias("s_cost"),
        *[F.col(f"piece.seg.{f}").alias(f"s_{f}") for f in SEG_FIELDS])
    kept = fold_ordered(flat, ["device_id"], [time, "event_id"], hold_corridor, STICKY_SCHEMA, parts=parts)
    has = F.col("k_ord").isNotNull()
    place = band_place("x", "y", "k_x1", "k_y1", "k_x2", "k_y2", F.col("k_left"), F.col("k_right"))
    kept = kept.withColumn("_p", F.when(has, place))
    return kept.select(
        "device_id", "event_id", "floor", F.coalesce("_p.bx", "x").alias("placed_x"), F.coalesce("_p.by", "y").alias("placed_y"),
        F.when(has, segment_key("k_x1", "k_y1", "k_x2", "k_y2")).alias("seg_key"))


# Which corridors a straight walk may be compared with.
WALK_SEG_MIN_M, WALK_SEG_NEAR_M, WALK_MAX_ERR_DEG = 2.0, 4.0, 60.0


def walk_axis_error(stretches: DataFrame, pieces: DataFrame, keys: Sequence[str] = ("floor",), order: str = "seg_ord") -> DataFrame:
    """Signed angle between straight walks and the nearest corridor of similar direction.

    ``stretches``: mid_x, mid_y, walk_deg. Rows without such a corridor get NULL.
    """
    def cost(s: Column) -> Column:
        fits = (s["len"] >= WALK_SEG_MIN_M) & (across(F.col("walk_deg"), s["axis"]) <= WALK_MAX_ERR_DEG)
        return bind(piece_distance(F.col("mid_x"), F.col("mid_y"), s)["dist"], lambda d: F.when(
            fits & (d <= WALK_SEG_NEAR_M), nine_places(d)).otherwise(F.lit(float("inf"))))
    # nothing beyond the near limit can fit, so an infinite best is settled there too
    unseen = lambda r: F.lit(float("inf")) if r >= WALK_SEG_NEAR_M else F.lit(r)
    rows = nearest_piece(stretches, prepare_pieces(pieces, keys, order), keys, cost, unseen, "mid_x", "mid_y")
    s = F.col("piece.seg")
    axis = F.degrees(F.atan2(s["x2"] - s["x1"], s["y2"] - s["y1"]))
    err = F.pmod(F.col("walk_deg") - axis + 90.0, F.lit(180.0)) - 90.0
    ok = F.col("piece.cost") < float("inf")
    return rows.withColumns({"axis_error_deg": F.when(ok, err), "corridor": F.when(ok, F.col("piece.ord"))}).drop("piece")

"""Nearest-piece lookup on floor plans through grid cells.

Floor-plan pieces are put into every grid cell their box, grown by one cell, touches;
a point reads only its own cell and sees all pieces within one cell size. When the
best piece there cannot be beaten by an unseen one the point is settled, else a four
times larger grid is asked. The last grid spans the whole floor, so the answer is
exact. Points are not shuffled when pieces are few and Spark finds their cells small enough to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import side_widths
from ..functions.vectors import bind
from ..session import cut, large


def prepare_pieces(pieces: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pieces with direction vectors and band widths; exact copies keep the first."""
    has = lambda c: c if c in pieces.columns else None
    left, right = side_widths(has("width"), has("width_left"), has("width_right"))
    geo = ["x1", "y1", "x2", "y2"]
    p = pieces.withColumns({"left": left, "right": right})
    p = p.groupBy(*keys, *geo, "left", "right").agg(F.min(order).alias("ord"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    p = p.withColumn("len", F.when(length < 1e-9, 0.0).otherwise(length))
    flat = F.col("len") == 0
    return p.withColumns({
        "ux": F.when(flat, 1.0).otherwise((F.col("x2") - F.col("x1")) / F.col("len")),
        "uy": F.when(flat, 0.0).otherwise((F.col("y2") - F.col("y1")) / F.col("len")),
        "axis": F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))),
    })


PIECE_FIELDS = ("ord", "x1", "y1", "x2", "y2", "left", "right", "len", "ux", "uy", "axis")


def _cells(pieces: DataFrame, keys: Sequence[str], size: float, tag: str) -> DataFrame:
    lo = lambda c: F.floor((F.least(f"{c}1", f"{c}2") - size) / size)
    hi = lambda c: F.floor((F.greatest(f"{c}1", f"{c}2") + size) / size)
    spread = pieces.withColumn("gx", F.explode(F.sequence(lo("x"), hi("x"))))
    spread = spread.withColumn("gy", F.explode(F.sequence(lo("y"), hi("y"))))
    return spread.groupBy(*keys, "gx", "gy").agg(
        F.collect_list(F.struct(*PIECE_FIELDS)).alias(tag)
    )


def piece_distance(px: Column, py: Column, s: Column) -> Column:
    """STRUCT(dist, outside): metres to the line and outside the band of a prepared piece.

    Values are bound step by step: inside an array function nothing else would keep them
    from being computed again at every use.
    """
    local = F.struct(
        ((px - s["x1"]) * s["ux"] + (py - s["y1"]) * s["uy"]).alias("along"),
        ((py - s["y1"]) * s["ux"] - (px - s["x1"]) * s["uy"]).alias("lat"))
    beyond = lambda a: F.struct(
        (a["along"] - F.least(F.greatest(a["along"], F.lit(0.0)), s["len"])).alias("over"), a["lat"].alias("lat"),
        (a["lat"] - F.least(F.greatest(a["lat"], -s["right"]), s["left"])).alias("side"))
    measure = lambda d: F.struct(
        F.sqrt(d["over"] * d["over"] + d["lat"] * d["lat"]).alias("dist"), F.sqrt(d["over"] * d["over"] + d["side"] * d["side"]).alias("off"))
    final = lambda m: F.struct(m["dist"].alias("dist"), F.when(
        s["len"] == 0, F.greatest(m["dist"] - F.greatest(s["left"], s["right"]), F.lit(0.0))).when(
        m["off"] <= 1e-9, 0.0).otherwise(m["off"]).alias("outside"))
    return bind(bind(bind(local, beyond), measure), final)


def nine_places(c: Column) -> Column:
    """Rounded so that equal costs tie in the same way everywhere (plain double arithmetic)."""
    return F.rint(c * 1e9) / 1e9


def across(heading: Column, axis: Column) -> Column:
    """Angle between a heading and a piece's axis, 0..90."""
    d = F.abs(F.pmod(heading - axis + 180.0, F.lit(360.0)) - 180.0)
    return F.least(d, 180.0 - d)


def project_on(rows: DataFrame, piece: str, px: str, py: str) -> DataFrame:
    """Foot of the point on its piece: _nx, _ny, _lat (left positive), _over (past the ends).

    Each step is its own projection, so a value used twice is computed once.
    """
    g = lambda f: F.col(f"{piece}.seg.{f}")
    rows = rows.withColumns({
        "_along": (F.col(px) - g("x1")) * g("ux") + (F.col(py) - g("y1")) * g("uy"),
        "_lat": (F.col(py) - g("y1")) * g("ux") - (F.col(px) - g("x1")) * g("uy")})
    rows = rows.withColumn("_t", F.least(F.greatest("_along", F.lit(0.0)), g("len")))
    return rows.withColumns({"_over": F.col("_along") - F.col("_t"), "_nx": g("x1") + F.col("_t") * g("ux"), "_ny": g("y1") + F.col("_t") * g("uy")})


SPREAD_ROWS = 50_000
BROADCAST_PIECES = 20_000  # pieces whose cells Spark may broadcast


def _spread(points: DataFrame, rows: int) -> DataFrame:
    """A few files that cannot be split would leave most cores idle: deal their rows out.

    Tables of many files, the usual case on a cluster, are left where they are.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(points.inputFiles()) < cores
    return points.repartition(cores) if few and rows > SPREAD_ROWS else points


def _reach(points: DataFrame, pieces: DataFrame, px: str, py: str) -> tuple[float, int, int]:
    """(no point is further than this from any piece, numbers of points and pieces); one narrow aggregate per side."""
    ends = pieces.agg(*[f(g("%s1" % c, "%s2" % c)) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))], F.count("*")).first()
    spots = points.agg(F.min(px), F.max(px), F.min(py), F.max(py), F.count("*")).first()
    if ends[0] is None or spots[0] is None:
        return 0.0, spots[4], ends[4]
    span = [max(ends[i + 1], spots[i + 1]) - min(ends[i], spots[i]) for i in (0, 2)]
    return math.hypot(*span), spots[4], ends[4]


def nearest_piece(
    points: DataFrame, pieces: DataFrame, keys: Sequence[str], cost: Callable[[Column], Column],
    unseen_cost: Callable[[float], Column], px: str = "x", py: str = "y", cell_m: float = 8.0, out: str = "piece",
) -> DataFrame:
    """Add struct ``out``(cost, ord, seg): the cheapest piece on the same floor.

    ``cost(seg)`` may use point columns. ``unseen_cost(r)`` is the least cost a piece
    further than ``r`` metres could have. Ties go to the lower ``ord``. Points on a
    floor without pieces get NULL.
    """
    keys = list(keys)
    pieces = cut(pieces)  # floor plans are small next to the points and are read per grid
    reach, n_points, n_pieces = _reach(points, pieces, px, py)
    sizes = [cell_m]
    while sizes[-1] < reach:
        sizes.append(sizes[-1] * 4)
    frame, done = _spread(points, n_points), []
    for i, size in enumerate(sizes):
        tag = f"cell_{i}"
        cells = _cells(pieces, keys, size, tag)
        on = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in keys] + [
            F.floor(F.col(f"p.{px}") / size) == F.col("c.gx"), F.floor(F.col(f"p.{py}") / size) == F.col("c.gy")]
        if i:
            on.append(~F.coalesce(F.col(f"p.{out}")["cost"] <= unseen_cost(sizes[i - 1]), F.lit(False)))
        rows = frame.alias("p").join((large(cells) if n_pieces > BROADCAST_PIECES else cells).alias("c"), on, "left")
        best = F.array_min(F.transform(
            F.col(tag), lambda s, n: F.struct(cost(s).alias("cost"), s["ord"].alias("ord"), n.alias("n"))))
        kept = [F.col(f"p.{c}") for c in points.columns]
        prior = [F.col(f"p.{out}").alias("_prior")] if i else []
        rows = rows.select(*kept, *prior, F.col(tag), best.alias("_best"))
        found = F.when(F.col("_best").isNotNull(), F.struct(
            F.col("_best.cost").alias("cost"), F.col("_best.ord").alias("ord"), F.get(tag, F.col("_best.n")).alias("seg")))
        # least() skips NULLs: a settled point keeps its piece
        frame = rows.select(*points.columns, (F.least(F.col("_prior"), found) if i else found).alias(out))
        if n_pieces > BROADCAST_PIECES and i + 1 < len(sizes):
            # every grid shuffles its points: only those that are open go on
            frame = cut(frame)
            settled = F.coalesce(F.col(out)["cost"] <= unseen_cost(size), F.lit(False))
            done.append(frame.where(settled))
            frame = frame.where(~settled)
            if frame.isEmpty():
                return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, frame])

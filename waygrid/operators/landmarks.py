"""Landmark maps: filtering, pruning, alignment of walking sessions, cloud assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.floors import normalize_floor
from ..functions.geometry import segment_similarity
from ..functions.capture import (
    MARKER_CAM_HEIGHT_M, MARKER_MAX_DIST_M, MARKER_MAX_PITCH_DEG, MARKER_MAX_VIEW_DEG, MARKER_MIN_SIDE_PX, MARKER_MIRROR_DEG,
    marker_confidence, marker_max_reproj, marker_needed_ratio)
from ..session import cut, large, written
from .network import by_graph
from .ordered import fold_arrays, numbered, scan

# Map limits.
MIN_LANDMARKS = 80
COMMITTED_SESSION = -1
ORPHAN_GAP_S = 300.0
ANCHOR_GAP_M = 0.8
SCALE_RANGE = (0.05, 15.0)
KEEP_DIST_M, KEEP_HEIGHT_M = 8.0, 4.0
DEPTH_RANGE_M, MAX_HEIGHT_M, BODY_HEIGHT_M = (0.3, 20.0), 4.5, 4.0
ODOMETRY_MIN_M, FLOW_MIN_PX, FLOW_MIN_S, WALK_MPS, BASELINE_RANGE_M = 0.12, 8.0, 0.25, 1.05, (0.25, 1.40)
NEAR_XY_M, CLOUD_DEPTH_M, MATCH_PX, EYE_HEIGHT_M, VIDEO_FOCAL = 12.0, (0.4, 18.0), 6.0, 1.55, 0.85
LAYER_RANGE = (200, 20000)
PX_PLACES, PX_ROUNDING = 9, 1e-9
# Work of the cloud's search: points of a slice, pixels of a tile, pairs at once, keypoints within the first reach, its growth.
SLICE_POINTS, TILE_PX, MATCH_PAIRS, SPOTS_AROUND, WIDEN = 2048, 64, 1 << 21, 2.0, 4.0

# Pairs of a point and a span that a task looks at in one go, and of one slot of a session.
SPAN_PAIRS, SPAN_WORK = 1 << 20, 500_000_000


def filter_landmarks(landmarks: DataFrame, floor: str | None = None, center: tuple[float, float] | None = None, radius: float | None = None) -> DataFrame:
    """Landmarks of a floor within a planar radius; the box lets file statistics prune."""
    out = landmarks
    if floor is not None:
        out = out.where(normalize_floor("floor") == floor)
    if center is not None and radius is not None:
        cx, cy = center
        out = out.where(F.col("x").between(cx - radius, cx + radius) & F.col("y").between(cy - radius, cy + radius))
        out = out.where(F.hypot(F.col("x") - cx, F.col("y") - cy) <= radius)
    return out


def prune_landmarks(landmarks: DataFrame, floor: str | None = None, ids: DataFrame | None = None, bbox: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(remaining, deleted): rows matching all given filters go. No filter at all is refused."""
    if floor is None and ids is None and bbox is None:
        raise ValueError("prune needs at least one filter")
    hit = F.lit(True)
    if floor is not None:
        hit = hit & (normalize_floor("floor") == floor)
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        hit = hit & F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    hit = F.coalesce(hit, F.lit(False))
    if ids is None:
        return landmarks.where(~hit), landmarks.where(hit)
    doomed = landmarks.where(hit).join(ids.select("landmark_id"), "landmark_id", "left_semi")
    return landmarks.join(doomed.select("landmark_id"), "landmark_id", "left_anti"), doomed


def _finite(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        v = F.col(c)
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok


def exportable_landmarks(landmarks: DataFrame, aligned: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    """Finite landmarks with a descriptor; once any session is aligned, only aligned ones.

    ``aligned``: session_id.
    """
    good = landmarks.where(_finite("x", "y", "z") & F.col(descriptor).isNotNull())
    if aligned.isEmpty():
        return good
    committed = aligned.sparkSession.createDataFrame([(COMMITTED_SESSION,)], "session_id long")
    return good.join(aligned.select(F.col("session_id").cast("long")).union(committed).distinct(), "session_id", "left_semi").select(*landmarks.columns)


def min_size_gate(landmarks: DataFrame, keys=("floor",), n: int = MIN_LANDMARKS) -> DataFrame:
    big = landmarks.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*keys)
    return landmarks.join(big, list(keys), "left_semi")


def merge_landmarks(mem: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows in memory win; unseen ids are added from disk."""
    return mem.unionByName(disk.join(mem.select("landmark_id"), "landmark_id", "left_anti"), allowMissingColumns=True)


def infer_floor(landmarks: DataFrame, tags: DataFrame) -> DataFrame:
    """Default-floor landmarks take the floor of their session's last tag."""
    last = tags.groupBy("session_id").agg(F.max_by(normalize_floor("floor"), F.struct("tag_t", "tag_id")).alias("tag_floor"))
    out = landmarks.join(last, "session_id", "left")
    floor = normalize_floor("floor")
    return out.withColumn("floor", F.when((floor == "1") & F.col("tag_floor").isNotNull(), F.col("tag_floor")).otherwise(floor)).drop("tag_floor")


def cloud_layers(landmarks: DataFrame, max_per_floor: int, **slicing) -> DataFrame:
    """A thinned view of each floor: every n-th landmark, at most the (held) limit."""
    limit = max(LAYER_RANGE[0], min(int(max_per_floor), LAYER_RANGE[1]))
    per = landmarks.groupBy("floor").agg(F.count("*").alias("_n"))
    rows = numbered(landmarks.join(per, "floor"), ["floor"], [F.col("landmark_id")], "_i", **slicing)
    step = F.when(F.col("_n") > limit, F.greatest(F.lit(1), F.floor(F.col("_n") / limit))).otherwise(1)
    place = F.col("_i") - 1
    return rows.where((place % step == 0) & (place / step < limit)).drop("_n", "_i")


# ------------------------------------------------------------------ nearest in time
def nearest_in_time(tags: DataFrame, frames: DataFrame, keys: Sequence[str] = ("session_id",), parts: int | None = None) -> DataFrame:
    """As-of nearest: each tag with the keyframe closest in time; the lower frame id wins ties.

    ``tags``: keys, tag_id, tag_t. ``frames``: keys, frame_id, frame_t and payload columns.
    Tags and frames are put in time order together; each tag sees the frame before and the frame after it, so none meets
    more than two frames.
    """
    keys = list(keys)
    payload = [c for c in frames.columns if c not in keys]
    one = tags.select(*keys, F.struct(*tags.columns).alias("_tag"), F.col("tag_t").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_id"))
    first = frames.groupBy(*keys, "frame_t").agg(F.min_by(F.struct(*payload), "frame_id").alias("_f"))  # of one time the lowest id
    two = first.select(*keys, "_f", F.col("frame_t").alias("_t"), F.lit(0).alias("_kind"), F.col("_f.frame_id").cast("long").alias("_id"))
    frame = F.col("_f"), F.col("_kind") == 0
    both = scan(one.unionByName(two, allowMissingColumns=True), keys, ["_t", "_kind", "_id"], lasts={"_before": frame}, nexts={"_after": frame}, parts=parts)
    gap = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.abs(F.col(f)["frame_t"] - F.col("_t")).alias("dt"), F.col(f)["frame_id"].alias("id"), F.col(f).alias("f")))
    out = both.where("_kind = 1").withColumn("_best", F.least(gap("_before"), gap("_after")))
    return out.select(*[F.col(f"_tag.{c}").alias(c) for c in tags.columns], F.col("_best.dt").alias("dt"), *[F.col(f"_best.f.{c}").alias(c) for c in payload])


def reattach_orphan_tags(tags: DataFrame, frames: DataFrame, aligned: DataFrame, max_gap_s: float = ORPHAN_GAP_S) -> DataFrame:
    """Tags of sessions without keyframes move to the unaligned session of the nearest keyframe in time."""
    with_frames = frames.select("session_id").distinct()
    open_frames = frames.join(aligned.select("session_id"), "session_id", "left_anti").where(F.col("session_id") != COMMITTED_SESSION)
    orphans = tags.join(with_frames, "session_id", "left_anti").join(aligned.select("session_id"), "session_id", "left_anti")
    near = nearest_in_time(orphans.select("tag_id", "tag_t"), open_frames.select("frame_id", "frame_t", F.col("session_id").alias("new_session")), [])
    moves = near.where(F.col("dt") <= max_gap_s).select("tag_id", "new_session")
    return tags.join(moves, "tag_id", "left").withColumn("session_id", F.coalesce("new_session", "session_id")).drop("new_session")


def keep_apart(state: dict, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Anchors but for those within 0.8 m of the last kept one in either frame."""
    last, kept = state["last"], []
    for i, here in enumerate(zip(*[rows[c].tolist() for c in ("map_x", "map_z", "facility_x", "facility_y")])):
        if last is not None and not (math.hypot(here[0] - last[0], here[1] - last[1]) > ANCHOR_GAP_M and math.hypot(here[2] - last[2], here[3] - last[3]) > ANCHOR_GAP_M):
            continue
        last = here
        kept.append(i)
    state["last"] = last and list(last)
    return {k: rows[k][kept] for k in ("tag_id", "tag_t", "map_x", "map_z", "facility_x", "facility_y")}


def tag_anchors(tags: DataFrame, frames: DataFrame) -> DataFrame:
    """Distinct (map position, building position) pairs of each session with two or more tags."""
    enough = tags.groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 2").select("session_id")
    near = nearest_in_time(tags.join(enough, "session_id", "left_semi"), frames.select("session_id", "frame_id", "frame_t", "map_x", "map_z"))
    place = [F.col(c).cast("double") for c in ("tag_t", "map_x", "map_z", "facility_x", "facility_y")]
    near = cut(near.where("frame_id is not null").select(F.col("session_id").cast("long"), F.col("tag_id").cast("long"), *place))
    return fold_arrays(near, ["session_id"], ["tag_id"], keep_apart,
                       "tag_id long, tag_t double, map_x double, map_z double, facility_x double, facility_y double", lambda: {"last": None})


def session_pieces(anchors: DataFrame) -> DataFrame:
    """One transform per consecutive anchor pair; a single anchor gives a shift.

    piece (order), scale, angle, tx, ty and the map-side segment a0, a1.
    """
    w = Window.partitionBy("session_id").orderBy("tag_id")
    nxt = lambda c: F.lead(c).over(w)
    a = anchors.withColumns({"n": F.count("*").over(Window.partitionBy("session_id")), "piece": F.row_number().over(w) - 1,
                             **{f"n_{c}": nxt(c) for c in ("map_x", "map_z", "facility_x", "facility_y")}})
    sim = segment_similarity("map_x", "map_z", "n_map_x", "n_map_z", "facility_x", "facility_y", "n_facility_x", "n_facility_y")
    shift = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("angle"), (F.col("facility_x") - F.col("map_x")).alias("tx"), (F.col("facility_y") - F.col("map_z")).alias("ty"))
    a = a.withColumn("s", F.when(F.col("n") == 1, shift).when(F.col("n_map_x").isNotNull(), sim))
    a = a.where(F.col("s").isNotNull() & (F.col("s.scale") > SCALE_RANGE[0]) & (F.col("s.scale") < SCALE_RANGE[1]))
    return a.select("session_id", "piece", "s.scale", "s.angle", "s.tx", "s.ty", F.col("map_x").alias("a0x"), F.col("map_z").alias("a0y"),
                    F.coalesce("n_map_x", "map_x").alias("a1x"), F.coalesce("n_map_z", "map_z").alias("a1y"))


def _nearest_span(points: DataFrame, spans: DataFrame, px: Column, py: Column, key: str, fields: Sequence[str]) -> DataFrame:
    """Closest span of the point's session, as ``_near`` (d, piece, s). A task holds the spans of a session; its points stream
    past them in blocks of ``SPAN_PAIRS`` pairs, and a session of many pairs is dealt to several tasks."""
    names = ["piece", "a0x", "a0y", "a1x", "a1y", *fields]
    held = spans.where(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"_s_{c}") for c in names])
    asked = points.withColumns({"_px": px.cast("double"), "_py": py.cast("double")})
    count = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    many = cut(count(held, "_h").join(large(count(points, "_p")), key).withColumn("_slots", F.ceil(F.col("_h") * F.col("_p") / SPAN_WORK).cast("int")).where("_slots > 1").select(key, "_slots"))
    if many.isEmpty():
        held, asked = held.withColumn("_slot", F.lit(0)), asked.withColumn("_slot", F.lit(0))
    else:
        n = F.coalesce("_slots", F.lit(1))
        held = held.join(many, key, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slots")
        asked = asked.join(many, key, "left").withColumn("_slot", F.pmod(F.xxhash64(*points.columns), n).cast("int")).drop("_slots")
    kind = {c: spans.schema[c].dataType for c in names}
    near = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("piece", kind["piece"]), T.StructField("s", T.StructType([T.StructField(c, kind[c]) for c in names]))])
    schema, mine = T.StructType([*points.schema.fields, T.StructField("_near", near)]), list(points.columns)
    arrow = to_arrow_schema(schema)

    def load(table: pa.Table | None):
        if table is None:
            return None
        table = table.rename_columns([c.removeprefix("_s_") for c in table.schema.names]).select(names).combine_chunks().sort_by("piece")
        ax, ay, bx, by = (table[c].to_numpy() for c in names[1:5])
        return table, ax, ay, bx - ax, by - ay

    def answer(given, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [rows.column(c) for c in mine]
        if given is None:
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(rows.num_rows, arrow.field("_near").type)], schema=arrow)
            return
        table, ax, ay, dx, dy = given
        x, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_px", "_py"))
        len2 = dx * dx + dy * dy
        best, far, step = np.empty(len(x), np.int64), np.empty(len(x)), max(1, SPAN_PAIRS // len(ax))
        for lo in range(0, len(x), step):
            ux, uy = x[lo:lo + step, None] - ax, y[lo:lo + step, None] - ay
            u = np.where(len2 > 0, np.clip((ux * dx + uy * dy) / np.where(len2 > 0, len2, 1.0), 0.0, 1.0), 0.0)
            d = np.round(np.hypot(ux - u * dx, uy - u * dy), 9)
            best[lo:lo + step] = d.argmin(1)  # of equally near ones the first piece
            far[lo:lo + step] = np.take_along_axis(d, best[lo:lo + step, None], 1)[:, 0]
        s = table.take(pa.array(best)).combine_chunks()
        cols = [s[c].combine_chunks() for c in names]
        inner = pa.StructArray.from_arrays(cols, fields=list(arrow.field("_near").type.field("s").type))
        out = pa.StructArray.from_arrays([pa.array(far, mask=np.isnan(far)), cols[0], inner], fields=list(arrow.field("_near").type))
        yield pa.RecordBatch.from_arrays([*own, out], schema=arrow)

    return by_graph(held, asked, [key, "_slot"], load, answer, schema)


def align_sessions(landmarks: DataFrame, pieces: DataFrame) -> DataFrame:
    """Session landmarks moved into the building by the transform of their nearest path piece.

    Input x, y, z is (map x, height, map z); output is (facility x, facility y, height).
    Sessions without a transform stay as they are, ``aligned`` false.
    """
    rows = _nearest_span(landmarks, pieces, F.col("x"), F.col("z"), "session_id", ["scale", "angle", "tx", "ty"])
    s = F.col("_near.s")
    m, n = s["scale"] * F.cos(s["angle"]), s["scale"] * F.sin(s["angle"])
    ok = F.col("_near").isNotNull()
    moved = {"x": F.when(ok, m * F.col("x") - n * F.col("z") + s["tx"]).otherwise(F.col("x")),
             "y": F.when(ok, n * F.col("x") + m * F.col("z") + s["ty"]).otherwise(F.col("y")),
             "z": F.when(ok, F.col("y")).otherwise(F.col("z")), "aligned": ok}
    return rows.withColumns(moved).drop("_near")


def drop_far_landmarks(aligned: DataFrame, anchors: DataFrame) -> DataFrame:
    """Aligned landmarks within 8 m of the tag polyline and 4 m of the floor height."""
    w = Window.partitionBy("session_id").orderBy("tag_id")
    a = anchors.withColumns({"piece": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("session_id")),
                             "a1x": F.lead("facility_x").over(w), "a1y": F.lead("facility_y").over(w)})
    lines = a.where(F.col("a1x").isNotNull() | (F.col("n") == 1)).select(
        "session_id", "piece", F.col("facility_x").alias("a0x"), F.col("facility_y").alias("a0y"),
        F.coalesce("a1x", "facility_x").alias("a1x"), F.coalesce("a1y", "facility_y").alias("a1y"))
    rows = _nearest_span(aligned, lines, F.col("x"), F.col("y"), "session_id", [])
    near = (F.col("_near.d") <= KEEP_DIST_M) & (F.abs("z") <= KEEP_HEIGHT_M)
    return rows.where(~F.col("aligned") | F.coalesce(near, F.lit(False))).drop("_near")


def finalize_map(mem: DataFrame, disk: DataFrame, tags: DataFrame, frames: DataFrame, aligned: DataFrame) -> DataFrame:
    """Orphan tags, alignment of open sessions, export rule, merge with the stored map, floors."""
    tags = cut(tags)  # read for orphans and for what they move
    tags = cut(reattach_orphan_tags(tags, frames, aligned))
    done = aligned.select("session_id").unionByName(frames.sparkSession.createDataFrame([(COMMITTED_SESSION,)], "session_id long")).distinct()
    open_tags = tags.join(done, "session_id", "left_anti")
    # anchors are a few rows per session and feed three steps
    anchors = cut(tag_anchors(open_tags, frames))
    pieces = cut(session_pieces(anchors))
    moved = drop_far_landmarks(align_sessions(mem.join(done, "session_id", "left_anti"), pieces), anchors)
    now = aligned.select("session_id").unionByName(pieces.select("session_id")).distinct()
    all_mem = moved.drop("aligned").unionByName(mem.join(done, "session_id", "left_semi"))
    return infer_floor(merge_landmarks(cut(exportable_landmarks(all_mem, now)), disk), tags)


def tags_3d(tags: DataFrame, frames: DataFrame, aligned: DataFrame) -> DataFrame:
    """Tag positions in the map frame: building coordinates if aligned, else the nearest keyframe."""
    near = nearest_in_time(tags, frames.select("session_id", "frame_id", "frame_t", "map_x", "map_z"))
    t = near.join(aligned.select("session_id").distinct().withColumn("aligned", F.lit(True)), "session_id", "left")
    ok = F.coalesce("aligned", F.lit(False))
    return t.select("tag_id", "session_id", ok.alias("aligned"),
                    F.bround(F.when(ok, F.col("facility_x")).otherwise(F.coalesce("map_x", "facility_x")), 3).alias("x"),
                    F.bround(F.when(ok, F.col("facility_y")).otherwise(F.lit(0.0)), 3).alias("y"),
                    F.bround(F.when(ok, F.lit(0.0)).otherwise(F.coalesce("map_z", F.lit(0.0))), 3).alias("z"))


def landmark_filter(points: DataFrame, body_frame: bool = False) -> DataFrame:
    """Triangulated points at plausible depth and height: cam_x, cam_y, cam_z (camera), world_y."""
    ok = _finite("cam_x", "cam_y", "cam_z") & F.col("cam_z").between(*DEPTH_RANGE_M) & (F.abs("world_y") <= MAX_HEIGHT_M)
    if body_frame:
        ok = ok & (F.abs("cam_y") <= BODY_HEIGHT_M)
    return points.where(ok)


def keyframe_motion(frames: DataFrame, parts: int | None = None) -> DataFrame:
    """Metric step between consecutive keyframes of a session and where it came from.

    ``frames``: session_id, frame_id, t, x, y, z, median_flow.
    """
    f = scan(frames, ["session_id"], ["t", "frame_id"], prevs=["x", "y", "z", "t"], parts=parts)
    d = lambda c: F.col(c) - F.col(f"prev_{c}")
    f = f.withColumns({"odo": F.sqrt(d("x") ** 2 + d("y") ** 2 + d("z") ** 2), "dt": F.abs(d("t"))}).where("odo is not null")
    visual = (F.col("median_flow") >= FLOW_MIN_PX) & (F.col("dt") >= FLOW_MIN_S)
    lo, hi = BASELINE_RANGE_M
    base = F.when(F.col("odo") >= ODOMETRY_MIN_M, F.col("odo")).when(visual, F.least(F.greatest(WALK_MPS * F.col("dt"), F.lit(lo)), F.lit(hi)))
    source = F.when(F.col("odo") >= ODOMETRY_MIN_M, "odometry").when(visual, "visual").otherwise("skip")
    return f.select("session_id", "frame_id", base.alias("baseline"), source.alias("source"))


# ------------------------------------------------------------------ cloud to photos
def _views(cloud: DataFrame, photos: DataFrame) -> DataFrame:
    """point_id, image_id, pu, pv: every point in the picture of a camera within 12 m.

    Points of a grid cell are dealt by hash of their id to slices of ``SLICE_POINTS``, and a slice meets the cameras around
    its cell, so that a crowded cell is many tasks.
    """
    r = NEAR_XY_M
    cell = lambda c: F.floor(F.col(c) / r)
    around = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)]))
    a = F.radians("orientation")
    cams = photos.select("image_id", F.col("x").alias("cam_x"), F.col("y").alias("cam_y"), "width", "height", F.cos(a).alias("cos"), F.sin(a).alias("sin"),
                         cell("x").alias("hx"), cell("y").alias("hy"))
    cams = cams.withColumn("gx", around("hx")).withColumn("gy", around("hy")).drop("hx", "hy")
    pts = cloud.select("point_id", "x", "y", "z", cell("x").alias("gx"), cell("y").alias("gy"))
    slices = pts.groupBy("gx", "gy").agg(F.ceil(F.count("*") / SLICE_POINTS).cast("int").alias("slices"))
    pts = pts.join(slices, ["gx", "gy"]).withColumn("slice", F.pmod(F.xxhash64("point_id"), "slices").cast("int")).drop("slices")
    cams = cams.join(slices, ["gx", "gy"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    # few bytes and much work: Spark would put the slices together again, were their number not given
    pts = pts.repartition(int(cloud.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gx", "gy", "slice")
    seen = pts.join(large(cams), ["gx", "gy", "slice"])
    ex, ey = F.col("x") - F.col("cam_x"), F.col("y") - F.col("cam_y")
    seen = seen.where(F.hypot(ex, ey) < r)
    right, depth = ex * F.col("cos") - ey * F.col("sin"), ex * F.col("sin") + ey * F.col("cos")
    seen = seen.withColumns({"right": right, "depth": depth, "down": EYE_HEIGHT_M - F.col("z")})
    seen = seen.where((F.col("depth") > CLOUD_DEPTH_M[0]) & (F.col("depth") < CLOUD_DEPTH_M[1]))
    f = F.greatest("width", "height") * VIDEO_FOCAL
    seen = seen.withColumns({"pu": F.try_divide(f * F.col("right"), F.col("depth")) + F.col("width") / 2, "pv": F.try_divide(f * F.col("down"), F.col("depth")) + F.col("height") / 2})
    seen = seen.where((F.col("pu") >= 0) & (F.col("pu") < F.col("width")) & (F.col("pv") >= 0) & (F.col("pv") < F.col("height")))
    return seen.select("point_id", "image_id", "pu", "pv")


class _Pixels:
    """Keypoints of a tile of a photo, ordered by pixel cells as wide as the search reaches."""

    def __init__(self, kps: pa.Table, reach: float):
        u, v = kps["u"].to_numpy(), kps["v"].to_numpy()
        self.reach, self.u0, self.v0 = reach, u.min(), v.min()
        self.wide = int((u.max() - self.u0) // reach) + 4
        code = self._code(u, v)
        order = np.argsort(code, kind="stable")
        self.code, self.u, self.v, self.kps = code[order], u[order], v[order], kps.take(pa.array(order))

    def _code(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        col = np.clip(np.floor((u - self.u0) / self.reach), -2, self.wide - 2).astype(np.int64)
        return np.floor((v - self.v0) / self.reach).astype(np.int64) * self.wide + col + 1

    def nearest(self, pu: np.ndarray, pv: np.ndarray) -> Iterator[tuple]:
        """(view, keypoint) positions: all keypoints within reach that are as near as the nearest, up to rounding."""
        rows = self._code(pu, pv)[:, None] + np.array([-1, 0, 1]) * self.wide
        lo = np.searchsorted(self.code, rows - 1)
        n = np.searchsorted(self.code, rows + 1, side="right") - lo
        upto = np.cumsum(n.sum(1))
        first = 0
        while first < len(pu):
            # a bounded number of pairs at once
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + MATCH_PAIRS, side="right")))
            m, start = n[first:last].ravel(), lo[first:last].ravel()
            view = np.repeat(np.arange(first, last), n[first:last].sum(1))
            if len(view):
                k = np.arange(len(view)) + np.repeat(start - np.cumsum(m) + m, m)
                d = np.hypot(pu[view] - self.u[k], pv[view] - self.v[k])
                heads = np.flatnonzero(np.r_[True, view[1:] != view[:-1]])
                least = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.r_[heads, len(view)]))
                keep = (d <= least + 2 * PX_ROUNDING) & (d <= self.reach)
                yield view[keep], k[keep]
            first = last


def _pixel_hits(views: DataFrame, kps: DataFrame, radius: float) -> DataFrame:
    """Views with their nearest keypoints within ``radius`` pixels: point_id, image_id, kp_idx, px_err.

    Views and keypoints meet by tile of a photo; keypoints also go to the tiles that the radius reaches. In a task a
    tile's keypoints come first, then its views stream past them.
    """
    reach = radius + 2 * PX_ROUNDING
    tile = lambda c, by=0.0: F.floor((F.col(c) + by) / TILE_PX)
    tiles = lambda c: F.explode(F.sequence(tile(c, -reach), tile(c, reach)))
    kind = {f.name: f.dataType for f in (*views.schema.fields, *kps.schema.fields)}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    at = "image_id", "tu", "tv"
    one = kps.withColumn("tu", tiles("u")).withColumn("tv", tiles("v")).select(*at, F.lit(0).alias("kind"), "u", "v", "kp_idx", none("point_id"))
    two = views.select("image_id", tile("pu").alias("tu"), tile("pv").alias("tv"), F.lit(1).alias("kind"), F.col("pu").alias("u"), F.col("pv").alias("v"), none("kp_idx"), "point_id")
    schema = T.StructType([T.StructField(c, kind[c]) for c in ("point_id", "image_id", "kp_idx")] + [T.StructField(c, T.DoubleType()) for c in ("pu", "pv", "u", "v")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, pixels = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = pa.Table.from_batches([batch])
            image = b["image_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            marks = [image, *[b[c].to_numpy() for c in ("tu", "tv", "kind")]]
            cuts = np.flatnonzero(np.r_[True, np.any([m[1:] != m[:-1] for m in marks], axis=0)]).tolist() + [b.num_rows]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                here, rows = (b["image_id"][lo].as_py(), marks[1][lo], marks[2][lo]), b.slice(lo, hi - lo)
                if here != key:
                    key, parts, pixels = here, [], None
                if marks[3][lo] == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if pixels is None:
                    pixels = _Pixels(pa.concat_tables(parts).combine_chunks(), reach)
                for view, kp in pixels.nearest(rows["u"].to_numpy(), rows["v"].to_numpy()):
                    if len(view):
                        r, k = rows.select(["point_id", "image_id", "u", "v"]).take(pa.array(view)), pixels.kps.select(["kp_idx", "u", "v"]).take(pa.array(kp))
                        out.append(pa.table([r["point_id"], r["image_id"], k["kp_idx"], r["u"], r["v"], k["u"], k["v"]], names=schema.names))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    hits = one.unionByName(two).repartition(*at).sortWithinPartitions(*at, "kind").mapInArrow(meet, schema)
    err = F.round(F.hypot(F.col("pu") - F.col("u"), F.col("pv") - F.col("v")), PX_PLACES)
    return hits.select("point_id", "image_id", "kp_idx", err.alias("px_err")).where(F.col("px_err") <= radius)


def nearest_landmark_keypoint(cloud: DataFrame, photos: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Best keypoint of any photo for each cloud point.

    ``cloud``: point_id, x, y, z. ``photos``: image_id, x, y, orientation, width, height.
    ``keypoints``: image_id, kp_idx, u, v, desc. Points within 12 m of a camera are found by grid cell, projected, and matched
    to keypoints in tiles of the picture. The first search reaches only as far as the keypoints are dense; a point with a
    match is settled, as nothing nearer can lie outside, and the rest ask again with ``WIDEN`` times the reach, up to 6 pixels.
    """
    # of keypoints on one spot the lowest counts
    spots = keypoints.where(_finite("u", "v")).groupBy("image_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    kps = written(spots.agg(F.min(F.struct("kp_idx")).alias("_k")).select("image_id", "u", "v", "_k.kp_idx"), "spots")
    counts = cut(photos.join(kps.groupBy("image_id").agg(F.count("*").alias("_n")), "image_id"))  # other photos match nothing
    area = F.greatest(F.col("width") * F.col("height"), F.lit(1)).cast("double")
    dense = counts.agg((F.sum(F.col("_n") * F.col("_n") / area) / F.sum("_n")).alias("d")).first()["d"]
    radius = min(MATCH_PX, math.sqrt(SPOTS_AROUND / dense) / 3) if dense else MATCH_PX
    found, left = [], cloud
    while True:
        hits = _pixel_hits(_views(left, counts.drop("_n")), kps, radius)
        best = hits.groupBy("point_id").agg(F.min(F.struct("px_err", "image_id", "kp_idx")).alias("b")).select("point_id", "b.*")
        if radius >= MATCH_PX:
            return reduce(DataFrame.unionByName, [*found, best])
        found.append(cut(best))
        done = found[-1].select(F.col("point_id").alias("_done"))
        left = left.join(large(done), F.col("point_id").eqNullSafe(F.col("_done")), "left_anti")
        radius = min(MATCH_PX, radius * WIDEN)


def build_map_from_cloud(cloud: DataFrame, photos: DataFrame, keypoints: DataFrame, least: int = MIN_LANDMARKS) -> DataFrame:
    """Cloud points with the descriptor of their keypoint; too few points is an error."""
    best = cut(nearest_landmark_keypoint(cloud, photos, keypoints))
    out = cloud.join(large(best), "point_id").join(keypoints.select("image_id", "kp_idx", "desc"), ["image_id", "kp_idx"])
    out = cut(out)  # counted and read: made once
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} cloud points got a descriptor")
    return out


# ------------------------------------------------------------------ markers
def marker_pose_accept(cands: DataFrame) -> DataFrame:
    """Accept or reject each marker sighting from its candidate poses.

    ``cands``: sighting_id, pose_no, side_px, err, in_front, cam_z, pitch, roll, heading,
    view_deg, dist. Output: sighting_id, reason ('ok' when accepted), pose_no, confidence.
    """
    plausible = F.col("in_front") & F.col("cam_z").between(*MARKER_CAM_HEIGHT_M) & (F.abs("pitch") <= MARKER_MAX_PITCH_DEG)
    pose = F.struct("err", "pose_no", "pitch", "roll", "heading", "view_deg", "dist")
    g = cands.groupBy("sighting_id").agg(F.max("side_px").alias("side"), F.sort_array(F.collect_list(F.when(plausible, pose))).alias("ps"))
    a, b = F.get("ps", F.lit(0)), F.get("ps", F.lit(1))
    close = F.coalesce(b["err"] < marker_needed_ratio("side") * F.greatest(a["err"], F.lit(1e-6)), F.lit(False))
    turn = F.abs(F.pmod(b["heading"] - a["heading"] + 180.0, F.lit(360.0)) - 180.0)
    level = lambda p: F.abs(p["roll"]) + 0.5 * F.abs(p["pitch"])
    best = F.when(close & (level(b) < level(a)), b).otherwise(a)
    g = g.withColumns({"best": best, "amb": close})
    p = F.col("best")
    reason = (F.when(F.col("side") < MARKER_MIN_SIDE_PX, "small").when(F.size("ps") == 0, "implausible").when(close & (turn > MARKER_MIRROR_DEG), "ambiguous")
              .when(p["err"] > marker_max_reproj("side"), "reproj").when(p["view_deg"] > MARKER_MAX_VIEW_DEG, "angle")
              .when(p["dist"] > MARKER_MAX_DIST_M, "far").otherwise("ok"))
    g = g.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return g.select("sighting_id", "reason", F.when(ok, p["pose_no"]).alias("pose_no"), F.when(ok, marker_confidence(p["dist"], F.col("amb"))).alias("confidence"))

"""Survey photos, floor-plan georeferencing and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.capture import image_id, parse_image_id
from ..functions.floors import normalize_floor
from ..functions.geometry import implied_scale, pixel_to_world, world_to_pixel
from .ordered import numbered

# Fit-quality limits.
MAX_RESIDUAL_M = 0.5
SCALE_RANGE = (0.001, 2.0)


# ------------------------------------------------------------------ photos
def ordered_photos(photos: DataFrame, keys=("location_id",), **slicing) -> DataFrame:
    """Capture order in a folder: EXIF time if every photo has one, else file name."""
    keys = list(keys)
    folder = photos.groupBy(*keys).agg(
        F.count("*").alias("n_photos"), (F.count("exif_time") == F.count("*")).alias("_dated"))
    rows = photos.join(folder, keys).withColumn("_time", F.when(F.col("_dated"), F.col("exif_time")))
    rows = numbered(rows, keys, [F.col("_time").asc_nulls_last(), F.col("filename")], "photo_no", **slicing)
    return rows.withColumn("photo_no", F.col("photo_no") - 1).drop("_dated", "_time")


def ingest_survey(photos: DataFrame, locations: DataFrame, headings: DataFrame, **slicing) -> DataFrame:
    """Photos with place, heading, running sequence and image id.

    Heading: manifest row, else EXIF, else evenly spaced round the circle.
    """
    known = photos.join(locations, "location_id").withColumn("floor", normalize_floor("floor"))
    rows = ordered_photos(known, **slicing).join(headings, ["location_id", "filename"], "left")
    rows = numbered(rows, [], [F.col("location_id"), F.col("photo_no")], "sequence", **slicing)
    spaced = F.col("photo_no") * 360.0 / F.col("n_photos")
    deg = F.coalesce(F.col("heading_degrees"), F.col("exif_heading"), spaced)
    source = F.when(F.col("heading_degrees").isNotNull(), "manifest").when(
        F.col("exif_heading").isNotNull(), "exif").otherwise("approximated")
    rows = rows.withColumns({
        "orientation": F.pmod(F.bround(deg, 0).cast("int"), F.lit(360)), "heading_source": source})
    return rows.select(
        "location_id", "filename", "floor", "zone", "x", "y", "orientation", "heading_source", "sequence",
        image_id("floor", "zone", "sequence", "orientation").alias("image_id"))


def unplaced_photos(photos: DataFrame, locations: DataFrame) -> DataFrame:
    """Folders without a manifest row, and manifest rows without photos."""
    folders = photos.select("location_id").distinct()
    no_row = folders.join(locations, "location_id", "left_anti").select("location_id", F.lit("no_manifest").alias("problem"))
    no_photo = locations.join(folders, "location_id", "left_anti").select("location_id", F.lit("no_photos").alias("problem"))
    return no_row.unionByName(no_photo)


def heading_source_counts(ingested: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("heading_source") == s).alias(s)
    return ingested.agg(n("manifest"), n("exif"), n("approximated"))


def exif_coverage(photos: DataFrame, keys=("location_id",)) -> DataFrame:
    return photos.groupBy(*keys).agg(
        F.count("*").alias("photos"), F.count("exif_heading").alias("with_heading"), F.count("exif_time").alias("with_time"))


def pair_ordered_headings(photos: DataFrame, ordered: DataFrame) -> DataFrame:
    """``;``-lists of headings paired with photos in capture order.

    A location whose counts differ is left out whole.
    """
    items = F.filter(F.transform(F.split("headings", ";"), lambda h: F.trim(h)), lambda h: h != "")
    lists = ordered.select("location_id", items.alias("hs"))
    listed = lists.select("location_id", F.size("hs").alias("n_photos"), F.posexplode("hs").alias("photo_no", "heading"))
    rows = ordered_photos(photos).join(listed, ["location_id", "photo_no", "n_photos"])
    return rows.select("location_id", "filename", F.col("heading").cast("double").alias("heading_degrees"))


def next_sequence(records: DataFrame) -> DataFrame:
    return records.agg((F.coalesce(F.max(parse_image_id("image_id")["sequence"]), F.lit(0)) + 1).alias("next_sequence"))


def photo_counts(locations: DataFrame, records: DataFrame) -> DataFrame:
    per = records.groupBy("location_id").agg(F.count("*").alias("photos"))
    return locations.join(per, "location_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))


def survey_locations(records: DataFrame, order: str = "image_id") -> DataFrame:
    """One row per location: its first record."""
    first = F.min_by(F.struct("floor", "zone", "x", "y"), order).alias("r")
    return records.where("location_id is not null").groupBy("location_id").agg(first).select("location_id", "r.*")


# ------------------------------------------------------------------ record edits
def records_for(records: DataFrame, column: str, value) -> DataFrame:
    return records.where(F.col(column) == value)


def update_heading(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Set orientation and rename id and path; ``applied`` is false where the new id is taken.

    ``edits``: image_id, heading_degrees.
    """
    deg = F.pmod(F.bround("heading_degrees", 0).cast("int"), F.lit(360))
    stem = parse_image_id("image_id")["stem"]
    plan = edits.select("image_id", deg.alias("new_deg"), F.coalesce(
        F.concat(stem, F.format_string("_%03d", deg)), F.col("image_id")).alias("new_id"))
    taken = plan.where("new_id <> image_id").join(
        records.select(F.col("image_id").alias("new_id")), "new_id", "left_semi").select("image_id", F.lit(True).alias("taken"))
    plan = plan.join(taken, "image_id", "left")
    rows = records.join(plan, "image_id", "left")
    edited, ok = F.col("new_id").isNotNull(), F.col("taken").isNull() & F.col("new_id").isNotNull()
    path = F.replace("processed_path", F.col("image_id"), F.col("new_id"))
    return rows.withColumns({
        "applied": F.when(edited, ok), "orientation": F.when(ok, F.col("new_deg")).otherwise(F.col("orientation")),
        "processed_path": F.when(ok, path).otherwise(F.col("processed_path")),
        "image_id": F.when(ok, F.col("new_id")).otherwise(F.col("image_id")),
    }).drop("new_id", "new_deg", "taken")


def delete_records(records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records kept, ids that do not exist)."""
    return records.join(ids, "image_id", "left_anti"), ids.join(records, "image_id", "left_anti").select("image_id")


def upsert_locations(locations: DataFrame, updates: DataFrame) -> DataFrame:
    """Update in place or add; new coordinates at 3 dp."""
    new = updates.select("location_id", normalize_floor("floor").alias("n_floor"), F.col("zone").alias("n_zone"),
                         F.bround("x", 3).alias("n_x"), F.bround("y", 3).alias("n_y"), F.lit(True).alias("n"))
    pick = lambda c: F.when(F.col("n"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return locations.join(new, "location_id", "full_outer").select("location_id", *[pick(c) for c in ("floor", "zone", "x", "y")])


def delete_locations(locations: DataFrame, ids: DataFrame) -> DataFrame:
    return locations.join(ids, "location_id", "left_anti")


def retag_floor(tables: dict[str, DataFrame], old: str, new: str, connectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables with floor ``old`` renamed; raises if ``new`` is in use in any of them.

    ``connectors`` holds ``nodes``, a map from floor to landing.
    """
    for df in tables.values():
        if not df.where(normalize_floor("floor") == new).isEmpty():
            raise ValueError(f"floor {new!r} already exists")
    label = F.when(normalize_floor("floor") == old, F.lit(new)).otherwise(normalize_floor("floor"))
    out = {name: df.withColumn("floor", label) for name, df in tables.items()}
    if connectors is not None:
        out["connectors"] = connectors.withColumn("nodes", F.transform_keys(
            "nodes", lambda k, v: F.when(normalize_floor(k) == old, F.lit(new)).otherwise(normalize_floor(k))))
    return out


def retag_counts(tables: dict[str, DataFrame], old: str) -> DataFrame:
    parts = [df.agg(F.count_if(normalize_floor("floor") == old).alias("changed")).select(F.lit(n).alias("table"), "changed")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replace_floor_geometry(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Floors named in ``incoming`` are replaced whole."""
    floors = incoming.select("site_id", "floor").distinct()
    return current.join(floors, ["site_id", "floor"], "left_anti").unionByName(incoming)


# ------------------------------------------------------------------ registries
def registry_lookup(asked: DataFrame, registry: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    norm = (lambda c: F.upper(F.trim(c))) if ignore_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    left = asked.withColumn("_k", norm(F.col(key)))
    right = registry.withColumn("_k", norm(F.col(key))).drop(key)
    return left.join(right, "_k").drop("_k")


def cross_floor_clashes(registry: DataFrame, key: str) -> DataFrame:
    """Ids used on more than one floor of a site."""
    return registry.groupBy("site_id", key).agg(F.count_distinct("floor").alias("floors")).where("floors > 1")


def validate_registry(markers: DataFrame, kiosks: DataFrame) -> DataFrame:
    """Violations (site_id, floor, item, rule) of marker and kiosk rules."""
    m = markers.withColumn("item", F.concat(F.lit("marker "), F.col("marker_id").cast("string")))
    k = kiosks.withColumn("kiosk_id", F.upper(F.trim("kiosk_id"))).withColumn("item", F.concat(F.lit("kiosk "), "kiosk_id"))
    show = lambda df, rule: df.select("site_id", "floor", "item", F.lit(rule).alias("rule"))
    twice = lambda df: df.groupBy("site_id", "floor", "item").agg(F.count("*").alias("n")).where("n > 1")
    floors_of = lambda df: df.groupBy("site_id", "item").agg(F.collect_set("floor").alias("fs"), F.count_distinct("floor").alias("n")).where("n > 1")
    clash = lambda df: floors_of(df).select("site_id", F.explode("fs").alias("floor"), "item")
    own = markers.select("site_id", "floor", "marker_id").distinct()
    checks = [
        show(twice(m), "duplicate"), show(twice(k), "duplicate"),
        show(clash(m), "other_floor"), show(clash(k), "other_floor"),
        show(m.where(~F.col("marker_id").between(0, 49)), "id_range"),
        show(m.where(~F.col("size_m").between(0.05, 1.0) | ~F.col("height_m").between(0.3, 3.0)), "size_or_height"),
        show(k.where(~F.col("kiosk_id").rlike("^[A-Za-z0-9_-]{1,32}$")), "id_pattern"),
        show(k.where(~F.col("stand_m").between(0.2, 3.0)), "stand_distance"),
        show(k.where("marker_id is not null").join(own, ["site_id", "floor", "marker_id"], "left_anti"), "marker_not_here"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


# ------------------------------------------------------------------ floors
def floors_bottom_up(floors: DataFrame) -> DataFrame:
    """``rank`` by level; labels without one keep their order above the rest."""
    from ..functions.floors import floor_level
    first = floors.groupBy("site_id", normalize_floor("floor").alias("floor")).agg(F.min("pos").alias("pos"))
    lvl = floor_level("floor")
    w = Window.partitionBy("site_id").orderBy(lvl.isNull(), lvl, "pos")
    return first.withColumn("rank", F.row_number().over(w) - 1)


def adjacent_floors(floors: DataFrame) -> DataFrame:
    w = Window.partitionBy("site_id").orderBy("pos")
    return floors.select("site_id", "floor", F.lag("floor").over(w).alias("below"), F.lead("floor").over(w).alias("above"))


def floors_present(landmarks: DataFrame, keys=()) -> DataFrame:
    return landmarks.select(*keys, normalize_floor("floor").alias("floor")).distinct()


def map_only_floors(mapped: DataFrame, declared: DataFrame) -> DataFrame:
    return floors_present(mapped, ["site_id"]).join(
        declared.select("site_id", normalize_floor("floor").alias("floor")), ["site_id", "floor"], "left_anti")


# ------------------------------------------------------------------ georeferencing
def fit_affine(points: DataFrame, keys) -> DataFrame:
    """Least-squares pixel-to-world transform per floor plan, from at least three points.

    Two passes of sums: means first, then centred second moments, so the normal
    equations are 2 x 2 and well conditioned. Collinear points give no row.
    """
    keys = list(keys)
    mean = points.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("px", "py", "x", "y")]).where("n >= 3")
    c = points.join(mean, keys)
    u, v = F.col("px") - F.col("m_px"), F.col("py") - F.col("m_py")
    x, y = F.col("x") - F.col("m_x"), F.col("y") - F.col("m_y")
    s = c.groupBy(*keys, "n", "m_px", "m_py", "m_x", "m_y").agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"),
        F.sum(u * x).alias("ux"), F.sum(v * x).alias("vx"), F.sum(u * y).alias("uy"), F.sum(v * y).alias("vy"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    s = s.withColumn("det", det).where(F.col("det") > 1e-9 * F.col("uu") * F.col("vv"))
    s = s.withColumns({
        "a": (F.col("ux") * F.col("vv") - F.col("vx") * F.col("uv")) / F.col("det"),
        "b": (F.col("vx") * F.col("uu") - F.col("ux") * F.col("uv")) / F.col("det"),
        "c": (F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv")) / F.col("det"),
        "d": (F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv")) / F.col("det")})
    return s.select(*keys, F.col("n").alias("n_points"), "a", "b", "c", "d",
                    (F.col("m_x") - F.col("a") * F.col("m_px") - F.col("b") * F.col("m_py")).alias("tx"),
                    (F.col("m_y") - F.col("c") * F.col("m_px") - F.col("d") * F.col("m_py")).alias("ty"))


def transform_struct() -> Column:
    return F.struct("a", "b", "c", "d", "tx", "ty")


def fit_quality(points: DataFrame, fits: DataFrame, keys) -> DataFrame:
    """Largest residual, implied scale and warnings per fitted floor plan."""
    keys = list(keys)
    t = fits.select(*keys, "n_points", transform_struct().alias("t"))
    w = pixel_to_world("px", "py", "t")
    r = points.join(t, keys).groupBy(*keys).agg(
        F.max(F.hypot(w["x"] - F.col("x"), w["y"] - F.col("y"))).alias("max_residual"),
        F.avg(F.hypot(w["x"] - F.col("x"), w["y"] - F.col("y"))).alias("mean_residual"))
    s = implied_scale("t")
    out = r.join(t, keys).withColumns({"scale_x": s["scale_x"], "scale_y": s["scale_y"]})
    lo, hi = SCALE_RANGE
    odd = lambda c: (F.col(c) > hi) | (F.col(c) < lo)
    return out.withColumns({
        "warn_three_points": F.col("n_points") == 3, "warn_residual": F.col("max_residual") > MAX_RESIDUAL_M,
        "warn_scale": odd("scale_x") | odd("scale_y")}).drop("t")


def build_geometry(pixels: DataFrame, fits: DataFrame, keys, pairs=(("px", "py", "x", "y"),), places: int = 3) -> DataFrame:
    """Pixel columns to world columns at 3 dp. ``pairs``: (px, py, x, y) column names."""
    keys = list(keys)
    rows = pixels.join(fits.select(*keys, transform_struct().alias("t")), keys)
    for px, py, x, y in pairs:
        w = pixel_to_world(px, py, "t")
        rows = rows.withColumns({x: F.bround(w["x"], places), y: F.bround(w["y"], places)})
    return rows.drop("t", *[c for p in pairs for c in p[:2]])


def overlay_pixels(world: DataFrame, fits: DataFrame, keys, x: str = "x", y: str = "y") -> DataFrame:
    """World rows at their floor-plan pixels."""
    keys = list(keys)
    rows = world.join(fits.select(*keys, transform_struct().alias("t")), keys)
    p = world_to_pixel(x, y, "t")
    return rows.withColumns({"px": p["px"], "py": p["py"]}).drop("t")


def union_tags_landmarks(tags: DataFrame, locations: DataFrame) -> DataFrame:
    """User tags and surveyed spots in one table."""
    a = tags.select(F.col("id").cast("string"), "label", F.lit("user_tag").alias("type"), "facility_x", "facility_y",
                    normalize_floor("floor").alias("floor"), "x", "y", "z", "session_id")
    b = locations.select(
        F.col("location_id").cast("string").alias("id"), F.concat(F.lit("Spot "), F.col("location_id").cast("string")).alias("label"),
        F.lit("facility_landmark").alias("type"), F.col("x").alias("facility_x"), F.col("y").alias("facility_y"),
        normalize_floor("floor").alias("floor"), "zone", "x", "y", F.lit(0.0).alias("z"))
    return a.unionByName(b, allowMissingColumns=True)


def dedupe_tags(tags: DataFrame, order: str) -> DataFrame:
    """Tags unique on (timestamp, facility_x, facility_y); the first one stays."""
    others = [c for c in tags.columns if c not in ("timestamp", "facility_x", "facility_y")]
    keep = tags.groupBy("timestamp", "facility_x", "facility_y").agg(F.min_by(F.struct(*others), order).alias("r"))
    return keep.select("timestamp", "facility_x", "facility_y", "r.*")

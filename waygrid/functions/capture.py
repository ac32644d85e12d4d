"""Image ids, camera models, device headings, fix confidence and link parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .floors import normalize_floor
from .geometry import clamp, col, num

# Id layout, focal guesses and film diagonal.
IMAGE_ID_FORMAT = "F%s_Z%s_%05d_%03d"
SEQUENCE_PATTERN = r"^F[^_]+_Z.+_(\d{5})_\d{3}$"
HEADING_SUFFIX_PATTERN = r"^(.+)_(\d{3})$"
VIDEO_FOCAL_RATIO = 0.85
PHOTO_FOCAL_RATIO = 0.72
FULL_FRAME_DIAG_MM = 43.27

# Query keys of a parking link, by priority.
SLOT_KEYS = ("slot", "bay", "parking", "p", "spot", "plate")
KIOSK_KEYS = ("kiosk", "k", "kiosk_id")

# Marker acceptance limits.
MARKER_MIN_SIDE_PX = 36.0
MARKER_MAX_REPROJ_PX = 3.0
MARKER_REPROJ_PER_SIDE = 0.025
MARKER_MAX_VIEW_DEG = 70.0
MARKER_MAX_DIST_M = 8.0
MARKER_CAM_HEIGHT_M = (0.3, 2.5)
MARKER_MAX_PITCH_DEG = 65.0
MARKER_RATIO_FAR = 3.0
MARKER_RATIO_NEAR = 1.3
MARKER_RATIO_FAR_PX = 80.0
MARKER_RATIO_NEAR_PX = 150.0
MARKER_MIRROR_DEG = 10.0


def image_id(floor, zone, seq, deg) -> Column:
    token = F.regexp_replace(normalize_floor(floor), "[^A-Za-z0-9_-]+", "")
    token = F.when(token == "", F.lit("1")).otherwise(token)
    return F.format_string(IMAGE_ID_FORMAT, token, col(zone), col(seq).cast("int"), col(deg).cast("int"))


def parse_image_id(c) -> Column:
    """STRUCT(stem, sequence, heading); NULL fields where the id has no such part."""
    c = col(c)
    part = lambda pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))
    return F.struct(
        part(HEADING_SUFFIX_PATTERN, 1).alias("stem"),
        part(SEQUENCE_PATTERN, 1).cast("int").alias("sequence"),
        part(HEADING_SUFFIX_PATTERN, 2).cast("int").alias("heading"),
    )


def texture_bucket(n) -> Column:
    return F.when(num(n) < 50, "low_texture").when(num(n) < 200, "medium_texture").otherwise("high_texture")


def fix_confidence(inliers, matches) -> Column:
    return F.least(F.lit(1.0), 0.35 + 0.65 * (num(inliers) / F.greatest(num(matches), F.lit(1))))


def marker_confidence(dist, ambiguous) -> Column:
    c = 0.95 - 0.04 * F.greatest(F.lit(0.0), num(dist) - 1.5) - F.when(col(ambiguous), 0.1).otherwise(0.0)
    return clamp(c, 0.55, 0.95)


def marker_needed_ratio(side_px) -> Column:
    """Error margin the better of two mirrored poses needs, falling with size in the image."""
    t = clamp((num(side_px) - MARKER_RATIO_FAR_PX) / (MARKER_RATIO_NEAR_PX - MARKER_RATIO_FAR_PX), 0.0, 1.0)
    return MARKER_RATIO_FAR + t * (MARKER_RATIO_NEAR - MARKER_RATIO_FAR)


def marker_max_reproj(side_px) -> Column:
    return F.greatest(F.lit(MARKER_MAX_REPROJ_PX), MARKER_REPROJ_PER_SIDE * num(side_px))


def validate_intrinsics(fx, fy, cx, cy, width, height) -> Column:
    """STRUCT(fx, fy, cx, cy, width, height) or NULL when missing or implausible."""
    fx, fy, cx, cy = (num(c).cast("double") for c in (fx, fy, cx, cy))
    w, h = (F.bround(num(c).cast("double"), 0).cast("int") for c in (width, height))
    side = F.greatest(w, h).cast("double")
    plausible = lambda f: (f > 0.25 * side) & (f < 3.0 * side)
    ok = (
        (w >= 16) & (h >= 16) & (fx > 0) & (fy > 0) & plausible(fx) & plausible(fy)
        & (cx > 0) & (cx < w) & (cy > 0) & (cy < h)
    )
    return F.when(ok, F.struct(fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy"),
                               w.alias("width"), h.alias("height")))


def camera_matrix(width, height, intr) -> Column:
    """STRUCT(fx, fy, cx, cy, known): rescaled intrinsics, else a guess from the size."""
    w, h, k = num(width).cast("double"), num(height).cast("double"), col(intr)
    sx, sy = w / k["width"], h / k["height"]
    use = F.coalesce(F.abs(sx - sy) < 0.02, F.lit(False))
    guess = F.greatest(w, h) * VIDEO_FOCAL_RATIO
    pick = lambda known, other: F.when(use, known).otherwise(other)
    return F.struct(
        pick(k["fx"] * sx, guess).alias("fx"), pick(k["fy"] * sy, guess).alias("fy"),
        pick(k["cx"] * sx, w / 2.0).alias("cx"), pick(k["cy"] * sy, h / 2.0).alias("cy"),
        use.alias("known"),
    )


def focal_px(f35, width, height) -> Column:
    """Focal candidates in pixels, best first: film equivalent, or the two guesses."""
    w, h, f = num(width).cast("double"), num(height).cast("double"), num(f35)
    side = F.greatest(w, h)
    return F.when(F.coalesce(f, F.lit(0.0)) != 0, F.array(f * F.hypot(w, h) / FULL_FRAME_DIAG_MM)).otherwise(
        F.array(VIDEO_FOCAL_RATIO * side, PHOTO_FOCAL_RATIO * side)
    )


def kiosk_start_pose(x, y, facing_deg, stand_m) -> Column:
    r = F.radians(num(facing_deg))
    return F.struct(
        (num(x) + num(stand_m) * F.sin(r)).alias("x"),
        (num(y) + num(stand_m) * F.cos(r)).alias("y"),
        F.pmod(num(facing_deg) + 180.0, F.lit(360.0)).alias("heading"),
    )


def normalize_bay(text) -> Column:
    t = F.regexp_replace(F.trim(F.upper(F.coalesce(col(text), F.lit("")))), r"\s+", "-")
    return F.regexp_replace(t, "[^A-Z0-9-]", "")


def valid_bay(bay) -> Column:
    return (F.length(col(bay)) >= 2) & col(bay).rlike("^[A-Z0-9]+(?:-[A-Z0-9]+)*$")


def parse_parking_link(text) -> Column:
    """STRUCT(slot, kiosk) from a link with query keys or a bare bay number, else NULL."""
    raw = F.trim(F.coalesce(col(text), F.lit("")))
    # a relative link has no scheme, which parse_url needs
    url = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).otherwise(
        F.concat(F.lit("http://host/"), F.regexp_replace(raw, "^/+", "")))
    value = lambda key: F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)), F.lit(""))
    decoded = lambda keys: F.try_url_decode(F.coalesce(*[value(k) for k in keys]))
    link_slot = normalize_bay(decoded(SLOT_KEYS))
    kiosk = F.nullif(F.upper(F.trim(F.coalesce(decoded(KIOSK_KEYS), F.lit("")))), F.lit(""))
    bare = normalize_bay(raw)
    pair = lambda s, k: F.struct(s.alias("slot"), k.alias("kiosk"))
    null_kiosk = F.lit(None).cast("string")
    return F.when(raw.rlike("[?&]"), F.when(F.length(link_slot) >= 2, pair(link_slot, kiosk))).otherwise(
        F.when((F.length(bare) >= 2) & (F.length(bare) <= 16) & bare.rlike(r"\d"), pair(bare, null_kiosk))
    )


def age_days(epoch, iso) -> Column:
    return F.abs(num(epoch).cast("double") - F.unix_micros(F.try_to_timestamp(col(iso))) / 1e6) / 86400.0


def choose_anchor(sx, sy, rx, ry, limit_m: float = 2.5) -> Column:
    """Raw position, unless it is missing or too far from the corridor position."""
    keep = F.coalesce(F.hypot(num(rx) - num(sx), num(ry) - num(sy)) <= limit_m, F.lit(False))
    return F.struct(F.when(keep, num(rx)).otherwise(num(sx)).alias("x"),
                    F.when(keep, num(ry)).otherwise(num(sy)).alias("y"))


# ------------------------------------------------------------------ device headings
def euler_heading(alpha, beta, gamma, absolute) -> Column:
    """Compass heading of an orientation event; relative readings give NULL."""
    a, b, g = (F.radians(num(c)) for c in (alpha, beta, gamma))
    vx = -F.cos(a) * F.sin(g) - F.sin(a) * F.sin(b) * F.cos(g)
    vy = -F.sin(a) * F.sin(g) + F.cos(a) * F.sin(b) * F.cos(g)
    full = F.when(F.hypot(vx, vy) > 1e-9, F.pmod(F.degrees(F.atan2(vx, vy)), F.lit(360.0)))  # held flat it points nowhere
    flat = F.pmod(360.0 - num(alpha), F.lit(360.0))
    return F.when(col(absolute), F.coalesce(full, flat))


def tilt_heading(ax, ay, az, mx, my, mz) -> Column:
    """Magnetic heading after removing pitch and roll; m* are calibrated readings. NULL where no horizontal field is left."""
    ax, ay, az, mx, my, mz = (num(c) for c in (ax, ay, az, mx, my, mz))
    n = F.sqrt(ax * ax + ay * ay + az * az)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    pitch = F.asin(-ax / n)
    roll = F.asin(clamp(ay / n / F.cos(pitch), -1.0, 1.0))
    fx = mx * F.cos(pitch) + mz * F.sin(pitch)
    fy = mx * F.sin(roll) * F.sin(pitch) + my * F.cos(roll) - mz * F.sin(roll) * F.cos(pitch)
    return F.when(F.hypot(fx, fy) > 1e-9, F.pmod(450.0 - F.degrees(F.atan2(fy, fx)), F.lit(360.0)))


def circular_mean(deg) -> Column:
    """Aggregate: mean direction in 0..360."""
    r = F.radians(num(deg))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def circular_spread(deg) -> Column:
    """Aggregate: circular standard deviation in degrees, 0 under two samples, at most 180."""
    r = F.radians(num(deg))
    resultant = F.greatest(F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r))), F.lit(1e-9))
    spread = F.least(F.lit(180.0), F.degrees(F.sqrt(F.greatest(-2.0 * F.log(resultant), F.lit(0.0)))))
    return F.when(F.count(num(deg)) < 2, F.lit(0.0)).otherwise(spread)

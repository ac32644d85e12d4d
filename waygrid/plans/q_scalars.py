"""Queries: scalar column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capture as C
from ..functions import floors as FL
from ..functions import geometry as G
from .catalog import query, rounded

# floor labels in many spellings, one per part
LABEL = """CASE p_partkey % 12 WHEN 0 THEN ' B2 ' WHEN 1 THEN 'gf' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'Level 3'
  WHEN 5 THEN 'L0' WHEN 6 THEN 'P-1' WHEN 7 THEN 'Roof top!' WHEN 8 THEN 'f12' WHEN 9 THEN 'LOBBY' WHEN 10 THEN '  ' ELSE 'basement 4' END"""
LABELS = f"lb AS (SELECT p_partkey AS id, {LABEL} AS label FROM part), nf AS (SELECT id, label, coalesce(nullif(trim(label), ''), '1') AS f FROM lb)"


def labels(t):
    return t.part.selectExpr("p_partkey AS id", f"{LABEL} AS label")


@query("normalize_floor", f"WITH {LABELS} SELECT id, f AS floor FROM nf")
def _(t):
    return labels(t).select("id", FL.normalize_floor("label").alias("floor"))


@query("floor_token", f"WITH {LABELS} SELECT id, regexp_replace(f, '[^A-Za-z0-9_-]+', '_', 'g') AS token FROM nf")
def _(t):
    return labels(t).select("id", FL.floor_token("label").alias("token"))


LEVEL = r"""CASE WHEN regexp_matches(f, '^(B|P|LB|SB|BASEMENT)\s*-?(\d+)$', 'i') THEN -CAST(regexp_extract(f, '(\d+)$', 1) AS INT)
  WHEN upper(f) IN ('G','GF','GR','GROUND','L','LOBBY','0','L0') THEN 0
  WHEN regexp_matches(f, '^(L|F|LEVEL|FLOOR)?\s*(\d+)$', 'i') THEN CAST(regexp_extract(f, '(\d+)$', 1) AS INT) END"""


@query("floor_level", f"WITH {LABELS} SELECT id, {LEVEL} AS level FROM nf")
def _(t):
    return labels(t).select("id", FL.floor_level("label").alias("level"))


@query("same_floor", f"WITH {LABELS} SELECT id, lower(f) = 'lobby' AS lobby, lower(f) = '1' AS first FROM nf")
def _(t):
    return labels(t).select("id", FL.same_floor("label", F.lit(" Lobby")).alias("lobby"), FL.same_floor("label", F.lit(None)).alias("first"))


@query("vertical_dir", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > o_custkey % 5 THEN 'up' WHEN o_orderkey % 5 < o_custkey % 5 THEN 'down'
  ELSE 'straight' END AS dir FROM orders""")
def _(t):
    o = t.orders
    return o.select("o_orderkey", FL.vertical_dir(o.o_custkey % 5, o.o_orderkey % 5).alias("dir"))


@query("image_id", f"""WITH {LABELS}, k AS (SELECT id, CASE WHEN regexp_replace(f, '[^A-Za-z0-9_-]+', '', 'g') = '' THEN '1' ELSE regexp_replace(f, '[^A-Za-z0-9_-]+', '', 'g') END AS tok FROM nf)
SELECT id, printf('F%s_Z%s_%05d_%03d', tok, 'A' || CAST(id % 4 AS VARCHAR), CAST(id % 90000 AS INT), CAST(id * 7 % 360 AS INT)) AS image_id FROM k""")
def _(t):
    zone = F.concat(F.lit("A"), (F.col("id") % 4).cast("string"))
    return labels(t).select("id", C.image_id("label", zone, F.col("id") % 90000, F.col("id") * 7 % 360).alias("image_id"))


IDS = "ii AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'IMG_' || CAST(p_partkey AS VARCHAR) ELSE printf('FB%d_Zz_%05d_%03d', CAST(p_partkey % 3 AS INT), CAST(p_partkey AS INT), CAST(p_partkey * 7 % 360 AS INT)) END AS image_id FROM part)"


def image_ids(t):
    i = F.col("p_partkey")
    made = F.format_string("FB%d_Zz_%05d_%03d", (i % 3).cast("int"), i.cast("int"), (i * 7 % 360).cast("int"))
    return t.part.select(i.alias("id"), F.when(i % 5 == 0, F.concat(F.lit("IMG_"), i.cast("string"))).otherwise(made).alias("image_id"))


@query("parse_image_id", rf"""WITH {IDS} SELECT id, nullif(regexp_extract(image_id, '^(.+)_(\d{{3}})$', 1), '') AS stem,
  CAST(nullif(regexp_extract(image_id, '^F[^_]+_Z.+_(\d{{5}})_\d{{3}}$', 1), '') AS INT) AS sequence,
  CAST(nullif(regexp_extract(image_id, '^(.+)_(\d{{3}})$', 2), '') AS INT) AS heading FROM ii""")
def _(t):
    return image_ids(t).select("id", C.parse_image_id("image_id").alias("p")).select("id", "p.*")


HD = "h AS (SELECT o_orderkey, (o_orderkey * 7) % 720 AS a, (o_custkey * 13) % 720 AS b FROM orders)"


def headings(t):
    return t.orders.selectExpr("o_orderkey", "(o_orderkey * 7) % 720 AS a", "(o_custkey * 13) % 720 AS b")


@query("heading_diff", f"WITH {HD} SELECT o_orderkey, least(abs(a - b) % 360, 360 - abs(a - b) % 360) AS d FROM h")
def _(t):
    return headings(t).select("o_orderkey", G.heading_diff("a", "b").alias("d"))


@query("signed_heading_delta", f"WITH {HD} SELECT o_orderkey, CAST((a - b + 540 + 720) % 360 - 180 AS DOUBLE) AS d FROM h")
def _(t):
    return headings(t).select("o_orderkey", G.signed_heading_delta("a", "b").alias("d"))


@query("heading_bucket", f"""WITH {HD}, d AS (SELECT o_orderkey, least(abs(a - b) % 360, 360 - abs(a - b) % 360) AS d FROM h)
SELECT o_orderkey, CASE WHEN d <= 45 THEN '0-45' WHEN d <= 90 THEN '45-90' ELSE '90-180' END AS bucket FROM d""")
def _(t):
    return headings(t).select("o_orderkey", G.heading_bucket(G.heading_diff("a", "b")).alias("bucket"))


P4 = """p4 AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 97 AS DOUBLE) AS ax, CAST(l_partkey % 89 AS DOUBLE) AS ay,
  CAST(l_suppkey % 83 AS DOUBLE) AS bx, CAST((l_partkey * 3) % 79 AS DOUBLE) AS by_, CAST((l_orderkey * 5) % 73 AS DOUBLE) AS cx,
  CAST((l_partkey * 7) % 71 AS DOUBLE) AS cy, CAST((l_orderkey * 11) % 360 AS DOUBLE) AS h FROM lineitem)"""


def points4(t):
    return t.lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "CAST(l_orderkey % 97 AS DOUBLE) AS ax", "CAST(l_partkey % 89 AS DOUBLE) AS ay",
        "CAST(l_suppkey % 83 AS DOUBLE) AS bx", "CAST((l_partkey * 3) % 79 AS DOUBLE) AS by_", "CAST((l_orderkey * 5) % 73 AS DOUBLE) AS cx",
        "CAST((l_partkey * 7) % 71 AS DOUBLE) AS cy", "CAST((l_orderkey * 11) % 360 AS DOUBLE) AS h")


@query("axis_diff", f"""WITH {P4}, d AS (SELECT id, abs(fmod(fmod(h - degrees(atan2(bx - ax, by_ - ay)) + 180, 360) + 360, 360) - 180) AS d0 FROM
  (SELECT id, h, ax, ay, bx, by_ FROM p4)), e AS (SELECT id, d0 FROM d)
SELECT id, round(least(d0, 180 - d0), 6) AS d FROM e""".replace("fmod(fmod(", "mod(mod(").replace("+ 180, 360) + 360, 360)", "+ 180, 360) + 360, 360)"))
def _(t):
    p = points4(t)
    return rounded(p.select("id", G.axis_diff("h", "ax", "ay", "bx", "by_").alias("d")))


@query("bearing", f"WITH {P4} SELECT id, round(mod(degrees(atan2(bx - ax, by_ - ay)) + 360, 360), 6) AS deg FROM p4")
def _(t):
    p = points4(t)
    return rounded(p.select("id", G.bearing("ax", "ay", "bx", "by_").alias("deg")))


@query("turn_angle", f"""WITH {P4}, a AS (SELECT id, degrees(atan2((bx-ax)*(cy-by_) - (by_-ay)*(cx-bx) + 0e0, (bx-ax)*(cx-bx) + (by_-ay)*(cy-by_) + 0e0)) AS ang FROM p4)
SELECT id, round(ang, 6) + 0e0 AS angle, CASE WHEN abs(ang) < 30 THEN NULL WHEN abs(ang) >= 150 THEN 'Turn around' WHEN ang > 0 THEN 'Turn left' ELSE 'Turn right' END AS label
FROM a""")
def _(t):
    a = points4(t).withColumn("angle", G.turn_angle("ax", "ay", "bx", "by_", "cx", "cy"))
    return rounded(a.select("id", "angle", G.turn_label("angle").alias("label")))


@query("yaw_from_quat", f"""WITH {P4}, q AS (SELECT id, ax / 97 AS w, ay / 89 AS x, bx / 83 AS y, by_ / 79 AS z FROM p4)
SELECT id, round(mod(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))) + 360, 360), 5) AS yaw FROM q""")
def _(t):
    q = points4(t).selectExpr("id", "ax / 97 AS w", "ay / 89 AS x", "bx / 83 AS y", "by_ / 79 AS z")
    return rounded(q.select("id", G.yaw_from_quat("w", "x", "y", "z").alias("yaw")), 5)


# one affine transform per row: rotation-like with a shift; every 50th is singular
TR = """tr AS (SELECT *, 2e-2 AS a, CASE WHEN id % 50 = 0 THEN 4e-2 ELSE 1e-3 END AS b, 1e-3 + bx / 1e4 AS c,
  CASE WHEN id % 50 = 0 THEN 2 * (1e-3 + bx / 1e4) ELSE -19e-3 END AS d, cx AS tx, cy AS ty FROM p4)"""
TRANSFORM = """named_struct('a', 2e-2, 'b', CASE WHEN id % 50 = 0 THEN 4e-2 ELSE 1e-3 END, 'c', 1e-3 + bx / 1e4,
  'd', CASE WHEN id % 50 = 0 THEN 2 * (1e-3 + bx / 1e4) ELSE -19e-3 END, 'tx', cx, 'ty', cy)"""


def transforms(t):
    return points4(t).withColumn("t", F.expr(TRANSFORM))


@query("pixel_to_world", f"WITH {P4}, {TR} SELECT id, round(a * ax + b * ay + tx, 6) AS x, round(c * ax + d * ay + ty, 6) AS y FROM tr")
def _(t):
    return rounded(transforms(t).select("id", G.pixel_to_world("ax", "ay", "t").alias("w")).select("id", "w.*"))


@query("world_to_pixel", f"""WITH {P4}, {TR}, w AS (SELECT *, a * d - b * c AS det FROM tr)
SELECT id, round(CASE WHEN abs(det) >= 1e-12 THEN (d * (ax - tx) - b * (ay - ty)) / det END, 4) + 0e0 AS px,
  round(CASE WHEN abs(det) >= 1e-12 THEN (a * (ay - ty) - c * (ax - tx)) / det END, 4) + 0e0 AS py FROM w""")
def _(t):
    return rounded(transforms(t).select("id", G.world_to_pixel("ax", "ay", "t").alias("p")).select("id", "p.px", "p.py"), 4)


@query("heading_direction_px", f"""WITH {P4}, {TR}, w AS (SELECT id, a * d - b * c AS det, d * sin(radians(h)) - b * cos(radians(h)) AS u,
  a * cos(radians(h)) - c * sin(radians(h)) AS v FROM tr), s AS (SELECT id, u * sign(det) AS u, v * sign(det) AS v, sqrt(u * u + v * v) AS n, det FROM w)
SELECT id, round(CASE WHEN abs(det) >= 1e-12 THEN u / n END, 5) AS dx, round(CASE WHEN abs(det) >= 1e-12 THEN v / n END, 5) AS dy FROM s""")
def _(t):
    return rounded(transforms(t).select("id", G.heading_direction_px("ax", "ay", "h", "t").alias("d")).select("id", "d.*"), 5)


@query("implied_scale", f"WITH {P4}, {TR} SELECT id, round(sqrt(a * a + c * c), 6) AS scale_x, round(sqrt(b * b + d * d), 6) AS scale_y FROM tr")
def _(t):
    return rounded(transforms(t).select("id", G.implied_scale("t").alias("s")).select("id", "s.*"))


@query("segment_similarity", f"""WITH {P4}, s AS (SELECT id, ax, ay, bx, by_, cx, cy, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS la,
  sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)) AS lb, atan2(ay-cy, ax-cx) - atan2(by_-ay, bx-ax) AS ang FROM p4),
r AS (SELECT *, lb / nullif(la, 0) AS scale FROM s)
SELECT id, round(CASE WHEN la >= 1e-3 AND lb >= 1e-3 THEN scale END, 7) AS scale,
  round(CASE WHEN la >= 1e-3 AND lb >= 1e-3 THEN cx - scale * (cos(ang) * ax - sin(ang) * ay) END, 7) + 0e0 AS tx,
  round(CASE WHEN la >= 1e-3 AND lb >= 1e-3 THEN cy - scale * (sin(ang) * ax + cos(ang) * ay) END, 7) + 0e0 AS ty FROM r""")
def _(t):
    p = points4(t)
    s = p.select("id", G.segment_similarity("ax", "ay", "bx", "by_", "cx", "cy", "ax", "ay").alias("s"))
    return s.select("id", F.round("s.scale", 7).alias("scale"), (F.round("s.tx", 7) + 0.0).alias("tx"), (F.round("s.ty", 7) + 0.0).alias("ty"))


@query("is_same_location", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'L' || CAST(o_orderkey % 7 AS VARCHAR) END AS la,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'L' || CAST(o_custkey % 7 AS VARCHAR) END AS lb, (o_orderkey % 10) / 1e1 AS xa, (o_custkey % 10) / 1e1 AS xb FROM orders)
SELECT o_orderkey, CASE WHEN la <> '' AND coalesce(lb, '') <> '' THEN la = lb ELSE abs(xa - xb) <= 5e-1 END AS same FROM r""")
def _(t):
    r = t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'L' || CAST(o_orderkey % 7 AS STRING) END AS la",
        "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'L' || CAST(o_custkey % 7 AS STRING) END AS lb",
        "(o_orderkey % 10) / 1e1 AS xa", "(o_custkey % 10) / 1e1 AS xb")
    return r.select("o_orderkey", G.is_same_location("la", "lb", "xa", F.lit(0.0), "xb", F.lit(0.0)).alias("same"))


NEAREST = """n0 AS (SELECT *, CASE WHEN ax = bx AND ay = by_ THEN 0e0 ELSE least(greatest(((cx-ax)*(bx-ax)+(cy-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)), 0e0), 1e0) END AS tt FROM p4),
n1 AS (SELECT *, ax + tt * (bx-ax) AS nx, ay + tt * (by_-ay) AS ny FROM n0)"""


@query("nearest_on_segment", f"WITH {P4}, {NEAREST} SELECT id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(sqrt((cx-nx)*(cx-nx)+(cy-ny)*(cy-ny)), 6) AS dist, round(tt, 6) AS t FROM n1")
def _(t):
    return rounded(points4(t).select("id", G.nearest_on_segment("cx", "cy", "ax", "ay", "bx", "by_").alias("s")).select("id", "s.*"))


@query("band_place", f"""WITH {P4}, {NEAREST},
b0 AS (SELECT *, 10e0 AS l, 5e0 AS r, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS len FROM n1),
b1 AS (SELECT *, (cy-ny)*(bx-ax)/nullif(len, 0) - (cx-nx)*(by_-ay)/nullif(len, 0) AS lat, (cx-nx)*(bx-ax)/nullif(len, 0) + (cy-ny)*(by_-ay)/nullif(len, 0) AS alo, sqrt((cx-nx)*(cx-nx)+(cy-ny)*(cy-ny)) AS dist FROM b0),
b2 AS (SELECT *, least(greatest(lat, -r), l) AS held FROM b1), b3 AS (SELECT *, CASE WHEN len > 0 THEN sqrt(alo*alo + (lat-held)*(lat-held)) ELSE greatest(dist - 10, 0) END AS o FROM b2)
SELECT id, round(CASE WHEN o <= 1e-9 THEN cx WHEN len = 0 THEN nx + (cx-nx) * 10 / dist ELSE nx - (by_-ay)/len*held END, 5) AS bx, round(CASE WHEN o <= 1e-9 THEN cy WHEN len = 0 THEN ny + (cy-ny) * 10 / dist ELSE ny + (bx-ax)/len*held END, 5) AS by_,
  round(CASE WHEN o <= 1e-9 THEN 0e0 ELSE o END, 5) AS outside FROM b3""")
def _(t):
    p = points4(t)
    left, right = G.side_widths(None, F.lit(10.0), F.lit(5.0))
    s = p.select("id", G.band_place("cx", "cy", "ax", "ay", "bx", "by_", left, right).alias("s"))
    return rounded(s.selectExpr("id", "s.bx AS bx", "s.by AS by_", "s.outside AS outside"), 5)


@query("segment_key", f"""WITH {P4}, k AS (SELECT id, printf('%.2f,%.2f', ax, ay) AS a, printf('%.2f,%.2f', bx, by_) AS b, (ax < bx OR (ax = bx AND ay <= by_)) AS fwd FROM p4)
SELECT id, CASE WHEN fwd THEN a || '|' || b ELSE b || '|' || a END AS seg FROM k""")
def _(t):
    return points4(t).select("id", G.segment_key("ax", "ay", "bx", "by_").alias("seg"))


@query("fix_confidence", f"WITH {P4} SELECT id, round(least(1e0, 35e-2 + 65e-2 * (ax / greatest(ay, 1))), 6) AS conf FROM p4")
def _(t):
    return rounded(points4(t).select("id", C.fix_confidence("ax", "ay").alias("conf")))


@query("marker_confidence", f"""WITH {P4} SELECT id, round(least(greatest(95e-2 - 4e-2 * greatest(0e0, ax / 5 - 15e-1) - CASE WHEN id % 2 = 0 THEN 1e-1 ELSE 0e0 END, 55e-2), 95e-2), 6) AS conf FROM p4""")
def _(t):
    return rounded(points4(t).select("id", C.marker_confidence(F.col("ax") / 5, F.col("id") % 2 == 0).alias("conf")))


INTR = """iv AS (SELECT id, 640e0 AS w, 480e0 + ay AS h, 100 + 20 * ax AS fx, 150 + 15 * ay AS fy, bx * 9 AS cx0, by_ * 7 AS cy0 FROM p4),
  ok AS (SELECT *, w >= 16 AND h >= 16 AND fx > 25e-2 * greatest(w, h) AND fx < 3 * greatest(w, h) AND fy > 25e-2 * greatest(w, h) AND fy < 3 * greatest(w, h)
    AND cx0 > 0 AND cx0 < w AND cy0 > 0 AND cy0 < h AS good FROM iv)"""


def intrinsics(t):
    p = points4(t).selectExpr("id", "640e0 AS w", "480e0 + ay AS h", "100 + 20 * ax AS fx", "150 + 15 * ay AS fy", "bx * 9 AS cx0", "by_ * 7 AS cy0")
    return p.withColumn("k", C.validate_intrinsics("fx", "fy", "cx0", "cy0", "w", "h"))


@query("validate_intrinsics", f"WITH {P4}, {INTR} SELECT id, good AS valid, CASE WHEN good THEN fx END AS fx, CASE WHEN good THEN CAST(h AS INT) END AS height FROM ok")
def _(t):
    return intrinsics(t).select("id", F.col("k").isNotNull().alias("valid"), "k.fx", "k.height")


@query("camera_matrix", f"""WITH {P4}, {INTR}, c AS (SELECT *, 1280e0 AS iw, 960e0 + ay2 AS ih FROM (SELECT ok.*, (id % 7) * 10e0 AS ay2 FROM ok)),
u AS (SELECT *, good AND abs(iw / w - ih / h) < 2e-2 AS use FROM c)
SELECT id, use AS known, round(CASE WHEN use THEN fx * iw / w ELSE 85e-2 * greatest(iw, ih) END, 6) AS fx, round(CASE WHEN use THEN fy * (ih / h) ELSE 85e-2 * greatest(iw, ih) END, 6) AS fy,
  round(CASE WHEN use THEN cx0 * iw / w ELSE iw / 2 END, 6) AS cx, round(CASE WHEN use THEN cy0 * (ih / h) ELSE ih / 2 END, 6) AS cy FROM u""")
def _(t):
    i = intrinsics(t).withColumn("ih", F.expr("960e0 + (id % 7) * 10e0"))
    return rounded(i.select("id", C.camera_matrix(F.lit(1280.0), "ih", "k").alias("m")).select("id", "m.*"))


@query("focal_px", f"""WITH {P4}, c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 26e0 WHEN id % 3 = 1 THEN NULL ELSE 0e0 END AS f35, 4032e0 AS w, 3000 + ay AS h FROM p4)
SELECT id, CAST(i AS INT) AS pos, round(CASE WHEN coalesce(f35, 0) <> 0 THEN f35 * sqrt(w * w + h * h) / 4327e-2 WHEN i = 0 THEN 85e-2 * w ELSE 72e-2 * w END, 6) AS focal
FROM c JOIN (SELECT range AS i FROM range(2)) r ON i = 0 OR coalesce(f35, 0) = 0""")
def _(t):
    p = points4(t).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 26e0 WHEN id % 3 = 1 THEN NULL ELSE 0e0 END AS f35", "3000 + ay AS h")
    return rounded(p.select("id", F.posexplode(C.focal_px("f35", F.lit(4032.0), "h")).alias("pos", "focal")))


@query("kiosk_start_pose", f"""WITH {P4} SELECT id, round(ax + 8e-1 * sin(radians(h)), 6) AS x, round(ay + 8e-1 * cos(radians(h)), 6) AS y, mod(h + 180, 360) AS heading FROM p4""")
def _(t):
    return rounded(points4(t).select("id", C.kiosk_start_pose("ax", "ay", "h", F.lit(0.8)).alias("p")).select("id", "p.*"))


@query("choose_anchor", f"""WITH {P4}, r AS (SELECT id, ax, ay, CASE WHEN id % 4 = 0 THEN NULL ELSE ax + bx / 20 END AS rx, ay + by_ / 40 AS ry FROM p4),
k AS (SELECT *, coalesce(sqrt((rx-ax)*(rx-ax)+(ry-ay)*(ry-ay)) <= 25e-1, false) AS keep FROM r)
SELECT id, round(CASE WHEN keep THEN rx ELSE ax END, 6) AS x, round(CASE WHEN keep THEN ry ELSE ay END, 6) AS y FROM k""")
def _(t):
    r = points4(t).selectExpr("id", "ax", "ay", "CASE WHEN id % 4 = 0 THEN NULL ELSE ax + bx / 20 END AS rx", "ay + by_ / 40 AS ry")
    return rounded(r.select("id", C.choose_anchor("ax", "ay", "rx", "ry").alias("p")).select("id", "p.*"))


@query("carried_heading", f"""WITH {P4} SELECT id, CASE WHEN id % 5 = 0 THEN h ELSE mod(h + mod(ax - ay + 540, 360) - 180 + 360, 360) END AS heading FROM p4""")
def _(t):
    now = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("ax"))
    return points4(t).select("id", G.carried_heading("h", "ay", now).alias("heading"))


LINKS = """CASE p_partkey % 9 WHEN 0 THEN 'https://ex.org/parking/?slot=86-03c&kiosk=k2' WHEN 1 THEN '?bay=12%20a' WHEN 2 THEN ' b 17 ' WHEN 3 THEN 'hello'
  WHEN 4 THEN NULL WHEN 5 THEN 'https://ex.org/?kiosk=K1' WHEN 6 THEN '/go?p=A' WHEN 7 THEN 'x?plate=zz-9&slot=&k=front' ELSE 'P' || CAST(p_partkey AS STRING) END"""


@query("parse_parking_link", f"""WITH l AS (SELECT p_partkey AS id, p_partkey % 9 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN '86-03C' WHEN 1 THEN '12-A' WHEN 2 THEN 'B-17' WHEN 7 THEN 'ZZ-9' WHEN 8 THEN 'P' || CAST(id AS VARCHAR) END AS slot,
  CASE k WHEN 0 THEN 'K2' WHEN 7 THEN 'FRONT' END AS kiosk FROM l""")
def _(t):
    p = t.part.selectExpr("p_partkey AS id", f"{LINKS} AS link")
    return p.select("id", C.parse_parking_link("link").alias("p")).select("id", "p.*")


@query("normalize_bay", r"""WITH n AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(trim(upper(p_name)), '\s+', '-', 'g'), '[^A-Z0-9-]', '', 'g') AS bay FROM part)
SELECT id, bay, length(bay) >= 2 AND regexp_full_match(bay, '[A-Z0-9]+(-[A-Z0-9]+)*') AS valid FROM n""")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), C.normalize_bay("p_name").alias("bay")).withColumn("valid", C.valid_bay(F.col("bay")))


@query("age_days", """WITH o AS (SELECT o_orderkey, 17e8 + o_orderkey * 60 AS epoch, CASE WHEN o_orderkey % 6 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM orders)
SELECT o_orderkey, round(abs(epoch - epoch(TRY_CAST(iso AS TIMESTAMPTZ))) / 86400, 6) AS days FROM o""")
def _(t):
    iso = F.when(F.col("o_orderkey") % 6 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rounded(t.orders.select("o_orderkey", C.age_days(F.expr("17e8 + o_orderkey * 60"), iso).alias("days")))


@query("texture_bucket", "SELECT o_orderkey, CASE WHEN o_custkey % 300 < 50 THEN 'low_texture' WHEN o_custkey % 300 < 200 THEN 'medium_texture' ELSE 'high_texture' END AS bucket FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.texture_bucket(F.col("o_custkey") % 300).alias("bucket"))


@query("rescale_xy", f"WITH {P4} SELECT id, round_even(ax * 1e-3, 6) AS ax, round_even(ay * 1e-3, 6) AS ay FROM p4")
def _(t):
    return points4(t).select("id", "ax", "ay").withColumns(G.rescale_xy(0.001, 6, "ax", "ay"))


@query("euler_heading", f"""WITH {P4}, e AS (SELECT id, radians(h) AS a, radians(ax) AS b, radians(ay - 45) AS g, h, id % 4 AS k FROM p4),
f AS (SELECT *, -cos(a)*sin(g) - sin(a)*sin(b)*cos(g) AS vx, -sin(a)*sin(g) + cos(a)*sin(b)*cos(g) AS vy FROM e)
SELECT id, round(CASE WHEN k = 0 THEN NULL WHEN k = 1 OR sqrt(vx*vx + vy*vy) <= 1e-9 THEN mod(360 - h, 360) ELSE mod(degrees(atan2(vx, vy)) + 360, 360) END, 4) AS heading FROM f""")
def _(t):
    k = F.col("id") % 4
    e = points4(t).select("id", C.euler_heading("h", F.when(k != 1, F.col("ax")), F.expr("ay - 45"), k != 0).alias("heading"))
    return rounded(e, 4)


@query("tilt_heading", f"""WITH {P4}, v AS (SELECT id, (ax - 48) / 20 AS gx, (ay - 44) / 20 AS gy, 9e0 AS gz, bx - 41 AS mx, by_ - 39 AS my, cx - 36 AS mz FROM p4),
n AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) AS nn FROM v), p AS (SELECT *, asin(-gx / nn) AS pitch FROM n), r AS (SELECT *, asin(gy / nn / cos(pitch)) AS roll FROM p),
f AS (SELECT id, mx*sin(roll)*sin(pitch) + my*cos(roll) - mz*sin(roll)*cos(pitch) AS fy, mx*cos(pitch) + mz*sin(pitch) AS fx FROM r)
SELECT id, round(CASE WHEN sqrt(fx*fx + fy*fy) > 1e-9 THEN mod(450 - degrees(atan2(fy, fx)), 360) END, 4) AS heading FROM f""")
def _(t):
    v = points4(t).selectExpr("id", "(ax - 48) / 20 AS gx", "(ay - 44) / 20 AS gy", "9e0 AS gz", "bx - 41 AS mx", "by_ - 39 AS my", "cx - 36 AS mz")
    return rounded(v.select("id", C.tilt_heading("gx", "gy", "gz", "mx", "my", "mz").alias("heading")), 4)


@query("circular_mean", """SELECT device_id, round(mod(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360, 360), 5) AS mean FROM v_points GROUP BY device_id""")
def _(t):
    return rounded(t.v_points.groupBy("device_id").agg(C.circular_mean("heading").alias("mean")), 5)


@query("circular_spread", """WITH s AS (SELECT device_id, count(*) AS n, sqrt(avg(sin(radians(heading / 4)))*avg(sin(radians(heading / 4))) + avg(cos(radians(heading / 4)))*avg(cos(radians(heading / 4)))) AS r FROM v_points GROUP BY device_id)
SELECT device_id, round(CASE WHEN n < 2 THEN 0e0 ELSE least(180e0, degrees(sqrt(greatest(-2 * ln(greatest(r, 1e-9)), 0)))) END, 5) AS spread FROM s""")
def _(t):
    return rounded(t.v_points.groupBy("device_id").agg(C.circular_spread(F.col("heading") / 4).alias("spread")), 5)

"""Queries: survey ingestion, record edits, registries, floors, georeferencing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.floors import normalize_floor
from ..operators import survey as S
from .catalog import query, rounded
from .q_scalars import IDS, LABEL, image_ids

# photos: one per order, in a folder per customer; some folders lack EXIF times
PHOTO = ["'L' || CAST(o_custkey AS STRING) AS location_id", "'IMG_' || CAST((o_orderkey * 7919) % 1000003 AS STRING) || '.jpg' AS filename",
         "CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey * 31337) % 999983 AS STRING) END AS exif_time",
         "CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_orderkey * 13) % 3600 AS DOUBLE) / 10 END AS exif_heading", "o_orderkey"]
LOC = ["'L' || CAST(c_custkey AS STRING) AS location_id", "CASE c_custkey % 4 WHEN 0 THEN ' G ' WHEN 1 THEN NULL ELSE 'B1' END AS floor",
       "'Z' || CAST(c_nationkey AS STRING) AS zone", "(c_custkey * 7 % 1000) / 1e1 AS x", "(c_custkey * 11 % 1000) / 1e1 AS y"]
PHOTO_SQL = f"ph AS (SELECT {', '.join(PHOTO)} FROM orders)"
LOC_SQL = f"lo AS (SELECT {', '.join(LOC)} FROM customer WHERE c_custkey % 10 <> 3)"
MAN_SQL = "ma AS (SELECT location_id, filename, CAST((o_orderkey * 17) % 7200 AS DOUBLE) / 10 AS heading_degrees FROM ph WHERE o_orderkey % 3 = 0)"
ORD_SQL = """od AS (SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY CASE WHEN dated THEN exif_time END NULLS LAST, filename) - 1 AS BIGINT) AS photo_no FROM
  (SELECT *, count(*) OVER (PARTITION BY location_id) AS n_photos, count(exif_time) OVER (PARTITION BY location_id) = count(*) OVER (PARTITION BY location_id) AS dated FROM {src}))"""


def photos(t):
    return t.orders.selectExpr(*PHOTO)


def locations(t):
    # every tenth location is missing from the manifest
    return t.customer.where("c_custkey % 10 <> 3").selectExpr(*LOC)


def manifest(t):
    return photos(t).where("o_orderkey % 3 = 0").selectExpr("location_id", "filename", "CAST((o_orderkey * 17) % 7200 AS DOUBLE) / 10 AS heading_degrees")


@query("ordered_photos", f"WITH {PHOTO_SQL}, {ORD_SQL.format(src='ph')} SELECT location_id, filename, photo_no, n_photos FROM od")
def _(t):
    return S.ordered_photos(photos(t)).select("location_id", "filename", "photo_no", "n_photos")


INGEST = f"""{PHOTO_SQL}, {LOC_SQL}, {MAN_SQL}, kp AS (SELECT ph.*, coalesce(nullif(trim(lo.floor), ''), '1') AS floor, zone, x, y FROM ph JOIN lo USING (location_id)),
{ORD_SQL.format(src='kp')}, ing AS (SELECT od.*, row_number() OVER (ORDER BY location_id, photo_no) AS sequence,
  CAST(CAST(round_even(coalesce(heading_degrees, exif_heading, photo_no * 36e1 / n_photos), 0) AS BIGINT) % 360 AS INT) AS orientation,
  CASE WHEN heading_degrees IS NOT NULL THEN 'manifest' WHEN exif_heading IS NOT NULL THEN 'exif' ELSE 'approximated' END AS heading_source
  FROM od LEFT JOIN ma USING (location_id, filename))"""


@query("ingest_survey", f"""WITH {INGEST} SELECT location_id, filename, floor, zone, x, y, orientation, heading_source, sequence,
  printf('F%s_Z%s_%05d_%03d', floor, zone, sequence, orientation) AS image_id FROM ing""")
def _(t):
    return S.ingest_survey(photos(t), locations(t), manifest(t))


@query("heading_source_counts", f"""WITH {INGEST} SELECT count(*) FILTER (heading_source = 'manifest') AS manifest, count(*) FILTER (heading_source = 'exif') AS exif,
  count(*) FILTER (heading_source = 'approximated') AS approximated FROM ing""")
def _(t):
    return S.heading_source_counts(S.ingest_survey(photos(t), locations(t), manifest(t)))


@query("exif_coverage", f"WITH {PHOTO_SQL} SELECT location_id, count(*) AS photos, count(exif_heading) AS with_heading, count(exif_time) AS with_time FROM ph GROUP BY 1")
def _(t):
    return S.exif_coverage(photos(t))


@query("unplaced_photos", f"""WITH {PHOTO_SQL}, {LOC_SQL} SELECT DISTINCT location_id, 'no_manifest' AS problem FROM ph WHERE location_id NOT IN (SELECT location_id FROM lo)
UNION ALL SELECT location_id, 'no_photos' FROM lo WHERE location_id NOT IN (SELECT location_id FROM ph)""")
def _(t):
    return S.unplaced_photos(photos(t), locations(t))


@query("pair_ordered_headings", f"""WITH {PHOTO_SQL}, {ORD_SQL.format(src='ph')}, n AS (SELECT location_id, count(*) AS n FROM ph GROUP BY 1),
h AS (SELECT location_id, CASE WHEN CAST(substr(location_id, 2) AS BIGINT) % 4 = 0 THEN n + 1 ELSE n END AS k FROM n)
SELECT od.location_id, filename, CAST((photo_no * 37 + length(od.location_id)) % 360 AS DOUBLE) AS heading_degrees FROM od JOIN h USING (location_id) WHERE k = n_photos""")
def _(t):
    # one heading list per folder; every fourth list has one entry too many
    n = photos(t).groupBy("location_id").agg(F.count("*").alias("n"))
    k = F.col("n") + F.when(F.substring("location_id", 2, 20).cast("long") % 4 == 0, 1).otherwise(0)
    lists = n.select("location_id", F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1), lambda i: ((i * 37 + F.length("location_id")) % 360).cast("string")), " ; ").alias("headings"))
    return S.pair_ordered_headings(photos(t), lists)


@query("next_sequence", rf"WITH {IDS} SELECT coalesce(max(CAST(nullif(regexp_extract(image_id, '^F[^_]+_Z.+_(\d{{5}})_\d{{3}}$', 1), '') AS INT)), 0) + 1 AS next_sequence FROM ii")
def _(t):
    return S.next_sequence(image_ids(t))


@query("photo_counts", """SELECT c_custkey AS location_id, CAST(coalesce(n, 0) AS BIGINT) AS photos FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def _(t):
    rec = t.orders.selectExpr("o_custkey AS location_id", "o_orderkey")
    return S.photo_counts(t.customer.selectExpr("c_custkey AS location_id"), rec)


@query("survey_locations", """SELECT DISTINCT location_id, first_value(floor) OVER w AS floor, first_value(zone) OVER w AS zone, first_value(x) OVER w AS x, first_value(y) OVER w AS y
FROM v_images WINDOW w AS (PARTITION BY location_id ORDER BY image_id)""")
def _(t):
    return S.survey_locations(t.v_images)


REC = ["format_string('FG_ZA_%05d_%03d', CAST(o_custkey AS INT), CAST(o_orderkey % 360 AS INT)) AS image_id", "CAST(o_orderkey % 360 AS INT) AS orientation",
       "'G/' || format_string('FG_ZA_%05d_%03d', CAST(o_custkey AS INT), CAST(o_orderkey % 360 AS INT)) || '.jpg' AS processed_path"]
REC_SQL = f"rc AS (SELECT DISTINCT {', '.join(REC).replace('format_string', 'printf')} FROM orders)"


def records(t):
    return t.orders.selectExpr(*REC).distinct()


@query("update_heading", rf"""WITH {REC_SQL}, ed AS (SELECT image_id, (orientation * 7 + 90) % 360 AS deg, regexp_extract(image_id, '^(.+)_(\d{{3}})$', 1) || printf('_%03d', (orientation * 7 + 90) % 360) AS new_id
  FROM rc WHERE orientation % 5 = 0), st AS (SELECT rc.*, deg, new_id, new_id IS NOT NULL AND NOT (new_id <> rc.image_id AND new_id IN (SELECT image_id FROM rc)) AS ok FROM rc LEFT JOIN ed USING (image_id))
SELECT CASE WHEN ok THEN new_id ELSE image_id END AS image_id, CASE WHEN ok THEN deg ELSE orientation END AS orientation,
  CASE WHEN ok THEN replace(processed_path, image_id, new_id) ELSE processed_path END AS processed_path, CASE WHEN new_id IS NOT NULL THEN ok END AS applied FROM st""")
def _(t):
    r = records(t)
    edits = r.where("orientation % 5 = 0").selectExpr("image_id", "CAST((orientation * 7 + 90) % 360 AS DOUBLE) AS heading_degrees")
    return S.update_heading(r, edits)


@query("delete_records", """SELECT image_id, 'kept' AS state FROM v_images WHERE image_id % 3 <> 0 UNION ALL
SELECT vec_id + 1000000, 'missing' FROM embeddings WHERE vec_id % 4 = 0""")
def _(t):
    i = t.v_images
    ids = i.where("image_id % 3 = 0").select("image_id").unionByName(i.where("image_id % 4 = 0").selectExpr("image_id + 1000000 AS image_id"))
    kept, missing = S.delete_records(i, ids)
    return kept.select("image_id", F.lit("kept").alias("state")).unionByName(missing.select("image_id", F.lit("missing").alias("state")))


@query("records_for_floor", "SELECT image_id, floor, location_id FROM v_images WHERE floor = 'B1'")
def _(t):
    return S.records_for(t.v_images, "floor", "B1").select("image_id", "floor", "location_id")


@query("records_for_location", "SELECT image_id, location_id FROM v_images WHERE location_id = 3")
def _(t):
    return S.records_for(t.v_images, "location_id", 3).select("image_id", "location_id")


UPD = "up AS (SELECT 'L' || CAST(o_custkey * 2 AS VARCHAR) AS location_id, min(CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'R' END) AS floor, 'Q' AS zone, avg(o_totalprice) / 7e0 AS x, max(o_totalprice) / 3e0 AS y FROM orders GROUP BY o_custkey)"


@query("upsert_locations", f"""WITH {LOC_SQL}, {UPD} SELECT location_id, CASE WHEN up.zone IS NOT NULL THEN coalesce(nullif(trim(up.floor), ''), '1') ELSE lo.floor END AS floor,
  coalesce(up.zone, lo.zone) AS zone, CASE WHEN up.zone IS NOT NULL THEN round_even(round(up.x, 9), 3) ELSE lo.x END AS x, CASE WHEN up.zone IS NOT NULL THEN round_even(round(up.y, 9), 3) ELSE lo.y END AS y
FROM lo FULL JOIN up USING (location_id)""")
def _(t):
    up = t.orders.groupBy("o_custkey").agg(
        F.min(F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'R' END")).alias("floor"), F.round(F.avg("o_totalprice") / 7.0, 9).alias("x"),
        F.round(F.max("o_totalprice") / 3.0, 9).alias("y")).selectExpr("'L' || CAST(o_custkey * 2 AS STRING) AS location_id", "floor", "'Q' AS zone", "x", "y")
    return S.upsert_locations(locations(t), up)


@query("delete_locations", f"WITH {LOC_SQL} SELECT location_id, zone FROM lo WHERE CAST(substr(location_id, 2) AS BIGINT) % 4 <> 0")
def _(t):
    ids = t.customer.where("c_custkey % 4 = 0").selectExpr("'L' || CAST(c_custkey AS STRING) AS location_id")
    return S.delete_locations(locations(t), ids).select("location_id", "zone")


@query("retag_floor", """SELECT 'image' AS kind, CAST(image_id AS VARCHAR) AS id, CASE floor WHEN 'B1' THEN 'P1' ELSE floor END AS floor FROM v_images
UNION ALL SELECT 'landmark', CAST(landmark_id AS VARCHAR), CASE floor WHEN 'B1' THEN 'P1' ELSE floor END FROM v_landmarks
UNION ALL SELECT 'connector', CAST(site_id AS VARCHAR) || connector_id, CASE floor WHEN 'B1' THEN 'P1' ELSE floor END FROM v_landings""")
def _(t):
    conn = t.v_landings.groupBy("site_id", "connector_id").agg(F.map_from_entries(F.collect_list(F.struct("floor", F.struct("x", "y")))).alias("nodes"))
    out = S.retag_floor({"images": t.v_images, "landmarks": t.v_landmarks}, "B1", "P1", conn)
    pick = lambda kind, df, i: df.select(F.lit(kind).alias("kind"), i.alias("id"), "floor")
    keys = out["connectors"].select("site_id", "connector_id", F.explode(F.map_keys("nodes")).alias("floor"))
    return (pick("image", out["images"], F.col("image_id").cast("string"))
            .unionByName(pick("landmark", out["landmarks"], F.col("landmark_id").cast("string")))
            .unionByName(pick("connector", keys, F.concat(F.col("site_id").cast("string"), "connector_id"))))


@query("retag_counts", """SELECT 'images' AS "table", count(*) FILTER (floor = 'B1') AS changed FROM v_images UNION ALL SELECT 'landmarks', count(*) FILTER (floor = 'B1') FROM v_landmarks""")
def _(t):
    return S.retag_counts({"images": t.v_images, "landmarks": t.v_landmarks}, "B1")


@query("replace_floor_geometry", """SELECT site_id, floor, seg_no, x1, y1, x2, y2 FROM v_corridors WHERE NOT (floor = 'G' AND site_id % 2 = 0)
UNION ALL SELECT s_suppkey, 'G', 99, 0e0, 0e0, 5e0, 5e0 FROM supplier WHERE s_suppkey % 2 = 0""")
def _(t):
    cur = t.v_corridors.select("site_id", "floor", "seg_no", "x1", "y1", "x2", "y2")
    new = t.supplier.where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS site_id", "'G' AS floor", "99 AS seg_no", "0e0 AS x1", "0e0 AS y1", "5e0 AS x2", "5e0 AS y2")
    return S.replace_floor_geometry(cur, new)


MK = ["l_suppkey AS site_id", "CASE l_linenumber % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS floor", "CAST(l_partkey % 52 AS INT) AS marker_id",
      "(l_quantity + 1) / 5e1 AS size_m", "l_quantity / 15e0 AS height_m"]
KI = ["o_custkey % 50 AS site_id", "CASE o_orderkey % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS floor",
      "CASE WHEN o_orderkey % 11 = 0 THEN 'bad id' ELSE ' k' || CAST(o_orderkey % 997 AS STRING) END AS kiosk_id", "(o_orderkey % 40) / 1e1 AS stand_m",
      "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 52 AS INT) END AS marker_id"]


@query("validate_registry", f"""WITH mk AS (SELECT {', '.join(MK)} FROM lineitem), m AS (SELECT *, 'marker ' || CAST(marker_id AS VARCHAR) AS item FROM mk),
k AS (SELECT site_id, floor, upper(trim(kiosk_id)) AS kiosk_id, stand_m, marker_id, 'kiosk ' || upper(trim(kiosk_id)) AS item FROM (SELECT {', '.join(KI)} FROM orders) z),
b AS (SELECT site_id, floor, item FROM m UNION ALL SELECT site_id, floor, item FROM k),
v AS (SELECT site_id, floor, item, 'duplicate' AS rule FROM b GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT b.site_id, b.floor, b.item, 'other_floor' FROM b JOIN (SELECT site_id, item FROM b GROUP BY ALL HAVING count(DISTINCT floor) > 1) x USING (site_id, item)
UNION ALL SELECT site_id, floor, item, 'id_range' FROM m WHERE marker_id NOT BETWEEN 0 AND 49
UNION ALL SELECT site_id, floor, item, 'size_or_height' FROM m WHERE size_m NOT BETWEEN 5e-2 AND 1e0 OR height_m NOT BETWEEN 3e-1 AND 3e0
UNION ALL SELECT site_id, floor, item, 'id_pattern' FROM k WHERE NOT regexp_full_match(kiosk_id, '[A-Za-z0-9_-]{{1,32}}')
UNION ALL SELECT site_id, floor, item, 'stand_distance' FROM k WHERE stand_m NOT BETWEEN 2e-1 AND 3e0
UNION ALL SELECT site_id, floor, item, 'marker_not_here' FROM k WHERE marker_id IS NOT NULL AND (site_id, floor, marker_id) NOT IN (SELECT site_id, floor, marker_id FROM mk))
SELECT * FROM v""")
def _(t):
    return S.validate_registry(t.lineitem.selectExpr(*MK), t.orders.selectExpr(*KI))


@query("cross_floor_id_clash", f"""WITH mk AS (SELECT {', '.join(MK)} FROM lineitem) SELECT site_id, marker_id, count(DISTINCT floor) AS floors FROM mk GROUP BY 1, 2 HAVING count(DISTINCT floor) > 1""")
def _(t):
    return S.cross_floor_clashes(t.lineitem.selectExpr(*MK), "marker_id")


@query("registry_lookup", """SELECT o_orderkey, 'k' || CAST(o_orderkey % 2100 AS VARCHAR) || ' ' AS kiosk_id, floor, x, y FROM orders JOIN v_slots ON slot_id = o_orderkey % 2100""")
def _(t):
    asked = t.orders.selectExpr("o_orderkey", "'k' || CAST(o_orderkey % 2100 AS STRING) || ' ' AS kiosk_id")
    reg = t.v_slots.selectExpr("'K' || CAST(slot_id AS STRING) AS kiosk_id", "floor", "x", "y")
    return S.registry_lookup(asked, reg, "kiosk_id", True)


FLS = f"fl AS (SELECT p_partkey % 50 AS site_id, {LABEL} AS floor, p_partkey AS pos FROM part)"


@query("floors_bottom_up", rf"""WITH {FLS}, f AS (SELECT site_id, coalesce(nullif(trim(floor), ''), '1') AS floor, min(pos) AS pos FROM fl GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN regexp_matches(floor, '^(B|P|LB|SB|BASEMENT)\s*-?(\d+)$', 'i') THEN -CAST(regexp_extract(floor, '(\d+)$', 1) AS INT)
  WHEN upper(floor) IN ('G','GF','GR','GROUND','L','LOBBY','0','L0') THEN 0 WHEN regexp_matches(floor, '^(L|F|LEVEL|FLOOR)?\s*(\d+)$', 'i') THEN CAST(regexp_extract(floor, '(\d+)$', 1) AS INT) END AS lvl FROM f)
SELECT site_id, floor, pos, CAST(row_number() OVER (PARTITION BY site_id ORDER BY lvl IS NULL, lvl, pos) - 1 AS INT) AS rank FROM l""")
def _(t):
    return S.floors_bottom_up(t.part.selectExpr("p_partkey % 50 AS site_id", f"{LABEL} AS floor", "p_partkey AS pos"))


@query("adjacent_floors", """WITH f AS (SELECT s_suppkey AS site_id, lvl AS pos, 'F' || CAST(lvl AS VARCHAR) AS floor FROM supplier, v_levels WHERE lvl <= s_suppkey % 3)
SELECT site_id, floor, lag(floor) OVER w AS below, lead(floor) OVER w AS above FROM f WINDOW w AS (PARTITION BY site_id ORDER BY pos)""")
def _(t):
    f = t.supplier.selectExpr("s_suppkey AS site_id", "explode(sequence(0, CAST(s_suppkey % 3 AS INT))) AS pos").withColumn("floor", F.expr("'F' || CAST(pos AS STRING)"))
    return S.adjacent_floors(f)


@query("floors_present", "SELECT DISTINCT floor FROM v_landmarks")
def _(t):
    return S.floors_present(t.v_landmarks)


@query("map_only_floors", """WITH m AS (SELECT DISTINCT o_custkey % 100 AS site_id, CASE o_orderkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' WHEN 2 THEN '1' ELSE 'B9' END AS floor FROM orders)
SELECT site_id, floor FROM m WHERE (site_id, floor) NOT IN (SELECT site_id, floor FROM v_nodes)""")
def _(t):
    m = t.orders.selectExpr("o_custkey % 100 AS site_id", "CASE o_orderkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' WHEN 2 THEN '1' ELSE 'B9' END AS floor")
    return S.map_only_floors(m, t.v_nodes.select("site_id", "floor").distinct())


FIT = """mm AS (SELECT plan_id, count(*) AS n, avg(px) AS mpx, avg(py) AS mpy, avg(x) AS mx, avg(y) AS my FROM v_control GROUP BY 1),
s AS (SELECT plan_id, n, mpx, mpy, mx, my, sum((px-mpx)*(px-mpx)) AS uu, sum((px-mpx)*(py-mpy)) AS uv, sum((py-mpy)*(py-mpy)) AS vv, sum((px-mpx)*(x-mx)) AS ux,
  sum((py-mpy)*(x-mx)) AS vx, sum((px-mpx)*(y-my)) AS uy, sum((py-mpy)*(y-my)) AS vy FROM v_control JOIN mm USING (plan_id) WHERE n >= 3 GROUP BY ALL),
f0 AS (SELECT *, (ux*vv - vx*uv)/(uu*vv-uv*uv) AS a, (vx*uu - ux*uv)/(uu*vv-uv*uv) AS b, (uy*vv - vy*uv)/(uu*vv-uv*uv) AS c, (vy*uu - uy*uv)/(uu*vv-uv*uv) AS d FROM s),
fit AS (SELECT plan_id, n AS n_points, a, b, c, d, mx - a*mpx - b*mpy AS tx, my - c*mpx - d*mpy AS ty FROM f0)"""


@query("fit_affine", f"WITH {FIT} SELECT plan_id, n_points, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(tx, 6) AS tx, round(ty, 6) AS ty FROM fit")
def _(t):
    return rounded(S.fit_affine(t.v_control, ["plan_id"]))


@query("fit_quality", f"""WITH {FIT}, r AS (SELECT plan_id, n_points, a, b, c, d, sqrt((a*px+b*py+tx-x)*(a*px+b*py+tx-x) + (c*px+d*py+ty-y)*(c*px+d*py+ty-y)) AS e FROM v_control JOIN fit USING (plan_id))
SELECT plan_id, n_points, round(max(e), 6) AS max_residual, round(avg(e), 6) AS mean_residual, round(sqrt(a*a+c*c), 6) AS scale_x, round(sqrt(b*b+d*d), 6) AS scale_y,
  n_points = 3 AS warn_three_points, max(e) > 5e-1 AS warn_residual, sqrt(a*a+c*c) > 2 OR sqrt(a*a+c*c) < 1e-3 OR sqrt(b*b+d*d) > 2 OR sqrt(b*b+d*d) < 1e-3 AS warn_scale
FROM r GROUP BY plan_id, n_points, a, b, c, d""")
def _(t):
    return rounded(S.fit_quality(t.v_control, S.fit_affine(t.v_control, ["plan_id"]), ["plan_id"]))


@query("build_geometry_from_pixels", f"""WITH {FIT} SELECT l_orderkey, l_linenumber, plan_id, round_even(round(a * (l_orderkey % 1000) + b * (l_partkey % 800) + tx, 9), 3) AS x,
  round_even(round(c * (l_orderkey % 1000) + d * (l_partkey % 800) + ty, 9), 3) AS y FROM lineitem JOIN fit ON plan_id = l_suppkey""")
def _(t):
    px = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS plan_id", "CAST(l_orderkey % 1000 AS DOUBLE) AS px", "CAST(l_partkey % 800 AS DOUBLE) AS py")
    return S.build_geometry(px, S.fit_affine(t.v_control, ["plan_id"]), ["plan_id"])


@query("overlay_pixels", f"""WITH {FIT} SELECT l_orderkey, l_linenumber, plan_id, round((d * (l_quantity - tx) - b * (l_discount * 100 - ty)) / (a*d-b*c), 3) AS px,
  round((a * (l_discount * 100 - ty) - c * (l_quantity - tx)) / (a*d-b*c), 3) AS py FROM lineitem JOIN fit ON plan_id = l_suppkey""")
def _(t):
    w = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS plan_id", "l_quantity AS x", "l_discount * 100 AS y")
    return rounded(S.overlay_pixels(w, S.fit_affine(t.v_control, ["plan_id"]), ["plan_id"]).drop("x", "y"), 3)


TAG = ["event_id AS id", "'Tag #' || CAST(event_id AS STRING) AS label", "CAST(value AS DOUBLE) AS facility_x", "CAST(event_id % 50 AS DOUBLE) AS facility_y",
       "CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'B1' END AS floor", "1e0 AS x", "2e0 AS y", "3e0 AS z", "CAST(user_id AS INT) AS session_id"]


@query("union_tags_landmarks", f"""SELECT CAST(id AS VARCHAR) AS id, label, 'user_tag' AS type, facility_x, facility_y, coalesce(nullif(trim(floor), ''), '1') AS floor, x, y, z, session_id, NULL AS zone
FROM (SELECT {', '.join(TAG)} FROM events) t UNION ALL SELECT 'L' || CAST(c_custkey AS VARCHAR), 'Spot L' || CAST(c_custkey AS VARCHAR), 'facility_landmark', (c_custkey * 7 % 1000) / 1e1, (c_custkey * 11 % 1000) / 1e1,
  CASE c_custkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN '1' ELSE 'B1' END, (c_custkey * 7 % 1000) / 1e1, (c_custkey * 11 % 1000) / 1e1, 0e0, NULL, 'Z' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 10 <> 3""")
def _(t):
    return S.union_tags_landmarks(t.events.selectExpr(*TAG), locations(t))


@query("dedupe_tags", """SELECT floor(value) AS "timestamp", user_id % 10 AS facility_x, event_id % 3 AS facility_y, min(event_id) AS id FROM events GROUP BY 1, 2, 3""")
def _(t):
    tags = t.events.selectExpr("CAST(floor(value) AS DOUBLE) AS timestamp", "user_id % 10 AS facility_x", "event_id % 3 AS facility_y", "event_id AS id")
    return S.dedupe_tags(tags, "id")

"""Queries: corridor matching, walkway network, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corridors as C
from ..operators import network as N
from ..operators import routing as R
from ..session import cut, large
from .catalog import query, rounded
from .views import Tables

FK = ["site_id", "floor"]


def walk_pieces(t: Tables):
    return t.v_pieces.withColumn("seg_ord", F.col("seg_no") * 10 + F.col("piece_no"))


COST = """c0 AS (SELECT f.*, seg_no * 10 + piece_no AS ord, x1, y1, x2, y2, width / 2 AS h, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM v_fixes f JOIN v_pieces p USING (site_id, floor)),
c1 AS (SELECT *, (x-x1)*(x2-x1)/len + (y-y1)*(y2-y1)/len AS alo, (y-y1)*(x2-x1)/len - (x-x1)*(y2-y1)/len AS lat FROM c0),
c2 AS (SELECT *, alo - least(greatest(alo, 0e0), len) AS ov, lat - least(greatest(lat, -h), h) AS sd, mod(heading - degrees(atan2(x2-x1, y2-y1)) + 540, 360) - 180 AS dh FROM c1),
c3 AS (SELECT *, sqrt(ov*ov+lat*lat) AS dist, CASE WHEN sqrt(ov*ov+sd*sd) <= 1e-9 THEN 0e0 ELSE sqrt(ov*ov+sd*sd) END AS outs, least(abs(dh), 180 - abs(dh)) AS ax FROM c2)"""


@query("match_corridor", f"""WITH {COST}, c4 AS (SELECT *, outs + 5e-2 * dist + CASE WHEN ax > 50 THEN 6e-1 ELSE 0e0 END AS cost FROM c3),
b AS (SELECT *, row_number() OVER (PARTITION BY fix_id, site_id, floor, x, y ORDER BY round(cost, 9), ord) AS k FROM c4)
SELECT fix_id, site_id, round(round(cost, 9), 6) AS match_cost, round(CASE WHEN outs = 0 THEN x ELSE x1 + (alo-ov)*(x2-x1)/len - (y2-y1)/len*(lat-sd) END, 6) AS placed_x,
  round(CASE WHEN outs = 0 THEN y ELSE y1 + (alo-ov)*(y2-y1)/len + (x2-x1)/len*(lat-sd) END, 6) AS placed_y FROM b WHERE k = 1""")
def _(t):
    m = C.match_corridor(t.v_fixes, walk_pieces(t), FK)
    return rounded(m.select("fix_id", "site_id", "match_cost", "placed_x", "placed_y"))


@query("snap_to_walkable", f"""WITH {COST}, b AS (SELECT *, row_number() OVER (PARTITION BY fix_id, site_id, floor, x, y ORDER BY round(dist, 9), ord) AS k FROM c3)
SELECT fix_id, site_id, round(dist, 6) AS snap_dist, round(x1 + (alo-ov)*(x2-x1)/len, 6) AS snap_x, round(y1 + (alo-ov)*(y2-y1)/len, 6) AS snap_y FROM b WHERE k = 1""")
def _(t):
    m = C.snap_to_walkable(t.v_fixes, walk_pieces(t), FK)
    return rounded(m.select("fix_id", "site_id", "snap_dist", "snap_x", "snap_y"))


@query("sticky_corridor")
def _(t):
    # devices walk the building of the supplier with their number (the rest have no plan)
    pts = t.v_points.withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "site_id": F.col("device_id")})
    return rounded(C.sticky_corridor(pts, walk_pieces(t), ["site_id", "floor"], time="t"))


@query("split_at_junctions", "SELECT site_id, floor, seg_no, piece_no, x1, y1, x2, y2, width FROM v_pieces")
def _(t):
    s = N.split_at_junctions(t.v_corridors)
    return s.select("site_id", "floor", "seg_no", "piece_no", "x1", "y1", "x2", "y2", "width")


JITTER = "((seg_no * 7 + piece_no * 3 + {e} * 5 + {k}) % 21 - 10) / 1e2"


@query("snap_nodes", f"""WITH e AS (SELECT site_id, floor, seg_no, piece_no, 0 AS e, x1 + {JITTER.format(e=0, k=1)} AS x, y1 + {JITTER.format(e=0, k=4)} AS y, x1 AS gx, y1 AS gy FROM v_pieces
 UNION ALL SELECT site_id, floor, seg_no, piece_no, 1, x2 + {JITTER.format(e=1, k=1)}, y2 + {JITTER.format(e=1, k=4)}, x2, y2 FROM v_pieces)
SELECT site_id, floor, seg_no, piece_no, e AS "end", round(first_value(x) OVER w, 3) AS node_x, round(first_value(y) OVER w, 3) AS node_y FROM e
WINDOW w AS (PARTITION BY site_id, floor, gx, gy ORDER BY seg_no, piece_no, e)""")
def _(t):
    p = t.v_pieces
    for e in (1, 2):
        for c, k in (("x", 1), ("y", 4)):
            p = p.withColumn(f"{c}{e}", F.col(f"{c}{e}") + F.expr(JITTER.format(e=e - 1, k=k)))
    n = N.snap_nodes(N.piece_ends(p))
    return rounded(n.select("site_id", "floor", "seg_no", "piece_no", "end", "node_x", "node_y"), 3)


@query("build_edges", """SELECT DISTINCT site_id, floor, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS weight FROM v_pieces""")
def _(t):
    return rounded(N.build_edges(N.split_at_junctions(t.v_corridors)).withColumnRenamed("by", "by_"))


def doors(t: Tables, pieces):
    rank = F.col("lvl")
    return N.landing_splice(t.v_landings.withColumn("rank", rank), pieces)


@query("landing_splice", "SELECT site_id, connector_id, floor, x AS door_x, y AS door_y FROM v_landings")
def _(t):
    # doors stand a little beside the walkway corner
    l = t.v_landings.withColumns({"x": F.col("x") - 0.5 * F.when(F.col("node") == 0, 1).otherwise(-1)})
    return rounded(N.landing_splice(l, network(t.v_corridors)).select("site_id", "connector_id", "floor", "door_x", "door_y"))


@query("vertical_edges", """SELECT a.site_id, a.connector_id, a.floor AS a_floor, b.floor AS b_floor, 12e0 + (b.lvl - a.lvl - 1) AS weight
FROM v_landings a JOIN v_landings b ON a.site_id = b.site_id AND a.connector_id = b.connector_id AND a.lvl < b.lvl""")
def _(t):
    return N.vertical_edges(doors(t, network(t.v_corridors))).select("site_id", "connector_id", "a_floor", "b_floor", "weight")


def network(corridors):
    """Split pieces with their nodes, kept in the shared folder: all later steps read them."""
    pieces = cut(N.split_at_junctions(corridors))
    return R.resolved_pieces(pieces, N.snap_nodes(N.piece_ends(pieces)))


def building(t: Tables):
    """(resolved pieces, edges per graph) of every site."""
    resolved = network(t.v_corridors)
    d = doors(t, resolved)
    return resolved, R.network_edges(resolved, d, N.vertical_edges(d))


# closed form on the grid: Manhattan on a floor, else the better of the two lifts
HOPS = """abs(a.lvl - b.lvl)"""
DIST = f"""dd AS (SELECT a.site_id, a.lvl AS a_lvl, a.node AS a_node, b.lvl AS b_lvl, b.node AS b_node, a.floor AS a_floor, b.floor AS b_floor, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_,
  CASE WHEN a.lvl = b.lvl THEN abs(a.x-b.x)+abs(a.y-b.y) ELSE 11 + {HOPS} + least(a.x+a.y+b.x+b.y, 8 * pitch - a.x-a.y-b.x-b.y) END AS d
  FROM v_nodes a JOIN v_nodes b USING (site_id) JOIN v_sites s USING (site_id))"""


@query("all_pairs_distance", f"WITH {DIST} SELECT site_id, printf('%s/%.3f/%.3f', a_floor, ax, ay) AS source, printf('%s/%.3f/%.3f', b_floor, bx, by_) AS node, round(d, 6) AS dist FROM dd")
def _(t):
    _, edges = building(t)
    site = F.split("graph", "/")[0].cast("long").alias("site_id")
    whole = edges.where("graph like '%/*'").select(site, "src", "dst", "weight")
    d = N.shortest_distances(whole, whole.select("site_id", F.col("src").alias("source")))
    return rounded(d.drop("prev"))


def requests(t: Tables):
    """Node-to-node route requests with coordinates."""
    n = t.v_nodes
    side = lambda p: n.select("site_id", F.col("lvl").alias(f"{p}_lvl"), F.col("node").alias(f"{p}_node"), F.col("floor").alias(f"{p}_floor"),
                              F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    r = t.v_requests.join(large(side("start")), ["site_id", "start_lvl", "start_node"]).join(large(side("dest")), ["site_id", "dest_lvl", "dest_node"])
    return r.select("request_id", "site_id", "start_floor", "start_x", "start_y", "dest_floor", "dest_x", "dest_y")


@query("attach_point", """SELECT request_id, x AS at_x, y AS at_y FROM v_requests r JOIN v_nodes n ON n.site_id = r.site_id AND n.lvl = start_lvl AND n.node = start_node""")
def _(t):
    resolved = network(t.v_corridors)
    p = requests(t).select("request_id", "site_id", F.col("start_floor").alias("floor"), F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    return rounded(R.attach_point(p, resolved).select("request_id", "at_x", "at_y"))


ROUTE = f"WITH {DIST} SELECT request_id, r.site_id, round(d, 6) AS total_distance FROM v_requests r JOIN dd ON dd.site_id = r.site_id AND a_lvl = start_lvl AND a_node = start_node AND b_lvl = dest_lvl AND b_node = dest_node"


@query("route_requests", ROUTE)
def _(t):
    resolved, edges = building(t)
    routes, _ = R.route_requests(requests(t), resolved, edges)
    return rounded(routes.select("request_id", "site_id", "total_distance"))


def legs(t: Tables):
    resolved, edges = building(t)
    routes, dist = R.route_requests(requests(t), resolved, edges)
    kinds = t.spark.createDataFrame([("lift_a", "elevator"), ("lift_b", "elevator")], "connector_id string, type string")
    return R.route_legs(routes, R.route_paths(routes, dist), edges, kinds)


@query("route_legs", f"""WITH {DIST} SELECT request_id, CASE WHEN a_lvl = b_lvl THEN 1 ELSE 3 END AS legs, round(d, 6) AS distance, b_floor AS last_floor
FROM v_requests r JOIN dd ON dd.site_id = r.site_id AND a_lvl = start_lvl AND a_node = start_node AND b_lvl = dest_lvl AND b_node = dest_node""")
def _(t):
    g = legs(t).groupBy("request_id").agg(F.count("*").alias("legs"), F.sum("distance").alias("distance"), F.max_by("floor", "leg").alias("last_floor"))
    return rounded(g)


@query("unreachable_report", """SELECT request_id, r.site_id, CASE start_lvl WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS start_floor, CASE dest_lvl WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS dest_floor,
  CASE WHEN start_lvl = 2 THEN 0 ELSE 12 END AS start_pieces, CASE WHEN dest_lvl = 2 THEN 0 ELSE 12 END AS dest_pieces, 2 AS connectors FROM v_requests r WHERE start_lvl = 2 OR dest_lvl = 2""")
def _(t):
    # the top floor has no walkways here, so no route can start or end there
    resolved = network(t.v_corridors.where("lvl < 2"))
    d = cut(doors(t, resolved).where("door_x is not null and lvl < 2"))
    routes, _ = R.route_requests(requests(t), resolved, R.network_edges(resolved, d, N.vertical_edges(d)))
    return R.unreachable_report(routes, resolved, t.v_landings)

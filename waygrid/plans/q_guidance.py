"""Queries: guidance along routes. Every order is a route through its lines' points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guidance as G
from ..operators.routing import path_length
from .catalog import query, rounded

PTS = """w AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS i,
  CAST(l_partkey % 40 AS DOUBLE) AS x, CAST((l_partkey * 7) % 30 AS DOUBLE) AS y FROM lineitem),
pos AS (SELECT l_orderkey AS id, CAST(min(l_partkey * 3) % 40 AS DOUBLE) AS ux, CAST(max(l_partkey * 11) % 30 AS DOUBLE) AS uy, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS len FROM w a JOIN w b ON a.id = b.id AND b.i = a.i + 1),
c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM s)"""

PROJ = PTS + """, j AS (SELECT c.*, ux, uy, n, CASE WHEN len = 0 THEN 0e0 ELSE least(greatest(((ux-ax)*(bx-ax)+(uy-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)), 0e0), 1e0) END AS t FROM c JOIN pos USING (id)),
k AS (SELECT *, ax + t*(bx-ax) AS fx, ay + t*(by_-ay) AS fy, round(sqrt((ux-ax-t*(bx-ax))*(ux-ax-t*(bx-ax)) + (uy-ay-t*(by_-ay))*(uy-ay-t*(by_-ay))), 9) AS off FROM j),
tot AS (SELECT id, sum(len) AS total FROM s GROUP BY 1),
b AS (SELECT k.*, total, cum + t * len AS along, row_number() OVER (PARTITION BY id ORDER BY off, i) AS r FROM k JOIN tot USING (id)),
pr AS (SELECT * FROM b WHERE r = 1)"""


def paths(t):
    """id, waypoints, and one position (ux, uy) per order."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda q: F.struct(
        (q["l_partkey"] % 40).cast("double").alias("x"), ((q["l_partkey"] * 7) % 30).cast("double").alias("y")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        pts.alias("p"), (F.min(F.col("l_partkey") * 3) % 40).cast("double").alias("ux"), (F.max(F.col("l_partkey") * 11) % 30).cast("double").alias("uy"))


def long_paths(t):
    return paths(t).where(F.size("p") >= 2)


@query("path_length", f"WITH {PTS} SELECT pos.id, round(coalesce(sum(len), 0e0), 6) AS len FROM pos LEFT JOIN s USING (id) GROUP BY pos.id")
def _(t):
    return rounded(paths(t).select("id", path_length("p").alias("len")))


@query("route_cumulative", f"WITH {PTS} SELECT id, i + 1 AS i, round(cum + len, 6) AS s FROM c")
def _(t):
    c = paths(t).select("id", F.posexplode(G.cumulative("p")).alias("i", "s")).where("i > 0")
    return rounded(c)


@query("turn_instructions", f"""WITH {PTS}, kp AS (SELECT w.* FROM w LEFT JOIN s ON s.id = w.id AND s.i = w.i - 1 WHERE w.i = 0 OR len >= 1e-1),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k, lag(x) OVER z AS px, lag(y) OVER z AS py, lead(x) OVER z AS nx, lead(y) OVER z AS ny FROM kp WINDOW z AS (PARTITION BY id ORDER BY i)),
d AS (SELECT *, coalesce(sum(CASE WHEN px IS NULL THEN 0e0 ELSE sqrt((x-px)*(x-px)+(y-py)*(y-py)) END) OVER (PARTITION BY id ORDER BY i), 0e0) AS along FROM q),
a AS (SELECT *, degrees(atan2((x-px)*(ny-y)-(y-py)*(nx-x) + 0e0, (x-px)*(nx-x)+(y-py)*(ny-y))) AS ang FROM d WHERE px IS NOT NULL AND nx IS NOT NULL),
tn AS (SELECT id, along, CASE WHEN abs(ang) >= 150 THEN 'Turn around' WHEN ang > 0 THEN 'Turn left' ELSE 'Turn right' END AS label, false AS is_arrival FROM a WHERE abs(ang) >= 30),
e AS (SELECT id, max(along) AS along, count(*) AS n FROM d GROUP BY id)
SELECT id, round(along, 6) AS along, label, is_arrival FROM tn UNION ALL
SELECT id, round(along, 6), CASE WHEN n < 2 THEN 'At your destination' WHEN id IN (SELECT id FROM tn) THEN 'Arrive at your destination' ELSE 'Continue straight to your destination' END, true FROM e""")
def _(t):
    r = paths(t).select("id", F.explode(G.turn_instructions("p")).alias("r")).select("id", "r.along", "r.label", "r.is_arrival")
    return rounded(r)


@query("route_progress", f"WITH {PROJ} SELECT pos.id, round(along, 6) AS along, round(greatest(total - along, 0e0), 6) AS remaining, round(off, 6) AS off FROM pos LEFT JOIN pr ON pr.id = pos.id")
def _(t):
    return rounded(paths(t).select("id", G.route_progress("p", "ux", "uy").alias("g")).select("id", "g.along", "g.remaining", "g.off"))


PLACE = """h AS (SELECT c.*, d, row_number() OVER (PARTITION BY c.id ORDER BY i) AS r FROM c JOIN v ON v.id = c.id WHERE len >= 1e-6 AND (round(d, 9) <= round(cum + len, 9) OR i = last))
SELECT pos.id, round(ax + (bx-ax)*least(1e0, (d-cum)/len), 5) AS x, round(ay + (by_-ay)*least(1e0, (d-cum)/len), 5) AS y FROM pos LEFT JOIN h ON h.id = pos.id AND r = 1"""


@query("point_at", f"""WITH {PTS}, v AS (SELECT id, least(CAST(id % 60 AS DOUBLE), sum(len)) AS d, max(i) AS last FROM s GROUP BY id), {PLACE}""")
def _(t):
    p = paths(t).withColumn("s", F.least((F.col("id") % 60).cast("double"), path_length("p")))
    return rounded(p.select("id", G.point_at("p", "s").alias("q")).select("id", "q.x", "q.y"), 5)


@query("look_ahead", f"""WITH {PROJ}, v AS (SELECT pr.id, along + 6 AS d, last FROM pr JOIN (SELECT id, max(i) AS last FROM s GROUP BY id) USING (id)), {PLACE}""")
def _(t):
    return rounded(paths(t).select("id", G.look_ahead("p", "ux", "uy", 6.0).alias("q")).select("id", "q.x", "q.y"), 5)


@query("remaining_waypoints", f"""WITH {PROJ} SELECT id, 0 AS pos, round(fx, 6) + 0e0 AS x, round(fy, 6) + 0e0 AS y FROM pr
UNION ALL SELECT w.id, w.i - pr.i, w.x, w.y FROM w JOIN pr ON w.id = pr.id AND w.i > pr.i UNION ALL SELECT w.id, 0, x, y FROM w ANTI JOIN s ON s.id = w.id""")
def _(t):
    r = paths(t).select("id", F.posexplode(G.remaining_waypoints("p", "ux", "uy")).alias("pos", "q")).select("id", "pos", "q.x", "q.y")
    return rounded(r)


@query("clamp_to_dest", f"""WITH {PTS}, n AS (SELECT id, max(i) AS last FROM w GROUP BY id),
tip AS (SELECT w.id, last >= 2 AND sqrt((x-ux)*(x-ux)+(y-uy)*(y-uy)) < 3e-1 AS spur FROM w JOIN n ON n.id = w.id AND i = last JOIN pos ON pos.id = w.id),
w2 AS (SELECT w.*, ux, uy FROM w JOIN n ON n.id = w.id JOIN tip ON tip.id = w.id JOIN pos ON pos.id = w.id WHERE NOT (spur AND i = last)),
j2 AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.ux, a.uy, CASE WHEN a.x = b.x AND a.y = b.y THEN 0e0 ELSE least(greatest(((a.ux-a.x)*(b.x-a.x)+(a.uy-a.y)*(b.y-a.y))/((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)), 0e0), 1e0) END AS t FROM w2 a JOIN w2 b ON a.id = b.id AND b.i = a.i + 1),
k2 AS (SELECT *, ax + t*(bx-ax) AS fx, ay + t*(by_-ay) AS fy FROM j2), b2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sqrt((ux-fx)*(ux-fx)+(uy-fy)*(uy-fy)), 9), i) AS r FROM k2),
f AS (SELECT id, fx, fy, CASE WHEN sqrt((ax-fx)*(ax-fx)+(ay-fy)*(ay-fy)) > 5e-2 THEN i + 1 ELSE i END AS kept FROM b2 WHERE r = 1)
SELECT w2.id, i AS pos, x, y FROM w2 LEFT JOIN f ON f.id = w2.id WHERE f.id IS NULL OR kept = 0 OR i < kept UNION ALL SELECT id, kept, round(fx, 6) + 0e0, round(fy, 6) + 0e0 FROM f WHERE kept > 0""")
def _(t):
    r = paths(t).select("id", F.posexplode(G.clamp_to_dest("p", "ux", "uy")).alias("pos", "q")).select("id", "pos", "q.x", "q.y")
    return rounded(r)


@query("rejoin_waypoints")
def _(t):
    r = long_paths(t).select("id", F.posexplode(G.rejoin_waypoints("p", "ux", "uy")).alias("pos", "q")).select("id", "pos", "q.x", "q.y")
    return rounded(r)


@query("join_walkway", f"""WITH {PTS}, f AS (SELECT s.*, sqrt((ux-ax)*(ux-ax)+(uy-ay)*(uy-ay)) AS off, ux, uy FROM s JOIN pos USING (id) WHERE i = 0),
g AS (SELECT *, greatest(3e0, least(8e0, 2*off)) AS want FROM f),
h AS (SELECT *, CASE WHEN len <= want THEN bx ELSE ax + (bx-ax)*want/len END AS mx, CASE WHEN len <= want THEN by_ ELSE ay + (by_-ay)*want/len END AS my FROM g)
SELECT id, round(CASE WHEN off < 75e-2 THEN 0e0 ELSE sqrt((mx-ux)*(mx-ux)+(my-uy)*(my-uy)) - least(len, want) END, 6) AS added, round(CASE WHEN off < 75e-2 THEN bx ELSE mx END, 6) AS second_x FROM h""")
def _(t):
    j = long_paths(t).select("id", G.join_walkway("p", "ux", "uy").alias("j"))
    return rounded(j.select("id", "j.added", F.get("j.points", F.lit(1))["x"].alias("second_x")))


@query("lane_walkway")
def _(t):
    l = long_paths(t).select("id", G.lane_walkway("p", F.get("p", F.lit(0))["x"] + 1.0, F.get("p", F.lit(0))["y"] - 0.5).alias("l"))
    return rounded(l.select("id", "l.added", "l.mode", F.size("l.points").alias("n")))


@query("arrival_flag", f"""WITH {PROJ}, e AS (SELECT id, max(i) AS m FROM w GROUP BY id),
q AS (SELECT pr.id, ux, uy, round(greatest(total - along, 0e0), 9) AS rem, p.x AS px, p.y AS py, a.x AS ax2, a.y AS ay2, z.x AS zx, z.y AS zy FROM pr JOIN e USING (id)
  JOIN w z ON z.id = pr.id AND z.i = m LEFT JOIN w a ON a.id = pr.id AND a.i = m - 1 LEFT JOIN w p ON p.id = pr.id AND p.i = m - 2),
r AS (SELECT *, round(sqrt((ux-zx)*(ux-zx)+(uy-zy)*(uy-zy)), 9) AS slot, sqrt((zx-ax2)*(zx-ax2)+(zy-ay2)*(zy-ay2)) AS spur, sqrt((ax2-px)*(ax2-px)+(ay2-py)*(ay2-py)) AS inl FROM q),
u AS (SELECT *, coalesce(px IS NOT NULL AND spur > 5e-1 AND spur <= 8 AND inl > 5e-1, false) AS shaped, CASE WHEN inl > 0 THEN round(((ux-ax2)*(ax2-px)+(uy-ay2)*(ay2-py))/inl, 9) END AS u, rem <= 2 OR (slot <= 3 AND rem <= 8) AS plain FROM r)
SELECT id, CASE WHEN shaped AND slot <= spur + 35e-1 AND rem <= spur + 8 AND u >= -1 THEN true WHEN shaped AND NOT (u >= -1) THEN slot <= 3 AND u >= -3 ELSE plain END AS arrived FROM u""")
def _(t):
    g = long_paths(t).withColumn("rem", G.route_progress("p", "ux", "uy")["remaining"])
    return g.select("id", G.arrival_flag("p", "ux", "uy", "rem").alias("arrived"))


@query("landing_pose", f"""WITH {PTS}, f AS (SELECT b.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, row_number() OVER (PARTITION BY b.id ORDER BY b.i) AS r FROM w a JOIN w b ON a.id = b.id AND a.i = 0 AND b.i > 0
  WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) >= 5e-1)
SELECT id, ax AS x, ay AS y, round(mod(degrees(atan2(bx-ax, by_-ay)) + 360, 360), 6) AS heading FROM f WHERE r = 1""")
def _(t):
    l = long_paths(t).select("id", G.landing_pose("p").alias("l")).where("l is not null")
    return rounded(l.select("id", "l.*"))


@query("next_guidance")
def _(t):
    g = long_paths(t).withColumn("g", G.route_progress("p", "ux", "uy"))
    lift = F.when(F.col("id") % 3 == 0, F.lit("lift_a"))
    n = g.select("id", G.next_guidance("p", F.col("g.along"), lift, F.col("g.remaining"), F.lit("down")).alias("n"))
    return rounded(n.select("id", "n.*"))


@query("facing_override")
def _(t):
    g = long_paths(t).withColumns({"device": F.col("id") % 100, "heading": (F.col("id") * 53 % 360).cast("double")})
    g = g.select("device", "id", G.facing_relative("p", "ux", "uy", "heading").alias("rel"))
    return rounded(G.facing_override(g, "rel", ["device"], ["id"]))

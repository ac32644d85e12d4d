"""Exploded rows look as small to Spark as the rows they come from; they must not go through the driver."""

import pytest
from pyspark.sql import functions as F

from waygrid.operators import colour, network as N, routing
from waygrid.session import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sites(spark):
    return spark.range(50).select(F.col("id").alias("site_id"), F.lit("G").alias("floor"))


@pytest.fixture(scope="module")
def pieces(sites):
    p = sites.withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("piece_no", F.lit(0))
    return p.withColumns({"x1": F.lit(0.0), "y1": F.col("seg_no") * 5.0, "x2": F.lit(9.0), "y2": F.col("seg_no") * 5.0})


def test_pixels(spark):
    px = spark.range(20).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("px"))
    px = px.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("gray", (F.col("px") * 7 + F.col("py")).cast("int"))
    q = colour.image_quality(px)
    assert "Broadcast" not in plan(q) and q.count() == 20


def test_ends_and_nodes(pieces):
    ends = N.snap_nodes(N.piece_ends(pieces))
    assert "Broadcast" not in plan(ends) and ends.count() == 300
    resolved = routing.resolved_pieces(pieces, ends)
    nodes = N.registered_nodes(resolved)
    near = N.first_node(cut(pieces.select("site_id", "floor", "x1", "y1")), nodes, "x1", "y1")
    assert "Broadcast" not in plan(near) and near.where("node_x = x1").count() == 150


def test_junctions(pieces):
    assert "Broadcast" not in plan(N.split_at_junctions(pieces.drop("piece_no")))

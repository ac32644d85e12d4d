import os

import pytest
from pyspark.sql import functions as F

from waygrid.sources import files as S, snapshots


def test_csv_with_mark_and_spaces(spark, tmp_path):
    p = tmp_path / "loc.csv"
    p.write_bytes("﻿location_id, floor ,zone,x,y\n A1 ,,Z , 1.5,2\n".encode())
    r = S.read_locations(spark, str(p)).first()
    assert (r["location_id"], r["floor"], r["zone"], r["x"]) == ("A1", "1", "Z", 1.5)
    assert S.read_locations(spark, str(tmp_path / "none.csv")).count() == 0


def test_old_records_get_defaults(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"image_id":"a","floor":null,"zone":"z","x":1,"y":2,"orientation":3}\n\n{"image_id":"b","floor":" G "}\n')
    got = {r["image_id"]: (r["floor"], r["location_id"]) for r in S.read_reference_images(spark, str(p)).collect()}
    assert got == {"a": ("1", ""), "b": ("G", "")}


def test_site_yaml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("""
site_id: s1
floors:
  - floor: G
    walkable_segments: [{x1: 0, y1: 0, x2: 5, y2: 0, width: 4}]
    markers: [{marker_id: 3, x: 1, y: 2}, {marker_id: bad, x: 1, y: 2}]
    kiosks: [{kiosk_id: k1, x: 1, y: 2, facing_deg: 370}]
vertical_connectors:
  - {connector_id: c, type: elevator, nodes: {G: {x: 0, y: 0}, B1: {x: 0, y: 0}}}
  - {connector_id: lonely, nodes: {G: {x: 0, y: 0}}}
""")
    t = S.read_site_configs(spark, str(tmp_path / "*.yaml"))
    assert t["segments"].first()["width"] == 4.0
    assert [r["marker_id"] for r in t["markers"].collect()] == [3] and t["markers"].first()["height_m"] == 1.4
    assert (t["kiosks"].first()["kiosk_id"], t["kiosks"].first()["facing_deg"]) == ("K1", 10.0)
    assert [(r["connector_id"], r["penalty_cost"]) for r in t["connectors"].collect()] == [("c", 10.0)]


def test_live_log_shapes(spark, tmp_path):
    short = tmp_path / "a.csv"
    short.write_text("timestamp,floor,x,y,heading,confidence,tracking,latency_ms,trigger\n2024-01-01T00:00:00Z,G,1,2,3,0.5,TRUE,90,motion\n# note\n")
    r = S.read_live_log(spark, str(short)).collect()
    assert len(r) == 1 and r[0]["source"] == "VPR" and r[0]["tracking"] is True


def test_point_cloud_round_trip(spark, tmp_path):
    p = str(tmp_path / "cloud")
    S.write_point_cloud(spark.createDataFrame([(1.0, 2.0, 3.0), (float("inf"), 0.0, 0.0)], "x double, y double, z double"), p)
    rows = S.read_point_cloud(spark, p).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, 3.0, 52, 199, 89)]
    assert "element vertex 1" in open(os.path.join(p, "header.ply")).read()


def test_snapshot_pointer(spark, tmp_path):
    base = str(tmp_path / "map")
    spark.range(3).write.parquet(f"{base}/{snapshots.LEGACY}")
    assert snapshots.read_current(spark, base).count() == 3
    name = snapshots.publish_snapshot(spark.range(5), base, 10)
    assert snapshots.read_current(spark, base).count() == 5
    with pytest.raises(Exception):
        snapshots.publish_snapshot(spark.range(2).select(F.raise_error(F.lit("broken")).alias("id")), base, 11)
    assert snapshots.current_name(spark, base) == name
    snapshots.publish_snapshot(spark.range(7), base, 12)
    assert snapshots.read_current(spark, base).count() == 7 and not os.path.exists(f"{base}/{name}")
    for bad in ("../etc", "map_99"):
        with open(os.path.join(base, snapshots.POINTER), "w") as f:
            f.write(bad)
        crc = os.path.join(base, f".{snapshots.POINTER}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        assert snapshots.current_name(spark, base) == snapshots.LEGACY


def test_fingerprint_ignores_order(spark):
    a = spark.range(50).withColumn("v", F.array("id"))
    f = lambda d: S.dataset_fingerprint(d).first()[0]
    assert f(a) == f(a.repartition(7).orderBy(F.desc("id"))) != f(a.where("id > 0")) and len(f(a)) == 12

"""Machines over arrays: samples are dealt out once, and only what a detector finds is written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waygrid.operators import steps
from waygrid.operators.ordered import fold_arrays
from waygrid.session import scratch_dir

from .test_operators import motion

SAMPLE = "device_id long, event_id long, t double, ax double, ay double, az double, rot double"


def tables(spark):
    path = scratch_dir(spark)
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def rows_in(spark, names):
    return sum(spark.read.parquet(f"{scratch_dir(spark)}/{n}").count() for n in names)


@pytest.mark.parametrize("name", ["pdr_steps", "gait_steps"])
def test_samples_are_not_written(spark, name):
    rng = random.Random(4)
    rows = [r for d in range(1, 9) for r in motion(rng, 300, d)]
    before = tables(spark)
    found = getattr(steps, name)(spark.createDataFrame(rows, SAMPLE)).count()
    assert 0 < found < len(rows) / 2
    assert rows_in(spark, tables(spark) - before) < len(rows)


def test_one_device_in_many_partitions(spark):
    rows = motion(random.Random(12), 3000, 7)
    df = spark.createDataFrame(rows, SAMPLE)
    for name in ("pdr_steps", "gait_steps"):
        one, many = (sorted((r.t, r.step_no, round(r.stride_m, 9)) for r in getattr(steps, name)(df, p).collect()) for p in (1, 9))
        assert one == many and one


def test_missing_readings(spark):
    rows = [(*r[:3], *(None if i % 50 == 7 else c for c in r[3:6]), None) for i, r in enumerate(motion(random.Random(3), 600))]
    df = spark.createDataFrame(rows, SAMPLE)
    assert steps.pdr_steps(df).where("stride_m IS NULL OR isnan(stride_m)").count() == 0
    assert steps.pdr_steps(df).count() > 5 and steps.gait_steps(df).count() > 5


def total(state, cols):
    state["n"] += int(cols["v"].sum())
    return {"upto": cols["v"].cumsum() + state["n"] - cols["v"].sum()}


def test_state_that_never_forgets(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("k"), "id", F.lit(1).cast("long").alias("v"))
    df = df.unionByName(df.where("k = 0").withColumn("k", F.lit(None).cast("long")))
    got = fold_arrays(df, ["k"], ["id"], total, "upto long", lambda: {"n": 0}, parts=7)
    assert sorted((str(r.k), r.upto) for r in got.collect()) == sorted(
        (str(k), i + 1) for k, n in ((0, 134), (1, 133), (2, 133), (None, 134)) for i in range(n))
    whole = fold_arrays(df, [], ["id", "k"], total, "upto long", lambda: {"n": 0}, parts=5)
    assert [r.upto for r in whole.orderBy("upto").collect()] == list(range(1, 535))
    assert fold_arrays(df.limit(0), ["k"], ["id"], total, "upto long", lambda: {"n": 0}).count() == 0

"""Looking ahead costs as much as looking back, however many rows a key has."""

from pyspark.sql import functions as F

from waygrid.operators.ordered import scan


def test_next_values_without_a_frame_to_the_end(spark):
    n = 400
    d = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 10 == 4, None).otherwise(F.col("id")).alias("v"))
    for parts in (None, 5):
        out = scan(d, ["k"], ["t"], nexts={"nx": (F.col("v"), F.col("t") % 10 > 3)}, parts=parts)
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedfollowing" not in plan
        got = {r["t"]: r["nx"] for r in out.collect()}
        for t in range(n):
            ahead = next((u for u in range(t, n, 2) if u % 10 > 3), None)
            assert got[t] == (None if ahead is None or ahead % 10 == 4 else ahead)

"""Joins with tables that are too large to broadcast."""

from pyspark.sql import functions as F

from epochwise.operators.attach import attach


def test_a_salted_table_is_never_broadcast(spark):
    """The planner doesn't see that salts multiply a table, so its size doesn't count."""
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how, count in (("inner", 800), ("left", 1000), ("left_semi", 800), ("left_anti", 200)):
        joined = attach(rows, table, ["k"], how, most=10)
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        physical = joined._jdf.queryExecution().sparkPlan().toString()
        assert "Broadcast" not in physical, plan
        assert joined.count() == count
    got = attach(rows, table, ["k"], most=10)
    assert got.filter("v <> 2 * k").count() == 0 and got.select("id").distinct().count() == 800

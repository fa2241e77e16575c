"""Bucketed ranks, sums and quantiles equal the plain forms, also with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epochwise.operators import compare, drift, evaluate, folds, ordering, prep, profile
from epochwise.operators.attach import attach


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of 4,000 rows share one key, a third of all values are equal."""
    rng = np.random.RandomState(3)
    n = 4000
    key = np.where(np.arange(n) % 2 == 0, "hot", [f"k{i % 7}" for i in range(n)])
    value = np.where(np.arange(n) % 3 == 0, 5.0, rng.lognormal(1.0, 2.0, n))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "key": key, "value": value, "ts": rng.randint(0, 500, n)}))


def test_rank_equals_window(skewed):
    got = ordering.exact_rank(skewed, ["key"], [F.col("ts"), F.col("id")], F.floor(F.col("ts") / 10), total="n")
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = skewed.withColumn("want", F.row_number().over(w)).withColumn("m", F.count("id").over(Window.partitionBy("key")))
    both = got.join(want.select("id", "want", "m"), "id")
    assert both.count() == skewed.count()
    assert both.filter("rn <> want OR n <> m").count() == 0


def test_limit_keeps_exactly_the_first(skewed):
    got = ordering.hash_rank(skewed, ["key"], "id", limit=F.lit(37))
    w = Window.partitionBy("key").orderBy(ordering.hash_key("id"), "id")
    want = skewed.withColumn("w", F.row_number().over(w)).filter("w <= 37")
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()}


def test_running_sum(skewed):
    got = ordering.running(skewed, ["key"], F.floor(F.col("ts") / 50), [F.col("ts"), F.col("id")], {"v": F.col("ts")})
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("want", F.sum("ts").over(w))
    assert got.join(want.select("id", "want"), "id").filter("cum_v <> want").count() == 0


@pytest.mark.parametrize("small", [0, 20000])
def test_quantiles_equal_numpy(skewed, small):
    qs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {(r.key, r.q): r.x for r in ordering.quantiles(skewed, ["key"], "value", qs, accuracy=200, small=small).collect()}
    pdf = skewed.toPandas()
    for key, part in pdf.groupby("key"):
        for q in qs:
            assert got[key, q] == pytest.approx(np.percentile(part.value, 100 * q), rel=1e-12)


def test_quantiles_global(skewed):
    row = ordering.quantiles(skewed, [], "value", [0.3]).first()
    assert row.x == pytest.approx(np.percentile(skewed.toPandas().value, 30))


def test_no_task_holds_a_whole_key(skewed):
    """The ranking window is partitioned by key and bucket."""
    got = ordering.exact_rank(skewed, ["key"], [F.col("ts"), F.col("id")], F.floor(F.col("ts") / 10))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(key" in plan and "_bucket" in plan.split("row_number() windowspecdefinition(")[1][:60]


@pytest.mark.parametrize("most", [100, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_equals_join(skewed, most, how):
    table = skewed.groupBy("key").agg(F.max("value").alias("top")).filter("key <> 'k3'")
    got, want = attach(skewed, table, ["key"], how, most=most), skewed.join(table, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_few_wide_keys_never_partition_the_rows(spark, skewed):
    """No sort-merge join on feature, subject or channel, even where statistics say nothing fits."""
    rows = skewed.select("id", F.col("key").alias("subject"), (F.col("id") % 2).cast("int").alias("y"), "value", F.col("ts").cast("double").alias("ts"))
    name = F.concat(F.lit("f"), F.col("id") % 3)
    long = rows.select("y", name.alias("feature"), "value")
    both = rows.withColumn("win", F.when(F.col("id") < 2000, "ref").otherwise("cur")).withColumn("feature", name)
    samples = rows.select("subject", F.concat(F.lit("r"), F.col("id") % 2).alias("recording"), name.alias("channel"), "value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        plans = {
            "histogram": profile.histogram(long, 5),
            "mutual_info": profile.mutual_info_binned(rows, ["value", "ts"]),
            "psi_counts": drift.psi_counts(both, drift.psi_edges(both, ["feature"]), ["feature"]),
            "windows": drift.split_windows(rows),
            "logo": folds.leave_one_group_out(rows),
            "scale": folds.scale_held_out(rows, "subject", ["value", "ts"]),
            "dead": prep.drop_dead_channels(samples),
            "usable": prep.with_positives(rows),
            "zscore": prep.tensor_zscore(rows, "value", keys=["subject"]),
        }
        for name, df in plans.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, name
            assert "BroadcastHashJoin" in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowded_scores(spark):
    """Nine of ten scores below 1e-4: the area is exact and no bucket holds more than a few per cent."""
    rng = np.random.RandomState(8)
    n = 6000
    p = np.where(rng.rand(n) < 0.9, rng.rand(n) * 1e-4, rng.rand(n))
    y = (rng.rand(n) < 0.2 + 0.5 * (p > 0.5)).astype(int)
    scored = spark.createDataFrame(pd.DataFrame({"model": "m", "protocol": "q", "subject": "s", "y": y, "p": p})).withColumn("y", F.col("y").cast("int"))
    order = np.argsort(p)
    rank = np.empty(n)
    rank[order] = np.arange(1, n + 1)
    want = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (n - y.sum()))
    assert evaluate.roc_auc(scored).first().auc == pytest.approx(want, rel=1e-9)
    sizes = ordering.with_level(scored, "p", "b").groupBy("b").count().agg(F.max("count")).first()[0]
    assert sizes < n / 100


def test_buckets_of_names_with_one_stem(spark):
    names = spark.range(5000).select(F.format_string("subject-%05d", "id").alias("s"), "id")
    sized = names.withColumn("b", ordering.sketch_bucket(names, "s"))
    assert sized.groupBy("b").count().agg(F.max("count")).first()[0] < 200
    got = ordering.exact_rank(names, [], [F.col("s")], ordering.sketch_bucket(names, "s"))
    assert got.filter("rn <> id + 1").count() == 0


def test_signed_rank_methods(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(1, 9)] + [("b", 1.0), ("b", 1.0), ("b", -2.0)], "k string, d double")
    got = {r.k: r for r in compare.wilcoxon(d, ["k"]).collect()}
    assert (got["a"].p_method, got["b"].p_method) == ("exact", "normal")
    exact = {r.k: r for r in compare.wilcoxon(d, ["k"], method="exact").collect()}
    assert exact["a"].p == pytest.approx(2 / 2**8) and exact["b"].p is None
    assert compare.wilcoxon(d, ["k"], method="normal").filter("p_method <> 'normal'").count() == 0

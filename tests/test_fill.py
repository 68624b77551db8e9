"""Missing predictions: filled inside parts of a group."""

import math

from pyspark.sql import functions as F

from layerframe.operators import regress as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_keeps_all_rows(spark):
    data = [(g, float(i), None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i)) for g in ("a", "b", None) for i in range(60)] + [("full", 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, y double, pred double")
    got = R.fill_nan_predictions(df, ["g"]).collect()
    want = [(g, y, 29.5 if p is None or math.isnan(p) else p) for g, y, p in data]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = R.fill_nan_predictions(df.filter("g = 'a'"), []).collect()
    assert sorted(r.pred for r in whole if int(r.y) % 3 < 2) == [29.5] * 40 and len(whole) == 60


def test_groups_are_not_single_tasks(spark):
    """Two groups whose predictions are all missing: the rows spread over the parts of each group."""
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("y"), F.lit(None).cast("double").alias("pred"))
    assert "_p" in plan(R.fill_nan_predictions(df.repartition(8), ["g"]))


def test_evaluation_moves_no_complete_rows(spark):
    """Rows that have a prediction are aggregated where they are: they meet no join."""
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "test").otherwise("train").alias("dataset"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("pred"))
    long = R.evaluation_long(R.evaluate(df.repartition(4), ["dataset"]), 5, 0)
    assert "Union" in plan(R.fill_nan_predictions(df, ["dataset"])) and long.count() == 13

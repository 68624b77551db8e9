"""Ranks by bit patterns: quantiles and trimmed means of groups with outliers, ties and values of any size."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe import iterate as I
from layerframe.functions.numeric import order_key
from layerframe.operators import points as P

SPECIAL = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-300, 1.0, math.nextafter(1, 2), math.nextafter(1, 0), 2.0, math.nextafter(2, 0), 8.0, math.nextafter(8, 0),
           1e22, 1e300, 1.7976931348623157e308, math.inf, -math.inf, -1.0, -1e300, 0.1, 1 / 3, 1000.0, math.nextafter(1000, 0)]


def test_key_is_the_bit_pattern(spark):
    rng = np.random.default_rng(1)
    values = SPECIAL + [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1060, 1024)]
    values += np.frombuffer(rng.bytes(8 * 3000), "<f8").tolist()
    values = [v for v in values if v == v]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("k", order_key(F.col("v"))).orderBy("i").select("k").collect()]
    want = [(-1 if v < 0 else 1) * struct.unpack("<q", struct.pack("<d", abs(v)))[0] for v in values]
    assert got == want
    assert spark.range(1).select(order_key(F.lit(math.nan))).first()[0] > max(want)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(2)
    data = {
        "outlier": np.r_[rng.normal(0, 1, 400), 1e300, -1e300],
        "ties": np.r_[np.full(300, 2.5), rng.integers(0, 5, 200)],
        "tiny": rng.uniform(0, 1, 100) * 1e-310,
        "wide": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500),
        "one": np.array([7.0]), "two": np.array([1.0, 4.0]),
        None: rng.normal(5, 2, 50),  # a null key is a group
    }
    rows = [(k, float(v)) for k, a in data.items() for v in a] + [("outlier", None), ("nothing", None)]
    return data, I.cut(spark.createDataFrame(rows, "g string, v double"))


@pytest.mark.parametrize("ranked", [1, 20, 1 << 16])
def test_quantiles_and_trimmed_means(groups, monkeypatch, ranked):
    """With few rows to rank, bins are split down to single values."""
    monkeypatch.setattr(I, "RANKED", ranked)
    data, df = groups
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r)[1:] for r in I.grouped_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(data)
    for k, a in data.items():
        assert np.allclose(got[k], np.quantile(a, probs), rtol=1e-12, atol=0), k
    means = {r.g: (r.n, r.score) for r in P.trimmed_mean(df, ["g"], "v", 0.3, 5).collect()}
    for k, a in data.items():
        keep = min(len(a), max(5, math.floor(len(a) * 0.7)))
        # a sum over numbers of very different size has the error of its largest part
        assert means[k][0] == len(a) and math.isclose(means[k][1], math.fsum(np.sort(a)[:keep]) / keep, rel_tol=1e-9), k


def test_outlier_takes_no_bins_from_the_others(groups):
    """The group with 1e300 in it is split as finely as without."""
    _, df = groups
    bins, rows = I.ranked_bins(df.filter("g = 'outlier'"), ["g"], "v", lambda n: [F.floor(n / 2)])
    assert bins.count() == 1 and rows.count() < 40


def test_without_keys_and_without_rows(groups):
    data, df = groups
    every = np.concatenate(list(data.values()))
    assert np.allclose(I.grouped_quantiles(df, [], "v", [0.5]).first().q0, np.quantile(every, 0.5), rtol=1e-12)
    assert I.grouped_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and P.trimmed_mean(df.limit(0), ["g"], "v", 0.1, 1).count() == 0

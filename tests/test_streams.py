"""Streams replayed from files."""

import datetime as dt

from pyspark.sql import functions as F

from layerframe.plans.queries_logs import _drain
from layerframe.streaming import streams as ST

SCHEMA = "ts timestamp, key string, value double"


def test_late_rows_are_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(src)
        s = ST.running_means(spark.readStream.schema(SCHEMA).json(src))
        s.writeStream.outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()

    feed([(at(1), "k", 1.0), (at(2), "k", 3.0), (at(60), "k", 5.0)])
    feed([(at(3), "k", 100.0), (at(120), "k", 7.0)])  # the first one is an hour late
    got = {r.window.start: (r.value, r.n) for r in spark.read.parquet(out).collect()}
    assert got[t0] == (2.0, 2) and got[at(60)] == (5.0, 1)


def test_early_stopping_with_delta(spark, tmp_path):
    scores = [0.1, 0.5, 0.505, 0.506, 0.507, 0.9]
    spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "run long, epoch long, score double").coalesce(1).write.json(str(tmp_path / "in"))
    s = ST.early_stopping(spark.readStream.schema("run long, epoch long, score double").json(str(tmp_path / "in")), patience=3, min_delta=0.01)
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    out = _drain(s, "append", conf).orderBy("epoch").collect()
    assert [r.counter for r in out] == [0, 0, 1, 2, 3, 0] and [r.stopped for r in out] == [False] * 4 + [True, True]
    assert out[-1].best == 0.9 and spark.range(1).select(F.lit(1)).count() == 1

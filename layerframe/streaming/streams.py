"""Structured Streaming: ingestion, running log means, bounded draws, early stopping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.augment import draw_table


def ingest_once(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """Every file or manifest row once; with a time column the remembered keys expire after ``delay``.

    Without one they are kept for ever; :func:`ingest_remembered` forgets them by the clock.
    """
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def read_manifest_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def running_means(stream: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean per key and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "key").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def draws_per_batch(keys: list[str], per_source: int, seed: int, sink: Callable[[DataFrame, int], None], config: dict | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: each new source of a micro-batch gets ``per_source`` parameter draws."""
    def run(batch: DataFrame, batch_id: int) -> None:
        sink(draw_table(batch.dropDuplicates(keys), keys, per_source, seed, config), batch_id)

    return run


class Quota(StatefulProcessor):
    """Numbers the rows of a key up to its quota; the count is forgotten ``ttl_ms`` after it last changed."""

    def __init__(self, per_batch: int, cap: int, ttl_ms: int):
        self.per_batch, self.cap, self.ttl_ms = per_batch, cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", T.StructType([T.StructField("n", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        had = self.taken.get()[0] if self.taken.exists() else 0
        new = min(self.per_batch, self.cap - had)
        if new > 0:
            self.taken.update((had + new,))
            yield pd.DataFrame({"source": [key[0]] * new, "draw": range(had, had + new)})

    def close(self) -> None:
        pass


def quota_draws(stream: DataFrame, source: str, per_batch: int, cap: int, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """``source, draw``: every micro-batch a source appears in gives it ``per_batch`` more draws, ``cap`` in all.

    The count per source is state with a time to live: it holds across batches and restarts, and a source that got no draw for ``ttl_ms`` is
    forgotten, so the state is bounded by the sources of that time. Needs the RocksDB state store; a stream that runs until everything
    available is read also needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off, or it never ends.
    """
    kind = stream.schema[source].dataType.simpleString()
    named = stream.select(F.col(source).alias("source")).filter("source is not null")
    return named.groupBy("source").transformWithStateInPandas(statefulProcessor=Quota(per_batch, cap, ttl_ms), outputStructType=f"source {kind}, draw bigint", outputMode="Append", timeMode="ProcessingTime")


def ingest_remembered(stream: DataFrame, key: str, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """Every value of ``key`` once, for streams without a time column: remembered for ``ttl_ms`` and then forgotten."""
    return quota_draws(stream, key, 1, 1, ttl_ms).select(F.col("source").alias(key))


class EarlyStop(StatefulProcessor):
    """Best score, counter and stop flag per run; one output row per evaluated epoch."""

    def __init__(self, patience: int, mode: str = "max", min_delta: float = 0.0):
        self.patience, self.sign, self.min_delta = patience, 1.0 if mode == "max" else -1.0, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("counter", T.IntegerType()), T.StructField("stopped", T.BooleanType())])
        self.state = handle.getValueState("early_stop", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, counter, stopped = self.state.get() if self.state.exists() else (None, 0, False)
        out = []
        for pdf in rows:
            for epoch, score in pdf.sort_values("epoch")[["epoch", "score"]].itertuples(index=False):
                s = self.sign * float(score)
                if best is None or s > best + self.min_delta:
                    best, counter = s, 0
                else:
                    counter += 1
                stopped = stopped or counter >= self.patience
                out.append((key[0], int(epoch), self.sign * best, counter, stopped))
        self.state.update((best, counter, stopped))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "counter", "stopped"])

    def close(self) -> None:
        pass


def early_stopping(stream: DataFrame, patience: int = 20, mode: str = "max", min_delta: float = 0.0) -> DataFrame:
    """Early-stopping state of every run in a stream of (run, epoch, score)."""
    return stream.groupBy("run").transformWithStateInPandas(
        statefulProcessor=EarlyStop(patience, mode, min_delta), outputStructType="run long, epoch long, best double, counter int, stopped boolean", outputMode="Append", timeMode="None")

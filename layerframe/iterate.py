"""Engine for the few operators that need rounds, and for global order without one big task.

Everything here is DataFrame joins and aggregates. Between rounds the state is a table in
the shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.numeric import order_key


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; a private one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: no lineage, true sizes.

    A stored table also drops the constraints and expressions of the old plan, which otherwise pile up
    from round to round in the optimizer.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/layerframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_stable(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame], bool],
                 max_rounds: int = 200) -> DataFrame:
    """Apply ``step`` until ``done(state)``; fails loudly rather than return a half-done state."""
    state = cut(state)
    for i in range(max_rounds):
        if done(state):
            return state
        state = cut(step(state, i))
    if done(state):
        return state
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def first_independent_set(nodes: DataFrame, conflicts: DataFrame, key: list[str], rank: str, max_rounds: int = 500) -> DataFrame:
    """The set a serial loop would keep: visit by ``rank``, keep a node unless a kept one conflicts with it.

    ``nodes``: key columns (the group first), node id ``node`` and a unique ``rank`` per group.
    ``conflicts``: pairs ``key…, a, b``, in either direction or both. Per round a node is kept when no undecided
    neighbour ranks before it; neighbours of kept nodes drop out. Conflict lists are only joined and
    aggregated, never collected.
    """
    rk = nodes.select(*key, "node", rank)
    ca = rk.withColumnsRenamed({"node": "a", rank: "ra"})
    cb = rk.withColumnsRenamed({"node": "b", rank: "rb"})
    # direct every pair from the earlier to the later node
    ordered = F.col("ra") < F.col("rb")
    edges = cut(
        conflicts.select(*key, "a", "b").distinct().join(ca, key + ["a"]).join(cb, key + ["b"])
        .select(*key, F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("b")).filter("a <> b").distinct()
    )
    state = nodes.withColumn("status", F.lit(0))  # 0 undecided, 1 kept, 2 dropped

    def step(s: DataFrame, _: int) -> DataFrame:
        und = s.filter("status = 0").select(*key, "node")
        live = (
            edges.join(und.withColumnRenamed("node", "a"), key + ["a"], "left_semi")
            .join(und.withColumnRenamed("node", "b"), key + ["b"], "left_semi")
        )
        blocked = live.select(*key, F.col("b").alias("node")).distinct()
        kept = und.join(blocked, key + ["node"], "left_anti").withColumn("hit", F.lit(1))
        dropped = (
            live.join(kept.drop("hit").withColumnRenamed("node", "a"), key + ["a"], "left_semi")
            .select(*key, F.col("b").alias("node")).distinct().withColumn("hit", F.lit(2))
        )
        return (
            s.join(kept.unionByName(dropped), key + ["node"], "left")
            .withColumn("status", F.coalesce("hit", "status")).drop("hit")
        )

    out = until_stable(state, step, lambda s: s.filter("status = 0").isEmpty(), max_rounds)
    return out.filter("status = 1").drop("status")


def connected_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Least reachable node per node: ``nodes(node)``, ``edges(a, b)`` -> ``(node, label)``.

    Alternating large-star / small-star rewriting (Kiveris et al., SoCC 2014): the number of rounds
    grows with the logarithm of the component size and the edge table never grows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(least, "a")
        if large:
            return j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        own = least.select("a", F.col("m").alias("b"))
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a <> b").distinct()

    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        e = cut(star(star(e, True), False))
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    lab = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return nodes.select("node").join(lab, "node", "left").withColumn("label", F.coalesce("label", "node"))


def global_order(df: DataFrame, order: list[Column | str], out: str = "rn") -> DataFrame:
    """0-based global row number by ``order`` without a one-task window.

    Rows are range-partitioned once and stored with their partition number; offsets are a running
    sum over one row per partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    stored = cut(ranged)
    counts = stored.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*order)
    return (
        stored.withColumn("_i", F.row_number().over(w) - 1).join(offsets, "_pid")
        .withColumn(out, F.col("_i") + F.col("_off")).drop("_pid", "_i", "_off")
    )


def hash_order(df: DataFrame, key: list[str], seed: int = 0, out: str = "rn", bits: int = 12) -> DataFrame:
    """0-based global row number in the order of a hash of ``key``: a reproducible shuffle.

    The top bits of the hash split the order into even buckets, so no task sees more than its share
    and no pass has to be stored.
    """
    h = F.xxhash64(F.lit(seed), *key)
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 64 - bits))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_b").orderBy("_h", *key)
    return (
        d.withColumn("_i", F.row_number().over(w) - 1).join(offsets, "_b")
        .withColumn(out, F.col("_i") + F.col("_off")).drop("_h", "_b", "_i", "_off")
    )


#: Rows of a histogram bin that are ranked as they are; fuller bins are split by the next bits. Bits of a level.
RANKED, LEVEL = 1 << 16, 16


def _alike(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[c])
    return on


def ranked_bins(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> tuple[DataFrame, DataFrame]:
    """(bins, rows): where the wanted 0-based ranks of each group lie, and the distinct values of those bins.

    ``ranks`` gives the wanted ranks from the group's number of values. Bins are prefixes of the order-preserving
    bit pattern, so their width follows the values and an outlier takes nothing from the others: one partial
    aggregate counts the first bits, and only bins that hold a wanted rank and more than `RANKED` rows are split
    by the next bits, down to single values if need be. ``bins``: keys…, _b, _before, _below (count and sum of the
    values before the bin), _n; ``rows``: the same and _v, _c (value and count), _start (rank of the first one).
    Null values are left out.
    """
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull()).select(*keys, v.alias("_v"), order_key(v).alias("_k"))

    def hits(counted: DataFrame, parent: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, *parent).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        h = counted.withColumns({"_before": F.col("_base") + F.coalesce(F.sum("_c").over(w), F.lit(0)), "_below": F.col("_under") + F.coalesce(F.sum("_s").over(w), F.lit(0.0))})
        wanted = F.lit(False)
        for r in ranks(F.col("_n")):
            wanted = wanted | ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")))
        return cut(h.filter(wanted).select(*keys, "_b", "_before", "_below", "_c", "_n"))

    shift = 64 - LEVEL
    first = d.groupBy(*keys, F.shiftright("_k", shift).alias("_b")).agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    first = first.withColumns({"_n": F.sum("_c").over(Window.partitionBy(*keys)), "_base": F.lit(0), "_under": F.lit(0.0)})
    found = hits(first, [])
    while shift and (found.agg(F.max("_c")).first()[0] or 0) > RANKED:
        outer = found.withColumnsRenamed({"_b": "_p", "_before": "_base", "_below": "_under"}).drop("_c")
        inner = d.join(outer, _alike(d, outer, keys) & (F.shiftright(d["_k"], shift) == outer["_p"])).select(*[d[c] for c in keys], "_p", "_base", "_under", "_n", "_v", "_k")
        shift -= LEVEL
        found = hits(inner.groupBy(*keys, "_p", "_base", "_under", "_n", F.shiftright("_k", shift).alias("_b")).agg(F.count("*").alias("_c"), F.sum("_v").alias("_s")), ["_p"])
    bins = found.drop("_c")
    rows = d.join(bins, _alike(d, bins, keys) & (F.shiftright(d["_k"], shift) == bins["_b"])).select(*[d[c] for c in keys], "_b", "_before", "_below", "_n", "_v")
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return bins, rows.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns ``keys…, q0, q1, …``; null values are left out.

    Only values of the bins that hold the wanted ranks are ranked (see `ranked_bins`), with their
    multiplicity, so a group of any size and any spread is never gathered in one task.
    """

    def places(n: Column) -> list[Column]:
        return [F.lit(float(p)) * (n - 1) for p in probs]

    _, rows = ranked_bins(df, keys, value, lambda n: [f(p) for p in places(n) for f in (F.floor, F.ceil)])

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_start") <= r) & (r < F.col("_start") + F.col("_c")), F.col("_v")))

    pos = places(F.col("_n"))
    aggs = []
    for i, p in enumerate(pos):
        aggs += [at(F.floor(p)).alias(f"_f{i}"), at(F.ceil(p)).alias(f"_g{i}")]
    res = rows.groupBy(*keys, "_n").agg(*aggs)
    out = []
    for i, p in enumerate(pos):
        lo, hi = F.col(f"_f{i}"), F.col(f"_g{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (p - F.floor(p))).alias(f"q{i}"))
    return res.select(*keys, *out)

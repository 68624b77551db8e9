"""Sources, logs and streams that must not depend on one task, one batch or one schema."""

import pytest
from pyspark.sql import functions as F

from layerframe.operators import regress as R
from layerframe.operators import superpose as S
from layerframe.plans.queries_logs import ROCKS, _drain
from layerframe.sources import configs as CF
from layerframe.sources import files as FS
from layerframe.sources import tables as TB
from layerframe.streaming import streams as ST


def test_one_xyz_file_is_many_ranges(spark, tmp_path):
    n = 5000
    body = "\n".join(f"Re {i}.0 {i % 7}.5 -1.0" for i in range(n))
    (tmp_path / "big.xyz").write_text(f'{n}\nLattice="1 0 0 0 2 0 0 0 3" pbc="T T F"\n{body}\n\n')
    (tmp_path / "small.xyz").write_text('1\nLattice="1 0 0 0 2 0 0 0 3"\nS 9.0 8.0 7.0')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        atoms, cells = FS.read_xyz(spark, str(tmp_path))
        assert atoms.rdd.getNumPartitions() > 1
        rows = [(r.atom_id, r.x) for r in atoms.filter("structure = 'big'").orderBy("atom_id").collect()]
        assert rows == [(i, float(i)) for i in range(n)]
        assert [(r.atom_id, r.symbol, r.z) for r in atoms.filter("structure = 'small'").collect()] == [(0, "S", 7.0)]
        assert {(r.structure, r.n, r.lattice[4], r.pbc) for r in cells.collect()} == {("big", n, 2.0, "T T F"), ("small", 1, 2.0, "")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_log_grows_a_column_in_the_third_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    for rows, schema in (([(1, 0.5)], "step long, loss double"), ([(2, 0.4)], "step long, loss double"), ([(3, 0.3, 7.0)], "step long, loss double, grad double")):
        TB.append_log(spark.createDataFrame(rows, schema), path)
    assert [tuple(r) for r in TB.read_log(spark, path).select("step", "loss", "grad").orderBy("step").collect()] == [(1, 0.5, None), (2, 0.4, None), (3, 0.3, 7.0)]
    long = spark.createDataFrame([(1, 1, "a", 1.0, 1), (1, 1, "a", 0.5, 2), (1, 1, "b", None, 3)], "run int, step int, key string, value double, seq int")
    assert TB.log_rows(long, seq=["seq"]).first()["values"] == {"a": 0.5, "b": None}


def _batches(spark, path, batches, cap):
    """Run the quota over the batches one after the other, with a restart between them."""
    for rows in batches:
        spark.createDataFrame([(r,) for r in rows], "name string").coalesce(1).write.mode("append").json(f"{path}/in")
        s = ST.quota_draws(spark.readStream.schema("name string").json(f"{path}/in"), "name", 2, cap)
        old = {k: spark.conf.get(k, None) for k in ROCKS}
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        try:
            s.writeStream.option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return sorted((r.source, r.draw) for r in spark.read.parquet(f"{path}/out").collect())


def test_quota_holds_over_batches_and_restarts(spark, tmp_path):
    got = _batches(spark, str(tmp_path), [["a", "a", "b", None], ["a", "c"], ["a", "b"]], 3)
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 0), ("c", 1)]


def test_remembered_key_is_forgotten(spark, tmp_path):
    """Seen again after its time to live, a key comes once more: nothing is kept for ever."""
    def feed():
        spark.createDataFrame([("k",)], "f string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    feed()
    src = spark.readStream.schema("f string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    feed()
    assert _drain(ST.ingest_remembered(src, "f"), "append", ROCKS).count() == 1
    assert _drain(ST.ingest_remembered(src, "f", ttl_ms=1), "append", ROCKS).count() == 2


def test_snapshot_keeps_metadata(spark):
    raw = spark.createDataFrame([("a", '{"lab": {"n": 3}}'), ("b", "[1]"), ("c", None)], "path string, metadata string")
    none = spark.createDataFrame([], CF.RAW_SCHEMA).drop("metadata")
    got = {r.path: r.m for r in CF.snapshot(CF.parse_configs(raw.unionByName(none, allowMissingColumns=True))).select("path", F.get_json_object("text", "$.metadata").alias("m")).collect()}
    assert got == {"a": '{"lab":{"n":3}}', "b": "{}", "c": "{}"}


def test_stack_of_unequal_layers_goes(spark):
    px = [("ok", l, x, 0, 10.0 * l + x) for l in (1, 2) for x in range(3)] + [("odd", l, x, 0, 1.0) for l in (1, 2) for x in range(1 + l)]
    t = spark.createDataFrame(px, "s string, layer int, x int, y int, v double")
    assert sorted((r.s, r.x, r.a, r.b) for r in R.matched_stacks(t, ["s"], {"1": "a", "2": "b"}).collect()) == [("ok", x, 10.0 + x, 20.0 + x) for x in range(3)]
    assert [tuple(r) for r in R.shape_problems(t, ["s"]).collect()] == [("odd", "2x1,3x1", "sizes differ")]


def test_series_ends_at_the_target(spark):
    """A step of weight 1 makes the layers add up to the target; the log shows the residual before each step."""
    layers = spark.createDataFrame([(1, 0, tc, l, x, 0, 0.1 * (l + 1) + 0.01 * x) for tc in range(2) for l in range(2) for x in range(2 * tc, 2 * tc + 2)], "i int, tr int, tc int, layer int, x int, y int, v double")
    target = spark.createDataFrame([(1, 0, tc, x, 0, 0.2 + 0.02 * x) for tc in range(2) for x in range(2 * tc, 2 * tc + 2)], "i int, tr int, tc int, x int, y int, t double")
    log, after = S.residual_series(layers, target, ["i"], [(9, 5, 1.0), (5, -1, 1.0)], fixed=0.5)
    rows = log.orderBy("iter").collect()
    assert [(r.iter, r.shift_h, r.shift_w, r.t, r.t_next) for r in rows] == [(0, 0, 0, 9, 5), (1, 0, 0, 5, -1), (2, 0, 1, 9, 5), (3, 0, 1, 5, -1)]
    assert rows[0].residual_abs_mean > 0.01 and abs(rows[1].residual_abs_mean) < 1e-12
    got = {r.x: r.s for r in after.groupBy("x").agg(F.sum("v").alias("s")).collect()}
    assert all(abs(0.5 * got[x] - (0.2 + 0.02 * x)) < 1e-12 for x in range(4))


def test_residual_series_joins_pixels_by_merge(spark):
    """Three layers, one without pixels that have a target, an unknown value, and k of each tile; no pixel is broadcast or stored after the last step."""
    v = {(layer, x): 0.1 * (layer + 1) + 0.07 * x for layer in (0, 1) for x in range(4)}
    rows = [(1, 0, 0, layer, x, 0, w) for (layer, x), w in v.items()] + [(1, 0, 0, 2, 9, 0, 0.5), (1, 0, 0, 1, 4, 0, None), (1, 0, 0, 0, 4, 0, 0.3)]
    layers = spark.createDataFrame(rows, "i int, tr int, tc int, layer int, x int, y int, v double")
    target = spark.createDataFrame([(1, 0, 0, x, 0, 0.2 + 0.05 * x) for x in range(5)], "i int, tr int, tc int, x int, y int, t double")
    log, after = S.residual_series(layers, target, ["i"], [(9, 5, 0.5), (5, -1, 1.0)])
    now, n = {**v, (0, 4): 0.3}, 3
    for r, lam in zip(log.orderBy("iter").collect(), (0.5, 1.0), strict=True):
        s = {x: sum(w for (_, z), w in now.items() if z == x) for x in range(5)}
        t = {x: 0.2 + 0.05 * x for x in range(5)}
        k = min(1.0, sum(s[x] * t[x] for x in s) / sum(s[x] * s[x] for x in s))
        assert r.k == pytest.approx(k) and r.residual_abs_mean == pytest.approx(sum(abs(k * s[x] - t[x]) for x in s) / 5)
        now, n = {(a, x): w - lam / n / k * (k * s[x] - t[x]) for (a, x), w in now.items()}, 2
    got = {(r.layer, r.x): r.v for r in after.collect()}
    assert got.pop((1, 4)) is None and got == pytest.approx(now)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # of the log only the sizes of the tiling are joined; pixels have been
    assert log._jdf.queryExecution().executedPlan().toString().count("Join") <= 2

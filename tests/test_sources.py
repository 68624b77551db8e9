"""Readers, writers, keys, formulas and configs."""

import json
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from layerframe.functions.formula import formula_column
from layerframe.operators import keys as K
from layerframe.operators import regress as R
from layerframe.operators import superpose as S
from layerframe.sources import configs as CF
from layerframe.sources import files as FS
from layerframe.sources import tables as TB


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_listing_and_gray(spark, tmp_path):
    for d in ("a", "result_1", "b/step_2"):
        (tmp_path / d).mkdir(parents=True)
    rows = [[10, 20, 30], [40, 50, 255]]
    for f in ("a/x.PNG", "result_1/y.png", "b/step_2/z.png", "a/mask.png"):
        png(tmp_path / f, rows)
    (tmp_path / "a/n.txt").write_text("no")
    rel = lambda **k: sorted(r.rel for r in FS.list_images(spark, str(tmp_path), **k).collect())
    assert rel() == ["a/mask.png", "a/x.PNG"] and rel(training=True) == ["a/x.PNG"] and len(rel(exclude_dirs=[])) == 4
    assert FS.derive_excludes("out/run1") == ["result", "result_*", "step_*", "out"]
    px = FS.read_gray(spark, str(tmp_path / "b")).orderBy("y", "x").collect()
    assert [[r.v for r in px if r.y == y] for y in (0, 1)] == rows


def test_gray_csv(spark, tmp_path):
    (tmp_path / "gray_values_a.csv").write_text("x,y,layer1_gray,layer2_gray,bilayer_gray\n1,2,3.5,4.5,8.0\n2,2,1,2,3\n")
    (tmp_path / "gray_values_b.csv").write_text("y,x,bilayer_gray,layer2_gray,layer1_gray\n0,0,9,5,4\n")
    (tmp_path / "gray_values_c.csv").write_text("x,y,layer1_gray\n1,2,3\n")
    r = TB.read_gray_tables(spark, str(tmp_path)).orderBy("source_image", "pixel_index").collect()
    assert [(x.layer1_gray, x.layer2_gray, x.bilayer_gray, x.source_image[-5], x.pixel_index) for x in r] == [(3.5, 4.5, 8.0, "a", 0), (1.0, 2.0, 3.0, "a", 1), (4.0, 5.0, 9.0, "b", 0)]
    with pytest.raises(ValueError):
        TB.read_gray_tables(spark, str(tmp_path), layers=3)


def test_csv_sink(spark, tmp_path):
    df = spark.range(1).selectExpr("'f' folder", "1.23456D sideA_A", "cast(null as double) twist_score", "true is_flip")
    TB.write_csv(df, str(tmp_path / "o"), TB.INTERLAYER_COLUMNS, TB.INTERLAYER_DECIMALS)
    head, line = sorted((p.read_text().splitlines() for p in (tmp_path / "o").glob("*.csv")), key=len)[-1]
    vals = dict(zip(head.split(","), line.split(",")))
    assert len(vals) == 36 and vals["sideA_A"] == "1.2346" and vals["twist_score"].strip('"') == "" and vals["is_flip"] == "1"


def test_keys(spark):
    df = spark.createDataFrame([("d/sample-7.1x3.1.png",), ("d/0_2.79x2.79/q.png",), ("x/-3.2_-2.8_0_0_a.tif",)], "path string")
    r = df.select(K.size_tag(F.col("path")).alias("t"), K.side_angstrom(K.size_tag(F.col("path"), "parents")).alias("s"), K.stack_key(K.base_name(F.col("path"))).alias("k"),
                  K.stack_key(F.lit("1.6_1.5_0.8_2.35_35.0_0.6_12345_type_trilayer.png"), 3).alias("t3"), K.request_key(F.lit("-3.2_-2.8_0_0")).alias("rk"), K.request_key(F.lit("1_2")).alias("bad")).collect()
    assert (r[0].t.w, r[0].t.h) == (7.1, 3.1) and r[1].s == pytest.approx(27.9) and r[2].k == "x-3.2_y-2.8_rot0_flip0" == r[0].rk and r[0].t3 == "1.6_1.5_0.8_2.35" and r[0].bad is None
    v = spark.createDataFrame([("[1, 2.5]",), ("",), ("[1]",), ("[NaN, 1]",), ("junk",), ("[1,2,3]",)], "t string").select(K.parse_vector(F.col("t")).alias("v")).collect()
    assert [x.v is not None for x in v] == [True, False, False, False, False, False]


def test_formulas_and_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.1), (2.0, 5.0, 6.8), (4.0, 0.0, 0.0)], "x0 double, x1 double, y double")
    n = {"x0": "x0", "x1": "x1"}
    got = df.select(formula_column("(x0 + x1) * 0.5 - x0 ^ 2 / x1", n).alias("a"), formula_column("pow(x0, 2.0) * 100", n, 0, 255).alias("b")).collect()
    assert got[0].a == pytest.approx(1.0) and got[2].a is None and [g.b for g in got] == [100, 255, 255]
    for bad in ("__import__('os')", "x0 + z", "x0 if x1 else 2", ""):
        with pytest.raises((ValueError, SyntaxError)):
            formula_column(bad, n)
    m = R.evaluate(df.withColumn("pred", F.when(F.col("x0") == 1, float("nan")).otherwise(F.col("y") + 1.0)).withColumn("g", F.lit(1)), ["g"]).first()
    mean = (3.1 + 6.8) / 3
    assert m.mae == pytest.approx((abs(3.1 - mean) + 2) / 3) and m.mape == pytest.approx(100 * (abs(3.1 - mean) / 3.1 + 1 / 6.8) / 2)
    assert R.best_equation(df, [(1, "x0 / (x1 - x1)"), (2, "x0 + x1"), (3, "x1 + x0"), (4, "rm -rf")], n).first().id == 2
    k = S.scale_factor(df.selectExpr("1 image_id", "x0 + x1 s", "0.9 * (x0 + x1) t"), ["image_id"], adaptive=True).first()
    assert k.k == pytest.approx(0.9)


def test_pareto_is_monotone(spark):
    import random

    rnd = random.Random(1)
    rows = [(a := rnd.uniform(30, 200), b := rnd.uniform(30, 200), 0.967 * (a + b) + rnd.gauss(0, 0.1)) for _ in range(300)]
    t = R.pareto(R.fitted_family(spark.createDataFrame(rows, "x0 double, x1 double, y double"), ["x0", "x1"], "y")).orderBy("complexity").collect()
    assert [r.complexity for r in t[:3]] == [1, 3, 5] and all(a.loss > b.loss for a, b in zip(t, t[1:])) and "0.967" in t[2].equation


def test_xyz_configs_checksums(spark, tmp_path):
    (tmp_path / "s.xyz").write_text('2\nLattice="3.0 0 0 0 4.0 0 0 0 5.0" Properties=species:S:1:pos:R:3 pbc="T T F"\nRe 1.0 2.0 3.0\nS  -1.5 0 2e-1\n')
    atoms, cells = FS.read_xyz(spark, str(tmp_path / "s.xyz"))
    assert [tuple(r) for r in atoms.orderBy("atom_id").collect()] == [("s", 0, "Re", 1.0, 2.0, 3.0), ("s", 1, "S", -1.5, 0.0, 0.2)]
    c = cells.first()
    assert c.n == 2 and c.lattice[4] == 4.0 and c.pbc == "T T F"
    good = {"material": "m", "image_size": {"width": 4, "height": 5}, "simulator": {"defocus_A": 7, "thermal_displacement_A": [0.1, {"value": 0.2, "weight": 3}]}, "defects": [{"symbol": "S", "rate": 0.3}]}
    bad = {"image_size": 8, "num": 0, "defect_presets": [{"rates": {"S": 0.1}, "weight": -1}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    cfg = {r.path: r for r in CF.read_configs(spark, str(tmp_path / "*.json")).collect()}
    g = cfg["good.json"]
    assert g.defocus_A == [7.0] and g.source_size_A == [0.6] and [(e.value, e.weight) for e in g.thermal_displacement_A] == [(0.1, 1.0), (0.2, 3.0)]
    assert g.defect_presets[0].name == "legacy" and g.defect_presets[0].rates == {"S": 0.3} and cfg["bad.json"].image_size.width == 8 and cfg["bad.json"].defect_presets[0].name == "S0.1"
    p = {(r.path, r.problem) for r in CF.config_problems(CF.read_configs(spark, str(tmp_path / "*.json"))).collect()}
    assert p == {("bad.json", "num must be positive"), ("bad.json", "negative preset weight"), ("bad.json", "preset weights sum to zero")}


def test_draws_are_reproducible_and_fair(spark):
    from layerframe.operators import augment as A
    from layerframe.operators import variants as V

    im = spark.range(400).withColumnRenamed("id", "image_id")
    a, b = (A.draw_table(im, ["image_id"], 2, 3).orderBy("image_id", "draw").toPandas() for _ in range(2))
    assert a.equals(b) and a.crop_side.mod(2).eq(0).all() and abs(a.rotate_range.mean() - 180) < 15
    n = spark.range(20000).select(V.hash_normal(1, "id").alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(n.m) < 0.03 and abs(n.s - 1) < 0.03 and not math.isnan(n.s)


def test_early_stop_batch(spark):
    from layerframe.operators.evallog import early_stop

    rows = [(0, e, s) for e, s in enumerate([1.0, 2.0, 1.5, 2.0, 1.0, 3.0])] + [(1, e, float(e)) for e in range(50)]
    df = spark.createDataFrame(rows, "run int, epoch int, score double")
    got = {r.run: (r.stop_epoch, r.best) for r in early_stop(df, ["run"], "score", 3).collect()}
    assert got == {0: (4, 3.0), 1: (None, 49.0)}


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 0.1, 1.0), ("b", 0.1, 0.1), ("c", 1.0, 1.0), ("c", 3.0, 2.0)], "g string, y double, pred double")
    assert {r.g: r.r2 for r in R.evaluate(df, ["g"]).collect()} == {"a": 1.0, "b": 0.0, "c": 0.5}


def test_last_value_of_a_repeated_step(spark):
    from layerframe.operators.evallog import dump_last
    from layerframe.sources.tables import pivot_log

    log = spark.createDataFrame([("r", 1, "loss", 5.0, 0), ("r", 1, "loss", 2.0, 1), ("r", 2, "loss", 4.0, 3), ("r", 2, "loss", 9.0, 2)], "run string, step int, key string, value double, seq int")
    assert [r.value for r in dump_last(log, 10, ["seq"]).collect()] == [4.0] and [r.value for r in dump_last(log, 10).collect()] == [9.0]
    assert [r.loss for r in pivot_log(log, ["loss"], seq=["seq"]).orderBy("step").collect()] == [2.0, 4.0]
    assert [r.loss for r in pivot_log(log, ["loss"]).orderBy("step").collect()] == [5.0, 9.0]


def test_structures_with_unknown_symbols_have_no_lines(spark):
    from layerframe.operators import variants as V

    atoms = spark.createDataFrame([(s, i, sym, 0.0, 0.0, 0.0) for s in (1, 2) for i, sym in enumerate(["Re", "S", "Xx" if s == 2 else "S"])], "structure int, atom_id int, symbol string, x double, y double, z double")
    cells = atoms.select("structure").distinct().selectExpr("structure", "4.0 AS lx", "3.0 AS ly", "2.0 AS lz")
    count = lambda ex: {r.structure: r["count"] for r in V.simulator_lines(atoms, cells, ["structure"], ex).groupBy("structure").count().collect()}
    assert count(()) == {1: 6} and count(["Xx"]) == {1: 6, 2: 5}
    assert [(r.structure, r.symbol) for r in V.unknown_symbols(atoms, ["structure"]).collect()] == [(2, "Xx")]


def test_unreadable_images_are_listed(spark, tmp_path):
    from layerframe.sources import files as FS

    (tmp_path / "a.bmp").write_bytes(bytes.fromhex("424d3a000000000000003600000028000000010000000100000001001800000000000400000000000000000000000000000000000000") + b"\x0a\x0a\x0a\x00")
    (tmp_path / "b.png").write_bytes(b"no image")
    assert [(r.x, r.y, r.v) for r in FS.read_gray(spark, str(tmp_path)).collect()] == [(0, 0, 10.0)]
    assert [r.image_id.rsplit("/", 1)[1] for r in FS.unreadable_images(spark, str(tmp_path)).collect()] == ["b.png"]


def test_gray_table_lines_are_numbered_without_sorting_them(spark, tmp_path):
    """Splits, chunks and repeated headers: the number of a line counts the rows before it in its file."""
    head = "x,y,layer1_gray,layer2_gray,bilayer_gray"
    for name, n in (("a", 90_000), ("b", 70_001), ("c", 3)):
        rows = [f"1,2,{i},0,{i % 7}" for i in range(n)]
        rows[n // 2:n // 2] = [head] * 2
        (tmp_path / f"gray_values_{name}.csv").write_text("\n".join([head, *rows]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        t = TB.read_gray_tables(spark, str(tmp_path))
        r = t.groupBy("source_image").agg(F.count("*").alias("n"), F.sum((F.col("pixel_index") != F.col("layer1_gray")).cast("int")).alias("wrong")).orderBy("n").collect()
        plan = t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(x.n, x.wrong) for x in r] == [(3, 0), (70_001, 0), (90_000, 0)]
    assert "Window" not in plan and "Sort " not in plan

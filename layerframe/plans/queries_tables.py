"""Queries: keys and filters (B), superposition (F), gray regression (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import keys as K
from ..operators import pixels as P
from ..operators import regress as R
from ..operators import superpose as S
from ..sources.tables import RESIDUAL_COLUMNS
from . import standins as T
from .registry import query

# candidate formulas of the kind a symbolic search emits
EQUATIONS = [(1, "113.34557"), (3, "x1 + x0"), (5, "(x0 + x1) * 0.9673063"), (7, "(x0 * 0.95) + (x1 / 1.02)"), (9, "(((x1 + x0) * 1.9673063) - x0) - x1"), (11, "x0 / (x1 - x1)")]
NAMES = {"x0": "x0", "x1": "x1"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r6(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- H: statistics, formula, metrics

def fit_by_group(spark: SparkSession, d: str) -> DataFrame:
    p = T.pairs(spark, d)
    stats = R.gray_stats(p, ["grp"], ["y"])
    k = S.scale_factor(p.withColumn("s", F.col("x0") + F.col("x1")).withColumnRenamed("y", "t"), ["grp"], adaptive=True).select("grp", "k")
    scored = R.predict_formula(p, "(x0 + x1) * 0.9673063", NAMES, clip=False)
    m = R.evaluate(scored, ["grp"]).select("grp", "r2", "rmse", "mae")
    return rounded(stats.join(k, "grp").join(m, "grp"))


query("h04_f02_flagship_fit_by_group", f"""
WITH {T.PAIRS}, s AS (SELECT grp, count(*) AS count, avg(y) AS y_mean, stddev_pop(y) AS y_std, min(y) AS y_min, max(y) AS y_max,
  quantile_cont(y, 0.25) AS y_q25, quantile_cont(y, 0.75) AS y_q75,
  greatest(0.0, least(1.0, sum(y * (x0 + x1)) / greatest(sum((x0 + x1) * (x0 + x1)), 1e-8))) AS k,
  1 - sum(power(y - (x0 + x1) * 0.9673063::DOUBLE, 2)) / (var_pop(y) * count(*)) AS r2,
  sqrt(avg(power(y - (x0 + x1) * 0.9673063::DOUBLE, 2))) AS rmse, avg(abs(y - (x0 + x1) * 0.9673063::DOUBLE)) AS mae FROM pairs GROUP BY grp)
SELECT grp, count, round(y_mean, 6) AS y_mean, round(y_std, 6) AS y_std, round(y_std / y_mean, 6) AS y_cv, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max,
 round(y_q25, 6) AS y_q25, round(y_q75, 6) AS y_q75, round(k, 6) AS k, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM s""")(fit_by_group)


@query("h01_layer_inventory", """
WITH f AS (SELECT o_custkey % 997 AS key, o_orderstatus AS layer, max(o_orderkey) AS path FROM orders GROUP BY ALL),
w AS (SELECT key, max(CASE WHEN layer = 'F' THEN path END) AS f, max(CASE WHEN layer = 'O' THEN path END) AS o, max(CASE WHEN layer = 'P' THEN path END) AS p FROM f GROUP BY key),
r AS (SELECT c_custkey AS key FROM customer)
SELECT r.key, f, o, p, concat_ws(',', CASE WHEN f IS NULL THEN 'F' END, CASE WHEN o IS NULL THEN 'O' END, CASE WHEN p IS NULL THEN 'P' END) AS missing,
 (f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL) AS complete FROM r LEFT JOIN w ON r.key = w.key""")
def layer_inventory(spark, d):
    files = T.table(spark, d, "orders").select((F.col("o_custkey") % 997).alias("key"), F.col("o_orderstatus").alias("layer"), F.col("o_orderkey").alias("path"))
    req = T.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    out = R.layer_inventory(req, files, ["F", "O", "P"])
    return out.select("key", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), F.concat_ws(",", "missing").alias("missing"), "complete")


BOX5 = """p5 AS (SELECT {k}, x, y, sum(w * l1) / 25.0 AS m1, sum(w * l2) / 25.0 AS m2, sum(w * t) / 25.0 AS mt FROM (
  SELECT a.{k}, a.x, a.y, b.l1, b.l2, b.t, 1 AS w FROM (SELECT {k}, x, y, dx, dy FROM {s}, (SELECT unnest(generate_series(-2, 2)) AS dx), (SELECT unnest(generate_series(-2, 2)) AS dy)) a
  JOIN {s} b ON a.{k} = b.{k} AND b.x = least(7, greatest(0, a.x + a.dx)) AND b.y = least(7, greatest(0, a.y + a.dy))) GROUP BY ALL)"""


@query("h02_valid_pixels_bilayer", f"""WITH {T.STACKS}, {BOX5.format(k='stack', s='stacks')}
SELECT p5.stack, p5.x, p5.y, round(m1, 6) AS l1, round(m2, 6) AS l2, round(mt, 6) AS t FROM p5 JOIN stacks s ON p5.stack = s.stack AND p5.x = s.x AND p5.y = s.y
WHERE s.t > 50 AND mt > 50 AND (m1 > 30 OR m2 > 30)""")
def valid_bilayer(spark, d):
    return rounded(R.valid_bilayer(T.stacks(spark, d), ["stack"]))


@query("h02_valid_pixels_trilayer", f"""WITH {T.STACKS}, s3 AS (SELECT stack, x, y, l1, l2, t - 40.0 AS t FROM stacks), {BOX5.format(k='stack', s='s3')}
SELECT stack, x, y, round(m1, 6) AS l1, round(m2, 6) AS l2, round((m1 + m2) / 2, 6) AS l3, round(mt, 6) AS t FROM p5 WHERE mt > 30""")
def valid_trilayer(spark, d):
    s = T.stacks(spark, d).withColumn("l3", (F.col("l1") + F.col("l2")) / 2).withColumn("t", F.col("t") - 40.0)
    return rounded(R.valid_trilayer(s, ["stack"]))


RAGGED = """rag AS (SELECT image_id // 3 AS stack, CAST(image_id % 3 AS INT) AS layer, x, y, v FROM gray WHERE image_id % 7 <> 0 OR x < 7)"""


@query("h02_matched_stacks", f"""WITH {T.GRAY}, {RAGGED}, sh AS (SELECT stack, layer, max(x) AS w, max(y) AS h FROM rag GROUP BY ALL), ok AS (SELECT stack FROM sh GROUP BY stack HAVING count(DISTINCT (w, h)) = 1)
SELECT stack, x, y, round(max(CASE WHEN layer = 0 THEN v END), 6) AS l1, round(max(CASE WHEN layer = 1 THEN v END), 6) AS l2, round(max(CASE WHEN layer = 2 THEN v END), 6) AS t FROM rag JOIN ok USING (stack) GROUP BY stack, x, y HAVING count(DISTINCT layer) = 3""")
def matched_stacks(spark, d):
    """Stacks of three images; every seventh image is one column narrower, and its stack goes."""
    return rounded(R.matched_stacks(_ragged(spark, d), ["stack"], {"0": "l1", "1": "l2", "2": "t"}))


def _ragged(spark, d):
    g = T.gray(spark, d).filter("image_id % 7 <> 0 or x < 7")
    return g.select(F.floor(F.col("image_id") / 3).cast("bigint").alias("stack"), (F.col("image_id") % 3).cast("int").alias("layer"), "x", "y", "v")


@query("h02_shape_problems", f"""WITH {T.GRAY}, {RAGGED}, sh AS (SELECT stack, layer, (max(x) + 1) || 'x' || (max(y) + 1) AS shape FROM rag GROUP BY ALL)
SELECT stack, string_agg(shape, ',' ORDER BY layer) AS shapes, 'sizes differ' AS problem FROM sh GROUP BY stack HAVING count(DISTINCT shape) > 1""")
def shape_problems(spark, d):
    return R.shape_problems(_ragged(spark, d), ["stack"])


@query("h03_sample_400_per_stack", f"""WITH {T.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('/', 21, grp, l_orderkey, l_linenumber)), l_orderkey, l_linenumber) AS k FROM pairs)
SELECT grp, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, round(avg(y), 6) AS mean_t FROM r WHERE k <= 400 GROUP BY grp""")
def sample_400(spark, d):
    p = T.pairs(spark, d).select("grp", F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("y").alias("t"))
    return rounded(R.sample_per_stack(p, ["grp"], 400).groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("n_distinct"), F.avg("t").alias("mean_t")))


@query("h04_gray_stats_by_flag", f"""WITH {T.PAIRS} SELECT grp, count(*) AS count,
 {", ".join(f"round(avg({c}),6) AS {c}_mean, round(stddev_pop({c}),6) AS {c}_std, round(stddev_pop({c})/avg({c}),6) AS {c}_cv, round(min({c}),6) AS {c}_min, round(max({c}),6) AS {c}_max, round(quantile_cont({c},0.25),6) AS {c}_q25, round(quantile_cont({c},0.75),6) AS {c}_q75" for c in ("x0", "x1", "y"))}
 FROM pairs GROUP BY grp""")
def gray_stats_by_flag(spark, d):
    return rounded(R.gray_stats(T.pairs(spark, d), ["grp"], ["x0", "x1", "y"]))


@query("h05_split_sizes", "SELECT * FROM (SELECT 'test' AS dataset, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM lineitem)")
def split_sizes(spark, d):
    return R.split_rows(T.pairs(spark, d), ["l_orderkey", "l_linenumber"]).groupBy("dataset").agg(F.count("*").alias("n"))


def _scored(spark, d):
    p = R.predict_formula(T.pairs(spark, d), "(x0 + x1) * 0.9673063", NAMES, clip=False)
    # quantity 13 stands for rows a model fails on
    return p.withColumn("pred", F.when(F.col("x0") == 26.0, F.lit(float("nan"))).otherwise(F.col("pred"))).withColumn("y", F.when(F.col("x0") == 4.0, 0.0).otherwise(F.col("y")))


SCORED = f"""{T.PAIRS}, sc0 AS (SELECT grp, dataset, x0, CASE WHEN x0 = 4.0 THEN 0.0 ELSE y END AS y, CASE WHEN x0 = 26.0 THEN NULL ELSE (x0 + x1) * 0.9673063::DOUBLE END AS p FROM pairs),
sc AS (SELECT grp, dataset, y, coalesce(p, avg(y) OVER (PARTITION BY dataset)) AS pred FROM sc0),
met AS (SELECT dataset, 1 - sum((y-pred)*(y-pred)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y-pred)*(y-pred))) AS rmse, avg(abs(y-pred)) AS mae,
 100 * avg(CASE WHEN y <> 0 THEN abs((y-pred)/y) END) AS mape, avg((y-pred)*(y-pred)) AS mse, count(*) AS n FROM sc GROUP BY dataset)"""


@query("h06_metrics", f"WITH {SCORED} SELECT dataset, round(r2,6) AS r2, round(rmse,6) AS rmse, round(mae,6) AS mae, round(mape,6) AS mape, round(mse,5) AS mse, n FROM met")
def metrics(spark, d):
    m = R.evaluate(_scored(spark, d), ["dataset"])
    return rounded(m.withColumn("mse", r6(F.col("mse"), 5)))


@query("h07_best_equation", f"""WITH {T.PAIRS}, e AS (SELECT 1 AS id, avg(abs(y - 113.34557::DOUBLE)) AS mae FROM pairs WHERE dataset = 'test' UNION ALL
 SELECT 3, avg(abs(y - (x1 + x0))) FROM pairs WHERE dataset = 'test' UNION ALL SELECT 5, avg(abs(y - (x0 + x1) * 0.9673063::DOUBLE)) FROM pairs WHERE dataset = 'test' UNION ALL
 SELECT 7, avg(abs(y - (x0 * 0.95::DOUBLE + x1 / 1.02::DOUBLE))) FROM pairs WHERE dataset = 'test' UNION ALL SELECT 9, avg(abs(y - ((x1 + x0) * 1.9673063::DOUBLE - x0 - x1))) FROM pairs WHERE dataset = 'test')
SELECT id, round(mae, 6) AS mae FROM e ORDER BY e.mae, id LIMIT 1""")
def best_equation(spark, d):
    return rounded(R.best_equation(T.pairs(spark, d).filter("dataset = 'test'"), EQUATIONS, NAMES))


@query("h08_evaluation_long", f"""WITH {SCORED} SELECT metric, round(value, 5) AS value FROM (
 SELECT dataset || '_' || m AS metric, value FROM (SELECT dataset, r2, rmse, mae, mape, mse FROM met) UNPIVOT (value FOR m IN (r2, rmse, mae, mape, mse))
 UNION ALL SELECT 'node_count', 5.0 UNION ALL SELECT 'tree_depth', 0.0 UNION ALL SELECT 'r2_per_node', r2 / 5 FROM met WHERE dataset = 'test')""")
def evaluation_long(spark, d):
    return rounded(R.evaluation_long(R.evaluate(_scored(spark, d), ["dataset"]), 5, 0), 5)


@query("h09_a13_prediction_tables", f"""WITH {T.PAIRS}, p AS (SELECT *, (x0 + x1) * 0.9673063::DOUBLE AS pred FROM pairs)
SELECT dataset, count(*) AS sample_count, round(1 - sum(power(y-pred,2)) / (var_pop(y)*count(*)),5) AS r2, round(sqrt(avg(power(y-pred,2))),5) AS rmse, round(avg(abs(y-pred)),5) AS mae,
 round(avg(CASE WHEN y<>0 THEN abs((y-pred)/y) END)*100,5) AS mape_percent, round(avg(power(y-pred,2)),5) AS mse FROM p GROUP BY dataset""")
def prediction_summary(spark, d):
    from ..sources.tables import prediction_sheets

    return rounded(prediction_sheets(R.predict_formula(T.pairs(spark, d), "(x0 + x1) * 0.9673063", NAMES, clip=False))["summary"], 5)


@query("h10_pareto_fitted_family", f"""WITH {T.PAIRS}, s AS (SELECT count(*)::DOUBLE AS n, sum(y) AS sy, sum(y*y) AS syy, sum(x0+x1) AS sx, sum((x0+x1)*(x0+x1)) AS sxx, sum((x0+x1)*y) AS sxy,
 sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x1*x1) AS c, sum(x0*y) AS e, sum(x1*y) AS f FROM pairs),
w AS (SELECT *, (c*e - b*f) / (a*c - b*b) AS w0, (a*f - b*e) / (a*c - b*b) AS w1, sxy / sxx AS k, (sy - sx) / n AS sh FROM s),
fam AS (SELECT 1 AS complexity, syy/n - (sy/n)*(sy/n) AS loss FROM w UNION ALL SELECT 3, (syy - 2*sxy + sxx)/n FROM w
 UNION ALL SELECT 5, least((syy - 2*sxy + sxx)/n - sh*sh, (syy - 2*k*sxy + k*k*sxx)/n) FROM w
 UNION ALL SELECT 7, (syy - 2*(w0*e + w1*f) + w0*w0*a + 2*w0*w1*b + w1*w1*c)/n FROM w)
SELECT complexity, round(loss, 4) AS loss FROM (SELECT *, min(loss) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM fam) WHERE b IS NULL OR loss < b""")
def pareto_family(spark, d):
    return rounded(R.pareto(R.fitted_family(T.pairs(spark, d), ["x0", "x1"], "y")).drop("equation"), 4)


@query("h11_chart_ranges", f"WITH {T.PAIRS}, p AS (SELECT *, (x0 + x1) * 0.9673063::DOUBLE AS pred FROM pairs) SELECT dataset, round(least(min(y), min(pred)),6) AS lo, round(greatest(max(y), max(pred)),6) AS hi, count(*) AS n FROM p GROUP BY dataset")
def chart_ranges(spark, d):
    return rounded(R.chart_ranges(R.predict_formula(T.pairs(spark, d), "(x0 + x1) * 0.9673063", NAMES, clip=False), ["dataset"]))


# ---------------------------------------------------------------- F: superposition

@query("f01_layer_sum", f"""WITH {T.LAYERS} SELECT image_id, x, y, count(*) AS n_layers, round(sum(2*v-1) + (count(*) - 1), 6) AS s, round((sum(2*v-1) + (count(*) - 1)) / count(*), 6) AS back FROM layers GROUP BY image_id, x, y""")
def layer_sum(spark, d):
    s = S.superpose(T.layers(spark, d).withColumn("v", P.unit_to_signed(F.col("v"))), signed=True)
    return rounded(s.select("image_id", "x", "y", "n_layers", "s", (F.col("s") / F.col("n_layers")).alias("back")))


STK = f"""{T.STACKS}, st AS (SELECT stack AS image_id, x, y, (l1 + l2) / 255.0 AS s, t / 255.0 AS t FROM stacks),
kk AS (SELECT image_id, count(*) AS n, greatest(0.0, least(1.0, sum(t*s) / greatest(sum(s*s), 1e-8))) AS k FROM st GROUP BY image_id)"""


def _stk(spark, d):
    return T.stacks(spark, d).select(F.col("stack").alias("image_id"), "x", "y", ((F.col("l1") + F.col("l2")) / 255.0).alias("s"), (F.col("t") / 255.0).alias("t"))


@query("f02_scale_factor", f"""WITH {STK} SELECT image_id, n, round(k, 6) AS k, round(greatest(k, 1e-8), 6) AS k_safe, 'adaptive' AS k_mode FROM kk
 UNION ALL SELECT image_id, n, 0.5, 0.5, 'fixed' FROM kk UNION ALL SELECT image_id, n, 1.0, 1.0, 'unity' FROM kk""")
def scale_factor(spark, d):
    p = _stk(spark, d)
    out = S.scale_factor(p, ["image_id"], adaptive=True).unionByName(S.scale_factor(p, ["image_id"], fixed=0.5)).unionByName(S.scale_factor(p, ["image_id"]))
    return rounded(out)


@query("f03_combined_image", f"WITH {STK} SELECT st.image_id, x, y, round(greatest(0.0, least(1.0, k * s)), 6) AS combined FROM st JOIN kk ON st.image_id = kk.image_id")
def combined_image(spark, d):
    p = _stk(spark, d)
    k = S.scale_factor(p, ["image_id"], adaptive=True).select("image_id", "k")
    return rounded(p.join(k, "image_id").select("image_id", "x", "y", S.combined(F.col("k"), F.col("s")).alias("combined")))


@query("f04_consistency_step", f"""WITH {STK}, st2 AS (SELECT l.image_id, l.layer, l.x, l.y, l.v, st.s, st.t FROM ({T.LAYERS.replace("layers AS", "", 1) and "SELECT image_id // 2 AS image_id, CAST(image_id % 2 AS INT) AS layer, x, y, v / 255.0 AS v FROM gray"}) l JOIN st ON l.image_id = st.image_id AND l.x = st.x AND l.y = st.y)
SELECT a.image_id, layer, x, y, round(v - 0.7 * 0.5 / greatest(k, 1e-8) * (k * s - t), 6) AS v FROM st2 a JOIN kk ON a.image_id = kk.image_id""")
def consistency_step(spark, d):
    ls = T.layers(spark, d)
    target = _stk(spark, d).select("image_id", "x", "y", "t")
    return rounded(S.consistency_step(ls, target, ["image_id"], 0.7))


TILES44 = """tl AS (SELECT tr, tc, least(2*tr, 4) AS y0, least(2*tc, 4) AS x0, tr*3+tc AS tile_rank FROM (SELECT unnest(generate_series(0, 2)) AS tr), (SELECT unnest(generate_series(0, 2)) AS tc))"""


@query("f05_residual_log", f"""WITH {STK}, {TILES44}, tp AS (SELECT image_id, tr, tc, s, t FROM st JOIN tl ON x >= x0 AND x < x0+4 AND y >= y0 AND y < y0+4),
k2 AS (SELECT image_id, tr, tc, greatest(0.0, least(1.0, sum(t*s) / greatest(sum(s*s), 1e-8))) AS k FROM tp GROUP BY ALL)
SELECT tp.image_id, tp.tr, tp.tc, round(k, 6) AS k, 'adaptive' AS k_mode, round(avg(abs(k*s-t)), 6) AS residual_abs_mean, tp.tr*3+tp.tc AS shift_index, true AS adaptive
FROM tp JOIN k2 ON tp.image_id = k2.image_id AND tp.tr = k2.tr AND tp.tc = k2.tc GROUP BY tp.image_id, tp.tr, tp.tc, k""")
def residual_log(spark, d):
    p = _stk(spark, d)
    tiles = P.cut_tiles(p, P.image_size(p), 4)
    return rounded(S.residual_log(tiles, ["image_id"]))


# the steps of a fixed k in closed form: s becomes s - lambda * (k s - t) / k
SERIES = """q0 AS (SELECT image_id, tr, tc, x, y, s, t FROM st JOIN tl ON x >= x0 AND x < x0+4 AND y >= y0 AND y < y0+4), q1 AS (SELECT image_id, tr, tc, x, y, s - 1.0 * (0.4::DOUBLE * s - t) / 0.4::DOUBLE * 0.5::DOUBLE AS s, t FROM q0),
q2 AS (SELECT image_id, tr, tc, x, y, s - 0.25::DOUBLE * (0.4::DOUBLE * s - t) / 0.4::DOUBLE AS s, t FROM q1), qs AS (SELECT *, 0 AS n FROM q0 UNION ALL SELECT *, 1 FROM q1 UNION ALL SELECT *, 2 FROM q2)"""


@query("f05_residual_series", f"""WITH {STK}, {TILES44}, {SERIES}
SELECT image_id, tr AS shift_h, tc AS shift_w, tr*3+tc AS shift_index, ((tr*3+tc)*3 + n)::BIGINT AS iter, [90, 60, 30][n + 1] AS t, [60, 30, -1][n + 1] AS t_next, [0.5, 0.25, 1.0][n + 1]::DOUBLE AS lambda_t, 0.4::DOUBLE AS k, 'fixed' AS k_mode, round(avg(abs(0.4::DOUBLE * s - t)), 6) AS residual_abs_mean, false AS adaptive
FROM qs GROUP BY image_id, tr, tc, n""")
def residual_series(spark, d):
    """Three steps on every 4 × 4 tile of the layers, all eleven columns of the log."""
    log, _ = S.residual_series(*_tiled_layers(spark, d), ["image_id"], [(90, 60, 0.5), (60, 30, 0.25), (30, -1, 1.0)], fixed=0.4)
    return rounded(log.select("image_id", *RESIDUAL_COLUMNS))


def _tiled_layers(spark, d):
    p = _stk(spark, d)
    tiles = P.cut_tiles(p, P.image_size(p), 4).select("image_id", "tr", "tc", "x", "y", "t")
    return T.layers(spark, d).join(tiles.drop("t").hint("merge"), ["image_id", "x", "y"]), tiles


@query("f05_series_summary", f"""WITH {STK}, {TILES44}, {SERIES}, r AS (SELECT image_id, tr, tc, n, avg(abs(0.4::DOUBLE * s - t)) AS r FROM qs GROUP BY ALL)
SELECT image_id, [90, 60, 30][n + 1] AS t, [60, 30, -1][n + 1] AS t_next, n::BIGINT AS first_iter, 0.4::DOUBLE AS k, round(avg(r), 6) AS residual_abs_mean, count(*) AS n_tiles FROM r GROUP BY image_id, n""")
def series_summary(spark, d):
    log, _ = S.residual_series(*_tiled_layers(spark, d), ["image_id"], [(90, 60, 0.5), (60, 30, 0.25), (30, -1, 1.0)], fixed=0.4)
    return rounded(S.series_summary(log, ["image_id"]))


@query("f06_channel_mean", f"WITH {T.LAYERS} SELECT image_id, x, y, round(avg(v), 6) AS v, round(avg(v), 6) AS back FROM layers GROUP BY image_id, x, y")
def channel_mean(spark, d):
    m = S.channel_mean(T.layers(spark, d).withColumnRenamed("layer", "channel"))
    back = F.aggregate(S.channel_spread(F.col("v")), F.lit(0.0), lambda a, b: a + b / 3.0)
    return rounded(m.withColumn("back", back))


# ---------------------------------------------------------------- B: keys

def named_parts(spark, d):
    """File-like names built from part rows: folder with a size tag, file with stack parameters."""
    p = T.table(spark, d, "part")
    size = F.concat((F.col("p_size") / 10).cast("string"), F.lit("x"), (F.col("p_retailprice") % 7).cast("int").cast("string"))
    name = F.concat((F.col("p_partkey") % 13 - 6).cast("string"), F.lit("_"), (F.col("p_size") / 4).cast("string"), F.lit("_0_"),
                    F.when(F.col("p_partkey") % 11 == 0, "x").otherwise((F.col("p_partkey") % 2).cast("string")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return p.select("p_partkey", F.concat(F.lit("run-"), size, F.lit("/s_"), size, F.lit("/"), name).alias("path"), (F.col("p_partkey") % 3).cast("string").alias("layer"))


NAMED = """np AS (SELECT p_partkey, 'run-' || sz || '/s_' || sz || '/' || (p_partkey % 13 - 6)::VARCHAR || '_' || (p_size / 4)::VARCHAR || '_0_' ||
  CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE (p_partkey % 2)::VARCHAR END || '_' || p_partkey::VARCHAR || '.png' AS path, (p_partkey % 3)::VARCHAR AS layer
  FROM (SELECT *, (p_size / 10)::VARCHAR || 'x' || (floor(p_retailprice % 7))::INT::VARCHAR AS sz FROM part))"""


@query("b01_size_tags", f"""WITH {NAMED}, g AS (SELECT p_partkey, split_part(path, '/', 1) AS gp, split_part(path, '/', 2) AS pa FROM np),
n AS (SELECT p_partkey, TRY_CAST(regexp_extract(gp, '[-_]([0-9.]+)x([0-9.]+)', 1) AS DOUBLE) AS nw, TRY_CAST(regexp_extract(gp, '[-_]([0-9.]+)x([0-9.]+)', 2) AS DOUBLE) AS nh,
 TRY_CAST(regexp_extract(pa, '_([0-9.]+)x([0-9.]+)$', 1) AS DOUBLE) AS pw, TRY_CAST(regexp_extract(pa, '_([0-9.]+)x([0-9.]+)$', 2) AS DOUBLE) AS ph FROM g)
SELECT p_partkey, CASE WHEN nw > 0 AND nh > 0 THEN nw END AS name_w, CASE WHEN nw > 0 AND nh > 0 THEN nh END AS name_h,
 round(CASE WHEN pw > 0 AND ph > 0 THEN 5.0 * (pw + ph) ELSE 27.9 END, 6) AS side_parents, round(CASE WHEN pw > 0 AND ph > 0 THEN 5.0 * (pw + ph) ELSE 27.9 END, 6) AS side_folder,
 CASE WHEN pw > 0 AND ph > 0 THEN pw END AS any_w FROM n""")
def size_tags(spark, d):
    p = named_parts(spark, d)
    folder = K.dir_name(F.col("path"))
    return p.select(
        "p_partkey", K.size_tag(F.element_at(F.split("path", "/"), 1), "name")["w"].alias("name_w"), K.size_tag(F.element_at(F.split("path", "/"), 1), "name")["h"].alias("name_h"),
        r6(K.side_angstrom(K.size_tag(F.col("path"), "parents"))).alias("side_parents"), r6(K.side_angstrom(K.size_tag(folder, "folder"))).alias("side_folder"),
        K.size_tag(F.concat(folder, F.lit("/a.png")), "anywhere")["w"].alias("any_w"))


@query("b02_stack_keys", f"""WITH {NAMED}, k AS (SELECT layer, path, regexp_extract(split_part(path, '/', 3), '^([-+]?[0-9]+(?:\\.[0-9]+)?)_([-+]?[0-9]+(?:\\.[0-9]+)?)_([-+]?[0-9]+(?:\\.[0-9]+)?)_([-+]?[0-9]+(?:\\.[0-9]+)?)_', ['a','b','c','d']) AS m FROM np)
SELECT layer, 'x' || m.a || '_y' || m.b || '_rot' || m.c || '_flip' || m.d AS key, max(path) AS path FROM k WHERE m.a <> '' GROUP BY ALL""")
def stack_keys(spark, d):
    return K.latest_per_key(named_parts(spark, d))


@query("b02_unmatched_names", f"WITH {NAMED} SELECT path FROM np WHERE p_partkey % 11 = 0")
def unmatched(spark, d):
    return K.unmatched_names(named_parts(spark, d))


@query("b03_plan_lookup", f"""WITH {NAMED}, im AS (SELECT p_partkey, path, split_part(path, '/', 3) AS b FROM np WHERE TRUE), pl AS (SELECT p_partkey AS plan_id, p_partkey AS ord, split_part(path, '/', 3) AS path FROM np)
SELECT im.path, min(pl.plan_id) AS plan_id FROM im LEFT JOIN pl ON pl.path = im.b GROUP BY im.path""")
def plan_lookup(spark, d):
    p = named_parts(spark, d)
    plans = p.select(F.col("p_partkey").alias("plan_id"), F.col("p_partkey").alias("ord"), K.base_name(F.col("path")).alias("path"))
    return K.lookup_plan(p.select("path"), plans)


@query("b03_selection_report", """
WITH f AS (SELECT 'img/' || p_name || '/' || p_partkey || '.png' AS path, p_partkey FROM part), s AS (SELECT o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.png' ELSE '' END AS name FROM orders GROUP BY ALL)
SELECT s.name, count(p_partkey) AS hits FROM s LEFT JOIN f ON f.p_partkey::VARCHAR = replace(s.name, '.png', '') GROUP BY s.name""")
def selection_report(spark, d):
    f = T.table(spark, d, "part").select(F.concat(F.lit("img/"), "p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"))
    o = T.table(spark, d, "orders")
    s = o.select(F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".png").otherwise("")).alias("name")).distinct()
    hits = K.resolve_all(s, f).groupBy("name").agg(F.count("*").alias("hits"))
    return s.join(hits, "name", "left").select("name", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


@query("b04_pair_layers", """
WITH f AS (SELECT 'd' || (o_custkey % 401) AS folder, 'b' || (o_orderkey % 7) AS base, CASE o_orderstatus WHEN 'F' THEN 'b' || (o_orderkey % 7) || '_0.png' WHEN 'O' THEN 'b' || (o_orderkey % 7) || '_1.png' ELSE 'b_x.png' END AS name FROM orders),
a AS (SELECT folder, min(CASE WHEN name LIKE '%\\_0.png' ESCAPE '\\' THEN name END) AS img0, min(CASE WHEN name LIKE '%\\_1.png' ESCAPE '\\' THEN name END) AS img1 FROM f GROUP BY folder)
SELECT folder, img0, img1, CASE WHEN img0 IS NULL OR img1 IS NULL THEN 'missing__0_or__1' ELSE '' END AS reason FROM a""")
def pair_layers(spark, d):
    return K.pair_layers(order_files(spark, d))


def order_files(spark, d):
    o = T.table(spark, d, "orders")
    b = F.concat(F.lit("b"), (F.col("o_orderkey") % 7).cast("string"))
    suffix = F.when(F.col("o_orderstatus") == "F", F.concat(b, F.lit("_0.png"))).when(F.col("o_orderstatus") == "O", F.concat(b, F.lit("_1.png"))).otherwise("b_x.png")
    return o.select(F.concat(F.lit("d"), (F.col("o_custkey") % 401).cast("string"), F.lit("/"), suffix).alias("path"))


@query("b04_pair_layers_by_base", """
WITH f AS (SELECT 'd' || (o_custkey % 401) AS folder, 'b' || (o_orderkey % 7) AS base, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
a AS (SELECT folder, base, max(CASE WHEN s = 'F' THEN base || '_0.png' END) AS img0, max(CASE WHEN s = 'O' THEN base || '_1.png' END) AS img1 FROM f GROUP BY ALL)
SELECT folder, base, img0, img1, CASE WHEN img0 IS NULL OR img1 IS NULL THEN 'missing__0_or__1' ELSE '' END AS reason FROM a""")
def pair_layers_by_base(spark, d):
    return K.pair_layers(order_files(spark, d), by_base=True)


@query("b06_parse_vectors", """
WITH t AS (SELECT event_id, event_type, value, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN '[' || value || ']' ELSE '[' || value || ', ' || (value * 2)::DOUBLE || ']' END AS txt FROM events)
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN round(value, 6) END AS vx, CASE WHEN event_type NOT IN ('error', 'view') THEN round(value * 2, 6) END AS vy FROM t""")
def parse_vectors(spark, d):
    e = T.table(spark, d, "events")
    txt = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), (F.col("value") * 2).cast("string"), F.lit("]")))
    v = K.parse_vector(txt)
    return e.select("event_id", r6(v["x"]).alias("vx"), r6(v["y"]).alias("vy"))


@query("b05_image_id", "SELECT page_id, substr(sha1(u), 1, 10) || '_' || regexp_replace(split_part(u, '/', -1), '(.)\\.[^./]*$', '\\1') AS image_key FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS u FROM pages)")
def image_key(spark, d):
    u = F.split(F.split("url", r"\?")[0], "#")[0]
    return T.table(spark, d, "pages").select("page_id", K.image_id(u).alias("image_key"))


@query("b07_class_ids", "SELECT p_partkey, dense_rank() OVER (ORDER BY split_part(replace(p_name, ' ', '_'), '_', 1)) - 1 AS class_id FROM part")
def class_ids(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.translate("p_name", " ", "_").alias("name"))
    return K.class_ids(p).select("p_partkey", "class_id")


@query("b08_shards", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) % 4 AS BIGINT) AS shard FROM customer")
def shards(spark, d):
    return K.shard_number(T.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], 4).select("c_custkey", F.col("shard").cast("bigint").alias("shard"))


@query("b09_numeric_sort", "SELECT p_partkey, p_partkey AS num, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def numeric_sort(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    return K.numeric_sort(p).select("p_partkey", "num", "pos")


@query("b10_resume_steps", """
WITH f AS (SELECT o_custkey % 17 AS run, o_orderkey AS step FROM orders) SELECT 'r' || run AS folder, max(step) AS step, 'r' || run || '/model' || lpad(max(step)::VARCHAR, greatest(6, length(max(step)::VARCHAR))::INT, '0') || '.pt' AS path FROM f GROUP BY run""")
def resume_steps(spark, d):
    o = T.table(spark, d, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 17).cast("string"), F.lit("/model"), F.format_string("%06d", "o_orderkey"), F.lit(".pt")).alias("path"))
    return K.latest_checkpoint(o)


@query("b11_formula_columns", """
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(255.0, (l_quantity + l_extendedprice / 1000) * 0.9673063)), 6) AS bilayer,
 round(greatest(0.0, least(255.0, power(l_quantity, 1.5) - l_extendedprice / 1000)), 6) AS curved FROM lineitem""")
def formula_columns(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    n = {"x0": "a", "x1": "b"}
    out = R.predict_formula(R.predict_formula(li, "(x0 + x1) * 0.9673063", n, out="bilayer"), "x0 ^ 1.5 - x1", n, out="curved")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("bilayer")).alias("bilayer"), r6(F.col("curved")).alias("curved"))


@query("b13_train_batches", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS rn FROM customer), b AS (SELECT *, rn // 64 AS batch, count(*) OVER (PARTITION BY rn // 64) AS n FROM r)
SELECT c_custkey, batch FROM b WHERE n = 64""")
def train_batches(spark, d):
    return K.train_batches(T.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], 64).select("c_custkey", F.col("batch").cast("bigint").alias("batch"))


@query("b14_mask_pairs", """
WITH i AS (SELECT o_orderkey AS stem, CASE o_orderstatus WHEN 'P' THEN 'CMYK' ELSE 'L' END AS mode, o_custkey % 5 AS h, 8 AS w FROM orders), m AS (SELECT c_custkey AS stem, c_nationkey % 5 AS h, 8 AS w FROM customer)
SELECT i.stem, CASE WHEN m.h IS NULL THEN 'mask_not_found' WHEN mode NOT IN ('L', 'RGB', 'RGBA') THEN 'unsupported_mode' WHEN i.h <> m.h OR i.w <> m.w THEN 'size_mismatch' END AS reason FROM i LEFT JOIN m ON i.stem = m.stem""")
def mask_pairs(spark, d):
    i = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.when(F.col("o_orderstatus") == "P", "CMYK").otherwise("L").alias("mode"), (F.col("o_custkey") % 5).alias("h"), F.lit(8).alias("w"))
    m = T.table(spark, d, "customer").select(F.col("c_custkey").alias("stem"), (F.col("c_nationkey") % 5).alias("h"), F.lit(8).alias("w"))
    return K.mask_pairs(i, m).select("stem", "reason")

"""Matched gray pixels: extraction, statistics, formula choice and regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import formula_column
from ..iterate import grouped_quantiles, hash_order
from .pixels import box_mean

#: Parts of a group that is joined with its mean.
SALTS = 64
STATS = ("mean", "std", "cv", "min", "max", "q25", "q75")


# ---------------------------------------------------------------- extraction

def layer_inventory(requests: DataFrame, files: DataFrame, layers: list[str]) -> DataFrame:
    """Requested stacks against the layer listing: one path per layer and the list of missing layers."""
    have = files.groupBy("key").pivot("layer", layers).agg(F.max("path"))
    need = F.array(*[F.lit(x) for x in layers])
    present = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.lit(x)) for x in layers]))
    return requests.join(have, "key", "left").withColumn("missing", F.array_except(need, present)).withColumn("complete", F.size("missing") == 0)


def stack_pixels(px: DataFrame, layers: list[str], key: list[str]) -> DataFrame:
    """Pixel rows ``key, layer, x, y, v`` -> one row per pixel with a column per layer, complete pixels only."""
    wide = px.groupBy(*key, "x", "y").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in layers])
    return wide.dropna(subset=layers)


def equal_shapes(px: DataFrame, key: list[str]) -> DataFrame:
    """Stacks whose layers all have the same width and height."""
    per = px.groupBy(*key, "layer").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    return per.groupBy(*key).agg(F.countDistinct("w", "h").alias("n")).filter("n = 1").select(*key)


def shape_problems(px: DataFrame, key: list[str]) -> DataFrame:
    """Stacks that :func:`matched_stacks` leaves out, with the shapes of their layers: ``key, shapes, problem``."""
    per = px.groupBy(*key, "layer").agg(F.concat_ws("x", F.max("x") + 1, F.max("y") + 1).alias("shape"))
    all_ = per.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "shape"))), lambda s: s["shape"]), ",").alias("shapes"), F.countDistinct("shape").alias("n"))  # one entry per layer
    return all_.filter("n > 1").select(*key, "shapes", F.lit("sizes differ").alias("problem"))


def matched_stacks(px: DataFrame, key: list[str], names: dict[str, str]) -> DataFrame:
    """Layer pixels (key, layer, x, y, v) -> one row per pixel of the stacks whose layers agree in shape.

    ``names`` gives the column of each layer, for instance ``{"1": "l1", "2": "l2", "bilayer": "t"}``. A pixel that one of the layers lacks is left out.
    """
    kept = px.filter(F.col("layer").cast("string").isin(*names)).join(equal_shapes(px, key), key, "left_semi")
    wide = kept.groupBy(*key, "x", "y").agg(*[F.max(F.when(F.col("layer").cast("string") == a, F.col("v"))).alias(c) for a, c in names.items()])
    return wide.dropna(subset=list(names.values()))


def valid_bilayer(stack: DataFrame, key: list[str]) -> DataFrame:
    """Valid matched pixels of two-layer stacks (columns l1, l2, t): 5×5 means, centre and mean of the target above 50, one layer above 30."""
    m = box_mean(stack, ["l1", "l2", "t"], key=key)
    j = m.join(stack.select(*key, "x", "y", F.col("t").alias("center")), [*key, "x", "y"])
    return j.filter("center > 50 and t > 50 and (l1 > 30 or l2 > 30)").drop("center")


def valid_trilayer(stack: DataFrame, key: list[str]) -> DataFrame:
    """Valid matched pixels of three-layer stacks: 5×5 mean of the target above 30."""
    return box_mean(stack, ["l1", "l2", "l3", "t"], key=key).filter("t > 30")


def sample_per_stack(pixels: DataFrame, key: list[str], n: int = 400, seed: int = 21) -> DataFrame:
    """At most n pixels per stack without replacement, in hash order (reproducible)."""
    h = F.md5(F.concat_ws("/", F.lit(seed), *key, "x", "y"))
    w = Window.partitionBy(*key).orderBy(h, "x", "y")
    return pixels.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


# ---------------------------------------------------------------- statistics

def gray_stats(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """count and, per column, mean, population std, cv (0 for zero mean), min, max, exact quartiles."""
    aggs = [F.count("*").alias("count")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = df.groupBy(*key).agg(*aggs)
    out = out.withColumns({f"{c}_cv": F.when(F.col(f"{c}_mean") != 0, F.col(f"{c}_std") / F.col(f"{c}_mean")).otherwise(0.0) for c in columns})
    # quartiles of all columns in one pass over a long layout
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*key, F.explode(cells).alias("e")).select(*key, "e.c", "e.v")
    q = grouped_quantiles(long, [*key, "c"], "v", [0.25, 0.75])
    wide = q.groupBy(*key).agg(*[F.max(F.when(F.col("c") == c, F.col(f"q{i}"))).alias(f"{c}_{n}") for c in columns for i, n in enumerate(("q25", "q75"))])
    return out.join(wide, key).select(*key, "count", *[f"{c}_{s}" for c in columns for s in STATS])


def split_rows(df: DataFrame, key: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffled split with exact sizes: the first ⌈test·n⌉ rows in hash order are the test set."""
    n = df.agg(F.ceil(F.count("*") * F.lit(test)).alias("_t"))  # one row
    d = hash_order(df, key, seed).crossJoin(F.broadcast(n))
    return d.withColumn("dataset", F.when(F.col("rn") < F.col("_t"), "test").otherwise("train")).drop("rn", "_t")


# ---------------------------------------------------------------- metrics

def fill_nan_predictions(df: DataFrame, key: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """NaN or missing predictions become the mean target of their group.

    Only rows that lack one meet the means, and each group is dealt over `SALTS` parts: a group of any size is
    never one task.
    """
    m = df.groupBy(*key).agg(F.avg(y).alias("_m"))
    lacks = F.col(pred).isNull() | F.isnan(pred)
    gone = df.filter(lacks)
    if key:
        # any part holds the mean, so the part of a row need not be the same when a task runs again
        part = m.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_q"))
        on = F.col("_p") == F.col("_q")
        for i, c in enumerate(key):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        gone = gone.withColumn("_p", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(part, on)
    else:
        gone = gone.crossJoin(F.broadcast(m))
    return df.filter(~lacks).unionByName(gone.withColumn(pred, F.col("_m")).select(*df.columns))


def metric_aggs(y: Column, p: Column) -> list[Column]:
    """r2, rmse, mae, mape (zero targets left out), mse and n in one aggregate pass.

    r2 of a constant target is 1 for a perfect fit, else 0.
    """
    e = y - p
    mse = F.avg(e * e)
    constant = F.when(F.sum(e * e) == 0, 1.0).when(F.sum(e * e) > 0, 0.0)
    return [
        F.when(F.min(y) == F.max(y), constant).otherwise(1.0 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * 100.0).alias("mape"), mse.alias("mse"), F.count(y).alias("n"),
    ]


def evaluate(df: DataFrame, key: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return fill_nan_predictions(df, key, y, pred).groupBy(*key).agg(*metric_aggs(F.col(y), F.col(pred)))


def predict_formula(df: DataFrame, formula: str, names: dict[str, str], clip: bool = True, out: str = "pred") -> DataFrame:
    return df.withColumn(out, formula_column(formula, names, 0.0 if clip else None, 255.0 if clip else None))


def equation_errors(df: DataFrame, equations: list[tuple[int, str]], names: dict[str, str], y: str = "y") -> DataFrame:
    """MAE of every usable equation in one scan: ``(id, ord, mae)``; texts that do not parse are skipped."""
    cols = []
    for i, (ident, text) in enumerate(equations):
        try:
            cols.append((i, ident, formula_column(text, names)))
        except (ValueError, SyntaxError):
            continue
    if not cols:
        raise ValueError("no usable equation")
    # a prediction missing in any row disqualifies the equation
    one = df.agg(*[F.when(F.count(c) == F.count(y), F.avg(F.abs(F.col(y) - c))).alias(f"m{i}") for i, _, c in cols])
    bad = [F.struct(F.lit(ident).alias("id"), F.lit(i).alias("ord"), F.col(f"m{i}").alias("mae")) for i, ident, _ in cols]
    return one.select(F.explode(F.array(*bad)).alias("e")).select("e.*")


def best_equation(df: DataFrame, equations: list[tuple[int, str]], names: dict[str, str], y: str = "y") -> DataFrame:
    """Equation of least MAE; NaN errors are ignored and the first one wins ties."""
    e = equation_errors(df, equations, names, y).filter(F.col("mae").isNotNull() & ~F.isnan("mae"))
    return e.agg(F.min_by("id", F.struct("mae", "ord")).alias("id"), F.min("mae").alias("mae"))


def evaluation_long(train_test: DataFrame, node_count: int, tree_depth: int) -> DataFrame:
    """Long ``metric, value`` table from the per-dataset metrics, with complexity rows."""
    long = train_test.unpivot(["dataset"], ["r2", "rmse", "mae", "mape", "mse"], "m", "value").select(
        F.concat_ws("_", "dataset", "m").alias("metric"), "value")
    test_r2 = train_test.filter("dataset = 'test'").select(
        F.explode(F.array(
            F.struct(F.lit("node_count").alias("metric"), F.lit(float(node_count)).alias("value")),
            F.struct(F.lit("tree_depth").alias("metric"), F.lit(float(tree_depth)).alias("value")),
            F.struct(F.lit("r2_per_node").alias("metric"), ((F.col("r2") / node_count) if node_count > 0 else F.lit(0.0)).alias("value")),
        )).alias("e")).select("e.metric", "e.value")
    return long.unionByName(test_r2)


def chart_ranges(df: DataFrame, key: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Identity-line range of a predicted-versus-true chart."""
    return df.groupBy(*key).agg(F.least(F.min(y), F.min(pred)).alias("lo"), F.greatest(F.max(y), F.max(pred)).alias("hi"), F.count("*").alias("n"))


# ---------------------------------------------------------------- fitted family

def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    import numpy as np

    return [float(v) for v in np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]]


def fitted_family(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Least-squares members of a fixed family, from one pass of sums: ``complexity, loss, equation`` rows.

    constant, Σx, Σx+c, k·Σx, Σw·x. Only the (n+2)² sums reach the driver.
    """
    n = len(xs)
    cols = [F.col(x).cast("double") for x in xs] + [F.col(y).cast("double")]
    aggs = [F.count("*").alias("c")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]
    r = df.agg(*aggs).first()
    cnt, sy, syy = float(r["c"]), r[f"s{n}"], r[f"p{n}_{n}"]
    sx = sum(r[f"s{i}"] for i in range(n))
    sxx = sum(r[f"p{min(i, j)}_{max(i, j)}"] for i in range(n) for j in range(n))
    sxy = sum(r[f"p{i}_{n}"] for i in range(n))
    total = "(" + " + ".join(f"x{i}" for i in range(n)) + ")"
    mean, shift, k = sy / cnt, (sy - sx) / cnt, sxy / sxx
    w = _solve([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], [r[f"p{i}_{n}"] for i in range(n)])
    wxy = sum(w[i] * r[f"p{i}_{n}"] for i in range(n))
    wxx = sum(w[i] * w[j] * r[f"p{min(i, j)}_{max(i, j)}"] for i in range(n) for j in range(n))
    rows = [
        (1, syy / cnt - mean * mean, f"{mean!r}"),
        (2 * n - 1, (syy - 2 * sxy + sxx) / cnt, total),
        (2 * n + 1, (syy - 2 * sxy + sxx) / cnt - shift * shift, f"{total} + {shift!r}"),
        (2 * n + 1, (syy - 2 * k * sxy + k * k * sxx) / cnt, f"{total} * {k!r}"),
        (4 * n - 1, (syy - 2 * wxy + wxx) / cnt, " + ".join(f"x{i} * {w[i]!r}" for i in range(n))),
    ]
    return df.sparkSession.createDataFrame(rows, "complexity int, loss double, equation string")


def pareto(table: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Least loss per complexity, kept only when it is below every simpler one."""
    key = key or []
    best = table.groupBy(*key, "complexity").agg(F.min("loss").alias("loss"), F.min_by("equation", "loss").alias("equation"))
    # complexities are few (at most the size limit of the search), also without a key
    w = Window.partitionBy(*key).orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_b", F.min("loss").over(w)).filter(F.col("_b").isNull() | (F.col("loss") < F.col("_b"))).drop("_b")

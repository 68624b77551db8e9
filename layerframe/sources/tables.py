"""CSV result sinks and sources with fixed column orders and decimals."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..iterate import cut
from ..operators.regress import metric_aggs

# Column orders and decimals of the result files.
STACKING_COLUMNS = [
    "folder", "img0", "img1", "ok", "class", "is_flip", "handedness_0", "handedness_1", "theta_deg", "theta_method",
    "origin0_512", "origin1_512", "da0_512", "db0_512", "da1_512", "db1_512", "da_mean_512", "db_mean_512", "reason",
]
INTERLAYER_COLUMNS = [
    "folder", "img0", "img1", "sideA_A", "stacking_csv", "stacking_atoms_dir", "stacking_theta_deg", "stacking_theta_method", "class", "reason", "is_flip",
    "n0", "n1", "da0_x", "da0_y", "db0_x", "db0_y", "da1_x", "da1_y", "db1_x", "db1_y", "shift_px_x", "shift_px_y", "shift_A_x", "shift_A_y",
    "shift_align_score", "ab0_raw_a", "ab0_raw_b", "ab1_raw_a", "ab1_raw_b", "ab_mean_raw_a", "ab_mean_raw_b", "ab_mean_reduced_a", "ab_mean_reduced_b",
    "twist_fine_deg", "twist_score",
]
INTERLAYER_DECIMALS = {"sideA_A": 4, "stacking_theta_deg": 6, "shift_px_x": 3, "shift_px_y": 3, "shift_A_x": 4, "shift_A_y": 4}
SEGMENTATION_COLUMNS = ["image_path", "physical_size_nm", "original_pixels", "processing_pixels", "output_pixels", "scale_factor", "instance_count", "extraction_mode"]
MERGE_COLUMNS = ["subfolder", "base_name", "physical_size_nm", "output_pixels", "scale_factor", "mask0_instances", "mask1_instances"]
RESIDUAL_COLUMNS = ["iter", "shift_h", "shift_w", "shift_index", "t", "t_next", "lambda_t", "k", "k_mode", "residual_abs_mean", "adaptive"]
CHUNK_BITS = 16  # lines of a table that are numbered from one offset
GRAY_COLUMNS = {2: ["x", "y", "layer1_gray", "layer2_gray", "bilayer_gray"], 3: ["x", "y", "layer1_gray", "layer2_gray", "layer3_gray", "trilayer_gray"]}


def text_column(df: DataFrame, name: str, decimals: int = 6) -> Column:
    """CSV text of a column: fixed decimals for doubles, 0/1 for booleans, [x, y] for vectors, blank for null."""
    if name not in df.columns:
        return F.lit("").alias(name)
    t = df.schema[name].dataType
    c = F.col(name)
    if isinstance(t, T.DoubleType):
        out = F.format_string(f"%.{decimals}f", c)
    elif isinstance(t, T.BooleanType):
        out = F.when(c, "1").otherwise("0")
    elif isinstance(t, T.StructType):
        out = F.concat(F.lit("["), c["x"].cast("string"), F.lit(", "), c["y"].cast("string"), F.lit("]"))
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "").otherwise(out).alias(name)


def csv_frame(df: DataFrame, columns: list[str], decimals: dict[str, int] | None = None) -> DataFrame:
    """Fixed column order, missing columns blank."""
    return df.select(*[text_column(df, c, (decimals or {}).get(c, 6)) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], decimals: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    csv_frame(df, columns, decimals).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def read_gray_tables(spark: SparkSession, folder: str, layers: int = 2) -> DataFrame:
    """All ``gray_values_*.csv`` of a folder with ``source_image`` and ``pixel_index``; files lacking a column are left out.

    Headers are compared in one pass over the first line of every file, so files of different schema can
    share the folder.
    """
    need = GRAY_COLUMNS[layers][2:]
    glob = os.path.join(folder, "gray_values_*.csv")
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    first = lines.filter("b = 0").groupBy("f").agg(F.min("m").alias("m"))
    cols = F.transform(F.split("header", ","), lambda c: F.trim(c))
    # one row per file
    head = cut(lines.filter("b = 0").join(first, ["f", "m"]).select("f", F.col("value").alias("header")))
    ok = head.filter(F.size(F.array_intersect(cols, F.array(*[F.lit(c) for c in need]))) == len(need)).withColumn("pos", cols).select("f", "header", "pos")
    if ok.isEmpty():
        raise ValueError(f"no gray-value table with {need} in {folder}")
    # ids of one split and chunk are consecutive, so a line's number is its distance from the first one of its chunk, plus the
    # rows of the chunks before, less the headers in between: one row per chunk is ordered, and no line is sorted or sent
    body = lines.join(ok, "f").withColumn("c", F.shiftright("m", CHUNK_BITS))
    is_head = F.col("value") == F.col("header")
    n = body.groupBy("f", "b", "c").agg(F.min("m").alias("start"), F.count(F.when(~is_head, 1)).alias("n"))
    before = Window.partitionBy("f").orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)
    heads = body.filter(is_head).groupBy("f", "b", "c").agg(F.array_sort(F.collect_list("m")).alias("heads"))
    chunks = n.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).join(heads, ["f", "b", "c"], "left").select("f", "b", "c", "start", "off", "heads")
    parts = F.split("value", ",")
    val = [F.get(parts, F.array_position("pos", c).cast("int") - 1).try_cast("double").alias(c) for c in need]
    passed = F.coalesce(F.size(F.filter("heads", lambda h: h < F.col("m"))), F.lit(0))
    index = F.col("off") + F.col("m") - F.col("start") - F.when(F.col("heads").isNull(), 0).otherwise(passed)
    return body.filter(~is_head).join(cut(chunks), ["f", "b", "c"]).select(*val, F.col("f").alias("source_image"), index.cast("bigint").alias("pixel_index"))


def prediction_sheets(df: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a prediction export: train rows, test rows, and per dataset the sample count and the metrics."""
    err = F.abs(F.col("y") - F.col("pred"))
    full = df.withColumn("abs_error", err).withColumn("rel_error", F.when(F.col("y") != 0, err / F.abs("y")))
    metrics = full.groupBy("dataset").agg(*metric_aggs(F.col("y"), F.col("pred")))
    summary = metrics.select("dataset", F.col("n").alias("sample_count"), "r2", "rmse", "mae", F.col("mape").alias("mape_percent"), "mse")
    return {"train": full.filter("dataset = 'train'"), "test": full.filter("dataset = 'test'"), "summary": summary}


def union_growing(frames: list[DataFrame]) -> DataFrame:
    """Logs whose key set grows: absent columns are back-filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def log_rows(long: DataFrame, run: list[str] | None = None, seq: list[str] | None = None) -> DataFrame:
    """Long key/value log -> one row per step with ``values``, a map from key to value: any key set, none collected.

    Of a key logged again in a step the row that ``seq`` orders last wins; without ``seq`` the largest value.
    """
    run = run or ["run", "step"]
    value = F.max_by("value", F.struct(*seq)) if seq else F.max("value")
    one = long.groupBy(*run, "key").agg(value.alias("value"))
    return one.groupBy(*run).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("values"))  # one entry per key


def append_log(rows: DataFrame, path: str) -> None:
    """Append a batch of log rows whose columns may differ from those written before."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All batches of :func:`append_log`; columns that a batch did not have are null in its rows, as if back-filled.

    The schemas are merged from the file footers by tasks; no data row is read for it.
    """
    return spark.read.option("mergeSchema", True).parquet(path)


def pivot_log(long: DataFrame, keys: list[str] | None = None, run: list[str] | None = None, seq: list[str] | None = None) -> DataFrame:
    """Long key/value log -> one row per step with a column per key.

    Without ``keys`` the key set becomes the schema and is collected for it; :func:`log_rows` has no such step.
    Of a key logged again in a step the row that ``seq`` orders last wins; without ``seq`` the largest value.
    """
    run = run or ["run", "step"]
    g = long.groupBy(*run)
    return (g.pivot("key", keys) if keys else g.pivot("key")).agg(F.max_by("value", F.struct(*seq)) if seq else F.max("value"))

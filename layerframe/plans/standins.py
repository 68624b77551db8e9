"""Views of the driver tables in the shapes the operators expect, in Spark and in SQL.

The tables hold no images; every adapter below maps whole tables (see FIXTURES, section 5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def img(spark: SparkSession, d: str) -> DataFrame:
    """8×8 images, one per embedding row."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("image_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), F.col("e").cast("double").alias("v"))


IMG = """img AS (SELECT vec_id AS image_id, (i-1) % 8 AS x, (i-1) // 8 AS y, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"""


def gray(spark: SparkSession, d: str) -> DataFrame:
    """Same images on a 0..255 gray scale."""
    return img(spark, d).withColumn("v", F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128.0 + 400.0 * F.col("v"))))


GRAY = IMG + """,
gray AS (SELECT image_id, x, y, least(255.0, greatest(0.0, 128.0 + 400.0 * v)) AS v FROM img)"""


def mask(spark: SparkSession, d: str) -> DataFrame:
    """Foreground = above 1.05 × the image mean of the gray scale."""
    from ..operators.pixels import threshold_mean

    return threshold_mean(gray(spark, d), 1.05).filter("fg").select("image_id", "x", "y")


MASK = GRAY + """,
mask AS (SELECT image_id, x, y FROM (SELECT *, avg(v) OVER (PARTITION BY image_id) AS m FROM gray) WHERE v > m * 1.05)"""


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Stacks of two layers: images 2k and 2k+1 form stack k; gray scale 0..1."""
    g = gray(spark, d)
    return g.select(F.floor(F.col("image_id") / 2).cast("bigint").alias("image_id"), (F.col("image_id") % 2).cast("int").alias("layer"),
                    "x", "y", (F.col("v") / 255.0).alias("v"))


LAYERS = GRAY + """,
layers AS (SELECT image_id // 2 AS image_id, CAST(image_id % 2 AS INT) AS layer, x, y, v / 255.0 AS v FROM gray)"""


def stacks(spark: SparkSession, d: str) -> DataFrame:
    """Stack target next to the two layers, on the 0..255 scale: y = 0.9·(l1+l2) with a per-pixel ripple."""
    g = gray(spark, d).withColumn("stack", F.floor(F.col("image_id") / 2).cast("bigint"))
    p = g.groupBy("stack", "x", "y").agg(
        F.max(F.when(F.col("image_id") % 2 == 0, F.col("v"))).alias("l1"),
        F.max(F.when(F.col("image_id") % 2 == 1, F.col("v"))).alias("l2"),
    )
    ripple = (F.col("x") * 3 + F.col("y") * 5) % 7
    return p.withColumn("t", 0.45 * (F.col("l1") + F.col("l2")) + ripple).filter("l1 is not null and l2 is not null")


STACKS = GRAY + """,
stacks AS (SELECT stack, x, y, l1, l2, 0.45 * (l1 + l2) + (x * 3 + y * 5) % 7 AS t FROM (
  SELECT image_id // 2 AS stack, x, y, max(CASE WHEN image_id % 2 = 0 THEN v END) AS l1,
         max(CASE WHEN image_id % 2 = 1 THEN v END) AS l2 FROM gray GROUP BY ALL)
  WHERE l1 IS NOT NULL AND l2 IS NOT NULL)"""


def pts(spark: SparkSession, d: str) -> DataFrame:
    """Point clouds: sample = label, layer = parity of the id, coordinates = first two components × 512."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("label").alias("sample"), (F.col("vec_id") % 2).cast("int").alias("layer"), F.col("vec_id").alias("pt_id"),
        (F.col("embedding")[0].cast("double") * 512).alias("x"), (F.col("embedding")[1].cast("double") * 512).alias("y"),
    )


PTS = """pts AS (SELECT label AS sample, CAST(vec_id % 2 AS INT) AS layer, vec_id AS pt_id,
  CAST(embedding[1] AS DOUBLE) * 512 AS x, CAST(embedding[2] AS DOUBLE) * 512 AS y FROM embeddings)"""


def lattice_atoms(spark: SparkSession, d: str) -> DataFrame:
    """One rhombic crystal patch per embedding row: 16 cells of four atoms, jittered by the 64 components.

    128-px coordinates; orientation from the label, so that samples differ.
    """
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("p", "e"))
    cell = F.floor(F.col("p") / 4)
    corner = F.col("p") % 4
    i, j = cell % 4, F.floor(cell / 4)
    # cell vectors about 29.36 and 30.28 px at 120 degrees, rhombus of side 12.6 px
    ux = 20.0 + i * 25.43 + corner_offset(corner, "x")
    uy = 10.0 + j * 30.28 + i * (-14.68) + 44.0 + corner_offset(corner, "y")
    a = F.radians(F.col("label").cast("double") * 1.5)
    dx, dy = ux - 64.0, uy - 64.0
    # a smooth deterministic jitter, different on the two axes
    jx, jy = 1.2 * F.col("e").cast("double"), -0.9 * F.col("e").cast("double")
    return e.select(
        "sample", F.col("p").cast("bigint").alias("pt_id"),
        (64.0 + dx * F.cos(a) - dy * F.sin(a) + jx).alias("x"), (64.0 + dx * F.sin(a) + dy * F.cos(a) + jy).alias("y"),
    )


def corner_offset(corner, axis: str):
    vals = {"x": (0.0, 10.9, 10.9, 0.0), "y": (0.0, -6.3, 6.3, 12.6)}[axis]
    out = F.lit(vals[3])
    for k in (2, 1, 0):
        out = F.when(corner == k, vals[k]).otherwise(out)
    return out


LATTICE_ATOMS = """lat_raw AS (SELECT vec_id AS sample, label, i-1 AS p, CAST(embedding[i] AS DOUBLE) AS e
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
lat_u AS (SELECT sample, p, e, radians(CAST(label AS DOUBLE) * 1.5) AS a,
  20.0::DOUBLE + ((p // 4) % 4) * 25.43::DOUBLE + (CASE p % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 10.9 WHEN 2 THEN 10.9 ELSE 0.0 END)::DOUBLE - 64 AS dx,
  10.0::DOUBLE + ((p // 4) // 4) * 30.28::DOUBLE + ((p // 4) % 4) * (-14.68)::DOUBLE + 44
    + (CASE p % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -6.3 WHEN 2 THEN 6.3 ELSE 12.6 END)::DOUBLE - 64 AS dy FROM lat_raw),
atoms AS (SELECT sample, p AS pt_id, 64 + dx * cos(a) - dy * sin(a) + 1.2::DOUBLE * e AS x,
  64 + dx * sin(a) + dy * cos(a) - 0.9::DOUBLE * e AS y FROM lat_u)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Regression rows: list price of a line against its discounted and rounded value."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"),
        (F.col("l_quantity") * 2.0).alias("x0"), (F.col("l_extendedprice") / 1000.0).alias("x1"),
        (F.col("l_quantity") * 1.9 + F.col("l_extendedprice") / 1020.0 + F.col("l_tax") * 10).alias("y"),
        F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("dataset"),
    )


PAIRS = """pairs AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, l_quantity * 2.0::DOUBLE AS x0, l_extendedprice / 1000.0::DOUBLE AS x1,
  l_quantity * 1.9::DOUBLE + l_extendedprice / 1020.0::DOUBLE + l_tax * 10 AS y,
  CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS dataset FROM lineitem)"""


def uniform(seed: int, *cols: str) -> str:
    """SQL of `hash_uniform`."""
    return f"(('0x' || substr(md5(concat_ws('/', {', '.join([str(seed), *cols])})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(seed: int, *cols: str) -> str:
    """SQL of `hash_normal`."""
    return f"(sqrt(-2.0 * ln(greatest({uniform(seed, *cols)}, 1e-300::DOUBLE))) * cos(2.0 * pi() * {uniform(seed + 7919, *cols)}))"


def log(spark: SparkSession, d: str) -> DataFrame:
    """Training log: run = user, step = event id, key = event type."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value", "ts")


LOG = "log AS (SELECT user_id AS run, event_id AS step, event_type AS key, value, ts FROM events)"

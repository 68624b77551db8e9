"""Source configurations, manifests and snapshots as JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schema and defaults of a source configuration.
RAW_SCHEMA = """material STRING, num INT, seed BIGINT, structure_path STRING, output_dir STRING, image_size STRING, incostem_exclude_symbols ARRAY<STRING>,
 simulator STRUCT<defocus_A: STRING, source_size_A: STRING, thermal_displacement_A: STRING>,
 defect_presets ARRAY<STRUCT<name: STRING, rates: MAP<STRING, DOUBLE>, weight: DOUBLE>>, defects ARRAY<STRUCT<symbol: STRING, rates: STRING, rate: STRING>>"""
DEFAULTS = {"material": "ReS2", "num": 1, "defocus_A": 35.0, "source_size_A": 0.6, "thermal_displacement_A": 0.0}
MANIFEST_SCHEMA = """file STRING, material STRING, image_size STRUCT<width: INT, height: INT>, thermal_displacement_A DOUBLE, thermal_displacement_weight DOUBLE, defocus_A DOUBLE,
 source_size_A DOUBLE, defect_preset STRING, defect_preset_weight DOUBLE, defect_rates MAP<STRING, DOUBLE>"""


def float_list(raw: Column, default: float) -> Column:
    """Number or list of numbers in text form -> array; absent or empty -> the default."""
    one, many = raw.try_cast("double"), F.from_json(raw, "array<double>")
    return F.when(raw.isNull(), F.array(F.lit(default))).when(one.isNotNull(), F.array(one)).when(F.size(many) > 0, many).when(F.size(many) == 0, F.array(F.lit(default)))


def weighted_list(raw: Column, default: float) -> Column:
    """Number, list of numbers or list of {value, weight} -> array of (value, weight); missing weights are 1."""
    one = raw.try_cast("double")
    items = F.from_json(raw, "array<string>")

    def item(s: Column) -> Column:
        obj = F.from_json(s, "struct<value:double,weight:double>")
        return F.struct(F.coalesce(s.try_cast("double"), obj["value"]).alias("value"), F.coalesce(obj["weight"], F.lit(1.0)).alias("weight"))

    single = lambda v: F.array(F.struct(v.cast("double").alias("value"), F.lit(1.0).alias("weight")))
    return F.when(raw.isNull() | (F.size(items) == 0), single(F.lit(default))).when(one.isNotNull(), single(one)).otherwise(F.transform(items, item))


def parse_configs(raw: DataFrame) -> DataFrame:
    """Typed configuration rows from raw JSON rows of :data:`RAW_SCHEMA` (plus ``path``)."""
    size = F.col("image_size")
    obj = F.from_json(size, "struct<width:int,height:int>")
    n = size.try_cast("int")
    preset = lambda p: F.struct(
        F.coalesce(F.nullif(F.trim(p["name"]), F.lit("")), F.nullif(F.array_join(F.transform(F.sort_array(F.map_entries(p["rates"])), lambda e: F.concat(e["key"], e["value"].cast("string"))), ","), F.lit("")), F.lit("clean")).alias("name"),
        F.coalesce(p["rates"], F.create_map().cast("map<string,double>")).alias("rates"), F.coalesce(p["weight"], F.lit(1.0)).alias("weight"))
    clean = F.array(F.struct(F.lit("clean").alias("name"), F.create_map().cast("map<string,double>").alias("rates"), F.lit(1.0).alias("weight")))
    legacy_rates = F.map_from_entries(F.transform("defects", lambda x: F.struct(F.trim(x["symbol"]).alias("key"), F.get(float_list(F.coalesce(x["rates"], x["rate"]), 0.0), 0).alias("value"))))
    legacy = F.array(F.struct(F.lit("legacy").alias("name"), legacy_rates.alias("rates"), F.lit(1.0).alias("weight")))
    presets = F.when(F.size("defect_presets") > 0, F.transform("defect_presets", preset)).when(F.col("defect_presets").isNull() & (F.size("defects") > 0), legacy).otherwise(clean)
    s = F.col("simulator")
    metadata = F.col("metadata") if "metadata" in raw.columns else F.lit("{}")
    return raw.select(
        "path", F.coalesce("material", F.lit(DEFAULTS["material"])).alias("material"), F.coalesce("num", F.lit(DEFAULTS["num"])).alias("num"), "seed", "structure_path",
        F.struct(F.coalesce(n, obj["width"]).alias("width"), F.coalesce(n, obj["height"]).alias("height")).alias("image_size"),
        float_list(s["defocus_A"], DEFAULTS["defocus_A"]).alias("defocus_A"), float_list(s["source_size_A"], DEFAULTS["source_size_A"]).alias("source_size_A"),
        weighted_list(s["thermal_displacement_A"], DEFAULTS["thermal_displacement_A"]).alias("thermal_displacement_A"), presets.alias("defect_presets"),
        F.when(F.startswith(F.ltrim(metadata), F.lit("{")), metadata).otherwise("{}").alias("metadata"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", True).json(path)
    return parse_configs(raw.withColumn("path", F.col("_metadata.file_name")))


def config_problems(cfg: DataFrame) -> DataFrame:
    """One row per violated rule."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, e: x + e["weight"])
    rules = [
        ("num must be positive", F.col("num") <= 0), ("image size must be positive", ~((F.col("image_size.width") > 0) & (F.col("image_size.height") > 0)) | F.col("image_size.width").isNull()),
        ("negative thermal weight", F.exists("thermal_displacement_A", lambda e: e["weight"] < 0)), ("thermal weights sum to zero", total(F.col("thermal_displacement_A")) <= 0),
        ("negative preset weight", F.exists("defect_presets", lambda e: e["weight"] < 0)), ("preset weights sum to zero", total(F.col("defect_presets")) <= 0),
        ("defocus is not a number or list", F.col("defocus_A").isNull()), ("thermal entry is not a number", F.exists("thermal_displacement_A", lambda e: e["value"].isNull())),
    ]
    return cfg.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in rules]))).alias("problem"))


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def snapshot(cfg: DataFrame) -> DataFrame:
    """Configuration snapshot record as JSON text; metadata that is no JSON object counts as an empty one."""
    return cfg.select("path", F.to_json(F.struct(F.col("path").alias("source_config"), "material", "num", "image_size", F.lit("mask.png").alias("mask_path"), F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))).alias("metadata"))).alias("text"))

"""From documents to training shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes every
result to the shared checkpoint folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.iterate import cut
from layerframe.llm import decontaminate, language, mixing, setsketch, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: mixture inference by expectation-maximisation is not expressible; tests/llm has a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language (no text, or no letter in it) go."""
    model = language.train(docs, language.fold(F.col("doc_id")) == 0)
    return language.predict(docs.select(*COLUMNS), model, keep=tuple(COLUMNS)).filter("lang_pred <> 'und'").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts stays, whether its rows have ids or not: that with the
    smallest id, then with the smallest hash of its text, then one of the equal rows. Texts without words all stay."""
    rows = cut(docs.select(*COLUMNS).withColumns({"row": F.monotonically_increasing_id(), "node": F.xxhash64("text")}))
    texts = rows.groupBy("node").agg(F.first("text").alias("text")).withColumnRenamed("node", "doc_id")
    groups = setsketch.near_duplicates(texts).select(F.col("doc_id").alias("node"), "component_id", "n_shingles")
    placed = cut(rows.select("row", "doc_id", "node").join(groups, "node"))
    first = placed.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "row")).alias("first"))
    stay = first.select("first.row").unionAll(placed.filter("n_shingles = 0").select("row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, or up to three times."""
    return mixing.apply_mix(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES = [("language_id", identify_language), ("near_dedup", remove_near_duplicates), ("decontamination", remove_contaminated), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

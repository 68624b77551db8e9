"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs on a bounded sample; statistics of host suffixes come from
all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "host_length", "labels", "depth", "path_length", "digit_ratio", "punct_ratio", "entropy", "n_params", "has_fragment", "is_https", "longest_token", "host_digits", "tld_rate", "domain_rate", "first_rate", "tld_seen", "domain_seen", "first_seen")
SEED = 17


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased, the path up to ``?`` or ``#``; empty if there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host or a parent domain and the path's beginning; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {"tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "first": F.concat(F.substring_index(host, ".", -1), F.lit("/"), F.get(F.split(path, "/"), 1))}


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the suffix keys."""
    u, n = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit("")))
    chars = F.split(u, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))
    tokens = F.transform(F.split(u, r"[^A-Za-z0-9]+"), lambda t: F.length(t))
    ratio = lambda part: F.coalesce(F.try_divide(part, n), F.lit(0.0))
    query = F.substring_index(F.when(F.instr(u, "?") > 0, F.substring_index(u, "?", -1)).otherwise(""), "#", 1)
    return urls.withColumns({
        "length": n, "host_length": F.length("host"), "labels": F.size(F.split("host", r"\.")), "depth": F.size(F.array_remove(F.split("path", "/"), "")), "path_length": F.length("path"),
        "digit_ratio": ratio(F.length(F.regexp_replace(u, "[^0-9]", ""))), "punct_ratio": ratio(F.length(F.regexp_replace(u, "[A-Za-z0-9]", ""))), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": F.size(F.array_remove(F.split(query, "&"), "")), "has_fragment": (F.instr(u, "#") > 0).cast("int"), "is_https": F.startswith(u, F.lit("https://")).cast("int"),
        "longest_token": F.array_max(tokens), "host_digits": F.length(F.regexp_replace("host", "[^0-9]", "")), **{f"_{k}": F.coalesce(c, F.lit("")) for k, c in _suffixes(F.col("host"), F.col("path")).items()},
    })


def _with_rates(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds smoothed share of blocked URLs and log count of the labelled URLs with the same suffix."""
    for k in ("tld", "domain", "first"):
        stats = labelled.groupBy(f"_{k}").agg(((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias(f"{k}_rate"), F.log1p(F.count("*")).alias(f"{k}_seen"))
        urls = urls.join(stats, f"_{k}", "left").withColumns({f"{k}_rate": F.coalesce(f"{k}_rate", F.lit(0.5)), f"{k}_seen": F.coalesce(f"{k}_seen", F.lit(0.0))})
    return urls


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, sample_rows: int = 20_000, trees: int = 12, depth: int = 4) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` per row of ``pages(page_id, url)``.

    ``labelled(url, label)``, 1 for block: the training set; by default the URLs of ``pages`` that a
    rule decides. The trees see the rows whose URL hash lies below a threshold set for about
    ``sample_rows`` of them (all, if there are no more). ``block_probability`` is null where a rule
    decides. Without labels of both kinds the only kind known is the verdict, ``allow`` if there is none.
    A null url, or one without ``://``, has empty host and path and is judged by the trees.
    Repeated rows get equal verdicts; other columns are not read.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = lexical(split.withColumns({"rule": rule, "ruled": verdict}))
    if labelled is None:
        known = ruled.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("int"))
    else:
        known = lexical(labelled.select("url", F.col("label").cast("int").alias("label")).filter("label is not null").withColumns({"host": host, "path": path}))
    n, blocked = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < blocked < n:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if n else "allow") if blocked else F.lit("allow")).alias("verdict"), F.when(F.col("ruled").isNull(), F.lit(1.0 if blocked else 0.0)).alias("block_probability"))
    share = min(1.0, sample_rows / n)
    sample = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(_with_rates(sample, known)).select("features", F.col("label").cast("double"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED, maxBins=32).fit(train)
    scored = model.transform(assemble.transform(_with_rates(ruled, known)))
    p = F.when(F.col("ruled").isNull(), vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("block_probability"))

"""Quality rules by robust multivariate outliers.

Every text gets a vector of transformed statistics. Per language and source (small groups: per language,
or over all documents) the minimum covariance determinant is approached by concentration steps: from a robust start, mean and covariance of the
half with the smallest Mahalanobis distances are estimated again and again until the determinant no
longer falls. Documents far from the final estimate are rejected.

Statistics are fixed-point integers, so sums do not depend on the order of rows and reruns agree. The
half is cut at a bin edge of the distance histogram, which needs no ranking of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SCALE = 10_000
#: feature: least standard deviation, in units of the feature, so that a constant statistic has a finite distance
FEATURES = {"length": 0.5, "word_length": 0.1, "symbols": 0.2, "dup_lines": 0.5, "repeats": 0.5}
P = len(FEATURES)
#: chi-square quantile of 5 degrees of freedom at 1 - 1e-7, and the factor that makes the half-sample covariance consistent
LIMIT = 41.0
CONSISTENCY = 1.9
HALF, LEAST_GROUP, STEPS = 0.5, 30, 30
ANY = "any"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array; the first occurrence counts too."""

    def shifted(s: Column) -> Column:
        """Hash before each entry, null before the first."""
        return F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x["h"]))

    def pairs(a: Column) -> Column:
        """The entries from the second on."""
        return F.slice(a, 2, F.size(a))

    def covered(windows: Column) -> Column:
        # sorted by (window, place), equal neighbours are repeats; their places in order cover 3 words each
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.zip_with(
            F.zip_with(s, pairs(s), lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == y["h"]).alias("t"))), shifted(s),
            lambda x, before: F.struct(x["i"].alias("i"), (F.coalesce(x["t"], F.lit(False)) | F.coalesce(x["h"] == before, F.lit(False))).alias("t")),
        )
        places = lambda s: F.sort_array(F.transform(F.filter(twice(s), lambda x: x["t"]), lambda x: x["i"]))
        total = lambda at: F.aggregate(F.zip_with(at, pairs(at), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
        return _let(ordered, lambda s: _let(places(s), total))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, counted)).cast("long")


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` per row.

    Words are runs of non-space characters; null and empty texts have none. Lines are split at newlines
    only; a duplicate line holds a word and equals an earlier line of its text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # one space class, so that words are split at a single character
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    measured = docs.select(
        *keep, F.struct(
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        ).alias("_m"),
    )
    flat = measured.select(*keep, F.col("_m.w.n_words").alias("n_words"), F.col("_m.word_chars").alias("word_chars"), F.col("_m.n_symbols").alias("n_symbols"), F.col("_m.n_dup_lines").alias("n_dup_lines"), F.col("_m.w.n_repeat_words").alias("n_repeat_words"))
    return flat.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> dict[str, Column]:
    """Transformed statistics, rounded to 1 / SCALE."""
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = {
        "length": F.log1p("n_words"), "word_length": F.log1p(F.col("word_chars") / n), "symbols": F.log1p(1000 * F.col("n_symbols") / c),
        "dup_lines": F.log1p(F.col("n_dup_lines")), "repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    }
    return {k: F.round(v * SCALE).cast("long") for k, v in raw.items()}


def _bin(d2: Column) -> Column:
    """Bin of a squared distance: 64 per doubling."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * 64).cast("int")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2`` from the mean and Cholesky factor columns, by forward substitution."""
    out = rows
    for i, f in enumerate(FEATURES):
        value = (F.col(f) / SCALE - F.col(f"mean_{i}"))
        for j in range(i):
            value = value - F.col(f"chol_{i}_{j}") * F.col(f"z_{j}")
        out = out.withColumn(f"z_{i}", value / F.col(f"chol_{i}_{i}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)])).drop(*[f"z_{i}" for i in range(P)])


def _half_sums(scored: DataFrame, share: float = HALF) -> DataFrame:
    """Per group: count ``m``, sums and sums of products of the rows up to the histogram bin of ``d2`` that reaches ``share`` of the group.

    Sums are formed per bin, so one pass over the rows gives the histogram and the half's moments.
    """
    names = list(FEATURES)
    wide = lambda c: c.cast("decimal(20,0)")
    moments = {f"s_{i}": F.col(f) for i, f in enumerate(names)} | {f"ss_{i}_{j}": wide(F.col(names[i]) * F.col(names[j])) for i in range(P) for j in range(i + 1)}
    bins = scored.groupBy("g_lang", "g_source", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("m"), *[F.sum(c).alias(k) for k, c in moments.items()])
    group = Window.partitionBy("g_lang", "g_source")
    before = F.coalesce(F.sum("m").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = bins.withColumns({"before": before, "all": F.sum("m").over(group)}).filter(F.col("before") < F.ceil(F.col("all") * share))
    return lower.groupBy("g_lang", "g_source").agg(F.sum("m").alias("m"), *[F.sum(k).alias(k) if k[1] == "_" else F.sum(k).cast("double").alias(k) for k in moments])


def _estimate(sums: DataFrame) -> DataFrame:
    """Per group: mean, Cholesky factor of the covariance (with the least deviations added) and log determinant."""
    names = list(FEATURES)
    out = sums
    for i in range(P):
        out = out.withColumn(f"mean_{i}", F.col(f"s_{i}") / F.col("m") / SCALE)
    for i, f in enumerate(names):
        for j in range(i + 1):
            cov = CONSISTENCY * (F.col(f"ss_{i}_{j}") / F.col("m") / (SCALE * SCALE) - F.col(f"mean_{i}") * F.col(f"mean_{j}")) + (FEATURES[f] ** 2 if i == j else 0.0)
            for k in range(j):
                cov = cov - F.col(f"chol_{i}_{k}") * F.col(f"chol_{j}_{k}")
            out = out.withColumn(f"chol_{i}_{j}", F.sqrt(F.greatest(cov, F.lit(1e-6))) if i == j else cov / F.col(f"chol_{j}_{j}"))
    log_det = reduce(lambda a, b: a + b, [2 * F.ln(F.col(f"chol_{i}_{i}")) for i in range(P)])
    return out.select("g_lang", "g_source", "m", *[f"mean_{i}" for i in range(P)], *[f"chol_{i}_{j}" for i in range(P) for j in range(i + 1)], log_det.alias("log_det"))


def _start(rows: DataFrame) -> DataFrame:
    """First estimate: median of each statistic (at 1 / 16 steps) and its median absolute deviation, no correlations."""
    group = ["g_lang", "g_source"]
    step = SCALE // 16

    def medians(of: DataFrame, columns: dict[str, Column]) -> DataFrame:
        long = of.select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.floor(c / step)).cast("long").alias("v")) for i, c in enumerate(columns.values())])).alias("x")).select(*group, "x.*")
        counts = long.groupBy(*group, "i", "v").agg(F.count("*").alias("k"))
        w = Window.partitionBy(*group, "i")
        reached = counts.withColumn("upto", F.sum("k").over(w.orderBy("v"))).withColumn("all", F.sum("k").over(w)).filter("2 * upto >= all").groupBy(*group, "i").agg(F.min("v").alias("v"))
        return reached.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, (F.col("v") + 0.5) * step)).alias(f"mid_{i}") for i in range(P)])

    centre = cut(medians(rows, {f: F.col(f) for f in FEATURES}))
    away = rows.join(centre, group)
    spread = medians(away, {f: F.abs(F.col(f) - F.col(f"mid_{i}")) for i, f in enumerate(FEATURES)}).withColumnsRenamed({f"mid_{i}": f"mad_{i}" for i in range(P)})
    both = centre.join(spread, group)
    return both.select(
        *group, *[(F.col(f"mid_{i}") / SCALE).alias(f"mean_{i}") for i in range(P)],
        *[(F.greatest(F.col(f"mad_{i}") / SCALE * 1.4826, F.lit(least)) if i == j else F.lit(0.0)).alias(f"chol_{i}_{j}") for i, least in enumerate(FEATURES.values()) for j in range(i + 1)],
    )


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Concentration steps over ``rows(g_lang, g_source, statistics)`` until no group's determinant falls.

    Returns the estimates with ``converged``; ``steps`` bounds the rounds, which a group that is cut at
    bin edges could otherwise prolong.
    """
    group = ["g_lang", "g_source"]
    now = cut(_start(rows))
    last = None
    for _ in range(steps):
        new = _estimate(_half_sums(_distance(rows.join(now.drop("m", "log_det", "converged"), group))))
        if last is None:
            now = cut(new.withColumn("converged", F.lit(False)))
        else:
            before = last.withColumnsRenamed({c: f"o_{c}" for c in last.columns if c not in group}).drop("o_converged")
            falls = F.col("log_det") < F.col("o_log_det") - 1e-4
            kept = [c for c in last.columns if c not in (*group, "converged")]
            now = cut(new.join(before, group).select(*group, *[F.when(falls, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in kept], (~falls).alias("converged")))
        last = now
        if now.filter(~F.col("converged")).isEmpty():
            break
    return now


def reject_outliers(docs: DataFrame, limit: float = LIMIT, least_group: int = LEAST_GROUP) -> DataFrame:
    """``doc_id, lang, source``, the statistics, ``base_failed, d2, kept`` per row of ``docs(doc_id, text, lang, source)``.

    The estimates come from the documents that pass the base rules. ``kept`` is false if base_failed,
    else whether the squared Mahalanobis distance from the estimate of the row's language and source is
    at most ``limit``. Null languages and sources are groups of their own. Where fewer than
    ``least_group`` documents of a language and source pass, the estimate is that of the language over
    all its sources, and where fewer of the language pass, that of all documents, however few. Repeated
    rows count as often as they occur. Empty table: no rows. Other columns are not read.
    """
    group = ["g_lang", "g_source"]
    named = {f"g_{c}": F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string") for c in ("lang", "source")}
    stats = cut(text_statistics(docs).withColumns(_vector()).withColumns(named))
    passed = stats.filter(~F.col("base_failed")).select(*group, *FEATURES)
    sizes = stats.groupBy(*group).agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    large = F.sum("n").over(Window.partitionBy("g_lang")) >= least_group
    # an estimate is named by (language, source), (language, ANY) or (ANY, ANY); a group's own name is a struct in braces, never ANY
    level = F.when(F.col("n") >= least_group, 0).when(large, 1).otherwise(2)
    levels = cut(sizes.select(*group, level.alias("level")))
    named_by = [F.when(F.col("level") < 2, F.col("g_lang")).otherwise(ANY).alias("e_lang"), F.when(F.col("level") < 1, F.col("g_source")).otherwise(ANY).alias("e_source")]
    used = cut(levels.select(*named_by).distinct())
    every = F.explode(F.array(F.struct("g_lang", "g_source"), F.struct("g_lang", F.lit(ANY).alias("g_source")), F.struct(F.lit(ANY).alias("g_lang"), F.lit(ANY).alias("g_source"))))
    wanted = passed.select(every.alias("g"), *FEATURES).select("g.*", *FEATURES).join(used.toDF(*group), group, "left_semi")
    estimates = robust_estimates(cut(wanted)).drop("m", "log_det", "converged").withColumnsRenamed({"g_lang": "e_lang", "g_source": "e_source"})
    scored = _distance(stats.join(levels.select(*group, *named_by), group).join(estimates, ["e_lang", "e_source"], "left"))
    kept = ~F.col("base_failed") & (F.col("d2") <= limit)
    return scored.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), kept.alias("kept"))

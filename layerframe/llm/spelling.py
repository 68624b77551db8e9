"""Spelling variants by permuterm rotations.

Every word, ended by a terminator, is written down once per rotation. The rotation that starts behind an edited
character reads ``suffix, terminator, prefix, character``: all words that differ only there share its prefix up
to that character, and the word that lacks the character is this prefix as a whole. So one sorted scan of
rotations cut before their last character (and whole rotations) meets all words one replacement, insertion or
deletion apart, in groups of at most one word per letter of the alphabet and one without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut

#: Fixed value: letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends words; no letter, and before all letters.
TERMINATOR = "$"


def _worn(run: Column, mark: Column, every: int) -> Column:
    """``run`` with one code point deleted where ``every`` divides ``mark``."""
    at = F.pmod(mark, F.length(run)).cast("int")
    return F.when(mark % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): words of whole texts, lower-cased in A-Z, with their number of occurrences.

    Every ``every``-th run of letters by crc32 of ``<doc_id>:<run>`` loses a code point (a null doc_id is
    written as nothing). Counts are partial sums per task first, so a frequent word is one row of each task.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    words = runs.select(_worn(F.col("run"), F.crc32(F.concat("doc", F.lit(":"), "run")), every).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, lacks, once, word, n): whole rotations of ``words(word, n)``, and rotations without their last character.

    ``lacks``: the rotation is whole, so its word lacks the edited character. ``once``: the character taken off
    differs from that before it; in a run of equal characters only the deletion of the first one counts, as
    deleting another gives the same word.
    """
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    before, behind = F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, size)
    last, other = F.substring(F.col("word"), F.col("at"), F.lit(1)), F.substring(F.col("word"), F.col("at") - 1, F.lit(1))
    whole = F.struct(F.concat(behind, F.lit(TERMINATOR), before).alias("key"), F.lit(True).alias("lacks"), F.lit(False).alias("once"))
    cut_off = F.struct(
        F.concat(behind, F.lit(TERMINATOR), F.substring(F.col("word"), F.lit(1), F.col("at") - 1)).alias("key"), F.lit(False).alias("lacks"),
        ((F.col("at") == 1) | (last != other)).alias("once"),
    )
    both = F.when(F.col("at") > 0, F.array(whole, cut_off)).otherwise(F.array(whole))
    return at.select("word", "n", F.inline(both))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): number of words at one edit, and the most frequent of them (ties: first in code-point order).

    ``words``: distinct (word, n). Rotations are dealt and sorted by key; a group holds at most one word per
    letter and one more, so nothing is paired: each row looks at the first two of its group. ``near`` is a
    struct (less, word) with less = -n, the least of which is the nearest.
    """
    me, group = F.struct((-F.col("n")).alias("less"), "word"), Window.partitionBy("key")
    scan = group.orderBy("less", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def place(cond: Column, k: int) -> Column:
        return F.nth_value(F.when(cond, me), k, ignoreNulls=True).over(scan)

    lacks, once = F.col("lacks"), F.col("once")
    seen = rotations(words).withColumn("less", -F.col("n")).select(
        "word", "lacks", "once", F.count(F.when(~lacks, 1)).over(group).alias("n_edited"), F.count(F.when(once, 1)).over(group).alias("n_once"), F.count(F.when(lacks, 1)).over(group).alias("n_lacks"),
        place(~lacks, 1).alias("first"), place(~lacks, 2).alias("second"), place(once, 1).alias("longer"), place(lacks, 1).alias("shorter"),
    )
    replaced = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    met = F.when(lacks, F.col("n_once")).otherwise(F.col("n_edited") - 1 + F.when(once, F.col("n_lacks")).otherwise(0))
    least = F.when(lacks, F.col("longer")).otherwise(F.least(replaced, F.when(once, F.col("shorter"))))
    return seen.select("word", met.alias("met"), least.alias("near")).filter("met > 0").groupBy("word").agg(F.sum("met").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, in which no word leads back to itself: the last form reached.

    Each round doubles the distance followed, so rounds are the logarithm of the longest chain; forms at least
    double a count, so a chain of counts below 2**63 has at most 63 steps.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.drop("moved").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.drop("moved")


def group_variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """One row per frequent word: word, n, n_near, form, form_n and root.

    ``form`` is the most frequent word at one edit if it is at least ``ratio`` (2 or more) times as frequent; ``root`` is
    reached by following forms and is the word itself without one. Null and empty texts and an empty table give
    no words; a null doc_id counts as an empty one; repeated rows count as often as they are there. Only doc_id
    and text are read. A text is split whole; its words are rows at once.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms need not end")
    words = cut(count_words(docs, every, least_length, least_count))
    near = near_words(words)
    known = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("near.less") >= ratio * F.col("n"), F.struct(F.col("near.word").alias("form"), (-F.col("near.less")).alias("n"))).alias("to")
    )).select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n"))
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Language identification by multilingual mixture inference.

Hashed byte trigrams of lower-cased letters are counted per language over all labelled texts. A
document is a mixture: expectation-maximisation estimates the share of each language from the
likelihoods its words have under the trigram models, and languages are dropped from the set while
that does not cost more likelihood than the penalty per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as T

BITS = 16
#: Letters, and numbers that are no digits, such as fractions; `has_letter` tells them apart.
_LETTER = re.compile(r"[^\W\d_]")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[0x80:] = True


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows without id count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def _lowered(column: pa.Array) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word, row of each word): trigrams of each word between spaces, in text order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)]
    s, e, rows = T.word_spans(data, bounds, _IN_WORD)
    size = e - s + 2  # one space on either side
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), 32, np.uint32)
    place = np.arange(len(padded)) - np.repeat(begin, size)
    inner = (place > 0) & (place < np.repeat(size, size) - 1)
    padded[inner] = data[(np.repeat(s, size) + place - 1)[inner]]
    word = np.repeat(np.arange(len(s)), size)
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:] if len(padded) else np.zeros(0, np.uint32)
    whole = word[:-2] == word[2:] if len(padded) else np.zeros(0, bool)
    bucket = (code[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return bucket.astype(np.int64), word[:-2][whole] if len(padded) else np.zeros(0, np.int64), rows


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``labelled(text, lang)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                langs = np.array(part.column(1).to_pylist(), object)
                bucket, word, rows = trigrams(_lowered(part.column(0)))
                of = langs[rows[word]] if len(word) else langs[:0]
                for lang in set(langs.tolist()):
                    total[lang] = total.get(lang, 0) + np.bincount(bucket[of == lang], minlength=1 << BITS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])

    return labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of the trigram buckets per language: len(langs) * 2**BITS floats, whatever the corpus."""

    def __init__(self, counts: list[tuple[str, int, int]], smooth: float = 0.5):
        self.langs = sorted({c[0] for c in counts})
        n = np.full((1 << BITS, max(1, len(self.langs))), smooth)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, bucket, c in counts:
            n[bucket, at[lang]] += c
        self.log_p = np.log(n / n.sum(0)).astype(np.float32)

    def shares(self, texts: list[str], rounds: int = 12, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """(share of each language per text, chosen set per text).

        The penalty of one more language is ``penalty * ln(words)``.
        """
        bucket, word, rows = trigrams(texts)
        n, langs = len(texts), len(self.langs)
        at = T.row_bounds(rows, n)
        words = np.diff(at)
        has = np.flatnonzero(words)
        share = np.full((n, langs), 1.0 / max(1, langs))
        chosen = np.ones((n, langs), bool)
        if not len(has) or not langs:
            return share, chosen
        start = T.row_bounds(word, len(rows))[:-1]
        loglik = np.add.reduceat(self.log_p[bucket], start, axis=0).astype(np.float64)
        top = loglik.max(1, keepdims=True)
        lik = np.exp(np.maximum(loglik - top, -60.0))
        first = at[has]

        def fit(active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = active / active.sum(1, keepdims=True)
            for _ in range(rounds):
                joint = lik * np.repeat(pi, words[has], axis=0)
                joint /= joint.sum(1, keepdims=True) + 1e-300
                pi = np.add.reduceat(joint, first, axis=0) / words[has][:, None]
            mixed = (lik * np.repeat(pi, words[has], axis=0)).sum(1)
            return pi, np.add.reduceat(np.log(mixed + 1e-300), first)

        active = np.ones((len(has), langs), bool)
        pi, ll = fit(active)
        cost = penalty * np.log(np.maximum(words[has], 2))
        for _ in range(langs - 1):
            least = np.where(active, pi, np.inf).argmin(1)
            trial = active.copy()
            trial[np.arange(len(has)), least] = False
            trial[active.sum(1) == 1] = active[active.sum(1) == 1]
            if (trial == active).all():
                break
            pi2, ll2 = fit(trial)
            better = (ll2 + cost >= ll) & (active.sum(1) > 1)
            active[better], pi[better], ll[better] = trial[better], pi2[better], ll2[better]
            if not better.any():
                break
        share[has], chosen[has] = pi, active
        return share, chosen


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


PREDICTED = "lang_pred string, score double, langs array<string>"


def train(docs: DataFrame, held_out: Column) -> Model:
    """From text and non-null lang of the rows of ``docs(doc_id, text, lang)`` that are not held out."""
    learned = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return Model([tuple(r) for r in count_trigrams(learned).collect()])  # at most languages * 2**BITS rows


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (with a text column), then PREDICTED.

    ``lang_pred``: the language with the largest share, first by name if equal; ``und`` with score 0 for
    a null text, a text without a letter, or a model without languages. ``langs``: the chosen set, by
    share. A text with letters but no word of [a-z] or beyond ASCII cannot occur: all letters are one or
    the other. Repeated rows get equal results; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*[c for c in keep if c != "text"], "text")
    kept = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            sizes = np.cumsum([len(t or "") for t in b.column(len(kept) - 1).to_pylist()])
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + T.CHUNK_BYTES)))
                part = b.slice(at, end - at)
                at = end
                texts = _lowered(part.column(len(kept) - 1))
                share, chosen = m.shares(texts)
                best = share.argmax(1) if m.langs else np.zeros(len(texts), int)
                letters = [bool(m.langs) and has_letter(t) for t in texts]
                names = [m.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                score = [float(min(1.0, share[i, best[i]])) if ok else 0.0 for i, ok in enumerate(letters)]
                sets = [[m.langs[k] for k in np.argsort(-share[i], kind="stable") if chosen[i, k]] if ok else [] for i, ok in enumerate(letters)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(kept))), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[*kept.names, "lang_pred", "score", "langs"])

    done = out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PREDICTED]))
    return done if "text" in keep else done.drop("text")

"""Hard negatives, spelling variants and BPE against plain versions, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from layerframe.llm import bpe, negatives, spelling
from tools.check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


# --- hard negatives -------------------------------------------------------------------------------


def mined(rows, every=5):
    """Plain version over (vec_id, label, vector) with Python's integers."""
    use = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, a in use:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, lab) for j, lab, v in use if j != i and len(v) == len(a))
        for p, pid in [(-s, j) for s, j, lab in scored if lab == label][:5]:
            fit = [(-s, j) for s, j, lab in scored if lab != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, pid, k, j, p, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")


def run_mine(spark, rows, every=5):
    return sorted(map(tuple, negatives.mine(negatives.quantise(vectors(spark, rows)), F.col("vec_id") % every == 0).collect()))


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    """Several subtrees and anchor blocks; a third of all rows are one vector, so scores tie."""
    monkeypatch.setattr(negatives, "SUBTREE", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(4)), ([0.5, 0.25, 0.0, 0.125] if i % 3 == 0 else (r.integers(-3, 4, 4) / 8).tolist())) for i in range(700)]
    got = run_mine(spark, rows)
    assert len(got) > 500 and got == mined(rows)


def test_hard_negatives_awkward_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(3)), r.normal(size=3).tolist()) for i in range(60)]
    rows += rows[:20]  # repeated rows
    rows += [(5, 1, [0.1, 0.9, 0.3]), (10, 0, [1.0, 0.0, 0.0])]  # ids with a second vector
    rows += [(None, 1, [1.0, 2.0, 3.0]), (100, None, [1.0, 2.0, 3.0]), (105, 1, None), (110, 1, [1.0, None, 2.0]), (115, 1, [1.0, math.nan, 2.0]), (120, 1, [math.inf, 0.0, 0.0])]
    rows += [(130, 1, [1.0, 2.0]), (131, 1, [1.0, 2.0]), (132, 2, [0.7, 1.4]), (135, 1, []), (136, 1, [])]  # other lengths
    assert run_mine(spark, rows) == mined(rows)
    assert run_mine(spark, rows[:1]) == [] and run_mine(spark, []) == []


def test_hard_negatives_beyond_doubles(spark):
    """Scores beyond 2**53 are compared as integers."""
    rows = [(5 * i, i % 2, [2.0**22 + i % 3, 2.0**22 + (i % 4) / 256]) for i in range(12)] + [(1, 0, [1.0, 2.0**22]), (2, 1, [2.0**21, 2.0**21])]
    assert run_mine(spark, rows) == mined(rows)


def test_boxes_bound_inner_products():
    r = np.random.default_rng(5)
    v = r.integers(-50, 50, (700, 6)).astype(float)
    v = v[negatives._str_order(v, negatives.LEAF)]
    row = {"dim": 6, "ids": np.arange(700).tobytes(), "labels": np.zeros(700, int).tobytes(), "vectors": negatives._pack(v)}
    tree = negatives.Tree(row, True)
    a = r.integers(-50, 50, (20, 6)).astype(float)
    least, most = tree.intervals(a)
    for leaf in range(-(-700 // negatives.LEAF)):
        s = np.array([tree.scores(leaf, x) for x in a])
        assert (least[:, leaf] <= s.min(1)).all() and (s.max(1) <= most[:, leaf]).all()
    assert (least[:, -1] == least.min(1)).all() and (most[:, -1] == most.max(1)).all()


# --- spelling variants ----------------------------------------------------------------------------


def variants(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n.get(form[w])))
    return sorted(out)


def run_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = spelling.group_variants(docs)
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect())


def test_spelling_variants(spark):
    """Edits of all kinds, doubled letters, chains of forms, ties, letters beyond ASCII, nulls, repeated rows, a long text."""
    r = random.Random(6)
    base = ["letter", "baaaad", "ÀÿèÖü", "naïve", "straße", "accommodate", "zzzzz"]
    words = []
    for w in base:
        words += [w] * 40
        for _ in range(25):
            k, c = r.randrange(len(w)), r.choice("abétÿz")
            words += [r.choice([w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:]])] * r.choice([3, 3, 6, 12])
    words += ["chains"] * 60 + ["chainst"] * 20 + ["chainsty"] * 5  # a form of a form
    r.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "Letter LETTER letter, straße"), (None, None), (7, ""), (8, "1234 -- ×÷")]
    rows += [(3, rows[3][1])] * 2 + [(99, ("lettre-letter_" * 90000))]
    got = run_variants(spark, rows)
    assert got == variants(rows) and any(x[1] and x[2] != x[1] for x in got) and len(got) > 50


def test_spelling_variants_without_words(spark):
    assert run_variants(spark, [(1, None), (2, "ab cd")]) == [] and run_variants(spark, []) == []


# --- BPE --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    with open(bpe.TOKENIZER, encoding="utf-8") as f:
        return bpe.PrefixEncoder(f.read()), Tokenizer.from_file(bpe.TOKENIZER)


def ids_of(tok, text):
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_the_library(pair):
    mine, tok = pair
    r = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'ll", "0", "12", "<|endoftext|>", "<|endof", "​", "\x85", "\x1c", "�", "࢏", "A", "tion", "-", "...", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 150))) for _ in range(700)]
    texts += ["".join(chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000), r.randrange(0x250)])) for _ in range(30)) for _ in range(500)]
    texts += ["a" * 5000, " " * 3001, "ab" * 2000, "=" * 777]
    for t in texts:
        ids = mine.encode(t)
        assert ids == ids_of(tok, t), repr(t)
        assert mine.decode(ids) == t == tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_every_prefix_has_its_own_last_token(pair):
    """The last tokens that the programme stores are those of encoding each prefix by itself."""
    mine, _ = pair
    word = b"internationalisation"
    for k in range(1, len(word) + 1):
        ids = mine.word(word[:k])
        assert b"".join(mine.bytes[i] for i in ids) == word[:k] and mine.word(word[:k - mine.length[ids[-1]]]) == ids[:-1]


def test_bpe_breaks_off_ids_it_cannot_place(pair):
    mine, tok = pair
    ids = np.array([220, 1 << 20, 50256, 162, 64], "<u4")
    assert mine.decode(ids.tobytes()) == tok.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_tables(spark, pair):
    mine, tok = pair
    long = "Long words, and “quotes” " * 60000
    rows = [(1, "Hello  world\n", "old"), (1, "Hello  world\n", "old"), (None, None, None), (2, "", "x"), (3, long, None), (None, "<|endoftext|> é", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    coded = bpe.decode_texts(bpe.encode_texts(docs))
    assert sorted(coded.columns) == ["decoded", "doc_id", "text", "token_ids"]
    assert all(r.decoded == (r.text or "") and bytes(r.token_ids) == ids_of(tok, r.text or "") for r in coded.collect())
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(coded).collect())
    want = sorted((i or 0, len(ids_of(tok, t or "")) // 4, hashlib.sha256(ids_of(tok, t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert got == want and bpe.digest(bpe.decode_texts(bpe.encode_texts(docs.limit(0)))).count() == 0


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.PrefixEncoder('{"model": {"type": "Unigram"}, "pre_tokenizer": null, "added_tokens": [], "normalizer": null}')

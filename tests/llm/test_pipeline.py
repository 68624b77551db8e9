"""Registered queries against their SQL, and the pipeline stages against plain versions of each."""

import collections
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
NAMES = ["op1_chat_formatting", "op2_mixing", "op3_sharding", "op6_decontamination"]


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def similar_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(lower))
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in {j for x in sets[a] for j in by[x]} if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.cut(stage(spark, docs, FOLDER))
        kept[name] = before, docs.collect()
    before, after = kept["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after} == set(similar_groups(before).values())
    before, after = kept["decontamination"]
    assert 0 < len(after) < len(before) and set(after) < set(before)
    before, after = kept["mixing"]
    times = collections.Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    before, after = kept["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert all(len(kept[n][1][0]) == 5 for n, _ in corpus_pipeline.STAGES[:-1])


def test_near_duplicates_go_by_row(spark):
    """Rows without id are compared, repeated rows go, and an id with two texts keeps the one that is no copy."""
    text = {k: [f"{k}{i}" for i in range(60)] for k in "abcde"}
    plain = {k: " ".join(w) for k, w in text.items()}
    near = {k: " ".join([*w[:30], "changed", *w[31:]]) for k, w in text.items()}
    rows = [(None, plain["a"]), (None, near["a"]), (None, plain["a"]), (7, plain["b"]), (7, plain["b"]), (1, plain["c"]), (2, near["c"]), (2, plain["d"]), (None, near["d"]), (None, plain["e"]), (9, near["e"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.remove_near_duplicates(spark, docs, FOLDER).collect()
    without_id = [r.text for r in got if r.doc_id is None]
    assert len(without_id) == 1 and without_id[0] in (plain["a"], near["a"])
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(1, plain["c"]), (2, plain["d"]), (7, plain["b"]), (9, near["e"])]

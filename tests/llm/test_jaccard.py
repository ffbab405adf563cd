"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from zonalis.llm import jaccard


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r["doc_id"] for r in out.collect())


def test_edited_copies_go_and_less_similar_texts_stay(spark):
    words = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # 96 shingles; an edit changes 5: J = 91/101, 86/106 = 0.81, 81/111 = 0.73
    rows = [(1, edited()), (2, edited(50)), (3, edited(30, 60)), (4, edited(20, 45, 70, 85)), (5, None), (6, " \n"), (7, "a B"), (8, "A b"), (9, "a c")]
    assert kept(spark, rows) == [1, 4, 5, 7, 9] == jaccard.brute_kept(rows)


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    want = jaccard.brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in out.collect()) == want


@pytest.mark.parametrize("frequent", [4, 1])
def test_large_groups_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(words)
        for at in rng.sample(range(80), rng.choice([0, 1, 1, 2, 3, 5])):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    assert kept(spark, rows) == jaccard.brute_kept(rows)


def near_copies(words, seed=1, every=200):
    rng = np.random.default_rng(seed)
    text = [f"w{i}" for i in rng.integers(0, 50_000, words)]
    other = list(text)
    for i in range(0, words, every):
        other[i] = f"changed{i}"
    return " ".join(text), " ".join(other)


def test_long_near_copies_travel_in_proportion(spark):
    """Bytes of the rows that meet in cells: a histogram goes once to a cell, not with every token."""
    a, b = near_copies(100_000)
    keyed = spark.createDataFrame([(1, a), (2, b)], "key bigint, text string")
    met = jaccard._meetings(jaccard.sketches(keyed).select("sig", "n", "bins", "prefix"), 0.8)
    row = met.selectExpr("sum(coalesce(length(bins), 0)) as bins", "sum(8 + 8 + 8 + 4 + 4) as rest", "count(bins) as k").first()
    assert row["bins"] + row["rest"] < 5 * (len(a) + len(b)) and row["k"] < 40


def test_long_texts_keep_one_of_each_group(spark):
    a, b = near_copies(20_000)
    c, d = near_copies(20_000, 2)
    half = " ".join(a.split()[:10_000] + c.split()[:10_000])
    rows = [(1, a), (2, b), (3, c), (4, d), (5, half), (6, a + " end"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == jaccard.brute_kept(rows) == [1, 3, 5, 7]

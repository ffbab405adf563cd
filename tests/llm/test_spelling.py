"""Spelling variants against all pairs in plain Python, and on awkward rows."""

import re
import zlib
from collections import Counter

import pytest

from zonalis.llm import spelling

DOCS = "doc_id bigint, text string, word string, n bigint, size int, path map<string,string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "word", 1, 2, {"a": "b"}) for i, t in rows], DOCS)


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def brute_words(rows, least_length=6, least=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_groups(words, times=5):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, form[w], root, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_groups_of_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert got(spelling.group_variants(docs)) == want and len(want) > 300


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_near_words_at_any_number_of_hot_chunks(spark, hot):
    stems = ["station", "stations", "nation", "statio", "étation", "stättion", "a", "", "b", "ab", "ba", "aab"]
    words = set(stems)
    for i in range(26):
        words |= {f"prefix{chr(97 + i)}suffix", f"{chr(97 + i)}prefixsuffix", f"prefixsuffix{chr(97 + i)}", f"pre{chr(97 + i)}fixsuffix", f"prefix{chr(97 + i)}{chr(97 + i)}uffix"}
    words = sorted(words)
    rows = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n bigint")
    pairs = [(r["word"], r["other"]) for r in spelling.near_words(rows, hot).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert len(pairs) == len(set(pairs))


def test_chains_of_forms_end_at_their_root(spark):
    chain = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "cccccc": 2, "cccccd": 2}
    rows = spark.createDataFrame(list(chain.items()), "word string, n bigint")
    found = spelling.roots(spelling.forms(rows, spelling.near_words(rows)))
    assert {r["word"]: r["root"] for r in found.collect()} == {w: "abbbbb" if w[0] == "a" else w for w in chain}


def test_awkward_rows(spark):
    long = "Straße " * 3000 + "x" * 50_000
    rows = [(1, None), (2, ""), (3, " 12 "), (4, long), (4, long), (None, "Straßen " * 9), (5, "ÉTATS états " * 7), (6, "ab×cd÷ef " * 6)]
    assert got(spelling.group_variants(frame(spark, rows))) == brute_groups(brute_words(rows))
    assert spelling.group_variants(frame(spark, rows).where("doc_id = 0")).count() == 0
    ties = [(7, "tieaab " * 50 + "tieaac " * 50 + "tieaad " * 5)]
    found = got(spelling.group_variants(frame(spark, ties), slips=0))
    assert found["tieaad"][1:3] == ("tieaab", "tieaab") and found["tieaac"][1] is None

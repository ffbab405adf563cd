"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm import bpe, licenses, lz_fingerprints, mixing, quality_rules, simhash, site_quality, substrings, token_counts, warc
from zonalis.llm.queries import queries, tokenizer_path

BASE = " ".join(f"w{i}" for i in range(90))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w40", "other")), (4, None), (5, ""), (6, "  \t\n "), (7, "a"), (8, "The THE the"),
    (9, "la " * 400), (10, BASE + " " + BASE), (11, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
    (12, "x" * 5000), (13, "é ü \x0b mot"), (14, "cc by cc BY\ngeneral public license"), (14, "cc by cc BY\ngeneral public license"),
    (None, BASE), (15, " ".join(f"z{i % 7}" for i in range(3000))),
]


def frame(spark, rows=None):
    rows = TEXTS if rows is None else rows
    data = [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or ""), 1, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, marks string")


def empty(spark):
    return frame(spark).where("doc_id = -1")


def key(rows):
    return sorted(rows, key=str)


def test_simhash_matches_all_pairs(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(frame(spark, rows)).collect()}
    want = simhash.brute_components(list(dict(rows).items()))
    assert got == {(i, *v) for i, v in want.items()}
    assert simhash.components(frame(spark)).count() == len(TEXTS)
    assert simhash.components(empty(spark)).count() == 0


def test_simhash_links_dense_groups_in_blocks(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(50):
            f = centre
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                f ^= 1 << int(bit)
            fps.add(f - (1 << 64) if f >> 63 else f)
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    from zonalis.operators.graph_components import connected_components

    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for block in (8, 4096):
        found = {r["node"]: r["component"] for r in connected_components(simhash.links(df, block)).collect()}
        assert {f: found.get(f, f) for f in fps} == {f: top(f) for f in fps}


def test_every_anchor_within_two_bits():
    fp = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.int64)
    row, anchor, home = simhash.anchors(fp)
    assert len(row) <= 32 * 50 and home.sum() == 100
    word = np.where(anchor >> 31 & 1, fp[row] >> 32, fp[row]) & 0x7FFFFFFF
    assert (np.bitwise_count((word ^ (anchor & 0x7FFFFFFF)).view(np.uint64)) <= np.where(home, 1, 2)).all()


def test_simhash_keeps_one_of_each_group(spark):
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and None not in ids


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example.com/x?b=1#c", "h" * 200), (2, "http://b.example.com/", "h" * 200), (3, None, None), (4, "http://a.example.com/x?b=1", "short"), (5, "bad url\r\n", "short"), (6, "http://é.example/", "é" * 60), (7, "http://a.example.com/x?b=1", "h" * 200), (7, "http://a.example.com/x?b=1", "h" * 200), (8, "u", "\x1f\x8b\x00" * 90)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload_bytes string")
    got = warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(b) >= 100 and p != first
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert key(map(tuple, got)) == key(want)
    assert warc.archive_and_read(pages.where("page_id < 0")).count() == 0


def test_warc_pages_with_several_payloads(spark):
    a, b, c = "A" * 200, "B" * 200, "C" * 200
    rows = [(5, "u", c), (7, "u", a), (7, "u", b), (7, None, c), (9, "v", a), (10, None, b), (None, "w", a)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r["page_id"], r["payload_digest"]): (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_and_read(pages).collect()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (a, b, c)}
    assert got == {
        (5, digest[c]): ("response", None, 200), (7, digest[a]): ("response", None, 200), (7, digest[b]): ("response", None, 200), (7, digest[c]): ("revisit", 5, 200),
        (9, digest[a]): ("revisit", 7, 200), (10, digest[b]): ("revisit", 7, 200), (None, digest[a]): ("revisit", 7, 200),
    }


def test_warc_index_finds_every_capture(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 40}", "body " * 30 + str(i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/archive", records_per_file=50)
    captures = warc.read_archives(spark, f"file://{tmp_path}/archive").cache()
    index = warc.build_index(captures, f"file://{tmp_path}/index", block_lines=7)
    keys = spark.createDataFrame([(warc.surt(f"http://h1.example.com/p{i}"),) for i in range(45)], "key string")
    found = warc.lookup(index, keys)
    assert {r["page_id"] for r in found.collect()} == {i for i, u, _ in rows if "h1." in u}
    read = {r["page_id"]: r["payload_digest"] for r in warc.fetch(found).collect()}
    assert all(d == hashlib.sha256(rows[i][2].encode()).hexdigest() for i, d in read.items())


def test_surt_and_large_members():
    assert warc.surt("HTTP://WWW.Example.com:80/a/b?q=1#x") == "com,example,www)/a/b?q=1"
    raw = b"\x00" * (1 << 24)
    member = warc._member(raw) + b"\x00"
    assert [(len(r)) for _, _, r in warc._members(io.BytesIO(member * 2))] == [1 << 24] * 2


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = [*TEXTS, (20, "a<|endoftext|>b"), (21, "aaaa " * 300 + "b" * 700), (22, "😀\r\n 123,456 I'll")]
    got = bpe.encode_texts(frame(spark, texts), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert key(map(tuple, got)) == key(want)
    assert bpe.encode_texts(empty(spark), path).count() == 0
    encoded = bpe.encode_texts(frame(spark), path).drop("text")
    assert {r["text"] for r in bpe.decode_texts(encoded, path).collect()} == {t or "" for _, t in TEXTS}


def test_token_counts_equal_greedy_search(spark):
    path = tokenizer_path()
    pieces = token_counts.byte_pieces(path)
    vocabulary, longest = set(pieces), max(map(len, pieces))
    out = token_counts.count_tokens(frame(spark), path)
    want = [(i, len((t or "").encode().split()), sum(token_counts.brute_count(w, vocabulary, longest) for w in (t or "").encode().split())) for i, t in TEXTS]
    assert key(tuple(r) for r in out.select("doc_id", "n_words", "n_tokens").collect()) == key(want)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_automaton_on_a_small_vocabulary():
    vocabulary = [bytes([b]) for b in range(256)] + [b" abc", b"abcd", b"cde", b"bcdef", b"de"]
    automaton = token_counts.Automaton(vocabulary)
    for word in (b"abcdef", b"abcde", b"cdede", b"xabc", b"bcde", b"", b"abcabcd"):
        assert automaton.count(b" " + word) == token_counts.brute_count(word, set(vocabulary), 5)


def test_license_scan(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark)).collect()}
    assert (rows[14]["n_base"], rows[14]["first_word"], rows[14]["last_word"], rows[14]["base_labels"]) == (3, 0, 4, "cc-by,gpl")
    assert rows[11]["labels"] == "apache-2.0,reserved" and rows[11]["base_labels"] == "reserved"
    assert rows[4]["n_words"] == 0 and rows[4]["labels"] == "" and rows[4]["score"] == 0.0 and rows[4]["first_word"] is None
    assert licenses.scan(frame(spark)).count() == len(TEXTS) and licenses.scan(empty(spark)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""


def test_license_notices_across_lines_and_scattered_words(spark):
    scattered = ["word"] * 5000
    for i, w in zip(range(300, 5000, 900), "released under the mit license".split()):
        scattered[i] = w
    rows = [
        (1, MIT), (2, "Licensed under the Apache License,\nVersion 2.0"), (3, "we released the new mit roof tiles under budget and the license plate"), (4, " ".join(scattered)),
        (5, "word " * 500 + MIT.replace("merge", "join") + " word" * 200), (6, "released under mit license"), (7, "# Released\n * under the MIT\n * license."), (8, None),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: "mit", 2: "apache-2.0", 3: "", 4: "", 5: "mit", 6: "", 7: "mit", 8: ""}


def test_license_labels_of_damaged_notices_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    prose = [f"p{i}" for i in range(50)] + ["the", "of", "to", "this", "is", "under", "license", "software", "copy"]
    rows, planted = [], {}
    for i in range(300):
        words = [prose[j] for j in rng.integers(0, len(prose), rng.integers(0, 400))]
        if i % 3:
            notice, label = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
            notice = notice.split()
            for _ in range(i % 4):
                notice[rng.integers(0, len(notice))] = "damaged"
            at = rng.integers(0, len(words) + 1)
            words[at:at] = notice
            planted[i] = label if not i % 4 else None
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)))
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(",")))) for r in licenses.scan(frame(spark, rows)).collect()}
    base = {r["doc_id"]: set(filter(None, r["base_labels"].split(","))) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {i: set(licenses.brute_labels(t)) - base[i] for i, t in rows}
    assert all(label in got[i] | base[i] for i, label in planted.items() if label) and not any(got[i] for i in range(0, 300, 3))


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
COMMONS = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
#: Notices and the labels that the method adds to those of the base phrases.
WHOLE = [
    (GNU.format("General Public License", 3), "gpl,gpl-3.0"), (GNU.format("General Public License", 2), "gpl,gpl-2.0"), (GNU.format("Lesser General Public License", 3), "lgpl"),
    (GNU.format("Affero General Public License", 3), "agpl"), ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"), ("This work is licensed under the GNU Affero General Public License, version 3", ""),
    *[(COMMONS.format(part), label) for part, label in licenses.COMMONS.items()], *[(f"Licensed under CC {label[3:].upper()} 4.0", label) for label in licenses.COMMONS.values()],
    *[(f"// SPDX-License-Identifier: {name}", label) for name, label in licenses.IDENTIFIERS.items()], ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", "cc-by-nc-nd"),
    ("The MIT License (MIT)", "mit"), (MIT, "mit"), ("Apache License\nVersion 2.0, January 2004", "apache-2.0"), ("BSD 3-Clause License", "bsd"), ("BSD 2-Clause License", "bsd"),
]
#: Notices that no template stands for.
OTHERS = [
    MIT.replace("to deal in the", "to deal with the"), "Licensed under the Apache License, Version 1.1", "Licensed under the Eclipse Public License, Version 2.0", "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: LicenseRef-Apache-1.1", "This work is licensed under a Creative Commons Zero 1.0 Universal Deed", "Licensed under the European Union Public Licence, Version 1.2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Boost Software License - Version 1.0 - August 17th, 2003", "licensed under CC BY-XX 4.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "This software is provided 'as-is', without any express or implied warranty.", "SPDX-License-Identifier: CC-BY-XX-4.0",
]


def test_license_families_are_told_apart(spark):
    rows = [(i, "Some words before. " * (i % 3 * 20) + text + " and after it" * 9) for i, (text, _) in enumerate([*WHOLE, *[(t, "") for t in OTHERS]])]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))) for r in licenses.scan(frame(spark, rows)).collect()}
    base = {i: {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in " " + " ".join(licenses._words(t)) + " "} for i, t in rows}
    wrong = {t[:90]: got[i] for i, (t, label) in enumerate([*WHOLE, *[(t, "") for t in OTHERS]]) if got[i] != set(filter(None, label.split(","))) - base[i]}
    assert not wrong


def test_templates_of_any_length_are_found_whole(spark):
    long = " ".join(f"clause{i}" for i in range(700))
    rows = [(i, "lead " * n + long) for i, n in enumerate((0, 1, 95, 96, 500, 874, 875, 900))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, rows), templates=[(long, "long"), ("two words", "two")], deciding={}).collect()}
    assert got == dict.fromkeys(range(8), ("long", 1.0))
    for bad, deciding in (("one", {}), ("a b c", {"a b c": [("x y",)]}), ("a b c d", {"a b c d": [("a b c d",)]})):
        with pytest.raises(ValueError, match="no text can match"):
            licenses.scan(frame(spark), templates=[(bad, "x")], deciding=deciding)


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (i % 50 + 1) ** (3 if i % 97 == 0 else 1), ["a", "b", "c", None][0 if i % 10 < 7 else i % 4]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.repetition_rates(docs).cache()
    per = out.groupBy("source").agg(F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("longest")).collect()
    assert abs(sum(r["t"] for r in per) - 1.5 * sum(r["s"] for r in per)) < 1e-6
    assert all(r["t"] <= 2 * r["s"] + 1e-9 and abs(r["taken"] - r["t"]) <= r["longest"] for r in per)
    assert out.where("copies > 2").count() == 0
    assert [n for _, n in sorted((r["doc_id"], r["copies"]) for r in out.select("doc_id", "copies").collect())] == mixing.brute_copies(rows)
    again = mixing.repetition_rates(docs.repartition(7)).select("doc_id", "copies").collect()
    assert key(again) == key(out.select("doc_id", "copies").collect())
    assert mixing.mix(docs).count() == out.agg(F.sum("copies")).first()[0]


def test_mixing_comes_near_the_targets_of_small_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.repetition_rates(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("longest"))
    assert all(abs(r["taken"] - r["t"]) <= r["longest"] for r in out.collect())


def test_every_document_has_its_sources_fraction():
    """Mean copies over 200 seeds are within five deviations of the rate, long documents and lone ones included."""
    rows = [(i, "w " * n, "s") for i, n in enumerate([900, 40, 40, 40, 7, 7, 1, 300, 1, 0])] + [(99, "w " * 500, "t"), (100, "w " * 60, "u"), (101, "w " * 61, "u")]
    runs = np.array([mixing.brute_copies(rows, f"seed-{k}") for k in range(200)])
    for s in "stu":
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        rate = {i: runs[:, i].mean() for i in mine}
        mean = sum(rate.values()) / len(mine)
        f = mean - int(mean)
        assert all(abs(v - mean) <= 5 * (f * (1 - f) / 200) ** 0.5 + 1e-9 for v in rate.values())
    assert 0.05 < runs[:, 10].mean() % 1 < 0.95 or runs[:, 10].mean() in (1.0, 2.0)


def test_drawn_copies_follow_the_seed(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in ("a", "b"):
        got = {r["doc_id"]: r["copies"] for r in mixing.repetition_rates(docs, seed=seed).collect()}
        assert [got[i] for i in range(80)] == mixing.brute_copies(rows, seed)


def test_mixing_rows_without_id_draw_by_their_text(spark):
    rows = [(None, f"text {i} " * (i % 5 + 1), "s") for i in range(200)]
    docs = spark.createDataFrame(rows + [(1, "other " * 3000, "t")], "doc_id bigint, text string, source string")
    copies = [r["copies"] for r in mixing.repetition_rates(docs).where("source = 's'").collect()]
    assert len(copies) == 200 and sorted(copies) == sorted(mixing.brute_copies(rows + [(1, "other " * 3000, "t")])[:200])


def test_mixing_edge_cases(spark):
    assert mixing.repetition_rates(empty(spark)).count() == 0
    out = mixing.repetition_rates(frame(spark))
    assert out.count() == len(TEXTS) and out.where("doc_id = 4").first()["size"] == 0
    blank = frame(spark, [(1, None), (2, "")])
    assert [r["copies"] for r in mixing.repetition_rates(blank).collect()] == [1, 1]


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_substrings_equal_counting_every_window(spark, hot):
    edited = []
    for i in range(40):
        words = BASE.split()
        words[i * 2] = f"edit{i}"
        edited.append((100 + i, " ".join(words)))
    rows = TEXTS + edited
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, rows), hot=hot).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, substrings.brute_remove([t for _, t in rows]))]
    assert key(got) == key(want)
    assert substrings.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [16, 512])
def test_substrings_of_many_copies_and_repeated_rows(spark, hot):
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words)) for i in range(300)] + [(7, " ".join(words[20:60]))] * 120
    rows += [(1000 + i, " ".join([f"own{i}", *words[i : i + 36], f"end{i}"])) for i in range(50)] + [(2000, " ".join(f"x{i}" for i in range(50)))]
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, rows), hot=hot).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, substrings.brute_remove([t for _, t in rows]))]
    assert key(got) == key(want)


def test_windows_of_equal_hash_are_told_by_their_words():
    class Same(substrings.Spans):
        def of(self, h, start, end):
            return np.zeros(len(start), np.uint64)

    packed = [b"a b c d", b"b c d e", b"c b a d"]
    rows = substrings.Sorted(np.array([1, 1, 1]), np.array([1, 1, 1]), packed, 3, Same(substrings.BASE))
    assert rows.marks(3).tolist() == [2, 1, 0]


def test_lz_fingerprints(spark):
    rows = [(i, t) for i, t in dict((i, t) for i, t in TEXTS if i is not None).items()]
    got = {r["doc_id"]: tuple(r)[1:7] for r in lz_fingerprints.compare_with_edits(frame(spark, rows)).collect()}
    assert got == lz_fingerprints.brute(rows)
    assert lz_fingerprints.compare_with_edits(frame(spark)).count() == len(TEXTS)
    assert lz_fingerprints.compare_with_edits(empty(spark)).count() == 0
    one = lz_fingerprints.compare_with_edits(frame(spark, [(1, "solo text")])).first()
    assert one["near_next"] == 1.0


def test_lz_ids_without_value_and_string_ids(spark):
    texts = [f"some text {i} " * (i % 7 + 1) for i in range(60)] + ["y" * 30_000]
    nulls = spark.createDataFrame([(None, t) for t in texts] + [(1, "last")], "doc_id bigint, text string")
    got = lz_fingerprints.compare_with_edits(nulls).collect()
    first = sorted((r["xxhash64(t)"], r["t"]) for r in nulls.where("doc_id is null").selectExpr("text as t").selectExpr("xxhash64(t)", "t").collect())
    following = {a[1]: b[1] for a, b in zip(first, first[1:] + [(0, "last")])} | {"last": first[0][1]}
    edited = lambda t: t[: len(t) - len(t) // 2] + following[t][: len(t) // 2]
    want = sorted(hashlib.sha256(edited(t).encode()).hexdigest() for t in following)
    assert sorted(r["edited_sha256"] for r in got) == want
    named = spark.createDataFrame([(f"id{i:03d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in lz_fingerprints.compare_with_edits(named).collect()}
    assert got == lz_fingerprints.brute([(f"id{i:03d}", t) for i, t in enumerate(texts)])


def test_lz_phrases_are_shortest_new_strings():
    d = lz_fingerprints.Dictionary()
    d.parse(lz_fingerprints.codes_of("aababcabcd").tolist())
    seen, at, text = [], 0, "aababcabcd"
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        if end > len(text):
            break
        seen.append(text[at:end])
        at = end
    assert len(d.hashes) - 1 == len(seen) and len(set(d.hashes)) == len(d.hashes)


def test_quality_rules(spark):
    rows = frame(spark)
    got = {r["doc_id"]: r for r in quality_rules.judge(rows).collect()}
    for i, t in TEXTS:
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == quality_rules.brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_on_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality_rules.judge(docs).join(labels, "doc_id")
    good = judged.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    junk = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert good > 0.99 and junk < 0.2
    assert quality_rules.keep_good(docs).count() == quality_rules.judge(docs).where("kept").count()


def test_site_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = site_quality.score(docs, fit).join(held, "doc_id").select((F.col("kept").cast("int") == held["quality"]).alias("right"))
    assert out.agg(F.avg(F.col("right").cast("double"))).first()[0] > 0.95
    assert site_quality.score(docs, labels).count() == docs.count()


def test_site_quality_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        good = rng.random() < (0.9 if i % 4 else 0.2)
        words = ["the", "of", "house", "river", "and", "Stone"] if good else ["#x", "9$", "AA", "|", "zz"]
        rows.append((i, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(1, 60))), ["en", "fr", None][i % 3], ["h1", "h2", "h3", None][i % 4], int(good)))
    rows += rows[:5]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:150]] + [(rows[0][0], 0)], "doc_id bigint, quality int")
    common = quality_rules.common_words()

    def features(text):
        chars, n = max(len(text), 1), max(len(text.split()), 1)
        n_words, word_chars, _, dup, repeat = quality_rules.brute_counts(text)
        count = lambda f: 10 * sum(map(f, text)) / chars
        symbols, stops, joints, blank = "#*$%&|<>", ".,;:!?", "'\"-()’", " \t\n\x0b\x0c\r"
        rest = lambda c: not (c.isalpha() or c.isdigit() or c in symbols or c in stops or c in blank)
        known = sum(w in common or (w[:1] + w[1:].lower() == w and w.lower() in common and w == w.capitalize()) for w in text.split())
        return [count(str.isupper), count(str.isdigit), count(stops.__contains__), count(symbols.__contains__), count(lambda c: rest(c) or c in joints), known / n, repeat / n, np.log1p(n_words) / 5, word_chars / n / 5, np.log1p(dup)]

    y = {}
    for r in rows[:150]:
        y[r[0]] = r[4]
    y[rows[0][0]] = 0
    by_id = {r[0]: r for r in rows}
    w = site_quality.fit_logistic(np.array([features(by_id[i][1]) for i in sorted(y)]), np.array([y[i] for i in sorted(y)], float))
    evidence = [1 / (1 + np.exp(-(np.dot(w[:-1], features(r[1])) + w[-1]))) for r in rows]

    def shrunk(groups, prior):
        n, s, s2 = (np.array(x, float) for x in zip(*[(len(g), sum(g), sum(v * v for v in g)) for g in groups]))
        within = np.maximum(s2 / n - (s / n) ** 2, 0)
        inside = (n * within).sum() / max(n.sum() - len(n), 1)
        across = max(((n * (s / n - prior) ** 2).sum() - inside * len(n)) / n.sum(), 1e-6)
        weight = min(max(inside / across, 1.0), 1e6)
        return (s + weight * prior) / (n + weight)

    overall = np.mean(evidence)
    hosts = sorted({r[3] for r in rows}, key=str)
    of_host = dict(zip(hosts, shrunk([[e for e, r in zip(evidence, rows) if r[3] == h] for h in hosts], np.full(len(hosts), overall))))
    paths = sorted({(r[3], r[2]) for r in rows}, key=str)
    of_path = dict(zip(paths, shrunk([[e for e, r in zip(evidence, rows) if (r[3], r[2]) == p] for p in paths], np.array([of_host[p[0]] for p in paths]))))
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    want = {r[0]: (e, of_host[r[3]], of_path[r[3], r[2]], 1 / (1 + np.exp(-(logit(e) + logit(of_path[r[3], r[2]]) - logit(overall))))) for r, e in zip(rows, evidence)}
    out = site_quality.score(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        np.testing.assert_allclose([r["evidence"], r["host_posterior"], r["path_posterior"], r["quality"]], want[r["doc_id"]], rtol=1e-6)


def test_site_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = site_quality.score(frame(spark), none).collect()
    assert len(out) == len(TEXTS) and all(0 < r["quality"] < 1 for r in out)
    assert site_quality.score(empty(spark), none).count() == 0


def test_sparse_sites_shrink_towards_the_whole(spark):
    sums = spark.createDataFrame([("big", 1000, 900.0, 850.0), ("small", 1, 0.0, 0.0), ("other", 1000, 300.0, 200.0)], "h string, n bigint, s double, s2 double")
    got = {r["h"]: r["p"] for r in site_quality._shrunk(sums, F.lit(0.6), "p").collect()}
    assert abs(got["big"] - 0.9) < 0.02 and got["small"] > 0.2


def test_one_query_per_operator():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))

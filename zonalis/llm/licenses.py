r"""License scans: exact phrases, and an exact set-similarity join of text blocks with notice templates.

All of it is DataFrame expressions. A text is a row of words, whatever its line ends; a block is the 2 * step words
from every step-th word on, so any step words in a row lie whole in a block; the step follows from the longest template.
Tokens are pairs of neighbouring words: scattered words of a notice don't make one. A template is found in a block when the block holds at least
``CONTAINMENT`` of the template's pairs. Pairs that no template has can't count, so blocks are cut to the template
vocabulary, whose tokens are put in one global order, rarest over all blocks first. A qualifying block then shares a
token with the template within both prefixes (prefix filter), has enough tokens (length filter), and enough tokens
after the first shared one (positional filter); what passes the join on prefix tokens is counted exactly.

Notices of one family differ in a word or a number, which containment forgives. A template therefore names phrases of
two or three words that decide between it and its relatives; the block must hold one of each of its groups.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.runtime import cut

CONTAINMENT = 0.8
#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Least step of blocks, in words.
STEP = 96
#: Parts of the names of Creative Commons licences, and of labels.
COMMONS = {"": "cc-by", "-ShareAlike": "cc-by-sa", "-NonCommercial": "cc-by-nc", "-NoDerivatives": "cc-by-nd", "-NonCommercial-ShareAlike": "cc-by-nc-sa", "-NonCommercial-NoDerivatives": "cc-by-nc-nd"}
#: Identifiers on one line of source files, and labels.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2.0", "ISC": "isc", "CC0-1.0": "cc0", "Unlicense": "unlicense",
}
GPL, LESSER, AFFERO = ("gnu general public",), ("gnu lesser general",), ("gnu affero general",)
#: Notice texts, labels and groups of deciding phrases.
NOTICES = [
    ("released under the MIT license", "mit", [("mit license",)]),
    ("licensed under the MIT license", "mit", [("mit license",)]),
    ("The MIT License (MIT)", "mit", []),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "mit", [("to deal in",)]),
    ("licensed under the Apache License, Version 2.0", "apache-2.0", [("apache license",), ("license version 2",)]),
    ("Apache License Version 2.0, January 2004", "apache-2.0", [("apache license",), ("version 2 0",)]),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0", [("apache org licenses",), ("license 2 0",)]),
    ("this work is licensed under the GNU General Public License, version 2", "gpl-2.0", [GPL, ("license version 2",)]),
    ("this work is licensed under the GNU General Public License, version 3", "gpl-3.0", [GPL, ("license version 3",)]),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2.0", [GPL, ("version 2 of",)]),
    ("GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3.0", [GPL, ("version 3 of",)]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", [GPL]),
    ("GNU Lesser General Public License as published by the Free Software Foundation", "lgpl", [LESSER]),
    ("GNU Affero General Public License as published by the Free Software Foundation", "agpl", [AFFERO]),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0", [("waived all copyright",)]),
    ("no rights reserved this work is dedicated to the public domain CC0", "cc0", [("domain cc0",)]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", []),
    ("BSD 2-Clause License", "bsd", []),
    ("BSD 3-Clause License", "bsd", []),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2.0", [("mozilla public license",), ("v 2 0",)]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc", [("provided that the",)]),
    ("This is free and unencumbered software released into the public domain", "unlicense", [("unencumbered software",)]),
]


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def commons_notices() -> list[tuple[str, str, list]]:
    """Long and short notices of each Creative Commons licence. What stands right before the version decides."""
    out = []
    for part, label in COMMONS.items():
        names = _words("Attribution" + part)
        short = label.replace("cc-", "").upper()
        ends = lambda words: tuple(" ".join([*words[-2:], v]) if len(words) > 1 else f"{words[0]} {v}" for v in "234")
        before = ["commons", *names] if not part else names
        out.append((f"This work is licensed under a Creative Commons Attribution{part} 4.0 International License", label, [ends(before)]))
        out.append((f"licensed under CC {short} 4.0", label, [ends(_words("CC " + short))]))
    return out


def identifier_notices() -> list[tuple[str, str, list]]:
    """Lines ``SPDX-License-Identifier: ...``; the identifier's first words decide."""
    commons = {"CC-" + label[3:].upper() + "-4.0": label for label in COMMONS.values()}
    out = []
    for name, label in (IDENTIFIERS | commons).items():
        words = ["identifier", *_words(name)]
        groups = [(" ".join(words[i : i + 3]),) for i in range(0, max(1, len(words) - 2))] if len(words) > 2 else [(" ".join(words),)]
        out.append((f"SPDX-License-Identifier: {name}", label, groups))
    return out


_ALL = [*NOTICES, *commons_notices(), *identifier_notices()]
#: Notice texts and labels.
TEMPLATES = [(text, label) for text, label, _ in _ALL]
#: Notice text -> groups of deciding phrases; a block must hold a phrase of each.
DECIDING = {text: groups for text, _, groups in _ALL}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_PHRASE = " (?:" + "|".join(PHRASES) + ")(?= )"


def lowered(text: Column) -> Column:
    """Lower case for comparing with ASCII words: only U+212A would turn into an ASCII letter, so it is swapped out."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def words_line(text: Column) -> Column:
    """All words of a text in one line, between single spaces."""
    return F.trim(F.regexp_replace(lowered(text), BETWEEN, " "))


def base_columns(line: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base labels of a words_line() column.

    A phrase is a substring of the line, and its place the number of spaces before it. Only lines that hold a phrase
    are searched with regular expressions.
    """
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    holds = [F.contains(padded, F.lit(f" {p} ")) for p in PHRASES]
    some = functools.reduce(lambda a, b: a | b, holds)
    before = lambda how: F.when(some, _spaces(F.regexp_extract(padded, f"(?s)^(.{how}){ANY_PHRASE}", 1)))
    found = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, label in zip(holds, PHRASES.values())]))
    return {
        "n_words": F.when(line == "", F.lit(0)).otherwise(_spaces(line) + 1).cast("bigint"),
        "n_base": F.when(some, F.regexp_count(padded, F.lit(ANY_PHRASE)).cast("bigint")).otherwise(F.lit(0).cast("bigint")),
        "first_word": before("*?"), "last_word": before("*"), "base": F.array_sort(found),
    }


def template_pairs(templates: list[tuple[str, str]]) -> list[tuple[list[str], str]]:
    """The distinct pairs of neighbouring words of each template, and its label."""
    out = []
    for text, label in templates:
        words = _words(text)
        out.append((sorted({f"{a} {b}" for a, b in zip(words, words[1:])}), label))
    return out


def step_of(templates: list[tuple[str, str]]) -> int:
    """A quarter more words than the longest template has, so a notice with words put in lies whole in a block."""
    return max(STEP, *(len(_words(text)) * 5 // 4 for text, _ in templates))


def deciding_groups(templates: list[tuple[str, str]], deciding: dict[str, list]) -> list[list[tuple[str, ...]]]:
    """The groups of phrases of each template. An error for a phrase that isn't two or three words, or a template that
    could never be found: without two words, or without its own phrases."""
    out = []
    for text, _ in templates:
        line = " " + " ".join(_words(text)) + " "
        groups = [tuple(g) for g in deciding.get(text, [])]
        if line.count(" ") < 3 or any(len(p.split()) not in (2, 3) for g in groups for p in g) or not all(any(f" {p} " in line for p in g) for g in groups):
            raise ValueError(f"no text can match the template {text!r}")
        out.append(groups)
    return out


def _hits(pairs: Column, vocabulary: list[str], least: int) -> Column:
    """(pos, pair) of every template pair of a text, by first word; NULL where fewer than ``least`` different ones stand."""
    present = F.size(F.array_intersect(pairs, F.array(*map(F.lit, vocabulary))))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p.alias("pair")))
    return F.when(present >= least, F.filter(placed, lambda h: h["pair"].isin(*vocabulary)))


def find_templates(hits: DataFrame, sets: list[tuple[list[str], str]], groups: list[list[tuple[str, ...]]], step: int, containment: float = CONTAINMENT) -> DataFrame:
    """``(rk, rk2, label, score)`` for each block of ``hits(rk, rk2, hits)`` and template that it contains.

    ``hits`` are the places of pairs and of deciding phrases.
    """
    spark = hits.sparkSession
    vocabulary = sorted({p for pairs, _ in sets for p in pairs})
    need = [math.ceil(containment * len(pairs) - 1e-9) for pairs, _ in sets]
    least = min(need)
    at = F.floor(F.col("h.pos") / step)
    placed = hits.where("hits is not null").select("rk", "rk2", F.explode("hits").alias("h")).select("rk", "rk2", F.col("h.pair").alias("pair"), F.explode(F.array(at, at - 1)).alias("block"))
    blocks = placed.where("block >= 0").groupBy("rk", "rk2", "block").agg(F.collect_set("pair").alias("every"))
    blocks = blocks.withColumn("tokens", F.filter("every", lambda t: t.isin(*vocabulary)))
    # Read twice, for the frequencies and for the join.
    blocks = cut(blocks.where(F.size("tokens") >= least))
    # One row per template pair at most comes to the driver.
    counted = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, ((pairs, label), o, must) in enumerate(zip(sets, need, groups)):
        ranks = sorted(rank[w] for w in pairs)
        phrases = ", ".join("array(" + ", ".join(f"'{p}'" for p in g) + ")" for g in must)
        for j, r in enumerate(ranks[: len(ranks) - o + 1]):
            rows.append(f"({r}, {number}, {j}, {len(ranks)}, {o}, array({', '.join(map(str, ranks))}), '{label}', cast(array({phrases}) as array<array<string>>))")
    prefixes = spark.sql(f"select * from values {', '.join(rows)} as t(rank, template, j, n, need, template_ranks, label, must)")
    numbered = F.array_sort(F.transform("tokens", lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int") - 1))
    sized = blocks.select("rk", "rk2", "every", numbered.alias("ranks"))
    prefix = F.slice("ranks", 1, F.size("ranks") - least + 1)
    probes = sized.select("rk", "rk2", "every", "ranks", F.posexplode(prefix).alias("i", "rank"))
    b = F.size("ranks")
    fits = (b >= F.col("need")) & (F.col("i") < b - F.col("need") + 1) & (1 + F.least(F.col("n") - F.col("j") - 1, b - F.col("i") - 1) >= F.col("need"))
    # The templates' prefixes are a few hundred rows.
    near = probes.join(F.broadcast(prefixes), "rank").where(fits)
    overlap = F.size(F.array_intersect("ranks", "template_ranks"))
    decided = F.forall("must", lambda g: F.arrays_overlap(g, F.col("every")))
    return near.withColumn("overlap", overlap).where((F.col("overlap") >= F.col("need")) & decided).select("rk", "rk2", "label", (F.col("overlap") / F.col("n")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, deciding: dict[str, list] = DECIDING) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    ``score`` is the best containment of a template whose deciding phrases stand in the block too, 1 where a base phrase
    stands, else 0. Templates may be of any length from two words on. NULL texts count as empty: no words, empty
    labels, score 0. Repeated rows are scanned alike and come back as often as they came; NULL ids are kept. An empty
    table gives no rows. Texts are read and cut into words once; no text is shuffled.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    sets, groups, step = template_pairs(templates), deciding_groups(templates, deciding), step_of(templates)
    phrases = {p for must in groups for g in must for p in g}
    vocabulary = sorted({p for pairs, _ in sets for p in pairs})
    twos, threes = sorted({*vocabulary, *(p for p in phrases if p.count(" ") == 1)}), sorted(p for p in phrases if p.count(" ") == 2)
    least = min(math.ceil(CONTAINMENT * len(pairs) - 1e-9) for pairs, _ in sets)
    keys = ["id", "rk", "rk2"]
    lines = docs.select(i.alias("id"), F.xxhash64(i, t).alias("rk"), F.hash(i, t, F.lit(7)).alias("rk2"), words_line(t).alias("line"))
    words = lines.select(*keys, "line", F.split("line", " ").alias("words"))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    pairs = words.select(*keys, "line", "words", F.zip_with("words", F.slice("words", 2, F.size("words")), joined).alias("pairs"))
    hits = _hits(F.col("pairs"), twos, least)
    # Only texts with enough pairs are searched for longer phrases.
    triples = F.zip_with("pairs", F.slice("words", 3, F.size("words")), joined)
    longer = F.filter(F.transform(triples, lambda p, i: F.struct(i.alias("pos"), p.alias("pair"))), lambda h: h["pair"].isin(*threes)) if threes else F.slice(hits, 1, 0)
    marked = F.when(hits.isNotNull(), F.concat(hits, longer))
    seen = cut(pairs.select(*keys, *[c.alias(name) for name, c in base_columns(F.col("line")).items()], marked.alias("hits")))
    found = find_templates(seen.select("rk", "rk2", "hits"), sets, groups, step)
    found = found.groupBy("rk", "rk2").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    out = seen.drop("hits").join(found, ["rk", "rk2"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def brute_labels(text: str | None, templates: list[tuple[str, str]] = TEMPLATES, deciding: dict[str, list] = DECIDING) -> dict[str, float]:
    """Each template label found in a text and its best containment, by plain loops; for tests."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    triples = [f"{a} {b}" for a, b in zip(pairs, words[2:])]
    step = step_of(templates)
    found: dict[str, float] = {}
    for start in range(0, max(len(pairs), 1), step):
        block = set(pairs[start : start + 2 * step])
        every = block | set(triples[start : start + 2 * step])
        for (notice, label), (source, _) in zip(template_pairs(templates), templates):
            share = len(block & set(notice)) / len(notice)
            if share >= CONTAINMENT - 1e-9 and all(every & set(g) for g in deciding.get(source, [])):
                found[label] = max(found.get(label, 0.0), share)
    return found


def oracle() -> str:
    """DuckDB SQL that compares every block with every template."""
    listed = ", ".join(f"({i}, {pairs!r}, '{label}')" for i, (pairs, label) in enumerate(template_pairs(TEMPLATES)))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    groups = deciding_groups(TEMPLATES, DECIDING)
    must = ", ".join(f"({i}, {k}, '{p}')" for i, must in enumerate(groups) for k, g in enumerate(must) for p in g)
    sizes = ", ".join(f"({i}, {len(must)})" for i, must in enumerate(groups))
    step = step_of(TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with t as (
  select doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents
), w as (
  select doc_id, text, regexp_extract_all(text, '{WORD}') as words from t
), phrase(p, label) as (values {phrases}),
places as (
  select doc_id, unnest(range(len(words))) as i, words from w
), base as (
  select a.doc_id, a.i, f.label from places a join phrase f on list_slice(a.words, a.i + 1, a.i + len(f.p)) = f.p
), bases as (
  select doc_id, count(*)::bigint as n_base, min(i)::bigint as first_word, max(i)::bigint as last_word,
    list_sort(list(distinct label)) as base from base group by doc_id
), template(id, pairs, label) as (values {listed}),
token as (
  select id, label, len(pairs) as n, unnest(pairs) as pair from template
), must(id, k, phrase) as (values {must}), groups(id, n) as (values {sizes}),
pairs as (
  select doc_id, i, words[i + 1] || ' ' || words[i + 2] as pair from places where i + 1 < len(words)
  union all select doc_id, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] from places where i + 2 < len(words)
), every as (
  select distinct doc_id, i // {step} - back as block, pair from pairs, (values (0), (1)) s(back)
  where (pair in (select pair from token) or pair in (select phrase from must)) and i // {step} >= back
), counted as (
  select h.doc_id, h.block, k.id, k.label, count(*)::double / k.n as score from every h join token k on h.pair = k.pair group by h.doc_id, h.block, k.id, k.label, k.n
), decided as (
  select e.doc_id, e.block, m.id, count(distinct m.k) as held from every e join must m on m.phrase = e.pair group by 1, 2, 3
), found as (
  select c.doc_id, c.label, c.score from counted c join groups g on g.id = c.id left join decided d on d.doc_id = c.doc_id and d.block = c.block and d.id = c.id
  where coalesce(d.held, 0) = g.n
), best as (
  select doc_id, list(distinct label) as labels, max(score) as score from found where score >= {CONTAINMENT} - 1e-9 group by doc_id
)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word, b.last_word,
  coalesce(array_to_string(b.base, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(f.labels, [])))), ','), '') as labels,
  case when b.n_base > 0 then 1.0::double else coalesce(f.score, 0.0::double) end as score
from w left join bases b on w.doc_id = b.doc_id left join best f on w.doc_id = f.doc_id
"""

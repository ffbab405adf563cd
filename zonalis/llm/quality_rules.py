"""Quality rules: base limits, then distribution divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.profiles import BLANK, DIGIT, JOINT, LOWER, OTHER, STOP, SYMBOL, UPPER, common_words, js_distance, profile, shares, summed, total_of
from zonalis.llm.words import hashable
from zonalis.runtime import broadcast_if_small, cut

LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
#: A document's histogram counts as evidence from so many characters or words on; shorter ones pass that test.
GUARD_CHARS = 200
GUARD_WORDS = 60
#: A language's reference counts from so many words on.
GUARD_REFERENCE = 2000
#: Largest Jensen-Shannon distance of the character classes and of the common words from the reference.
MOST_CLASS_DISTANCE = 0.18
MOST_WORD_DISTANCE = 0.6
#: The same for the documents that make the final references.
FIRST_CLASS_DISTANCE = 0.25
FIRST_WORD_DISTANCE = 0.6
#: References, of about 1 KB each, go to every task up to so many languages.
BROADCAST_LANGUAGES = 2000


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept)`` per row.

    The references are the summed histograms of every document of a language that passes the base limits; NULL
    is a language of its own. Repeated windows within a text are told by 64-bit hashes of their words. Where a text or
    its language's reference is below a length guard, the distance is NULL and counts for nothing. NULL and empty texts have no words and fail the base limits. Repeated rows are
    judged alike and come back as often as they came. An empty table gives no rows.
    """
    counted = profile(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")), keep=("id", "lang"))
    return judge_profiles(cut(counted)).drop("lang", "n_chars", "classes", "common").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with the columns of ``docs``; the rejected go by an anti-join."""
    t = F.col(f"`{text}`")
    keys = {"__k1": F.xxhash64(*hashable(docs, *docs.columns)), "__k2": F.hash(t, F.lit(7))}
    keyed = docs.withColumns(keys)
    verdict = judge(keyed.select(F.struct("__k1", "__k2").alias("k"), t.alias("text"), F.col(f"`{lang}`").alias("lang")), "k")
    bad = verdict.where("not kept").select("k.__k1", "k.__k2").distinct()
    return keyed.join(bad, ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _judged_classes() -> Column:
    """Lower, upper, blank, symbol and the rest: numbers or addresses in a short text must not tell against it."""
    at = lambda i: F.col("classes")[i]
    return F.array(at(LOWER), at(UPPER), at(BLANK), at(SYMBOL), at(DIGIT) + at(STOP) + at(OTHER) + at(JOINT))


def _with_distances(counted: DataFrame, good: DataFrame) -> DataFrame:
    """Adds both distances from the references that ``good`` makes, one row a language."""
    n = len(common_words()) + 1
    sums = good.groupBy("lang").agg(summed("judged", 5), summed("frequent", n), F.sum("n_words").alias("ref_words"))
    sums = cut(sums.withColumn("ref_chars", total_of(F.col("judged"))))
    reference = sums.select(F.col("lang").alias("of"), shares(F.col("judged"), F.col("ref_chars")).alias("ref_classes"), shares(F.col("frequent"), F.col("ref_words")).alias("ref_common"), "ref_words")
    # Without the broadcast, rows would be dealt by language, of which one may have most of them.
    joined = counted.join(broadcast_if_small(cut(reference), BROADCAST_LANGUAGES), F.col("lang").eqNullSafe(F.col("of")), "left")
    known = F.coalesce(F.col("ref_words") >= GUARD_REFERENCE, F.lit(False))
    return joined.withColumns({
        "class_distance": F.when(known & (F.col("word_chars") >= GUARD_CHARS), js_distance(shares(F.col("judged"), F.col("n_chars")), F.col("ref_classes"))),
        "word_distance": F.when(known & (F.col("n_words") >= GUARD_WORDS), js_distance(shares(F.col("frequent"), F.col("n_words")), F.col("ref_common"))),
    }).drop("of", "ref_classes", "ref_common", "ref_words")


def _fits(most_class: float, most_word: float) -> Column:
    return (F.coalesce("class_distance", F.lit(0.0)) <= most_class) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word)


def judge_profiles(counted: DataFrame) -> DataFrame:
    """The verdicts on profile() rows with id and lang.

    A first set of references comes from all documents within the base limits; the second and final one from
    those of them that the first finds near, so junk doesn't blur it.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    rest = F.col("n_words") - total_of(F.col("common"))
    counted = counted.withColumns({"base_failed": failed, "judged": _judged_classes(), "frequent": F.array_append(F.col("common"), rest)})
    good = counted.where("not base_failed")
    near = _with_distances(good, good).where(_fits(FIRST_CLASS_DISTANCE, FIRST_WORD_DISTANCE)).drop("class_distance", "word_distance")
    judged = _with_distances(counted, near)
    return judged.withColumn("kept", ~F.col("base_failed") & _fits(MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE)).drop("judged", "frequent")


def brute_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain loops; for tests."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def oracle() -> str:
    """DuckDB SQL for judge(), distances to four decimals."""
    words = common_words()
    forms = ", ".join(f"('{form}', {i})" for i, w in enumerate(words) for form in sorted({w, w.capitalize()}))
    blank = "\\x20\\x09-\\x0D"

    def distances(name: str, of: str, good: str) -> str:
        return f"""
{name}_ref as (
  select h.lang, kind, bin, sum(n)::double / sum(sum(n)) over (partition by h.lang, kind) as q from hist h join {good} g on h.doc_id = g.doc_id group by 1, 2, 3
), {name}_words as (
  select lang, sum(n_words) as ref_words from {good} group by 1
), {name}_terms as (
  select h.doc_id, h.kind, sum(case when h.n > 0 then p / 2 * log2(2 * p / (p + coalesce(q, 0))) + case when q > 0 then q / 2 * log2(2 * q / (p + q)) else 0 end else 0 end) as t, sum(case when h.n > 0 then coalesce(q, 0) else 0 end) as seen
  from shares h left join {name}_ref r on h.lang is not distinct from r.lang and h.kind = r.kind and h.bin = r.bin group by 1, 2
), {name} as (
  select o.doc_id, case when ref_words >= {GUARD_REFERENCE} and word_chars >= {GUARD_CHARS} then sqrt(greatest(c.t + (1 - c.seen) / 2, 0)) end as class_distance,
    case when ref_words >= {GUARD_REFERENCE} and n_words >= {GUARD_WORDS} then sqrt(greatest(f.t + (1 - f.seen) / 2, 0)) end as word_distance
  from {of} o left join {name}_words r on o.lang is not distinct from r.lang left join {name}_terms c on o.doc_id = c.doc_id and c.kind = 'c' left join {name}_terms f on o.doc_id = f.doc_id and f.kind = 'w'
)"""

    return f"""
with d as (
  select doc_id, lang, coalesce(text, '') as text from documents
), w as (
  select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(text, '[^{blank}]+') as l from d)
), s as (
  select doc_id, pos, word, string_agg(word, ' ') over f as win, count(*) over f as n from w window f as (partition by doc_id order by pos rows between current row and 7 following)
), c as (
  select doc_id, pos, word, n = 8 and count(*) over (partition by doc_id, n, win) > 1 as twice from s
), g as (
  select doc_id, word, bool_or(twice) over (partition by doc_id order by pos rows between 7 preceding and current row) as again from c
), ws as (
  select doc_id, count(*) as n_words, sum(length(word)) as word_chars, count(*) filter (where again) as n_repeat_words from g group by 1
), ls as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^{blank}]') group by 1
), base as (
  select d.doc_id, lang, text, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join ws on d.doc_id = ws.doc_id left join ls on d.doc_id = ls.doc_id
), judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words as base_failed from base
), letters as (
  select doc_id, lang, length(text) as total, len(regexp_extract_all(text, '\\p{{L}}')) as letters, len(regexp_extract_all(text, '\\p{{Lu}}')) as upper_n, len(regexp_extract_all(text, '[{blank}]')) as blank_n, n_symbols from base
), common(form, bin) as (values {forms}),
hits as (
  select doc_id, bin, count(*) as n from w join common on word = form group by 1, 2
), hist as (
  select doc_id, lang, 'c' as kind, 0 as bin, letters - upper_n as n from letters union all select doc_id, lang, 'c', 1, upper_n from letters union all select doc_id, lang, 'c', 2, blank_n from letters
  union all select doc_id, lang, 'c', 3, n_symbols from letters union all select doc_id, lang, 'c', 4, total - letters - blank_n - n_symbols from letters
  union all select h.doc_id, lang, 'w', bin, n from hits h join d on h.doc_id = d.doc_id
  union all select b.doc_id, lang, 'w', {len(words)}, n_words - coalesce(k, 0) from base b left join (select doc_id, sum(n) as k from hits group by 1) h on b.doc_id = h.doc_id
), shares as (
  select *, n::double / nullif(sum(n) over (partition by doc_id, kind), 0) as p from hist
), good as (
  select * from judged where not base_failed
),{distances("first", "good", "good")},
near as (
  select g.* from good g join first f on g.doc_id = f.doc_id where coalesce(class_distance, 0) <= {FIRST_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {FIRST_WORD_DISTANCE}
),{distances("final", "judged", "near")}
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(class_distance, 0) <= {MOST_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE} as kept, round(class_distance, 4) as class_distance, round(word_distance, 4) as word_distance
from judged j join final f on j.doc_id = f.doc_id
"""

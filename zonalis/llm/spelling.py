"""Spelling variants of the corpus vocabulary by asymmetric q-chunks.

Near words differ by one inserted, deleted or replaced code point. The shorter word of a pair contributes two disjoint
chunks, its halves; the other all its positional grams of the halves' lengths. One edit leaves one half whole, and the
longer word has it at a place shifted by one at most: a whole first half at shift 0, a whole second half at the shift
of the ends. A gram elsewhere can't decide a pair, so only these places meet in the join, which verifies what is left
of the two words. Chunks that many words share are hot: with such a chunk fixed the rest of the word is halved again,
for as long as chunks are hot, so a stem of any frequency costs no pairs of all its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.runtime import cut

#: Letters of a run: ASCII and the block from U+00C0 to U+00FF.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words with one chunk from which on it is split again.
HOT = 64


def slipped(key: Column, run: Column, every: int = 199) -> Column:
    """``run``, without one code point where the CRC-32 of ``<key>:<run>`` is a multiple of ``every``: planted slips."""
    h = F.crc32(F.concat_ws(":", key, run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, slips: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: how often each word of ``least_length`` letters or more occurs, ``least`` times at least.

    Words are maximal runs of letters, A-Z lower-cased, with the slips of slipped(); ``slips`` of 0 plants none. A NULL
    text has none; a NULL key counts as empty (the text before the colon); repeated rows count each time; columns of
    other names are not read.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    runs = rows.select("key", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    word = slipped(F.col("key"), run, slips) if slips else run
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halved(rows: DataFrame, shorter: Column) -> DataFrame:
    """Each row twice: with the first or the second half of ``rest`` moved to its key. ``shorter`` is the length of the
    rest of the pair's shorter word."""
    size, half = F.length("rest"), F.floor(shorter / 2).cast("int")
    head = lambda n: F.substring("rest", F.lit(1), n)
    tail = lambda n: F.when(n > 0, F.substring("rest", size - n + 1, n)).otherwise(F.lit(""))
    first = F.struct(F.concat("path", F.lit("<"), head(half)).alias("path"), tail(size - half).alias("rest"))
    last = F.struct(F.concat("path", F.lit(">"), tail(shorter - half)).alias("path"), head(size - shorter + half).alias("rest"))
    halves = F.when(shorter > 1, F.array(first, last)).otherwise(F.array(F.struct("path", "rest")))
    return rows.select(*[c for c in rows.columns if c not in ("path", "rest")], F.explode(halves).alias("p")).select("*", "p.*").drop("p")


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(word, n, other, other_n)``: each pair of near words of ``words(word, n)``, once in either direction.

    Words must be distinct; NULL and empty words have no near words but for one letter beside the empty one.
    """
    longer = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    chunks = words.where("word is not null").select("word", "n", longer, F.length("word").alias("size"), F.lit("").alias("path"), F.col("word").alias("rest"))
    grams = chunks.withColumn("size", F.col("size") - F.col("longer")).where("size >= 0")
    key = ["longer", "size", "path"]
    found = []
    while True:
        chunks = _halved(chunks, F.length("rest"))
        grams = _halved(grams, F.length("rest") - F.col("longer"))
        # A rest that can't be halved any more leaves a group of one place and the letters that stand there.
        crowded = cut(grams.where(F.length("rest") - F.col("longer") > 1).groupBy(*key).agg(F.count("*").alias("words")).where(F.col("words") > hot).drop("words"))
        some = not crowded.isEmpty()
        cold = lambda rows: rows.join(crowded, key, "left_anti") if some else rows
        a = cold(chunks).select(*key, "word", "n", "rest")
        b = cold(grams).select(*[F.col(c).alias(f"o_{c}") for c in key], F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("rest").alias("o_rest"))
        same = [F.col(c) == F.col(f"o_{c}") for c in key]
        one = (F.levenshtein("rest", "o_rest", 1) == 1) & ((F.col("longer") == 1) | (F.col("word") < F.col("other")))
        found.append(cut(a.join(b, [*same, one]).select("word", "n", "other", "other_n")))
        if not some:
            break
        chunks, grams = (rows.join(crowded, key, "left_semi") for rows in (chunks, grams))
        chunks, grams = cut(chunks), cut(grams)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(turned)


def forms(words: DataFrame, near: DataFrame, times: int = 5) -> DataFrame:
    """``(word, n, form, form_n, n_near)``: the near word of largest ``n`` (ties: smallest) if that is ``times`` the
    word's own at least, and the number of near words."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("m"))
    rows = words.join(best, "word", "left")
    good = -F.col("m.n") >= times * F.col("n")
    return rows.select("word", "n", F.when(good, F.col("m.other")).alias("form"), F.when(good, -F.col("m.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))


def roots(found: DataFrame) -> DataFrame:
    """``found(word, form)`` with ``root``: the last word that its forms lead to, itself where it has none.

    A form is more frequent than its word, so there is no circle. Each round doubles the steps taken.
    """
    steps = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, slips: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` of every word of word_counts(); no word, no row."""
    words = cut(word_counts(docs, least_length, least, slips, key, text))
    found = cut(forms(words, near_words(words), times))
    return roots(found).select("word", "n", "form", "root", "n_near", "form_n")


def oracle() -> str:
    """SQL of group_variants(documents): CRC-32 by its table, near words as words that agree but for one deleted place."""
    letters = "[A-Za-z\\x{00C0}-\\x{00FF}]{6,}"
    return f"""
with recursive tab as (select i, 0 as k, i as c from range(256) r(i) union all select i, k + 1, xor(c >> 1, (c & 1) * 3988292384) from tab where k < 8),
crc as (select list(c order by i) as c from tab where k = 8),
runs as (select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '{letters}')), '{UPPER}', '{LOWER}') as run from documents),
each as (select doc, run, count(*) as k from runs group by 1, 2),
hashed as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(doc || ':' || run))), lambda i: ('0x' || hex(encode(doc || ':' || run))[2 * i + 1 : 2 * i + 2])::bigint)),
  lambda a, b: xor(a >> 8, crc.c[(xor(a, b) & 255) + 1])), 4294967295) as h from each, crc),
words as (select case when h % 199 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, sum(k)::bigint as n from hashed group by 1),
v as (select * from words where length(word) >= 6 and n >= 5),
gone as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from v, unnest(range(1, length(word) + 1)) u(i)),
one as (select a.word, a.n, b.word as other, b.n as other_n from gone a join gone b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select g.word, g.n, v.word, v.n from gone g join v on v.word = g.rest union select v.word, v.n, g.word, g.n from gone g join v on v.word = g.rest),
best as (select word, count(*) as n_near, min({{'n': -other_n, 'w': other}}) as m from one group by 1),
form as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -m.n >= 5 * v.n then m.w end as form, case when -m.n >= 5 * v.n then -m.n end as form_n from v left join best using (word)),
up as (select word, word as root, form as further from form union all select up.word, f.word, f.form from up join form f on f.word = up.further)
select form.word, n, form, up.root, n_near, form_n from form join up on up.word = form.word and up.further is null"""

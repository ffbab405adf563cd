"""One pass of counts over whole texts, shared by quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.words import HashCache, cover, map_texts, rolling, split_words

#: Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that for it was on are as with by at this an or be from which not",
    "fr": "le la de et les des en un une du est que pour dans qui par sur au pas plus elle il",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht ein eine als auch es",
    "es": "de la que el en y a los se del las un por con para una su al lo como más",
}
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other", "joint")
LOWER, UPPER, DIGIT, BLANK, STOP, SYMBOL, OTHER, JOINT = range(8)
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
BASE = 0x9E3779B97F4A7C15


def common_words() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def _class_table() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.uint8)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isupper():
            table[cp] = UPPER
        elif c.isalpha():
            table[cp] = LOWER
        elif c.isdigit():
            table[cp] = DIGIT
    for c in ".,;:!?":
        table[ord(c)] = STOP
    for c in "'\"-()’":
        table[ord(c)] = JOINT
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    table[[32, 9, 10, 11, 12, 13]] = BLANK
    return table


class Profiler:
    """Counts of one text after another; the tables are built once per worker."""

    def __init__(self):
        self.table = _class_table()
        self.cache = HashCache()
        words = common_words()
        pairs = [(xxhash.xxh64_intdigest(form.encode()), i) for i, w in enumerate(words) for form in {w, w.capitalize()}]
        pairs.sort()
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.index = np.array([i for _, i in pairs])
        self.n_common = len(words)

    def counts(self, text: str | None) -> tuple:
        text = text or ""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = np.bincount(self.table[np.minimum(cps, 0xFFFF)], minlength=len(CLASSES))
        words = split_words(text)
        n = len(words)
        h = self.cache.of(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        common = np.bincount(self.index[at[self.hashes[at] == h]], minlength=self.n_common)
        lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")] if "\n" in text else []
        repeat = 0
        if n > REPEAT_WINDOW:
            windows = rolling(h, REPEAT_WINDOW, BASE)
            _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
            starts = np.flatnonzero(count[inverse] > 1)
            if len(starts):
                repeat = int(cover(starts, REPEAT_WINDOW, n).sum())
        return n, len(cps), len(cps) - int(classes[BLANK]), int(classes[SYMBOL]), len(lines) - len(set(lines)), repeat, classes, common


FIELDS = "n_words bigint, n_chars bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, common array<bigint>"


def profile(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the counts of FIELDS for every row; NULL texts count as empty."""
    made: list[Profiler] = []
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), FIELDS])
    names = [*keep, *(f.split(" ")[0] for f in FIELDS.split(", "))]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Profiler())
        rows = list(zip(*(made[0].counts(t) for t in batch.column("__text").to_pylist())))
        columns = [pa.array(c, pa.int64()) for c in rows[:6]]
        for c in rows[6:]:
            flat = np.concatenate(c).astype(np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(c[0]), dtype=np.int32)), pa.array(flat)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return map_texts(slim, one, schema, "__text")


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def shares(counts: Column, total: Column) -> Column:
    """Counts over their sum; zeros where there is nothing. ``total`` should be a column at hand: Spark evaluates it
    for every element."""
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (half(x, (x + y) / 2) + half(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def summed(name: str, size: int) -> Column:
    """Element-wise sum of an array column."""
    return F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0)) for i in range(size)]).alias(name)

"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of the MMER-word runs inside it;
consecutive windows of a text with one minimiser form a super-k-mer, ``SPAN`` windows at most. Equal windows
have equal minimisers, so all of a window's copies meet in the minimiser's bucket.

Places of super-k-mers travel first, as rows of (minimiser, text, start). A minimiser seen once has no repeated window.
Every super-k-mer of the others travels as one packed string to its minimiser's bucket, where equal strings are folded,
their windows sorted, compared word by word and counted. Buckets of more than ``hot`` super-k-mers, such as those of a
large group of copies, are dealt to blocks that sort and count on their own; their distinct windows, as words, then meet
by a grouped aggregation, so no task holds a crowded bucket.

Words alone decide whether two windows are equal; hashes only deal them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.words import HashCache, cover, hashable, map_texts, mix, rolling, split_words
from zonalis.runtime import cut

WINDOW = 35
MMER = 4
#: Windows of one super-k-mer; their marks fit one long.
SPAN = 64
#: Super-k-mers of a minimiser that one task sorts at a time: some 200 KB of packed strings and, with their
#: windows, some 2 MB of arrays.
HOT = 512
BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; base is odd."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Spans:
    """Hashes of any span of a sequence from prefix sums."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = _powers(1 << 12, base)

    def of(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.up):
            self.up, self.down = _powers(2 * len(h), self.base)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * self.down[start])


def _sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    width, out = 1, g
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    extra = w - width
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def super_kmers(h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows of each super-k-mer of a text's word hashes, and whether it
    holds its minimiser more than once, without which it can't hold a window twice."""
    if len(h) < k:
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none.astype(bool)
    runs = rolling(h, m, BASE)
    least = _sliding_min(runs, k - m + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, len(least)))
    if (size > SPAN).any():
        parts = -(-size // SPAN)
        run = np.repeat(first, parts)
        step = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = run + step * SPAN
        size = np.minimum(np.repeat(first + size, parts) - start, SPAN)
        first = start
    mm = least[first]
    twice = np.zeros(len(mm), bool)
    order = np.sort(runs)
    repeated = order[1:][order[1:] == order[:-1]]
    if len(repeated):
        for i in np.flatnonzero(np.isin(mm, repeated)).tolist():
            twice[i] = np.count_nonzero(runs[first[i] : first[i] + size[i] + k - m] == mm[i]) > 1
    return mm, first, size, twice


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows under a 96-bit key of id and text, so repeated and NULL ids do no harm."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    (of,) = hashable(docs, id_col)
    return docs.select(i.alias("id"), F.xxhash64(of, t).alias("rk"), F.hash(of, t, F.lit(7)).alias("rk2"), t.alias("text"))


def _places(keyed: DataFrame, k: int, m: int) -> DataFrame:
    """A slim row for each super-k-mer."""
    cache = HashCache()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        mins, rows, starts, sizes, twice = [], [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            words = split_words(t)
            if len(words) < k:
                continue
            mm, start, size, again = super_kmers(cache.of(words), k, m)
            mins.append(mm)
            rows.append(np.full(len(mm), i))
            starts.append(start)
            sizes.append(size)
            twice.append(again)
        if not rows:
            return None
        at = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(mins).view(np.int64)), batch.column("rk").take(at), batch.column("rk2").take(at)]
        columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, sizes)]
        columns.append(pa.array(np.concatenate(twice)))
        return pa.RecordBatch.from_arrays(columns, names=["mm", "rk", "rk2", "start", "size", "twice"])

    return map_texts(keyed.drop("id"), one, "mm bigint, rk bigint, rk2 int, start int, size int, twice boolean")


def _pack(joined: DataFrame, k: int) -> DataFrame:
    """The packed words of each wanted super-k-mer of the joined texts, ``n`` being the text's repeated rows.

    The id comes along unused, so that Spark sees the same exchange of texts here and in the last join and
    runs it once. Of repeated rows that follow each other the first packs for all; readers drop other repeats.
    """
    last: list[tuple | None] = [None]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, keys, repeats, packed = [], [], [], []
        for t, wanted, n, *key in zip(*(batch.column(c).to_pylist() for c in ("text", "wanted", "n", "rk", "rk2"))):
            if key == last[0]:
                continue
            last[0] = key
            words = split_words(t)
            items.extend(wanted)
            keys.extend([key] * len(wanted))
            repeats.extend([n] * len(wanted))
            packed.extend([b" ".join(words[w["start"] : w["start"] + w["size"] + k - 1]) for w in wanted])
        columns = [pa.array([w[c] for w in items], kind) for c, kind in (("mm", pa.int64()), ("block", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("crowded", pa.bool_()))]
        columns += [pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int32()), pa.array(repeats, pa.int64()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["mm", "block", "start", "size", "crowded", "rk", "rk2", "n", "packed"])

    return map_texts(joined.select("id", "text", "wanted", "n", "rk", "rk2"), one, "mm bigint, block int, start int, size int, crowded boolean, rk bigint, rk2 int, n bigint, packed binary")


def _flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Dense word numbers of all packed strings in a row, each string's number of words, the numbered words."""
    known: dict[bytes, int] = {}
    ids, counts = [], []
    for p in packed:
        words = p.split(b" ")
        counts.append(len(words))
        ids.extend([known.setdefault(w, len(known)) for w in words])
    return np.array(ids, np.int64), np.array(counts, np.int64), list(known)


def _windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset in the row and place in the flat sequence of every window."""
    per = counts - k + 1
    row = np.repeat(np.arange(len(counts)), per)
    offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return row, offset, offset + np.repeat(np.cumsum(counts) - counts, per)


class Sorted:
    """All windows of a run of buckets in sorted order, equal ones side by side."""

    def __init__(self, bucket: np.ndarray, n: np.ndarray, packed: list[bytes], k: int, spans: Spans):
        self.ids, counts, self.words = _flat(packed)
        ids, (row, offset, at) = self.ids, _windows(counts, k)
        # Dealt by hash for a quick sort; equality of the words themselves then decides.
        h = spans.of(mix(ids.astype(np.uint64) + np.uint64(1)), at, at + k)
        order = np.lexsort((h, bucket[row]))
        row, offset, at, h = row[order], offset[order], at[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[row[1:]] != bucket[row[:-1]])])
        again = np.flatnonzero(~new)
        if len(again) and any((ids[at[again] + j] != ids[at[again - 1] + j]).any() for j in range(k)):
            full = np.column_stack([bucket[row], *(ids[at + j] for j in range(k))])
            order = np.lexsort(full.T[::-1])
            row, offset, at, full = row[order], offset[order], at[order], full[order]
            new = np.concatenate([[True], (full[1:] != full[:-1]).any(1)])
        group = np.cumsum(new) - 1
        self.row, self.offset, self.at, self.first = row, offset, at, np.flatnonzero(new)
        self.total = np.bincount(group, weights=n[row].astype(np.float64)).astype(np.int64)
        self.twice = self.total[group] >= 2

    def marks(self, rows: int) -> np.ndarray:
        """For each packed string the windows that occur twice or more in its bucket."""
        out = np.zeros(rows, np.uint64)
        np.bitwise_or.at(out, self.row[self.twice], np.uint64(1) << self.offset[self.twice].astype(np.uint64))
        return out.view(np.int64)


def _buckets(batches):
    """Tables of whole blocks of buckets, about 4,000 rows at a time, from sorted rows; repeats of a place go."""
    held, size = [], 0

    def changes(table, *names):
        columns = [table.column(c).to_numpy() for c in names]
        return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])

    def cleaned(table):
        return table.take(pa.array(np.flatnonzero(changes(table, *ORDER))))

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            held.append(pa.Table.from_batches([batch.slice(at, 2000)]))
            size += held[-1].num_rows
            if size < 4000:
                continue
            table = pa.concat_tables(held).combine_chunks()
            whole = int(np.flatnonzero(changes(table, "mm", "block"))[-1])
            if whole:
                yield cleaned(table.slice(0, whole))
            held, size = [table.slice(whole)], table.num_rows - whole
    if size:
        yield cleaned(pa.concat_tables(held).combine_chunks())


#: How super-k-mers stand in their partition.
ORDER = ["mm", "block", "rk", "rk2", "start"]


def _marks(packed: DataFrame, k: int) -> DataFrame:
    """``(rk, rk2, start, size, marks)`` of super-k-mers with windows that occur twice or more.

    A block sorts and counts its own windows. Each distinct one of a crowded bucket then leaves the block as one row with
    its words; sums over the blocks tell which of those seen once in a block occur in another.
    """
    spans = Spans(BASE)
    places, rest = ["rk", "rk2", "start", "size"], ["marks", "window", "total", "offset"]

    def run(batches):
        for table in _buckets(batches):
            mm, block = table.column("mm").to_numpy(), table.column("block").to_numpy()
            bucket = np.cumsum(np.concatenate([[True], (mm[1:] != mm[:-1]) | (block[1:] != block[:-1])]))
            known: dict[tuple, int] = {}
            of = np.array([known.setdefault(key, len(known)) for key in zip(bucket.tolist(), table.column("packed").to_pylist())], np.int64)
            first = np.unique(of, return_index=True)[1]
            n = np.bincount(of, weights=table.column("n").to_numpy()).astype(np.int64)
            rows = Sorted(bucket[first], n, [p for _, p in known], k, spans)
            marks = rows.marks(len(first))[of]
            at = {c: table.column(c).combine_chunks() for c in places}
            seen = np.flatnonzero(marks)
            none = [pa.nulls(len(seen), t) for t in (pa.binary(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(at[c].take(pa.array(seen)) for c in places), pa.array(marks[seen]), *none], names=places + rest)
            words, ids = rows.words, rows.ids.tolist()
            row = first[rows.row[rows.first]]
            leaving = np.flatnonzero(table.column("crowded").to_numpy()[row])
            for i in range(0, len(leaving), 20_000):
                group = leaving[i : i + 20_000]
                head, place = rows.first[group], pa.array(row[group])
                windows = pa.array([b" ".join([words[j] for j in ids[a : a + k]]) for a in rows.at[head].tolist()], pa.binary())
                columns = [*(at[c].take(place) for c in places), pa.nulls(len(group), pa.int64()), windows, pa.array(rows.total[group]), pa.array(rows.offset[head].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=places + rest)

    dealt = packed.repartition("mm", "block").sortWithinPartitions(*ORDER)
    local = cut(dealt.mapInArrow(run, "rk bigint, rk2 int, start int, size int, marks bigint, window binary, total bigint, offset int"))
    windows = local.where("window is not null")
    elsewhere = windows.groupBy("window").agg(F.sum("total").alias("all")).where("all > 1").select("window")
    found = windows.where("total = 1").join(elsewhere, "window", "left_semi")
    across = found.groupBy(*places).agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("marks"))
    return local.where("window is null").select(*places, "marks").unionByName(across)


def repeated_marks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MMER, hot: int = HOT) -> DataFrame:
    """``(rk, rk2, found)``: for each keyed row with repeated windows, its (start, size, marks) structs."""
    keyed = _keyed(docs, id_col, text)
    places = cut(_places(keyed, k, m))
    buckets = places.groupBy("mm").agg(F.count("*").alias("c"), F.bool_or("twice").alias("any_twice")).where("c > 1 or any_twice")
    shared = places.drop("twice").join(buckets.select("mm", "c"), "mm")
    block = F.pmod(F.xxhash64("rk", "rk2", "start"), F.ceil(F.col("c") / hot)).cast("int").alias("block")
    item = F.struct("mm", "start", "size", block, (F.col("c") > hot).alias("crowded"))
    # Every repeated row brings the same places, so their number over that of distinct places is that of the rows.
    wanted = shared.groupBy("rk", "rk2").agg(F.collect_set(item).alias("wanted"), F.count("*").alias("c"))
    wanted = wanted.select("rk", "rk2", "wanted", F.expr("c div size(wanted)").alias("n"))
    marks = _marks(_pack(keyed.join(wanted, ["rk", "rk2"]), k), k)
    return marks.groupBy("rk", "rk2").agg(F.collect_set(F.struct("start", "size", "marks")).alias("found"))


def _keep(words: list[bytes], found: list[dict] | None, k: int) -> np.ndarray:
    if not found:
        return np.ones(len(words), bool)
    starts = [f["start"] + np.flatnonzero(np.unpackbits(np.array([f["marks"]], "<i8").view(np.uint8), bitorder="little")[: f["size"]]) for f in found]
    return ~cover(np.concatenate(starts), k, len(words))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MMER, hot: int = HOT, layout: bool = False) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row, ``kept`` being the words that stay, joined by one space.

    With ``layout``, a text that loses nothing stays as it is. The id may be a struct that carries other columns.

    A word goes if a k-word window that covers it also starts anywhere else, in the same or another row; all
    windows are judged on the input. NULL texts have no words and give an empty ``kept``. Repeated rows count as
    separate documents and come back as often as they came; NULL ids are kept. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = repeated_marks(docs, id_col, text, k, m, hot)
    joined = _keyed(docs, id_col, text).join(found, ["rk", "rk2"], "left").select("id", "text", "found")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            words = split_words(t)
            keep = _keep(words, f, k)
            sizes.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            if layout and not gone[-1]:
                kept.append(t)
                continue
            kept.append(b" ".join([w for w, y in zip(words, keep.tolist()) if y] if gone[-1] else words).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return map_texts(joined, one, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")


def brute_remove(texts: list[str | None], k: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept) of each text by counting all windows in one dictionary; for tests."""
    words = [split_words(t) for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


ORACLE = f"""
with w as (
  select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as l from documents)
), s as (
  select doc_id, pos, word, string_agg(word, ' ') over f as win, count(*) over f as n from w
  window f as (partition by doc_id order by pos rows between current row and {WINDOW - 1} following)
), c as (
  select doc_id, pos, word, n = {WINDOW} and count(*) over (partition by case when n = {WINDOW} then win else doc_id::varchar || ':' || pos::varchar end) > 1 as twice from s
), g as (
  select doc_id, pos, word, bool_or(twice) over (partition by doc_id order by pos rows between {WINDOW - 1} preceding and current row) as gone from c
), k as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from g group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k on d.doc_id = k.doc_id
"""

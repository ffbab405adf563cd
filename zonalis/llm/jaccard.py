"""Near-duplicate groups by exact Jaccard similarity of word shingle sets (the pipeline's second stage).

Equal sets are one row throughout. Candidates come from two searches. SimHash fingerprints of the sets, linked by
anchor-point covering (operator 1), find the closest texts. Within 3 of 64 bits few texts of similarity 0.8 lie, so
prefix tokens find the rest: sets of similarity ``least`` share a token within their first n - ceil(least n) + 1
tokens of any common order; the order puts tokens that a sample shows to be frequent last. Sets that share a prefix
token are compared by size, place of the token and, once a pair, a histogram of their hashes, whose distance never
exceeds the number of shingles in which two sets differ. None of these drops a similar pair.

Candidates form families. The whole sets of a family then travel once to its task (a large family's blocks to one task
for each pair of blocks), where products of membership matrices count the shingles that every two sets share. Tasks
return forests of links, so a group of n copies never becomes its n * n pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.words import LOWER, HashCache, hashable, map_texts, mix, rolling, split_words
from zonalis.operators.graph_components import connected_components
from zonalis.runtime import broadcast_if_small, cut

SHINGLE = 5
SIMILARITY = 0.8
BASE = 0x9E3779B97F4A7C15
#: Rows of a bucket, rows and shingles of a family that go to one block; block meets block in a task of its own.
BLOCK, FAMILY, FAMILY_TOKENS = 1024, 1024, 1 << 20
#: A task's tables of bucket rows are closed at so many bytes.
TABLE_BYTES = 24 << 20
#: Share of sets whose tokens are counted for the order, and how often a frequent token stands there.
SAMPLE, FREQUENT, MOST = 16, 4, 200_000
#: Keys of copies, or of rows whose sets are to be compared, of some 50 bytes each, go to every task up to so many.
BROADCAST_ROWS = 200_000


def shingles(text: str | None, size: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = split_words(text.translate(LOWER)) if text else []
    if not words:
        return np.array([], np.uint64)
    return np.unique(rolling(cache.of(words), min(size, len(words)), BASE))


def _token_sets(texts: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``texts(*columns, text)`` with ``tokens`` for ``text``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = HashCache(1)
        sets = [shingles(t, size, cache) for t in batch.column(len(columns)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], _lists(sets)], names=[*columns, "tokens"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns]
    return map_texts(texts.select(*columns, "text"), one, ", ".join([*kinds, "tokens array<bigint>"]))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def _frequent(keyed: DataFrame, size: int) -> np.ndarray:
    """Tokens that a sample of texts shows to be frequent, the most frequent last. Only speed hangs on them."""
    sample = keyed.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    n = _token_sets(sample, [], size).select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = n.where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h").limit(MOST).collect()
    return np.array([r["h"] for r in reversed(rows)], np.int64)


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of 64-bit shingle hashes, as a signed number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(s), 65536):
        total += np.unpackbits(s[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(s), bitorder="little").view("<i8")[0])


def histogram(s: np.ndarray) -> bytes:
    """Counts of the hashes' low bits, modulo 16, two to a byte: 128 bins, or as many more as leave 8 hashes to a bin."""
    bins = max(128, 1 << (max(len(s), 1) - 1 >> 3).bit_length())
    n = (np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 15).astype(np.uint8)
    return (n[: bins // 2] | n[bins // 2 :] << np.uint8(4)).tobytes()


class Histograms:
    """Many sets' histograms; two are compared on the bins of the smaller one."""

    def __init__(self, packed: list[bytes]):
        sizes = np.array([len(p) for p in packed], np.int64)
        self.size, self.place, self.rows = sizes, np.zeros(len(packed), np.int64), {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            half = np.frombuffer(b"".join([packed[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
            self.rows[size] = np.concatenate([half & 15, half >> 4], axis=1)
            self.place[at] = np.arange(len(at))

    def _of(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(at), 2 * size), np.uint8)
        for own in np.unique(self.size[at]).tolist():
            mine = np.flatnonzero(self.size[at] == own)
            rows = self.rows[own][self.place[at[mine]]]
            while rows.shape[1] > 2 * size:
                half = rows.shape[1] // 2
                rows = rows[:, :half] + rows[:, half:] & 15
            out[mine] = rows
        return out

    def least_difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the number of hashes in which the sets of rows a and b differ."""
        out = np.zeros(len(a), np.int64)
        smaller = np.minimum(self.size[a], self.size[b])
        for size in np.unique(smaller).tolist():
            at = np.flatnonzero(smaller == size)
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                d = self._of(a[part], size) - self._of(b[part], size) & 15
                out[part] = np.minimum(d, 16 - d).sum(-1, dtype=np.int64)
        return out


def sketches(keyed: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``(key, sig, n, fp, bins, prefix)`` of every row of ``keyed(key, text)``; equal sets have equal ``sig``."""
    last = _frequent(keyed, size)
    order = np.argsort(last)
    known, rank = last[order], order + 1

    def first(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        h = s.view(np.int64)
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        r = np.where(known[at] == h, rank[at], 0) if len(known) else np.zeros(len(h), np.int64)
        return s[np.lexsort((h, r))][: len(s) - math.ceil(least * len(s) - 1e-9) + 1]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = HashCache(1)
        sets = [shingles(t, size, cache) for t in batch.column(1).to_pylist()]
        sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        columns = [pa.array(sig), pa.array([len(s) for s in sets], pa.int32()), pa.array([set_fingerprint(s) for s in sets], pa.int64())]
        columns += [pa.array([histogram(s) for s in sets], pa.binary()), _lists([first(s) for s in sets])]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "sig", "n", "fp", "bins", "prefix"])

    kind = keyed.schema["key"].dataType.simpleString()
    return map_texts(keyed.select("key", "text"), one, f"key {kind}, sig bigint, n int, fp bigint, bins binary, prefix array<bigint>")


def _partnered(token: np.ndarray, n: np.ndarray, pos: np.ndarray, least: float) -> np.ndarray:
    """Which rows, in order of token and n, have the next or the one before of their token near enough in length, and
    enough shingles after the shared one to be similar to it."""
    room = n - pos >= least / (1 + least) * (n + least * n) - 1e-9
    near = (token[1:] == token[:-1]) & (n[:-1] >= least * n[1:] - 1e-9)
    return room & (np.append(near, False) | np.insert(near, 0, False))


def _buckets(sets: DataFrame, least: float) -> DataFrame:
    """``(home, h, sig, n, pos, size)``: prefix tokens, by 48 bits of them, that ``size`` > 1 sets share.

    Most tokens have one set and go where they arrive, so what travels is no more than token, place, set and length;
    rows without a set of their length go as well. The two smallest sets of a bucket name its home: the many tokens
    that near copies share have the same one.
    """
    rows = sets.select("sig", "n", F.posexplode("prefix").alias("pos", "h"))
    place = F.shiftleft(F.shiftrightunsigned("h", 16), 16).bitwiseOR(F.least("pos", F.lit(65_535)).cast("bigint"))
    rows = rows.select(place.alias("a"), "sig", "n").repartition(F.shiftrightunsigned("a", 16)).sortWithinPartitions("a")

    def run(batches):
        for table in _cells(batches, 200_000, lambda b: b.num_rows, lambda a: a.view(np.uint64) >> np.uint64(16)):
            a, sig, n = (table.column(c).to_numpy() for c in ("a", "sig", "n"))
            a = a.view(np.uint64)
            token, pos, n = a >> np.uint64(16), (a & np.uint64(65_535)).astype(np.int64), n.astype(np.int64)
            order = np.lexsort((n, token))
            order = order[_partnered(token[order], n[order], pos[order], least)]
            token, sig, n, pos = token[order], sig[order], n[order], pos[order]
            if not len(token):
                continue
            starts = _starts(token)
            size = np.diff(starts)
            by = np.lexsort((sig, token))
            first, second = sig[by[starts[:-1]]], sig[by[np.minimum(starts[:-1] + 1, len(sig) - 1)]]
            home = mix(first.view(np.uint64)) ^ second.view(np.uint64)
            at = np.flatnonzero(np.repeat(size, size) > 1)
            if len(at):
                columns = [np.repeat(home, size)[at].view(np.int64), token[at].view(np.int64), sig[at], n[at].astype(np.int32), pos[at].astype(np.int32), np.repeat(size, size)[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["home", "h", "sig", "n", "pos", "size"])

    # Negative numbers sort before positive ones, but the sets of a token stay together.
    return rows.mapInArrow(run, "home bigint, h bigint, sig bigint, n int, pos int, size bigint")


def _dealt(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """``rows`` under ``cell``: a group's rows are dealt to blocks by ``sig``, and each pair of blocks is a cell.

    Two rows of a group share at least one cell. Cells whose hashes collide are compared together, which adds nothing
    but work.
    """
    own, other = F.pmod(F.xxhash64("sig"), blocks), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = rows.withColumn("__own", own).withColumn("__other", other)
    cell = F.xxhash64(group, F.least("__own", "__other"), F.greatest("__own", "__other"))
    return dealt.withColumn("cell", cell).drop("__own", "__other")


def _meetings(sets: DataFrame, least: float) -> DataFrame:
    """``(cell, h, sig, n, pos, bins)``: the bucket rows of each cell, and one row with the histogram (``h`` NULL) for each
    set of a cell, so a histogram doesn't travel with every token.

    Buckets of one home share a cell; those of more than BLOCK rows are dealt to cells of their own.
    """
    rows = cut(_buckets(sets, least))
    small = rows.where(F.col("size") <= BLOCK).withColumn("cell", F.col("home"))
    large = _dealt(rows.where(F.col("size") > BLOCK), "h", F.ceil(F.col("size") / BLOCK))
    met = small.select("cell", "h", "sig", "n", "pos").unionByName(large.select("cell", "h", "sig", "n", "pos"))
    once = met.select("cell", "sig").distinct().join(sets.select("sig", "n", "bins"), "sig")
    once = once.select("cell", F.lit(None).cast("bigint").alias("h"), "sig", "n", F.lit(0).alias("pos"), "bins")
    return once.unionByName(met.withColumn("bins", F.lit(None).cast("binary")))


def _grid(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    return _dealt(rows, group, blocks).repartition("cell").sortWithinPartitions("cell")


def _cells(batches: Iterator[pa.RecordBatch], most: int, weight: Callable[[pa.RecordBatch], int], cell_of: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> Iterator[pa.Table]:
    """Tables of whole cells, which the sorted first column tells, closed once they weigh ``most``."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            held.append(batch.slice(at, 1000))
            total += weight(held[-1])
            if total < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cell = cell_of(table.column(0).to_numpy())
            whole = int(_starts(cell)[-2])  # the last cell may go on in the next batch
            if whole:
                yield table.slice(0, whole)
                table = table.slice(whole)
            held = table.combine_chunks().to_batches()
            total = sum(map(weight, held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(cell: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))


def _forests(batches, most: int, weight, edges_of) -> Iterator[pa.RecordBatch]:
    """One forest of a task's links, as (src, dst)."""
    kept = np.array([], np.int64), np.array([], np.int64)
    for table in _cells(batches, most, weight):
        a, b = edges_of(table)
        if len(a):
            kept = forest(np.concatenate([kept[0], a]), np.concatenate([kept[1], b]))
    for at in range(0, len(kept[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in kept], names=["src", "dst"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end's smallest reachable end, for the edges a-b: one row per end that isn't its own root."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ends))
    return ends[moved], ends[root[moved]]


def _fits(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the rows a, b can have the similarity, by length and position filter."""
    fits = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
    return fits & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least / (1 + least) * (n[a] + n[b]) - 1e-9)


def _bucket_edges(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a table of _meetings() between sets that share a prefix token and may be similar, at least a forest of
    each bucket's. A pair of sets is compared once, however many tokens of small buckets it shares."""
    is_set = np.asarray(table.column("h").is_null())
    held = table.filter(pa.array(is_set))
    bins = Histograms(held.column("bins").to_pylist())
    length = held.column("n").to_numpy().astype(np.int64)
    rows = table.filter(pa.array(~is_set))
    cell, h, sig, n, pos = (rows.column(c).to_numpy() for c in ("cell", "h", "sig", "n", "pos"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    # Each row's set among those of its cell.
    key = lambda cell, sig: mix(cell.view(np.uint64)) ^ sig.view(np.uint64)
    known = key(held.column("cell").to_numpy(), held.column("sig").to_numpy())
    order = np.argsort(known)
    own = order[np.searchsorted(known, key(cell, sig), sorter=order)]
    by = np.lexsort((h, cell))
    cell, h, sig, n, pos, own = (x[by] for x in (cell, h, sig, n, pos, own))
    starts = np.append(np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])), len(h)) if len(h) else np.array([0])
    size = np.diff(starts)
    name = held.column("sig").to_numpy()

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return bins.least_difference(a, b) <= (1 - least) / (1 + least) * (length[a] + length[b]) + 1e-9

    pairs = [np.zeros(0, np.int64)]
    index = np.flatnonzero(np.repeat(size <= 16, size))
    for d in range(1, 16):
        a, b = index[:-d], index[d:]
        same = (h[a] == h[b]) & (cell[a] == cell[b])
        if not same.any():
            break
        a, b = a[same], b[same]
        a, b = (x[_fits(n, pos, a, b, least)] for x in (a, b))
        x, y = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
        pairs.append(np.unique(x[x < y] * len(name) + y[x < y]))
    pairs = np.unique(np.concatenate(pairs))
    a, b = np.divmod(pairs, max(len(name), 1))
    may = similar(a, b)
    out_a, out_b = [name[a[may]]], [name[b[may]]]
    for g in np.flatnonzero(size > 16).tolist():
        # A row is compared with those that are not in its component yet.
        at = np.arange(starts[g], starts[g + 1])
        label = np.arange(len(at))
        for i in range(len(at) - 1):
            open_ = np.flatnonzero(label != label[i])
            open_ = open_[open_ > i]
            open_ = open_[_fits(n, pos, np.full(len(open_), at[i]), at[open_], least)] if len(open_) else open_
            if not len(open_):
                continue
            found = open_[similar(np.full(len(open_), own[at[i]]), own[at[open_]])]
            out_a.append(np.full(len(found), sig[at[i]]))
            out_b.append(sig[at[found]])
            if len(found):
                label[np.isin(label, label[found])] = label[i]
    return np.concatenate(out_a), np.concatenate(out_b)


def _similar_edges(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between a cell's sets that have the similarity, each link between two such sets."""
    cell, sig = table.column("cell").to_numpy(), table.column("sig").to_numpy()
    lists = table.column("tokens").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    starts = _starts(cell)
    out_a, out_b = [sig[:0]], [sig[:0]]
    for g, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - g < 2:
            continue
        n = np.diff(ends[g : e + 1]).astype(np.int64)
        tokens, number, times = np.unique(flat[ends[g] : ends[e]], return_inverse=True, return_counts=True)
        shared = times[number] > 1
        column = np.cumsum(times > 1)[number[shared]] - 1
        row = np.repeat(np.arange(e - g), n)[shared]
        common = np.zeros((e - g, e - g), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [first, first + 4096])
            member = np.zeros((e - g, min(4096, int(column[-1]) + 1 - first)), np.float32)
            member[row[lo:hi], column[lo:hi] - first] = 1
            common += member @ member.T
        a, b = np.nonzero(np.triu(common >= least * (n[:, None] + n[None, :] - common) - 1e-9, 1))
        if len(a):
            a, b = forest(sig[g:e][a], sig[g:e][b]) if len(a) > e - g else (sig[g:e][a], sig[g:e][b])
        else:
            a, b = sig[:0], sig[:0]
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _families(one: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(sig, family)`` of the sets that may be similar to another; similar sets are of one family.

    ``one(sig, fp)``, ``sets(sig, n, bins, prefix)``, either a row for each set.
    """
    from zonalis.llm.simhash import links

    low = cut(one.groupBy("fp").agg(F.min("sig").alias("low")))
    same = one.join(low, "fp").where("sig <> low").select(F.col("sig").alias("src"), F.col("low").alias("dst"))
    ends = lambda c: low.select(F.col("fp").alias(c), F.col("low").alias("__" + c))
    close = links(low.select("fp")).join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    met = _meetings(sets, least).repartition("cell").sortWithinPartitions("cell")
    weight = lambda b: 128 * b.num_rows + 4 * b.column("bins").nbytes
    bucketed = met.mapInArrow(lambda batches: _forests(batches, TABLE_BYTES, weight, lambda t: _bucket_edges(t, least)), "src bigint, dst bigint")
    return connected_components(same.unionByName(close).unionByName(bucketed)).withColumnsRenamed({"node": "sig", "component": "family"})


def components(keyed: DataFrame, sets: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``(sig, component)`` of the sets that a similarity of ``least`` links to another one.

    ``keyed(key, text)``, ``sets`` from sketches(). The whole sets of families are made again from their texts.
    """
    one = cut(sets.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    # The first row of each set carries its prefix; the others, which exact copies make, are left out by their keys.
    others = sets.where("n > 0").select("sig", "key").join(one.select("sig", F.col("key").alias("first")), "sig").where("key <> first").select(F.col("key").alias("other"))
    first = sets.where("n > 0").join(broadcast_if_small(cut(others), BROADCAST_ROWS), F.col("key") == F.col("other"), "left_anti")
    families = cut(_families(one.select("sig", "fp"), first.select("sig", "n", "bins", "prefix"), least))
    used = families.join(one.select("sig", "n", "key"), "sig")
    weights = used.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("rows") / FAMILY, F.col("tokens") / FAMILY_TOKENS)).cast("bigint")
    used = cut(used.join(weights.select("family", blocks.alias("blocks")), "family").select("sig", "family", "blocks", F.col("key").alias("wanted")))
    texts = keyed.join(broadcast_if_small(used, BROADCAST_ROWS), F.col("key") == F.col("wanted")).select("sig", "family", "blocks", "text")
    held = _token_sets(texts, ["sig", "family", "blocks"], size)
    dealt = _grid(held, "family", F.col("blocks")).select("cell", "sig", "tokens")
    weight = lambda b: len(b.column(2).flatten())
    similar = dealt.mapInArrow(lambda batches: _forests(batches, 2 * FAMILY_TOKENS, weight, lambda t: _similar_edges(t, least)), "src bigint, dst bigint")
    return connected_components(similar).withColumnRenamed("node", "sig")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one of smallest id, NULL last.

    Texts without words (NULL too) are equal to each other and to nothing else. Of repeated rows one stays; rows that
    share an id but differ are told apart. Other columns may have any name. An empty table gives no rows.
    """
    i = F.col(f"`{id_col}`")
    key = F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(*hashable(docs, *docs.columns)).alias("row"))
    keyed = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    sets = cut(sketches(keyed, size, least))
    classes = sets.select("key", "sig").join(components(keyed, sets, size, least), "sig", "left")
    chosen = classes.groupBy(F.coalesce("component", "sig").alias("c")).agg(F.min("key").alias("__key")).select("__key")
    rows = docs.select(key.alias("__key"), F.struct("*").alias("__cells")).join(chosen, "__key", "left_semi").dropDuplicates(["__key"])
    return rows.select(*[F.col(f"__cells.`{c}`") for c in docs.columns])


def brute_kept(rows: list[tuple], size: int = SHINGLE, least: float = SIMILARITY) -> list:
    """Smallest ids of the components of (id, text) rows by comparing all pairs of word tuples; for tests."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode("utf-8").split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= least * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted(i for i in up if up[i] == i)

"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits within ``THRESHOLD`` = 3 bits of each other agree, but for one bit, in the first or in
the second half. On 31 bits of either half the perfect Hamming code of covering radius 1 supplies the anchors:
every fingerprint has one home anchor within radius 1, and a partner that differs in at most one of these bits
lies within radius + 1 = 2 of that home. So each distinct fingerprint goes to the 16 or 31 anchors within 2 of it,
in either half, and is compared there with those that are at home.

Equal fingerprints are one row throughout. A task links the fingerprints of its anchors by a forest, so a group
of n fingerprints adds fewer than n links per task and never its pairs. Anchors with more fingerprints than
``block`` are cut into blocks, and block meets block in tasks of their own.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.jaccard import forest
from zonalis.llm.words import LOWER, hashable, map_texts
from zonalis.operators.graph_components import connected_components
from zonalis.runtime import cut

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Fingerprints of one anchor that one task compares with each other.
BLOCK = 4096


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; 0 without words."""
    words = (text or "").translate(LOWER).encode("utf-8").split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    view = memoryview(line)
    hashes = [digest(view[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long. NULL counts as the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    return map_texts(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), one, f"`{id_col}` {kind}, fp bigint", text)


def _syndrome(bits: np.ndarray) -> np.ndarray:
    """Of 31-bit words under the Hamming code whose column i is i + 1; 0 for a codeword."""
    out = np.zeros(len(bits), np.int64)
    for i in range(31):
        out ^= np.where(bits >> np.int64(i) & 1, i + 1, 0)
    return out


def _flip(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flips position at - 1 of each word; at = 0 leaves it."""
    return bits ^ np.where(at > 0, np.int64(1) << np.maximum(at - 1, 0), 0)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, key and home flag of each fingerprint's anchors in both halves.

    The key is the half's number above the 31 bits of the codeword. A word at home distance 1 (syndrome s) has
    15 codewords at distance 2: those that flip i and j with i xor j = s. A codeword has none at distance 1 or
    2 but itself.
    """
    rows, keys, home = [], [], []
    u = fp.view(np.uint64)
    for half in (0, 1):
        bits = (u >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        tag = np.int64(half) << np.int64(31)
        s = _syndrome(bits)
        index = np.arange(len(fp))
        rows.append(index)
        keys.append(_flip(bits, s) | tag)
        home.append(np.ones(len(fp), bool))
        for i in range(1, 32):
            j = s ^ i
            use = (s > 0) & (j > i)
            rows.append(index[use])
            keys.append(_flip(_flip(bits[use], np.full(use.sum(), i)), j[use]) | tag)
            home.append(np.zeros(use.sum(), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= THRESHOLD


def _group_edges(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between home and other rows of equal key; rows are sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    out_a, out_b = [fp[:0]], [fp[:0]]
    small = np.repeat(size <= 64, size)
    if small.any():
        k, f, h = key[small], fp[small], home[small]
        for d in range(1, 64):
            if d >= len(k):
                break
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            same = same[h[same] | h[same + d]]
            same = same[_close(f[same], f[same + d])]
            out_a.append(f[same])
            out_b.append(f[same + d])
    for at in np.flatnonzero(size > 64).tolist():
        part = slice(first[at], first[at] + size[at])
        mine, every = fp[part][home[part]], fp[part]
        step = max(1, (1 << 21) // len(every))
        for i in range(0, len(mine), step):
            x, y = np.nonzero(_close(mine[i : i + step, None], every[None, :]))
            a, b = forest(mine[i : i + step][x], every[y]) if len(x) else (fp[:0], fp[:0])
            out_a.append(a)
            out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _task_edges(batches):
    """Forest of all links that a task's sorted rows (key, fp, home) show."""
    held: list[pa.Table] = []
    kept_a, kept_b = np.array([], np.int64), np.array([], np.int64)

    def work(table: pa.Table) -> None:
        nonlocal kept_a, kept_b
        a, b = _group_edges(*(table.column(i).to_numpy() for i in range(3)))
        if len(a):
            kept_a, kept_b = forest(np.concatenate([kept_a, a]), np.concatenate([kept_b, b]))

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < 200_000:
            continue
        table = pa.concat_tables(held).combine_chunks()
        key = table.column(0).to_numpy()
        whole = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
        if whole:
            work(table.slice(0, whole))
        held, rows = [table.slice(whole)], len(key) - whole
    if held:
        work(pa.concat_tables(held).combine_chunks())
    for at in range(0, len(kept_a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(kept_a[at : at + 50_000]), pa.array(kept_b[at : at + 50_000])], names=["src", "dst"])


def links(distinct_fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(src, dst)`` edges that join every two fingerprints of ``distinct_fps(fp)`` within THRESHOLD bits.

    Not every pair is an edge, but those within the threshold are connected by edges, each of which is a true
    link. Anchors that hold over ``block`` rows have their rows dealt to blocks by hash, and every pair of
    blocks is compared in its own group.
    """

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy()
                row, key, home = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], names=["key", "fp", "home"])

    rows = cut(distinct_fps.select("fp").mapInArrow(replicate, "key bigint, fp bigint, home boolean"))
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).where("n > 1 and n_home > 0"))
    plain = rows.join(sizes.where(F.col("n") <= block).select("key"), "key", "left_semi").withColumn("part", F.lit(0))
    blocks = F.ceil(F.col("n") / block).cast("int")
    hot = rows.join(sizes.where(F.col("n") > block).select("key", blocks.alias("blocks")), "key")
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A home row meets every block of the others, so it goes to its own row of the block grid; the rest go to
    # their own column.
    grid = F.sequence(F.lit(0), F.col("blocks") - 1)
    hot = hot.select("key", "fp", "home", "own", "blocks", F.explode(grid).alias("other"))
    as_home = hot.where("home").select("key", "fp", "home", (F.col("own") * F.col("blocks") + F.col("other")).alias("part"))
    as_any = hot.select("key", "fp", F.lit(False).alias("home"), (F.col("other") * F.col("blocks") + F.col("own")).alias("part"))
    whole = plain.select("key", "fp", "home", "part").unionByName(as_home).unionByName(as_any)
    dealt = whole.select(F.xxhash64("key", "part").alias("k"), "fp", "home").repartition("k").sortWithinPartitions("k")
    return dealt.mapInArrow(_task_edges, "src bigint, dst bigint").where("src <> dst")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row: hex fingerprint and smallest id reachable over links.

    NULL texts count as empty; texts without words have fingerprint zero and link like any other. Repeated rows
    come back as often as they came. Rows with a NULL id keep it, link like the others and never name a
    component that has another id. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text, size))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    cc = connected_components(links(distinct))
    named = distinct.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one of smallest id, NULL last.

    Components are those of components(), or, with ``similarity``, of texts whose sets of ``size``-word shingles have
    that Jaccard similarity or more: fingerprint links are then candidates beside those of prefix tokens, and whole
    sets decide (jaccard.py).

    Rows go under a key of id, text hash, so repeated rows and NULL ids are told apart or fall together rightly.
    """
    if similarity is not None:
        from zonalis.llm import jaccard

        return jaccard.keep_one(docs, id_col, text, size, similarity)
    i = F.col(f"`{id_col}`")
    keyed = docs.withColumn("__key", F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(*hashable(docs, *docs.columns)).alias("row")))
    found = components(keyed.select("__key", F.col(f"`{text}`").alias("text")), "__key", "text", size)
    chosen = found.where("__key = component_id").select(F.col("__key.row").alias("__row")).distinct()
    rows = keyed.withColumn("__row", F.col("__key.row")).drop("__key").join(chosen, "__row", "left_semi")
    return rows.dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_components(rows: list[tuple]) -> dict:
    """{id: (hex, component)} of (id, text) rows by counting bits one by one and comparing all pairs; for tests."""

    def bits(text: str | None) -> int:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
        runs = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64(r.encode("utf-8"), seed=42).intdigest() for r in runs]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    fps = [(i, bits(t)) for i, t in rows]
    up = {i: i for i, _ in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in combinations(fps, 2):
        if bin(a ^ b).count("1") <= 3:
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return {i: (f"{f:016x}", top(i)) for i, f in fps}

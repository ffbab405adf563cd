"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into dictionary phrases: the shortest string not yet in the dictionary is the next
phrase and enters it. Two texts that compress well together share phrases, so the Jaccard likeness of the phrase
sets follows compression; a signature of minimum hashes estimates it.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.words import mix
from zonalis.runtime import cut, shuffle_partitions

SLOTS = 64
#: Keys sampled for each range of ids.
SAMPLE_ROWS = 100
EMPTY = 0xFFFF
_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(1, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Dictionary:
    """Phrases as a tree: a phrase is an earlier one plus a code point. Keeps each phrase's 64-bit hash."""

    def __init__(self):
        self.child: dict[int, int] = {}
        self.hashes = [0x243F6A8885A308D3]
        self.at = 0

    def copy(self) -> Dictionary:
        out = Dictionary()
        out.child, out.hashes, out.at = self.child.copy(), self.hashes.copy(), self.at
        return out

    def parse(self, codes: list[int]) -> None:
        """Goes on parsing; an unfinished last phrase repeats an earlier one and adds nothing."""
        child, hashes, at = self.child, self.hashes, self.at
        get = child.get
        for c in codes:
            key = at << 21 | c
            at_next = get(key)
            if at_next is None:
                child[key] = len(hashes)
                hashes.append((hashes[at] * _BASE + c + 1) & _MASK)
                at = 0
            else:
                at = at_next
        self.at = at

    def least(self, start: int = 1) -> np.ndarray:
        """Minimum of each slot's hash over the phrases from number ``start`` on."""
        h = mix(np.array(self.hashes[start:], np.uint64)).astype(np.uint32)
        out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 2048):
            out = np.minimum(out, (_TIMES[:, None] * h[None, i : i + 2048] + _PLUS[:, None]).min(1))
        return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def signature(least: np.ndarray, empty: bool) -> np.ndarray:
    """SLOTS minimum hashes folded to 16 bits; a text without phrases has EMPTY in every slot."""
    if empty:
        return np.full(SLOTS, EMPTY, np.uint16)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str | None) -> np.ndarray:
    found = Dictionary()
    found.parse(codes_of(text or "").tolist())
    return signature(found.least(), not text)


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and the edited text; the common first part is parsed once."""
    half = len(text) // 2
    keep = len(text) - half
    edited = text[:keep] + following[:half]
    common = Dictionary()
    common.parse(codes_of(text[:keep]).tolist())
    least, phrases = common.least(), len(common.hashes)
    own, other = common, common.copy()
    own.parse(codes_of(text[keep:]).tolist())
    other.parse(codes_of(edited[keep:]).tolist())
    a, e = (signature(np.minimum(least, d.least(phrases)), not whole) for d, whole in ((own, text), (other, edited)))
    return a, e, edited


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the next
    row's text in order of id (NULL ids first, rows of equal id by a hash of their text); the last row's next is the
    first. Ids are integers or strings, each in their own order. NULL texts are empty; two empty texts are alike
    (1.0). Repeated rows follow each other. An empty table gives no rows.

    Rows are dealt to ranges of (id, text hash), so NULL ids or one repeated id fill as many ranges as they need; the
    first row of a range also goes to the range before it as a guest (with its exact repeats, if any), so every task
    finds all next rows in its own sorted stream and hardly a text moves twice.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = F.coalesce("id", F.lit("") if kind == "string" else F.lit(0).cast(kind))
    rows = rows.select("id", "text", F.col("id").isNotNull().alias("has"), known.alias("known"), F.xxhash64("text").alias("th"))
    n = shuffle_partitions(spark)
    slim = cut(rows.select("has", "known", "th"))
    # Some SAMPLE_ROWS distinct keys of each range come to the driver to choose the bounds.
    share = min(1.0, SAMPLE_ROWS * n / max(slim.count(), 1))
    sample = slim.where(F.pmod(F.xxhash64("has", "known", "th", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().collect()
    keys = sorted(tuple(r) for r in sample)
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def range_of(has: pd.Series, i: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, k) for k in zip(has.tolist(), i.tolist(), th.tolist())], dtype="int32")

    # One key per range comes to the driver and goes out again.
    heads = {r["part"]: tuple(r["first"]) for r in slim.withColumn("part", range_of("has", "known", "th")).groupBy("part").agg(F.min(F.struct("has", "known", "th")).alias("first")).collect()}
    parts = sorted(heads)
    to_of = {heads[p]: parts[i - 1] for i, p in enumerate(parts)}

    @F.pandas_udf("int")
    def guest_of(has: pd.Series, i: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series([to_of.get(k) for k in zip(has.tolist(), i.tolist(), th.tolist())], dtype="Int32")

    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("guest"))
    guest = F.col("guest_to")
    targets = F.array_compact(F.array(own, F.when(guest.isNotNull(), F.struct(guest.alias("to"), F.lit(1).alias("guest")))))
    # Both Python functions see keys alone; texts stay in the JVM until they are parsed.
    dealt = rows.withColumns({"part": range_of("has", "known", "th"), "guest_to": guest_of("has", "known", "th")})
    dealt = dealt.select("id", "text", "has", "known", "th", F.explode(targets).alias("t"))
    # One range, one partition: a hash of so few numbers would put several ranges together.
    dealt = dealt.select("t.to", "t.guest", "id", "text", "has", "known", "th").repartitionById(len(cuts) + 1, "to").sortWithinPartitions("to", "guest", "has", "known", "th", "text").select("to", "guest", "id", "text")
    names = [id_col, *(f.split(" ")[0] for f in OUT.split(", "))]

    def run(batches):
        held = pending = None
        done: list[tuple] = []
        id_type = None

        def close(following: np.ndarray) -> None:
            nonlocal pending
            done.append((*pending[:3], text_of(pending[3]), text_of(pending[4]), likeness(pending[3], pending[4]), likeness(pending[3], following)))
            pending = None

        for batch in batches:
            id_type = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for is_guest, i, t in zip(*(part.column(c).to_pylist() for c in ("guest", "id", "text"))):
                    if held is not None:
                        a, e, edited = both_fingerprints(held[1], t)
                        if pending is not None:
                            close(a)
                        pending = (held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, e)
                    if is_guest and pending is not None:
                        close(fingerprint(t))
                    held = None if is_guest else (i, t)
                if done:
                    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), types)], names=names)
                    done = []

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {OUT}")


def brute(rows: list[tuple]) -> dict:
    """Results of (id, text) rows with distinct ids, phrase by phrase in plain Python; for tests."""
    wide, narrow = (1 << 64) - 1, (1 << 32) - 1

    def print_of(text: str) -> list[int]:
        if not text:
            return [0xFFFF] * 64
        phrases, at = set(), 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in phrases:
                end += 1
            if end > len(text):
                break
            phrases.add(text[at:end])
            at = end
        hashes = []
        for p in phrases:
            h = 0x243F6A8885A308D3
            for c in p:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & wide
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ h >> 33) * factor & wide
            hashes.append((h ^ h >> 33) & narrow)
        slots = [min(int(t) * h + int(p) & narrow for h in hashes) for t, p in zip(_TIMES, _PLUS)]
        return [(v * 0x9E3779B1 & narrow) >> 16 for v in slots]

    rows = sorted(rows)
    out = {}
    hexed = lambda sig: "".join(f"{v:04x}" for v in sig)
    alike = lambda x, y: sum(u == v for u, v in zip(x, y)) / 64
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, e, b = map(print_of, (t, edited, following))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), alike(a, e), alike(a, b))
    return out

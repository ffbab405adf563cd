"""Byte-level BPE encoding and decoding over a public vocabulary file.

Merging works on a contiguous rank array: a word's part boundaries stand beside the rank of the pair that
starts at each; the smallest rank is looked for, the boundary after it goes, and only the two neighbouring
ranks are looked up anew. Words are short, so the scan beats any heap.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.words import map_texts

#: The fixed pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 60
#: Words kept with their ids in one worker; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Words longer than this are encoded without being kept.
CACHE_WORD_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one tokenizers JSON file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        model = spec["model"]
        raw = {token: bytes(alphabet[c] for c in token) for token in model["vocab"] if all(c in alphabet for c in token)}
        self.ids = {raw[token]: i for token, i in model["vocab"].items() if token in raw}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: raw[token] for token, i in model["vocab"].items() if token in raw}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.ids[raw[left]], self.ids[raw[right]]), rank)
            self.made.append(self.ids[raw[left] + raw[right]])
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word's parts."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > 256:
            return self._merge_long(parts)
        look, made = self.ranks.get, self.made
        ranks = list(map(look, zip(parts, parts[1:]), repeat(NO_RANK)))
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            new = parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = look((new, parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = look((parts[i - 1], new), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same order of merges with numpy scans in place of list scans, for words of unusual length.

        All non-overlapping places of the smallest rank are merged from left to right in one sweep: a merge
        makes pairs of a new id, whose rank is higher than its own.
        """
        look = self.ranks.get
        ids = np.array(parts, np.int64)
        rank = np.array([look(p, NO_RANK) for p in zip(parts, parts[1:])], np.int64)
        while len(rank):
            best = int(rank.min())
            if best == NO_RANK:
                break
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run like "aaa": every second place of it counts
                keep, last = [], -2
                for i in at.tolist():
                    if i > last + 1:
                        keep.append(i)
                        last = i
                at = np.array(keep)
            ids[at] = self.made[best]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids = ids[stay]
            rank = np.append(rank, NO_RANK)[stay][: len(ids) - 1]
            moved = at - np.arange(len(at))
            for i in np.unique(np.concatenate([moved, moved - 1])).tolist():
                if 0 <= i < len(rank):
                    rank[i] = look((int(ids[i]), int(ids[i + 1])), NO_RANK)
        return ids.tolist()

    def packed(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers, kept for the next time."""
        got = self.known.get(word)
        if got is None:
            ids = self.merge(word.encode("utf-8"))
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= CACHE_WORD_BYTES:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed; a special token's string in the text is that token."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.packed, self.find(text)))
        out = []
        for piece in self.cut(text):
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
            else:
                out.extend(map(self.packed, self.find(piece)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Every column of ``docs`` that is not overwritten, with ``n_tokens``, ``ids`` (packed binary, where
    ``with_ids``), ``ids_sha256`` and ``decoded_sha256``.

    One pass without a shuffle: a task holds one slice of texts at a time. NULL counts as the empty text
    (0 tokens, hashes of nothing). Columns of these four names in the input are replaced. ``tokenizer`` is the
    path of the vocabulary file on every worker.
    """
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    keep = [c for c in docs.columns if c not in new]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields]
    schema = ", ".join([*fields, "n_tokens bigint", *(["ids binary"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(tokenizer)
        ids, sums, back = [], [], []
        counts = []
        for t in batch.column(text).to_pylist():
            packed = bpe.encode(t or "")
            counts.append(len(packed) // 4)
            sums.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(bpe.decode(packed).encode("utf-8")).hexdigest())
            if with_ids:
                ids.append(packed)
        columns = [*batch.columns, pa.array(counts, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []), pa.array(sums), pa.array(back)]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    return map_texts(slim, one, schema, text)


def decode_texts(encoded: DataFrame, tokenizer: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of packed ids (NULL stays NULL); an existing column of that name is replaced."""

    @F.pandas_udf("string")
    def text_of(packed: pd.Series) -> pd.Series:
        bpe = load(tokenizer)
        return packed.map(lambda b: None if b is None else bpe.decode(bytes(b)))

    return encoded.withColumn(to, text_of(F.col(ids)))

"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node has a failure link to the node of what is left after the longest-match
pieces in front have been popped, and the number of pieces popped, both computed once. Reading a word's bytes
then takes time linear in its length and counts the pieces without building them.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.bpe import byte_alphabet
from zonalis.llm.words import map_texts, split_words

#: Words whose counts one worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 600_000


class Automaton:
    """Over a vocabulary of byte strings that has every single byte, so each word can be cut into pieces."""

    def __init__(self, vocabulary: list[bytes]):
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        final = bytearray(1)
        for piece in vocabulary:
            node = 0
            for b in piece:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(final)
                    final.append(0)
                node = nxt
            if node:
                final[node] = 1
        if sum((b in self.child) for b in range(256)) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.final = final
        self._link()
        self.known: dict[bytes, int] = {}

    def _link(self) -> None:
        """Breadth first: a piece pops itself and leaves nothing; any other node pops what its parent would pop,
        then goes on from there until the last byte can be read."""
        n = len(self.final)
        self.fail, self.pops = [0] * n, [0] * n
        below: list[list[int]] = [[] for _ in range(n)]
        for key in self.child:
            below[key >> 8].append(key)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for key in below[parent]:
                node, byte = self.child[key], key & 255
                queue.append(node)
                if self.final[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while (nxt := self.child.get(at << 8 | byte)) is None:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[node], self.pops[node] = nxt, popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word."""
        get, fail, pops = self.child.get, self.fail, self.pops
        node = total = 0
        for b in word:
            while (nxt := get(node << 8 | b)) is None:
                total += pops[node]
                node = fail[node]
            node = nxt
        while node:
            total += pops[node]
            node = fail[node]
        return total

    def counted(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            got = self.count(b" " + word)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = got
        return got


def byte_pieces(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary file, without special tokens."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in t) for t in vocabulary if t and all(c in alphabet for c in t)]


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    return Automaton(byte_pieces(path))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, n_bytes, n_tokens, longest_word_tokens)`` of every row, in one pass without a shuffle.

    Words are cut at ASCII white space and read with a space in front, as the vocabulary's word-initial pieces
    are. NULL and empty texts count 0. Repeated rows and NULL ids come back as they came; an empty table gives no
    rows. ``tokenizer`` is the path of the vocabulary file on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_bytes", "n_tokens", "longest_word_tokens"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = load(tokenizer).counted
        words, sizes, tokens, most = [], [], [], []
        for t in batch.column(1).to_pylist():
            parts = split_words(t)
            counts = np.fromiter(map(counted, parts), np.int64, len(parts))
            words.append(len(parts))
            sizes.append(len(t.encode("utf-8", "surrogatepass")) if t else 0)
            tokens.append(int(counts.sum()))
            most.append(int(counts.max(initial=0)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, sizes, tokens, most))], names=names)

    return map_texts(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), one, f"`{id_col}` {kind}, n_words bigint, n_bytes bigint, n_tokens bigint, longest_word_tokens bigint", text)


def brute_count(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    """Pieces of one word with a space in front by trying every length; for tests."""
    word, at, n = b" " + word, 0, 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        at, n = at + size, n + 1
    return n

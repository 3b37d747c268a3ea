"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links.  Failing from a node pops the pieces
that greedy longest match takes there; the number popped is stored on the link, so
a word's length in pieces is a sum along its path and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_letters, file_of
from .common import ALNUM, CACHE_WORDS, LOWER, blocks, others, small_batches, split_words, utf8

#: Pieces of an unknown word, as word-piece tokenizers give one unknown token.
UNKNOWN = 1


class LongestMatch:
    """Counts pieces of words over a vocabulary of initial pieces and continuation pieces (both bytes)."""

    def __init__(self, initial: set[bytes], inner: set[bytes]) -> None:
        # nodes: 0 word start, 1 start of a continuation; then trie nodes of both
        self.next: list[dict[int, int]] = [{}, {}]
        depth_first: list[tuple[int, int, int]] = []  # parent, byte, node
        final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in sorted(pieces):
                node = root
                for byte in piece:
                    child = self.next[node].get(byte)
                    if child is None:
                        child = len(self.next)
                        self.next[node][byte] = child
                        self.next.append({})
                        final.append(False)
                        depth_first.append((node, byte, child))
                    node = child
                if piece:
                    final[node] = True
        depth = [0, 0] + [0] * len(depth_first)
        for parent, _, child in depth_first:
            depth[child] = depth[parent] + 1
        # fail[v] = (node, popped): where to go on after popping that many pieces; -1 if the text cannot be split
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        for parent, byte, child in sorted(depth_first, key=lambda x: depth[x[2]]):
            if final[child]:
                self.fail[child], self.popped[child] = 1, 1
                continue
            node, count = self.fail[parent], self.popped[parent]
            while node >= 0 and byte not in self.next[node]:
                count += self.popped[node]
                node = self.fail[node]
            if node >= 0:
                self.fail[child], self.popped[child] = self.next[node][byte], count

    def count(self, word: bytes) -> int:
        """Pieces of one word; UNKNOWN if no split exists, 0 for the empty word."""
        if not word:
            return 0
        node, total = 0, 0
        following, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while (child := following[node].get(byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return UNKNOWN
            node = child
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return UNKNOWN
        return total


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuation pieces of a byte-level BPE file: tokens that begin with a space start words.

    Every byte is a piece of both kinds, so no word is unknown.  Upper-case pieces
    never match lower-cased words and are left out.
    """
    with open(file_of(path), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    to_byte = {c: b for b, c in byte_letters().items()}
    initial, inner = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    for token in tokens:
        if not all(c in to_byte for c in token):
            continue
        raw = bytes(to_byte[c] for c in token)
        if any(65 <= b <= 90 for b in raw):
            continue
        if raw[:1] == b" ":
            if raw[1:] and b" " not in raw[1:]:
                initial.add(raw[1:])
        elif b" " not in raw:
            inner.add(raw)
    return initial, inner


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*vocabulary(path))


class Counts(dict):
    """word -> pieces, remembered for up to CACHE_WORDS words."""

    def __init__(self, machine: LongestMatch) -> None:
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.machine.count(word)
        return n


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), alnum: bool = False) -> DataFrame:
    """keep, n_words, n_tokens and max_word_tokens (long) of the lower-cased (A-Z) text.

    Words are runs without ASCII white space (with alnum: without ASCII punctuation
    either).  Null and empty texts count 0 everywhere.  Rows are independent: repeated
    rows each get a row, a column in keep that has a result's name gives way to it, no shuffle, memory bounded by a block or the longest text.
    """
    small_batches(df.sparkSession)
    keep = others(keep, ["n_words", "n_tokens", "max_word_tokens"])
    source = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "n_words long, n_tokens long, max_word_tokens long"])
    letters = ALNUM if alnum else LOWER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(automaton(path))
        for block in blocks(batches):
            if len(known) > CACHE_WORDS:
                known.clear()
            words, n_words = split_words(utf8(block.column(block.num_columns - 1)), letters)
            each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            full = np.flatnonzero(n_words)
            total, most = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            if len(full):
                at = (np.cumsum(n_words) - n_words)[full]
                total[full], most[full] = np.add.reduceat(each, at), np.maximum.reduceat(each, at)
            made = [pa.array(x, pa.int64()) for x in (n_words, total, most)]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *made], names=[*keep, "n_words", "n_tokens", "max_word_tokens"])

    return source.mapInArrow(run, schema)

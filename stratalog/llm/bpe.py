"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a block of a partition are laid out as one linked list of
symbols.  An index maps every mergeable pair (by rank) to all its positions; the
active ranks are taken in ascending order from a heap, each is applied to all its
positions at once, and only the lists of the pairs that this makes are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_WORDS, blocks, others, small_batches

#: White space of the tokenizer's regular expressions (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int64(-1)


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(extra)) for b in range(256)}


class PairIndexBPE:
    """Tokenizer of a word-level BPE file with byte letters and a word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in added.items()})
        self.added = added
        self._split_added = regex.compile("|".join(map(regex.escape, added))) if added else None
        # The file's splitting pattern with its own white space, which differs from this library's \s.
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._words = regex.compile(split.replace(r"[^\s", f"[^{_SPACE}"))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        letters = byte_letters()
        self._inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int64)
        self._last = np.array([self.vocab[letters[b] + self.end] for b in range(256)], np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text, normalised; an added token stands as itself behind a space."""
        if not self.added or not any(a in text for a in self.added):
            return self._words.findall(self._normal(text))
        out: list[str] = []
        at = 0
        for m in self._split_added.finditer(text):
            out += self._words.findall(self._normal(text[at : m.start()]))
            out.append(" " + m.group())
            at = m.end()
        return out + self._words.findall(self._normal(text[at:]))

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row (distinct words, none empty), and where each word's begin and end."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        sym = self._inner[data]
        sym[ends - 1] = self._last[data[ends - 1]]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = n  # n stands for "none"; its symbol matches nothing
        prv = np.arange(-1, n - 1)
        prv[ends - sizes] = n
        sym = np.append(sym, np.int64(1 << 31))
        nxt, prv = np.append(nxt, n), np.append(prv, n)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            ranks = self._rank_of(sym[at], sym[nxt[at]])
            live = ranks >= 0
            at, ranks = at[live], ranks[live]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:
                at = self._apart(np.sort(at), nxt)
            if not len(at):
                continue
            gone = nxt[at]
            sym[at] = self.made[r]
            sym[gone] = _NONE
            after = nxt[gone]
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            before = before[before < n]
            add(np.unique(np.concatenate([before, at])))
        live = sym[:n] >= 0
        counts = np.add.reduceat(live, ends - sizes, dtype=np.int64) if n else np.zeros(0, np.int64)
        return sym[:n][live].astype("<u4"), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of pairs of one symbol that overlap, every second from the left."""
        out, last = [], -1
        for x, y in zip(at.tolist(), nxt[at].tolist(), strict=True):
            if x != last:
                out.append(x)
                last = y
        return np.array(out, np.int64)

    def decode_ids(self, ids: np.ndarray) -> str:
        """Text of ids as a tokenizer without a decoder gives it: tokens joined by spaces; unknown ids are left out."""
        return " ".join(t for t in map(self.tokens.get, ids.tolist()) if t is not None)


class Encoder:
    """Encodes blocks of texts, remembering up to CACHE_WORDS words."""

    def __init__(self, bpe: PairIndexBPE) -> None:
        self.bpe, self.known = bpe, {}
        top = max(bpe.tokens) + 1
        self.tokens = [bpe.tokens.get(i, "").encode() for i in range(top)]

    def learn(self, words: list[str]) -> None:
        """Remember each word's ids as little-endian bytes and its decoded text."""
        plain = [w for w in words if w[0] != " "]
        if plain:
            ids, at = self.bpe.encode_words(plain)
            raw, at = ids.tobytes(), at.tolist()
            tokens = list(map(self.tokens.__getitem__, ids.tolist()))
            for w, a, b in zip(plain, at, at[1:], strict=False):
                self.known[w] = raw[4 * a : 4 * b], b" ".join(tokens[a:b])
        for w in words:
            if w[0] == " ":
                i = self.bpe.added[w[1:]]
                self.known[w] = i.to_bytes(4, "little"), self.tokens[i]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Little-endian unsigned 32-bit ids and the decoded text (UTF-8) of each text."""
        lists = [self.bpe.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        look = [list(map(self.known.get, ws)) for ws in lists]
        self.learn(list({w for ws, got in zip(lists, look, strict=True) if None in got for w, g in zip(ws, got, strict=True) if g is None}))
        for ws, got in zip(lists, look, strict=True):
            got = [g or self.known[w] for w, g in zip(ws, got, strict=True)] if None in got else got
            yield b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])


def file_of(path: str) -> str:
    """The place, on this machine, of a tokenizer file: a bare name is one of the public tokenizers' package."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@lru_cache(maxsize=2)
def _load(path: str) -> PairIndexBPE:
    return PairIndexBPE(file_of(path))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """keep, then n_tokens (long) and ids (array of int) - or with digest, SHA-256 of ids and of the decoded text.

    path names a tokenizer file that is installed on every executor (file_of).  Null texts
    are empty, and empty texts have no ids; repeated rows each get a row; a column in keep
    that has a result's name gives way to the result.  Each row is encoded whole and by itself; no
    shuffle, memory bounded by a block or by the longest text.
    """
    small_batches(df.sparkSession)
    keep = others(keep, ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"])
    source = df.select(*keep, df[text].alias("__text"))
    fields = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "n_tokens long", fields])
    names = [*keep, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_load(path))
        for block in blocks(batches):
            texts = [x or "" for x in block.column(block.num_columns - 1).to_pylist()]
            coded = encoder.encode(texts)
            if digest:
                rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for i, t in coded]
                made = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
            else:
                raw = [i for i, _ in coded]
                sizes = [len(i) // 4 for i in raw]
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                made = [pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *made], names=names)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text (string): the tokens of ids joined by spaces; null ids give null, unknown ids are left out."""
    source = df.select(*keep, df[ids].alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path)
        for block in blocks(batches):
            lists = block.column(block.num_columns - 1).to_pylist()
            made = [None if x is None else bpe.decode_ids(np.array(x, np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(made, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)

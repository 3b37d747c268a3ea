"""Per-text statistics, computed in one pass over Arrow blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, blocks, join_texts, mix, others, per_text, small_batches, split_words, utf8, windows

REPEAT_WINDOW = 8

#: name -> bytes counted per text
_CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_pipes": b"|",
    "n_digits": b"0123456789",
    "n_upper": bytes(range(65, 91)),
    "n_punct": b".,;:!?",
    "n_brackets": b"()[]{}<>/\\=_@",
}
STATS = [
    "n_words",
    "word_chars",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_short",
    "n_long",
    *_CLASSES,
]


def _lookup(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_TABLES = {name: _lookup(chars) for name, chars in _CLASSES.items()}
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13, *range(0x80, 0xC0)]] = False  # one for each code point of a word


def duplicates(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    s = np.sort(values)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def measure(texts: list[bytes], hashes: WordHashes) -> dict[str, np.ndarray]:
    """STATS of each text."""
    raw, starts = join_texts(texts, b"")
    data = np.frombuffer(raw, np.uint8)
    out = {name: per_text(t[data], starts) for name, t in _TABLES.items()}
    out["word_chars"] = per_text(_IN_WORD[data], starts)
    words, n_words = split_words(texts, b"")
    out["n_words"] = n_words
    own = hashes.of(words)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n_words)
    first = np.concatenate([[0], np.cumsum(n_words)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    count = lambda mask: np.bincount(doc[mask], minlength=len(texts)).astype(np.int64)
    out["n_short"], out["n_long"] = count(lengths <= 2), count(lengths >= 20)
    with np.errstate(over="ignore"):
        salt = mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.lexsort((own, doc)) if len(own) else np.zeros(0, np.int64)
    a, d = own[order], doc[order]
    kept = np.ones(len(a), bool)
    kept[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    out["n_distinct"] = np.bincount(d[kept], minlength=len(texts)).astype(np.int64)

    covered = np.zeros(len(words) + 1, np.int32)
    runs = windows(own, REPEAT_WINDOW)
    if len(runs):
        inside = doc[: len(runs)] == doc[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(inside)
        again = at[duplicates(mix(runs[at] ^ salt[at]))]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    hit = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])

    lines, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            full = [x for x in text.split(b"\n") if x.strip()]
            lines[i] = len(full)
            dup[i] = len(full) - len(set(full))
    out["n_lines"], out["n_dup_lines"] = lines, dup
    return out


def with_stats(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, then STATS (long) of the text column.

    A null text counts as empty; every other column is left out, and one in keep that
    has a statistic's name gives way to the statistic, so clashing names do no harm.  Rows are independent: no shuffle, memory bounded by a block
    (or by the longest single text).
    """
    small_batches(df.sparkSession)
    keep = others(keep, STATS)
    source = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), *(f"{s} long" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches):
            found = measure(utf8(block.column(block.num_columns - 1)), hashes)
            columns = [*block.columns[:-1], *(pa.array(found[s], pa.int64()) for s in STATS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATS])

    return source.mapInArrow(run, schema)

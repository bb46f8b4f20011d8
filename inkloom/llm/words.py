"""Words of many texts at once, in numpy, for tasks that get Arrow batches.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased, that is of digits, a-z and
everything outside ASCII. In UTF-8 each byte alone tells whether it belongs to a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_BYTES = 2 << 20  # of text handled at once; a longer text is a chunk of its own
CHUNK_ROWS = 1024      # texts handled at once, however short

_LOWER = np.zeros(256, dtype=np.uint8)  # 0 marks bytes outside words
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: base^(done+i) = base^done * base^i
            step = min(done, size - done)
            have[done:done + step] = have[:step] * np.uint64(pow(int(base), done, 1 << 64))
            done += step
        if n <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of one chunk; word w is ``data[starts[w]:ends[w]]``, text d has words ``first[d]`` to ``first[d+1]``."""

    data: np.ndarray      # bytes, lower-cased, 0 outside words
    raw: np.ndarray       # bytes as given
    offsets: np.ndarray   # of texts in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    prefix: np.ndarray | None = None

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes ``starts`` to ``ends``, equal for equal bytes wherever they stand."""
        if self.prefix is None:
            n = len(self.data)
            self.prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, n + 1)[:n], out=self.prefix[1:])
        back = _table("down", _BASE_INV, len(self.data) + 1)
        return mix((self.prefix[ends] - self.prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def word(self, w: int) -> bytes:
        return self.data[self.starts[w]:self.ends[w]].tobytes()

    def phrase(self, lo: int, hi: int) -> bytes:
        return b" ".join(self.word(w) for w in range(lo, hi))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def word_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of rows of about ``limit`` bytes; every text is whole."""
    if len(texts) == 0:
        return
    raw, offsets = _buffers(texts)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, min(lo + CHUNK_ROWS, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1))
        part = raw[offsets[lo]:offsets[hi]]
        yield lo, hi, find_words(part, offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def find_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    data = _LOWER[raw]
    inside = data != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word never spans two texts
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def words_of(text: str) -> list[str]:
    """The same words for one text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    w = find_words(raw, np.array([0, len(raw)]))
    return [w.word(i).decode() for i in range(len(w.starts))]


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes (one fewer per step; may span texts, the caller masks that)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * _BASE + words[i:i + n]
    return mix(out + np.uint64(size))


def group_hash(words: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """Order-aware hash of each text's whole word list."""
    n = len(words)
    up, down = _table("up", _BASE, n + 1), _table("down", _BASE_INV, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * up[:n], out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with one function per batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, new: T.StructType, fn: Callable[[pa.Array], dict[str, object]], text: str = "text") -> DataFrame:
    """Adds the columns ``new`` that ``fn`` makes of column ``text``; the others pass. A column of that name is replaced."""
    names = [f.name.lower() for f in new.fields]
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name == text]
    clash = [f.name for f in new.fields if f.name == text]
    out = T.StructType([f for f in kept if f.name not in clash] + new.fields)
    arrow = to_arrow_schema(out)
    source = df.select(*[f.name for f in kept])

    def run(whole: pa.RecordBatch):
        for at in range(0, whole.num_rows, CHUNK_ROWS):
            yield one(whole.slice(at, CHUNK_ROWS))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch.column(text))
        cols = [pa.array(made[f.name], type=f.type) if f.name in made and not isinstance(made[f.name], (pa.Array, pa.ChunkedArray))
                else made[f.name].cast(f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    return map_batches(source, run, out)

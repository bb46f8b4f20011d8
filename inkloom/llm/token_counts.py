"""Token counts by a two-tier lookup inside the tasks; no pre-token is ever shuffled.

A text is cut where two ASCII characters of different kind meet, around white space and around each ASCII digit, so every
pre-token of the tokenizer lies in one part. Characters outside ASCII are never cut from their neighbours, as they may
compose with them or belong to either kind, and an apostrophe stays with the letter after it; what such a part holds is
left to the library. The count of a text is the sum over its parts.

First tier: a broadcast open-addressed table of frequent parts of up to 16 bytes, keyed by those bytes and their number, so
a hit is exact. Second tier: each worker remembers the parts it had the library encode, in two generations of bounded size.
The table is learned from a sample of about ``sample`` rows (twice as many at most), chosen by a hash of id and text over
the whole table; it decides about speed alone: with any table, or none, the counts are those of the library.

Special strings of the tokenizer are one token each, as the library has it, and separate what stands around them.

Defined cases: null and empty texts and texts of white space have no tokens; repeated rows are counted alike; texts of any
length are worked through in slices cut at white space; other columns pass, a column named like a result is replaced.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import table
from .words import _buffers, mix, with_columns

SAMPLE = 1_000     # rows the table is learned from
FREQUENT = 65_536  # parts in the table, 18 bytes a slot and four slots a part at most
SLICE = 1 << 20    # bytes worked through at once
LIMIT = 2_048      # tokens above which a text is over the limit
_KEEP = 65_536     # parts a worker remembers, and as many from before
_KEPT_BYTES = 128  # longer parts are not remembered

_SPACE, _LETTER, _DIGIT, _OTHER, _WIDE, _APOSTROPHE = range(6)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:] = _WIDE
_KIND[0x27] = _APOSTROPHE


def _cuts() -> np.ndarray:
    """Whether a part ends between a byte of one kind and the next, at index 8 * kind + next kind."""
    cut = np.zeros((8, 8), dtype=bool)
    for a in range(6):
        for b in range(6):
            sign = {_OTHER, _APOSTROPHE}
            if _SPACE in (a, b):
                cut[a, b] = a != b
            elif _WIDE not in (a, b):
                cut[a, b] = (a != b or a == _DIGIT) and not (a in sign and b in sign) and (a, b) != (_APOSTROPHE, _LETTER)
    return cut.reshape(-1)


_CUT = _cuts()
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def parts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the parts of UTF-8 bytes; ``edges`` are places where a text begins."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    cut = np.empty(len(data), dtype=bool)
    cut[0] = True
    cut[1:] = _CUT[(kind[:-1] << 3) | kind[1:]]
    cut[edges[edges < len(data)]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(data))
    real = kind[at] != _SPACE
    return at[real], ends[real]


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first eight bytes, next eight, number of bytes) of parts of up to 16 bytes."""
    padded = np.concatenate((data, np.zeros(16, dtype=np.uint8)))
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    return eight[starts] & _LOW_BYTES[np.minimum(size, 8)], eight[starts + 8] & _LOW_BYTES[np.clip(size - 8, 0, 8)], size.astype(np.uint8)


class Frequent:
    """Open-addressed table from parts of up to 16 bytes to their number of tokens."""

    def __init__(self, lengths: dict[bytes, int]):
        known = [(p, n) for p, n in lengths.items() if 0 < len(p) <= 16 and 0 <= n < 256]
        slots = 1 << max(4, (2 * len(known)).bit_length())
        self.low, self.high = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
        self.size, self.tokens, self.reach = np.zeros(slots, dtype=np.uint8), np.zeros(slots, dtype=np.uint8), 0
        data = np.frombuffer(b"".join(p for p, _ in known), dtype=np.uint8)
        ends = np.cumsum([len(p) for p, _ in known], dtype=np.int64)
        starts = ends - np.array([len(p) for p, _ in known], dtype=np.int64)
        low, high, size = packed(data, starts, ends)
        homes = self._home(low, high, size)
        for i, (_, n) in enumerate(known):
            far, at = 0, int(homes[i])
            while self.size[at]:
                far, at = far + 1, (at + 1) % slots
            self.low[at], self.high[at], self.size[at], self.tokens[at] = low[i], high[i], size[i], n
            self.reach = max(self.reach, far)

    def _home(self, low, high, size):
        return (mix(low ^ mix(high + size)) & np.uint64(len(self.size) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each part, -1 for parts that are not in the table."""
        out = np.full(len(low), -1, dtype=np.int64)
        todo, at = np.arange(len(low)), self._home(low, high, size)
        for _ in range(self.reach + 1):
            same = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (self.size[at] == size[todo])
            out[todo[same]] = self.tokens[at[same]]
            on = ~same & (self.size[at] > 0)
            todo, at = todo[on], (at[on] + 1) % len(self.size)
            if not len(todo):
                break
        return out


class Counts:
    """Counts by one tokenizer in one worker."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encoded(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each part by the library."""
        return [len(e.ids) for e in self.library.encode_batch([p.decode(errors="replace") for p in pieces], add_special_tokens=False)]

    def remembered(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each part, encoded once and then from memory."""
        new, old, out, fresh = self.new, self.old, np.zeros(len(pieces), dtype=np.int64), {}
        for i, p in enumerate(pieces):
            n = new.get(p)
            if n is None and (n := old.get(p)) is not None:
                new[p] = n
            if n is None:
                fresh.setdefault(p, []).append(i)
            else:
                out[i] = n
        names = list(fresh)
        for p, n in zip(names, self.encoded(names)):
            out[fresh[p]] = n
            if len(p) <= _KEPT_BYTES:
                new[p] = n
        if len(new) > _KEEP:
            self.new, self.old = {}, dict(list(new.items())[-_KEEP:])
        return out

    def of_texts(self, texts: pa.Array, frequent: Frequent, slice_bytes: int = SLICE) -> np.ndarray:
        """Tokens of every text of a column."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        total = np.zeros(len(texts), dtype=np.int64)
        for special in self.special:
            n = np.asarray(pc.fill_null(pc.count_substring(texts, special), 0), dtype=np.int64)
            if n.any():
                total += n
                texts = pc.replace_substring(texts, special, " ")
        raw, offsets = _buffers(texts)
        for lo, hi in slices(raw, offsets, slice_bytes):
            data = raw[lo:hi]
            inside = offsets[(offsets >= lo) & (offsets < hi)] - lo
            starts, ends = parts(data, inside)
            found = np.full(len(starts), -1, dtype=np.int64)
            short = np.flatnonzero(ends - starts <= 16)
            found[short] = frequent.find(*packed(data, starts[short], ends[short]))
            missed = np.flatnonzero(found < 0)
            if len(missed):
                whole = data.tobytes()
                found[missed] = self.remembered([whole[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist())])
            owner = np.searchsorted(offsets, starts + lo, side="right") - 1
            first = owner[0] if len(owner) else 0
            n = np.bincount(owner - first, weights=found).astype(np.int64) if len(owner) else found
            total[first:first + len(n)] += n
        return total


def slices(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end before white space or where a text ends, so that no part is cut."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + size, end)
        if hi < end:
            text_end = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            gap = np.flatnonzero(_KIND[raw[lo + 1:hi + 1]] == _SPACE)
            hi = max(text_end, lo + 1 + int(gap[-1]) if len(gap) else lo)
            at = lo + 1
            while hi <= lo:  # one part longer than a slice
                hi = min(at + size, int(offsets[np.searchsorted(offsets, at, side="left")]))
                gap = np.flatnonzero(_KIND[raw[at:hi]] == _SPACE)
                at, hi = hi, (at + int(gap[0]) if len(gap) else hi if hi in offsets else lo)
        yield lo, hi
        lo = hi


_workers: dict[str, Counts] = {}


def counts(spec: str) -> Counts:
    """The counter of this process; another tokenizer replaces it."""
    if spec not in _workers:
        _workers.clear()
        _workers[spec] = Counts(spec)
    return _workers[spec]


def frequent_parts(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, keep: int = FREQUENT) -> list[bytes]:
    """The most frequent parts of up to 16 bytes in about ``sample`` rows; ``keep`` bounds what reaches the driver."""
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where((F.pmod(F.xxhash64(id_col, text), F.lit(1 << 40)) < int(share * (1 << 40))) & F.col(text).isNotNull()) \
        .select(F.col(text).alias("text")).limit(2 * sample)

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            raw, offsets = _buffers(batch.column(0))
            for lo, hi in slices(raw, offsets, SLICE):
                data = raw[lo:hi]
                starts, ends = parts(data, offsets[(offsets >= lo) & (offsets < hi)] - lo)
                short = ends - starts <= 16
                whole = data.tobytes()
                seen.update([whole[a:b] for a, b in zip(starts[short].tolist(), ends[short].tolist())])
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:keep]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary())], ["part"])

    return [bytes(r["part"]) for r in chosen.mapInArrow(run, "part binary").limit(keep).collect()]


def count_tokens(docs: DataFrame, *, tokenizer: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT,
                 sample: int = SAMPLE) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit; ``tokenizer`` is the file of a vocabulary, read by the driver alone."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    known = frequent_parts(docs, text=text, id_col=id_col, sample=sample) if sample else []
    frequent = Frequent(dict(zip(known, Counts(spec).encoded(known))))
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent))  # a vocabulary file and at most FREQUENT parts

    def run(column: pa.Array) -> dict:
        spec, frequent = shared.value
        return {"n_tokens": counts(spec).of_texts(column, frequent)}

    made = with_columns(docs, T.StructType([T.StructField("n_tokens", T.LongType())]), run, text)
    return made.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

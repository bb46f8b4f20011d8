"""SentencePiece encoding and decoding by a max-plus scan over a lattice of pieces.

The lattice has a node for each place of a text and each piece that ends there. The vocabulary at hand is of the BPE kind,
so a step between neighbouring pieces weighs 0 if merging their joined characters gives just these two pieces back, and
minus infinity otherwise. A sequence whose neighbours all fit is what merging the whole text gives, and there is only one;
the best path of the lattice is therefore the library's encoding, id by id.

Texts up to ``giant`` characters are one chunk, scanned from the start. Longer ones are cut into chunks that many tasks
take. A chunk yields a transfer matrix between the pieces that cross its left and its right cut; matrices are multiplied
(max-plus, associative) in groups of at most ``FAN`` per level; the products give back to each chunk the pieces possible at
its left cut and the one chosen at its right cut, and each chunk then backtraces alone.

Within a chunk, runs that no piece can leave (a word with the spaces before it, a character that stands only alone) are
scanned once and remembered. Short runs of ASCII and Latin-1 letters met for the first time are scanned side by side, place
by place in numpy.

Defined cases: null texts have null ids and decode to null; empty texts have no ids; characters outside the vocabulary
become byte pieces; U+2581 decodes to a space, as in the library; repeated rows are encoded alike; columns named like a
result are replaced. All other texts come back exactly.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .near_dup import row_keys
from .store import stored, table
from .words import map_batches, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 32_768   # characters; longer texts are cut
CHUNK = 16_384
FAN = 64         # matrices multiplied by one task at a level
_KEEP = 250_000  # runs a worker remembers, about 45 MB, and as many pairs, 30 MB
_AT_ONCE = 50_000  # runs looked up at once
_TEXTS = 64        # texts decoded at once
_CHUNKS = 32       # chunks of long texts held as Python objects at once
_SHORT = 32        # characters of a run that is scanned side by side with others
_SLOTS = 20        # bits of a place in the table of pairs, 8 MB
_MARK = "▁"
_START = 0       # node before the first piece
_EDGE = 63       # node of a cut that is itself a free place


class Lattice:
    """Vocabulary of one model file with its admissible neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(_MARK, " ").encode())
        self.width = max(map(len, self.ids))
        near: dict[str, set[str]] = {}  # characters that stand side by side in some piece
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        ascii_ = {chr(c) for c in range(128)}
        alone = ascii_ - near.keys()
        signs = {c for c in ascii_ - alone if not c.isalnum() and not any(x.isalpha() or x > "\x7f" and x != _MARK for x in near[c])}
        one, sign = (re.escape("".join(sorted(x or {"\n"}))) for x in (alone, signs))
        word = f"a-zA-Z\x80-{chr(ord(_MARK) - 1)}{chr(ord(_MARK) + 1)}-\U0010ffff"
        # no piece holds a letter beside a sign, so runs end there; anything else runs up to the next space
        self.runs = re.compile(f"[{one}]|{_MARK}*[{word}]+(?=[{sign}{_MARK}{one}]|\\Z)|{_MARK}*[{sign}]+(?=[{word}{_MARK}{one}]|\\Z)|{_MARK}*[^{one}{_MARK}]+|{_MARK}+")
        self.cut = re.compile(f"(?<!{_MARK})(?={_MARK})|(?<=[{one}])|(?=[{one}])|(?<=[{word}])(?=[{sign}])|(?<=[{sign}])(?=[{word}])")
        self._fits: dict[int, bool] = {}
        self._steps: dict[str, list[tuple[float, str, str]]] = {}
        self._forget()
        lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._bytes, self._byte_end = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8), np.cumsum(lengths)
        self._byte_len = lengths
        self.pieces = {p: i for p, i in self.ids.items() if len(p) == 1 or self.steps(p)[-1:] and self.steps(p)[-1][1] == p}
        self._plant()

    def _plant(self) -> None:
        """Tree of the pieces of printable ASCII, Latin-1 letters and the mark, read from their last character to their first."""
        letters = [chr(c) for c in range(33, 127)] + [c for c in (*map(chr, range(0xC0, 0x100)), _MARK) if c in self.pieces]
        number = {c: k for k, c in enumerate(letters)}
        self._letter = np.full(1 << 14, -1, dtype=np.int32)
        self._letter[[ord(c) for c in letters]] = np.arange(len(letters))
        child: dict[tuple[int, int], int] = {}
        ends, self._named = [-1], {}  # code of the piece that is read in full at a node
        for piece in dict.fromkeys((*letters, *self.pieces)):
            if all(c in number for c in piece):
                at = 0
                for c in reversed(piece):
                    at = child.setdefault((at, number[c]), len(ends))
                    if at == len(ends):
                        ends.append(-1)
                ends[at] = self.code(piece)
                self._named[ends[at]] = piece
        self._down = np.zeros((len(ends), len(letters)), dtype=np.min_scalar_type(len(ends)))  # child by letter, 0 none
        where = np.array(list(child))
        self._down[where[:, 0], where[:, 1]] = list(child.values())
        self._at_node = np.array(ends, dtype=np.int64)
        self._pairs = np.full(1 << _SLOTS, -1, dtype=np.int64)  # 2 * pair + whether it fits; a later pair takes the place of an earlier one

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for pairs of codes."""
        pair = left << 22 | right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        found = self._pairs[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            known, named = self._fits, self._named
            if len(known) > _KEEP:
                known.clear()
            each, first, place = np.unique(pair[new], return_index=True, return_inverse=True)
            good = []
            for p in each.tolist():
                ok = known.get(p)
                if ok is None:
                    ok = known[p] = self.fits(named[p >> 22], named[p & (1 << 22) - 1])
                good.append(ok)
            answer = each << 1 | np.array(good, dtype=np.int64)
            self._pairs[slot[new][first]] = answer
            found[new] = answer[place]
        return (found & 1).astype(bool)

    def short_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the runs one after the other, how many each has, whether a run was taken): ``run_path`` for many runs at once.

        Taken are runs of at most ``_SHORT`` characters, all of them in the tree.
        """
        size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        chars = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = np.where(chars < len(self._letter), self._letter[np.minimum(chars, len(self._letter) - 1)], -1)
        begin = np.cumsum(size) - size
        taken = (size <= _SHORT) & (np.minimum.reduceat(letter, begin) >= 0)
        order = np.flatnonzero(taken)
        order = order[np.argsort(-size[order], kind="stable")]  # those that reach a place stand first
        long, first = size[order], begin[order]
        most = int(long[0]) if len(order) else 0
        last, code = np.zeros((most + 1, len(order)), dtype=np.int64), np.full((most + 1, len(order)), -1, dtype=np.int64)
        for x in range(1, most + 1):
            row = np.arange(np.searchsorted(-long, -x, side="right"))
            node = np.zeros(len(row), dtype=np.int64)
            for n in range(1, x + 1):
                node = self._down[node, letter[first[row] + x - n]].astype(np.int64)
                row, node = row[node > 0], node[node > 0]
                if not len(row):
                    break
                own, left = self._at_node[node], code[x - n][row]
                good = own >= 0
                check = np.flatnonzero(good & (left >= 0))
                good[check] = self._fitting(left[check], own[check])
                last[x, row[good]], code[x, row[good]] = n, own[good]
                row, node = row[~good], node[~good]
        found = np.full((most, len(order)), -1, dtype=np.int64)  # pieces from the last to the first
        at, row = long.copy(), np.arange(len(order))
        for k in range(most):
            found[k, row] = code[at[row], row]
            at[row] -= last[at[row], row]
            row = row[at[row] > 0]
            if not len(row):
                break
        count = np.zeros(len(runs), dtype=np.int64)
        count[order] = (found >= 0).sum(axis=0)
        byrun = found[::-1].T[np.argsort(order)]
        flat = byrun[byrun >= 0]
        outside = flat >= 1 << 21
        if outside.any():  # all ASCII, so one byte each
            flat[outside] = np.array(self.byte_id)[flat[outside] - (1 << 21)]
        return flat.astype(np.int32), count[taken], taken

    def steps(self, piece: str) -> list[tuple[float, str, str]]:
        """Merges inside ``piece`` alone, in order: (score, then first part, then last part)."""
        got = self._steps.get(piece)
        if got is None:
            parts, got = list(piece), []
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                got.append((best, parts[0], parts[-1]))
            self._steps[piece] = got
        return got

    def whole(self, piece: str) -> bool:
        """Whether merging the characters of ``piece`` gives it back; other pieces never come out."""
        return len(piece) == 1 or piece in self.pieces

    def fits(self, left: str, right: str) -> bool:
        """Whether merging left + right never joins across their border: the merges of both run side by side, best first."""
        score, i, j = self.score, 0, 0
        a, b, mine, others = left[-1], right[0], self.steps(left), self.steps(right)
        while True:
            s = mine[i][0] if i < len(mine) else None
            t = others[j][0] if j < len(others) else None
            over = score.get(a + b)
            if over is not None and (s is None or over > s) and (t is None or over >= t):
                return False
            if s is not None and (t is None or s >= t):
                a, i = mine[i][2], i + 1
            elif t is not None:
                b, j = others[j][1], j + 1
            else:
                return True

    def forward(self, text: str, seeds: dict[int, int], begin: int, end: int) -> dict[int, int]:
        """Length of the piece that ends at each place in (begin, end], for paths from ``seeds`` (place: length, 0 none before)."""
        last, pieces, width, known = dict(seeds), self.pieces, self.width, self._fits
        code = {x: self.code(text[x - n:x]) if n else -1 for x, n in seeds.items()}
        for x in range(begin + 1, end + 1):
            if x in last:
                continue
            for y in range(x - 1, max(begin, x - width) - 1, -1):
                own = pieces.get(text[y:x])
                if own is None:
                    if y < x - 1:
                        continue
                    own = self.code(text[y:x])
                left = code.get(y)
                if left is None:
                    continue
                if left >= 0:
                    good = known.get(left << 22 | own)
                    if good is None:
                        if len(known) > _KEEP:
                            known.clear()
                        good = known[left << 22 | own] = self.fits(text[y - last[y]:y], text[y:x])
                    if not good:
                        continue
                last[x], code[x] = x - y, own
                break
        return last

    def run_path(self, run: str) -> list[str]:
        """Pieces of a run on its own: ``forward`` and ``back`` from place 0, from where every place has one path.

        As only one piece can end at a place, the order of trial is free: first the last piece grown by a character.
        """
        pieces, width, known, fits = self.pieces, self.width, self._fits, self.fits
        if len(known) > _KEEP:
            known.clear()
        size = len(run)
        last, code = [0] * (size + 1), [-1] * (size + 1)
        for x in range(1, size + 1):
            grown = x - 1 - last[x - 1]
            for y in (grown, *range(x - 1, max(0, x - width) - 1, -1)) if grown < x - 1 else range(x - 1, max(0, x - width) - 1, -1):
                own = pieces.get(run[y:x])
                if own is None:
                    if y < x - 1:
                        continue
                    own = self.code(run[y:x])
                left = code[y]
                if left >= 0:
                    good = known.get(left << 22 | own)
                    if good is None:
                        good = known[left << 22 | own] = fits(run[y - last[y]:y], run[y:x])
                    if not good:
                        continue
                last[x], code[x] = x - y, own
                break
        out, at = [], size
        while at:
            out.append(run[at - last[at]:at])
            at -= last[at]
        return out[::-1]

    def code(self, piece: str) -> int:
        """Number of a piece; characters outside the vocabulary have numbers of their own."""
        got = self.pieces.get(piece)
        return got if got is not None else 1 << 21 | ord(piece)

    def to_ids(self, pieces: list[str]) -> array:
        out = array("i")
        for p in pieces:
            i = self.ids.get(p)
            out.extend([i] if i is not None else [self.byte_id[b] for b in p.encode()])
        return out

    def back(self, text: str, last: dict[int, int], at: int, stop: dict[int, int], begin: int) -> list[str]:
        """Pieces from place ``at`` back to a seed, in order."""
        out = []
        while not (at in stop and at >= begin and last[at] == stop[at]):
            n = last[at]
            out.append(text[at - n:at])
            at -= n
        return out[::-1]

    def _forget(self) -> None:
        """Keeps the remembered runs that were asked for most, half of the room; their counts are halved."""
        index = getattr(self, "_index", {})
        least = np.sort(self._asked[list(index.values())])[-(_KEEP // 2)] if len(index) > _KEEP // 2 else 0
        kept = [(run, self._ids_of(n), self._asked[n] // 2) for run, n in index.items() if self._asked[n] > least]
        self._index: dict[str, int] = {}
        self._flat, self._ends = array("i"), array("q", [0])  # ids of run n are flat[ends[n]:ends[n + 1]]
        self._asked = np.zeros(_KEEP, dtype=np.int32)
        for run, ids, asked in kept:
            self._asked[self._remember(run, ids)] = asked

    def _ids_of(self, n: int) -> array:
        return self._flat[self._ends[n]:self._ends[n + 1]]

    def _remember(self, run: str, ids: array) -> int:
        self._index[run] = n = len(self._ends) - 1
        self._flat.extend(ids)
        self._ends.append(len(self._flat))
        if n >= len(self._asked):
            self._asked = np.concatenate((self._asked, np.zeros(len(self._asked), dtype=np.int32)))
        return n

    def _scan(self, runs: list[str]) -> list[str]:
        """Remembers distinct runs not met before; returns those too long to stay."""
        ids, count, taken = self.short_ids(runs)
        n = len(self._ends) - 1
        self._index.update(zip(compress(runs, taken.tolist()), range(n, n + len(count))))
        self._ends.frombytes((np.cumsum(count) + len(self._flat)).astype(np.int64).tobytes())
        self._flat.frombytes(ids.tobytes())
        if n + len(count) > len(self._asked):
            self._asked = np.concatenate((self._asked, np.zeros(max(len(self._asked), len(count)), dtype=np.int32)))
        others = list(compress(runs, (~taken).tolist()))
        for run in others:
            self._remember(run, self.to_ids(self.run_path(run)))
        return [run for run in others if len(run) > 64]

    def run_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs one after the other, how many there are up to the end of each run)."""
        if len(self._index) > _KEEP or len(self._flat) > 16 * _KEEP:
            self._forget()
        number = np.fromiter(map(self._index.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
        missing = np.flatnonzero(number < 0).tolist()
        passing = self._scan(list(dict.fromkeys(map(runs.__getitem__, missing)))) if missing else []
        number[missing] = [self._index[runs[i]] for i in missing]
        np.add.at(self._asked, number, 1)
        ends = np.frombuffer(self._ends, dtype=np.int64)
        start, size = ends[number], ends[number + 1] - ends[number]
        upto = np.cumsum(size)
        ids = np.frombuffer(self._flat, dtype=np.int32)[_spread(start, size, upto)] if len(runs) and upto[-1] else np.zeros(0, dtype=np.int32)
        for run in passing:  # long runs hardly come again
            del self._index[run]
        return ids, upto

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many there are up to the end of each text); a null text has none."""
        parts, counts, runs, ends = [], [], [], []

        def flush():
            ids, upto = self.run_ids(runs)
            before = np.concatenate(([0], upto))[np.concatenate(([0], ends))]
            parts.append(ids)
            counts.append(np.diff(before))
            runs.clear()
            ends.clear()

        for text in texts:
            if text:
                runs.extend(self.runs.findall(normal(text)))
            ends.append(len(runs))
            if len(runs) > _AT_ONCE:
                flush()
        if ends:
            flush()
        return np.concatenate(parts or [np.zeros(0, dtype=np.int32)]), np.cumsum(np.concatenate(counts or [np.zeros(0, dtype=np.int64)]))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists; the bytes are gathered for all at once, text by text only the decoding is left."""
        size = self._byte_len[ids]
        upto = np.cumsum(size)
        raw = self._bytes[_spread(self._byte_end[ids] - size, size, upto)].tobytes() if len(ids) and upto[-1] else b""
        at = np.concatenate(([0], upto))[offsets].tolist()
        return [raw[a + (raw[a:a + 1] == b" " and a < b):b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    # -- chunks: nodes are coded (place beyond the cut) * 64 + length; _START stands before the text

    def _seeds(self, nodes, cut: int) -> dict[int, int]:
        return {cut: 0} if nodes[0] in (_START, _EDGE) else {cut + n // 64: n % 64 for n in nodes}

    def _nodes(self, text: str, cut: int) -> list[int]:
        """All pieces that end at or cross ``cut``."""
        return [off * 64 + n for off in range(self.width) for n in range(off + 1, self.width + 1)
                if cut + off <= len(text) and cut + off - n >= 0 and self.whole(text[cut + off - n:cut + off])]

    def _crossing(self, last: dict[int, int], cut: int) -> list[int]:
        return [off * 64 + last[cut + off] for off in range(self.width) if last.get(cut + off, 0) > off]

    def _ahead(self, text: str, seeds: dict[int, int], begin: int, end: int) -> dict[int, int]:
        last = self.forward(text, seeds, begin, end)
        edge = min(len(text), end + self.width - 1)
        for x in range(end + 1, edge + 1):  # pieces over the right cut start before it
            for n in range(x - end + 1, self.width + 1):
                y = x - n
                m = last.get(y)
                if y < begin or m is None or x in last:
                    continue
                piece = text[y:x]
                if self.whole(piece) and (m == 0 or self.fits(text[y - m:y], piece)):
                    last[x] = n
        return last

    def _free(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last place in [begin, end] that no piece can cross, None without one."""
        first = self.cut.search(text, begin, min(len(text), end + 1))
        if first is None or first.start() > end:
            return None
        size = 64
        while True:
            lo = max(first.start(), end - size)
            found = [m.start() for m in self.cut.finditer(text, lo, min(len(text), end + 1)) if m.start() <= end]
            if found:
                return first.start(), found[-1]
            size *= 8

    def transfer(self, text: str, begin: int, end: int, first: bool) -> dict[str, list[int]]:
        """Matrix of a chunk as {node at the left cut: nodes at the right cut}; all other entries are minus infinity."""
        out: dict[str, list[int]] = {}
        free = self._free(text, begin, end)
        rest = self._crossing(self._ahead(text, {free[1]: 0}, free[1], end), end) or [_EDGE] if free else []
        for node in [_START] if first else [_EDGE, *self._nodes(text, begin)]:
            seeds = self._seeds([node], begin)
            if not free:
                reached = self._crossing(self._ahead(text, seeds, begin, end), end)
            else:  # behind a free place all paths go on alike
                reached = rest if free[0] in self.forward(text, seeds, begin, free[0]) else []
            if reached:
                out[str(node)] = reached
        return out

    def chunk_ids(self, text: str, begin: int, end: int, left: list[int], right: int) -> array:
        """Ids of the pieces that start in the chunk, on the path from one of ``left`` to ``right``."""
        seeds, free = self._seeds(left, begin), self._free(text, begin, end)
        if not free:
            return self.to_ids(self.back(text, self._ahead(text, seeds, begin, end), end + right // 64, seeds, begin))
        head = self.back(text, self.forward(text, seeds, begin, free[0]), free[0], seeds, begin)
        out = self.to_ids(head)
        out.frombytes(self.run_ids(self.runs.findall(text[free[0]:free[1]]))[0].tobytes())
        start = {free[1]: 0}
        if right != _EDGE:
            out.extend(self.to_ids(self.back(text, self._ahead(text, start, free[1], end), end + right // 64, start, free[1])))
        return out


def normal(text: str) -> str:
    return _MARK + text.replace(" ", _MARK)


def _spread(start: np.ndarray, size: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Places start[0], start[0] + 1, ... of every stretch, one stretch after the other."""
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1])


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def times(a: dict[str, list[int]], b: dict[str, list[int]]) -> dict[str, list[int]]:
    """Max-plus product of two transfer matrices with entries 0 and minus infinity."""
    out = {}
    for node, mids in a.items():
        reached = sorted({r for m in mids for r in b.get(str(m), ())})
        if reached:
            out[node] = reached
    return out


def _int_lists(parts: list[array | None]) -> pa.Array:
    flat = array("i")
    for p in parts:
        flat.extend(p or ())
    offsets = np.concatenate(([0], np.cumsum([len(p or ()) for p in parts]))).astype(np.int32)
    mask = pa.array([p is None for p in parts]) if any(p is None for p in parts) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, dtype=np.int32)), mask=mask)


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK,
           decoded: str | None = None) -> DataFrame:
    """``docs`` with column ids, and with column ``decoded``, if named, as ``decode`` gives it.

    Asked for together, ids of short texts are decoded where they were made, so a task needs one worker instead of two.
    """
    new = T.StructType([*IDS.fields, *([T.StructField(decoded, T.StringType())] if decoded else [])])
    size = F.coalesce(F.char_length(text), F.lit(0))

    def plain(texts: pa.Array) -> dict:
        lat = lattice(model)
        known = texts.to_pylist()
        ids, upto = lat.encode_all(known)
        mask = pa.array([t is None for t in known]) if texts.null_count else None
        made = {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), pa.array(ids), mask=mask)}
        return made | ({decoded: _decoded(lat, made["ids"])} if decoded else {})

    small = with_columns(docs.where(size <= giant), new, plain, text)
    k1, k2 = row_keys(text, id_col)
    long_docs = docs.where(size > giant).withColumns({"_k1": k1, "_k2": k2})
    made = giant_ids(long_docs.select("_k1", "_k2", F.col(text).alias("text")).dropDuplicates(["_k1", "_k2"]), model, chunk)
    big = long_docs.drop("ids").join(made, ["_k1", "_k2"]).select(*[c for c in docs.columns if c.lower() != "ids"], "ids")
    return small.unionByName(decode(big, model=model, into=decoded) if decoded else big)


_PART = T.StructType([T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType()), T.StructField("c", T.IntegerType()),
                      T.StructField("last", T.BooleanType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
                      T.StructField("piece", T.StringType())])


def _cut(texts: DataFrame, model: str, chunk: int) -> DataFrame:
    """Chunks with as much text on both sides as a piece can reach."""
    arrow = to_arrow_schema(_PART)

    def run(batch):
        margin = 2 * lattice(model).width
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("_k1", "_k2", "text"))):
            whole = normal(text)
            n = -(-len(whole) // chunk)
            for lo in range(0, n, 256):
                rows = []
                for c in range(lo, min(n, lo + 256)):
                    a, b = c * chunk, min(len(whole), (c + 1) * chunk)
                    left = max(0, a - margin)
                    rows.append({"_k1": k1, "_k2": k2, "c": c, "last": c == n - 1, "begin": a - left, "end": b - left, "piece": whole[left:b + margin]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return map_batches(texts.select("_k1", "_k2", "text"), run, _PART)


def _multiply(level: DataFrame) -> DataFrame:
    """Products of runs of FAN neighbours: (k, c) -> (k, c // FAN)."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        total = None
        for t in pdf["t"]:
            total = json.loads(t) if total is None else times(total, json.loads(t))
        return pd.DataFrame({"_k1": pdf["_k1"][:1], "_k2": pdf["_k2"][:1], "c": pdf["_g"][:1], "t": [json.dumps(total)]})

    return level.withColumn("_g", F.expr(f"cast(c div {FAN} as int)")).groupBy("_k1", "_k2", "_g").applyInPandas(product, "_k1 long, _k2 long, c int, t string")


def _hand_down(parents: DataFrame, level: DataFrame) -> DataFrame:
    """From the states at a group's cuts to those at the cuts of its members."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        tables = [json.loads(t) for t in pdf["t"]]
        lefts = [json.loads(pdf["left"].iloc[0])]
        for t in tables[:-1]:
            lefts.append(sorted({r for n in lefts[-1] for r in t.get(str(n), ())}))
        rights = [int(pdf["right"].iloc[0])]
        for t, left in zip(tables[:0:-1], lefts[:0:-1]):
            rights.append(next(n for n in left if rights[-1] in t.get(str(n), ())))
        return pd.DataFrame({"_k1": pdf["_k1"], "_k2": pdf["_k2"], "c": pdf["c"], "left": [json.dumps(x) for x in lefts], "right": rights[::-1]})

    inner = level.withColumn("_g", F.expr(f"cast(c div {FAN} as int)"))
    up = parents.select("_k1", "_k2", F.col("c").alias("_g"), "left", "right")
    return inner.join(up, ["_k1", "_k2", "_g"]).groupBy("_k1", "_k2", "_g").applyInPandas(split, "_k1 long, _k2 long, c int, left string, right int")


def giant_ids(texts: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(_k1, _k2, ids) of long texts (_k1, _k2, text): cut, matrices, products up, states down, backtraces, joined in order."""
    spread = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = stored(_cut(texts, model, chunk).repartition(spread, "_k1", "_k2", "c"), "chunks")
    schema = T.StructType([*_PART.fields[:3], T.StructField("t", T.StringType())])
    arrow = to_arrow_schema(schema)

    def matrices(whole):
        lat = lattice(model)
        for at in range(0, whole.num_rows, _CHUNKS):
            rows = [{"_k1": r["_k1"], "_k2": r["_k2"], "c": r["c"],
                     "t": json.dumps(lat.transfer(r["piece"], r["begin"], r["end"], r["c"] == 0))} for r in whole.slice(at, _CHUNKS).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    levels = [stored(map_batches(parts, matrices, schema), "matrices")]
    width = (parts.agg(F.max("c")).first()[0] or 0) + 1
    while width > 1:
        levels.append(stored(_multiply(levels[-1]), "products"))
        width = -(-width // FAN)
    top = levels[-1].withColumn("left", F.lit(f"[{_START}]"))

    def end_node(t: pd.Series) -> pd.Series:
        return t.map(lambda s: next(n for n in json.loads(s)[str(_START)] if n < 64))

    states = top.withColumn("right", F.pandas_udf(end_node, T.IntegerType())("t")).select("_k1", "_k2", "c", "left", "right")
    for level in reversed(levels[:-1]):
        states = _hand_down(states, level)
    found = T.StructType([*_PART.fields[:3], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    found_arrow = to_arrow_schema(found)

    def backtraces(whole):
        lat = lattice(model)
        for at in range(0, whole.num_rows, _CHUNKS):
            batch = whole.slice(at, _CHUNKS)
            ids = _int_lists([lat.chunk_ids(r["piece"], r["begin"], r["end"], json.loads(r["left"]), r["right"]) for r in batch.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), batch.column("c"), ids.cast(found_arrow.field("ids").type)], schema=found_arrow)

    joined = parts.join(states, ["_k1", "_k2", "c"]).select("_k1", "_k2", "c", "begin", "end", "piece", "left", "right")
    done = map_batches(joined, backtraces, found)
    return done.groupBy("_k1", "_k2").agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(c, ids))), x -> x.ids)")).alias("ids"))


def _decoded(lat: Lattice, column: pa.Array) -> list[str | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, known = column.offsets.to_numpy(), column.is_valid().to_pylist()
    out = []
    for lo in range(0, len(column), _TEXTS):
        part = offsets[lo:lo + _TEXTS + 1]
        out += lat.decode_all(column.values.slice(part[0], part[-1] - part[0]).to_numpy(zero_copy_only=False).astype(np.int64), part - part[0])
    return [t if ok else None for t, ok in zip(out, known)]


def decode(df: DataFrame, *, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with column ``into``: the text of its ids."""

    def run(column: pa.Array) -> dict:
        return {into: _decoded(lattice(model), column)}

    return with_columns(df, T.StructType([T.StructField(into, T.StringType())]), run, ids)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded="decoded").select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
                                       F.col("decoded").eqNullSafe(F.regexp_replace("text", _MARK, " ")).alias("round_trip"))

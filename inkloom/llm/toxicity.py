"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are the words of a text, labels are "toxic" or "other". Training tokens are labelled from document labels: in toxic
documents, words whose form or beginning is tied to toxic documents beyond chance carry the toxic label; all other tokens
are "other". The field weighs hashed features of a token (its form, its beginnings and its end) and the label pairs; it
is fitted by stochastic gradient on the exact likelihood with forward-backward. Scoring runs forward-backward over every
whole text in the tasks. ``score`` comes from the sum of squared marginals through a fitted logistic curve, and the
tokens whose marginal reaches ``span_threshold`` give the offending offsets.

The fit uses at most ``FIT_ROWS`` labelled documents of each class, of at most ``FIT_CHARS`` characters, taken by a hash
of the id; copies among them count once. Everything else covers all rows and whole texts.

Defined cases: null and empty texts have no tokens, no spans and the score of a zero sum; without labelled
rows of both classes all token weights are zero; several labels of an id count as the largest; null labels are left out;
repeated rows are scored alike; columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .near_dup import band_keys, elements, throw_darts
from .store import table
from .words import Words, with_columns, word_chunks

FIT_ROWS = 1500
FIT_CHARS = 8_000
FEATURE_BITS = 18
SEED = 7

RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


@dataclass
class Field:
    weights: np.ndarray     # hashed feature -> score of "toxic" over "other"
    moves: np.ndarray       # other->toxic, toxic->other, toxic->toxic, over other->other
    start: float
    curve: tuple[float, float]


def features(w: Words) -> list[np.ndarray]:
    """Feature numbers of every token, one array a kind."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    length = w.ends - w.starts
    kinds = [w.hashes()]
    kinds += [w.span_hash(w.starts, w.starts + np.minimum(length, n)) for n in (3, 4, 5, 6)]
    kinds.append(w.span_hash(w.ends - np.minimum(length, 4), w.ends))
    return [((h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2 ** 64 - 1))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20) & mask).astype(np.int64)
            for i, h in enumerate(kinds)]


def _sweeps(first: np.ndarray):
    """(texts, tokens) of each step; texts by falling length, so that those still running are a prefix."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    falling = -count[order]
    for t in range(int(count.max(initial=0))):
        n = int(np.searchsorted(falling, -t, side="left"))
        yield order[:n], first[order[:n]] + t


def _soft(x: np.ndarray, moves_from_other: float, moves_from_toxic: float) -> np.ndarray:
    return np.logaddexp(moves_from_other, x + moves_from_toxic)


def marginals(emit: np.ndarray, first: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, logit): log odds of "toxic" from the left, from the right, and of the marginal."""
    to_toxic, to_other, stay = f.moves
    fwd, bwd = np.empty(len(emit)), np.zeros(len(emit))
    steps = list(_sweeps(first))
    for t, (_, at) in enumerate(steps):
        if t == 0:
            fwd[at] = emit[at] + f.start
        else:
            x = fwd[at - 1]
            fwd[at] = emit[at] + _soft(x, to_toxic, stay) - _soft(x, 0.0, to_other)
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t][1]
        z = emit[at] + bwd[at]
        bwd[at - 1] = _soft(z, to_other, stay) - _soft(z, 0.0, to_toxic)
    return fwd, bwd, fwd + bwd


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x)))


def tie_to_label(kinds: list[np.ndarray], doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents that carry a feature tied to them: likelihood ratio over 30 and twenty times as frequent."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    tied = np.zeros(len(doc), dtype=bool)
    for kind in kinds:
        pair = np.unique(np.stack((doc, kind), axis=1), axis=0)
        own = y[pair[:, 0]] == 1
        a = np.bincount(pair[own, 1], minlength=1 << FEATURE_BITS)
        b = np.bincount(pair[~own, 1], minlength=1 << FEATURE_BITS)
        p, q, r = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 0.5) / (n1 + n0 + 1)
        part = lambda k, n, x, z: k * np.log(x / z) + (n - k) * np.log(np.maximum(1e-12, 1 - x) / np.maximum(1e-12, 1 - z))
        ratio = 2 * (part(a, n1, p, r) + part(b, n0, q, r))
        tied |= ((ratio > 30) & (p > 20 * q))[kind]
    return tied & (y[doc] == 1)


def distinct_texts(texts: list[str]) -> list[int]:
    """Places of texts that share no signature band with an earlier one, so that copies do not outvote the rest."""
    seen: set[int] = set()
    kept: list[int] = []
    for lo, hi, w in word_chunks(pa.array(texts, pa.string())):
        owner, element = elements(w)
        keys = band_keys(throw_darts(owner, element, hi - lo, 64), 16, 4)
        full = np.bincount(owner, minlength=hi - lo) > 0
        for d in range(hi - lo):
            own = keys[d].tolist() if full[d] else [0]
            if seen.isdisjoint(own):
                kept.append(lo + d)
            seen.update(own)
    return kept


def fit(texts: list[str], labels: list[int], *, epochs: int = 3, rate: float = 0.3, seed: int = SEED) -> Field:
    """Field fitted on labelled documents."""
    f = Field(np.zeros(1 << FEATURE_BITS, dtype=np.float32), np.array([-4.0, 0.0, -2.0]), -4.0, (-4.0, 1.0))
    kept = distinct_texts(texts)
    texts, y = [texts[i] for i in kept], np.array([labels[i] for i in kept], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return f
    parts = []
    for lo, hi, w in word_chunks(pa.array(texts, pa.string())):
        parts.append((features(w), np.diff(w.first)))
    kinds = [np.concatenate([p[0][k] for p in parts]) for k in range(len(parts[0][0]))]
    first = np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parts]))))
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    gold = tie_to_label(kinds, doc, y).astype(np.float64)
    table_ = np.stack(kinds, axis=1)
    seen, seen_moves = np.full(1 << FEATURE_BITS, 1e-3), np.full(4, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 48)):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in batch]) if len(batch) else np.zeros(0, int)
            if not len(rows):
                continue
            cut = np.concatenate(([0], np.cumsum(first[batch + 1] - first[batch])))
            emit = f.weights[table_[rows]].sum(axis=1, dtype=np.float64)
            fwd, bwd, logit = marginals(emit, cut, f)
            p, g = _sigmoid(logit), gold[rows]
            grad = np.bincount(table_[rows].ravel(), weights=np.repeat(g - p, table_.shape[1]), minlength=1 << FEATURE_BITS)
            touched = np.flatnonzero(grad)
            seen[touched] += grad[touched] ** 2
            f.weights[touched] += (rate * grad[touched] / np.sqrt(seen[touched]) - 1e-4 * f.weights[touched]).astype(np.float32)
            later = np.setdiff1d(np.arange(len(rows)), cut[:-1])  # tokens with one before them in their text
            x, z = fwd[later - 1], emit[later] + bwd[later]
            to_toxic, to_other, stay = f.moves
            score = np.stack((np.zeros_like(x), to_toxic + z, x + to_other, x + stay + z))
            score = np.exp(score - score.max(axis=0))
            pair = score / score.sum(axis=0)
            was, is_ = g[later - 1], g[later]
            step = np.array([((1 - was) * is_ - pair[1]).sum(), (was * (1 - is_) - pair[2]).sum(), (was * is_ - pair[3]).sum(),
                             (g[cut[:-1][cut[:-1] < len(g)]] - p[cut[:-1][cut[:-1] < len(g)]]).sum()])
            seen_moves += step ** 2
            step = rate * step / np.sqrt(seen_moves)
            f.moves, f.start = f.moves + step[:3], f.start + float(step[3])
    emit = f.weights[table_].sum(axis=1, dtype=np.float64)
    x = np.log(_mass(marginals(emit, first, f)[2], first) + 1e-6)
    f.curve = _curve(x, y)
    return f


def _mass(logit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of squared marginals of each text: toxic tokens, with doubtful ones counted down so that length alone does not add up."""
    total = np.concatenate(([0.0], np.cumsum(_sigmoid(logit) ** 2)))
    return total[first[1:]] - total[first[:-1]]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of y over x by Newton steps, with a weak pull to zero slope."""
    a, b = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0
    middle = x.mean()
    for _ in range(30):
        p = _sigmoid(a + b * (x - middle))
        v = np.maximum(p * (1 - p), 1e-6)
        d = x - middle
        g = np.array([(y - p).sum(), ((y - p) * d).sum() - 0.1 * b])
        h = np.array([[v.sum(), (v * d).sum()], [(v * d).sum(), (v * d * d).sum() + 0.1]])
        move = np.clip(np.linalg.solve(h + 1e-9 * np.eye(2), g), -2, 2)
        a, b = a + move[0], b + move[1]
    return float(a - b * middle), float(b)


def score_texts(texts: pa.Array, f: Field, span_threshold: float = 0.5) -> dict:
    scores, spans = [], []
    for lo, hi, w in word_chunks(texts):
        emit = np.zeros(len(w.starts))
        for kind in features(w):
            emit += f.weights[kind]
        logit = marginals(emit, w.first, f)[2]
        x = np.log(_mass(logit, w.first) + 1e-6)
        scores.extend(_sigmoid(f.curve[0] + f.curve[1] * x).tolist())
        hot = np.flatnonzero(_sigmoid(logit) >= span_threshold)
        found: list[list[dict]] = [[] for _ in range(hi - lo)]
        owner = np.searchsorted(w.first, hot, side="right") - 1
        for d in np.unique(owner).tolist():
            own = hot[owner == d]
            o = int(w.offsets[d])
            point = np.concatenate(([0], np.cumsum((w.raw[o:w.offsets[d + 1]] & 0xC0) != 0x80)))
            runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
            found[d] = [{"start": int(point[w.starts[r[0]] - o]), "end": int(point[w.ends[r[-1]] - o])} for r in runs]
        spans.extend(found)
    return {"score": scores, "spans": spans}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, chars: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(text, y) of at most ``rows`` documents a class, chosen by a hash of the id."""
    y = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = [y.where(F.col("y") == c).orderBy(order, id_col).limit(2 * rows) for c in (0, 1)]  # some are too long
    texts = docs.select(id_col, F.col(text).alias("text")).where(F.char_length("text") <= chars)
    both = [p.hint("broadcast").join(texts, id_col).orderBy(order, id_col, "text").limit(rows) for p in picked]  # at most 2 * rows ids
    return both[0].unionByName(both[1]).select("text", "y")


def fit_field(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = FIT_ROWS, chars: int = FIT_CHARS, id_col: str = "doc_id") -> Field:
    got = labelled_sample(docs, labels, label, rows=rows, chars=chars, id_col=id_col).collect()
    got = sorted(got, key=lambda r: (r["y"], r["text"]))
    return fit([r["text"] for r in got], [r["y"] for r in got])


def tag_toxic(docs: DataFrame, field: Field, *, text: str = "text", span_threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and spans (code points of runs of toxic tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return with_columns(docs, RESULT, lambda texts: score_texts(texts, shared.value, span_threshold), text)


def held_out(n: int, remainder: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n == remainder, F.lit(False))


def op1_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    scored = tag_toxic(docs, fit_field(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")

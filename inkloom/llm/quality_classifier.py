"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every whole text are made in the tasks. Boosted trees over a bounded labelled sample give paths; each path is
a conjunction of thresholds; a lasso logistic fit weighs them; and what is left compiles to one Spark column expression, so
that scoring is plain column work over the statistics.

The fit uses at most ``FIT_ROWS`` labelled documents of each class, taken by a hash of the id; statistics and scores cover
all rows.

Defined cases: null and empty texts have statistics of 0 and a score as any other; without labelled rows of both classes
the score is the smoothed share of label 1; repeated rows score alike; columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules_fit import Rule, sparse_ensemble
from .store import table
from .toxicity import held_out
from .words import Words, with_columns, word_chunks

FIT_ROWS = 4000

STATISTICS = ["n_words", "word_length", "upper_share", "digit_share", "sign_share", "stop_share", "bang_share", "ascii_share", "short_words",
              "long_words", "distinct_words", "repeated_pairs", "top_word", "words_per_line", "distinct_lines", "words_per_stop"]
_PREFIX = "q_"
_SCHEMA = T.StructType([T.StructField(_PREFIX + s, T.DoubleType()) for s in STATISTICS])

_KIND = np.zeros((6, 256), dtype=bool)
_KIND[0, 0x41:0x5B] = True
_KIND[1, 0x30:0x3A] = True
_KIND[2, [ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]] = True
_KIND[3, [ord(c) for c in ".,;:?"]] = True
_KIND[4, ord("!")] = True
_KIND[5, :0x80] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, count of the most frequent one) of each owner."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
    size = np.diff(np.append(start, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[start], size)
    return np.bincount(o[start], minlength=n).astype(float), top


def statistics(w: Words) -> np.ndarray:
    """One row of STATISTICS for each text of the chunk."""
    n = len(w.first) - 1
    chars = np.maximum(1, np.diff(w.offsets))
    words = np.diff(w.first)
    safe = np.maximum(1, words)
    owner, length, hashes = w.text_of(), w.ends - w.starts, w.hashes()
    kinds = [_sums(_KIND[k][w.raw], w.offsets) for k in range(6)]
    upto = np.concatenate(([0], np.cumsum(length)))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _distinct(owner, hashes, n)
    breaks = np.flatnonzero(w.raw == 10)
    line_start = np.unique(np.concatenate((w.offsets[:-1][np.diff(w.offsets) > 0], breaks + 1)))
    line_start = line_start[line_start < len(w.raw)]
    line_end = np.append(line_start[1:], len(w.raw))
    line_owner = np.searchsorted(w.offsets, line_start, side="right") - 1
    in_line = np.searchsorted(w.starts, line_end) - np.searchsorted(w.starts, line_start)
    full = in_line > 0
    lines = np.bincount(line_owner[full], minlength=n)
    distinct_lines, _ = _distinct(line_owner[full], w.span_hash(line_start[full], line_end[full]), n)
    pick = lambda mask: np.bincount(owner[mask], minlength=n) / safe
    return np.stack([words, (upto[w.first[1:]] - upto[w.first[:-1]]) / safe, kinds[0] / chars, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars,
                     kinds[4] / chars, kinds[5] / chars, pick(length <= 3), pick(length >= 12), distinct / safe, pick(same), top / safe,
                     words / np.maximum(1, lines), distinct_lines / np.maximum(1, lines), words / (1 + kinds[3])], axis=1).astype(float)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column q_<name> for each statistic."""

    def run(texts: pa.Array) -> dict:
        parts = [statistics(w) for _, _, w in word_chunks(texts)]
        all_ = np.concatenate(parts)
        return {_PREFIX + s: pa.array(all_[:, i]) for i, s in enumerate(STATISTICS)}

    return with_columns(docs, _SCHEMA, run, text)


def compiled(rules: list[tuple[Rule, float]], intercept: float, columns: list[str]) -> Column:
    """The ensemble as a column: logistic of the intercept and the weights of the rules that hold."""
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = None
        for c in rule:
            one = F.col(columns[c.column]) > c.cut if c.above else F.col(columns[c.column]) <= c.cut
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with y, at most ``rows`` of each class, by a hash of the id."""
    y = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = [y.where(F.col("y") == c).orderBy(order, id_col).limit(rows) for c in (0, 1)]
    both = picked[0].unionByName(picked[1]).hint("broadcast")  # at most 2 * rows ids
    return docs.drop("y").join(both, id_col)


def fit_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, text: str = "text", id_col: str = "doc_id"):
    """(rules with weights, intercept) from a bounded labelled sample."""
    sample = text_statistics(labelled_rows(docs.select(id_col, text), labels, label, rows, id_col), text)
    got = sample.select(F.col(id_col).cast("string").alias("i"), "y", *[f.name for f in _SCHEMA.fields]).limit(8 * rows).collect()
    got = sorted(map(tuple, got))
    x = np.array([r[2:] for r in got], dtype=float).reshape(len(got), len(STATISTICS))
    x, one = np.unique(x, axis=0, return_index=True) if len(got) else (x, [])  # copies count once
    return sparse_ensemble(x, np.array([got[i][1] for i in one]))


def score_quality(docs: DataFrame, model, *, text: str = "text") -> DataFrame:
    """``docs`` with column score, the likelihood of label 1."""
    rules, intercept = model
    made = text_statistics(docs.drop("score"), text)
    kept = [c for c in docs.columns if c != "score"]
    return made.select(*kept, compiled(rules, intercept, [f.name for f in _SCHEMA.fields]).alias("score"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0))
    scored = score_quality(docs, fit_rules(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

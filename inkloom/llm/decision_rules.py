"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of every text are built-in functions over its words and lines. Sequential covering over a bounded labelled
sample grows and prunes conjunctions of thresholds (``quality_rules_fit.decision_list``), and the list becomes one ordered
CASE expression over the statistics: the first rule that holds rejects, a text that none holds for is kept.

The fit uses at most ``FIT_ROWS`` labelled documents of each class, taken by a hash of the id; statistics and verdicts
cover all rows.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; without labelled rows of both
classes the list is empty and only the base rules reject; repeated rows are judged alike; input columns named like a
result are replaced, all others pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_classifier import labelled_rows
from .quality_rules_fit import Rule, decision_list
from .store import table

FIT_ROWS = 4000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_bangs"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "bang_share"]
_SPACE = r"[\x20\x09-\x0D]"


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS (longs) and n_lines.

    A repeated window is found by sorting the hashes of a text's three-word windows with their places; texts whose window
    hashes all differ skip that. Nothing leaves its row, so nothing is shuffled.
    """
    names = [*COUNTS, "n_lines"]
    kept = [c for c in docs.columns if c.lower() not in names]
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(*kept, F.array_remove(F.split(t, f"{_SPACE}+"), "").alias("_w"),
                        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashes = F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END")
    counted = words.select(
        *kept, hashes.cast("array<bigint>").alias("_h"), F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    placed = F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                    F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = counted.withColumn("_p", placed)
    twice = F.expr("array_sort(transform(filter(_p, (x, j) -> x.h = get(_p, j - 1).h OR x.h = get(_p, j + 1).h), x -> x.i))")
    marked = sorted_.withColumn("_r", twice)
    covered = F.expr("aggregate(zip_with(_r, slice(_r, 2, greatest(size(_r), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)")
    return marked.select(*kept, *[c for c in COUNTS if c in counted.columns], "n_lines",
                         F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                         F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                         (F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
                         F.regexp_count(t, F.lit("!")).cast("long").alias("n_bangs")).select(*kept, *COUNTS, "n_lines")


def shares() -> list[Column]:
    """SHARES as columns over the counts; 0 where there is nothing to divide by."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [part(a, b).alias(n) for n, (a, b) in zip(SHARES, (
        ("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
        ("n_distinct_words", "n_words"), ("n_upper", "word_chars"), ("n_bangs", "word_chars")))]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit_list(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, text: str = "text", id_col: str = "doc_id") -> list[Rule]:
    """Rules for label 0, in order, over [n_words, *SHARES]."""
    sample = text_counts(labelled_rows(docs.select(id_col, text), labels, label, rows, id_col), text)
    got = sample.select(F.col(id_col).cast("string").alias("i"), "y", "n_words", *shares()).limit(8 * rows).collect()
    got = sorted(map(tuple, got))
    if not got:
        return []
    x, one = np.unique(np.array([r[2:] for r in got], dtype=float), axis=0, return_index=True)  # copies count once
    y = np.array([got[i][1] for i in one])
    return decision_list(x, 1 - y) if 0 < y.mean() < 1 else []


def verdict(rules: list[Rule], column=F.col) -> Column:
    """The list as one ordered conditional: False at the first rule that holds, else True."""
    names = ["n_words", *SHARES]
    value = dict(zip(names, [column("n_words"), *shares()]))
    out = None
    for rule in rules:
        holds = None
        for c in rule:
            one = value[names[c.column]] > F.lit(c.cut) if c.above else value[names[c.column]] <= F.lit(c.cut)
            holds = one if holds is None else holds & one
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed and kept."""
    kept = [c for c in docs.columns if c.lower() not in ("base_failed", "kept")]
    counted = text_counts(docs.select(*kept), text).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` that base rules and list keep, with their columns as they are."""
    rules = fit_list(docs, labels, text=text, id_col=id_col, **params)
    inner = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))
    # the row number keeps the filter above the projections: pushed below, it would repeat their lambdas inside each other
    judged = judge(inner, rules, text="_text").withColumn("_row", F.monotonically_increasing_id())
    return judged.where("kept AND _row >= 0").select("_doc.*")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit_list(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

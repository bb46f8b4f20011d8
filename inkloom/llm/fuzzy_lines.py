"""Line deduplication over the whole corpus, exact and fuzzy, in DataFrame functions only.

Lines are lower-cased and trimmed. A line's shingles are its runs of ``SHINGLE`` characters, one beginning at every
character. The ``SKETCH`` smallest of their hashes are its MinHash sketch; each ``BAND``
neighbours of the sorted sketch are a band. Lines that share a band are compared by exact Jaccard similarity of all their
shingles; links at 0.8 or more are merged by union-find over joins and mins (``links.group``), and each component keeps its
first line, by document id and place.

A pair at similarity 0.8 shares no three neighbours of the sketch once in a hundred times, one at 0.9 practically never.

Most of a line's shingles are hashed one by one as rows, in generated code, and only those that can be among the smallest are
collected; lines that keep too few are sketched whole. After the first round lines are compared only where their signatures
allow it: these tell how many shingles at least only one of two lines has, and a pair this rules out is not near.

Lines are cut out of the texts once and stored. Texts are not shuffled: bands and verdicts travel as hashes, and bit tables of
a fixed size, broadcast, tell which bands and which lines are worth sending at all (a full bit table would only let everything
through).

Defined cases: null and empty texts have no lines to remove and stay; lines under ``MIN_CHARS`` characters are never
removed; a text may lose all lines and then is empty; rows with equal id and text share one verdict; lines whose 64-bit
hashes collide stay; ids that are null come last in order; further columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import links
from .near_dup import row_keys
from .store import stored, table

SHINGLE = 9
MIN_CHARS = 20
SKETCH, BAND = 14, 3
THRESHOLD = 0.8
BLOCK = 512
SOME = 24  # shingles of a line that should pass the bound, so that seldom fewer than SKETCH do
SIGNS = 24  # words of 64 bits in a line's signature; with 28 a join of blocks took three times as long
BITS = 24  # of a bit table: 2 MB, whatever the data

_WIDE = 4  # bytes of a character in UTF-32, where a place is found without reading what stands before it


def _hashes(line: Column, size: int) -> Column:
    """Hashes of a line's shingles, place by place."""
    at = lambda b: F.sequence(F.lit(1), F.octet_length(b) - (_WIDE * size - 1), F.lit(_WIDE))
    of = lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(_WIDE * size))))
    # as the element of an array the bytes are not copied for each shingle
    return F.when(F.char_length(line) >= size, F.transform(F.array(F.encode(line, "UTF-32")), of)[0]).otherwise(F.array().cast("array<bigint>"))


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.array_distinct(_hashes(line, size))


def sketch(line: Column, size: int = SHINGLE) -> Column:
    """The ``SKETCH`` smallest distinct hashes of a line's shingles, sorted; all where there are fewer.

    Of long lines only the hashes below a bound that some ``4 * SKETCH`` should pass are sorted, and all if too few passed.
    """
    once = lambda x, f: F.transform(F.array(x), f)[0]
    least, all_ = F.lit(float(-1 << 63)), F.lit(float(1 << 64))
    bound = lambda h: (least + all_ * F.least(F.lit(1.0), F.lit(4.0 * SKETCH) / F.size(h))).cast("long")
    some = lambda h: F.when(F.size(h) > 4 * SKETCH, once(bound(h), lambda t: F.array_distinct(F.filter(h, lambda x: x < t))))
    pick = lambda h: once(some(h), lambda s: F.when(F.size(s) >= SKETCH, s).otherwise(F.array_distinct(h)))
    return F.slice(F.sort_array(once(_hashes(line, size), pick)), 1, SKETCH)


def bands(sketch_column: str) -> Column:
    """Hashes of neighbouring sketch values; a line with few shingles has one band of all, one with none has none."""
    n = f"least({SKETCH}, size({sketch_column}))"
    band = lambda i: f"xxhash64({', '.join(f'{sketch_column}[{i} + {k}]' for k in range(BAND))})"
    full = ", ".join(band(i) for i in range(SKETCH - BAND + 1))  # most lines; the other forms are not generated code
    return F.expr(f"CASE WHEN {n} = {SKETCH} THEN array({full}) WHEN {n} >= {BAND} THEN transform(sequence(0, {n} - {BAND}), i -> {band('i')}) "
                  f"WHEN {n} > 0 THEN array(xxhash64({sketch_column})) ELSE array() END")


def each_shingle(lines: DataFrame, *keep: str, size: int = SHINGLE) -> DataFrame:
    """(keep, _m, _h): a row for every place of ``line`` where a shingle begins, and one with null for the line itself; _m is their number."""
    wide = lines.select(*keep, F.encode("line", "UTF-32").alias("_u"))
    counted = wide.withColumn("_m", F.greatest(F.lit(0), F.octet_length("_u") / _WIDE - (size - 1)).cast("int"))
    placed = counted.select("*", F.explode(F.sequence(F.lit(1 - _WIDE), (F.col("_m") - 1) * _WIDE + 1, F.lit(_WIDE))).alias("_i"))
    return placed.select(*keep, "_m", F.when(F.col("_i") > 0, F.xxhash64(F.substring("_u", F.col("_i"), F.lit(_WIDE * size)))).alias("_h"))


def line_keys(lines: DataFrame) -> DataFrame:
    """(node, keys): the bands of every line's ``sketch``, the line named by ``h1``; without lines whose hashes collide."""
    bound = (F.lit(float(-1 << 63)) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(float(SOME)) / F.greatest(F.col("_m"), F.lit(1)))).cast("long")
    low = each_shingle(lines, "h1", "h2").where(F.col("_h").isNull() | (F.col("_m") <= SOME) | (F.col("_h") < bound))
    met = low.groupBy(F.col("h1").alias("node")).agg(F.collect_set("_h").alias("_s"), F.max("_m").alias("_m"), F.min("h2").alias("_a"), F.max("h2").alias("_b")).where("_a = _b")
    least = met.select("node", F.slice(F.sort_array("_s"), 1, SKETCH).alias("_s"), ((F.col("_m") > SOME) & (F.size("_s") < SKETCH)).alias("_few"))
    made = stored(least.select("node", F.when(~F.col("_few"), bands("_s")).alias("keys")), "keys")
    few = made.where("keys IS NULL").select("node")
    whole = with_bit(lines.select(F.col("h1").alias("node"), "line"), "node", bit_table(few, "node")).join(few, "node").dropDuplicates(["node"])
    again = stored(whole.select("node", sketch(F.col("line")).alias("_s")).select("node", bands("_s").alias("keys")), "keys")
    return made.where("keys IS NOT NULL").unionByName(again)


def signatures(lines: DataFrame) -> DataFrame:
    """(node, m, w0, w1, ..): the number of places of ``line`` where a shingle begins, and a bit for each shingle hash.

    A bit only one line has is a shingle only that line has.
    """
    word = F.expr(f"cast(shiftrightunsigned(_h, 6) % {SIGNS} AS int)")
    bits = each_shingle(lines, "node").where("_h IS NOT NULL").select("node", word.alias("_w"), F.expr("shiftleft(1L, cast(_h & 63 AS int))").alias("_b"), "_m")
    none = lines.select("node", F.explode(F.sequence(F.lit(0), F.lit(SIGNS - 1))).alias("_w"), F.lit(0).cast("long").alias("_b"), F.lit(0).alias("_m"))
    words = bits.unionByName(none).groupBy("node", "_w").agg(F.bit_or("_b").alias("_b"), F.max("_m").alias("_m"))
    one = words.groupBy("node").agg(F.max("_m").alias("m"), F.sort_array(F.collect_list(F.struct("_w", "_b")))["_b"].alias("_all"))
    return one.select("node", "m", *[F.col("_all")[k].alias(f"w{k}") for k in range(SIGNS)])


def may_be_near(threshold: float) -> str:
    """Condition that every pair at ``threshold`` meets, on places and signatures (am, aw0, ..) and (bm, bw0, ..).

    If at least d shingles are in one line only, at most (am + bm - d) / 2, and at most am and bm, are in both.
    """
    d = " + ".join(f"bit_count(aw{k} ^ bw{k})" for k in range(SIGNS))
    each = threshold / (1 - threshold)  # shingles in both, for one in one line only
    return f"{d} <= least(am / {each}D, bm / {each}D, (am + bm) / {2 * each + 1}D) + 1e-6D"


def lines_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, k1, k2, line_no, line, h1, h2) of the lines long enough to be looked at."""
    k1, k2 = row_keys(text, id_col)
    cut = docs.select(F.col(id_col).alias("doc_id"), k1, k2, F.posexplode(F.split(text, "\n")).alias("line_no", "_raw"))
    normal = cut.withColumn("line", F.lower(F.trim("_raw"))).drop("_raw").where(F.char_length("line") >= MIN_CHARS)
    return normal.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(5), "line"))


def bit_table(df: DataFrame, column: str) -> DataFrame:
    """(_bucket, _words): at most 2^BITS / 32768 rows of 512 words with a bit for each value of ``column``."""
    at = df.select(F.pmod(F.col(column), F.lit(1 << BITS)).alias("_at"))
    made = at.groupBy(F.floor(F.col("_at") / 32768).alias("_bucket")).agg(F.expr("bitmap_construct_agg(_at % 32768)").alias("_bits"))
    word = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) AS bigint))")
    return stored(made.select("_bucket", word.alias("_words")), "bits")


def with_bit(df: DataFrame, column: str, table_: DataFrame) -> DataFrame:
    """Rows of ``df`` whose value of ``column`` has its bit set: all in the table and a few more."""
    held = df.withColumn("_bucket", F.shiftright(F.pmod(F.col(column), F.lit(1 << BITS)), 15)).join(F.broadcast(table_), "_bucket")  # 2 MB at most by construction
    word = f"_words[cast(pmod({column}, 32768) div 64 AS int)]"
    return held.where(F.expr(f"shiftrightunsigned({word}, cast(pmod({column}, 64) ^ 56 AS int)) & 1 = 1")).drop("_bucket", "_words")  # ^ 56: the first byte is the highest


def line_verdicts(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k1, k2, line_no, kept_doc_id, kept_line_no): one row for each line to remove, with the line that stands for it."""
    lines = stored(lines_of(docs, text, id_col), "lines", "zstd")
    keyed = line_keys(lines).select("node", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    buckets = links.shared_buckets(with_bit(keyed, "key", bit_table(shared, "key")), shared)
    wanted = stored(buckets.select("node").distinct(), "wanted")
    texts = with_bit(lines.select(F.col("h1").alias("node"), "line"), "node", bit_table(wanted, "node")).join(wanted.hint("merge"), "node")
    texts = stored(texts.dropDuplicates(["node"]), "texts")  # shingles take eight bytes a character, so they are made anew where lines meet
    signs = ["m", *[f"w{k}" for k in range(SIGNS)]]
    at = lambda df, x, *cols: df.select(F.col("node").alias(x), *[F.col(c).alias(x + c) for c in cols])

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(at(texts, "b", "line"), "b").join(at(texts, "a", "line"), "a") \
            .withColumns({"sa": shingles(F.col("aline")), "sb": shingles(F.col("bline"))}).withColumn("_n", F.size(F.array_intersect("sa", "sb")))
        return both.select("a", "b", (F.col("_n") / (F.size("sa") + F.size("sb") - F.col("_n"))).alias("similarity"))

    def signed(nodes: DataFrame) -> DataFrame:
        return stored(signatures(texts.join(nodes.distinct(), "node")), "signatures")

    def settle(pairs: DataFrame) -> DataFrame:
        met = stored(pairs, "pairs")
        known = signed(met.select(F.explode(F.array("a", "b")).alias("node")))
        near = met.join(at(known, "b", *signs), "b").join(at(known, "a", *signs), "a").where(may_be_near(threshold))
        return verify(stored(near.select("a", "b"), "pairs"))

    def rest(live: DataFrame) -> DataFrame:
        cell = links.cells(live, BLOCK).join(signed(live.select("node")), "node")
        of = lambda x: cell.select("key", "cell", F.col("node").alias(x), *[F.col(c).alias(x + c) for c in ("root", *signs)])
        near = of("a").join(of("b"), ["key", "cell"]).where("a < b AND aroot <> broot").where(may_be_near(threshold))
        met = verify(stored(near.select("a", "b"), "pairs").distinct())
        return met.where(F.greatest("similarity", F.lit(threshold)) == F.col("similarity")).select("a", "b")

    roots = stored(links.group(buckets, verify, threshold, rest=rest, settle=settle), "roots")
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # roots are members too
    counts = lines.groupBy(F.col("h1").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("h2").alias("_a"), F.max("h2").alias("_b")).where("_a = _b")
    several = stored(counts.join(every, "node", "left").where("n > 1 OR root IS NOT NULL").select(F.col("node").alias("h1"), F.coalesce("root", "node").alias("root")), "several")
    narrow = with_bit(lines.select("doc_id", "k1", "k2", "line_no", "h1"), "h1", bit_table(several, "h1"))
    members = stored(narrow.join(several, "h1").drop("h1"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "k1", "k2", "line_no")
    heads = stored(members.groupBy("root").agg(F.min(place).alias("head")), "heads")
    same = (F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2")) & (F.col("line_no") == F.col("head.line_no"))
    return members.join(heads, "root").where(~same).select(
        "doc_id", "k1", "k2", "line_no", F.col("head.doc_id").alias("kept_doc_id"), F.col("head.line_no").alias("kept_line_no"))


def removed_lines(verdicts: DataFrame) -> DataFrame:
    """(k1, k2, removed): the places of a document's lines to remove; as many as it has lines."""
    return verdicts.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines to remove; n_chars, where there is one, follows the new text."""
    gone = stored(removed_lines(line_verdicts(docs, text=text, id_col=id_col, threshold=threshold)), "removed")
    k1, k2 = row_keys(text, id_col)
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), k1, k2).join(gone, ["k1", "k2"], "left")
    left = F.expr("array_join(filter(split(_text, '\n'), (x, i) -> NOT array_contains(removed, i)), '\n')")
    new = held.withColumn("_new", F.when(F.col("removed").isNull(), F.col("_text")).otherwise(left))
    cols = []
    for c in docs.columns:
        old = F.col("_doc").getField(c)
        if c == text:
            old = F.col("_new")
        elif c == "n_chars":
            old = F.when(F.col("removed").isNull(), old).otherwise(F.char_length("_new").cast(docs.schema[c].dataType))
        cols.append(old.alias(c))
    return new.select(*cols)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = stored(removed_lines(line_verdicts(docs)), "removed")
    k1, k2 = row_keys("text", "doc_id")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    rows = docs.select("doc_id", k1, k2, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    return rows.join(gone, ["k1", "k2"], "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                                                        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))

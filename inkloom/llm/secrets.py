"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens, in DataFrame functions only.

Base spans come from three patterns. The method then looks at tokens of 20 characters and more that no base span touches.
Runs end at "=" other than padding, so values are apart from their names; in a run with "+", "/", "_" or "-" the parts over
smaller alphabets are tested too, and of declared tokens those inside another are left out.
A token's encoding is the smallest alphabet that holds it; tokens of one letter case only, or of digits only, count as
words and numbers and are not tested. Under the hypothesis that a token is random over its alphabet, three tests give
p-values: chi-squared uniformity of its characters, runs above and below the middle of the alphabet, and serial
correlation of neighbours. Fisher's rule joins them.

Random tokens have joint p-values spread evenly; written ones crowd near zero, the more so the longer they are. Therefore
thresholds are set for each encoding and length class: the density above one half tells how many tokens are random, and
the threshold is the lowest one at which the share of others among the declared tokens is at most ``RATE``. Only the counts
of at most |encodings| x |length classes| x ``BINS`` cells reach the driver.

Defined cases: null and empty texts have no spans; equal texts get equal spans; spans are in code points, end exclusive;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored, table

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_ASSIGNED = 12

_PAD = "(?:=+(?![A-Za-z0-9+/_=-]))?"
TOKEN = "[A-Za-z0-9+/_-]{20,}" + _PAD
PARTS = [f"[A-Za-z0-9{more}]{{20,}}{_PAD}" for more in ("+/", "_-", "")]  # within a token
KINDS = ["assign", "access", "hex", "random"]
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, what the token (without padding) must match, alphabet in order; the first that holds counts
ENCODINGS = [
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("alnum_lower", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("alnum_upper", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("alnum", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
]
RATE = 0.1
BINS = 100
_BLOCK = 128  # of the two-step running sums


def placed(df: DataFrame, name: str, pattern: str, only_if: Column | None = None) -> DataFrame:
    """Adds ``name``: array of (start, end, found) of the leftmost non-overlapping matches in column t."""
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    if only_if is not None:
        found = F.when(only_if, found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_m", found)
    gaps = F.when(F.size("_m") > 0, F.transform(F.split("t", pattern, -1), lambda x: F.char_length(x).cast("long"))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_g", gaps)
    df = df.withColumn("_u", F.expr("zip_with(slice(_g, 1, size(_m)), _m, (g, x) -> g + char_length(x))"))
    total = "aggregate({0}, 0L, (s, x) -> s + x)"
    df = df.withColumn("_b", F.expr(f"transform(sequence(0, greatest(size(_u) - 1, 0) div {_BLOCK}), b -> {total.format(f'slice(_u, b * {_BLOCK} + 1, {_BLOCK})')})"))
    df = df.withColumn("_p", F.expr(f"transform(_b, (x, b) -> {total.format('slice(_b, 1, b)')})"))
    start = f"_p[i div {_BLOCK}] + {total.format(f'slice(_u, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, i % {_BLOCK})')} + _g[i]"
    return df.withColumn(name, F.expr(f"transform(_m, (x, i) -> struct({start} AS start, {start} + char_length(x) AS end, x AS found))")) \
        .drop("_m", "_g", "_u", "_b", "_p")


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z (rational approximation, error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds encoding, length and p to tokens (column found); tokens outside all encodings go."""
    body = F.regexp_replace("found", "=+$", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]") | (body.rlike("[a-z]") & body.rlike("[a-z][A-Z]"))
    df = tokens.withColumn("_t", body).where(mixed & (F.char_length(body) >= 20))
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, pattern, symbols in reversed(ENCODINGS):
        name, alphabet = (F.when(F.col("_t").rlike(pattern), F.lit(v)).otherwise(old) for v, old in ((n, name), (symbols, alphabet)))
    df = df.withColumns({"encoding": name, "_a": alphabet}).where(F.col("encoding").isNotNull())
    df = df.withColumn("_x", F.expr("transform(filter(split(_t, ''), c -> c <> ''), c -> instr(_a, c) - 1)")) \
        .withColumns({"n": F.size("_x").cast("double"), "k": F.char_length("_a").cast("double")})
    # uniformity: sum of squared counts over the alphabet's symbols, as a chi-squared with k - 1 degrees, cube-root normal
    squares = F.expr("aggregate(transform(array_distinct(_x), v -> size(filter(_x, x -> x = v))), 0D, (s, c) -> s + c * c)")
    chi, free = squares * F.col("k") / F.col("n") - F.col("n"), F.col("k") - 1
    z_chi = (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # runs above and below the middle
    df = df.withColumns({"_z_chi": z_chi, "_above": F.expr("aggregate(_x, 0D, (s, x) -> s + if(x >= k / 2, 1, 0))"),
                         "_runs": F.expr("1D + aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (a, b) -> if((a >= k / 2) = (b >= k / 2), 0, 1)), 0D, (s, x) -> s + x)"),
                         "_mean": F.expr("aggregate(_x, 0D, (s, x) -> s + x) / n")})
    hoped = 2 * F.col("_above") * (F.col("n") - F.col("_above")) / F.col("n") + 1
    z_runs = F.when(hoped > 2, (F.col("_runs") - hoped) / F.sqrt((hoped - 1) * (hoped - 2) / (F.col("n") - 1))).otherwise(F.lit(9.0))
    # correlation of neighbours
    over = F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (a, b) -> (a - _mean) * (b - _mean)), 0D, (s, x) -> s + x)")
    under = F.expr("aggregate(_x, 0D, (s, x) -> s + (x - _mean) * (x - _mean))")
    z_serial = F.when(under > 0, (over / under + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(9.0))
    df = df.withColumns({"_p1": upper_tail(F.col("_z_chi")), "_zr": z_runs, "_zs": z_serial}) \
        .withColumns({"_p2": 2 * upper_tail(F.abs("_zr")), "_p3": 2 * upper_tail(F.abs("_zs"))})
    half = -F.log(F.greatest("_p1", F.lit(1e-300))) - F.log(F.greatest("_p2", F.lit(1e-300))) - F.log(F.greatest("_p3", F.lit(1e-300)))
    joint = df.withColumn("_h", half).withColumn("p", F.exp(-F.col("_h")) * (1 + F.col("_h") + F.col("_h") * F.col("_h") / 2))
    length = F.least(F.floor(F.log2("n")), F.lit(9)).cast("int")
    return joint.select(*tokens.columns, "encoding", length.alias("length"), F.least("p", F.lit(1.0)).alias("p"))


def candidates(held: DataFrame) -> DataFrame:
    """(row, start, end, found) of the tokens, whole and in parts, that no base span touches."""
    df = held.select("row", "base", F.explode("token").alias("_f")).withColumn("t", F.col("_f.found"))
    names = [f"_c{i}" for i in range(len(PARTS))]
    for name, pattern in zip(names, PARTS):
        df = placed(df, name, pattern, F.col("t").rlike("[+/_-]"))
    inner = [F.transform(name, lambda m: F.struct((m["start"] + F.col("_f.start")).alias("start"), (m["end"] + F.col("_f.start")).alias("end"), m["found"].alias("found"))) for name in names]
    every = df.select("row", "base", F.explode(F.array_distinct(F.concat(F.array("_f"), *inner))).alias("f"))
    return every.where("NOT exists(base, b -> b.start < f.end AND f.start < b.end)").select("row", "f.start", "f.end", "f.found")


def thresholds(tested: DataFrame, rate: float = RATE) -> dict[tuple[str, int], float]:
    """Lowest joint p-value that declares a token random, for each encoding and length class; absent: none does."""
    cell = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    counts: dict[tuple[str, int], list[int]] = {}
    for r in tested.groupBy("encoding", "length", cell).count().collect():  # a bounded number of cells
        counts.setdefault((r["encoding"], r["length"]), [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for stratum, own in counts.items():
        random_ = 2 * sum(own[BINS // 2:])
        for b in range(1, BINS):
            declared = sum(own[b:])
            if declared and 1 - random_ * (1 - b / BINS) / declared <= rate:
                out[stratum] = b / BINS
                break
    return out


def find_secrets(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind_no, end, kind), by start and then kind; spans hold the base and random tokens."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = placed(df, "assign", ASSIGN)
    df = placed(df, "access", ACCESS, F.instr("t", "AKIA") > 0)
    df = placed(df, "hex", HEX)
    df = placed(df, "token", TOKEN)
    df = df.withColumn("assign", F.filter("assign", lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= MIN_ASSIGNED))
    kinds = [F.expr(f"transform({kind}, m -> struct(m.start AS start, {i} AS kind_no, m.end AS end, '{kind}' AS kind))") for i, kind in enumerate(KINDS[:3])]
    df = df.withColumn("base", F.array_sort(F.concat(*kinds)))
    held = stored(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "token"), "spans")
    tested = stored(randomness(candidates(held)), "tested")
    limit = F.lit(None).cast("double")
    for (encoding, length), p in sorted(thresholds(tested, rate).items()):
        limit = F.when((F.col("encoding") == encoding) & (F.col("length") == length), F.lit(p)).otherwise(limit)
    declared = tested.where(F.col("p") >= limit).groupBy("row").agg(F.collect_list(
        F.struct("start", F.lit(3).alias("kind_no"), "end", F.lit("random").alias("kind"))).alias("more")) \
        .withColumn("more", F.expr("filter(more, m -> NOT exists(more, o -> o.start <= m.start AND m.end <= o.end AND o.end - o.start > m.end - m.start))"))
    joined = held.drop("token").join(declared, "row", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(held.schema["base"].dataType)))).alias("spans"))


def joined_spans(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined_spans("base"), 256).alias("base_sha256"),
                        joined_spans("spans").alias("spans"))

"""Secret scans, in DataFrame functions only.

Base patterns find assignments, access keys and hex strings. Besides, every long token of a base
encoding's characters is put to a battery of randomness tests under the smallest alphabet that holds
it: chi-squared uniformity, runs about the alphabet's middle, and serial correlation. A token is
reported if the battery doesn't reject that its symbols are uniform and independent, and if natural
text of its length (by its uniformity and its runs of symbols of one class) is rejected at a
false-discovery rate that is controlled for each class of lengths over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, table

either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

#: Kind, pattern, and the length that the whole match or its second group has at least.
ASSIGN = "(" + "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
LEAST_VALUE = 12
#: Noncharacters of Unicode; the first that a text lacks stands for its hidden characters meanwhile.
MARKS = "".join(map(chr, range(0xFDD0, 0xFDF0)))
#: Tokens that the battery looks at.
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES_OF_SYMBOLS = (LOWER, UPPER, DIGITS, "+/-_")
#: Alphabets from small to large; a token's encoding is the first that has all its symbols.
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Relative frequencies of the letters a to z in English text, in percent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of upper-case letters, digits and other symbols, against lower-case letters, in natural tokens.
NATURAL = {"upper": 0.1, "digit": 0.05, "other": 0.02}
#: Length classes for the false-discovery control: lower bounds.
CLASSES = (20, 32, 48, 64, 128)
#: p-values are counted in bins of this width of -log10 p, up to BINS.
BIN, BINS = 0.1, 200


@dataclass(frozen=True)
class Control:
    """Rejection bins of each length class (BINS + 1: none) at the false-discovery rate, and the battery's level."""

    bins: tuple[int, ...]
    level: float


def natural_moments(alphabet: str) -> tuple[float, float, float]:
    """Of natural tokens within the alphabet: sums of squares and cubes of the symbol frequencies, and the probability that two symbols are of one class (case, digit, other)."""
    share = {c: f for c, f in zip(LOWER, LETTERS, strict=True)}
    share |= {c: f * NATURAL["upper"] for c, f in zip(UPPER, LETTERS, strict=True)} | {c: 10 * NATURAL["digit"] for c in DIGITS} | {c: 50 * NATURAL["other"] for c in "+/-_"}
    total = sum(share[c] for c in alphabet)
    same = sum((sum(share[c] for c in alphabet if c in kind) / total) ** 2 for kind in CLASSES_OF_SYMBOLS)
    return sum((share[c] / total) ** 2 for c in alphabet), sum((share[c] / total) ** 3 for c in alphabet), same


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by a rational approximation of the complementary error function (relative error below 1.2e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + x / 2)
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        series = series * t + c
    half = t * F.exp(-x * x - 1.26551223 + t * series) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def running(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array, block by block so that long arrays aren't copied for each element."""

    def scan(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, first, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / block).cast("int") - 1)), lambda b: F.slice(lengths, b * block + 1, block))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v))
    return F.flatten(F.zip_with(blocks, scan(sums, F.lit(0).cast("bigint")), scan))


SPANS = "array<struct<start: bigint, end: bigint, value: string>>"


def add_matches(df: DataFrame, name: str, pattern: str, *, of: str = "text", where: Column | None = None) -> DataFrame:
    """Add column `name`: array of (start, end, value) of the leftmost non-overlapping matches in column `of` (of rows `where`), and `name`_gaps: what stands before, between and after them."""
    found, gaps, some = f"{name}_found", f"{name}_gaps", F.size(f"{name}_found") > 0
    every = F.regexp_extract_all(of, F.lit(pattern), F.lit(0))
    df = df.withColumn(found, every if where is None else F.when(where, every).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(some, F.split(of, pattern, -1)))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    df = df.withColumn(f"{name}_at", F.when(some, running(lengths)))
    rows = F.arrays_zip(F.col(f"{name}_at").alias("at"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.col(found).alias("value"))
    span = lambda x: F.struct((x["at"] + F.length(x["gap"])).alias("start"), (x["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"))
    return df.withColumn(name, F.when(some, F.transform(rows, span)).otherwise(F.array().cast(SPANS))).drop(found, f"{name}_at")


def masked(gaps: str, spans: str, hide) -> Column:
    """The text of `gaps` and `spans`, with the row's mark in place of every character of the spans that hide(span) holds for."""
    parts = F.zip_with(F.slice(gaps, 1, F.size(spans)), spans, lambda g, x: F.concat(g, F.when(hide(x), F.repeat("mark", F.length(x["value"]))).otherwise(x["value"])))
    return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))


def add_base(df: DataFrame) -> DataFrame:
    """Add columns assign, access and hex with the base spans of column text; mark: a noncharacter that the text lacks; and rest: the text with marks in place of the base spans."""
    mark = F.lit(MARKS[0])  # a text with all of them: its own noncharacters then count as marks
    for c in MARKS[::-1]:
        mark = F.when(F.instr("text", c) == 0, c).otherwise(mark)
    df = df.withColumn("mark", mark)
    for kind, pattern in PATTERNS.items():
        df = add_matches(df, kind, pattern)
    right = lambda x: F.length(F.regexp_extract(x["value"], f"^{ASSIGN}$", 2)) >= LEAST_VALUE
    df = df.withColumn("rest", F.when(F.size("assign") > 0, masked("assign_gaps", "assign", right)).otherwise(F.col("text")))
    df = df.withColumn("assign", F.filter("assign", right))
    # keys and hex strings within assignments are gone already
    df = add_matches(df, "both", f"{PATTERNS['access']}|{PATTERNS['hex']}", of="rest", where=F.size("access") + F.size("hex") > 0)
    df = df.withColumn("rest", F.when(F.size("both") > 0, masked("both_gaps", "both", lambda x: F.lit(True))).otherwise(F.col("rest")))
    return df.drop("assign_gaps", "access_gaps", "hex_gaps", "both", "both_gaps")


def add_battery(df: DataFrame) -> DataFrame:
    """Add column tokens: long tokens in what base spans leave, with n, uniform (the battery's p-value) and bin (of -log10 p under natural text)."""
    df = add_matches(df, "tokens", TOKEN, of="rest").drop("tokens_gaps")

    def pick(of: Column, what) -> Column:
        out = None
        for k in range(len(ENCODINGS)):
            out = F.when(of == k, what(k)) if out is None else out.when(of == k, what(k))
        return out

    body = lambda t: F.regexp_replace(t["value"], "=+$", "")
    keep = lambda t: [t["start"].alias("start"), t["end"].alias("end")]

    def encoding(t: Column) -> Column:
        out = None
        for k, (_, alphabet) in enumerate(ENCODINGS):
            fits = F.translate(body(t), alphabet, "") == ""
            out = F.when(fits, k) if out is None else out.when(fits, k)
        classes = F.translate(body(t), "".join(CLASSES_OF_SYMBOLS), "a" * 26 + "A" * 26 + "0" * 10 + "." * 4)
        return F.struct(*keep(t), body(t).alias("body"), out.alias("code"), F.regexp_count(classes, F.lit("a+|A+|0+|[.]+")).cast("double").alias("turns"))

    def symbols(t: Column) -> Column:
        alphabet = pick(t["code"], lambda k: F.lit(ENCODINGS[k][1]))
        v = F.transform(F.filter(F.split(t["body"], ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        return F.struct(*keep(t), t["code"].alias("code"), t["turns"].alias("turns"), pick(t["code"], lambda k: F.array(*[F.lit(float(x)) for x in (len(ENCODINGS[k][1]), *natural_moments(ENCODINGS[k][1]))])).alias("of"), v.alias("v"))

    def moments(t: Column) -> Column:
        v, n, a = t["v"], F.size(t["v"]).cast("double"), t["of"][0]
        sums = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        counts = F.aggregate(F.sequence(F.lit(0), a.cast("int") - 1), F.lit(0.0), lambda s, k: s + F.pow(F.size(F.filter(v, lambda x: x == k)).cast("double"), 2))
        above = F.size(F.filter(v, lambda x: 2 * x >= a)).cast("double")
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: F.struct((x * y).alias("xy"), ((2 * x >= a) != (2 * y >= a)).cast("int").alias("turn")))
        joint = F.aggregate(pairs, F.struct(F.lit(0.0).alias("xy"), F.lit(1.0).alias("runs")), lambda s, p: F.struct((s["xy"] + p["xy"]).alias("xy"), (s["runs"] + p["turn"]).alias("runs")))
        return F.struct(*keep(t), t["of"].alias("of"), t["turns"].alias("turns"), n.alias("n"), sums.alias("sum"), squares.alias("squares"), counts.alias("counts"), above.alias("above"), joint.alias("joint"), v[0].alias("v0"), F.element_at(v, -1).alias("v1"))

    def ratios(t: Column) -> Column:
        n, a, free = t["n"], t["of"][0], t["of"][0] - 1
        return F.struct(*keep(t), t["of"].alias("of"), t["turns"].alias("turns"), n.alias("n"), a.alias("a"), free.alias("free"), (a * t["counts"] / n - n).alias("chi"), (2 * t["above"] * (n - t["above"])).alias("both"), t["joint"]["runs"].alias("runs"), (t["squares"] - t["sum"] * t["sum"] / n).alias("around"), (t["joint"]["xy"] - t["sum"] / n * (2 * t["sum"] - t["v0"] - t["v1"]) + (n - 1) * F.pow(t["sum"] / n, 2)).alias("lagged"))

    def scores(t: Column) -> Column:
        n, a, free, both, two, three, same = t["n"], t["a"], t["free"], t["both"], t["of"][1], t["of"][2], t["of"][3]
        chi = (F.pow(F.greatest(t["chi"], F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 1e-9, F.abs(t["runs"] - both / n - 1) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(99.0)
        serial = F.when(t["around"] > 1e-9, F.abs(t["lagged"] / F.greatest(t["around"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(99.0)
        even = (a * n * two + a * (1 - two) - n - t["chi"]) / (a * F.sqrt(4 * n * (three - two * two) + 2 * two * two))
        mixed = F.when(same < 0.9999, (t["turns"] - 1 - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same)))
        return F.struct(*keep(t), n.alias("n"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), F.coalesce((even + mixed) / math.sqrt(2), even).alias("natural"))

    def tests(t: Column) -> Column:
        worst = F.least(upper_tail(t["chi"]), 2 * upper_tail(t["runs"]), 2 * upper_tail(t["serial"]))
        surprise = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(upper_tail(t["natural"]), F.lit(1e-300))) / BIN).cast("int"))
        return F.struct(*keep(t), t["n"].cast("int").alias("n"), F.least(F.lit(1.0), 3 * worst).alias("uniform"), surprise.alias("bin"))

    for step in (encoding, symbols, moments, ratios, scores, tests):
        df = df.withColumn("tokens", F.transform("tokens", step))
    return df


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(CLASSES[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def control(docs: DataFrame, *, text_col: str = "text", rate: float = 0.05, level: float = 0.001) -> Control:
    """Step-up false-discovery control over all tokens of docs, apart for each class of lengths."""
    return _control(add_battery(add_base(_texts(docs, text_col))), rate, level)


def _control(df: DataFrame, rate: float = 0.05, level: float = 0.001) -> Control:
    """Only counts for each class and bin come to the driver: len(CLASSES) * (BINS + 1) rows at most."""
    tokens = df.select(F.explode("tokens").alias("t"))
    counted = tokens.groupBy(length_class(F.col("t.n")).alias("class"), F.col("t.bin").alias("bin")).count().collect()
    bins = []
    for k in range(len(CLASSES)):
        own, above, least = {r.bin: r["count"] for r in counted if r["class"] == k}, 0, BINS + 1
        total = sum(own.values())
        for b in range(BINS, -1, -1):
            above += own.get(b, 0)
            if above and 10 ** (-b * BIN) <= rate * above / total:
                least = b
        bins.append(least)
    return Control(tuple(bins), level)


def _texts(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    return docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(more)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _random(t: Column, found: Control) -> Column:
    bound = F.element_at(F.array(*[F.lit(b) for b in found.bins]), length_class(t["n"]) + 1)
    return (t["bin"] >= bound) & (t["uniform"] >= found.level)


def _spans(df: DataFrame, found: Control) -> DataFrame:
    """Add column spans: all (start, end, kind) by start, then kind in the order of KINDS."""
    df = df.withColumn("random", F.filter("tokens", lambda t: _random(t, found)))

    def part(k: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return df.withColumn("spans", F.array_sort(F.concat(*[part(k, kind) for k, kind in enumerate(KINDS)])))


def scan(docs: DataFrame, found: Control | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, spans) for each row of docs.

    assign, access and hex are arrays of (start, end, value), spans one of (start, kind, end) with kind an
    index into KINDS; offsets are code points, ends exclusive. Null texts count as empty and have no
    spans; equal rows get equal results; null ids are kept; an empty table gives no rows; other columns
    are not read. `found` holds thresholds from control(); by default those of docs themselves, for which
    the spans and tested tokens (not the texts) are written once and read twice.
    """
    df = add_battery(add_base(_texts(docs, text_col, id_col))).select("own_0", "assign", "access", "hex", "tokens")
    if found is None:
        df = Scratch(docs.sparkSession).save(df)
        found = _control(df)
    return _spans(df, found).select(F.col("own_0").alias(id_col), "assign", "access", "hex", "spans")


def redact(docs: DataFrame, found: Control | None = None, *, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The rows of docs with every secret in the text replaced by `mark`, overlapping or touching ones by one.

    Null texts stay null; an empty table gives no rows; all columns are carried along.
    """
    columns = docs.columns
    df = add_battery(add_base(_texts(docs, text_col, *columns)))
    own, base = [f"own_{k}" for k in range(len(columns))], F.size("assign") + F.size("access") + F.size("hex") > 0
    df = df.select(*own, "mark", base.alias("base"), "tokens", F.when(base | (F.size("tokens") > 0), F.col("rest")).alias("rest"))
    if found is None:
        df = Scratch(docs.sparkSession).save(df)
        found = _control(df)
    hit = F.exists("tokens", lambda t: _random(t, found))
    df = add_matches(df.withColumn("hit", hit), "again", TOKEN, of="rest", where=F.col("hit"))
    # the matches are those that were tested, in the same order
    both = F.arrays_zip(F.col("again").alias("a"), F.col("tokens").alias("t"))
    df = df.withColumn("again", F.transform(both, lambda x: F.struct(x["a"]["value"].alias("value"), x["t"]["n"].alias("n"), x["t"]["bin"].alias("bin"), x["t"]["uniform"].alias("uniform"))))
    df = df.withColumn("rest", F.when(F.col("hit"), masked("again_gaps", "again", lambda x: _random(x, found))).otherwise(F.col("rest")))
    clean = F.regexp_replace("rest", F.concat("mark", F.lit("+")), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))
    text = F.when(F.col("base") | F.col("hit"), clean).otherwise(F.col(own[columns.index(text_col)]))
    return df.select(*[(text if c == text_col else F.col(own[k])).alias(c) for k, c in enumerate(columns)])


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(kind).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Secrets in texts: three fixed patterns, and a battery of randomness tests for the rest.

Every long run of characters that could be a key is read in the encoding it seems to have
(decimal, hexadecimal, base 32 or base 64). A chi-squared test of its symbols' uniformity, a
runs test about the middle of the alphabet and a serial correlation test give one p-value of
"random", by Fisher's method. Structured strings gather near 0, random ones are spread
evenly, so for each class of lengths the share of structured ones above a threshold can be
estimated from the whole corpus; the threshold is the least one that keeps it small.

Everything is a Spark expression or aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import col, cut

# The patterns of the base kinds, and the least length of a match or its value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# A maximal run or an access key that is long enough; shorter matches would be dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BITS = 80  # length times bits a symbol that a candidate needs: below, no test has power
CLASSES = [32, 48, 64]  # lengths at which a new class of lengths begins
BINS = 1000
FALSE_SHARE = 0.05  # of the strings called random, at most so many structured ones are expected
LEAST_P = 0.001  # no string below this is called random, whatever its class
STEP = 256

SPAN = "struct<kind: int, start: bigint, end: bigint, text: string, value: string>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each element of an array of bigint, in near linear time."""

    def sums(values: Column, zero: Column) -> Column:
        start = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, start, step)["out"]

    size = F.size(lengths)
    blocks = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / STEP).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    part = lambda b: F.slice(lengths, b * STEP + 1, F.lit(STEP))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda s, x: s + x))
    return let(sums(totals, F.lit(0).cast("bigint")), lambda begins: F.flatten(F.transform(begins, lambda at, b: sums(part(b), at))))


def matches(text: Column, pattern: str, kind: str, may: Column, value_group: int = 0) -> Column:
    """The non-overlapping matches of a pattern, leftmost first, as spans in code points.
    `may` is a cheap test that a text with a match must pass."""
    number = F.lit(KINDS.index(kind))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    # Between the matches lie the pieces of a split: the lengths of both give the places.
    gaps = F.transform(F.split(text, pattern), lambda x: F.char_length(x).cast("bigint"))

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.char_length(m))
        pairs = F.arrays_zip(found.alias("m"), (values if value_group else found).alias("v"))
        return let(steps, lambda own: let(pairs, lambda x: F.zip_with(F.zip_with(running_sums(own), own, lambda before, n: before + n), x, span)))

    def span(end: Column, x: Column) -> Column:
        m, v = x["m"], x["v"]
        return F.struct(number.alias("kind"), (end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("text"), v.alias("value"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(may & text.rlike(pattern), let(found, spans)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _tail(F.abs(z)))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^[0-9]+$"), "decimal").when(token.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike(r"^[A-Z2-7]+$"), "base32").otherwise("base64")
    )


def randomness(value: Column) -> Column:
    """(encoding, n, p, bits) of a string: the combined p-value of the three tests."""
    plain = lambda token, kind: F.translate(F.when(kind == "hex", F.lower(token)).otherwise(token), "-_", "+/")
    return let(F.regexp_replace(value, r"=+$", ""), lambda t: let(encoding(t), lambda kind: let(plain(t, kind), lambda x: _tests(x, kind))))


def _tests(plain: Column, kind: Column) -> Column:
    choose = lambda make: F.coalesce(*[F.when(kind == k, make(a)) for k, a in ALPHABETS.items()])
    number = lambda c: F.pow(n - F.char_length(F.replace(plain, F.lit(c), F.lit(""))), F.lit(2))
    n = F.char_length(plain).cast("double")
    size = choose(lambda a: F.lit(float(len(a))))
    # Chi-squared, made normal by Wilson and Hilferty's cube root.
    squares = choose(lambda a: sum((number(c) for c in a[1:]), number(a[0])))
    df = size - 1
    uneven = let(F.greatest(squares * size / n - n, F.lit(0.0)), lambda chi: let((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), _tail))

    # Runs of symbols in the upper and lower half of the alphabet.
    def runs_test(halves: Column) -> Column:
        ones = n - F.char_length(F.replace(halves, F.lit("1"), F.lit("")))
        runs = 1 + F.regexp_count(halves, F.lit("(?<=0)1|(?<=1)0"))

        def z(ones: Column) -> Column:
            mean = 2 * ones * (n - ones) / n + 1
            return (runs - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))

        return let(ones, lambda k: F.when((k == 0) | (k == n), F.lit(0.0)).otherwise(let(z(k), _two_sided)))

    halves = choose(lambda a: F.translate(plain, a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)))

    # Correlation of neighbours, the string taken as a ring so that all sums have n terms.
    def serial_test(codes: Column) -> Column:
        zero = F.lit(0.0)
        total = F.aggregate(codes, zero, lambda s, x: s + x)
        square = F.aggregate(codes, zero, lambda s, x: s + x * x)
        turned = F.concat(F.slice(codes, F.lit(2), F.size(codes)), F.slice(codes, F.lit(1), F.lit(1)))
        product = F.aggregate(F.zip_with(codes, turned, lambda x, y: x * y), zero, lambda s, x: s + x)
        sums = F.struct((square - total * total / n).alias("own"), (product - total * total / n).alias("next"))
        return let(sums, lambda v: F.when(v["own"] <= 0, zero).otherwise(let((v["next"] / v["own"] + 1 / (n - 1)) * F.sqrt(n), _two_sided)))

    codes = choose(lambda a: F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(a), c).cast("double")))
    logs = F.array(uneven, let(halves, runs_test), let(codes, serial_test))
    x = F.aggregate(logs, F.lit(0.0), lambda s, p: s - F.log(F.greatest(p, F.lit(1e-15))))
    combined = let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))
    return F.struct(kind.alias("encoding"), n.cast("bigint").alias("n"), combined.alias("p"), (n * F.log2(size)).alias("bits"))


def _length_class(n: Column) -> Column:
    return sum(((n >= c).cast("int") for c in CLASSES[1:]), (n >= CLASSES[0]).cast("int"))


def thresholds(tested: DataFrame) -> dict[int, float]:
    """From (n, p) of all candidates: for each class of lengths the least p from which on the
    expected share of structured strings is at most FALSE_SHARE, 2 where there is none."""
    bins = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = tested.groupBy(_length_class(F.col("n")).alias("class"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    above = F.sum("m").over(Window.partitionBy("class").orderBy(F.col("bin").desc()))  # a class has BINS rows at most
    upper = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("m")).otherwise(0)).over(Window.partitionBy("class"))
    # Random strings lie evenly: twice those above one half, times the share of the range above the bin.
    random = 2 * F.col("upper") * (1 - F.col("bin") / BINS)
    told = counts.withColumn("above", above).withColumn("upper", upper).withColumn("wrong", 1 - random / F.col("above"))
    least = told.where((F.col("wrong") <= FALSE_SHARE) & (F.col("upper") > 0)).groupBy("class").agg(F.min("bin").alias("bin"))
    found = {r["class"]: max(LEAST_P, r["bin"] / BINS) for r in least.collect()}
    return {c: found.get(c, 2.0) for c in range(len(CLASSES) + 1)}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, base, added) for each row of `docs`: arrays of (kind, start, end, text,
    value) in code points. `base` has the fixed kinds by start and kind, `added` the strings
    outside them that the tests call random (kind 3), by start.

    A null text is an empty text, without spans. Rows that repeat get equal spans. Other
    columns are not looked at; the thresholds come from all rows of `docs`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    assign = F.filter(matches(text, ASSIGN, "assign", F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), 2), lambda s: F.char_length(s["value"]) >= ASSIGN_VALUE)
    access = matches(text, ACCESS, "access", F.contains(text, F.lit("AKIA")))
    hexes = matches(text, HEX, "hex", F.lit(True))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), s["value"].alias("value"))
    base = F.array_sort(F.transform(F.concat(assign, access, hexes), order))
    tokens = matches(text, CANDIDATE, "random", F.lit(True))
    outside = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = rows.select("id", base.alias("base"), tokens.alias("tokens"))
    found = found.select("id", "base", F.transform(F.filter("tokens", outside), order).alias("tokens"))
    tested = found.select("id", "base", F.transform("tokens", lambda s: F.struct(s.alias("span"), randomness(s["text"]).alias("test"))).alias("tested"))
    tested = cut(tested.withColumn("tested", F.filter("tested", lambda x: x["test"]["bits"] >= BITS)), "secrets")
    least = thresholds(tested.select(F.explode("tested").alias("x")).select("x.test.n", "x.test.p"))

    def random(x: Column) -> Column:
        own = _length_class(x["test"]["n"])
        return F.coalesce(*[F.when(own == c, x["test"]["p"] >= t) for c, t in least.items()])

    return tested.select("id", "base", F.transform(F.filter("tested", random), lambda x: x["span"]).alias("added"))


def span_names(spans: Column, kinds: list[str] = KINDS) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")

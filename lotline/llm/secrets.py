"""Secrets in texts: three patterns, and a battery of randomness tests for what the patterns miss. DataFrame functions only.

Patterns, leftmost and not overlapping per kind, are ``assign`` (a keyword, a sign and a value of six characters or more), ``access``
(AKIA and more, 20 characters at least) and ``hex`` (24 at least). Spans are code points of the whole match, end exclusive.

The battery looks at runs of 20 or more characters of the base64 and URL alphabets; a run without an encoding of its own is cut at
its separators. The encoding is inferred from the characters (hex, base32, base36, base62, base64, URL base64; letters of one case alone are
none). The null hypothesis is that the run is an ordinary name: three tests ask whether it is more random than that.
Chi-squared: pairs of equal characters are fewer than letters of words give. Runs: digits, small and capital letters change more often (beside each other; separators don't count).
Serial: neighbours are unlikely after each other, by the pairs of neighbours that all shorter tokens of the table have. A name's
variance is taken larger than independent steps would give. Stouffer's rule combines the three, so that one test can't reject what the
others contradict. Within each class of lengths, Benjamini-Hochberg over all tested runs of the table keeps the share of false discoveries at FALSE_SHARE; p-values are counted in bins and judged by the upper edge of their bin, so that
only a small histogram is gathered. Discoveries that touch no pattern span are added as kind ``random``.

Null and empty texts have no spans. Every row of the input gives one row; long texts are one pass each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import keep, texts

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the kinds; [A-Z0-9]{16,} and {24,} match what + does and the shortest length leaves.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}",
    "part": r"[A-Za-z0-9]{20,}",
}
FALSE_SHARE = 0.05
SHORTEST = 20
#: Ordinary names: chance that two of their characters are equal (a larger one in a small alphabet), how far the spread of
#: such pairs exceeds that of even characters, and how often neighbours differ in class.
EQUAL, EQUAL_OF_ALPHABET, EQUAL_SPREAD, CHANGES = 0.055, 1.8, 0.0012, 0.3
#: The serial test: its deviation against that of independent neighbours, the weight of an even prior for each symbol's
#: followers, and the most regular and the least varied neighbours that names are taken to have, whatever few tokens a table has.
SERIAL_SPREAD, PRIOR, REGULAR, VARIED = 1.5, 10.0, -2.3, 1.2
#: Symbols of neighbours: letters of any case, a digit, a separator.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS_PER_DECADE, LAST_BIN, LAST_CLASS = 20, 400, 12
_PART = 256


def _located(df: DataFrame, kind: str) -> DataFrame:
    """Adds a column named ``kind``: array of (start, end, found) of the pattern's matches.

    The gaps between matches and the matches add up to places. Sums run in parts of _PART, so that many matches in one
    text don't cost their square. What a lambda looks into is a column used elsewhere too: the optimizer would move one
    used only there into the lambda and compute it for every element.
    """
    pattern = PATTERNS[kind]
    seen = F.col("text").rlike(pattern)
    df = df.withColumn("found", F.when(seen, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("gaps", F.when(seen, F.transform(F.split("text", pattern, -1), lambda x: F.length(x))))
    pair = lambda x, gap: F.struct(gap.alias("gap"), F.length(x).alias("n"), x.alias("x"))
    df = df.withColumn("pairs", F.zip_with("found", F.slice("gaps", F.lit(1), F.size("found")), pair))
    df = df.withColumn("parts", F.transform(F.sequence(F.lit(0), F.floor((F.size("pairs") - 1) / _PART).cast("int")), lambda b: F.slice("pairs", b * _PART + 1, _PART)))
    df = df.withColumn("sums", F.transform("parts", lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["n"])))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("all"), F.lit(0).alias("at"))
    df = df.withColumn("befores", F.aggregate("sums", start, lambda s, x: F.struct(F.concat(s["all"], F.array(s["at"])).alias("all"), (s["at"] + x).alias("at")), lambda s: s["all"]))
    spans = F.array().cast("array<struct<start:int,end:int,found:string>>")
    within = lambda p, before: F.aggregate(
        p, F.struct(spans.alias("all"), before.alias("at")),
        lambda s, x: F.struct(F.concat(s["all"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["x"].alias("found")))).alias("all"), (s["at"] + x["gap"] + x["n"]).alias("at")),
        lambda s: s["all"],
    )
    df = df.withColumn(kind, F.coalesce(F.flatten(F.zip_with("parts", "befores", within)), spans))
    return df.drop("found", "gaps", "pairs", "parts", "sums", "befores")


def _alphabet(x: Column) -> Column:
    """The symbols of the inferred encoding in order; null if there is none."""
    digit, lower, upper = x.rlike("[0-9]"), x.rlike("[a-z]"), x.rlike("[A-Z]")
    mixed = lower & upper
    return (
        F.when(digit & x.rlike("^([0-9a-f]+|[0-9A-F]+)$") & x.rlike("[a-fA-F]"), F.when(upper, DIGITS + UPPER[:6]).otherwise(DIGITS + LOWER[:6]))
        .when(digit & x.rlike("^[A-Z2-7]+$") & upper, UPPER + "234567")
        .when(digit & x.rlike("^([0-9a-z]+|[0-9A-Z]+)$") & (lower | upper), F.when(upper, DIGITS + UPPER).otherwise(DIGITS + LOWER))
        .when(mixed & x.rlike("^[0-9A-Za-z]+$"), DIGITS + UPPER + LOWER)
        .when(mixed & x.rlike("^[0-9A-Za-z+/]+$"), UPPER + LOWER + DIGITS + "+/")
        .when(mixed & x.rlike("^[0-9A-Za-z_-]+$"), UPPER + LOWER + DIGITS + "-_")
    )


def _symbols(x: Column) -> Column:
    """Letters in lower case, digits as 0, separators as -."""
    return F.translate(F.lower(x), "123456789+/_", "000000000---")


def neighbours(docs: DataFrame) -> tuple[list[float], float, float]:
    """ln of the chance of each symbol after each, and the mean and deviation of a step, from all different tokens of the table that are
    shorter than a run. Symbols x symbols numbers reach the driver."""
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0)), lambda t: (F.length(t) < SHORTEST) & (F.length(t) > 1))
    different = docs.select(F.explode(tokens).alias("t")).select(_symbols(F.col("t")).alias("t")).distinct()
    pairs = different.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("pair"))
    seen = {r.pair: int(r.n) for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    size = len(SYMBOLS)
    table, total, mean, square = [], sum(seen.values()), 0.0, 0.0
    for a in SYMBOLS:
        row = [seen.get(a + b, 0) for b in SYMBOLS]
        table += [math.log((n + PRIOR / size) / (sum(row) + PRIOR)) for n in row]
        mean += sum(n * v for n, v in zip(row, table[-size:]))
        square += sum(n * v * v for n, v in zip(row, table[-size:]))
    if not total:
        return table, -math.log(size), VARIED
    mean, square = mean / total, square / total
    return table, min(mean, REGULAR), max(VARIED, math.sqrt(max(square - mean * mean, 0.0)))


def _with_normal(df: DataFrame, z: str, name: str) -> DataFrame:
    """Adds the standard normal distribution function of column ``z``, by the usual five-term polynomial (error below 1e-7)."""
    t, x = F.col("t"), F.abs(z)
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    df = df.withColumn("t", 1 / (1 + 0.2316419 * x)).withColumn("tail", tail)
    return df.withColumn(name, F.when(F.col(z) < 0, F.col("tail")).otherwise(1 - F.col("tail"))).drop("t", "tail")


def battery(df: DataFrame, pairs: tuple[list[float], float, float]) -> DataFrame:
    """Adds to rows of ``found`` (a run) the p-value that it is an ordinary name; null without an encoding."""
    table, mean, deviation = pairs
    df = df.withColumn("alphabet", _alphabet(F.col("found"))).withColumns({"a": F.length("alphabet").cast("double"), "n": F.length("found").cast("double")})
    squares = F.aggregate(F.sequence(F.lit(1), F.length("alphabet")), F.lit(0).cast("double"), lambda s, k: s + F.pow(F.length("found") - F.length(F.replace("found", F.substring("alphabet", k, F.lit(1)))), F.lit(2.0)))
    kinds = F.translate(F.translate(F.regexp_replace("found", "[0-9]", "0"), UPPER, "A" * 26), LOWER, "a" * 26)
    df = df.withColumns({"equal": (squares - F.col("n")) / 2, "kinds": kinds, "symbols": F.transform(F.split(_symbols(F.col("found")), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)})
    df = df.withColumn("symbols", F.filter("symbols", lambda i: i >= 0))
    changes = F.aggregate(F.sequence(F.lit(2), F.length("found")), F.lit(0), lambda s, k: s + F.substring("kinds", k - 1, F.lit(2)).isin("0a", "a0", "0A", "A0", "aA", "Aa").cast("int"))
    codes = F.zip_with(F.slice("symbols", F.lit(1), F.size("symbols") - 1), F.slice("symbols", F.lit(2), F.size("symbols") - 1), lambda x, y: x * len(SYMBOLS) + y)
    df = df.withColumns({"changes": changes, "codes": codes, "likely": F.array(*map(F.lit, table))})
    likely = F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.get("likely", c))
    n, steps, two = F.col("n"), F.col("n") - 1, F.col("n") * (F.col("n") - 1) / 2
    equal = F.greatest(F.lit(EQUAL), EQUAL_OF_ALPHABET / F.col("a"))
    z = {
        "z1": (two * equal - F.col("equal")) / F.sqrt(two * equal * (1 - equal) + EQUAL_SPREAD * n * n * n),
        "z2": (F.col("changes") - CHANGES * steps) / F.sqrt(steps * CHANGES * (1 - CHANGES)),
        "z3": (mean * steps - likely) / (F.sqrt(steps) * deviation * SERIAL_SPREAD),
    }
    df = df.withColumn("z", F.when(F.col("alphabet").isNotNull(), -(z["z1"] + z["z2"] + z["z3"]) / math.sqrt(3)))
    df = _with_normal(df, "z", "p")
    return df.drop("alphabet", "a", "n", "equal", "kinds", "symbols", "changes", "codes", "likely", "z")


def tested_runs(runs: DataFrame) -> DataFrame:
    """``runs`` (start, end, found, ...) with those without an encoding replaced by their parts between separators that are long enough."""
    whole = _alphabet(F.col("found")).isNotNull()
    others = [c for c in runs.columns if c not in ("start", "end", "found")]
    cut = _located(runs.where(~whole).select(*others, F.col("start").alias("before"), F.col("found").alias("text")), "part")
    cut = cut.select(*others, "before", F.inline("part")).where(_alphabet(F.col("found")).isNotNull())
    return runs.where(whole).unionByName(cut.select(*others, (F.col("before") + F.col("start")).alias("start"), (F.col("before") + F.col("end")).alias("end"), "found"))


def discovered(runs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Rows of ``runs`` (with found and p) that the Benjamini-Hochberg rule of their class of lengths takes.

    Only the counts per class and bin (13 x 401 at most) are gathered, so the windows over them are bounded.
    """
    size = F.least(F.floor(2 * F.log2(F.length("found") / 20)), F.lit(LAST_CLASS)).cast("int")
    level = F.least(F.floor(-BINS_PER_DECADE * F.log10(F.greatest("p", F.lit(1e-30)))), F.lit(LAST_BIN)).cast("int")
    runs = runs.where("p is not null").withColumns({"size": size, "level": level})
    counts = runs.groupBy("size", "level").agg(F.count("*").alias("n"))
    by = Window.partitionBy("size")
    ranked = counts.withColumns({"k": F.sum("n").over(by.orderBy(F.desc("level"))), "all": F.sum("n").over(by)})
    limits = ranked.where(F.pow(F.lit(10.0), -F.col("level") / BINS_PER_DECADE) <= share * F.col("k") / F.col("all"))
    limits = limits.groupBy(F.col("size").alias("s")).agg(F.min("level").alias("least"))
    return runs.join(F.broadcast(limits), (F.col("size") == F.col("s")) & (F.col("level") >= F.col("least"))).drop("size", "level", "s", "least")


def scan(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, spans (array of start, kind number in KINDS, end, by start and kind), one row for each row of ``docs``."""
    df = texts(docs)
    pairs = neighbours(df)
    for kind in KINDS:
        df = _located(df, kind)
    good = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], PATTERNS["assign"], 1)) >= 6)
    span = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.concat(F.transform(good, span("assign")), F.transform("access", span("access")), F.transform("hex", span("hex"))))
    rows = keep(df.select("doc_id", base.alias("base"), F.col("random").alias("runs"), F.monotonically_increasing_id().alias("row")))
    runs = rows.where(F.size("runs") > 0).select("row", "base", F.inline("runs"))
    touched = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    more = discovered(keep(battery(tested_runs(runs), pairs)), share).where(~touched)
    more = more.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    met = rows.join(more, rows.row == more.r, "left")
    return met.select("doc_id", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def listed(spans: Column, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the first ``kinds`` kinds, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < kinds), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

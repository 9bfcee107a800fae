"""Column expressions: keys, tokens, categories, ratios. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor spellings and their standard form.
FLOOR_ALIASES = {
    "지": "지하1",
    "지1": "지하1",
    "지하": "지하1",
    "B1": "지하1",
    "B2": "지하2",
    "B3": "지하3",
    "B4": "지하4",
    "반": "반지하",
    "반지층": "반지하",
    "반지하": "반지하",
}
BASEMENT = "지하"
HALF_BASEMENT = "반지"
NO_TOKEN = "nan"

# Text parts of a shop name that do not belong to the brand.
BRACKETED = r"[\(\[].*?[\)\]]"
BRANCH_WORD = r"\s+\S*점$"
PUNCTUATION = r"[\s\-_·.,&']+"

# Lot kinds of the building registry.
LOT_KINDS = {"대지": 1, "산": 2}

Name = str | Column


def _c(col: Name) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_long(col: Name) -> Column:
    """Number or numeric text to bigint, null when it is not a number ("12.0" counts as 12)."""
    c = _c(col)
    return F.coalesce(c.cast("string").try_cast("bigint"), c.cast("string").try_cast("double").try_cast("bigint"))


def build_padded_key(
    parts: Sequence[tuple[Name, int, int | None]], null_if: Column | None = None
) -> Column:
    """B1: numeric parts as (column, width, default) to one zero-padded text.

    A part without a default makes the key null when it is not numeric; ``null_if`` is a further rule.
    Values longer than their width are kept whole (plain ``lpad`` would cut them).
    """
    texts = []
    for col, width, default in parts:
        number = to_long(col) if default is None else F.coalesce(to_long(col), F.lit(default).cast("bigint"))
        text = number.cast("string")
        texts.append(F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))
    key = F.concat(*texts)
    return key if null_if is None else F.when(~null_if, key)


def strip_prefix(col: Name, prefix: str) -> Column:
    """Drop a fixed text (a city name) wherever it stands and trim."""
    return F.trim(F.replace(_c(col), F.lit(prefix), F.lit("")))


def value_map(col: Name, mapping: dict, default=None) -> Column:
    """A small dictionary as CASE; values without an entry and nulls take the default."""
    out = None
    for key, value in mapping.items():
        out = F.when(_c(col) == F.lit(key), F.lit(value)) if out is None else out.when(_c(col) == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def normalize_token(col: Name, aliases: dict[str, str] | None = None) -> Column:
    """One spelling per floor. Null, blank and "nan" give ``nan``; leading zeros go ("00" becomes
    an empty text, "0" stays); alternative spellings and B<n> become the basement form."""
    aliases = FLOOR_ALIASES if aliases is None else aliases
    text = F.trim(_c(col))
    bare = F.when(text.rlike(r"^0+\d+$"), F.regexp_replace(text, r"^0+", "")).otherwise(text)
    known = value_map(bare, aliases)
    numbered = F.when(bare.rlike(r"^B\d+$"), F.concat(F.lit(BASEMENT), F.substr(bare, F.lit(2))))
    return (
        F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(NO_TOKEN))
        .otherwise(F.coalesce(known, numbered, bare))
    )


def split_code_by_limit(code: Name, limit: Name) -> tuple[Column, Column]:
    """Split a digit code into (floor, unit) so that the floor is the longest proper prefix that lies
    in 1..limit; else after the first digit. Other texts, and unknown limits, give (code, null)."""
    c, top = _c(code).cast("string"), _c(limit).cast("bigint")
    lengths = F.when(F.length(c) > 1, F.sequence(F.length(c) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(lengths, lambda n: F.substr(c, F.lit(1), n).try_cast("bigint").between(F.lit(1), top))
    at = F.coalesce(F.get(fits, F.lit(0)), F.lit(1))
    usable = c.rlike(r"^\d+$") & top.isNotNull() & (top > 0)
    prefix = F.substr(c, F.lit(1), at)
    floor = F.when(F.size(fits) > 0, prefix.try_cast("bigint").cast("string")).otherwise(prefix)
    return F.when(usable, floor).otherwise(c), F.when(usable, F.substr(c, at + 1))


def floor_category(token: Name) -> Column:
    """floor1, floor2+, basement, other, missing."""
    t = F.trim(_c(token).cast("string"))
    number = t.try_cast("double")
    return (
        F.when(t.isNull() | t.isin("", "nan", "None"), "missing")
        .when(t.startswith(BASEMENT) | t.startswith(HALF_BASEMENT) | F.upper(t).startswith("B"), "basement")
        .when(number.isNull(), "other")
        .when(number == 1, "floor1")
        .when(number >= 2, "floor2+")
        .otherwise("basement")
    )


def floor_number(token: Name, low: float = -10, high: float = 130) -> Column:
    """Signed floor number (basement n is -n, half basement -0.5), null outside low..high."""
    t = F.trim(_c(token).cast("string"))
    below = F.replace(t, F.lit(BASEMENT), F.lit("")).try_cast("double")
    number = (
        F.when(t.startswith(HALF_BASEMENT), F.lit(-0.5))
        .when(t.startswith(BASEMENT), F.when(below.isNotNull(), -below).otherwise(F.lit(-1.0)))
        .otherwise(t.try_cast("double"))
    )
    return F.when(number.between(low, high), number)


def location_id(parcel: Name, floor: Name, slot: Name) -> Column:
    """The location key ``parcel_floor_slot``; null when a part is null."""
    return F.concat(_c(parcel), F.lit("_"), _c(floor), F.lit("_"), _c(slot).cast("string"))


def parse_location_id(col: Name) -> dict[str, Column]:
    """Split at the first and the last underscore (a floor token may contain one)."""
    pattern = r"^([^_]*)_(.*)_([^_]*)$"
    return {name: F.regexp_extract(_c(col), pattern, i) for i, name in enumerate(("parcel", "floor", "slot"), start=1)}


def normalize_code(col: Name, bad: str | None = None) -> Column:
    """Numeric code as integer text; a bad value gives null, or the text ``bad``."""
    text = to_long(col).cast("string")
    return text if bad is None else F.coalesce(text, F.lit(bad))


def in_box(lon: Name, lat: Name, box: tuple[float, float, float, float] = (126.7, 127.2, 37.4, 37.7)) -> Column:
    """Coordinate inside the box (lon from, lon to, lat from, lat to); false for nulls."""
    inside = _c(lon).between(box[0], box[1]) & _c(lat).between(box[2], box[3])
    return F.coalesce(inside, F.lit(False))


def brand_key(name: Name, branch: Name | None = None) -> Column:
    """Comparable brand text: without branch, bracketed parts, a trailing branch word, punctuation."""
    text = F.coalesce(_c(name).cast("string"), F.lit(""))
    if branch is not None:
        b = _c(branch).cast("string")
        text = F.when(b.isNotNull() & (F.trim(b) != ""), F.replace(text, b, F.lit(" "))).otherwise(text)
    text = F.trim(F.regexp_replace(text, BRACKETED, " "))
    text = F.regexp_replace(text, BRANCH_WORD, "")
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


def ratio(a: Name, b: Name) -> Column:
    """A / b with a zero divisor giving null."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


def clip_col(col: Name, low=None, high=None) -> Column:
    """Bounds that leave nulls alone (``greatest`` alone would turn a null into the bound)."""
    c = _c(col)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def log1p_col(col: Name) -> Column:
    return F.log1p(_c(col))


def period_year(period: Name) -> Column:
    """Year of a YYYYMM period."""
    return F.floor(_c(period) / 100).cast("int")


def quarter_code(col: Name) -> Column:
    """YYYYQ to YYYYMM (month = last of the quarter); null for anything else."""
    text = _c(col).cast("string")
    month = value_map(F.substr(text, F.lit(5)), {"1": "03", "2": "06", "3": "09", "4": "12"})
    return F.when(text.rlike(r"^\d{5}$"), F.concat(F.substr(text, F.lit(1), F.lit(4)), month).cast("int"))


def text_contains(col: Name, pattern: str) -> Column:
    """Contains a text; null is no match."""
    return F.coalesce(F.contains(_c(col), F.lit(pattern)), F.lit(False))


def null_out(col: Name, *invalid: Column) -> Column:
    """Null where any rule holds (an unknown rule does not hold)."""
    hit = F.lit(False)
    for rule in invalid:
        hit = hit | F.coalesce(rule, F.lit(False))
    return F.when(~hit, _c(col))


def cut_bins(col: Name, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed bins (edge, edge]; outside all bins and null give null.

    The result is a struct (bin_idx, label), so that the order of the bins survives grouping.
    """
    c = _c(col)
    out = None
    for i, label in enumerate(labels):
        low, high = float(edges[i]), float(edges[i + 1])
        above = (c >= low) if include_lowest and i == 0 else (c > low)
        test = above & (c <= high)
        value = F.struct(F.lit(i).alias("bin_idx"), F.lit(label).alias("label"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def first_period_of(file_name: Name, pattern: str = r"(\d{6})") -> Column:
    """A1: YYYYMM in a file name; raises when there is none."""
    found = F.regexp_extract(_c(file_name), pattern, 1)
    return F.when(found != "", found).otherwise(
        F.raise_error(F.concat(F.lit("no period in file name "), _c(file_name)))
    ).cast("int")

"""Tail probabilities of chi-squared and F as column expressions: incomplete gamma and beta functions by series and
continued fractions, folded over a sequence whose length follows from the arguments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _n(x: float) -> Column:
    return F.lit(float(x))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series ten steps up."""
    w = z + 10
    up = z
    for i in range(1, 10):
        up = up * (z + i)
    r = _n(1.0) / w
    terms = r / 12 - r * r * r / 360 + F.pow(r, _n(5)) / 1260 - F.pow(r, _n(7)) / 1680 + F.pow(r, _n(9)) / 1188
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + terms - F.log(up)


def _fold(steps: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """A state of doubles carried over 1, 2, ..., steps."""
    def state(values: dict[str, Column]) -> Column:
        return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])

    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), state(start), lambda s, i: state(step(s, i.cast("double"))))


def _off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _n(_TINY)).otherwise(x)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x): a series for its complement below a + 1, a continued fraction (Lentz) above."""
    a, x = a.cast("double"), x.cast("double")
    many = 200 + 12 * F.sqrt(F.greatest(a, _n(1.0)))
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = _fold(many, {"term": _n(1.0) / a, "sum": _n(1.0) / a}, lambda s, i: {
        "term": s["term"] * x / (a + i), "sum": s["sum"] + s["term"] * x / (a + i)})

    def lentz(s: Column, i: Column) -> dict[str, Column]:
        an, b = -i * (i - a), s["b"] + 2
        d = _n(1.0) / _off_zero(an * s["d"] + b)
        c = _off_zero(b + an / s["c"])
        return {"b": b, "c": c, "d": d, "h": s["h"] * d * c}

    b = x + 1 - a
    first = _n(1.0) / _off_zero(b)
    fraction = _fold(many, {"b": b, "c": _n(1 / _TINY), "d": first, "h": first}, lentz)["h"]
    return F.when(x <= 0, _n(1.0)).when(x < a + 1, 1 - front * series["sum"]).otherwise(front * fraction)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction, from the side where it converges fast."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    turn = x > (a + 1) / (a + b + 2)
    p, q = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
    y = F.when(turn, 1 - x).otherwise(x)
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) / p

    def lentz(s: Column, m: Column) -> dict[str, Column]:
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = _n(1.0) / _off_zero(1 + even * s["d"]), _off_zero(1 + even / s["c"])
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d2, c2 = _n(1.0) / _off_zero(1 + odd * d), _off_zero(1 + odd / c)
        return {"c": c2, "d": d2, "h": s["h"] * d * c * d2 * c2}

    first = _n(1.0) / _off_zero(1 - (p + q) * y / (p + 1))
    many = 200 + 12 * F.sqrt(F.greatest(a, b, _n(1.0)))
    value = front * _fold(many, {"c": _n(1.0), "d": first, "h": first}, lentz)["h"]
    return F.when(x <= 0, _n(0.0)).when(x >= 1, _n(1.0)).otherwise(F.when(turn, 1 - value).otherwise(value))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """Probability that chi-squared with ``dof`` degrees of freedom is at least x; null without degrees of freedom or x."""
    known = (dof > 0) & x.isNotNull()
    return F.when(known, F.least(_n(1.0), F.greatest(_n(0.0), upper_gamma(F.when(known, dof).otherwise(1) / 2, F.coalesce(x, _n(0.0)) / 2))))


def f_tail(f: Column, dof1: Column, dof2: Column) -> Column:
    """Probability that F with these degrees of freedom is at least f."""
    known = (dof1 > 0) & (dof2 > 0) & f.isNotNull()
    d1, d2 = F.when(known, dof1).otherwise(1).cast("double"), F.when(known, dof2).otherwise(1).cast("double")
    value = F.greatest(F.coalesce(f, _n(0.0)), _n(0.0))
    return F.when(known, F.least(_n(1.0), F.greatest(_n(0.0), incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * value)))))

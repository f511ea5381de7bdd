"""Special functions as column expressions: normal, chi-square, Student t and F tails.

They are meant for rows that are already aggregated: series and fractions run in higher-order functions, which are interpreted. The number of
terms follows the arguments, so no number of degrees of freedom is too large.
Undefined arguments give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate a column once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def _down(n: int) -> Column:
    return F.sequence(F.lit(n), F.lit(1), F.lit(-1))


def erfc(x: Column) -> Column:
    """Complementary error function: a positive series below 2 and a continued fraction beyond, mirrored for negative x."""

    def positive(z):
        series = F.aggregate(_down(60), F.lit(1.0), lambda s, n: F.lit(1.0) + s * F.lit(2.0) * z * z / (F.lit(2.0) * n + F.lit(1.0)))
        fraction = F.aggregate(_down(60), z, lambda f, n: z + n / F.lit(2.0) / f)
        low = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * z * F.exp(-z * z) * series
        return F.when(z < 2, low).otherwise(F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * fraction))

    return let(x.cast("double"), lambda v: F.when(v < 0, F.lit(2.0) - positive(-v)).otherwise(positive(v)))


def norm_cdf(z: Column) -> Column:
    return erfc(-z / F.lit(math.sqrt(2.0))) / F.lit(2.0)


def norm_two_tailed(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_sf(x: Column, k: int | Column) -> Column:
    """Upper tail of chi-square: the finite sums for even and odd whole degrees of freedom up to 60, else the incomplete gamma function."""
    if isinstance(k, int):
        return let(x.cast("double"), lambda v: _chi2_even(v, k) if k % 2 == 0 else _chi2_odd(v, k))

    def general(v):
        h = v / F.lit(2.0)
        whole = (k <= 60) & (k == F.floor(k))
        even = F.exp(-h) * F.aggregate(F.when(k > 2, F.sequence((k / 2).cast("int") - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda s, j: F.lit(1.0) + s * h / j)
        terms = F.when(k > 3, F.sequence(((k - 1) / 2).cast("int"), F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        odd = erfc(F.sqrt(h)) + F.when(k >= 3, F.lit(math.sqrt(2 / math.pi)) * F.exp(-h) * F.sqrt(v) * F.aggregate(terms, F.lit(1.0), lambda s, r: F.lit(1.0) + s * v / (F.lit(2.0) * r - F.lit(1.0)))).otherwise(F.lit(0.0))
        return F.when((k <= 0) | (v < 0), F.lit(None).cast("double")).when(~whole, gamma_q(k / F.lit(2.0), h)).when(k % 2 == 0, even).otherwise(odd)

    return let(x.cast("double"), general)


def _chi2_even(v: Column, k: int) -> Column:
    h, s = v / F.lit(2.0), F.lit(1.0)
    for j in range(k // 2 - 1, 0, -1):
        s = F.lit(1.0) + s * h / F.lit(float(j))
    return F.exp(-h) * s


def _chi2_odd(v: Column, k: int) -> Column:
    if k == 1:
        return erfc(F.sqrt(v / F.lit(2.0)))
    s = F.lit(1.0)
    for r in range((k - 1) // 2, 1, -1):
        s = F.lit(1.0) + s * v / F.lit(2.0 * r - 1.0)
    return erfc(F.sqrt(v / F.lit(2.0))) + F.lit(math.sqrt(2 / math.pi)) * F.exp(-v / F.lit(2.0)) * F.sqrt(v) * s


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: Stirling's series at x + 8, brought back by eight steps."""

    def of(v):
        z = v + F.lit(8.0)
        w = F.lit(1.0) / (z * z)
        tail = (F.lit(1 / 12) - w * (F.lit(1 / 360) - w * (F.lit(1 / 1260) - w * F.lit(1 / 1680)))) / z
        back = F.lit(0.0)
        for i in range(8):
            back = back + F.log(v + F.lit(float(i)))
        return (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + tail - back

    return F.when(x > 0, let(x.cast("double"), of))


def _stirling_tail(z: Column) -> Column:
    w = F.lit(1.0) / (z * z)
    return (F.lit(1 / 12) - w * (F.lit(1 / 360) - w * (F.lit(1 / 1260) - w * F.lit(1 / 1680)))) / z


def log_beta(p: Column, q: Column) -> Column:
    """Log of the beta function; for a large argument the difference of two log gammas is taken term by term, so that digits do not cancel."""

    def of(v):
        big, small, both = v["big"], v["small"], v["big"] + v["small"]
        step = (big - F.lit(0.5)) * F.log1p(small / big) + small * F.log(both) - small + _stirling_tail(both) - _stirling_tail(big)
        return lgamma(small) - F.when(big < 16, lgamma(both) - lgamma(big)).otherwise(step)

    return let(F.struct(F.greatest(p, q).alias("big"), F.least(p, q).alias("small")), of)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function from its innermost term outward; right of the mean it needs about the root of the larger parameter in terms."""
    terms = (F.lit(60) + F.ceil(F.sqrt(F.greatest(a, b)))).cast("int")

    def outward(inner, k):
        m = k.cast("double")
        even = m * (b - m) * x / ((a + F.lit(2.0) * m - F.lit(1.0)) * (a + F.lit(2.0) * m))
        odd = -(a + m) * (a + b + m) * x / ((a + F.lit(2.0) * m) * (a + F.lit(2.0) * m + F.lit(1.0)))
        return F.lit(1.0) + even / (F.lit(1.0) + odd / inner)

    return F.lit(1.0) / (F.lit(1.0) - (a + b) * x / (a + F.lit(1.0)) / F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), outward))


def beta_inc(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta function; y: 1 - x, if it is known more exactly than from x."""

    def side(p, q, t, u):
        return F.exp(p * F.log(t) + q * F.log(u) - log_beta(p, q)) / p * _beta_fraction(p, q, t)

    def of(v):
        p, q, t, u = v["a"], v["b"], v["x"], v["y"]
        inside = F.when(t < (p + F.lit(1.0)) / (p + q + F.lit(2.0)), side(p, q, t, u)).otherwise(F.lit(1.0) - side(q, p, u, t))
        return F.when((p <= 0) | (q <= 0) | (t < 0) | (u < 0), F.lit(None).cast("double")).when(t == 0, F.lit(0.0)).when(u == 0, F.lit(1.0)).otherwise(inside)

    y = F.lit(1.0) - x if y is None else y
    return let(F.struct(*[c.cast("double").alias(n) for n, c in zip("abxy", (a, b, x, y), strict=True)]), of)


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: the series of the lower one left of the mean, the continued fraction, from its innermost term outward, right of it."""

    def of(v):
        s, z = v["a"], v["x"]
        terms = (F.lit(60) + F.ceil(F.lit(9.0) * F.sqrt(s))).cast("int")
        front = F.exp(s * F.log(z) - z - lgamma(s))
        series = F.aggregate(_from(terms), F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * z / (s + k))
        fraction = F.aggregate(_from(terms), z + F.lit(2.0) * terms + F.lit(1.0) - s, lambda acc, k: z + F.lit(2.0) * k - F.lit(1.0) - s - k * (k - s) / acc)
        return F.when((s <= 0) | (z < 0), F.lit(None).cast("double")).when(z == 0, F.lit(1.0)).when(z < s + 1, F.lit(1.0) - front / s * series).otherwise(front / fraction)

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), of)


def _from(terms: Column) -> Column:
    return F.transform(F.sequence(terms, F.lit(1), F.lit(-1)), lambda k: k.cast("double"))


def t_two_tailed(t: Column, df: Column) -> Column:
    return F.when(df > 0, beta_inc(df / F.lit(2.0), F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    return F.when((d1 > 0) & (d2 > 0) & (f >= 0), beta_inc(d2 / F.lit(2.0), d1 / F.lit(2.0), d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)))

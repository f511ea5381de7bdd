"""Leading and last digits: Benford's law, last-digit uniformity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.special import chi2_sf

BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]
MIN_BENFORD, MIN_LAST = 50, 30


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def leading_digit(x: Column) -> Column:
    """First significant digit of a positive finite number, else null."""
    return F.when(finite(x) & (x > 0), F.substring(F.format_string("%.16e", x), 1, 1).cast("int"))


def last_digit(x: Column) -> Column:
    """Last digit of the whole part of a finite number, else null."""
    return F.when(finite(x), (F.floor(F.abs(x)) % 10).cast("int"))


def histogram(digit: Column, digits: Sequence[int]) -> list[Column]:
    return [F.count(F.when(digit == d, 1)).alias(f"c{d}") for d in digits]


def _chi2(observed: list[Column], expected: list[Column]) -> Column:
    total = F.lit(0.0)
    for o, e in zip(observed, expected, strict=True):
        total = total + (o - e) * (o - e) / e
    return total


def digit_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per group: n and the counts c1..c9, by partial aggregation of nine counters."""
    x = F.col(value).cast("double")
    kept = df.select(*by, x.alias("x")).where(finite(F.col("x")) & (F.col("x") > 0)).select(*by, "x", leading_digit(F.col("x")).alias("d"))
    span = F.log10(F.max("x") / F.min("x"))
    return kept.groupBy(*by).agg(F.count("*").alias("n"), span.alias("span"), *histogram(F.col("d"), range(1, 10)))


def benford(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Benford audit of each group: chi-square (8 df), p, mean absolute deviation, verdict, and whether the values span two decades.

    Groups of fewer than 50 positive values have status `insufficient` and no figures."""
    counts = digit_counts(df, value, by)
    n = F.col("n").cast("double")
    observed = [F.col(f"c{d}").cast("double") for d in range(1, 10)]
    chi2 = _chi2(observed, [n * F.lit(e) for e in BENFORD])
    deviation = F.lit(0.0)
    for o, e in zip(observed, BENFORD, strict=True):
        deviation = deviation + F.abs(o / n - F.lit(e))
    enough = F.col("n") >= MIN_BENFORD
    raw = counts.select(*by, "n", "span", enough.alias("ok"), chi2.alias("x2"), (deviation / F.lit(9.0)).alias("dev")).withColumn("p", chi2_sf(F.col("x2"), 8))
    verdict = F.when(F.col("p") < 0.01, "SIGNIFICANT").when(F.col("p") < 0.05, "SUSPICIOUS").when(F.col("p") < 0.10, "MARGINAL").otherwise("CONSISTENT")
    given = lambda c: F.when(F.col("ok"), c)
    return raw.select(
        *by, "n", F.when(F.col("ok"), "ok").otherwise("insufficient").alias("status"), given(F.round("x2", 3)).alias("chi2"), given(F.round("p", 4)).alias("p_value"),
        given(F.round("dev", 4)).alias("mad"), given(F.col("dev") > 0.015).alias("mad_nonconforming"), given(verdict).alias("verdict"), given(F.col("span") >= 2).alias("applicable"),
    )


def benford_digits(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per group and digit: expected and actual share, counts, z, and whether |z| is above 2."""
    n = F.col("n").cast("double")
    rows = F.array(*[F.struct(F.lit(d).alias("digit"), F.lit(e).alias("e"), F.col(f"c{d}").alias("o")) for d, e in enumerate(BENFORD, 1)])
    each = digit_counts(df, value, by).where(F.col("n") >= MIN_BENFORD).select(*by, "n", F.inline(rows))
    z = (F.col("o") - n * F.col("e")) / F.sqrt(n * F.col("e"))
    return each.select(
        *by, "digit", F.round(F.col("e") * 100, 2).alias("expected_pct"), F.round(F.col("o") * 100 / n, 2).alias("actual_pct"), F.round(n * F.col("e"), 1).alias("expected"),
        F.col("o").alias("actual"), F.round(z, 2).alias("z"), (F.abs(z) > 2).alias("flagged"),
    )


def last_digits(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Last-digit test of each group: chi-square against ten equal shares (9 df), over- and under-used digits; at least 30 values."""
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).select(*by, last_digit(x).alias("d")).groupBy(*by).agg(F.count("*").alias("n"), *histogram(F.col("d"), range(10)))
    e = F.col("n").cast("double") / F.lit(10.0)
    chi2 = _chi2([F.col(f"c{d}").cast("double") for d in range(10)], [e] * 10)
    pick = lambda test: F.concat_ws(",", *[F.when(test(F.col(f"c{d}")), F.lit(str(d))) for d in range(10)])
    raw = counts.withColumn("x2", chi2).withColumn("p", chi2_sf(F.col("x2"), 9)).withColumn("ok", F.col("n") >= MIN_LAST)
    given = lambda c: F.when(F.col("ok"), c)
    round_share = (F.col("c0") + F.col("c5")) / F.col("n")
    return raw.select(
        *by, "n", F.when(F.col("ok"), "ok").otherwise("insufficient").alias("status"), given(F.round("x2", 2)).alias("chi2"), given(F.round("p", 4)).alias("p_value"), given(F.col("p") > 0.01).alias("natural"),
        given(pick(lambda c: c > 2 * e)).alias("over"), given(pick(lambda c: (c < 0.3 * e) & (c < 5))).alias("under"), given(F.round(round_share, 4)).alias("round_share"),
    )


# Kinds of data that Benford's law does not hold for: bounded, assigned, of a narrow range or set by people.
UNSUITABLE = ("p_value", "percentage", "human_measure", "questionnaire", "identifier", "correlation", "price")


def of_kind(audit: DataFrame, kind: Column) -> DataFrame:
    """An audit that is not applicable to groups of unsuitable kinds, whatever their span."""
    return audit.withColumn("applicable", F.col("applicable") & ~F.coalesce(kind.isin(*UNSUITABLE), F.lit(False)))

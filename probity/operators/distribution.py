"""Moments, a Shapiro-Wilk surrogate, Anderson-Darling, uniformity and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.special import chi2_sf, norm_cdf, norm_two_tailed
from probity.operators.digits import finite, last_digits
from probity.sources import materialise


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("x")).where(finite(F.col("x")))


def moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, mean, sample variance and deviation, bias-adjusted skewness and excess kurtosis of each group (0 where undefined), unrounded."""
    n = F.col("n").cast("double")
    raw = _values(df, value, by).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    flat = F.col("low") == F.col("high")
    skew = F.when((F.col("n") < 3) | flat, 0.0).otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((F.col("n") < 4) | flat, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return raw.select(*by, "n", "mean", "variance", F.sqrt("variance").alias("sd"), skew.alias("skewness"), kurt.alias("kurtosis"))


def w_surrogate(skewness: Column, kurtosis: Column) -> Column:
    """Not Shapiro-Wilk's W: 1 less penalties for skewness and kurtosis, at least 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(0.05) * F.abs(kurtosis) + F.lit(0.10) * F.abs(skewness)))


def anderson_darling(df: DataFrame, value: str, by: Sequence[str], buckets: int = 64) -> DataFrame:
    """A-squared of each group against a normal with the sample's mean and deviation. Needs 5 values (else 0).

    The i-th of n sorted values enters with weights 2i-1 for its lower and 2(n-i)+1 for its upper tail. Equal values meet first: c of them after o
    smaller ones weigh (o+c)^2 - o^2 and (n-o)^2 - (n-o-c)^2. Ranks are found within buckets between approximate quantiles, on top of the counts of
    the buckets below, so a group is never sorted in one task."""
    values = _values(df, value, by)
    share = [i / buckets for i in range(1, buckets)]
    stats = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.percentile_approx("x", share, 10_000).alias("edges"))
    # read twice: quantiles of another merge order would put a value into another bucket than the one it was counted in
    stats = materialise(stats.select(*[F.col(c).alias(f"_{c}") for c in by], "n", "m", "s", "edges"))
    same = lambda x, y: [x[c].eqNullSafe(y[f"_{c}"]) for c in by]
    each = values.groupBy(*by, "x").agg(F.count("*").alias("c"))
    placed = each.join(stats, same(each, stats)).select(*by, "x", "c", "n", "m", "s", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bucket"))
    below = placed.groupBy(*by, "bucket").agg(F.sum("c").alias("held"))
    below = below.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bucket").alias("_bucket"), (F.sum("held").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("held")).alias("below"))
    ranked = placed.join(below, [*same(placed, below), placed["bucket"] == below["_bucket"]])
    before = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "bucket").orderBy("x")) - F.col("c")
    ranked = ranked.select(*by, "x", F.col("c").cast("double").alias("c"), F.col("n").cast("double").alias("n"), "m", "s", before.cast("double").alias("o"))
    z = F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s"))
    p = ranked.withColumn("z", z).withColumn("p", norm_cdf(F.col("z"))).withColumn("q", norm_cdf(-F.col("z")))
    n, o, c = F.col("n"), F.col("o"), F.col("c")
    term = c * (2 * o + c) * F.log(F.greatest("p", F.lit(1e-10))) + c * (2 * (n - o) - c) * F.log(F.greatest("q", F.lit(1e-10)))
    total = p.groupBy(*by).agg(F.max("n").alias("n"), F.sum(term).alias("t"), F.max("s").alias("s"))
    return total.select(*by, n.cast("long").alias("n"), F.when(n < 5, 0.0).when(F.col("s") > 0, -n - F.col("t") / n).alias("a2"))


def normality_report(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The normality figures of each group with A-squared and the last-digit test."""
    base, other = normality(df, value, by), {"a2": anderson_darling(df, value, by).select(*by, F.round("a2", 3).alias("a2")), "last": last_digits(df, value, by).select(*by, F.col("chi2").alias("last_chi2"), F.col("p_value").alias("last_p"), "natural", "over", "under")}
    for name, part in other.items():
        part = part.withColumnsRenamed({c: f"_{name}_{c}" for c in by})
        keys = [F.col(c).eqNullSafe(F.col(f"_{name}_{c}")) for c in by]
        base = base.join(part, keys, "left").drop(*[f"_{name}_{c}" for c in by])
    return base


def normality(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Moments, the surrogate and notes of each group; at least 10 values."""
    m = moments(df, value, by)
    ok = F.col("n") >= 10
    skew_note = F.when(F.abs("skewness") > 2, "strong skew").when(F.abs("skewness") > 1, "moderate skew")
    tail_note = F.when(F.col("kurtosis") > 2, "heavy tails").when(F.col("kurtosis") < -1, "too uniform")
    return m.select(
        *by, "n", F.when(ok, "ok").otherwise("insufficient").alias("status"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"),
        F.when(ok, F.round(w_surrogate(F.col("skewness"), F.col("kurtosis")), 4)).alias("w_surrogate"), F.when(ok, F.concat_ws(",", skew_note, tail_note)).alias("notes"),
    )


def uniform_chi2(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Chi-square of ten equal bins over each group's own range (9 df); at least 20 values that are not all the same."""
    values = _values(df, value, by)
    edges = values.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    keyed = values.join(edges.select(*[F.col(c).alias(f"e_{c}") for c in by], "low", "high"), [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in by]).drop(*[f"e_{c}" for c in by])
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / 10)), F.lit(9)))
    counts = keyed.select(*by, "low", "high", bin_.alias("b")).groupBy(*by).agg(F.count("*").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), *[F.count(F.when(F.col("b") == b, 1)).alias(f"b{b}") for b in range(10)])
    e = F.col("n").cast("double") / 10
    x2 = F.lit(0.0)
    for b in range(10):
        x2 = x2 + (F.col(f"b{b}") - e) * (F.col(f"b{b}") - e) / e
    raw = counts.withColumn("x2", x2).withColumn("p", chi2_sf(F.col("x2"), 9))
    status = F.when(F.col("n") < 20, "insufficient").when(F.col("high") == F.col("low"), "constant").otherwise("ok")
    given = lambda c: F.when((F.col("n") >= 20) & (F.col("high") > F.col("low")), c)
    return raw.select(*by, "n", status.alias("status"), given(F.round("x2", 3)).alias("chi2"), given(F.round("p", 4)).alias("p_value"), given(F.col("p") > 0.05).alias("uniform_like"), given(F.col("p") < 0.001).alias("strongly_not"))


def runs_test(df: DataFrame, bit: Column, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Wald-Wolfowitz runs test of each group's bits, in the given total order; at least 10 bits of both kinds."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    bits = df.select(*by, *order, bit.cast("int").alias("b")).where("b is not null")
    change = bits.select(*by, "b", F.coalesce((F.col("b") != F.lag("b").over(ordered)).cast("int"), F.lit(1)).alias("starts"))
    counts = change.groupBy(*by).agg(F.count("*").alias("n"), F.sum("b").alias("n1"), F.sum("starts").alias("runs"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    both = 2 * n1 * (n - n1)
    raw = counts.withColumn("mu", both / n + 1).withColumn("var", F.try_divide(both * (both - n), n * n * (n - 1)))
    raw = raw.withColumn("z", F.when(F.col("var") > 0, (F.col("runs") - F.col("mu")) / F.sqrt("var"))).withColumn("p", norm_two_tailed(F.col("z")))
    status = F.when(F.col("n") < 10, "insufficient").when((F.col("n1") == 0) | (F.col("n1") == F.col("n")) | F.col("z").isNull(), "invalid").otherwise("ok")
    raw = raw.withColumn("status", status)
    given = lambda c: F.when(F.col("status") == "ok", c)
    note = F.when(F.col("z") < -2, "too few").when(F.col("z") > 2, "too many").otherwise("as expected")
    return raw.select(
        *by, "n", "n1", "runs", "status", given(F.round("mu", 4)).alias("expected_runs"), given(F.round("z", 4)).alias("z"), given(F.round("p", 4)).alias("p_value"), given(F.col("p") > 0.01).alias("random"), given(note).alias("note")
    )


def bits_of_bytes(df: DataFrame, content: str, by: Sequence[str]) -> DataFrame:
    """One row per bit of a binary column, most significant first: by..., pos, bit."""
    byte = df.select(*by, F.posexplode(F.split(F.hex(content), "(?<=\\G..)")).alias("byte_at", "byte_hex")).where("byte_hex <> ''")
    value = F.conv("byte_hex", 16, 10).cast("int")
    bits = byte.select(*by, "byte_at", value.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit_at"))
    return bits.select(*by, (F.col("byte_at") * 8 + F.col("bit_at")).cast("long").alias("pos"), F.call_function("getbit", F.col("byte"), 7 - F.col("bit_at")).cast("int").alias("bit"))

"""p-curve analysis of significant p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.special import chi2_sf


def p_curve(df: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """Five bins of 0.01, closed on the right, over 0 < p < 0.05, for each group; three inputs and one significant one at least."""
    x = F.col("x")
    bins = F.when(~((x > 0) & (x < 0.05)), None).when(x <= 0.01, 0).when(x <= 0.02, 1).when(x <= 0.03, 2).when(x <= 0.04, 3).otherwise(4)
    counts = df.select(*by, F.col(p).cast("double").alias("x")).where("x is not null").select(*by, bins.alias("b"))
    counts = counts.groupBy(*by).agg(F.count("*").alias("n_all"), F.count("b").alias("n"), *[F.count(F.when(F.col("b") == b, 1)).alias(f"c{b + 1}") for b in range(5)])
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    mean, x2 = F.lit(0.0), F.lit(0.0)
    for b in range(5):
        c = F.col(f"c{b + 1}").cast("double")
        mean = mean + F.lit((2 * b + 1) * 0.005) * c / n
        x2 = x2 + (c - n / 5) * (c - n / 5) / (n / 5)
    raw = counts.withColumn("skew", F.when(F.col("n") < 5, 0.0).otherwise(F.lit(0.025) - mean)).withColumn("x2", x2).withColumn("pv", F.round(chi2_sf(F.col("x2"), 4), 4))
    shape = F.when(F.col("skew") > 0.005, "RIGHT").when(F.col("skew") > 1e-12, "WEAK").when(F.col("skew") > -0.003, "FLAT").otherwise("LEFT")
    e, share = n / 5, F.col("c5") / n
    cluster = F.when((F.col("pv") < 0.05) & (F.col("c5") / e > 1.5) & (F.col("c1") / e < 0.8), "CLIFF").when((F.col("pv") < 0.05) & (F.col("c5") / e > 1.3), "CLUSTER").otherwise("NONE")
    border = F.when(share > 0.3, "HIGH").when(share > 0.2, "WARN").otherwise("OK")
    odd = F.concat_ws(",", *[F.when(F.abs(F.col(f"c{b}") - e) / e > 0.5, F.lit(str(b))) for b in range(1, 6)])
    ok = (F.col("n_all") >= 3) & (F.col("n") >= 1)
    given = lambda c: F.when(ok, c)
    return raw.select(
        *by, "n_all", "n", *[f"c{b}" for b in range(1, 6)], F.when(ok, "ok").otherwise("insufficient").alias("status"), given(F.round("skew", 4)).alias("skew"), given(F.round("x2", 3)).alias("chi2"), given(F.col("pv")).alias("p_value"),
        given(shape).alias("shape"), given(cluster).alias("cluster"), given(border).alias("borderline"), given(odd).alias("odd_bins"),
    )

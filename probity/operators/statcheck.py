"""Recomputed p-values and effect sizes of reported statistics.

Input rows: test (t, t_paired, r, F, chi2), n, df, df1, df2, stat, reported_p, reported_es; absent values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.special import chi2_sf, f_sf, t_two_tailed

C = F.col


def r_to_t(r: Column, n: Column) -> Column:
    return F.when((F.abs(r) < 1) & (n > 2), r * F.sqrt((n - 2) / (1 - r * r)))


def recheck(df: DataFrame) -> DataFrame:
    """Adds status, p_value (two-tailed or upper), p_one_tailed, matches, matches_one_tailed, discrepancy and verdict."""
    t = F.when(C("test") == "r", r_to_t(C("stat"), C("n"))).otherwise(C("stat"))
    dof = F.when(C("test") == "r", F.coalesce(C("n") - 2, C("df"))).otherwise(C("df")).cast("double")
    p = F.when(C("test").isin("t", "t_paired", "r"), t_two_tailed(t, dof)).when(C("test") == "F", f_sf(C("stat"), C("df1"), C("df2"))).when(C("test") == "chi2", chi2_sf(C("stat"), C("df").cast("double")))
    out = df.withColumn("_p", p)
    delta = C("reported_p") - C("_p")
    gap = F.abs(delta)
    one = F.when(C("test").isin("t", "t_paired", "r"), C("_p") / 2)
    verdict = (
        F.when(C("reported_p") == 0, "CRITICAL_ZERO").when(C("reported_p") < 0, "CRITICAL_NEGATIVE").when(C("reported_p") > 1, "CRITICAL_ABOVE_ONE")
        .when(gap > 0.05, "HIGH").when(gap > 0.01, "MODERATE").when(gap > 0.001, "MINOR").when(gap < 0.001, "OK").otherwise("UNDETERMINED")
    )
    status = F.when(C("_p").isNull(), "invalid").otherwise("ok")
    return out.select(
        *df.columns, status.alias("status"), F.round("_p", 6).alias("p_value"), F.round(one, 6).alias("p_one_tailed"), (gap < 0.001).alias("matches"), (F.abs(C("reported_p") - one) < 0.001).alias("matches_one_tailed"),
        F.round(delta, 6).alias("discrepancy"), F.when(C("_p").isNull(), "INVALID").otherwise(verdict).alias("verdict"),
    )


def df_consistency(df: DataFrame) -> DataFrame:
    """n that the degrees of freedom ask for, by design, and whether the reported n agrees."""
    need = F.when(C("design").isin("independent_t", "correlation"), C("df") + 2).when(C("design").isin("paired_t", "one_sample_t"), C("df") + 1).when(C("design") == "chi2_gof", C("df") + 1).when(C("design") == "anova_between", C("df") + C("groups")).when(C("design") == "regression", C("df") + C("groups") + 1)
    return df.withColumn("implied_n", need.cast("long")).withColumn("consistent", C("n") == need)


def implied_effect(test: Column, stat: Column, n: Column, df1: Column, df2: Column, kind: Column | None = None) -> Column:
    """Cohen's d, paired d, r, eta squared or phi that the statistic implies; null where undefined. kind: `r` where the statistic of a correlation
    is the coefficient itself, else it is its t."""
    dof = n - 2
    if kind is not None:
        itself = (test == "r") & (kind == "r")
        return F.when(itself, F.when((dof > 0) & (F.abs(stat) <= 1), F.abs(stat))).otherwise(implied_effect(test, stat, n, df1, df2))
    return (
        F.when((test == "t") & (n > 0), stat * F.sqrt(1 / n + 1 / n)).when((test == "t_paired") & (n > 1), stat / F.sqrt(n - 1)).when((test == "r") & (dof > 0), F.sqrt(stat * stat / (stat * stat + dof)))
        .when((test == "F") & (stat >= 0) & (df1 > 0) & (df2 > 0), stat * df1 / (stat * df1 + df2)).when((test == "chi2") & (n > 0) & (stat >= 0), F.sqrt(stat / n))
    )


def cohens_f(eta_sq: Column) -> Column:
    return F.when((eta_sq >= 0) & (eta_sq < 1), F.sqrt(eta_sq / (1 - eta_sq)))


def odds_ratio(phi: Column) -> Column:
    return F.when(phi < 1, (1 + phi) / (1 - phi))


# Spellings of the tests in batch files.
ALIASES = {"ttest": "t", "t-test": "t", "corr": "r", "correlation": "r", "f": "F", "anova": "F", "chi-square": "chi2", "chisq": "chi2", "t": "t", "r": "r", "chi2": "chi2", "t_paired": "t_paired"}


def effect_sizes(df: DataFrame) -> DataFrame:
    """Adds the implied effect, Cohen's f, the odds ratio, the size class, the gap to the reported effect and its class; unknown tests are `skipped`.

    A column `stat_kind` of `r` or `t` tells what the statistic of a correlation is; without it, it is t."""
    kind = C("stat_kind") if "stat_kind" in df.columns else None
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    test = F.try_element_at(alias, F.lower("test"))
    d1 = F.when(test == "F", F.coalesce(C("df1"), F.lit(1))).otherwise(C("df1"))
    out = df.withColumn("_t", test).withColumn("_d1", d1).withColumn("_d2", F.coalesce(C("df2"), C("n") - C("_d1") - 1))
    out = out.withColumn("_e", implied_effect(C("_t"), C("stat").cast("double"), C("n").cast("double"), C("_d1").cast("double"), C("_d2").cast("double"), kind))
    a = F.abs(C("_e"))
    of_d = F.when(a > 2.5, "EXTREME").when((a > 1.5) & (C("n") < 30), "SUSPICIOUS").when(a > 1, "LARGE").when(a > 0.5, "MEDIUM").when(a > 0.2, "SMALL").otherwise("VERY_SMALL")
    of_r = F.when((a > 0.95) & (C("n") < 30), "SUSPICIOUS").when(a > 0.7, "LARGE").when(a > 0.3, "MEDIUM").when(a > 0.1, "SMALL").otherwise("VERY_SMALL")
    of_eta = F.when(a > 0.5, "SUSPICIOUS").when(a > 0.14, "LARGE").when(a > 0.06, "MEDIUM").when(a > 0.01, "SMALL").otherwise("VERY_SMALL")
    size = F.when(C("_e").isNull(), None).when(C("_t").isin("t", "t_paired"), of_d).when(C("_t") == "F", of_eta).otherwise(of_r)
    gap = C("reported_es") - C("_e")
    note = F.when(F.abs(gap) > 0.3, "MAJOR").when(F.abs(gap) >= 0.1, "MODERATE").when(gap.isNotNull(), "CONSISTENT")
    return out.select(
        *df.columns, F.when(C("_t").isNull() | C("stat").isNull(), "skipped").when(C("_e").isNull(), "invalid").otherwise("ok").alias("status"), F.round("_e", 4).alias("implied_es"),
        F.round(F.when(C("_t") == "F", cohens_f(C("_e"))), 4).alias("cohens_f"), F.round(F.when(C("_t") == "chi2", odds_ratio(C("_e"))), 4).alias("odds_ratio"), size.alias("size_class"), F.round(gap, 4).alias("es_gap"), note.alias("agreement"),
    )

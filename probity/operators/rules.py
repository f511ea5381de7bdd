"""Computable rules over papers, surveys, publications and tables. Each gives one row per flagged key or group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.special import norm_cdf
from probity.operators.overlap import paper_mill

C = F.col


def impossible_p(df: DataFrame, p: str) -> DataFrame:
    """Rows whose p is 0, negative, above 1 or exactly .05."""
    x = C(p)
    kind = F.when(x == 0, "zero").when(x < 0, "negative").when(x > 1, "above_one").when(x == 0.05, "exactly_05")
    return df.withColumn("problem", kind).where("problem is not null")


def same_p(df: DataFrame, paper: str, p: str) -> DataFrame:
    return df.groupBy(paper).agg(F.count(p).alias("n"), F.count_distinct(p).alias("n_distinct"), F.min(p).alias("p")).where("n > 1 and n_distinct = 1").select(paper, "n", "p")


def ci_contradicts(df: DataFrame, low: str, high: str, p: str) -> DataFrame:
    """Intervals that cross 0 beside a p below .05."""
    return df.where((C(low) < 0) & (C(high) > 0) & (C(p) < 0.05))


def identical_summaries(df: DataFrame, paper: str, mean: str, sd: str, digits: int = 2) -> DataFrame:
    """Equal mean and deviation in several groups of one paper."""
    return df.groupBy(paper, F.round(mean, digits).alias("mean"), F.round(sd, digits).alias("sd")).agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def absent_bars(df: DataFrame, by: Sequence[str], bar: str) -> DataFrame:
    """Groups of several bars that are all missing, 0 or of one height."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(C(bar), F.lit(0)) == 0).alias("n_absent"), F.count_distinct(bar).alias("n_heights"))
    return out.withColumn("problem", F.when(C("n_absent") == C("n"), "absent").when((C("n_heights") == 1) & (C("n_absent") == 0), "one_height")).where("n > 1 and problem is not null").select(*by, "n", "problem")


def excess_precision(df: DataFrame, raw: str, allowed: int) -> DataFrame:
    return df.withColumn("decimals", F.length(F.regexp_extract(C(raw), r"\.([0-9]+)$", 1)).cast("long")).where(C("decimals") > allowed)


def changing_n(df: DataFrame, paper: str, arm: str, n: str) -> DataFrame:
    return df.groupBy(paper, arm).agg(F.count_distinct(n).alias("n_values"), F.min(n).alias("least"), F.max(n).alias("most")).where("n_values > 1")


def recruitment(df: DataFrame, n: str, days: str, most_per_day: float) -> DataFrame:
    return df.withColumn("per_day", F.round(F.try_divide(C(n), C(days)), 4)).where(F.try_divide(C(n), C(days)) > most_per_day)


def prolific(df: DataFrame, author: str, year: Column, most: int = 20) -> DataFrame:
    return df.groupBy(author, year.alias("year")).agg(F.count("*").alias("n_papers")).where(C("n_papers") > most)


def over_citation(df: DataFrame, paper: str, cited_author: str, least_share: float = 0.3) -> DataFrame:
    """Authors with more than a share of a paper's references."""
    per = df.groupBy(paper, cited_author).agg(F.count("*").alias("n"))
    total = per.groupBy(paper).agg(F.sum("n").alias("total"))
    return per.join(total, paper).where(C("n") > least_share * C("total")).select(paper, cited_author, "n", "total")


def citation_rings(df: DataFrame, source: str, target: str, least: int = 1) -> DataFrame:
    """Pairs that cite each other at least `least` times each way."""
    e = df.groupBy(C(source).alias("a"), C(target).alias("b")).agg(F.count("*").alias("n")).where((C("n") >= least) & (C("a") != C("b")))
    back = e.select(C("a").alias("b"), C("b").alias("a"), C("n").alias("n_back"))
    return e.join(back, ["a", "b"]).where("a < b").select("a", "b", "n", "n_back")


def corresponding_mill(df: DataFrame, corresponding: str, first: str, least: int = 10) -> DataFrame:
    return df.groupBy(corresponding).agg(F.count_distinct(first).alias("n_first_authors"), F.count("*").alias("n_papers")).where(C("n_first_authors") >= least)


def similar_mill(df: DataFrame, corresponding: str, first: str, paper: str, text: str, least: int = 10, similarity: float = 0.15) -> DataFrame:
    """Corresponding authors with many first authors, and how many pairs of their papers are built alike."""
    pairs = paper_mill(df, paper, text, corresponding, least=similarity).groupBy(C(corresponding).alias("_who")).agg(F.count("*").alias("n_similar"))
    mills = corresponding_mill(df, corresponding, first, least)
    return mills.join(pairs, C(corresponding) == C("_who")).drop("_who")


# Phrases that language models leave behind.
PHRASES = ("as an ai language model", "i don't have access to")


def model_phrases(df: DataFrame, text: str, phrases: Sequence[str] = PHRASES) -> DataFrame:
    low = F.lower(C(text))
    return df.withColumn("phrases", F.concat_ws(",", *[F.when(low.contains(p), F.lit(p)) for p in phrases])).where("phrases <> ''")


def straight_lining(df: DataFrame, who: str, answer: str, least: int = 5) -> DataFrame:
    return df.groupBy(who).agg(F.count(answer).alias("n_items"), F.count_distinct(answer).alias("n_answers"), F.min(answer).alias("answer")).where((C("n_items") >= least) & (C("n_answers") == 1)).select(who, "n_items", "answer")


def alternating(df: DataFrame, who: str, item: Sequence[str], answer: str, least: int = 5) -> DataFrame:
    """Respondents whose answers rise and fall by turns, or climb by one step, all the way."""
    w = Window.partitionBy(who).orderBy(*item)
    step = df.select(who, *item, C(answer).alias("x")).withColumn("d", C("x") - F.lag("x").over(w)).withColumn("e", F.lag("d").over(w))
    out = step.groupBy(who).agg(F.count("x").alias("n"), F.count_if((C("d") != 0) & (C("d") == -C("e"))).alias("turns"), F.count_if((C("d") != 0) & (C("d") == C("e"))).alias("climbs"))
    pattern = F.when(C("turns") == C("n") - 2, "alternating").when(C("climbs") == C("n") - 2, "diagonal")
    return out.withColumn("pattern", pattern).where((C("n") >= least) & C("pattern").isNotNull()).select(who, "n", "pattern")


def speeding(df: DataFrame, who: str, seconds: str, by: Sequence[str]) -> DataFrame:
    """Rows faster than a third of their group's median."""
    mid = df.groupBy(*by).agg(F.median(seconds).alias("median"))
    return df.join(mid, list(by)).where(C(seconds) < C("median") / 3).select(*by, who, seconds, "median")


def duplicate_keys(df: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(C("n") >= least)


def cronbach_alpha(df: DataFrame, scale: Sequence[str], who: str, item: str, answer: str) -> DataFrame:
    """Alpha of each scale from long answers, and whether it is above .95."""
    items = df.groupBy(*scale, item).agg(F.var_samp(answer).alias("v")).groupBy(*scale).agg(F.sum("v").alias("sum_v"), F.count("*").alias("k"))
    total = df.groupBy(*scale, who).agg(F.sum(answer).alias("t")).groupBy(*scale).agg(F.var_samp("t").alias("v_total"))
    a = C("k") / (C("k") - 1) * (1 - C("sum_v") / C("v_total"))
    return items.join(total, list(scale)).where("k > 1 and v_total > 0").select(*scale, "k", F.round(a, 4).alias("alpha"), (a > 0.95).alias("too_high"))


def fit(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """R-squared of y on x in each group, and whether it is above .99."""
    return df.groupBy(*by).agg(F.round(F.regr_r2(y, x), 6).alias("r2"), (F.regr_r2(y, x) > 0.99).alias("too_good"))


def weak_instruments(df: DataFrame, f: str, least: float = 10.0) -> DataFrame:
    return df.where(C(f) < least)


def adjusted_p(df: DataFrame, family: Sequence[str], key: str, p: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg p-values within each family, and what stays below .05."""
    ranked = df.select(*family, key, C(p).alias("p")).withColumn("m", F.count("*").over(Window.partitionBy(*family))).withColumn("i", F.row_number().over(Window.partitionBy(*family).orderBy("p", key)))
    asc = Window.partitionBy(*family).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    desc = Window.partitionBy(*family).orderBy(C("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holm = F.least(F.lit(1.0), F.max(C("p") * (C("m") - C("i") + 1)).over(asc))
    bh = F.least(F.lit(1.0), F.min(C("p") * C("m") / C("i")).over(desc))
    return ranked.select(*family, key, "p", F.round(F.least(F.lit(1.0), C("p") * C("m")), 6).alias("bonferroni"), F.round(holm, 6).alias("holm"), F.round(bh, 6).alias("fdr"), ((C("p") < 0.05) & (bh >= 0.05)).alias("lost"))


def yields(df: DataFrame, percent: str, steps: str) -> DataFrame:
    return df.where((C(percent) >= 100) & (C(steps) > 1))


def elemental(df: DataFrame, found: str, calculated: str, tolerance: float = 0.4) -> DataFrame:
    return df.withColumn("off", F.round(C(found) - C(calculated), 4)).where(F.abs(C(found) - C(calculated)) > tolerance)


def correlation_matrix(df: DataFrame, paper: str, i: str, j: str, r: str) -> DataFrame:
    """Entries off the diagonal's 1, outside [-1, 1] or unlike their mirror image."""
    mirror = df.select(C(paper), C(i).alias(j), C(j).alias(i), C(r).alias("mirror"))
    both = df.join(mirror, [paper, i, j], "left")
    problem = F.when((C(i) == C(j)) & (C(r) != 1), "diagonal").when(F.abs(C(r)) > 1, "range").when((C(i) != C(j)) & (C("mirror").isNull() | (F.abs(C("mirror") - C(r)) > 1e-9)), "asymmetric")
    return both.withColumn("problem", problem).where("problem is not null").select(paper, i, j, r, "problem")


def not_positive_definite(df: DataFrame, paper: str, i: str, j: str, r: str) -> DataFrame:
    """Papers whose correlation matrix has a negative eigenvalue; one matrix per group, which the number of its variables bounds. Cells that are not
    given are 0, on the diagonal 1; where a cell and its mirror image differ, their mean counts."""

    def least(pdf):
        import numpy as np
        import pandas as pd

        names = sorted(set(pdf[i]) | set(pdf[j]))
        at = {n: k for k, n in enumerate(names)}
        m = np.full((len(names), len(names)), np.nan)
        for a, b, v in sorted(zip(pdf[i], pdf[j], pdf[r], strict=True)):
            m[at[a], at[b]] = v
        m = np.where(np.isnan(m), m.T, m)
        m = np.where(np.isnan(m), np.eye(len(names)), m)
        m = (m + m.T) / 2
        low = float(np.linalg.eigvalsh(m).min())
        return pd.DataFrame({paper: [pdf[paper].iloc[0]], "least_eigenvalue": [round(low, 6)]}) if low < -1e-8 else pd.DataFrame({paper: [], "least_eigenvalue": []})

    kind = dict(df.dtypes)[paper]
    return df.select(paper, i, j, r).groupBy(paper).applyInPandas(least, f"{paper} {kind}, least_eigenvalue double")


def regressions(df: DataFrame, model: Sequence[str], step: str, beta: str, r2: str) -> DataFrame:
    """Standardised coefficients beyond 1 and steps whose R-squared falls."""
    w = Window.partitionBy(*model).orderBy(step)
    out = df.withColumn("gain", C(r2) - F.lag(r2).over(w))
    return out.withColumn("problem", F.when(F.abs(C(beta)) > 1, "beta").when(C("gain") < 0, "falling_r2")).where("problem is not null")


def power(d: Column, n: Column) -> Column:
    """Power of a two-sample comparison at .05, by the normal approximation."""
    return norm_cdf(F.abs(d) * F.sqrt(n / F.lit(2.0)) - F.lit(1.96))


def underpowered(df: DataFrame, d: str, n: str, p: str) -> DataFrame:
    """Significant results with a power below one half."""
    return df.withColumn("power", F.round(power(C(d).cast("double"), C(n).cast("double")), 6)).where((C("power") < 0.5) & (C(p) < 0.05))


def equal_counts(df: DataFrame, by: Sequence[str], count: str, least: int = 2) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(count).alias("k"), F.min(count).alias("value")).where((C("n") >= least) & (C("k") == 1)).select(*by, "n", "value")


def monotone(df: DataFrame, by: Sequence[str], dose: str, response: str) -> DataFrame:
    """Whether the mean response never falls, or never rises, with the dose."""
    w = Window.partitionBy(*by).orderBy(dose)
    d = df.groupBy(*by, dose).agg(F.avg(response).alias(response)).select(*by, dose, (C(response) - F.lag(response).over(w)).alias("d"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(C("d") < 0).alias("falls"), F.count_if(C("d") > 0).alias("rises")).withColumn("monotone", (C("falls") == 0) | (C("rises") == 0))


def resolution_spread(df: DataFrame, paper: str, width: str, height: str, most: float = 4.0) -> DataFrame:
    size = C(width) * C(height)
    return df.groupBy(paper).agg(F.round(F.try_divide(F.max(size), F.min(size)), 4).alias("spread")).where(C("spread") > most)


def reverse_items(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Groups whose reverse-coded pair does not correlate negatively."""
    return df.groupBy(*by).agg(F.corr(a, b).alias("r")).where("r >= 0").withColumn("r", F.round("r", 4))


def missing_n(df: DataFrame, n: str) -> DataFrame:
    return df.where(C(n).isNull())


def registration(df: DataFrame, registry: DataFrame, trial: str, endpoint: str) -> DataFrame:
    """Trials that are not registered or name another endpoint."""
    known = registry.select(C(trial).alias("r_trial"), C(endpoint).alias("r_endpoint"))
    out = df.join(known, C(trial) == C("r_trial"), "left")
    problem = F.when(C("r_trial").isNull(), "unregistered").when(~C(endpoint).eqNullSafe(C("r_endpoint")), "other_endpoint")
    return out.withColumn("problem", problem).where("problem is not null").drop("r_trial", "r_endpoint")

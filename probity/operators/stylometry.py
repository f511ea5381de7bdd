"""Stylometric features of texts and the likelihood score built on them. Every feature is computed within its row: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.special import let
from probity.functions.text import TOKEN, paragraphs, population_cv, run_lengths, sentences, style_tokens

MIN_CHARS = 100
# The hundred common English words whose share is measured.
FUNCTION_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at "
    "this but his by from they we say her she or an will my one all would there "
    "their what so up out if about who get which go me when make can like time no "
    "just him know take people into year your good some could them see other than then "
    "now look only come its over think also back after use two how our work first "
    "well way even new want because any these give day most us"
).split()


def features(df: DataFrame, text: str, key: Sequence[str]) -> DataFrame:
    """Sentence, vocabulary, bigram and paragraph features of each text, rounded."""
    base = df.select(*key, F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), style_tokens(F.col(text)).alias("w"), sentences(F.col(text)).alias("s"), paragraphs(F.col(text)).alias("p"))
    lengths = lambda a: F.filter(F.transform(a, lambda x: F.regexp_count(F.lower(x), F.lit(TOKEN)).cast("double")), lambda n: n > 0)
    # words and pairs are counted by 64-bit digests: numbers sort faster than words
    digests = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    pairs = F.zip_with(F.slice("h", F.lit(1), F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", F.lit(2), F.size("h")), lambda a, b: F.xxhash64(a, b))
    counted = digests.select(
        *key, "n_chars", F.size("w").cast("long").alias("n_words"), population_cv(lengths(F.col("s"))).alias("sent"), F.size("p").cast("long").alias("n_paragraphs"), population_cv(lengths(F.col("p"))).alias("para"),
        run_lengths(F.col("h")).alias("words"), run_lengths(pairs).alias("pairs"), F.size(F.filter("w", lambda x: x.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
    )
    n = F.col("n_words").cast("double")
    distinct = F.size("words").cast("double")
    total = F.greatest(n - 1, F.lit(1.0))
    entropy = F.when(F.col("n_words") < 2, 0.0).otherwise(F.log2(total) - F.aggregate("pairs", F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double"))) / total)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    once = F.size(F.filter("words", lambda c: c == 1))
    return counted.select(
        *key, "n_chars", "n_words", F.coalesce(F.col("sent.n"), F.lit(0).cast("long")).alias("n_sentences"), F.round(F.coalesce("sent.mean", F.lit(0.0)), 2).alias("sentence_mean"), F.round(F.coalesce("sent.sd", F.lit(0.0)), 2).alias("sentence_sd"),
        F.round(F.coalesce("sent.cv", F.lit(0.0)), 3).alias("sentence_cv"), F.round(ratio(distinct, n), 4).alias("type_token_ratio"), F.round(entropy, 3).alias("bigram_entropy"), F.round(ratio(once, distinct), 4).alias("hapax_ratio"),
        F.round(ratio(100 * F.col("n_function"), n), 2).alias("function_word_pct"), "n_paragraphs", F.when(F.col("n_paragraphs") >= 2, F.round(F.col("para.cv"), 3)).alias("paragraph_cv"),
    )


# Fixed values: (feature, gate, points if the gate holds, whether less scores, ((bound, points) ...)).
SCORE = (
    ("sentence_cv", "sentence_cv > 0", 20, True, ((0.25, 20), (0.35, 10), (0.45, 3))),
    ("type_token_ratio", "n_words > 200", 10, True, ((0.20, 10), (0.30, 5))),
    ("bigram_entropy", "bigram_entropy > 0", 25, True, ((5, 25), (6.5, 18), (7.5, 10), (8.5, 3))),
    ("paragraph_cv", "paragraph_cv > 0 and n_paragraphs >= 3", 15, True, ((0.30, 15), (0.50, 7), (0.70, 2))),
    ("hapax_ratio", "hapax_ratio > 0", 15, False, ((0.65, 15), (0.55, 8), (0.45, 3))),
    ("function_word_pct", "function_word_pct > 0", 15, False, ((50, 15), (45, 8), (40, 3))),
)


def likelihood(feats: DataFrame) -> DataFrame:
    """Adds points, possible points, their percentage and a verdict; texts of fewer than 100 characters are `insufficient`."""
    score, most = F.lit(0), F.lit(0)
    for name, gate, full, below, steps in SCORE:
        points = F.lit(0)
        for bound, value in reversed(steps):
            points = F.when(F.col(name) < F.lit(float(bound)) if below else F.col(name) > F.lit(float(bound)), F.lit(value)).otherwise(points)
        holds = F.coalesce(F.expr(gate), F.lit(False))
        score, most = score + F.when(holds, points).otherwise(F.lit(0)), most + F.when(holds, F.lit(full)).otherwise(F.lit(0))
    out = feats.withColumn("points", score).withColumn("possible", most)
    pct = F.when(F.col("possible") > 0, 100.0 * F.col("points") / F.col("possible")).otherwise(F.lit(0.0))
    verdict = F.when(pct >= 60, "VERY_LIKELY_LLM").when(pct >= 45, "LIKELY_ASSISTED").when(pct >= 30, "POSSIBLY").when(pct >= 15, "MOSTLY_HUMAN").otherwise("STRONGLY_HUMAN")
    ok = F.col("n_chars") >= MIN_CHARS
    return out.withColumn("pct", F.round(pct, 2)).withColumn("status", F.when(ok, "ok").otherwise("insufficient")).withColumn("verdict", F.when(ok, verdict))

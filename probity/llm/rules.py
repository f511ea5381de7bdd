"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

`statistics` gives the columns that rules speak of, `RULES` holds (name, column, least, most), `compile_rules`
turns the table into one column that lists the rules a document fails. A document is kept if it fails
neither a rule nor the base rules.

Repeated windows: each 8-word window has a 64-bit digest; a text with as many distinct digests as windows has no
repeat, others sort (digest, position) and mark the windows equal to a neighbour. Words that
marked windows cover are counted by one pass over their positions, so a text of n words costs O(n log n).

Cases: null, empty and blank texts have 0 words, fail the base rules and are not kept; ratios over
nothing are 0; texts are measured whole; repeated rows are judged alike; other columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import SPACES, let, table, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]+"

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are by this from at or an "
    "der die das und ist von zu mit im nicht den ein eine auf für als auch sich dem es des in "
    "le la les de des et est que qui dans pour par sur une un il elle en du au aux pas "
    "el los las y del que en un una por con para se su al lo como más"
).split()

#: (rule, statistic, least, most): a document fails a rule if the statistic lies outside.
RULES = (
    ("mean_word_length", "mean_word_length", 1.5, 25.0),
    ("symbol_ratio", "symbol_ratio", None, 0.25),
    ("capital_ratio", "capital_ratio", None, 0.5),
    ("exclamation_ratio", "exclamation_ratio", None, 0.4),
    ("stop_word_ratio", "stop_word_ratio", 0.01, None),
    ("alphabetic_ratio", "alphabetic_ratio", 0.5, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", "ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", "bullet_line_ratio", None, 0.95),
)


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that are found twice or more in ws, the first included."""

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))  # [j]: j equals j + 1
            at = let(same, lambda e: F.filter(F.transform(s, lambda x, j: F.when(e[j] | F.when(j > 0, e[F.greatest(j - 1, F.lit(0))]).otherwise(False), x["i"])), lambda i: i.isNotNull()))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last"))
            return F.aggregate(F.array_sort(at), F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, marked))

    grams = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
    hashes = F.transform(ws, lambda x: F.xxhash64(x))
    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(let(hashes, lambda h: let(grams(h), covered))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    longs = lambda c: c.cast("long")
    matched = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    base = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    counted = base.select(
        "doc_id",
        longs(F.size("w")).alias("n_words"),
        longs(F.length(F.array_join("w", ""))).alias("word_chars"),
        longs(matched(SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.struct(
            longs(F.size(x)).alias("n"), longs(F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            longs(F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)\s*$")))).alias("ellipsis"), longs(F.size(F.filter(x, lambda y: y.rlike(r"^\s*[-*•·–]\s")))).alias("bullet"),
        )).alias("l"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        longs(F.size(F.filter("w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))))).alias("n_stop"),
        longs(matched(r"\p{Lu}+")).alias("n_capitals"), longs(matched(r"\p{L}+")).alias("n_letters"), longs(matched("!+")).alias("n_exclamations"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "n_repeat_words", *[
        ratio(a, b).alias(name) for name, a, b in (
            ("mean_word_length", "word_chars", "n_words"), ("symbol_ratio", "n_symbols", "n_words"), ("exclamation_ratio", "n_exclamations", "n_words"),
            ("capital_ratio", "n_capitals", "n_letters"), ("stop_word_ratio", "n_stop", "n_words"), ("alphabetic_ratio", "n_letters", "word_chars"),
            ("dup_line_ratio", "l.dup", "l.n"), ("ellipsis_line_ratio", "l.ellipsis", "l.n"), ("bullet_line_ratio", "l.bullet", "l.n"),
        )
    ])


def compile_rules(rules: Sequence[tuple] = RULES) -> Column:
    """Array of the names of the rules that a row of statistics fails."""

    def fails(column, least, most):
        bounds = ([F.col(column) < F.lit(float(least))] if least is not None else []) + ([F.col(column) > F.lit(float(most))] if most is not None else [])
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]

    return F.filter(F.array(*[F.when(fails(*r[1:]), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: Sequence[tuple] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Statistics, the failed rules, base_failed and kept of each document."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = statistics(docs).withColumn("failed", compile_rules(rules)).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    ratios = {
        "mean_word_length": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "exclamation_ratio": "n_excl / n_words", "capital_ratio": "n_caps / n_letters",
        "stop_word_ratio": "n_stop / n_words", "alphabetic_ratio": "n_letters / word_chars", "dup_line_ratio": "n_dup_lines / n_lines",
        "ellipsis_line_ratio": "n_ellipsis / n_lines", "bullet_line_ratio": "n_bullet / n_lines",
    }
    good = " AND ".join(f"coalesce({ratios[c]}, 0) {op} {float(b)!r}" for _, c, least, most in RULES for op, b in ((">=", least), ("<=", most)) if b is not None)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, list_slice(w, i, i + 7) AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), m AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), r AS (SELECT rid, sum(least(8, coalesce(i - prev, 8)))::BIGINT AS n FROM m GROUP BY rid),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•·–]\s'))) AS n_bullet,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_caps, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl
  FROM d LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {good} AS kept
FROM c
"""


ORACLE = _oracle()

"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

A page's verdict is that of the longest rule that fits; without one, it is `block` if the page's canonical URL
is on the list and `allow` otherwise. Blocks are 64-bit words, one for each four listed URLs; each URL sets
four bits of one word. Pages whose bits are all set go on to the exact join on the canonical URL, which
removes false positives; all others are allowed at once. Only DataFrame functions are used.

The filter's words take two bytes for each listed URL. While they are `BROADCAST_WORDS` or fewer they are packed into arrays of `PAGE_WORDS`
and broadcast, so that no page is shuffled before the filter and only possible hits are shuffled behind it; a longer list is met by shuffling
on the block, with pages without a canonical URL or with a rule kept out of it.

Cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed; equal rules
in length are tried in code-point order; an empty list blocks nothing; repeated pages are judged
alike; other columns of the pages pass through `judge` untouched, and the columns it adds get another name if a page has theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import fresh, lower_ascii, materialise, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: 8 bytes each: 32 MB for 16 million listed URLs.
BROADCAST_WORDS = 1 << 22
PAGE_WORDS = 1 << 12


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, query, fragment and closing slashes; null for a URL without a host."""
    h = host(url)
    return F.when(h != "", F.concat(h, F.rtrim(path(url), F.lit("/"))))


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule `host/path` that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _bits(u: Column) -> Column:
    """Four bits of a 64-bit word, from a digest of their own."""
    h, mask = F.xxhash64(u, F.lit(1)), F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _block(u: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(u), F.lit(n).cast("long"))


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(canonical) -> (block, word)."""
    return listed.groupBy(_block(F.col("canonical"), n_blocks).alias("block")).agg(F.bit_or(_bits(F.col("canonical"))).alias("word"))


def _packed(words: DataFrame) -> DataFrame:
    """(block, word) -> (page, words): PAGE_WORDS words in order of their blocks, 0 where a block has none."""
    page = F.floor(F.col("block") / PAGE_WORDS)
    per = words.groupBy(page.alias("page")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("block") % PAGE_WORDS).cast("int").alias("at"), "word"))).alias("by"))
    return per.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long"))).alias("words"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict to pages. listed: one column `canonical`."""
    rules_by = F.create_map(*[F.lit(x) for r in rules for x in r])
    h, p, r, verdict, u, b, key, word, exact = fresh(pages, "host", "path", "rule", "verdict", "canon", "block", "filter_key", "filter_word", "listed_canon")
    listed = materialise(listed.where("canonical is not null").distinct())
    n_blocks = max(1, -(-listed.count() // 4))
    cols = [F.col(f"`{c}`") for c in pages.columns]
    back = [*cols, F.col(h), F.col(p), F.col(r)]
    seen = pages.select(*cols, host(F.col("url")).alias(h), path(F.col("url")).alias(p), canonical(F.col("url")).alias(u)).withColumn(r, rule_of(F.col(h), F.col(p), rules))
    asks = F.col(r).isNull() & F.col(u).isNotNull()
    words, place = bloom(listed, n_blocks), F.col(b)
    if n_blocks <= BROADCAST_WORDS:
        words, place = F.broadcast(_packed(words).select(F.col("page").alias(key), F.col("words").alias(word))), F.floor(F.col(b) / PAGE_WORDS)
        bits_there = F.get(F.col(word), F.pmod(F.col(b), F.lit(PAGE_WORDS)).cast("int"))
    else:
        words, bits_there = words.select(F.col("block").alias(key), F.col("word").alias(word)), F.col(word)
    asked = seen.where(asks).withColumn(b, _block(F.col(u), n_blocks))
    bits = _bits(F.col(u))
    passed = asked.join(words, place == F.col(key), "left").withColumn(b, F.coalesce(bits_there.bitwiseAND(bits) == bits, F.lit(False)))
    hits = passed.where(F.col(b)).join(listed.select(F.col("canonical").alias(exact)), F.col(u) == F.col(exact), "left")
    of = lambda df, v: df.select(*back, v.alias(verdict))
    ruled = of(seen.where(~asks), F.coalesce(F.element_at(rules_by, F.col(r)), F.lit("allow")))
    clear = of(passed.where(~F.col(b)), F.lit("allow"))
    return ruled.unionByName(clear).unionByName(of(hits, F.when(F.col(exact).isNotNull(), F.lit("block")).otherwise(F.lit("allow"))))


def reported(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs of all pages on hosts whose first label is spam-farm."""
    return pages.where(host(F.col("url")).startswith("spam-farm.")).select(canonical(F.col("url")).alias("canonical"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, reported(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), c AS (
  SELECT *, CASE WHEN host <> '' THEN concat(host, rtrim(path, '/')) END AS canon,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canon IN (SELECT canon FROM c WHERE starts_with(host, 'spam-farm.')) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

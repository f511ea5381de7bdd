"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets ``min(max_epochs * size, level * weight)`` words with one level for all; the level is where
the targets add up to the budget. That is the fixed point of clamping sources at their cap and resharing the
excess by weight. A source's documents are taken ``floor(target / size)`` times each, and the rest of
the target is filled by documents in the order of a seeded digest up to the document nearest to it.

Cases: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own, last in
order; an empty table gives an empty mix; a budget above all caps gives each source its cap; rows with the
same doc_id and source share a digest and are taken alike, rows without a doc_id have the digest of their text; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.llm.common import fresh, materialise, table, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, EPOCHS, SEED = 1.5, 2.0, "mix"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) -> adds target. The table has one row per source, so ordered windows over it stay small.

    With sources by falling room (cap / weight), the level that is feasible for the first k is
    (budget - caps of the rest) / weights of the first k.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    by_room = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last())
    before, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("at", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("nth", F.row_number().over(by_room))
        # the first source that is not full gives the level
        .withColumn("level", F.min(F.when(F.col("at") <= F.col("room"), F.struct("nth", "at"))).over(every)["at"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def _digest(seed: str) -> Column:
    """32 hex digits that order the rows of a source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text"))), F.lit(""))))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: how often the mix takes each document."""
    return _mixed(docs, **how).drop("u")


def _mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """What mix() returns, and u, the digest.

    Within a source the digest's first two hex digits make 256 slices and the next two 256 more, whose sums are
    found by partial aggregation; only documents of the one slice where the target ends are ordered singly.
    """
    sized = materialise(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _digest(seed).alias("u"))
    )
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    def before(df: DataFrame, by: list[str], order: str):
        total = F.sum("size").over(Window.partitionBy("source", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return total - F.sum("size").over(Window.partitionBy("source", *by, order))

    same = lambda a, b: a.eqNullSafe(b)  # noqa: E731  the null source joins itself
    fine = sized.groupBy("source", F.substring("u", 1, 4).alias("s4")).agg(F.sum("size").alias("size")).withColumn("s2", F.substring("s4", 1, 2))
    coarse = fine.groupBy("source", "s2").agg(F.sum("size").alias("size"))
    coarse = coarse.withColumn("before", before(coarse, [], "s2"))
    edge = coarse.alias("c").join(goal.alias("g"), same(F.col("c.source"), F.col("g.source"))).where(
        (F.col("c.before") <= F.col("g.rest")) & (F.col("c.before") + F.col("c.size") > F.col("g.rest"))
    ).select("c.source", F.col("c.s2").alias("e2"), F.col("c.before").alias("b2"), "rest")
    near = fine.alias("f").join(edge.alias("e"), same(F.col("f.source"), F.col("e.source")) & (F.col("s2") == F.col("e2"))).select("f.source", "s4", "size", "b2", "rest")
    near = near.withColumn("before", F.col("b2") + before(near, [], "s4"))
    edge = near.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select("source", F.col("s4").alias("e4"), F.col("before").alias("b4"))
    goal = goal.alias("g").join(edge.alias("e"), same(F.col("g.source"), F.col("e.source")), "left").select("g.*", "e4", "b4")

    at = F.substring("u", 1, 4)
    # a source may hold a third of all rows, so its one row of goal stands 256 times and its documents meet it in as many parts
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    goal = goal.withColumn("part", part)
    rows = sized.alias("d").join(goal.alias("g"), same(F.col("d.source"), F.col("g.source")) & (F.substring("d.u", 1, 2) == F.col("g.part")), "left").select(
        "d.doc_id", "d.source", "d.size", "d.u", "source_size", "target", "whole", "rest", "e4", "b4"
    ).withColumn("last", at.eqNullSafe(F.col("e4")))
    # without an edge slice the target is a whole number of epochs
    sure = rows.where(~F.col("last")).withColumn("extra", F.coalesce(at < F.col("e4"), F.lit(False)))
    last = rows.where("last")
    last = last.withColumn("extra", F.col("b4") + before(last, [], "u") + F.col("size") / 2 <= F.col("rest"))
    times = F.col("whole") + F.col("extra").cast("long")
    return sure.unionByName(last).select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), "u")


def repeat(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mixed rows themselves: each row of docs as often as mix() takes it, numbered by `epoch`."""
    times, mine, theirs, source, epoch = fresh(docs, "mix_times", "mix_digest", "mix_digest2", "mix_source", "epoch")
    # rows of one digest and source are taken alike, so one row of each is enough to join on
    taken = _mixed(docs, seed=seed, **how).where("times > 0").groupBy(F.col("u").alias(theirs), F.col("source").alias(source)).agg(F.max("times").cast("int").alias(times))
    kept = docs.withColumn(mine, _digest(seed)).join(taken, (F.col(mine) == F.col(theirs)) & docs["source"].eqNullSafe(F.col(source)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(epoch))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, concat('text:', md5(text))))) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2e0 AS cap, source_size * 2e0 / weight AS room, sum(source_size) OVER ()::DOUBLE * 1.5e0 AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), g AS (
  SELECT source, source_size, least(cap, (SELECT lev FROM l WHERE lev <= room ORDER BY room, source NULLS LAST LIMIT 1) * weight) AS target FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
), o AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(d.size) OVER (PARTITION BY d.source, u) AS before
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole * source_size < target AND before + size / 2e0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

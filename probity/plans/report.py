"""Findings of all operators in one table, and the overall risk of each paper."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("paper_id", "layer", "dimension", "check_id", "severity", "evidence", "confidence")


def findings(df: DataFrame, paper: Column, layer: int, dimension: str, check_id: str, severity: Column, evidence: Column, confidence: str = "High") -> DataFrame:
    """Rows of one check in the common form; rows without a severity are no findings."""
    out = df.select(paper.cast("string").alias("paper_id"), F.lit(layer).alias("layer"), F.lit(dimension).alias("dimension"), F.lit(check_id).alias("check_id"), severity.alias("severity"), evidence.cast("string").alias("evidence"), F.lit(confidence).alias("confidence"))
    return out.where("severity is not null")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_of(tag: Column) -> Column:
    return F.when(tag.isin("CRIT", "CRITICAL"), "CRITICAL").when(tag == "HIGH", "HIGH").when(tag.isin("MOD", "MODERATE", "MEDIUM"), "MEDIUM").when(tag.isin("LOW", "WARN", "MINOR"), "LOW").when(tag == "INFO", "INFO")


def rollup(found: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Counts by severity and the risk of each paper: CRITICAL for two or more HIGH+ in two or more dimensions, HIGH for two HIGH+ or five
    MEDIUM, MODERATE for one HIGH+ or some MEDIUM, LOW for others, CLEAN for papers without findings."""
    high = F.col("severity").isin("CRITICAL", "HIGH")
    counts = found.groupBy("paper_id").agg(
        F.count("*").alias("n_findings"), F.count_if(high).alias("n_high"), F.count_distinct(F.when(high, F.col("dimension"))).alias("n_high_dimensions"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium")
    )
    if papers is not None:
        counts = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct().join(counts, "paper_id", "left").na.fill(0)
    risk = (
        F.when((F.col("n_high") >= 2) & (F.col("n_high_dimensions") >= 2), "CRITICAL").when((F.col("n_high") >= 2) | (F.col("n_medium") >= 5), "HIGH")
        .when((F.col("n_high") >= 1) | (F.col("n_medium") >= 1), "MODERATE").when(F.col("n_findings") > 0, "LOW").otherwise("CLEAN")
    )
    return counts.withColumn("risk", risk)

"""Streaming variants: digit histograms are sums, so they can be kept up by windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.digits import histogram, last_digit, leading_digit


def digit_windows(stream: DataFrame, ts: str, value: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Leading and last digits of each group and window, and its rows n, with those whose value has no leading digit. Works on streams and on tables alike."""
    x = F.col(value).cast("double")
    if stream.isStreaming:  # watermarks ask for time stamps with a time zone
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = (stream.withWatermark(ts, late) if stream.isStreaming else stream).select(F.col(ts), *by, leading_digit(x).alias("d"), last_digit(x).alias("l"))
    last = [F.count(F.when(F.col("l") == k, 1)).alias(f"last{k}") for k in range(10)]
    out = marked.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"),*histogram(F.col("d"), range(1, 10)), *last)
    return out.select(F.col("window.start").alias("window_start"), *by, "n", *[f"c{k}" for k in range(1, 10)], *[f"last{k}" for k in range(10)])

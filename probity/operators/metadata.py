"""Image metadata: software stamps, time stamps, batch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES = ("DateTimeOriginal", "DateTimeDigitized", "DateTime")
# Fixed values: (part of the software's name, class), first match wins.
SOFTWARE = (("photoshop", "HIGH"), ("gimp", "HIGH"), ("illustrator", "MODERATE"), ("matplotlib", "OK"), ("inkscape", "MODERATE"))


def software_class(exif: Column) -> Column:
    name = F.lower(F.try_element_at(exif, F.lit("Software")))
    out = F.when(name.isNotNull(), "OTHER")
    for part, kind in reversed(SOFTWARE):
        out = F.when(name.contains(part), kind).otherwise(out)
    return out


def timestamps(exif: Column) -> Column:
    return F.map_filter(exif, lambda k, v: k.isin(*TIMES) & v.isNotNull())


def inspect(df: DataFrame, key: Sequence[str], exif: str = "exif") -> DataFrame:
    """One row per image: whether it has metadata (its absence is normal), fields, software class, time stamps, distinct dates."""
    m = F.col(exif)
    dates = F.array_distinct(F.transform(F.map_values(timestamps(m)), lambda t: F.substring_index(t, " ", 1)))
    has = F.coalesce(F.size(m) > 0, F.lit(False))
    return df.select(*key, has.alias("has_exif"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("fields"), F.try_element_at(m, F.lit("Software")).alias("software"), software_class(m).alias("software_class"), F.coalesce(F.size(timestamps(m)), F.lit(0)).cast("long").alias("n_times"), (F.size(dates) > 1).alias("mixed_dates"))


def summary(df: DataFrame, by: Sequence[str], exif: str = "exif", error: str = "error") -> DataFrame:
    """Images with and without metadata and with errors (apart), distinct software, and whether dates differ within the batch."""
    m = F.col(exif)
    # dates of all time stamps of an image; the least and the greatest tell whether they differ
    dates = F.transform(F.map_values(timestamps(m)), lambda t: F.substring_index(t, " ", 1))
    failed = F.col(error).isNotNull()
    has = F.coalesce(F.size(m) > 0, F.lit(False))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_images"), F.count_if(failed).alias("n_errors"), F.count_if(~failed & has).alias("n_with"), F.count_if(~failed & ~has).alias("n_without"),
        F.array_join(F.array_sort(F.collect_set(F.try_element_at(m, F.lit("Software")))), ",").alias("software"), F.coalesce(F.min(F.array_min(dates)) != F.max(F.array_max(dates)), F.lit(False)).alias("mixed_dates"),
    )

"""DOIs: extraction, format, look-up in a bibliographic snapshot, retraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A DOI within a text, and what is cut from its end.
DOI = r"""10\.[0-9]{4,9}/[^\s,;"'<>)]+"""
TRAILING = ".,;:)\"'>"


def valid_doi(doi: Column) -> Column:
    d = F.rtrim(F.trim(doi), F.lit(".,;:"))
    return F.coalesce(d.rlike(r"^10\.[0-9]{4,9}") & (F.instr(d, "/") > 0) & (F.substr(d, F.instr(d, "/") + 1) != ""), F.lit(False))


def extract(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The distinct DOIs of each text."""
    found = df.select(*key, F.explode(F.regexp_extract_all(F.col(text), F.lit(DOI), F.lit(0))).alias("d"))
    return found.select(*key, F.rtrim(F.col("d"), F.lit(TRAILING)).alias("doi")).where(valid_doi(F.col("doi"))).distinct()


def check(refs: DataFrame, works: DataFrame, doi: str = "doi") -> DataFrame:
    """Left join of references to a snapshot of works: status ok, not_found or invalid_format, with title, three authors, journal, year."""
    snap = works.withColumn("w_doi", F.lower("doi")).drop("doi")
    out = refs.join(snap, F.lower(F.trim(F.col(doi))) == F.col("w_doi"), "left")
    status = F.when(~valid_doi(F.col(doi)), "invalid_format").when(F.col("w_doi").isNull(), "not_found").otherwise("ok")
    return out.withColumn("status", status).drop("w_doi")


def work_fields(work: Column) -> list[Column]:
    """Title, first three authors, journal, year of a bibliographic record."""
    authors = F.transform(F.slice(work["author"], 1, 3), lambda a: F.concat_ws(", ", a["family"], a["given"]))
    year = F.coalesce(*[F.try_element_at(F.try_element_at(work[c]["date_parts"], F.lit(1)), F.lit(1)).cast("string") for c in ("published_print", "published_online", "issued")], F.lit("?"))
    return [F.coalesce(F.try_element_at(work["title"], F.lit(1)), F.lit("?")).alias("title"), F.array_join(authors, "; ").alias("authors"), F.coalesce(F.try_element_at(work["container_title"], F.lit(1)), F.lit("?")).alias("journal"), year.alias("year")]


def work_kind(work: Column) -> list[Column]:
    """Publisher and type of a bibliographic record; `?` where one is missing."""
    return [F.coalesce(work[c], F.lit("?")).alias(c) for c in ("publisher", "type")]


def retracted(refs: DataFrame, retractions: DataFrame, doi: str = "doi") -> DataFrame:
    """Adds `retracted`: whether the lower-cased DOI is in the snapshot. Its size decides at run time how it is joined."""
    known = retractions.select(F.lower("doi").alias("r_doi")).distinct()
    return refs.join(known, F.lower(F.trim(F.col(doi))) == F.col("r_doi"), "left").withColumn("retracted", F.col("r_doi").isNotNull()).drop("r_doi")


def summary(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status and the share of references that are missing or malformed."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = checked.groupBy(*by).agg(F.count("*").alias("total"), count("ok").alias("n_ok"), count("not_found").alias("n_not_found"), count("invalid_format").alias("n_invalid"))
    return out.withColumn("failure_rate", F.round((F.col("n_not_found") + F.col("n_invalid")) / F.col("total"), 4))


def listed(df: DataFrame, text: str) -> DataFrame:
    """The distinct DOIs of all texts, sorted."""
    return extract(df, [], text).orderBy("doi")


def update_status(work: Column) -> Column:
    """Struct of status, reason and notice of a record by the updates it names: retracted if one of them is a retraction, not_found for no record."""
    notice = F.try_element_at(F.filter(work["update-to"], lambda u: u["type"] == "retraction"), F.lit(1))
    hit = notice.isNotNull()
    status = F.when(work.isNull(), "not_found").when(hit, "retracted").otherwise("ok")
    return F.struct(status.alias("status"), F.when(hit, F.coalesce(notice["reason"], F.lit("(no reason given)"))).alias("reason"), F.when(hit, F.coalesce(notice["DOI"], F.lit("?"))).alias("notice"))


def from_pages(pages: DataFrame, most: int = 5000, page_size: int = 100) -> DataFrame:
    """Lower-cased DOIs of a listing that was saved page by page: (start, items), items null where a page could not be read.

    Pages count in order of their start up to the first that is missing, unreadable, empty or short, or until `most` items are reached. There is a row for each
    page here, and a listing has most / page_size of them at most, so they are ordered in one task."""
    order = Window.orderBy("start")
    n = F.coalesce(F.size("items"), F.lit(0))
    sized = pages.where(F.col("start") < most).groupBy("start").agg(F.max_by("items", n).alias("items"))
    there = sized.withColumn("there", F.col("start") == (F.row_number().over(order) - 1) * page_size).withColumn("full", F.col("there") & (n >= page_size))
    before = F.coalesce(F.min("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    kept = there.withColumn("before", before).where("there and before")
    return kept.select(F.explode("items").alias("i")).select(F.lower("i.DOI").alias("doi")).where("doi is not null").distinct()

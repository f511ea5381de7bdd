"""Readers and writers for numbers, texts, DOI lists, reported statistics and images."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp,gif,webp}"
REPORTED = "test STRING, n BIGINT, stat DOUBLE, reported_es DOUBLE, df1 DOUBLE, df2 DOUBLE"


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir. Without one, a temporary folder that goes with this
    process, if driver and executors are one process; on a cluster that is an error, for executors do not see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="checkpoints"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder, for what is read several times. Spark removes it with its last reference if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Numbers of one column of CSV files with a header; cells that are no numbers are dropped."""
    x = F.col(f"`{column}`").try_cast("double")
    return spark.read.option("header", True).csv(path).select(x.alias("value")).where("value is not null and not isnan(value)")


def inline_numbers(spark: SparkSession, numbers: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("pos", "raw")).select("pos", F.trim("raw").try_cast("double").alias("value")).where("value is not null")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("double").alias("value")).where("value is not null and not isnan(value)")


def reported_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Reported statistics from CSV; rows without a readable n or stat have status `skipped`."""
    raw = spark.read.option("header", True).csv(path)
    cols = {c.strip().lower(): c for c in raw.columns}
    cell = lambda name, kind: (F.trim(F.col(f"`{cols[name]}`")).try_cast(kind) if name in cols else F.lit(None).cast(kind)).alias(name)
    out = raw.select(*[cell(name, kind) for name, kind in (f.split(" ") for f in REPORTED.lower().split(", "))])
    return out.withColumn("status", F.when(F.col("n").isNull() | F.col("stat").isNull(), "skipped").otherwise("ok"))


def texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """One row per text file, not from subfolders: path, text."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def doi_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("doi")).where("doi <> '' and not startswith(doi, '#')")


def files(spark: SparkSession, path: str, pattern: str = IMAGES, recursive: bool = True) -> DataFrame:
    """path, length, content and the first 16 hex digits of the content's md5, which only tells equal files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select("path", "length", "content", F.substring(F.md5("content"), 1, 16).alias("file_hash"))


def _pieces(df: DataFrame, size: int) -> DataFrame:
    """(path, at, piece) cut into pieces of `size` bytes; the whole goes no further, so the work follows its length."""
    n = F.ceil(F.length("piece") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("piece"), i * size + 1, F.lit(size)))
    return df.where(n > 0).select("path", F.col("at").alias("from"), F.posexplode(cut).alias("k", "piece")).select("path", (F.col("from") + F.col("k").cast("long") * size).alias("at"), "piece")


def byte_bits(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, bit) of files: eight bits of each byte, the highest first. An empty file has none."""
    read = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("at"), F.col("content").alias("piece"))
    # one byte of a long string costs its place in it, so the pieces that bytes are taken from are short
    short = _pieces(_pieces(read, 65_536), 64).select("path", "at", F.hex("piece").alias("hex"))
    byte = F.conv(F.substr("hex", F.col("k") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    each = short.select("path", "at", "hex", F.explode(F.sequence(F.lit(0), (F.length("hex") / 2).cast("int") - 1)).alias("k")).select("path", (F.col("at") + F.col("k")).alias("at"), byte.alias("byte"))
    bits = F.posexplode(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.col("byte"), k).bitwiseAND(F.lit(1))))
    return each.select("path", "at", bits.alias("k", "bit")).select("path", (F.col("at") * 8 + F.col("k")).alias("pos"), "bit")


def retraction_cache(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased DOIs from a JSON document with a `dois` list; none if it is missing or no such document."""
    try:
        raw = spark.read.schema("dois ARRAY<STRING>, updated_at STRING").json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "doi string")
    return raw.select(F.explode("dois").alias("doi")).select(F.lower("doi").alias("doi")).distinct()


def write_cache(df: DataFrame, path: str, metadata: str = "") -> None:
    """The distinct lower-cased DOIs as one JSON document: sorted list, count, metadata and time. A retraction list is small; it is one row here."""
    one = df.agg(F.sort_array(F.collect_set(F.lower("doi"))).alias("dois"))
    one.select("dois", F.size("dois").alias("count"), F.lit(metadata).alias("metadata"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at")).coalesce(1).write.mode("overwrite").json(path)


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(start, items) of the saved pages of a listing, one JSON document each; items are null where a document cannot be read."""
    schema = "message STRUCT<items: ARRAY<STRUCT<DOI: STRING>>, query: STRUCT<`start-index`: BIGINT>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("message.query.start-index").alias("start"), F.col("message.items").alias("items"))


def write_snapshot(df: DataFrame, path: str) -> None:
    df.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(path)

"""Substring dedup by hashing units of text: the earliest ranked occurrence of a unit stays, the rest are removed.

Units are lines and, in lines of several sentences, sentences, of at least `MIN_WORDS` words each. A line or sentence with fewer words makes
units with as many of those after it, and with as many of those before it, as it takes to reach `MIN_WORDS` (blocks of short lines are the
shortest paragraphs), so each piece of a repeated passage or paragraph of `MIN_WORDS` words lies in a unit of it.
A unit is normalised (lower case, single spaces) and gets a 128-bit digest; digests are grouped over all documents
and the occurrence with the least (doc_id, digest of the text, offset) is kept. Blocks catch the short lines
of a passage that are too common to be judged alone; sentences catch passages that start or end within a line.
Removed spans keep their offsets, in code points of the original text. Units overlap, so what belongs to a kept occurrence of a repeated unit is never
removed: each repeated unit stays whole in one place.

Units are cut once and checkpointed. They are counted by partial aggregation, so a unit that a third of all documents hold is one row per task; only
occurrences of units that occur again go on. Units with more than a 10,000th of all occurrences, which can be 10,000 at most, are broadcast to
theirs, so that no occurrence of a hot unit is shuffled by its digest.

Cases: null and blank texts have no units; rows of one doc_id and text rank alike and are treated alike, so repeated rows keep the same
spans; rows of one doc_id with other texts are told apart by the text's digest; a null doc_id ranks first; one
very long line is one unit; other columns pass through `remove` untouched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import fresh, materialise, table

#: Words of a unit. Shorter lines are mostly common phrases of texts that are not copies: with 8, one text in four that shares no passage loses a line.
MIN_WORDS = 16
#: Units that occur in more than one of this many occurrences are hot: so many at most, whatever the input, and no task gets all rows of one.
HOT_UNITS = 10_000
_ONE, _TWO = struct.Struct("<q"), struct.Struct("<qq")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?](?!\s|$)[^.!?]*)*(?:[.!?]+|$)")


def _blocks(pieces: list[tuple[list[str], int, int, int]], min_words: int) -> Iterator[tuple[int, int]]:
    """[first, last) of the least runs of pieces that reach min_words from each shorter piece on, and up to it."""
    total = [0, *accumulate(len(p[0]) for p in pieces)]
    for i, p in enumerate(pieces):
        if len(p[0]) < min_words:
            last, first = bisect_left(total, total[i] + min_words), bisect_right(total, total[i + 1] - min_words) - 1
            if last < len(total):
                yield i, last
            if first >= 0:
                yield first, i + 1


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(digest as two numbers, start, end) of each unit of a text."""

    def digest(words: list[str]) -> tuple[int, int]:
        return _TWO.unpack(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())

    lines, sentences, at = [], [], 0  # (words, start, end, number of the line)
    for n, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            lines.append((words, at + len(line) - len(line.lstrip()), at + len(line.rstrip()), n))
            for m in _SENTENCE.finditer(line):
                piece = m[0]
                ws = piece.lower().split()
                if ws:
                    sentences.append((ws, at + m.start() + len(piece) - len(piece.lstrip()), at + m.end() - (len(piece) - len(piece.rstrip())), n))
        at += len(line) + 1
    seen = set()
    for pieces in (lines, sentences) if len(sentences) > len(lines) else (lines,):
        whole = [(i, i + 1) for i, p in enumerate(pieces) if len(p[0]) >= min_words]
        for first, last in (*whole, *_blocks(pieces, min_words)):
            span = pieces[first][1], pieces[last - 1][2]
            if span not in seen:
                seen.add(span)
                words = list(pieces[first][0])
                for before, p in zip(pieces[first : last - 1], pieces[first + 1 : last], strict=True):
                    words += p[0] if p[3] == before[3] else ["\n", *p[0]]
                yield digest(words), *span


_OCCURRENCE = "d1 long, d2 long, doc_id long, row long, span long"


def _row_digest(text: str | bytes) -> int:
    return _ONE.unpack(hashlib.blake2b(text.encode("utf-8") if isinstance(text, str) else text, digest_size=8).digest())[0]


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each unit: its digest, the document, the digest of the whole text, start and end, each in 32 bits of `span`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "doc_id", "row", "span"]
        batch_of = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
        for batch in batches:
            cols = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text, doc_id = text.as_py(), doc_id.as_py()
                if not text:
                    continue
                row = _row_digest(text)
                for (d1, d2), start, end in units(text, min_words):
                    for c, v in zip(cols, (d1, d2, doc_id, row, start << 32 | end), strict=True):
                        c.append(v)
                if len(cols[0]) > 50_000:  # long batches leave in parts
                    yield batch_of(cols)
                    cols = [[], [], [], [], []]
            yield batch_of(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OCCURRENCE)


def _start(span: Column) -> Column:
    return F.shiftright(span, 32)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each occurrence of a unit that occurs again: doc_id, row, start, end, whether it is kept, and where the kept one is (keep_doc_id, keep_start)."""
    found = materialise(occurrences(docs, min_words))
    hot = max(1, found.count() // HOT_UNITS)
    # half of the digest tells the few units that may occur again; only they are compared in full
    seen = found.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(_met(found, seen, ["d1"], hot, "left_semi"))
    rank = F.struct("doc_id", "row", "span")  # repeated rows rank alike
    first = again.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    return _met(again, first, ["d1", "d2"], hot, "inner").select(
        "doc_id", "row", _start(F.col("span")).alias("start"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("end"), rank.eqNullSafe(F.col("first")).alias("kept"),
        F.col("first.doc_id").alias("keep_doc_id"), _start(F.col("first.span")).alias("keep_start"),
    )


def _met(rows: DataFrame, counted: DataFrame, keys: list[str], hot: int, how: str) -> DataFrame:
    """rows joined with their keys' counts: keys of more than `hot` rows, of which there are HOT_UNITS at most, by broadcast, the others by a shuffle."""
    many = F.broadcast(counted.where(F.col("n") > hot))
    few = rows.join(many.select(keys), keys, "left_anti").join(counted.where(F.col("n") <= hot), keys, how)
    return rows.join(many, keys, how).unionByName(few)


def _outside(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, merged, without what lies in the kept ones; both sorted."""
    out, k = [], 0
    for start, end in _merged(spans):
        while k < len(kept) and kept[k][1] <= start:
            k += 1
        i = k
        while start < end:
            if i == len(kept) or kept[i][0] >= end:
                out.append((start, end))
                break
            if kept[i][0] > start:
                out.append((start, kept[i][0]))
            start, i = max(start, kept[i][1]), i + 1
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and out[-1][1] >= start:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each text that loses something: doc_id, row, and its removed spans, merged, in order."""
    span = lambda kept: F.array_sort(F.collect_set(F.when(F.col("kept") == F.lit(kept), F.struct("start", "end"))))
    # spans of one text are as many as its units
    per = repeats(docs, min_words).groupBy("doc_id", "row").agg(span(False).alias("gone"), span(True).alias("kept")).where(F.size("gone") > 0)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda column: [[(x["start"], x["end"]) for x in xs] for xs in column.to_pylist()]
        for batch in batches:
            left = [_outside(gone, _merged(kept)) for gone, kept in zip(pairs(batch.column("gone")), pairs(batch.column("kept")), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in xs] for xs in left], kind)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), spans], ["doc_id", "row", "spans"])
            yield out.filter(pa.array([bool(xs) for xs in left], pa.bool_()))

    return per.mapInArrow(run, "doc_id long, row long, spans array<struct<start:long,end:long>>")


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the removed spans cut out of the text and listed, with their offsets in the original, in `removed`."""
    row, at, removed, cut = fresh(docs, "row_digest", "span_doc_id", "removed", "span_row")

    def with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_row_digest(t.as_py()) if t.is_valid else None for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.int64())], [*batch.schema.names, row])

    keyed = docs.mapInArrow(with_row, f"{docs._jdf.schema().toDDL()}, `{row}` long")
    spans = removed_spans(docs, min_words).select(F.col("doc_id").alias(at), F.col("row").alias(cut), F.col("spans").alias(removed))
    both = keyed.join(spans, keyed["doc_id"].cast("long").eqNullSafe(F.col(at)) & (F.col(row) == F.col(cut)), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.col(removed), lambda x: x["end"]))
    starts = F.concat(F.transform(F.col(removed), lambda x: x["start"]), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept)
    return both.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(removed), F.array().cast("array<struct<start:long,end:long>>")).alias(removed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = removed_spans(table(spark, sf_dir, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), length.alias("removed_chars"), listed.alias("removed_spans"))


ORACLE = None

"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a window of tokens and ignore the others, so a window still hashes alike when tokens at
ignored positions were replaced. The benchmark's hashes form a sorted table; each document's hashes, one for each mask
and position, are joined to it. A hit fixes a diagonal between document and item: along it the best-scoring stretch (+1 for an equal token,
-2 for another) is found, and the item's tokens that such stretches cover, over all diagonals, are counted. A
document holds an item if that covers at least half of the item's tokens and `LEAST` of them, or `ENOUGH`.

Items shorter than the longest mask also get masks of their own length, each of which ignores one position, and are compared along whole diagonals: of an
item of `TOLERANT` tokens or more one may be replaced, whatever its place, those of fewer tokens are looked for as they are. No item is
too short to be looked for: an item of one token is found in each text that has the token; `left_out` names those without any token.

Repeats stay cheap: a window that an item repeats stands in the table once, at its first place, and of the diagonals of an item whose stretches of the document are
equal only the first is compared. So a phrase that a text repeats any number of times costs one comparison for each item that has it.

The benchmark is read in blocks of at most `BLOCK_CHARS` characters, each of which meets all documents; what goes to
the workers is bounded by that size, and with several blocks each one's results are checkpointed and it is released before the next. Documents are never shuffled.

Tokens are lower-cased words without anything but letters and digits; words without any are skipped; they end at blanks, so in a script without
blanks a whole item may be one.

Cases: null and empty texts hold nothing; texts are read whole; of repeated items each is reported; rows of one doc_id are judged
each for itself; an empty benchmark finds nothing and keeps all; other columns pass through `clean` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import fresh, materialise, table

MASKS = ("11101001011", "1101100011001", "110010111", "11111101")
LEAST, ENOUGH, TOLERANT, SHARE = 8, 25, 5, 0.5
#: Diagonals of one item from which on equal stretches are looked for.
MANY = 4
BLOCK_CHARS = 4_000_000
_SIGNS = re.compile(r"[\W_]+")
_BITS = 20


class TokenHashes(dict):
    """64-bit digests of normalised words by their bytes; 0 for words without letters or digits. Bounded by starting anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = _SIGNS.sub("", word.decode("utf-8").lower())
        self[word] = h = int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little") | 1 if plain else 0
        return h

    def of(self, text: bytes) -> np.ndarray:
        ws = text.split()
        h = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        return h[h != 0] if len(h) and not h.all() else h


def _factors(n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"factor {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


def _needed(m: int) -> int:
    """Tokens of an item of m that a document must hold."""
    return m if m < TOLERANT else min(ENOUGH, max(min(LEAST, m - 1), -(-m // 2)))


class _Stretches:
    """Digests of any stretch of a sequence of tokens: sums of tokens times powers of an odd number, shifted to place 0."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, tokens: np.ndarray):
        powers = lambda base: np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(tokens), base, np.uint64), dtype=np.uint64)))
        self.total = np.concatenate(([np.uint64(0)], np.cumsum(tokens * powers(self.BASE)[:-1], dtype=np.uint64)))
        self.back = powers(self.INVERSE)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.total[last] - self.total[first]) * self.back[first]


class Matcher:
    """A block of benchmark items, ready to be looked for in documents. items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        hashes = TokenHashes()
        self.ids, self.tokens = [], []
        for item_id, text in items:
            t = hashes.of((text or "").encode("utf-8"))
            if len(t):
                self.ids.append(item_id)
                self.tokens.append(t)
        self.span = max(map(len, masks))
        # (mask, whether it is for items of its own length only)
        wanted = [(m, False) for m in masks]
        for n in sorted({len(t) for t in self.tokens if len(t) < self.span}):
            wanted += [("1" * k + "0" + "1" * (n - 1 - k), True) for k in range(n)] if n >= TOLERANT else [("1" * n, True)]
        self.seeds = []
        for k, (mask, own) in enumerate(wanted):
            offsets, factors = np.flatnonzero([c == "1" for c in mask]), _factors(self.span + 1)
            seed = (len(mask), offsets, factors[: len(offsets)] + np.uint64(2 * k))
            rows = []
            for i, t in enumerate(self.tokens):
                if len(t) == len(mask) if own else len(t) >= len(mask):
                    h, places = np.unique(self._hashes(t, seed), return_index=True)  # a repeated window's first place
                    rows.append((h, np.full(len(h), i), places))
            if not rows:
                continue
            h, item, at = (np.concatenate([r[c] for r in rows]) for c in range(3))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seeds.append((seed, h[order], item[order].astype(np.int64), at[order].astype(np.int64), seen))

    @staticmethod
    def _hashes(tokens: np.ndarray, seed) -> np.ndarray:
        span, offsets, factors = seed
        n = len(tokens) - span + 1
        out = np.zeros(n, np.uint64)
        for o, f in zip(offsets, factors, strict=True):
            out += tokens[o : o + n] * f
        return out ^ (out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)

    def _diagonals(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of all hits, by item and then by diagonal."""
        items, diagonals = [], []
        for seed, table_, owner, places, seen in self.seeds:
            if len(tokens) < seed[0]:
                continue
            h = self._hashes(tokens, seed)
            at = np.flatnonzero(seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(table_, h[at], "left"), np.searchsorted(table_, h[at], "right")
            n = high - low
            if not n.any():
                continue
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            items.append(owner[rows])
            diagonals.append(np.repeat(at, n) - places[rows])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(diagonals)]), axis=1)
        return both[0], both[1]

    def find(self, tokens: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, covered tokens, tokens of the item, first and last token of the document's stretches, of equal ones the first) of each item that the document holds."""
        owners, diagonals = self._diagonals(tokens)
        out, stretches = [], None
        edges = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1], [True]))) if len(owners) else [0]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            i, ds = int(owners[x]), diagonals[x:y]
            item = self.tokens[i]
            m = len(item)
            if len(ds) >= MANY:
                stretches = stretches or _Stretches(tokens)
                a, b = np.maximum(0, -ds), np.minimum(m, len(tokens) - ds)
                _, one = np.unique(np.stack([a.astype(np.uint64), b.astype(np.uint64), stretches.of(a + ds, b + ds)]), axis=1, return_index=True)
                ds = ds[np.sort(one)]
            covered, most, reach = np.zeros(m, bool), 0, None
            for d in ds.tolist():
                a, b = max(0, -d), min(m, len(tokens) - d)
                same = item[a:b] == tokens[a + d : b + d]
                first, last = _best_stretch(same)
                if m < self.span and (n := int(same.sum())) >= _needed(m):
                    most, first, last = max(most, n), 0, len(same)
                elif same[first:last].sum() < min(LEAST - 2, m):
                    continue
                covered[a + first : a + last] |= same[first:last]
                reach = (a + first + d, a + last + d) if reach is None else (min(reach[0], a + first + d), max(reach[1], a + last + d))
            n = max(most, int(covered.sum()))
            if reach is not None and n >= _needed(m):
                out.append((i, n, m, *reach))
        return out


def _best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[first, last) of the stretch with the greatest sum of +1 for equal and -2 for other tokens."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    gain = total - np.minimum.accumulate(total)
    last = int(np.argmax(gain))
    first = int(np.argmin(total[: last + 1]))
    return first, last


def blocks(benchmark: DataFrame, most_chars: int = BLOCK_CHARS) -> Iterator[Matcher]:
    """Matchers for the benchmark, each for at most about most_chars characters of it."""
    rows, n = _items(benchmark, most_chars)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Matcher([tuple(r) for r in part.collect()])


def _items(benchmark: DataFrame, most_chars: int) -> tuple[DataFrame, int]:
    rows = benchmark.select("item_id", "text").where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, -(-chars // most_chars)


def left_out(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens) of the items that cannot be looked for, because they have no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            found = [(i, n) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if (n := len(hashes.of((t or "").encode("utf-8")))) == 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["item_id", "n_tokens"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, n_tokens long")


def _met(docs: DataFrame, matcher: Matcher) -> tuple[DataFrame, object]:
    """(row_key, row_key2, doc_id, ...) for each document and item of one block that it holds, and the broadcast that the plan needs."""
    schema = "doc_id long, key long, key2 long, item_id long, n_matched long, n_item long, first_token long, last_token long"
    names = [c.split()[0] for c in schema.split(", ")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, TokenHashes()
        for batch in batches:
            rows = []
            for doc_id, key, key2, text in zip(*(batch.column(c) for c in range(3)), batch.column("text").cast(pa.binary()), strict=True):
                if (raw := text.as_py()) and (found := m.find(hashes.of(raw))):
                    rows += [(doc_id.as_py(), key.as_py(), key2.as_py(), m.ids[i], *rest) for i, *rest in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    return source.mapInArrow(run, schema), shared


def _all_met(docs: DataFrame, benchmark: DataFrame, most_chars: int) -> DataFrame | None:
    """_met over all blocks: one is left to the plan, the results of several are checkpointed one after the other."""
    _, n = _items(benchmark, most_chars)
    out = None
    for matcher in blocks(benchmark, most_chars):
        found, shared = _met(docs, matcher)
        if n > 1:
            found = materialise(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, matched and all tokens of the item, first and last token place in the document."""
    out = _all_met(docs, benchmark, most_chars)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_matched long, n_item long, first_token long, last_token long")
    return out.drop("key", "key2")


def clean(docs: DataFrame, benchmark: DataFrame, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    _, n = _items(benchmark, most_chars)
    if n == 0:
        return docs
    if n > 1:  # the texts that hold an item of any block, by two digests of theirs
        k1, k2 = fresh(docs, "text_key", "text_key2")
        held = _all_met(docs, benchmark, most_chars).select(F.col("key").alias(k1), F.col("key2").alias(k2)).distinct()
        keyed = docs.withColumn(k1, F.xxhash64("text")).withColumn(k2, F.xxhash64(F.lit(1), "text"))
        return keyed.join(held, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    (matcher,) = blocks(benchmark, most_chars)
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, TokenHashes()
        for batch in batches:
            keep = [not (raw := text.as_py()) or not m.find(hashes.of(raw)) for text in batch.column("text").cast(pa.binary())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = None

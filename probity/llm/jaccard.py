"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Documents become sets of hashed word n-grams. All sets follow one global order of tokens: rare ones by their
hash, then frequent ones by frequency. Two sets whose similarity reaches the threshold share at least l tokens
among the first ``n - ceil(threshold * n) + l`` of each; each document takes the l that its own estimate of
posting and verification costs favours: prefixes grow by one token for each match more that they ask for. Candidates are verified on the whole texts, so no link is lost and none is false
(up to 64-bit hash collisions within a pair).

Work stays near-linear in large groups:

* equal sets are one representative;
* sets that meet in a posting list of `HOT` or more are crowded. Over their whole sets, tokens that no other crowded set has are counted; the
  overlap of two crowded sets is at most what remains, which bounds the sizes a set can be linked with (`room`), and a set
  without room for any size leaves the long lists;
* a star round links the sets of a token's postings to the most central one (that with the fewest tokens of its own);
  what is verified there becomes preliminary components, and postings are then joined by component: members of one
  component are never paired with each other;
* two crowded sets that are close to the same centre, their hub, are judged by the tokens in which they differ from it (lacked or added): the overlap of
  the two is that of their differences, plus the hub less all that either lacks. So their sizes say how many differences they must share,
  and pairs that must share any meet in lists of differences, rarest first and only while enough of both remain, not in lists of the hub's tokens;
* what remains, pairs of different components that share a token and have room for each other, is joined in full, and a pair is verified if it
  shares as many prefix tokens as its two sizes ask for.

Frequencies are counted over all documents, for the lowest part of the hash range, which prefixes are made of;
`frequent` keeps the most frequent tokens, at most `MOST_FREQUENT`, and the choice affects only the order, never the result.

Cases: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words than an n-gram
is one n-gram; repeated rows and equal texts are linked; rows of one doc_id with several texts are judged each for itself;
a null doc_id never becomes a component_id unless it stands alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.llm.common import empty_like, materialise, table
from probity.llm.components import components

#: Words of an n-gram, and the threshold as a fraction: intersection / union >= NUM / DEN.
K, NUM, DEN = 3, 90, 100
MOST_FREQUENT = 1 << 17
LEAST_FREQUENT = 16
#: Rows up to which a list of ids is broadcast; beyond, it is joined by shuffling.
BROADCAST_ROWS = 500_000
MAX_MATCH, VERIFY_COST = 6, 8.0
#: Sets in a posting list of this length or more are crowded.
HOT = 24
#: Partners that one set is compared with in one task; sets with more are dealt out. If there are very many pairs, one in HOT_SETS of them instead,
#: so that HOT_SETS sets at most are dealt out, which is what the broadcast lists of them are bounded by.
PARTNERS, HOT_SETS = 64, 10_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_MULTIPLIERS = [int.from_bytes(hashlib.blake2b(f"word {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(64)]


def shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit digests of the k-word n-grams of a text, A-Z lower-cased."""
    ws = (text or b"").lower().split()  # bytes: only A-Z change, only U+0020 and U+0009 to U+000D split
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = max(len(h) - k + 1, 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(len(h), k)):
        out = out * np.uint64(_MULTIPLIERS[0]) + (h[i : i + n] ^ np.uint64(_MULTIPLIERS[1 + i]))
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MULTIPLIERS[7])
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked to."""
    return -(-num * n // den)


class Frequent:
    """Frequencies of frequent tokens, sorted by token."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def of(self, s: np.ndarray) -> np.ndarray:
        """Frequency of each token, 0 for those that are not frequent."""
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)


def prefix(s: np.ndarray, frequent: Frequent, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """(prefix, frequency and hash of its last token) of a set; it is as long as the number of matches that it asks for makes it.

    The hash is shifted so that signed numbers keep the order."""
    counts = frequent.of(s)
    order = np.lexsort((s, counts))
    least = _least_overlap(len(s), num, den)
    cost = np.cumsum(np.maximum(counts[order], 1))
    base = len(s) - least
    best = min(range(1, min(MAX_MATCH, least) + 1), key=lambda m: cost[base + m - 1] * (1 + VERIFY_COST / m))
    taken = order[: base + best]
    return s[taken], int(counts[taken[-1]]), int(s[taken[-1]]) - 2**63


def _band(num: int, den: int) -> float:
    """Share of the hash range whose tokens are counted: about twice what prefixes take."""
    return min(1.0, 2 * (1 - num / den) + 0.05)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def frequent_tokens(docs: DataFrame, k: int, num: int, den: int) -> Frequent:
    """The tokens in most documents, counted over all documents. A histogram by powers of two finds the least frequency of which at
    most MOST_FREQUENT tokens are as frequent, so what reaches the driver is bounded."""
    top = np.uint64(min(int(_band(num, den) * 2.0**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts, n = [], 0
            for text in batch.column("text").cast(pa.binary()):
                s = shingles(text.as_py(), k, hashes)
                parts.append(s[: np.searchsorted(s, top)])
                n += len(parts[-1])
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["token"])
                    parts, n = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["token"])

    counted = docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    counted = materialise(counted)
    by_power = {r["p"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()}
    least, total = None, 0
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > MOST_FREQUENT:
            break
        least = p
    rows = counted.where(F.col("n") >= F.lit(2**least)).toPandas() if least is not None else None
    if rows is None:
        return Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    return Frequent(rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n (size of the set), digest of the set, prefix and the order of its last token, of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k, num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, frequent = WordHashes(), shared.value
        names = ["doc_id", "n", "digest", "prefix", "last_n", "last_h"]
        for batch in batches:
            rows, ids = [], batch.column("doc_id")
            for text in batch.column("text").cast(pa.binary()):
                s = shingles(text.as_py(), k, hashes)
                rows.append((len(s), _digest(s), *prefix(s, frequent, num, den)) if len(s) else (0, *[None] * 4))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            tokens = pa.array([None if t is None else t.view(np.int64) for t in cols[2]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), tokens, *[pa.array(c, pa.int64()) for c in cols[3:]]], names)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>, last_n long, last_h long")


def _own_texts(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(id, text) of the representatives (id, doc_id, digest) asked for; repeated rows give a text more than once."""
    listed = asked.select(F.col("doc_id").alias("w_doc_id"), "id", "digest")
    few = asked.count() <= BROADCAST_ROWS
    texts = _texts(docs)
    met = texts.join(F.broadcast(listed) if few else listed, texts["doc_id"].eqNullSafe(F.col("w_doc_id"))).select("id", "digest", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()  # a doc_id may have other texts too
        for batch in batches:
            keep = [_digest(shingles(t.as_py(), k, hashes)) == d.as_py() for t, d in zip(batch.column("text").cast(pa.binary()), batch.column("digest"), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["id", "text"])

    return met.mapInArrow(same, "id long, text string")


def _own_tokens(docs: DataFrame, crowded: DataFrame, k: int) -> DataFrame:
    """(id, own) of crowded sets: how many of a set's tokens no other crowded set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, parts, n = [], [], 0
            for i, text in zip(batch.column("id"), batch.column("text").cast(pa.binary()), strict=True):
                parts.append(shingles(text.as_py(), k, hashes).view(np.int64))
                ids.append(np.full(len(parts[-1]), i.as_py(), np.int64))
                n += len(parts[-1])
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(parts))], ["id", "token"])
                    ids, parts, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(parts))], ["id", "token"])

    token = _own_texts(docs, crowded, k).mapInArrow(run, "id long, token long")
    alone = token.groupBy("token").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return alone.groupBy("id").agg(F.count("*").alias("own"))


def _compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, num: int, den: int, least: int) -> DataFrame:
    """(a, b, linked, both, differs) of the pairs of set ids whose similarity is least / den or more, found from the whole texts of their representatives:
    whether they reach the threshold, the size of the intersection, and the tokens that only one of them has."""
    pairs = materialise(pairs)
    ends = [pairs.select(F.col(c).alias("id"), F.lit(c == "a").alias("as_a"), F.lit(c == "b").alias("as_b")) for c in ("a", "b")]
    asked = ends[0].unionByName(ends[1]).groupBy("id").agg(F.max("as_a").alias("as_a"), F.max("as_b").alias("as_b"))
    asked = materialise(asked.join(sets.select("id", "doc_id", "digest"), "id"))
    if asked.isEmpty():
        return empty_like(docs.sparkSession, "a long, b long, linked boolean, both long, differs array<long>")
    texts = _own_texts(docs, asked, k).groupBy("id").agg(F.first("text").alias("text"))
    # a set may have any number of partners on either side: they meet its text in parts
    limit = max(PARTNERS, pairs.count() // HOT_SETS)
    dealt = {c: pairs.groupBy(c).agg(F.ceil(F.count("*") / limit).cast("int").alias(f"parts_{c}")).where(f"parts_{c} > 1") for c in ("a", "b")}
    part = lambda c, other: F.pmod(F.xxhash64(other), F.coalesce(f"parts_{c}", F.lit(1))).cast("int").alias(f"part_{c}")
    for c, few in dealt.items():
        pairs = pairs.join(F.broadcast(few), c, "left")
    pairs = pairs.select("a", "b", part("a", "b"), part("b", "a"))

    def side(c: str) -> DataFrame:
        held = texts.join(asked.where(f"as_{c}").select("id"), "id", "left_semi").select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        every = F.sequence(F.lit(0), F.coalesce(f"parts_{c}", F.lit(1)) - 1)
        return held.join(F.broadcast(dealt[c]), c, "left").select(c, f"text_{c}", F.explode(every).alias(f"part_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s = WordHashes(), None, None
        for batch in batches:
            keep, rows = [], []
            for a, ta, tb in zip(batch.column("a"), batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary()), strict=True):
                if a.as_py() != last:
                    last, s = a.as_py(), shingles(ta.as_py(), k, hashes)
                t = shingles(tb.as_py(), k, hashes)
                common = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s
                both = int(np.count_nonzero(common))
                either = len(s) + len(t) - both
                keep.append(den * both >= least * either)
                if keep[-1]:
                    rows.append((den * both >= num * either, both, np.setxor1d(s, t, assume_unique=True).view(np.int64)))
            close = batch.filter(pa.array(keep, pa.bool_()))
            linked, both, differs = list(zip(*rows, strict=True)) or [[]] * 3
            found = [pa.array(linked, pa.bool_()), pa.array(both, pa.int64()), pa.array(differs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([close.column("a"), close.column("b"), *found], ["a", "b", "linked", "both", "differs"])

    met = pairs.join(side("b"), ["b", "part_b"]).join(side("a"), ["a", "part_a"]).select("a", "b", "text_a", "text_b")
    return materialise(met.mapInArrow(compare, "a long, b long, linked boolean, both long, differs array<long>"))


def _sizes_fit(n: str, m: str, num: int, den: int):
    return F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)


def _overlap(n: str, m: str, num: int, den: int):
    """Tokens that linked sets of these sizes share at least."""
    return F.ceil(F.lit(num) * (F.col(n) + F.col(m)) / (num + den))


def _fits(n: str, room: str, crowded: str, m: str, room2: str, crowded2: str, num: int, den: int):
    """Whether sizes, and the room of two crowded sets, allow a link."""
    free = ~(F.col(crowded) & F.col(crowded2))
    return _sizes_fit(n, m, num, den) & (free | ((F.col(m) <= F.col(room)) & (F.col(n) <= F.col(room2))))


def _hubs(compared: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, hub, hub_n, lack, differs) of the crowded sets that are close to a crowded centre: the most central one, its size, how many of its tokens
    the set lacks, and the tokens that only one of the two has."""
    crowd = facts.where("crowded")
    centre = crowd.select(F.col("id").alias("a"), F.col("own").alias("own_a"), F.col("n").alias("n_a"))
    met = compared.join(centre, "a").join(crowd.select(F.col("id").alias("b")), "b")
    hub = F.struct(F.col("a").alias("hub"), F.col("n_a").alias("hub_n"), (F.col("n_a") - F.col("both")).alias("lack"), "differs")
    met = materialise(met.groupBy(F.col("b").alias("id")).agg(F.min_by(hub, F.struct("own_a", "a")).alias("h")).select("id", "h.*"))
    # a hub that has none lacks nothing of itself
    top = met.select("hub", "hub_n").distinct().join(met.select(F.col("id").alias("hub")), "hub", "left_anti")
    return met.unionByName(top.select(F.col("hub").alias("id"), "hub", "hub_n", F.lit(0).cast("long").alias("lack"), F.array().cast("array<long>").alias("differs")))


def _differences(hubs: DataFrame) -> DataFrame:
    """(id, top, token, left) of the tokens in which a set and another one of its hub differ from it; left: how many of the set's are at
    least as frequent among the differences, itself included. If two sets share m of them, m are left in both where the first is shared."""
    posted = hubs.select("id", F.col("hub").alias("top"), F.explode("differs").alias("token"))
    shared = posted.groupBy("top", "token").agg(F.count("*").alias("c")).where("c > 1")
    falling = Window.partitionBy("id").orderBy(F.desc("c"), F.desc("token"))
    return posted.join(shared, ["top", "token"]).withColumn("left", F.row_number().over(falling)).drop("c")


def _meetings(mine: DataFrame, key: list[str], num: int, den: int) -> DataFrame:
    """Pairs of sets of different components that share a key and fit each other, one row for each key: (a, b, asks, needed).

    asks: prefix tokens that a linked pair shares at least. needed: differences from their hub that both share at least if linked, if they have one hub,
    else 0 or less; pairs that need more than are left of either are left out."""
    facts = ["id", "n", "room", "crowded", "end", "len", "hub", "hub_n", "lack", "left"]

    def needed(n, m, lack, lack2, hub, hub2, hub_n):
        return F.when(F.col(hub) == F.col(hub2), _overlap(n, m, num, den) - F.col(hub_n) + F.col(lack) + F.col(lack2)).otherwise(0)

    one_hub = (F.min("hub") == F.max("hub")) & (F.count("hub") == F.count("*"))
    parts = mine.groupBy(*key, "part").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"), F.min("crowded").alias("crowded"),
        F.when(one_hub, F.min("hub")).alias("hub"), F.min("hub_n").alias("hub_n"), F.min("lack").alias("lack"), F.max("left").alias("left"),
    )
    of_part = ("low", "high", "room", "crowded", "hub", "hub_n", "lack", "left")
    x = parts.select(*key, F.col("part").alias("p"), *of_part)
    y = parts.select(*key, F.col("part").alias("q"), *[F.col(c).alias(c + "2") for c in of_part])
    near = (F.lit(den) * F.col("high2") >= F.lit(num) * F.col("low")) & (F.lit(den) * F.col("high") >= F.lit(num) * F.col("low2"))
    space = ~(F.col("crowded") & F.col("crowded2")) | ((F.col("low2") <= F.col("room")) & (F.col("low") <= F.col("room2")))
    enough = needed("low", "low2", "lack", "lack2", "hub", "hub2", "hub_n") <= F.least("left", "left2")
    meet = x.join(y, key).where((F.col("p") < F.col("q")) & near & space & enough).select(*key, "p", "q", *[c + "2" for c in of_part])
    a = mine.select(*key, F.col("part").alias("p"), *[F.col(c).alias(c + "_a") for c in facts])
    b = mine.select(*key, F.col("part").alias("q"), *[F.col(c).alias(c + "_b") for c in facts])
    half = (F.lit(den) * F.col("high2") >= F.lit(num) * F.col("n_a")) & (F.lit(den) * F.col("n_a") >= F.lit(num) * F.col("low2"))
    half = half & (~(F.col("crowded_a") & F.col("crowded2")) | ((F.col("low2") <= F.col("room_a")) & (F.col("n_a") <= F.col("room2"))))
    half = half & (needed("n_a", "low2", "lack_a", "lack2", "hub_a", "hub2", "hub_n_a") <= F.least("left_a", "left2"))
    pairs = meet.join(a, [*key, "p"]).where(half).select(*key, "q", *[c + "_a" for c in facts]).join(b, [*key, "q"])
    pairs = pairs.where(_fits("n_a", "room_a", "crowded_a", "n_b", "room_b", "crowded_b", num, den))
    least = needed("n_a", "n_b", "lack_a", "lack_b", "hub_a", "hub_b", "hub_n_a")
    pairs = pairs.where(least <= F.least("left_a", "left_b"))
    # the set whose prefix ends first lacks at most n - overlap of its prefix tokens in the other
    a_asks, b_asks = F.col("len_a") - F.col("n_a"), F.col("len_b") - F.col("n_b")
    asks = _overlap("n_a", "n_b", num, den) + F.when(F.col("end_a") < F.col("end_b"), a_asks).when(F.col("end_b") < F.col("end_a"), b_asks).otherwise(F.greatest(a_asks, b_asks))
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), asks.alias("asks"), least.alias("needed"))


def links(docs: DataFrame, sets: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b) pairs of set ids whose components are those of all links: the links to centres, and all links between their components."""
    posted = sets.select(F.explode("prefix").alias("token"), "id")
    shared = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    posted = materialise(posted.join(shared, "token").select("token", "id", (F.col("c") >= HOT).alias("long")))
    crowded = materialise(posted.where("long").select("id").distinct().join(sets.select("id", "doc_id", "digest"), "id"))
    facts = sets.select("id", "n", F.struct("last_n", "last_h").alias("end"), F.size("prefix").alias("len"))
    if crowded.isEmpty():
        facts = facts.withColumn("crowded", F.lit(False)).withColumn("own", F.lit(0).cast("long"))
    else:
        own = crowded.select("id").join(_own_tokens(docs, crowded, k), "id", "left").select("id", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
        facts = facts.join(own, "id", "left").select("id", "n", "end", "len", F.col("own").isNotNull().alias("crowded"), F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    facts = materialise(facts)
    # an overlap of n - own at most allows another size of (n - own)(1 + 1 / threshold) - n at most
    room = F.floor((F.col("n") - F.col("own")) * (num + den) / num) - F.col("n")
    posted = posted.join(facts, "id").withColumn("room", room)
    posted = materialise(posted.where(~F.col("long") | (F.lit(den) * F.col("room") >= F.lit(num) * F.col("n"))).drop("long"))

    centre = posted.groupBy("token").agg(F.min(F.struct("own", "id", "n", "room", "crowded")).alias("centre"))
    star = posted.join(centre, "token").where(F.col("id") != F.col("centre.id")).where(_fits("n", "room", "crowded", "centre.n", "centre.room", "centre.crowded", num, den))
    # a pair that shares one token of many is left to the full join
    star = star.groupBy(F.col("centre.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("c"), F.min("len").alias("len")).where("c >= least(len, 3)").select("a", "b")
    compared = _compared(docs, sets, star, k, num, den, 2 * num - den)
    root = components(compared.where("linked").select("a", "b"))

    hubs = materialise(_hubs(compared, facts))
    place = facts.join(root, "id", "left").join(hubs.drop("differs"), "id", "left").withColumn("room", room)
    place = place.select("id", F.coalesce("root", "id").alias("part"), "n", "room", "crowded", "end", "len", "hub", "hub_n", "lack")
    mine = materialise(posted.select("token", "id").join(place, "id").withColumn("left", F.lit(0)))
    pairs = _meetings(mine, ["token"], num, den)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("asks").alias("asks")).where("c >= asks").select("a", "b")
    differing = _meetings(materialise(_differences(hubs).join(place, "id")), ["top", "token"], num, den)
    differing = differing.where("needed > 0").select("a", "b").distinct()
    rest = _compared(docs, sets, pairs.unionByName(differing), k, num, den, num).select("a", "b")
    return root.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(rest)


def classes(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) of each row of docs."""
    each = materialise(prefixes(docs, k, num, den))
    full = each.where("n > 0")
    group = full.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    group = materialise(group)
    one = full.alias("f").join(group.alias("g"), (F.col("f.digest") == F.col("g.digest")) & F.col("f.doc_id").eqNullSafe(F.col("g.least_id")))
    one = one.select("f.*").groupBy("digest", "doc_id", "n", "last_n", "last_h").agg(F.first("prefix").alias("prefix"))  # rows may be repeated
    sets = materialise(one.withColumn("id", F.monotonically_increasing_id()))
    root = components(links(docs, sets, k, num, den))

    # only sets with a copy or a link have another component than their own row
    linked = sets.select("id", "digest", "doc_id").join(root, "id")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "root").select("digest", "component_id")
    copied = group.where("copies > 1").join(linked.select("digest"), "digest", "left_anti").select("digest", F.col("least_id").alias("component_id"))
    known = linked.unionByName(copied).withColumnRenamed("digest", "k_digest")
    out = each.select("doc_id", "n", "digest").join(known, F.col("digest") == F.col("k_digest"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those of which a group already has one: the row with the least doc_id of each component stays, once.

    Rows without a doc_id cannot be told from each other and stay; rows of one doc_id stay or go together, repeated ones once."""
    found = materialise(classes(docs, k, num, den))
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows")).where("doc_id is not null")
    gone = materialise(gone.where("not stays or rows > 1"))
    if gone.isEmpty():
        return docs
    listed = gone.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    small = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(listed) if small else listed, "doc_id", "left_anti").select(docs.columns)
    again = listed.join(gone.where("stays").select(F.col("doc_id").alias("again")), F.col("doc_id") == F.col("again"), "left_semi")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, "doc_id", "left_semi").select(docs.columns).distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = None

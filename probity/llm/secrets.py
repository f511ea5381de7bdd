"""Secret scans: all rules are compiled into deterministic byte automata; each text is read by them, never by regular expressions.

One automaton of all rules reads every text once and tells which rules match anywhere; most texts end there. In the others the same rules
read backward tell at which bytes a match starts, and the whole rule's own automaton, started there, tells where the longest one ends. Spans of a
rule do not overlap: the leftmost start at or after the end of the rule's last match, kept or dropped, is next. Each step is a table lookup and each
byte is read a bounded number of times, so a scan is linear in the text. Matches that are too short are dropped.

Rules have a head and a tail, and the tail's length decides. To tell where matches start, a tail's last repetition need not be read to its end (see `cut`).
The kinds `assign`, `access` and `hex` are the base; the other rules add spans of their own kinds.

Cases: null texts are empty; a text without secrets has counts 0, an empty list of spans and the digest of the empty
string; offsets count code points; texts of any length are scanned whole; repeated rows are scanned alike; other
columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.automata import compile_trees, cut, parse
from probity.llm.common import table


@dataclass(frozen=True)
class Rule:
    """A match is the head and the tail, as long as possible; keep: least size of the tail; fold: letters in either case."""

    kind: str
    head: str
    tail: str
    keep: int = 0
    fold: bool = False


RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]+", 16),
    Rule("private_key", "", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("hosting", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment", "", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20),
    Rule("bearer", r"bearer\x20+", r"[A-Za-z0-9._~+/=-]+", 16, True),
)
BASE = ("assign", "access", "hex")


class Automaton:
    """Transition arrays over byte classes. Rows are lists of rows, so a step is one lookup; the last entry holds the mask of accepted rules, and
    a row from which nothing is accepted any more has -1 there."""

    def __init__(self, trees: list, **how):
        transitions, self.masks = compile_trees(trees, **how)
        columns = list(zip(*transitions, strict=True))
        kinds = {c: i for i, c in enumerate(dict.fromkeys(columns))}
        self.classes, self.size = bytes(kinds[c] for c in columns), len(kinds)
        self.transitions = [list(r) for r in zip(*kinds, strict=True)]
        self._link()

    def _link(self) -> None:
        rows = [[] for _ in self.masks]
        for n, (row, to) in enumerate(zip(rows, self.transitions, strict=True)):
            row.extend(rows[t] for t in to)
            row.append(-1 if not self.masks[n] and all(t == n for t in to) else self.masks[n])
        self.start = rows[0]

    def __getstate__(self):
        return self.classes, self.size, self.transitions, self.masks

    def __setstate__(self, state) -> None:
        self.classes, self.size, self.transitions, self.masks = state
        self._link()

    def any(self, data: bytes) -> int:
        """Mask of the rules that match anywhere."""
        row, last, out = self.start, self.size, 0
        for c in data.translate(self.classes):
            row = row[c]
            if row[last]:
                out |= row[last]
        return out

    def starts(self, data: bytes, n_rules: int) -> list[list[int]]:
        """For a backward automaton: the places where a match of each rule starts, in order."""
        row, last, out = self.start, self.size, [[] for _ in range(n_rules)]
        at = len(data)
        for c in reversed(data.translate(self.classes)):
            row, at = row[c], at - 1
            if row[last]:
                for k in range(n_rules):
                    if row[last] >> k & 1:
                        out[k].append(at)
        for places in out:
            places.reverse()
        return out

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that starts at `at`, which is `at` if none does."""
        row, last, classes, end = self.start, self.size, self.classes, at
        for i in range(at, len(data)):
            row = row[classes[data[i]]]
            if row[last]:
                if row[last] < 0:
                    break
                end = i + 1
        return end


class Scanner:
    """The automata of a set of rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [parse(r.head + r.tail, r.fold) for r in rules]
        short = [cut(tree, r.keep) for tree, r in zip(whole, rules, strict=True)]
        self.present, self.back = Automaton(short), Automaton(short, backward=True)
        self.whole = [Automaton([tree], free=False) for tree in whole]
        self.heads = [Automaton([parse(r.head, r.fold)], free=False) if r.head else None for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of each kept match, by byte."""
        there = self.present.any(data)
        if not there:
            return []
        found = []
        for k, places in enumerate(self.back.starts(data, len(self.rules))):
            done = 0
            for start in places:
                if start >= done:
                    done = self.whole[k].longest(data, start)
                    tail = self.heads[k].longest(data, start) if self.heads[k] else start
                    if done - tail >= self.rules[k].keep:
                        found.append((start, done, k))
        return sorted(found)


def spans_of(scanner: Scanner, data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then by the rules' order."""
    found = sorted((s, k, e) for s, e, k in scanner.scan(data))
    if not found:
        return []
    if data.isascii():
        return [(s, e, scanner.rules[k].kind) for s, k, e in found]
    at, points, seen = {}, 0, 0
    for place in sorted({x for s, _, e in found for x in (s, e)}):
        points += len(data[seen:place].decode("utf-8"))
        seen = place
        at[place] = points
    return [(at[s], at[e], scanner.rules[k].kind) for s, k, e in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `found`, an array of (kind, start, end), of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found = [[{"kind": c, "start": s, "end": e} for s, e, c in spans_of(scanner, text.as_py() or b"")] for text in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(text(F.filter("found", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )


ORACLE = None

"""Token counts: greedy longest-match word pieces counted by one linear automaton pass over each word.

The automaton is a trie of the vocabulary with failure links. Where the trie cannot go on, the failure link
of a node names the node of what is left after the longest pieces have been popped, and `popped` holds how
many pieces those were, so a word of n characters takes O(n) steps and no piece is ever built. A piece that starts
with the word mark is found at a word's start only; a word that pieces cannot cover is one unknown token.

Words repeat, so each worker keeps the counts of the words it has met, at most `CACHE` of them at a time.

Cases: null, empty and blank texts have 0 words and 0 tokens; very long words take linear time; an empty vocabulary
makes every word one unknown token; repeated rows are counted alike; other columns stay out of the result.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import table

MARK = "▁"
CACHE = 500_000
#: Where public tokenizers lie; `piece_bpe_32k.model` holds the vocabulary of the registered query.
TOKENIZERS = "/opt/tokenizers"
_SHIFT = 21  # bits of a code point


class Automaton:
    """next: (node << 21 | code point) -> node; fail: failure link or -1; popped: pieces popped on the way there. Node 0 is the root."""

    def __init__(self, vocabulary: Iterable[str], mark: str = MARK):
        self.mark = mark
        self.next: dict[int, int] = {}
        ends, order = {}, [(0, -1, 0)]  # order: (node, parent, code point), parents first within a piece
        for piece in sorted(set(vocabulary) - {""}, key=lambda p: (len(p), p)):
            node = 0
            for c in map(ord, piece):
                key = node << _SHIFT | c
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(order)
                    order.append((child, node, c))
                node = child
            ends[node] = True
        depth = [0] * len(order)
        for node, parent, _ in order[1:]:
            depth[node] = depth[parent] + 1
        self.fail, self.popped = [-1] * len(order), [0] * len(order)
        for node, parent, c in sorted(order[1:], key=lambda x: depth[x[0]]):
            if node in ends:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0:
                child = self.next.get(at << _SHIFT | c)
                if child is not None:
                    self.fail[node], self.popped[node] = child, n
                    break
                n += self.popped[at]
                at = self.fail[at]

    def count(self, word: str) -> int:
        """Pieces of a word, 1 if pieces cannot cover it."""
        step, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for c in map(ord, self.mark + word):
            while (child := step.get(node << _SHIFT | c)) is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
            node = child
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


class Counts(dict):
    """Counts by word, in UTF-8; a miss asks the automaton."""

    def __init__(self, automaton: Automaton, most: int = CACHE):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.automaton.count(word.decode("utf-8"))
        return n


def pieces(model: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def count_tokens(docs: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """doc_id, n_words, n_tokens. The automaton is as large as the vocabulary and goes to the workers once."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text").cast(pa.binary()):
                ws = (text.as_py() or b"").split()  # bytes split at U+0020 and U+0009 to U+000D only
                n_words.append(len(ws))
                n_tokens.append(sum(map(counts.__getitem__, ws)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), pieces(os.path.join(TOKENIZERS, "piece_bpe_32k.model")))


ORACLE = None

import random

from probity.llm import tokens


def greedy(word: str, vocabulary: set[str]) -> int:
    text, at, n = tokens.MARK + word, 0, 0
    while at < len(text):
        ends = [e for e in range(len(text), at, -1) if text[at:e] in vocabulary]
        if not ends:
            return 1
        at, n = ends[0], n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(3)
    for _ in range(60):
        letters = "abc"[: rng.randint(1, 3)]
        vocabulary = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))} | {tokens.MARK + "".join(rng.choices(letters, k=rng.randint(0, 4))) for _ in range(6)}
        automaton = tokens.Automaton(vocabulary)
        for _ in range(200):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_query_against_greedy_matching(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    vocabulary = set(tokens.pieces(f"{tokens.TOKENIZERS}/piece_bpe_32k.model"))
    mine = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.query(spark, sf).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(mine) == len(rows)
    known = {}
    for doc_id, text in rows[:60]:
        ws = [w.decode() for w in text.encode().split()]
        assert mine[doc_id] == (len(ws), sum(known.setdefault(w, greedy(w, vocabulary)) for w in ws))


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, " \n", 0), (3, "ab " * 50_000, 0), (None, "ab", 0), (None, "ab", 0)], "doc_id long, text string, n_words int")
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in tokens.count_tokens(docs, ["▁a", "b"]).collect())
    assert out == [(0, 1, 2), (0, 1, 2), (1, 0, 0), (2, 0, 0), (3, 50_000, 100_000)]
    assert tokens.count_tokens(docs.limit(0), []).count() == 0


def test_the_cache_is_bounded():
    counts = tokens.Counts(tokens.Automaton(["▁a", "b"]), most=3)
    assert [counts[w] for w in (b"a", b"ab", b"abb", b"abbb", b"a")] == [1, 2, 3, 4, 1] and len(counts) <= 3

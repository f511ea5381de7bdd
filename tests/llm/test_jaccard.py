import random
import re

import duckdb
import pytest

from probity.llm import jaccard
from probity.llm.components import components

SF = "/root/testdata"


def sets_of(rows, k):
    out = []
    for _, t in rows:
        ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out.append(frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset())
    return out


def brute(rows, k, num, den):
    """[(doc_id, size, component)] by comparing all pairs that share an n-gram."""
    sets, parent, index = sets_of(rows, k), list(range(len(rows))), {}

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in index.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            index[g].append(i)
        for j, c in shared.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df, k, num, den):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df, k, num, den).collect()), key=str)


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (2, 60, 100)])
def test_random_families(spark, k, num, den):
    rng = random.Random(k)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 14)):
            ws = base.copy()
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice("ABC") * 5
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "a", "A", "a b", "a b"])]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den) == brute(rows, k, num, den)


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/sf0.01/documents.parquet'").fetchall()
    mine = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.query(spark, f"{SF}/sf0.01").collect()), key=str)
    assert mine == brute(rows, 3, 90, 100)


def test_partners_are_dealt_alike(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(60)], []
    for d in range(60):
        ws = base.copy()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((d, " ".join(ws)))
    want = brute(rows, 2, 80, 100)
    assert len({c for _, _, c in want}) < 50
    for most in (1, 10_000):  # few sets are dealt out, all with two partners or more are
        monkeypatch.setattr(jaccard, "HOT_SETS", most)
        assert got(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 100) == want


def test_frequent_tokens_only_change_the_order(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 6)
    rng = random.Random(9)
    common = " ".join(rng.choice("abcdefgh") * 2 for _ in range(30))
    rows = [(i, common + " " + " ".join(rng.choice("qrstuv") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 200])))) for i in range(120)]
    want = brute(rows, 3, 90, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 1 << 17):
        monkeypatch.setattr(jaccard, "MOST_FREQUENT", most)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        assert got(df, 3, 90, 100) == want


def edited_groups(seed):
    """Large groups of a few edits each, many of them just beyond the threshold, with gains that several texts share."""
    rng = random.Random(seed)
    rows = []
    for size, words in ((90, 120), (60, 60), (40, 40)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            ws = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
                at = rng.randrange(len(ws)) if rng.random() < 0.6 else rng.choice([5, 6, 20, 21])
                ws[at] = rng.choice([f"own{rng.randrange(10**6)}", "both", "gone", base[0]])
            if rng.random() < 0.2:
                ws = ws[: rng.randrange(words * 4 // 5, words)]
            rows.append((len(rows), " ".join(ws)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, k, num, den", [(1, 3, 90, 100), (2, 3, 90, 100), (3, 5, 80, 100)])
def test_near_misses_of_large_groups(spark, monkeypatch, seed, k, num, den):
    monkeypatch.setattr(jaccard, "HOT", 8)
    rows = edited_groups(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den) == brute(rows, k, num, den)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1007)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    root = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(root) == nodes
    assert len({(find(x), root[x]) for x in nodes}) == len({find(x) for x in nodes}) == len(set(root.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (5, "A b"), (5, "a B"), (6, "a b"), (7, "x"), (None, "x"), (None, "q"), (None, ""), (5, "other text here")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, n_shingles int")
    assert got(df, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert jaccard.classes(df.limit(0)).count() == 0
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    # the two rows of doc_id 5 that match stay as one of each text, as that doc_id leads its group
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 0, 1, 2, 3, 5, 5, 5, 7]
    assert jaccard.keep_one(df.limit(0)).count() == 0

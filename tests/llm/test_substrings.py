import random

import duckdb

from probity.llm import substrings as sub


def brute_units(text: str, least: int):
    """(words with line breaks, start, end) of each unit, by scanning signs and trying all runs of pieces."""
    lines, sentences, at = [], [], 0
    for n, line in enumerate(text.split("\n")):
        start = 0
        for i, c in enumerate(line):
            if c in ".!?" and (i + 1 == len(line) or line[i + 1].isspace()) or i + 1 == len(line):
                sentences.append((n, at + start, at + i + 1))
                start = i + 1
        lines.append((n, at, at + len(line)))
        at += len(line) + 1
    whole = [[p for p in pieces if text[p[1] : p[2]].split()] for pieces in (lines, sentences)]
    for pieces in whole if len(whole[1]) > len(whole[0]) else whole[:1]:
        size = [len(text[a:b].split()) for _, a, b in pieces]
        runs = {(i, i + 1) for i in range(len(pieces)) if size[i] >= least}
        for i in range(len(pieces)):
            if size[i] < least:
                runs |= set([(i, j) for j in range(i + 1, len(pieces) + 1) if sum(size[i:j]) >= least][:1])
                runs |= set([(j, i + 1) for j in range(i, -1, -1) if sum(size[j : i + 1]) >= least][:1])
        for i, j in runs:
            key = []
            for k in range(i, j):
                key += ["\n"] * (k > i and pieces[k][0] != pieces[k - 1][0]) + text[pieces[k][1] : pieces[k][2]].lower().split()
            first, last = text[pieces[i][1] : pieces[i][2]], text[pieces[j - 1][1] : pieces[j - 1][2]]
            yield tuple(key), pieces[i][1] + len(first) - len(first.lstrip()), pieces[j - 1][2] - len(last) + len(last.rstrip())


def brute(rows: list[tuple], least: int = sub.MIN_WORDS) -> dict:
    """doc_id -> set of removed code points."""
    places = {}
    for doc_id, text in rows:
        for key, start, end in set(brute_units(text or "", least)):
            places.setdefault(key, []).append(((doc_id, sub._row_digest(text or ""), start), end))
    gone, kept = {}, {}
    for found in places.values():
        if len(found) > 1:
            for n, (rank, end) in enumerate(sorted(found)):
                (gone if n else kept).setdefault(rank[:2], set()).update(range(rank[2], end))
    out = {k[0]: points - kept.get(k, set()) for k, points in gone.items()}
    return {d: points for d, points in out.items() if points}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want, texts = brute(rows), dict(rows)
    got = {r["doc_id"]: r for r in sub.query(spark, sf).collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        spans = [tuple(map(int, s.split(":"))) for s in r["removed_spans"].split(",")]
        points = {p for a, b in spans for p in range(a, b)}
        assert points == want[d] and r["removed_chars"] == len(points) and spans == sorted(spans) and r["n_spans"] == len(spans)
    cut = {r["doc_id"]: r["text"] for r in sub.remove(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert cut == {d: "".join(c for i, c in enumerate(t) if i not in want.get(d, ())) for d, t in texts.items()}


def test_planted_passages(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(4, 14))).capitalize() + "."
    passage = lambda: rng.choice([" ", "\n"]).join(sentence() for _ in range(8))
    passages = [passage() for _ in range(10)]
    docs = []
    for d in range(100):
        body = [passage() for _ in range(3)]
        if d % 2:
            body.insert(rng.randint(0, 3), passages[d // 2 % 10])
        docs.append((d, "\n".join(body)))
    got = {r["doc_id"] for r in sub.removed_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d for d in range(21, 100, 2)}


def test_cases(spark):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, None, "x"), (2, " \n ", "x"), (3, line, "x"), (4, f"É. {line.upper()}\n{line}", "x"), (4, f"É. {line.upper()}\n{line}", "x"), (4, line, "x"), (None, "y " * 40_000, "x")], "doc_id long, text string, removed string")
    out = sub.remove(docs, 8)
    rows = sorted(((r["doc_id"] or 0, r["text"] or "", [tuple(x) for x in r["_removed"]]) for r in out.collect()))
    assert len(rows) == 7 and (3, line, []) in rows and (4, "", [(0, len(line))]) in rows
    assert rows.count((4, "É. \n", [(3, 3 + len(line)), (4 + len(line), 4 + 2 * len(line))])) == 2
    assert sub.remove(docs.limit(0)).count() == 0 and sub.remove(docs).columns == out.columns


def test_hot_units_are_found_alike(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(d, f"{line}\nx{d % 7} {line}" if d % 3 else f"{d} {line} {d}") for d in range(90)], "doc_id long, text string")
    rows = lambda: sorted((r["doc_id"], [tuple(x) for x in r["spans"]]) for r in sub.removed_spans(docs).collect())
    found = []
    for most in (1, 7, 10_000):  # no unit is hot, some are, all are
        monkeypatch.setattr(sub, "HOT_UNITS", most)
        found.append(rows())
    assert found[0] == found[1] == found[2] and len(found[0]) == 59


def test_passages_of_short_lines_and_sentences(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    sentences = lambda joints: "".join(words(4) + "." + j for j in joints)
    lines = "\n".join(words(3) for _ in range(20)), "\n".join(words(1) for _ in range(30)), "\n".join(words(n) for n in (1, 6, 2, 7, 1, 1, 1, 5, 7, 3))
    docs, want = [], {}
    for k, passage in enumerate((*lines, sentences("     ").strip(), sentences(" \n \n\n ").strip())):
        joint = "\n" if passage in lines else " "
        for d in (2 * k, 2 * k + 1):
            before, after = words(12) + ".", words(12) + "."
            docs.append((d, joint.join([before, passage, after])))
        want[2 * k + 1] = [(len(before) + 1, len(before) + 1 + len(passage))]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sub.removed_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_kept_units_stay_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d\na b c d\na b c d")], "doc_id long, text string")
    assert [[tuple(x) for x in r["spans"]] for r in sub.removed_spans(docs, 8).collect()] == [[(15, 23)]]
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(12)]
    texts = {d: "\n".join(rng.choices(lines, k=rng.randint(1, 12))) for d in range(60)}
    want = brute(list(texts.items()), 8)
    got = {r["doc_id"]: {p for a, b in r["spans"] for p in range(a, b)} for r in sub.removed_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 8).collect()}
    assert got == want and len(want) > 20
    # each repeated unit is whole where it is first
    places = {}
    for d, t in texts.items():
        for key, start, end in set(brute_units(t, 8)):
            places.setdefault(key, []).append((d, start, end))
    repeated = [min(found) for found in places.values() if len(found) > 1]
    assert len(repeated) > 20 and not any(set(range(start, end)) & got.get(d, set()) for d, start, end in repeated)


def test_texts_without_a_shared_passage_are_left_alone(spark):
    """Of the texts of the table that share no 50 words with another, nine in ten or more lose nothing (the rest are mostly copies of fewer words); of those that share 50 different words with an earlier one, all lose something."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    seen, copies = {}, set()
    for d, t in rows:
        w = t.lower().split()
        runs = {tuple(w[i : i + 50]) for i in range(len(w) - 49) if len(set(w[i : i + 50])) > 20}
        if any(r in seen for r in runs):
            copies.add(d)
        seen.update(dict.fromkeys(runs))
    hit = {r["doc_id"] for r in sub.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(copies) > 30 and len(hit & copies) >= 0.97 * len(copies) and len(hit - copies) <= 0.1 * (len(rows) - len(copies))

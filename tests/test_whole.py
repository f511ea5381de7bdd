"""Registered queries take all rows of their tables: small tables with matches outside the first rows, against brute force."""

import hashlib
import math
import random
from statistics import variance

from probity.operators import images, overlap
from probity.plans.queries import QUERIES, _works


def test_dedup_minhash_finds_pairs_of_any_documents(spark, tmp_path):
    """Ids are multiples of 25, so every second document is looked for; all are compared when all are targets."""
    rng = random.Random(3)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    bodies = [some(60) for _ in range(20)]
    bodies[11] = bodies[8]
    bodies[17] = bodies[4][:40] + some(20)
    bodies[19] = bodies[1][30:] + some(200)
    bodies[18] = bodies[2][:12] + some(60)
    docs = spark.createDataFrame([(25 * i, " ".join(ws)) for i, ws in enumerate(bodies)] + [(500, None), (550, "too short")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{" ".join(ws[i : i + 6]) for i in range(len(ws) - 5)} for ws in bodies]
    sign = [[min(hashlib.md5(f"{i}{x}".encode()).hexdigest() for x in s) for i in range(128)] for s in sets]
    want = {}
    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            j = sum(x == y for x, y in zip(sign[a], sign[b], strict=True)) / 128
            if a != b and s & t and j > 0.05:
                want[25 * a, 25 * b] = (len(s & t), round(j, 3), round(len(s & t) / len(s), 4))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows, asked in ((QUERIES["dedup_minhash"](spark, str(tmp_path)).collect(), {k: v for k, v in want.items() if k[0] % 50 == 0}), (overlap.against_corpus(docs, docs, "doc_id", "text").collect(), want)):
        assert {(r["a"], r["b"]): (r["shared"], r["jaccard_estimate"], r["overlap_ratio"]) for r in rows} == asked and len(rows) == len(asked)
    assert {(200, 275), (275, 200), (100, 425), (425, 100)} <= set(want)


def test_rule_alpha_takes_all_items(spark, tmp_path):
    rng = random.Random(4)
    rows = [("A", who, item, float(rng.randint(1, 5) + who % 7)) for who in range(30) for item in range(1, 8)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    items = [variance(v for _, _, i, v in rows if i == item) for item in range(1, 8)]
    alpha = 7 / 6 * (1 - sum(items) / variance(sum(v for _, w, _, v in rows if w == who) for who in range(30)))
    assert [tuple(r) for r in QUERIES["rule_alpha"](spark, str(tmp_path)).collect()] == [("A", 7, round(alpha, 4), alpha > 0.95)]


def test_self_duplicates_gives_all_pairs(spark, tmp_path):
    block, other, filler = ([f"{name}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(n)] for name, n in (("one", 1200), ("two", 300), ("gap", 700)))
    text = " ".join([*block, *other, *filler, *block, *other])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["first"], r["second"]) for r in QUERIES["self_duplicates"](spark, str(tmp_path)).collect()}
    # the copied stretch of 1500 words starts 2200 words later: 27 windows of 200 words at steps of 50 lie in it
    assert {(at, at + 2200) for at in range(0, 1301, 50)} <= got


def test_doi_snapshot_holds_a_work_for_each_document(spark, tmp_path):
    spark.createDataFrame([(i, "s", "text") for i in range(10)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    works = [r["doi"] for r in _works(spark, str(tmp_path)).collect()]
    assert len(works) == len(set(works)) == 10 + 7 and {w.rpartition(".")[2] for w in works if w.startswith("10.1234/")} == set(map(str, range(10)))
    (row,) = QUERIES["doi_summary"](spark, str(tmp_path)).collect()
    assert row["total"] == 40 and row["n_ok"] == 4 + 10 and row["n_invalid"] == 10 and row["n_not_found"] == 16


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    common = rng.choices(words, k=14)
    bodies = []
    for d in range(150):
        ws = rng.choices(words, k=rng.randint(0, 60))
        if d % 3 == 0:
            ws += common
        if d % 5 == 0 and bodies:
            other = rng.choice(bodies)
            ws = other[: rng.randint(len(other) // 3, len(other))] + ws[: rng.randint(0, 20)]
        if d % 17 == 0 and bodies:
            ws = rng.choice(bodies)
        bodies.append(ws)
    sets = [{tuple(ws[i : i + 6]) for i in range(len(ws) - 5)} for ws in bodies]
    first = {}
    for d, s in enumerate(sets):
        first.setdefault(frozenset(s), d)
    want = {}
    for b, t in enumerate(sets):
        for a, s in enumerate(sets[:b]):
            if s and t and first[frozenset(s)] == a and (first[frozenset(t)] in (a, b)) and len(s & t) / len(s | t) > 0.15:
                want[a, b] = len(s & t), round(len(s & t) / len(s | t), 4)
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in enumerate(bodies)], "id long, text string")
    rows = overlap.similar_pairs(df, "id", "text").collect()
    assert {(r["a"], r["b"]): r["shared"] for r in rows} == {k: n for k, (n, _) in want.items()} and len(rows) == len(want) > 40
    assert all(abs(r["jaccard"] - want[r["a"], r["b"]][1]) < 1e-4 for r in rows)


def test_image_pairs_against_brute_force(spark):
    rng = random.Random(10)
    centres = [rng.getrandbits(64) for _ in range(30)]
    hashes = [c ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 0, 1, 5, 12, 15, 16, 20]))) for c in centres for _ in range(8)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    for most in (5, 15):
        want = {(a, b): (x ^ y).bit_count() for b, y in enumerate(hashes) for a, x in enumerate(hashes[:b]) if first[x] == a and first[y] in (a, b) and (x ^ y).bit_count() <= most}
        rows = images.similar_images(spark.createDataFrame(list(enumerate(signed)), "id long, h long"), "id", "h", most).collect()
        assert {(r["a"], r["b"]): r["distance"] for r in rows} == want and len(rows) == len(want) > 50


def test_tails_against_integration(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from probity.functions import special

    at, weight = np.polynomial.legendre.leggauss(400)

    def integral(log_f, low, high):
        x = low + (high - low) * (at + 1) / 2
        return float((weight * np.exp(log_f(x))).sum() * (high - low) / 2)

    def t_tail(t, v):
        # the density at 0 from the same integral over all values, so no gamma function is needed
        f = lambda x: -(v + 1) / 2 * np.log1p(x * x / v)
        return 1 - integral(f, 0, t) / (sum(integral(f, a, a + 5) for a in range(0, 100, 5)) if v > 7 else math.sqrt(v) * math.sqrt(math.pi) * math.gamma(v / 2) / math.gamma((v + 1) / 2) / 2)

    ts = [(t, v, t_tail(t, v)) for v in (1, 2, 3, 5, 8, 45, 500, 1e3, 1e4, 1e5, 1e6, 1e7) for t in (0.05, 0.7, 1.3, 1.73, 2.0, 4.0)]
    rows = spark.createDataFrame([(t, float(v), w) for t, v, w in ts], "t double, v double, w double").select("t", "v", "w", special.t_two_tailed(F.col("t"), F.col("v")).alias("p"), special.f_sf(F.col("t") * F.col("t"), F.lit(1.0), F.col("v")).alias("f")).collect()
    assert max(max(abs(r["p"] - r["w"]), abs(r["f"] - r["w"])) for r in rows) < 1e-8

    def chi_tail(x, k):
        f = lambda u: (k / 2 - 1) * np.log(u) - u / 2 - k / 2 * math.log(2) - math.lgamma(k / 2)
        wide = max(20.0, 4 * math.sqrt(2 * k))
        return sum(integral(f, x + i * wide / 4, x + (i + 1) * wide / 4) for i in range(24))

    chis = [(k + d * math.sqrt(2 * k) + 0.1, k, chi_tail(k + d * math.sqrt(2 * k) + 0.1, k)) for k in (0.4, 1.5, 7.0, 61.0, 61.5, 999.9, 1e5) for d in (0.0, 0.5, 3.0)]
    rows = spark.createDataFrame(chis, "x double, k double, w double").select("w", special.chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()
    assert max(abs(r["p"] - r["w"]) for r in rows) < 1e-7


def test_pictures_are_read(spark):
    import struct
    import zlib

    import numpy as np

    from probity.sources.pictures import grey

    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (24, 16, 3))
    pixels[:, :, 1] = np.arange(16) * 9
    rows, above = b"", np.zeros(48, np.int64)
    for y in range(24):
        line, kind = pixels[y].ravel().astype(np.int64), y % 5
        left = np.concatenate(([0, 0, 0], line[:-3]))
        corner = np.concatenate(([0, 0, 0], above[:-3]))
        near = np.array([min((abs(a - c), 0, l), (abs(l - c), 1, a), (abs(l + a - 2 * c), 2, c))[2] for l, a, c in zip(left, above, corner)])
        rows += bytes([kind]) + bytes(((line - [np.zeros(48, np.int64), left, above, (left + above) // 2, near][kind]) & 255).astype(np.uint8))
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 24, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    ppm = b"P6 # a comment\n16 24\n255\n" + pixels.astype(np.uint8).tobytes()
    want = (pixels @ [0.299, 0.587, 0.114]).reshape(8, 3, 8, 2).mean(axis=(1, 3)).ravel()
    for data in (png, ppm):
        got, error = grey(data)
        assert error is None and np.allclose(got, want)
    assert grey(b"P5 8 8 255\n" + bytes(range(64)))[0] == [float(v) for v in range(64)] and grey(png[:60])[0] is None and grey(None)[0] is None
    rows = images.decoded(spark.createDataFrame([("a", png), ("b", b"no image"), ("c", None)], "path string, content binary")).collect()
    assert [r["pixels"] is not None for r in rows] == [True, False, False] and rows[1]["error"]


def test_saved_pages_of_a_listing(spark, tmp_path):
    import json

    from probity import sources
    from probity.operators import citations

    for start, items in ((0, ["10.1/A", "10.1/b"]), (2, ["10.1/B", "10.1/c"]), (4, ["10.1/d"]), (6, ["10.1/e", "10.1/f"])):
        (tmp_path / f"{start}.json").write_text(json.dumps({"message": {"items": [{"DOI": d} for d in items], "query": {"start-index": start}}}))
    pages = sources.saved_pages(spark, str(tmp_path))
    read = lambda **how: sorted(r["doi"] for r in citations.from_pages(pages, page_size=2, **how).collect())
    assert read() == ["10.1/a", "10.1/b", "10.1/c", "10.1/d"] and read(most=2) == ["10.1/a", "10.1/b"]
    (tmp_path / "2.json").unlink()
    pages = sources.saved_pages(spark, str(tmp_path))
    assert read() == ["10.1/a", "10.1/b"]
    (tmp_path / "bad.json").write_text("not json")
    assert sources.retraction_cache(spark, str(tmp_path / "bad.json")).count() == 0 and sources.retraction_cache(spark, str(tmp_path / "none.json")).count() == 0


def test_digit_windows_count_all_rows(spark, tmp_path):
    """A value of 0 has no leading digit and is a row of its window all the same."""
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1 + i // 4, 12), "view", v) for i, v in enumerate([0.0, 9.5, 1.0, 0.04, 0.0, 0.0, 19.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r)[2:] for r in QUERIES["digit_windows"](spark, str(tmp_path)).collect())
    assert got == [(3, 1, 0, 2, 1), (4, 1, 1, 2, 1)]


def test_bits_of_long_files(spark, tmp_path):
    """A file of many pieces, with an end that fills none, an empty one beside it; seconds follow its length."""
    import time

    from pyspark.sql import functions as F

    from probity import sources

    data = random.Random(5).randbytes(600_001)
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"")
    bits = sources.byte_bits(spark, f"{tmp_path}/*.txt")
    began = time.perf_counter()
    weighed = bits.groupBy().agg(F.count("*"), F.sum("bit"), F.count_distinct("pos"), F.sum(F.col("pos") * F.col("bit")), F.max("pos")).first()
    assert time.perf_counter() - began < 60
    ones = [8 * i + k for i, byte in enumerate(data) for k in range(8) if byte >> (7 - k) & 1]
    assert tuple(weighed) == (8 * len(data), len(ones), 8 * len(data), sum(ones), 8 * len(data) - 1)
    assert [r["bit"] for r in bits.where("pos < 16").orderBy("pos").collect()] == [data[k // 8] >> (7 - k % 8) & 1 for k in range(16)]


def test_image_pairs_make_no_rows_for_candidates(spark):
    """Twenty thousand hashes in several blocks: the pairs that numpy finds, though two hundred million are compared."""
    import time

    import numpy as np

    h = np.random.default_rng(6).integers(-(2**63), 2**63, 20_000)
    h[5000:5020] = h[:20] ^ 7
    h[9000:9010] = h[:10]
    want = set()
    for i in range(len(h)):
        d = np.bitwise_count((h[i + 1 :] ^ h[i]).view(np.uint64))
        want |= {(i, i + 1 + int(j), int(d[j])) for j in np.flatnonzero(d <= 12)}
    want = {(a, b, d) for a, b, d in want if not (9000 <= b < 9010 and d) and not 9000 <= a < 9010}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h.tolist())], "id long, h long")
    for block in (1_000_000, 7_000):
        began = time.perf_counter()
        rows = images.similar_images(df, "id", "h", 12, block).collect()
        assert time.perf_counter() - began < 60
        assert {(r["a"], r["b"], r["distance"]) for r in rows} == want and len(rows) == len(want) >= 30
    assert images.similar_images(df.where("id < 0"), "id", "h").collect() == []


def test_targets_in_blocks_without_shuffles(spark):
    """Copies, parts and texts that share one common line: the same rows by one block and by many as signatures give, and no exchange of texts or pairs."""
    rng = random.Random(8)
    some = lambda n: ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]
    line, bodies = some(16), []
    for d in range(120):
        ws = some(rng.randint(0, 120)) + line * (d % 2)
        bodies.append(ws if d % 5 or not d else rng.choice(bodies)[rng.randint(0, 20) :] + ws[: rng.randint(0, 30)])
    sets = [{" ".join(ws[i : i + 6]) for i in range(len(ws) - 5)} for ws in bodies]
    sign = [[min(hashlib.md5(f"{i}{x}".encode()).digest() for x in s) for i in range(128)] if s else None for s in sets]
    want = set()
    for a in range(0, 120, 3):
        for b in range(120):
            if a != b and sign[a] and sign[b] and (j := sum(x == y for x, y in zip(sign[a], sign[b], strict=True)) / 128) > 0.05:
                want.add((a, b, len(sets[a] & sets[b]), j * 128))
    docs = spark.createDataFrame([(d, " ".join(ws)) for d, ws in enumerate(bodies)] + [(None, " ".join(bodies[0]))], "id long, text string")
    for block in (10**6, 2000):
        out = overlap.against_corpus(docs.where("id % 3 = 0"), docs, "id", "text", block=block)
        rows = out.collect()
        assert {(r["a"], r["b"], r["shared"], round(r["jaccard_estimate"] * 128)) for r in rows} == want and len(rows) == len(want) > 200
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert overlap.against_corpus(docs.where("id < 0"), docs, "id", "text").collect() == []


def test_ranks_stand_on_one_set_of_quantiles(spark):
    """Approximate quantiles depend on the order of merging, so buckets and the counts below them must come from one computation."""
    from probity.operators import distribution

    rng = random.Random(11)
    values = sorted(round(rng.gauss(10, 3), 2) for _ in range(5000))
    m, sd = sum(values) / 5000, math.sqrt(variance(values))
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-10)
    want = -5000 - sum((2 * i - 1) * math.log(tail(-(v - m) / sd)) + (2 * (5000 - i) + 1) * math.log(tail((v - m) / sd)) for i, v in enumerate(values, 1)) / 5000
    out = distribution.anderson_darling(spark.createDataFrame([("a", v) for v in values], "g string, v double").repartition(7), "v", ["g"])
    assert "percentile_approx" not in out._jdf.queryExecution().analyzed().toString()
    assert abs(out.first()["a2"] - want) < 1e-6


def test_image_totals_count_all_pairs_of_copies(spark, tmp_path):
    """Five copies of one image and three of a near one, in two folders: each pair counts under the folder of its first image."""
    one = [1.0] * 30 + [-1.0] * 34
    near = [1.0] * 33 + [-1.0] * 31
    far = [-1.0] * 32 + [1.0] * 32
    kinds = [one, near, one, one, near, one, far, near, one]
    rows = [(i, v, i % 2) for i, v in enumerate(kinds)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = [i % 2 for i, v in enumerate(kinds) for w in kinds[i + 1 :] if far not in (v, w)]
    got = {tuple(r) for r in QUERIES["image_totals"](spark, str(tmp_path)).collect()}
    assert got == {(0, 5, 10, pairs.count(0)), (1, 4, 6, pairs.count(1))} and len(pairs) == 28


def test_all_suspicious_images_against_brute_force(spark):
    """Large and small classes of copies, keys as numbers and as text, folders, keys and hashes that are absent; by one block and by many that cut the classes."""
    rng = random.Random(12)
    centres = [rng.getrandbits(64) for _ in range(20)]
    hashes = [c ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 0, 0, 1, 6, 15, 16]))) for c in centres for _ in range(25)] + [centres[0]] * 300
    rng.shuffle(hashes)
    folders = [rng.choice(["x", "y", "z", None]) for _ in hashes]
    for kind, key, blocks in ("long", lambda i: i, (1_000_000, 100)), ("string", lambda i: f"{'aé\U0001f600'[i % 3]}{i}", (90,)):
        rows = sorted(((key(i), h, f) for i, (h, f) in enumerate(zip(hashes, folders, strict=True))), key=lambda r: r[0])
        want = {}
        for i, (_, x, f) in enumerate(rows):
            want[f] = want.get(f, 0) + sum((x ^ y).bit_count() <= 15 for _, y, _ in rows[i + 1 :])
        signed = [(k, h - (1 << 64) if h >> 63 else h, f) for k, h, f in rows]
        df = spark.createDataFrame([*signed, (None, signed[0][1], "x"), (key(9999), None, "x")], f"id {kind}, h long, f string")
        for block in blocks:
            assert {r["f"]: r["n_suspicious"] for r in images.suspicious(df, "f", "id", "h", 15, block).collect()} == want
        assert sum(want.values()) > 50_000
    assert images.suspicious(df.where("id is null"), "f", "id", "h").collect() == []

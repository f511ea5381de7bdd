"""Published examples, hand-derived cases, planted anomalies and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from probity import sources
from probity.functions import special
from probity.functions.text import run_lengths
from probity.operators import citations, digits, distribution, images, metadata, overlap, pcurve, rules, statcheck, stylometry
from probity.plans import report
from probity.streaming import digit_windows

REPORTED = "test string, n long, df long, df1 double, df2 double, stat double, reported_p double, reported_es double"


def stats(spark, *rows):
    return spark.createDataFrame(rows, REPORTED)


def test_rechecked_p_values(spark):
    rows = [
        ("t", None, 28, None, None, 2.5, 0.019, None), ("t", None, 28, None, None, 2.5, 0.001, None), ("F", None, None, 2.0, 45.0, 5.3, 0.008, None), ("r", 100, 98, None, None, 0.35, 0.0004, None),
        ("chi2", None, 3, None, None, 12.5, 0.006, None), ("t", None, 28, None, None, 2.5, 0.0, None), ("t", None, 28, None, None, 2.5, -0.1, None), ("t", None, 28, None, None, 2.5, 1.2, None), ("r", 20, None, None, None, 1.0, 0.01, None),
    ]
    out = [(r["p_value"], r["verdict"]) for r in statcheck.recheck(stats(spark, *rows).coalesce(1)).collect()]
    assert out[:5] == [(0.018551, "OK"), (0.018551, "MODERATE"), (0.008572, "OK"), (0.000358, "OK"), (0.005853, "OK")]
    assert [v for _, v in out[5:]] == ["CRITICAL_ZERO", "CRITICAL_NEGATIVE", "CRITICAL_ABOVE_ONE", "INVALID"]


def test_effect_sizes(spark):
    rows = [("t", 30, None, None, None, 3.5, None, 0.8), ("r", 100, None, None, None, 0.45, None, 0.5), ("ANOVA", 64, None, 3.0, 60.0, 4.2, None, None), ("sign", 3, None, None, None, 1.0, None, None), ("t", 0, None, None, None, 1.0, None, None)]
    out = [tuple(r)[-7:] for r in statcheck.effect_sizes(stats(spark, *rows).coalesce(1)).collect()]
    assert out[0][1] == 0.9037 and out[0][4:] == ("MEDIUM", -0.1037, "MODERATE")
    assert out[1][1] == 0.0454 and out[1][5:] == (0.4546, "MAJOR")
    assert out[2][1] == 0.1736 and out[2][4] == "LARGE" and out[3][0] == "skipped" and out[4][0] == "invalid"


def test_df_consistency(spark):
    df = spark.createDataFrame([("independent_t", 30, 28, 2), ("paired_t", 30, 28, 2), ("other", 1, 1, 1)], "design string, n long, df long, groups int")
    assert [(r["implied_n"], r["consistent"]) for r in statcheck.df_consistency(df).collect()] == [(30, True), (29, False), (None, None)]


def test_special_functions(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 1.0, 1.9, 2.0, 2.5, 4.0, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", special.erfc(F.col("x")).alias("y")).collect():
        assert math.isclose(r["y"], math.erfc(r["x"]), rel_tol=1e-12)
    for r in df.where("x > 0").select("x", special.lgamma(F.col("x")).alias("y")).collect():
        assert math.isclose(r["y"], math.lgamma(r["x"]), rel_tol=1e-11, abs_tol=1e-11)
    one = spark.range(1)
    fixed, general = one.select(*[special.chi2_sf(F.lit(7.3), k).alias(f"k{k}") for k in range(1, 10)]).first(), one.select(*[special.chi2_sf(F.lit(7.3), F.lit(k)).alias(f"k{k}") for k in range(1, 10)]).first()
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(fixed, general, strict=True))
    assert math.isclose(one.select(special.chi2_sf(F.lit(15.507), 8)).first()[0], 0.05000522, abs_tol=1e-7)
    # two odd F degrees and a Welch df, against numeric integration
    assert math.isclose(one.select(special.f_sf(F.lit(1.0), F.lit(3.0), F.lit(3.0))).first()[0], 0.5, abs_tol=1e-12)
    assert math.isclose(one.select(special.t_two_tailed(F.lit(1.0), F.lit(1.0))).first()[0], 0.5, abs_tol=1e-12)
    t, df = 2.1, 28.7
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n = 20_000
    area = sum(c * (1 + (t * (i + 0.5) / n) ** 2 / df) ** (-(df + 1) / 2) for i in range(n)) * t / n
    assert math.isclose(one.select(special.t_two_tailed(F.lit(t), F.lit(df))).first()[0], 1 - 2 * area, abs_tol=1e-8)


def test_benford(spark):
    rng = random.Random(3)
    rows = [("exp", rng.expovariate(0.5) * 100) for _ in range(400)] + [("uni", rng.uniform(1, 1e5)) for _ in range(300)] + [("few", float(i)) for i in range(1, 12)] + [("few", x) for x in (-5.0, 0.0, float("nan"), float("inf"), None)]
    out = {r["k"]: r for r in digits.benford(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert out["exp"]["verdict"] in ("CONSISTENT", "MARGINAL") and out["uni"]["verdict"] == "SIGNIFICANT"
    assert out["few"]["status"] == "insufficient" and out["few"]["n"] == 11 and out["few"]["chi2"] is None
    lead = spark.createDataFrame([(0.3,), (0.00007,), (1e3,), (9.99,), (-2.0,)], "x double").select(digits.leading_digit(F.col("x"))).collect()
    assert [r[0] for r in lead] == [3, 7, 1, 9, None]
    per = digits.benford_digits(spark.createDataFrame(rows, "k string, v double"), "v", ["k"])
    assert {r["k"]: r["n"] for r in per.groupBy("k").agg(F.sum("actual").alias("n")).collect()} == {"exp": 400, "uni": 300}


def test_last_digits(spark):
    rows = [("round", 10.0 * i + (5 if i % 2 else 0)) for i in range(60)] + [("even", float(i)) for i in range(100)] + [("few", 1.0)]
    out = {r["k"]: r for r in digits.last_digits(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert not out["round"]["natural"] and out["round"]["over"] == "0,5" and out["round"]["round_share"] == 1.0
    assert out["even"]["natural"] and out["even"]["chi2"] == 0 and out["few"]["status"] == "insufficient"


def test_distribution(spark):
    rng = random.Random(1)
    rows = [("n", rng.gauss(5, 2)) for _ in range(200)] + [("scaled", 0.0)] + [("const", 4.0)] * 30 + [("few", 1.0)] * 3
    rows = [r for r in rows if r[0] != "scaled"] + [("scaled", 3 * v - 7) for k, v in rows if k == "n"]
    df = spark.createDataFrame(rows, "k string, v double")
    a = {r["k"]: r["a2"] for r in distribution.anderson_darling(df, "v", ["k"]).collect()}
    assert math.isclose(a["n"], a["scaled"], rel_tol=1e-9) and 0 < a["n"] < 1 and a["const"] is None and a["few"] == 0
    m = {r["k"]: r for r in distribution.moments(df, "v", ["k"]).collect()}
    vs = [v for k, v in rows if k == "n"]
    n, mean = len(vs), sum(vs) / len(vs)
    g1 = (sum((v - mean) ** 3 for v in vs) / n) / (sum((v - mean) ** 2 for v in vs) / n) ** 1.5
    assert math.isclose(m["n"]["skewness"], g1 * math.sqrt(n * (n - 1)) / (n - 2), rel_tol=1e-9) and m["const"]["skewness"] == 0
    u = {r["k"]: r["status"] for r in distribution.uniform_chi2(df, "v", ["k"]).collect()}
    assert u == {"n": "ok", "scaled": "ok", "const": "constant", "few": "insufficient"}


def test_runs(spark):
    bits = [("alt", i, i % 2) for i in range(16)] + [("ones", i, 1) for i in range(16)] + [("nine", i, i % 2) for i in range(9)] + [("two", i, int(i >= 8)) for i in range(16)]
    out = {r["k"]: r for r in distribution.runs_test(spark.createDataFrame(bits, "k string, pos int, b int"), F.col("b") == 1, ["pos"], ["k"]).collect()}
    assert (out["alt"]["runs"], out["alt"]["z"], out["alt"]["p_value"], out["alt"]["note"]) == (16, 3.6228, 0.0003, "too many")
    assert out["ones"]["status"] == "invalid" and out["nine"]["status"] == "insufficient" and (out["two"]["runs"], out["two"]["note"]) == (2, "too few")
    got = distribution.bits_of_bytes(spark.createDataFrame([("a", bytearray(b"\xaa\x01"))], "k string, content binary"), "content", ["k"]).orderBy("pos").collect()
    assert [r["bit"] for r in got] == [1, 0] * 4 + [0] * 7 + [1]


def test_p_curve(spark):
    rows = [("g9", p) for p in (0.01, 0.03, 0.04, 0.02, 0.01, 0.008)] + [("g10", p) for p in (0.049, 0.048, 0.047, 0.046, 0.045, 0.044)] + [("none", 0.5)] * 4 + [("edge", p) for p in (0.0, 0.05, 0.0500001, 0.02)]
    out = {r["k"]: r for r in pcurve.p_curve(spark.createDataFrame(rows, "k string, p double"), "p", ["k"]).collect()}
    a, b = out["g9"], out["g10"]
    assert [a[f"c{i}"] for i in range(1, 6)] == [3, 1, 1, 1, 0] and (a["skew"], a["shape"], a["chi2"], a["p_value"]) == (0.01, "RIGHT", 4.0, 0.406)
    assert b["c5"] == 6 and (b["skew"], b["shape"], b["chi2"], b["p_value"], b["cluster"], b["borderline"]) == (-0.02, "LEFT", 24.0, 0.0001, "CLIFF", "HIGH")
    assert out["none"]["status"] == "insufficient" and out["edge"]["n"] == 1 and out["edge"]["c2"] == 1


def test_texts(spark):
    block = " ".join(f"word{i}" for i in range(220))
    filler = " ".join(f"fill{i}" for i in range(600))
    docs = spark.createDataFrame([(1, "Short."), (2, block), (3, block), (4, f"{block} {filler} {block}"), (5, ""), (6, None), (7, "alpha beta " * 90)], "doc_id long, text string")
    pairs = {(r["a"], r["b"]): r for r in overlap.similar_pairs(docs, "doc_id", "text").collect()}
    assert pairs[2, 3]["jaccard"] == 1 and pairs[2, 3]["level"] == "HIGH" and (1, 5) not in pairs
    est = {r["b"]: r["jaccard_estimate"] for r in overlap.against_corpus(docs.where("doc_id = 2"), docs, "doc_id", "text").collect()}
    assert est[3] == 1.0 and 0.05 < est[4] < 0.6
    again = overlap.repeated_passages(docs, "doc_id", "text").collect()
    assert again and all(r["doc_id"] == 4 and r["second"] - r["first"] >= 500 and r["similarity"] >= 0.6 for r in again)
    s = {r["doc_id"]: r for r in stylometry.likelihood(stylometry.features(docs, "text", ["doc_id"])).collect()}
    assert s[1]["status"] == "insufficient" and s[6]["n_words"] == 0 and s[7]["type_token_ratio"] == round(2 / 180, 4) and s[7]["hapax_ratio"] == 0
    assert sorted(spark.range(1).select(run_lengths(F.split(F.lit("b a b c b a"), " "))).first()[0]) == [1, 2, 3]
    assert overlap.contamination(docs, docs.where("doc_id = 2").withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id", "text").count() == 3


def test_images(spark):
    rng = random.Random(2)
    grid = [rng.randint(0, 255) for _ in range(64)]
    df = spark.createDataFrame([(1, grid), (2, grid), (3, [255 - v for v in grid]), (4, [7] * 64), (5, [1])], "id long, px array<int>").withColumn("h", images.average_hash(F.col("px")))
    h = {r["id"]: r["h"] for r in df.collect()}
    assert h[1] == h[2] and h[4] == 0 and h[5] is None and bin((h[1] ^ h[3]) & (2**64 - 1)).count("1") >= 60
    flips = spark.createDataFrame([(0, 0)] + [(k, (1 << k) - 1) for k in (1, 5, 15, 16)], "id long, h long")
    assert {(r["a"], r["b"]): r["distance"] for r in images.similar_images(flips, "id", "h", 5).collect()} == {(0, 1): 1, (0, 5): 5, (1, 5): 4, (15, 16): 1}
    pixels = [("img", 64, 64, x, y, float(rng.randint(0, 255)) if not (x >= 32 and y >= 32) else 0.0) for x in range(64) for y in range(64)]
    at = {(x, y): v for _, _, _, x, y, v in pixels}
    pixels = [(k, w, hh, x, y, at[x - 32, y - 32] if x >= 32 and y >= 32 else v) for k, w, hh, x, y, v in pixels] + [("blank", 64, 64, x, y, 9.0) for x in range(64) for y in range(64)]
    found = images.clones(images.regions(spark.createDataFrame(pixels, "image string, width int, height int, x int, y int, v double"), "image"), "image").where("distance = 0").collect()
    assert [(r["image"], r["x1"], r["y1"], r["x2"], r["y2"], r["severity"]) for r in found] == [("img", 0, 0, 32, 32, "CRITICAL")]


def test_citations_and_metadata(spark):
    text = 'See 10.1234/abc.1. and (10.1000/Q(1)2), 10.1234/abc.1; "10.5555/X" 10.12/x 11.1234/x 10.1234/'
    df = spark.createDataFrame([(1, text), (2, None)], "paper_id long, text string")
    assert {r["doi"] for r in citations.extract(df, ["paper_id"], "text").collect()} == {"10.1234/abc.1", "10.1000/Q(1", "10.5555/X"}
    ok = spark.createDataFrame([("10.1234/a",), ("10.12/x",), ("11.1234/x",), ("10.1234/",), ("10.12345678901/x",), (None,)], "d string").select(citations.valid_doi(F.col("d"))).collect()
    assert [r[0] for r in ok] == [True, False, False, False, True, False]
    refs = spark.createDataFrame([("10.1/a",), ("10.1234/GOOD",), ("10.5555/x",)], "doi string")
    known = spark.createDataFrame([("10.1234/good", "T")], "doi string, title string")
    assert {r["doi"]: r["status"] for r in citations.check(refs, known).collect()} == {"10.1/a": "invalid_format", "10.1234/GOOD": "ok", "10.5555/x": "not_found"}
    assert {r["doi"] for r in citations.retracted(refs, known).where("retracted").collect()} == {"10.1234/GOOD"}
    work = spark.createDataFrame([((["A title"], [("Roe", "R."), ("Doe", "J.")], [], None, None, ([[2020, 1]],)),)], "w struct<title:array<string>,author:array<struct<family:string,given:string>>,container_title:array<string>,published_print:struct<date_parts:array<array<int>>>,published_online:struct<date_parts:array<array<int>>>,issued:struct<date_parts:array<array<int>>>>")
    assert tuple(work.select(*citations.work_fields(F.col("w"))).first()) == ("A title", "Roe, R.; Doe, J.", "?", "2020")
    exif = spark.createDataFrame([(1, {"Software": "Adobe Photoshop", "DateTime": "2024:01:02 1", "DateTimeOriginal": "2024:01:01 2"}), (2, {"Software": "matplotlib"}), (3, {}), (4, None)], "id long, exif map<string,string>")
    out = {r["id"]: (r["has_exif"], r["software_class"], r["mixed_dates"]) for r in metadata.inspect(exif, ["id"]).collect()}
    assert out[1] == (True, "HIGH", True) and out[2][:2] == (True, "OK") and out[3][0] is False and out[4][0] is False


def test_rollup(spark):
    rows = [("a", "LOW", "1"), ("b", "MEDIUM", "1"), *[("c", "MEDIUM", "1")] * 5, ("d", "HIGH", "1"), ("d", "HIGH", "1"), ("e", "HIGH", "1"), ("e", "CRITICAL", "2"), ("f", "HIGH", "1")]
    df = spark.createDataFrame(rows, "p string, s string, d string")
    found = report.union([report.findings(df.where(F.col("d") == d), F.col("p"), 1, d, "x", F.col("s"), F.lit("")) for d in "12"])
    got = {r["paper_id"]: r["risk"] for r in report.rollup(found, spark.createDataFrame([(x,) for x in "abcdefg"], "paper_id string")).collect()}
    assert got == {"a": "LOW", "b": "MODERATE", "c": "HIGH", "d": "HIGH", "e": "CRITICAL", "f": "MODERATE", "g": "CLEAN"}


def test_rules(spark):
    m = [(1, i, j, 1.0 if i == j else r) for (i, j), r in {**{(k, k): 1.0 for k in (1, 2, 3)}, (1, 2): 0.9, (2, 1): 0.9, (1, 3): 0.9, (3, 1): 0.9, (2, 3): -0.9, (3, 2): -0.9}.items()] + [(2, 1, 1, 1.0), (2, 1, 2, 0.3), (2, 2, 1, 0.4), (2, 2, 2, 0.9)]
    df = spark.createDataFrame(m, "paper long, i int, j int, r double")
    assert [r["paper"] for r in rules.not_positive_definite(df, "paper", "i", "j", "r").collect()] == [1]
    assert sorted(r["problem"] for r in rules.correlation_matrix(df, "paper", "i", "j", "r").collect()) == ["asymmetric", "asymmetric", "diagonal"]
    answers = [("s", i, 3) for i in range(6)] + [("z", i, i % 2) for i in range(6)] + [("d", i, i) for i in range(6)] + [("n", i, v) for i, v in enumerate([1, 3, 2, 2, 5, 1])]
    a = spark.createDataFrame(answers, "who string, item int, answer int")
    assert [r["who"] for r in rules.straight_lining(a, "who", "answer").collect()] == ["s"]
    assert {r["who"]: r["pattern"] for r in rules.alternating(a, "who", ["item"], "answer").collect()} == {"z": "alternating", "d": "diagonal"}
    assert rules.prolific(spark.createDataFrame([("x", 2020)] * 21 + [("y", 2020)] * 20, "a string, y int"), "a", F.col("y")).count() == 1
    reg = spark.createDataFrame([("t1", "death")], "trial string, endpoint string")
    trials = spark.createDataFrame([("t1", "death"), ("t1", "pain"), ("t2", "death")], "trial string, endpoint string")
    assert sorted(r["problem"] for r in rules.registration(trials, reg, "trial", "endpoint").collect()) == ["other_endpoint", "unregistered"]
    steps = spark.createDataFrame([(1, 1, 0.5, 0.2), (1, 2, 1.4, 0.3), (1, 3, 0.1, 0.25)], "m int, step int, beta double, r2 double")
    assert sorted(r["problem"] for r in rules.regressions(steps, ["m"], "step", "beta", "r2").collect()) == ["beta", "falling_r2"]
    simple = spark.createDataFrame([(1, "3.1415", 100.0, 2, 50.2, 49.0, None, -1.0, 1.0, 0.01, 400.0, 10.0), (2, "3.1", 99.0, 3, 50.1, 50.0, 5, 0.5, 1.0, 0.2, 20.0, 10.0)], "id int, raw string, yield double, steps int, found double, calc double, n int, lo double, hi double, p double, recruited double, days double")
    assert [rules.excess_precision(simple, "raw", 2).count(), rules.yields(simple, "yield", "steps").count(), rules.elemental(simple, "found", "calc").count(), rules.missing_n(simple, "n").count(), rules.ci_contradicts(simple, "lo", "hi", "p").count(), rules.recruitment(simple, "recruited", "days", 20).count(), rules.weak_instruments(simple, "days", 11).count()] == [1, 1, 1, 1, 1, 1, 2]
    sizes = spark.createDataFrame([(1, 10, 10), (1, 100, 100), (2, 10, 10)], "paper int, w int, h int")
    assert rules.resolution_spread(sizes, "paper", "w", "h").collect()[0]["spread"] == 100
    mill = spark.createDataFrame([(1, "x", "same " + " ".join(f"a{i}" for i in range(50))), (2, "x", "same " + " ".join(f"a{i}" for i in range(50))), (3, "y", "other words " * 10)], "id long, who string, text string")
    assert [(r["a"], r["b"]) for r in overlap.paper_mill(mill, "id", "text", "who").collect()] == [(1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text("a,b\n1,x\nabc,2\n,3\n-5,4\n1e3\nnan,1\n")
    assert [r[0] for r in sources.csv_column(spark, str(tmp_path / "v.csv"), "a").collect()] == [1.0, -5.0, 1000.0]
    (tmp_path / "s.csv").write_text("test,n,stat,reported_es\nt,30,3.5,0.8\nr,x,0.1,\n")
    assert [r["status"] for r in sources.reported_statistics(spark, str(tmp_path / "s.csv")).collect()] == ["ok", "skipped"]
    (tmp_path / "d.txt").write_text("# note\n10.1234/a \n\n10.1/b\n")
    assert [r[0] for r in sources.doi_list(spark, str(tmp_path / "d.txt")).collect()] == ["10.1234/a", "10.1/b"]
    assert [r["value"] for r in sources.inline_numbers(spark, "1, 2,,x,3.5").collect()] == [1.0, 2.0, 3.5]
    (tmp_path / "c.json").write_text('{"dois": ["10.1/A", "10.1/a"], "updated_at": "x"}')
    assert [r[0] for r in sources.retraction_cache(spark, str(tmp_path / "c.json")).collect()] == ["10.1/a"]
    (tmp_path / "p").mkdir()
    for n in ("1.png", "2.png", "3.png"):
        (tmp_path / "p" / n).write_bytes(b"same" if n != "3.png" else b"other")
    f = sources.files(spark, str(tmp_path / "p"))
    assert f.groupBy("file_hash").count().where("count > 1").count() == 1
    assert sources.texts(spark, str(tmp_path), "*.txt").count() == 1 and sources.number_lines(spark, str(tmp_path / "d.txt")).count() == 0
    sources.write_snapshot(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streaming_matches_batch(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(events)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = digit_windows(stream, "ts", "value", ["event_type"]).writeStream.format("memory").queryName("digits_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    plain = lambda d: {(str(r[0]), *r[1:]) for r in d.withColumn("window_start", F.col("window_start").cast("string")).collect()}
    assert plain(spark.sql("SELECT * FROM digits_out")) == plain(digit_windows(df, "ts", "value", ["event_type"]))


@pytest.mark.parametrize("name", ["benford_audit", "retraction_join"])
def test_entry(spark, name):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert name in entry.queries() and name in entry.oracle_sql()

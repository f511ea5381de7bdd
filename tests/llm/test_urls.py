from probity.llm import urls


def test_rules_and_list(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.net/en/1?x#y", "h"), (2, "https://example.net/de/1", "h"), (3, "HTTP://B.Example.COM/de/", "h"), (4, "x://q.org/fr/1", "h"), (5, None, "h"), (6, "no scheme", "h"),
            (7, "http://bad.org/a/?q=1", "h"), (8, "http://bad.org/a", "h"), (9, "http://good.org/a", "h"), (9, "http://good.org/a", "h"), (10, "http://x.net", "h"), (11, "http://notexample.com/de/1", "h"), (None, "://", "h"),
        ], "page_id long, url string, host string",
    )
    listed = spark.createDataFrame([("bad.org/a",), ("bad.org/a",), (None,), ("other.org/b",)], "canonical string")
    out = urls.judge(pages, listed)
    rows = sorted(((r["page_id"] or 0, r["_host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=str)
    by = {r[0]: r[1:] for r in rows}
    assert len(rows) == 13
    assert by[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[2][2:] == ("net/", "block") and by[3] == ("b.example.com", "/de/", "example.com/de/", "block")
    assert by[4][2:] == ("org/fr/", "allow") and by[5] == by[6] == by[0] == ("", "", None, "allow")
    assert by[7][3] == by[8][3] == "block" and by[9][3] == "allow" and by[10] == ("x.net", "", None, "allow") and by[11][2:] == (None, "allow")
    assert urls.judge(pages.limit(0), listed).count() == 0 and urls.judge(pages, listed.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.createDataFrame([(f"h{i}.org/p",) for i in range(3000)], "canonical string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p/") for i in range(6000)], "page_id long, url string")
    got = {r["page_id"] for r in urls.judge(pages, listed).where("verdict = 'block'").collect()}
    assert got == set(range(3000))


CLASHES = ("word", "verdict", "l_canonical", "path", "host", "rule", "canon", "block", "filter_key", "filter_word", "listed_canon", "canonical", "f_block", "page")


def test_any_other_columns_pass_untouched(spark, monkeypatch):
    rows = [(1, "http://bad.org/a/?q=1"), (2, "http://good.org/"), (3, "http://x.net/a"), (4, None), (5, "no")]
    pages = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], "page_id long, url string, " + ", ".join(f"{c} int" for c in CLASHES))
    listed = spark.createDataFrame([("bad.org/a",), ("worse.org/b",)], "canonical string")
    for most in (urls.BROADCAST_WORDS, 0):
        monkeypatch.setattr(urls, "BROADCAST_WORDS", most)
        out = urls.judge(pages, listed)
        assert out.columns == [*pages.columns, "_host", "_path", "_rule", "_verdict"]
        got = {r["page_id"]: r for r in out.collect()}
        assert {i: r["_verdict"] for i, r in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
        assert all(tuple(r[2 : 2 + len(CLASHES)]) == tuple(range(len(CLASHES))) for r in got.values())


def test_pages_are_not_shuffled_before_the_filter(spark):
    listed = spark.createDataFrame([(f"h{i}.org/p",) for i in range(30_000)], "canonical string")
    pages = spark.range(60_000).selectExpr("id AS page_id", "concat('http://h', id, '.org/p/') AS url")
    out = urls.judge(pages, listed)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    clear = urls.judge(pages, listed).where("verdict = 'allow'")
    assert clear.count() == 30_000 and out.where("verdict = 'block'").count() == 30_000


def test_both_ways_of_the_filter_agree(spark, monkeypatch):
    listed = spark.createDataFrame([(f"h{i}.org/p",) for i in range(0, 9000, 3)], "canonical string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p/" if i % 7 else None) for i in range(9000)], "page_id long, url string")
    monkeypatch.setattr(urls, "PAGE_WORDS", 16)
    one = {tuple(r) for r in urls.judge(pages, listed).collect()}
    monkeypatch.setattr(urls, "BROADCAST_WORDS", 0)
    assert one == {tuple(r) for r in urls.judge(pages, listed).collect()} and len(one) == 9000

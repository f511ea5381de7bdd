import random

from pyspark.sql import functions as F

from probity.llm import rules


def brute(ws: list[str]) -> int:
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab" if k % 2 else "abcdefgh", k=rng.randint(0, 60))) for k in range(150)]
    block = " ".join(f"w{i}" for i in range(20))
    texts += [f"{block} x {block}", f"{block} {block} {block}", block, "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in rules.statistics(df).select("doc_id", F.col("n_repeat_words").alias("n")).collect()}
    assert got == {i: brute(t.split()) for i, t in enumerate(texts)}


def test_cases(spark):
    good = "The cat sat on the mat and then it went to the house of the dog near a big river in spring."
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, good, "x"), (3, good, "x"), (4, " ".join(f"w{i}###" for i in range(40)), "x"), (None, good * 3000, "x")], "doc_id long, text string, kept string")
    out = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in rules.judge(docs).collect()))
    assert [x[:1] + x[2:] for x in out] == [(0, True, False), (1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, False, False)]
    assert rules.judge(docs.limit(0)).count() == 0


def test_no_user_functions(spark):
    df = rules.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan

import random

from pyspark.sql import functions as F

from probity.llm import mixing


def fill(sizes: list[int], weights: list[float], share: float, epochs: float) -> list[float]:
    """Clamp and reshare until none is above."""
    full, left = set(), share * sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        target = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = {i for i in rest if target[i] > epochs * sizes[i]}
        if not over:
            return [epochs * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full |= over
        left -= sum(epochs * sizes[i] for i in over)


def test_targets_are_the_fixed_point(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 10, 1000, 100_000]) + rng.randint(0, 9) for _ in range(rng.randint(1, 9))]
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2.0)
        assert all(abs(got[f"s{i}"] - w) <= 1e-6 * max(1, w) for i, w in enumerate(want))


def test_taken_is_near_target_and_repeats(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None, "d"]), "w " * rng.randint(0, 50)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = ({(r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == 800
    by = {}
    for r in mixing.mix(docs).collect():
        t = by.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert len(by) == 4 and all(abs(t - n) <= 50 for t, n in by.values())
    kept = mixing.repeat(docs)
    assert kept.columns == ["doc_id", "source", "text", "epoch"]
    assert sum(len((r["text"] or "").split()) for r in kept.collect()) == sum(n for _, n in by.values())


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, None, "", 1), (None, "a", "x y", 1), (3, "a", "x " * 9000, 1), (3, "a", "x " * 9000, 1)], "doc_id long, source string, text string, size int")
    out = mixing.mix(docs).collect()
    assert len(out) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeat(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id < 3")).count() == 2


def test_rows_without_a_doc_id_are_taken_singly(spark):
    docs = spark.createDataFrame([(None, f"word {i} " * (1 + i % 5), "a" if i % 3 else None) for i in range(600)], "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    for _, part in out.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 10
    again = mixing.repeat(docs.withColumns({c: F.lit(1) for c in ("u", "mix_digest", "mix_source", "times", "target")}))
    assert again.count() == out["times"].sum() and again.columns[-1] == "epoch" and again.columns[:3] == docs.columns

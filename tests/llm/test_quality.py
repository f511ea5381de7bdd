import duckdb
import numpy as np
from pyspark.sql import functions as F

from probity.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in quality.query(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    good = np.array([rows[d]["score"] for d, q in labels if q == 1 and rows[d]["held_out"]])
    bad = np.array([rows[d]["score"] for d, q in labels if q == 0 and rows[d]["held_out"]])
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    print("auc", auc, "good kept", (good >= 0.5).mean(), "bad dropped", (bad < 0.5).mean())
    assert auc > 0.97 and (good >= 0.5).mean() > 0.99 and (bad < 0.5).mean() > 0.9


def test_rules_match_their_column(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.3)).astype(int)
    model = quality.fit(x, y)
    assert model.rules and model == quality.fit(x[::-1], y[::-1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.FEATURES)).select(F.struct(*quality.FEATURES).alias("s"), F.monotonically_increasing_id().alias("i"))
    got = np.array([r[0] for r in df.orderBy("i").select(model.column(F.col("s"))).collect()])
    total = model.bias + sum(w * quality._holds(x, tuple((quality.FEATURES.index(n), g, t) for n, g, t in r)) for w, r in zip(model.weights, model.rules, strict=True))
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((got >= 0.5) == (y == 1)).mean() > 0.95


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a b c. " * 20_000, 1.0), (3, "a b", 1.0), (None, "a b", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 4)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(docs, labelled)
        out = quality.score(docs, model).collect()
        assert len(out) == 5 and all(0 <= r["_score"] <= 1 and r["predicted"] in (0, 1) and r["score"] == 1.0 for r in out)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels).bias == 0.0


def test_bound_prefers_no_length(spark, monkeypatch):
    docs = spark.createDataFrame([(1 + i % 4, "word " * (i + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    kept = []
    monkeypatch.setattr(quality, "held_out", lambda doc_id: F.lit(False))
    kept.append(quality.sample(docs, labels, max_rows=20).toPandas()[list(quality.FEATURES)].to_numpy(float))
    assert quality.train(docs, labels, max_rows=20).rules
    every = docs.select(quality.features(F.col("text")).alias("f")).select("f.*").toPandas()[list(quality.FEATURES)].to_numpy(float)
    words = next(k for k in range(every.shape[1]) if len(set(every[:, k])) == 200)
    assert len(kept[0]) == 40 and sorted(kept[0][:, words])[20] > sorted(every[:, words])[50]

import corpus_pipeline
import pytest

from probity.llm import decontamination, jaccard, pii
from probity.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
        docs = docs.cache()
        out.append(docs)
    return out


def test_each_stage_decides_and_keeps_the_rest(spark, stages):
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in stages]
    first = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    assert len(good & set(rows[0])) >= 0.97 * len(good) and len(bad & set(rows[0])) <= 0.2 * len(bad) + 1
    assert all(first[d] == t for s in rows[:3] for d, t in s.items())
    group = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(list(rows[0].items()), "doc_id long, text string"), 5, 80, 100).collect()}
    assert set(rows[1]) == {d for d, c in group.items() if d == c}
    held = {r["doc_id"] for r in decontamination.overlaps(stages[1], table(spark, SF, "benchmark")).collect()}
    assert set(rows[2]) == set(rows[1]) - held
    assert set(rows[3]) == set(rows[2]) and rows[3] == {r["doc_id"]: r["text"] for r in pii.replace(stages[2]).collect()}
    assert set(rows[4]) <= set(rows[3]) and all(rows[3][d] == t for d, t in rows[4].items())


def test_run_is_the_chain_of_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["epoch"], r["text"]) for r in out.collect()) == sorted((r["doc_id"], r["epoch"], r["text"]) for r in stages[-1].collect())


def test_cases(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "The cat and the dog went to the house. " * 3000, None, "s", 1), (3, "It is a day in the town of the king.", "en", "s", 1), (None, "It is a day in the town of the queen, anna.1@mail.com.", "en", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from probity.llm import common

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=context)

    assert common.shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[4]")) == common.shared_folder(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))

"""The registered text queries: SQL where there is some, the pipeline, and what the contract says about the results."""

import pytest
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from panelfx.llm import decontaminate, pii
from panelfx.llm.queries import QUERIES, SQL
from test_text_operators import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)} and set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        cur = duck.execute(SQL[name])
        assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == "ok"
    elif name != "op8_ann":
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= was
        if name == "near_copies":
            fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before.collect()}
            pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
            assert pairs and ids == set(plain_components(list(fps), pairs).values())
        if name == "decontamination":
            leaky = decontaminate.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert was - ids == {r["doc_id"] for r in leaky.collect()}
        if name == "pii":
            assert ids == was and pii.scan(docs).where(F.size("base") > 0).count() == 0
            assert docs.where("n_chars <> char_length(text)").count() == before.where("n_chars <> char_length(text)").count()
        if n < 4:
            assert docs.columns == before.columns
    assert docs.where("n_tokens <> size(ids)").count() == 0
    want = {(r["doc_id"], r["n_tokens"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["n_tokens"], r["text"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_pipeline_by_row(spark, sf_dir):
    """Rows of one id, and rows without an id, are judged by their own text."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    copy, other, more = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, copy), (2, copy), (2, other), (2, other), (None, copy), (None, more), (None, more)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_copies"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, more), (1, copy), (2, other)]
    rows = [(None, f"before {item} after"), (None, other), (3, f"x {item}"), (3, copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    kept = stages["decontamination"](spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, other), (3, copy)]


def test_pipeline_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words in a row here", "en", "s", 24), (3, "same words in a row here", "en", "s", 24),
            (None, "no id", "en", "s", 5), (4, "mail a.b@c.org now", "en", "s", 18)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
    assert [i for i, _ in got] == [0, 1, 3, 4] and "[ email ]" in got[-1][1]


def test_pipeline_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0

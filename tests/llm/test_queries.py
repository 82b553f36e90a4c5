"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections
import math

import pytest

import __spark_entry__
import corpus_pipeline
from corpuscope.llm import mixing, quality, queries
from corpuscope.llm.common import read
from tests.compare import connect, differences

from .test_operators import SF, brute_exact, brute_near, library, words  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted({*queries.QUERIES} - {*queries.SQL}))
def test_query_without_sql(spark, name):
    """Their operators are compared with brute force in test_operators."""
    assert queries.QUERIES[name](spark, SF).count() == read(spark, SF, "documents").count()


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()}
    assert found["pipeline"] is corpus_pipeline.run
    assert queries.SQL.keys() <= __spark_entry__.oracle_sql().keys()


def test_pipeline_stage_by_stage(spark, library):  # noqa: F811
    docs = read(spark, SF, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    good = stages[0](spark, docs, SF)
    scores = quality.score(docs, quality.fit(docs, read(spark, SF, "labels")))
    assert good.columns == docs.columns
    assert sorted(rows(good)) == sorted(rows(scores.filter("quality_score >= 0.5")))
    labelled = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    left = {i for i, _ in rows(good)}
    assert sum(q == 1 and i not in left for i, q in labelled.items()) <= 0.03 * len(labelled)

    before = rows(good)
    distinct = stages[1](spark, spark.createDataFrame(good.collect(), docs.schema), SF)
    keep = {eval(x)[1] for x in brute_exact(before)}
    assert distinct.columns == docs.columns and sorted(rows(distinct)) == sorted(r for r in before if r[0] in keep)

    before = rows(distinct)
    apart = stages[2](spark, spark.createDataFrame(distinct.collect(), docs.schema), SF)
    keep = set(brute_near(before).values())
    assert apart.columns == docs.columns and sorted(rows(apart)) == sorted(r for r in before if r[0] in keep)

    source = spark.createDataFrame(apart.collect(), docs.schema)
    mixed = stages[3](spark, source, SF)
    taken = {r.doc_id: math.floor(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix(source).collect()}
    assert mixed.columns == docs.columns
    assert collections.Counter(i for i, _ in rows(mixed)) == collections.Counter({i: n for i, n in taken.items() if n})

    source = spark.createDataFrame(mixed.collect(), docs.schema)
    text = dict(rows(source))
    coded = stages[4](spark, source, SF).collect()
    assert len(coded) == source.count()
    for r in coded:
        assert r.round_trip and r.ids == library.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)


def test_pipeline_on_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        read(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.filter("not round_trip").count() == 0 and out.count() > 0
    assert words("a b") == ["a", "b"]

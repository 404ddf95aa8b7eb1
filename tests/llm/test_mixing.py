import math

import pytest

from tests.llm import tables
from tripleweave.llm import mixing


def _docs(spark, n=3000):
    return spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 5) END AS source", "repeat('x', CAST(20 + id % 60 AS INT)) AS text", "1 AS copy")


def test_shares_come_near_the_weights(spark):
    docs = _docs(spark)
    weights = {"hot": 1.0, "s1": 2.0, "s2": 1.0}
    out = mixing.mixed(docs, weights, epochs=3.0).withColumn("m", mixing.text_mass())
    total = docs.select(mixing.text_mass().alias("m")).agg({"m": "sum"}).first()[0]
    got = {r.source: r[1] for r in out.groupBy("source").agg({"m": "sum"}).collect()}
    assert set(got) == set(weights)
    for s, w in weights.items():
        assert got[s] == pytest.approx(3 * total * w / 4, rel=0.1)


def test_draws_are_poisson_and_repeatable(spark):
    docs = _docs(spark)
    one = mixing.mixed(docs, {"hot": 1.0}, epochs=40.0)
    counts = [r[1] for r in one.groupBy("doc_id").count().collect()]
    rate = mixing.rates(docs, {"hot": 1.0}, epochs=40.0).where("source = 'hot'").first()
    assert rate.parts == math.ceil(rate.rate / mixing.MEAN) > 1
    mean = sum(counts) / 1000
    assert mean == pytest.approx(rate.rate, rel=0.05)
    assert sum((c - mean) ** 2 for c in counts) / 1000 == pytest.approx(rate.rate, rel=0.2)
    again = mixing.mixed(docs.repartition(7), {"hot": 1.0}, epochs=40.0)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = _docs(spark, 500)
    want = sorted(map(repr, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(repr, mixing.mixed(docs).collect())) == want


def test_odd_rows(spark):
    docs = tables.frame(spark)
    out = mixing.mixed(docs.unionByName(docs.where("doc_id = 10")))
    assert out.columns == [*docs.columns, "_copy", "shuffle_key"]
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.mixed(docs.limit(0)).count() == 0
    null_id = tables.frame(spark, [(None, "x y"), (None, None)])
    assert mixing.mixed(null_id, epochs=20.0).count() > 0

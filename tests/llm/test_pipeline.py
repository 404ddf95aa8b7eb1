import inspect

import corpus_pipeline as P
from tests.llm import brute, tables
from tripleweave.llm.queries import QUERIES, oracle_sql


def test_stages_on_whole_tables(spark, tmp_path):
    docs, items = tables.rows(), [(1, " ".join(dict(tables.rows())[40].split()[60:75])), (2, "w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    frame = tables.frame(spark, docs).withColumnRenamed("copy", "copies")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, now = dict(docs), frame
    good = {d for d, t in docs if brute.quality(t)["kept"]}
    single = set(brute.similar([(d, texts[d]) for d in sorted(good)]).values())
    leaks = brute.leaks([(d, texts[d]) for d in single], items)
    clean = {d for d in single if leaks[d][2] == 0}
    assert good > single > clean > set()
    for (name, stage), want in zip(P.STAGES[:3], (good, single, clean)):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(r.doc_id for r in now.collect()) == sorted(want)
    mixed = P.mix(spark, now, str(tmp_path))
    assert mixed.columns == frame.columns and {r.doc_id for r in mixed.collect()} <= clean
    last = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in mixed.collect()} and len(last) == mixed.count()


def test_contract_of_the_stages():
    assert 4 <= len(P.STAGES) <= 5
    for _, f in P.STAGES:
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]


def test_each_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(oracle_sql()) <= set(QUERIES)


def test_stages_take_empty_tables_and_nulls_in_every_column(spark, tmp_path):
    spark.createDataFrame([(None, None), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = tables.frame(spark, [(None, None), (1, None), (1, "word " * 30)])
    nulls = frame.selectExpr(*[f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in frame.dtypes])
    for docs in (frame.limit(0), nulls, frame):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == len(P.STAGES) - 1 or out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs.isEmpty() else n <= 30, (i, n)

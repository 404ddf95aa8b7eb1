import random

from tests.llm import brute, tables
from tripleweave.llm import decontamination as D


def _tables(spark):
    r = random.Random(9)
    docs = tables.rows()
    source = dict(docs)
    items = [(1, " ".join(source[40].split()[60:75])), (2, source[10][:300].upper()), (3, "one"), (4, None), (5, "!!"), (6, tables.words(r, 30)), (2, source[10][:300]), (7, "w1, w2"), (None, source[41]), (8, source[42].replace(" ", "--"))]
    docs += [(60, items[5][1] + " tail"), (61, "x w1. (w2) y"), (62, "ONE"), (63, tables.words(r, 3000, 3))]
    return docs, items


def test_documents_match_brute_force(spark):
    docs, items = _tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(tables.frame(spark, docs), bench).collect()}
    assert got == brute.leaks(docs, items)
    assert got[60][2] >= 1 and got[62][2] == 1


def test_few_hits_in_a_row_and_full_bitmaps_give_the_same(spark, monkeypatch):
    docs, items = _tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "HITS", 2)
    monkeypatch.setattr(D, "_bits", lambda hashes: b"\xff" * (1 << D.BITS - 3))  # as with a benchmark that sets every bit
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(tables.frame(spark, docs[-12:]), bench).collect()}
    assert got == brute.leaks(docs[-12:], items)


def test_the_benchmark_is_no_broadcast(spark):
    """What is sent to the workers has one size, whatever the benchmark's."""
    r = random.Random(3)
    few = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    many = spark.createDataFrame([(i, tables.words(r, 40, 5000)) for i in range(300)], "item_id long, text string")
    sizes = {len(D._bits(D.windows(b).selectExpr("explode(shingles) AS h"))) for b in (few, many)}
    assert sizes == {1 << D.BITS - 3}


def test_leaks_go_and_clean_rows_stay_whole(spark):
    docs, items = _tables(spark)
    frame = tables.frame(spark, docs)
    out = D.without_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    want = {d for d, x in brute.leaks(docs, items).items() if x[2] < 1}
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == want


def test_empty_tables(spark):
    docs = tables.frame(spark)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.without_leaks(docs, nothing).count() == docs.count()
    assert D.report(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert D.digest([2, 10, 10]) == D.digest(["10", "2"])

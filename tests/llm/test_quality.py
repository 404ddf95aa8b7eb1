from pyspark.sql import functions as F

from tests.llm import brute, tables
from tripleweave.llm import quality


def test_measures_match_brute_force(spark):
    got = {r.doc_id: r for r in quality.ledger(tables.frame(spark)).collect()}
    for d, t in tables.rows():
        want = brute.quality(t)
        for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            assert got[d][m] == want[m], (d, m)
        assert (got[d].fail_bits & quality.mask("base") != 0) == want["base_failed"]
        assert (got[d].fail_bits & quality.mask("v1") == 0) == want["kept"]


def test_kept_rows_keep_all_columns_and_repeats(spark):
    docs = tables.frame(spark)
    docs = docs.unionByName(docs.where("doc_id = 10"))
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect())
    want = sorted([d for d, t in tables.rows() if brute.quality(t)["kept"]] + [10])
    assert ids == want


def test_clashing_names_and_empty_table(spark):
    docs = tables.frame(spark)
    book = quality.ledger(docs, keep=tuple(docs.columns))
    assert {"n_words", "_n_words", "fail_bits", "_fail_bits"} <= set(book.columns)
    assert quality.ledger(docs.limit(0)).count() == 0


def test_ablations_agree_with_the_bits(spark):
    book = quality.ledger(tables.frame(spark)).cache()
    got = {r.rule: (r.n_failed, r.n_rejected_alone) for r in quality.ablations(book, "v2").collect()}
    bits = [r.fail_bits & quality.mask("v2") for r in book.collect()]
    for i, (name, _) in enumerate(quality.RULES):
        assert got.get(name, (0, 0)) == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    without = book.where(quality.verdict(F.col("fail_bits"), "base")).count()
    assert without >= book.where(quality.verdict(F.col("fail_bits"), "v1")).count()

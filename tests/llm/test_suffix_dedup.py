import random

import pytest

from tests.llm import brute, tables
from tripleweave.llm import anchors, suffix_dedup


def _docs():
    r = random.Random(2)
    docs = tables.rows()
    p = tables.words(r, 150)
    docs += [(70 + i, tables.words(r, 30) + p[i : i + 420] + tables.words(r, 30)) for i in range(25)]
    short = " ".join(r.choice("a bc def gh".split()) for _ in range(54))  # a passage of 54 words, under 400 bytes
    docs += [(200 + i, f"{tables.words(r, 40)} {short} {tables.words(r, 70)}") for i in range(3)] + [(203, f"{short} {short}"), (204, "of " * 120), (205, short[:-5])]
    docs += [(100, "ab" * 600), (101, "b" + "ab" * 250), (102, p[:399]), (103, p[:400]), (104, "é" * 350), (105, p[5:]), (106, "x" + "é" * 260)]
    return docs


@pytest.mark.parametrize("hot", [1, 4096])
def test_documents_match_brute_force(spark, hot):
    docs = _docs()
    out = suffix_dedup.repeats(tables.frame(spark, docs), hot_kinds=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == brute.repeats(docs)
    assert {r.doc_id: r.n_passage_words for r in out} == brute.passages(docs)
    texts = dict(docs)
    for r in out:
        kept = suffix_dedup.without_repeats((texts[r.doc_id] or "").encode(), [(s.first, s.end) for s in r.spans])
        assert len(kept) == r.n_bytes - r.n_removed


def test_repeated_rows_and_empty_table(spark):
    r = random.Random(4)
    long = tables.words(r, 300)
    docs = tables.frame(spark, [(1, long), (1, long), (None, "short"), (None, "short")])
    got = sorted((str(x.doc_id), x.n_removed, x.n_spans) for x in suffix_dedup.repeats(docs).collect())
    assert got == [("1", len(long), 1), ("1", len(long), 1), ("None", 0, 0), ("None", 0, 0)]
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_pieces_of_long_texts_find_the_same_windows(monkeypatch):
    r = random.Random(6)
    text = bytes(r.choices(b"abcde ", k=20_000))
    whole = anchors.runs([text, b"", text[:399]], 400)
    monkeypatch.setattr(anchors, "PIECE", 3000)
    cut = anchors.runs([text, b"", text[:399]], 400)
    of = lambda x: sorted((int(t), s, int(a)) for t, a, lo, hi in zip(x["text"], x["anchor"], x["low"], x["high"]) for s in range(lo, hi + 1))
    assert of(whole) == of(cut)
    assert len(of(whole)) == len(text) - 399


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark)
    for i in range(6):
        index.add(spark.range(10).selectExpr(f"id + {100 * i} AS gram", "id AS span"))
    found = {r.gram for r in index.add(spark.createDataFrame([(3, 0), (999, 1), (888, 1), (888, 2)], "gram long, span long")).collect()}
    assert found == {3, 888}
    sizes = {k: len(v) for k, v in index.levels.items() if v}
    assert sum(k * n for k, n in sizes.items()) == 7 and max(sizes) == 4


def test_saved_levels_meet_later_batches(spark, tmp_path):
    batch = lambda i: spark.range(10).selectExpr(f"id + {5 * i} AS gram", f"id + {i} AS span")
    whole, parts = suffix_dedup.SuffixIndex(spark), suffix_dedup.SuffixIndex(spark)
    for i in range(5):
        want = {r.gram for r in whole.add(batch(i)).collect()}
        assert {r.gram for r in parts.add(batch(i)).collect()} == want and (i == 0 or want)
        parts.save(f"{tmp_path}/{i}")
        parts.drop()
        parts = suffix_dedup.SuffixIndex.open(spark, f"{tmp_path}/{i}")
    rows = lambda x: sorted((k, tuple(r)) for k, v in x.levels.items() for level in v for r in level.collect())
    assert rows(parts) == rows(whole)
    empty = suffix_dedup.SuffixIndex(spark)
    empty.save(f"{tmp_path}/none")
    assert suffix_dedup.SuffixIndex.open(spark, f"{tmp_path}/none").add(batch(0)).count() == 0

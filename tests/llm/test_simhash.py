import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute, tables
from tripleweave.llm import simhash
from tripleweave.llm.components import components


def _classes(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_documents_match_brute_force(spark):
    given = tables.rows()
    got = {r.doc_id: (r.h, r.component_id) for r in simhash.near_duplicates(tables.frame(spark)).withColumn("h", simhash.hexadecimal(F.col("fp"))).collect()}
    assert got == brute.classes(given)


def test_dense_and_chained_fingerprints_lose_no_link(spark):
    """Small tiles force the hot path: one dense ball, one long chain, random ones."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre ^ (1 << a | 1 << b) for a in range(64) for b in range(a)} | {centre}
    at = r.getrandbits(64)
    for _ in range(60):
        for b in r.sample(range(64), 4):
            at ^= 1 << b
        fps.add(at)
    fps |= {r.getrandbits(64) for _ in range(500)}
    signed = [int(np.uint64(f).view(np.int64)) for f in sorted(fps)]
    fp = F.col("fp")
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node long, fp long").select("node", F.unhex(simhash.hexadecimal(fp)).alias("bits"), F.bit_count(fp).cast("long").alias("c"), simhash._bands(fp, 4).alias("bands"))
    for tile in (32, 300, 100_000):
        out = components(simhash.links(df, tile=tile)).collect()
        groups = {}
        for x in out:
            groups.setdefault(x.root, set()).add(signed[x.node])
        assert {frozenset(g) for g in groups.values()} == _classes(signed)


def test_components_of_a_path_and_hub(spark):
    links = [(i, i + 1) for i in range(100, 300)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 4), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 301)} | {i: 1 for i in range(1, 60)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    r = random.Random(1)
    a, b, c = (tables.words(r, 100) for _ in range(3))
    given = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, c), (4, c), (None, tables.words(r, 90)), (None, c)]
    lone = given[7][1]
    docs = tables.frame(spark, given)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(x.doc_id), x.text) for x in out.collect()) == sorted([("1", a), ("2", b), ("4", c), ("None", lone)])
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_keeps_the_least_id_of_each_group(spark):
    r = random.Random(8)
    given = tables.rows()
    for i in range(30):  # two words of some hundred changed, in chains
        w = tables.words(r, r.randint(150, 400), 5000).split()
        for j in range(3):
            given.append((1000 + 3 * i + j, " ".join(w)))
            for _ in range(2):
                w[r.randrange(len(w))] = f"new{r.random()}"
    want = sorted(set(brute.similar(given).values()))
    assert sorted(x.doc_id for x in simhash.one_of_each(tables.frame(spark, given)).collect()) == want


def test_wide_signatures_match_the_definition():
    from tripleweave.llm.wordhash import Words, mixed

    def plain(text):
        words = Words([text], simhash._VALUES)
        n, out = len(words.hashes), 0
        h = words.runs(min(n, 5))[0][: max(1, n - 4)] if n else []
        for w, salt in enumerate(simhash._SALTS):
            each = [int(mixed(np.array([x]) + salt)[0]) for x in h]
            out |= sum(1 << 64 * w + b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each))
        return out

    texts = [b"", b"One", b"a b c d", b"A b c d e f g", None, b"x y z " * 200, b"a b c d e f g"]
    bits, counts, bands = simhash.wide_signatures(texts, 5)
    for t, x, c in zip(texts, bits, counts.tolist()):
        assert int.from_bytes(x, "little") == plain(t or b"") and c == plain(t or b"").bit_count()
    assert bits[3] == bits[6] and bands[3] == bands[6] and bands[0] == bands[4] and len(bands[0]) == simhash.BANDS


def test_radius_grows_with_the_distance():
    assert 155 < simhash.radius_for(0.8) < 180 and simhash.radius_for(0.9) < simhash.radius_for(0.8) and simhash.radius_for(1.0) == 0


def test_one_of_each_goes_by_the_jaccard_of_shingle_sets(spark):
    """A repeated line changes no set; pairs just above and below the similarity, short texts, and all of it with small tiles."""
    r, given = random.Random(4), []
    for i, (n, times) in enumerate(((804, 10), (404, 6), (1504, 15))):
        text = tables.words(r, n, 5000)
        given += [(10 * i, text), (10 * i + 1, text + ("\n" + tables.words(r, 10, 5000)) * times)]
    for i in range(40):  # a cut end: Jaccard from 0.76 to 0.84
        w = tables.words(r, 304, 5000).split()
        given += [(100 + 2 * i, " ".join(w)), (101 + 2 * i, " ".join(w[: 4 + round(300 * (0.76 + i / 500))]))]
    given += [(200, "a b c d e f g h"), (201, "a b c d e f g h i"), (202, "a b c d e f g x y")]
    want = sorted(set(brute.similar(given).values()))
    assert {0, 10, 20, 100, 101, 178, 200, 202} <= set(want) and not {1, 11, 21, 179, 201} & set(want)
    docs = tables.frame(spark, given)
    assert sorted(x.doc_id for x in simhash.one_of_each(docs).collect()) == want


def test_exact_links_of_a_hot_band_in_small_tiles(spark):
    r = random.Random(6)
    base = tables.words(r, 204, 5000).split()
    given = [(i, " ".join(base[: 204 - i % 100] + [f"n{i}-{j}" for j in range(i % 3 * 20)])) for i in range(150)]
    want = brute.similar(given)
    docs = tables.frame(spark, given).select("doc_id", "text").withColumn("place", F.xxhash64("text"))
    ids = simhash.signatures(docs, "text", ("doc_id", "place"), 5, ("bits", "c", "bands"))
    nodes = ids.select(F.col("doc_id").alias("node"), "bits", "c", F.array(F.lit(1).cast("long")).alias("bands"), "place")
    radius = simhash.radius_for(0.8, deviations=simhash.DEVIATIONS)
    for tile in (20, 1000):
        got = {x.node: x.root for x in components(simhash.links(nodes, radius, tile, simhash.Exact(docs, "text", 5, 0.8))).collect()}
        assert {i: got.get(i, i) for i, _ in given} == want


def test_no_stage_of_the_near_copies_has_two_steps_in_python(spark, monkeypatch):
    """Each step in Python within a stage has a worker of its own for each task; the workers stay."""

    def most(node, above=0):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(node.initialPlan())
        here = 0 if "Exchange" in name else above + ("Arrow" in name or "Python" in name)
        below = node.children()
        return max([here, *(most(below.apply(i), here) for i in range(below.size()))])

    seen, plain = {}, simhash.written

    def written(df, name):
        seen[name] = max(seen.get(name, 0), most(df._jdf.queryExecution().executedPlan()))
        return plain(df, name)

    monkeypatch.setattr(simhash, "written", written)
    assert simhash.one_of_each(plain(tables.frame(spark), "docs")).count() < len(tables.rows())
    assert seen["signatures"] == 1 and max(seen.values()) == 1, seen

"""Near-duplicates by SimHash fingerprints and tiled exact comparison.

Fingerprints are compared exactly: numpy exclusive-or and bit counts over tiles of at most TILE
fingerprints, and a tile pair whose population counts differ beyond the radius is skipped, since it
holds no link. Tiles are formed within the values of bands, so that not all pairs of documents meet:

* 64-bit fingerprints and a small radius: of ``radius + 1`` bands of the bits one at least is equal in
  two linked fingerprints. No link is lost.
* Wide signatures (WIDE bits) for a Jaccard similarity of shingle sets such as 0.8, which 64 bits can't
  tell: their radius is a fifth of the bits, so the bands are of MinHash values instead: two texts of
  that similarity share none of the BANDS bands of ROWS values with probability
  (1 - 0.8 ** ROWS) ** BANDS, 2 in 10,000. Signatures count each distinct shingle once and only name
  candidates, within DEVIATIONS standard deviations; a pair is linked if the sets of its shingles'
  64-bit hashes have that similarity. Sets are made for candidates alone. (The radius loses next to
  none, but of sets of four and five shingles 2 in 10,000.)

A band value with more than TILE members (a hot group of near copies) is dealt out as tiles to many
tasks, and then as those pairs of tiles, of near population counts, that can join two components.
Equal fingerprints are compared once, whatever their number; a task returns at most one link for each
fingerprint it read, so dense groups don't return all their pairs.

Defined cases: a text without words (null, empty) has fingerprint 0, linked like any other. Rows with
a null document id take part but name no component; a component of such rows only has a null id.
Repeated rows fall into one component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.components import components
from tripleweave.llm.scratch import dropped, written
from tripleweave.llm.sieve import bitmap, place_of, sifted, without_keys
from tripleweave.llm.textmap import arrow_map, unused, with_text_columns
from tripleweave.llm.wordhash import Words, byte_values, mixed

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Fingerprints in a tile at most, where a band value has more.
TILE = 1024
#: Rows of a comparison matrix within a group.
BLOCK = 256
_CHUNK = 1 << 15

#: Bits of wide signatures, and the MinHash bands that bring them together.
WIDE, BANDS, ROWS = 1024, 16, 4
SIMILARITY = 0.8
#: How far beyond the expected distance at the similarity a pair is still a candidate.
DEVIATIONS = 7
_LANES = np.uint64(0x0101010101010101)
_VALUES = byte_values(bytes(b for b in range(256) if b not in b" \t\n\v\f\r"), fold_case=True)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    n, ones = len(stops), np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and the fingerprint as a signed 64-bit integer."""

    def kernel(texts: list[bytes | None]) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return with_text_columns(docs, text, keep, [T.StructField(name, T.LongType())], kernel)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def _bands(fp: Column, radius: int) -> Column:
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def radius_for(similarity: float, bits: int = WIDE, deviations: float = 2) -> int:
    """The distance of signatures of sets with this Jaccard similarity, and some standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of rows (``first``: where it begins, and the end), how often each of the 64 bits is set. Bits are counted in the bytes of 64-bit words, 255 rows at a time."""
    n = np.diff(first)
    parts = -(-n // 255)
    own = np.repeat(first[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    at, out = np.concatenate([[0], np.cumsum(parts)[:-1]]), np.empty((len(n), BITS), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, own).view(np.uint8).reshape(-1, 8)
        out[:, k::8] = np.add.reduceat(lanes, at, axis=0, dtype=np.int64)
    return out


def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles in lower case, ascending within each text, and where each text's begin (one entry more than texts); fewer words than a shingle are one."""
    words = Words(texts, _VALUES)
    n_words = np.diff(words.first)
    h, whole = words.runs(shingle)
    for m in range(1, shingle):
        short = words.first[:-1][n_words == m]
        if len(short):
            h[short], whole[short] = words.runs(m)[0][short], True
    h, owner = h[whole], np.repeat(np.arange(len(texts)), n_words)[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Eight bytes for each set, to tell sets of equal signatures apart."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + _SALTS[0]), dtype=np.uint64)])
    return [x.tobytes() for x in sums[first[1:]] - sums[first[:-1]]]


def wide_signatures(texts: list[bytes | None], shingle: int) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
    """Signature, population count and band values of each text, over its distinct shingles."""
    return _signed(*shingle_sets(texts, shingle))


def _signed(h: np.ndarray, first_of: np.ndarray) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
    n = np.diff(first_of)
    there = np.flatnonzero(n)
    bits, low = np.zeros((len(n), WIDE // BITS), np.uint64), np.zeros((len(n), BANDS * ROWS), np.uint64)
    if len(there):
        first = np.concatenate([[0], np.cumsum(n[there])])
        for w in range(WIDE // BITS):
            ones = 2 * _sums(mixed(h + _SALTS[w]), first) > n[there][:, None]
            bits[there, w] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        for i in range(BANDS * ROWS):
            low[there, i] = np.minimum.reduceat(h * _ODD[i], first[:-1])
    bands = np.zeros((len(n), BANDS), np.uint64)
    for i in range(ROWS):
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + low[:, i::ROWS])
    bands = mixed(bands + np.arange(BANDS, dtype=np.uint64)[None, :])
    return [x.tobytes() for x in bits], np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bands.view(np.int64).tolist()


_ODD = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.Generator(np.random.PCG64(SEED + 1)).integers(0, 1 << 63, WIDE // BITS, np.uint64)


def _hits(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius; a pair is left as soon as its first words differ in more bits."""
    x, y = np.nonzero(np.bitwise_count(a[:, :1] ^ b[None, :, 0]) <= radius)
    far = np.zeros(len(x), np.int64)
    for w in range(a.shape[1] if a.shape[1] > 1 else 0):
        far += np.bitwise_count(a[x, w] ^ b[y, w])
        near = far <= radius
        if not near.all():
            x, y, far = x[near], y[near], far[near]
    return x, y


def _joined(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items, the smallest item that the pairs connect it to."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            return root


def _group_links(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row, a row that it is linked with through others or itself. fp: a row of words each, in order of the population count."""
    n, pairs, count = len(fp), [], np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            if int(count[j]) - int(count[min(i + BLOCK, n) - 1]) > radius:
                break
            a, b = _hits(fp[i : i + BLOCK], fp[j : j + BLOCK], radius)
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                pairs.append((a + i, b + j))
    return _joined(n, pairs)


def _signatures_of(bits: list[bytes]) -> np.ndarray:
    """A row of words each; of a wide signature, without the digest behind it."""
    return np.frombuffer(b"".join(x[: WIDE // 8] for x in bits), np.uint64).reshape(len(bits), -1)


def _compare(radius: int):
    """A link for each node that has one in its group, of rows in order of the population count."""

    def linked(node: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        root = _group_links(_signatures_of(bits), radius)
        at = np.flatnonzero(root != np.arange(len(node)))
        return node[at], node[root[at]]

    return _by_group(linked, ["u", "v"])


def _candidates(radius: int):
    """The nodes that chains of distances within the radius connect in a group, under a hash of them all: what several bands bring together is one group again."""

    def near(node: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        root = _group_links(_signatures_of(bits), radius)
        several = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        several = several[np.lexsort((node[several], root[several]))]
        edges = np.flatnonzero(np.diff(root[several], prepend=-1, append=-1)).tolist() if len(several) else [0]
        names = [np.full(b - a, xxhash.xxh64_intdigest(node[several[a:b]].tobytes()), np.uint64) for a, b in zip(edges, edges[1:])]
        return np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64), node[several]

    return _by_group(near, ["g", "node"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _verified(radius: int, similarity: float):
    """Links by exact similarity of shingle sets; pairs that others connect already are not tested."""

    def linked(node: np.ndarray, bits: list[bytes], shingles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        fp, sets = _signatures_of(bits), [np.frombuffer(x, np.uint64) for x in shingles]
        root, n = np.arange(len(node)), len(node)
        for i in range(0, n, BLOCK):
            x, y = _hits(fp[i : i + BLOCK], fp, radius)
            x, y = x[x + i < y] + i, y[x + i < y]
            for a in np.unique(x).tolist():
                others = y[x == a]
                while len(others := others[root[others] != root[a]]):
                    if _alike(sets[a], sets[others[0]], similarity):
                        low, high = sorted((root[a], root[others[0]]))
                        root[root == high] = low
                    others = others[1:]
        at = np.flatnonzero(root != np.arange(n))
        return node[at], node[root[at]]

    return _by_group(linked, ["u", "v"])


def _by_group(made: Callable[..., tuple[np.ndarray, np.ndarray]], names: list[str]):
    """Reads rows (group, node, binary columns) sorted by group; holds one group at a time besides the batch. ``made`` gets the nodes and columns of each group of several rows."""

    def results(g: np.ndarray, node: np.ndarray, rest: list[list[bytes]]) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        several = np.diff(edges) > 1
        got = [made(node[a:b], *[x[a:b] for x in rest]) for a, b in zip(edges[:-1][several].tolist(), edges[1:][several].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*got) if got else ((), ()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, node, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in (whole.slice(i, TILE) for whole in batches for i in range(0, whole.num_rows, TILE)):
            g = np.concatenate([g, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            more = [x.to_pylist() for x in batch.columns[2:]]
            rest = [a + b for a, b in zip(rest, more)] if rest else more
            cut = _last_run(g)
            if cut:
                yield results(g[:cut], node[:cut], [x[:cut] for x in rest])
                g, node, rest = g[cut:], node[cut:], [x[cut:] for x in rest]
        if len(g):
            yield results(g, node, rest)

    return run


def _last_run(g: np.ndarray) -> int:
    """Where the last run of equal values begins."""
    other = np.flatnonzero(g != g[-1])
    return int(other[-1]) + 1 if len(other) else 0


def _compared(rows: DataFrame, distinct: DataFrame, radius: int, exact: Exact | None) -> DataFrame:
    """Links within the groups of rows (g, node, c)."""
    whole = rows.join(distinct.select("node", "bits"), "node")
    grouped = whole.repartition("g").sortWithinPartitions("g", "c").select("g", "node", "bits")
    if exact is None:
        return written(arrow_map(grouped, _compare(radius), "u long, v long"), "links")
    near = written(arrow_map(grouped, _candidates(radius), "g long, node long").distinct(), "near")
    sets = exact.sets(near.select("node").distinct().join(distinct.select("node", "bits", "place"), "node"))
    whole = near.join(sets, "node").repartition("g").sortWithinPartitions("g").select("g", "node", "bits", "shingles")
    out = written(arrow_map(whole, _verified(radius, exact.similarity), "u long, v long"), "links")
    dropped(near, sets)
    return out


@dataclass(frozen=True)
class Exact:
    """Where the shingle sets of candidates are made from."""

    docs: DataFrame
    text: str
    shingle: int
    similarity: float

    @property
    def texts(self) -> DataFrame:
        """``text`` and ``place``, a hash that finds it again."""
        return self.docs.select(self.docs[self.text].cast("string").alias("text")).withColumn("place", F.xxhash64("text"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node``, ``bits``, ``shingles`` for rows (node, bits, place); texts of other places aren't shuffled."""
        nodes = written(nodes.withColumn("digest", F.substring("bits", WIDE // 8 + 1, 8)), "candidates")
        shingle = self.shingle

        def kernel(texts: list[bytes | None]) -> list:
            h, first = shingle_sets(texts, shingle)
            return [digests(h, first), [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]]

        # Written, since two steps in Python within a stage have two workers for each task, which stay and take turns in all later stages.
        maybe = written(sifted(self.texts, "place", bitmap(nodes, place_of(F.col("place"))), True), "maybe")
        made = with_text_columns(maybe, "text", ("place",), [T.StructField(n, T.BinaryType()) for n in ("digest", "shingles")], kernel)
        made = made.groupBy("place", "digest").agg(F.first("shingles").alias("shingles"))
        out = written(nodes.join(made, ["place", "digest"]).select("node", "bits", "shingles"), "sets")
        dropped(nodes, maybe)
        return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, exact: Exact | None = None) -> DataFrame:
    """``u``, ``v``: links between nodes that connect exactly what chains of distances within the radius (with ``exact``, of those that also have its similarity), between nodes with a band in common, connect.

    distinct: one row for each fingerprint: ``node`` (long, 0 or more), ``bits`` (binary), ``c`` (its population count), ``bands`` (longs).

    First each band value with up to ``tile`` members is compared whole, others tile by tile without
    pairs of tiles. What that connects needs no comparison among itself, so of the pairs of tiles only those
    are made that can join two components: a dense group of any size costs its size, not its square.
    """
    every = distinct.select("node", "c", F.explode(F.array_distinct("bands")).alias("band"))
    met = every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(met.select("band", F.ceil(F.col("n") / tile).cast("int").alias("k")), "bands")
    group = F.when(F.col("k") > 1, F.xxhash64("band", F.pmod(F.xxhash64("node"), F.col("k")))).otherwise(F.xxhash64("band"))
    first = _compared(every.join(met, "band").select(group.alias("g"), "node", "c"), distinct, radius, exact)
    large = met.where("k > 1").select("band")
    if large.isEmpty():
        dropped(met)
        return first
    roots = written(components(first), "roots")
    members = every.join(large, "band").join(roots, "node", "left").select("band", "node", "c", F.coalesce("root", "node").alias("root"))
    members = written(members, "members")
    giants = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("band", "root", F.lit(True).alias("giant"))
    width = max(1, radius // 4)
    of = F.when(F.col("giant"), F.col("root")).otherwise(F.lit(-1))  # a giant's tiles hold it alone
    placed = written(members.join(giants, ["band", "root"], "left").select("band", "node", "c", of.alias("of"), F.floor(F.col("c") / width).alias("bin")), "placed")
    tiles = placed.groupBy("band", "of", "bin").agg(F.count(F.lit(1)).alias("n")).select("band", "of", "bin", F.ceil(F.col("n") / tile).cast("int").alias("k"))
    other = tiles.select("band", F.col("of").alias("of2"), F.col("bin").alias("bin2"), F.col("k").alias("k2"))
    joins_two = (F.col("of") != F.col("of2")) | (F.col("of") == -1)
    partners = (
        tiles.join(other, "band")
        .where((F.abs(F.col("bin") - F.col("bin2")) <= -(-radius // width)) & joins_two)
        .groupBy("band", "of", "bin")
        .agg(F.first("k").alias("k"), F.collect_list(F.struct("of2", "bin2", "k2")).alias("with"))
    )
    dealt = placed.join(partners, ["band", "of", "bin"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    named = lambda x, i: F.struct(x["of2"].alias("of"), x["bin2"].alias("bin"), i.alias("t"))
    pairs = F.flatten(F.transform("with", lambda x: F.transform(F.sequence(F.lit(0), x["k2"] - 1), lambda i: named(x, i))))
    dealt = dealt.select("node", "c", "band", F.struct("of", "bin", "t").alias("own"), F.explode(pairs).alias("p"))
    a, b = F.least("own", "p"), F.greatest("own", "p")
    group = F.xxhash64("band", a["of"], a["bin"], a["t"], b["of"], b["bin"], b["t"])
    second = _compared(dealt.select(group.alias("g"), "node", "c"), distinct, radius, exact)
    dropped(met, members, placed)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(second)


def classes(marked: DataFrame, radius: int, exact: Exact | None = None) -> DataFrame:
    """``bits``, ``root`` (of its component), ``component_id`` for each fingerprint of ``marked`` (doc_id, bits, c, bands; with ``exact``, place)."""
    firsts = ("c", "bands") if exact is None else ("c", "bands", "place")
    distinct = marked.groupBy("bits").agg(F.min("doc_id").alias("least"), *[F.first(n).alias(n) for n in firsts])
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots = components(links(distinct, radius, exact=exact))
    member = written(roots.join(distinct.select("node", "bits", "least"), "node").select("bits", "root", "least"), "member")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(least, "root").select("bits", "root", "component_id", F.lit(True).alias("linked"))
    alone = F.col("linked").isNull()
    return distinct.join(linked, "bits", "left").select("bits", F.coalesce("root", "node").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the smallest id in the row's component), one row for each row; by 64-bit fingerprints."""
    fps = fingerprints(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), shingle=shingle)
    marked = written(fps.withColumn("bits", F.unhex(hexadecimal(F.col("fp")))), "fp")
    of = classes(marked.withColumn("c", F.bit_count("fp").cast("long")).withColumn("bands", _bands(F.col("fp"), radius)), radius)
    return marked.join(of, "bits").select("doc_id", "fp", "component_id")


def signatures(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int, names: tuple[str, str, str]) -> DataFrame:
    """The kept columns and, under ``names``, the wide signature with the set's digest behind it, its population count and its band values."""
    kinds = (T.BinaryType(), T.LongType(), T.ArrayType(T.LongType()))

    def kernel(texts: list[bytes | None]) -> list:
        h, first = shingle_sets(texts, shingle)
        bits, count, bands = _signed(h, first)
        return [[a + b for a, b in zip(bits, digests(h, first))], count, bands]

    return with_text_columns(docs, text, keep, [T.StructField(n, k) for n, k in zip(names, kinds)], kernel)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, shingle: int = 5) -> DataFrame:
    """One row, with all its columns, of each group of near copies (chains of pairs whose shingle sets have the similarity): a row with the smallest document id, or any row where all ids are null.

    Rows that surely stay pass without a shuffle; see ``sieve``.
    """
    names = tuple(unused(docs.columns, n) for n in ("bits", "c", "bands"))
    marked = signatures(docs, text, tuple(docs.columns), shingle, names)
    placed = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("place", F.xxhash64("text"))
    ids = written(signatures(placed, "text", ("doc_id", "place"), shingle, ("bits", "c", "bands")), "signatures")
    of = written(classes(ids, radius_for(similarity, deviations=DEVIATIONS), Exact(docs, text, shingle, similarity)), "classes")
    chosen = F.col("doc_id") == F.col("component_id")
    by_id = ids.select("doc_id", "bits").join(of, "bits").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(chosen, 1)).alias("n_chosen"))
    by_id = written(by_id, "by-id")
    out = without_keys(docs.where(docs[doc_id].isNotNull()), doc_id, by_id.where("(n > 1 or n_chosen = 0) and doc_id is not null"), "doc_id")
    if not by_id.where("n > 1 or doc_id is null").isEmpty():  # repeated or null ids: the rows are told apart by their signatures too
        often = by_id.where("n > 1").select("doc_id")
        least = ids.select("doc_id", "bits").join(often, "doc_id", "left_semi").join(of, "bits").where(chosen).groupBy("doc_id", "root").agg(F.min("bits").alias("bits")).select("doc_id", "bits")
        nameless = of.where("component_id is null").groupBy("root").agg(F.min("bits").alias("bits")).select(F.lit(None).cast(ids.schema["doc_id"].dataType).alias("doc_id"), "bits")
        which = least.union(nameless).select(F.col("doc_id").alias("__id"), F.col("bits").alias("__bits"))
        more = marked.join(which, marked[doc_id].eqNullSafe(which["__id"]) & (marked[names[0]] == which["__bits"]), "left_semi")
        out = out.unionByName(more.dropDuplicates([doc_id, names[0]]).select(*docs.columns))
    return out

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is a set of shingles that a document must contain whole. So a document that has
the window has each shingle of it, the rarest too: the necessary prefix is that one shingle. Shingles
are ordered by how often all documents hold them; document shingles are joined with the windows' prefix
shingles; a hit's place in its window gives the window's place in the document (positional bound),
which must lie within the document (length bound); what remains is compared word by word.

The benchmark stays a table, of any size. All that goes to the workers is a bitmap of fixed size of its
shingles' hashes: a document's shingles without a bit are no benchmark's, the others go to the join
with the few words around them. Documents are scanned twice and never shuffled, but for their row
numbers.

Defined cases: a null or empty text has no words, no hits and no items; so has an item without words.
An item with a null id marks words as hit but is in no list. Repeated items count once by id.
Repeated document rows are judged each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tripleweave.llm.scratch import dropped, written
from tripleweave.llm.sieve import BITS, bitmap, without_keys
from tripleweave.llm.textmap import arrow_map, pieces, unused
from tripleweave.llm.wordhash import Words, byte_values

WINDOW, SHINGLE, MIN_ITEMS = 8, 4, 2
#: Hits in a row of the table of hits; a document with more has several rows.
HITS = 4096

_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_VALUES = byte_values(_WORD_BYTES, fold_case=True)
_MASK = (1 << BITS) - 1
_HIT = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.LongType()), T.StructField("first", T.LongType()), T.StructField("near", T.StringType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``w`` (a window's words, space-joined), ``m`` (how many), ``shingles`` (hashes, in order), ``item``: a row for each window of each item."""
    kind = benchmark.schema[item_id].dataType
    out = T.StructType([T.StructField("w", T.StringType()), T.StructField("m", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("item", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 0):
                words = Words(texts, _VALUES)
                lower = [words.word(i).lower().decode("utf-8", "replace") for i in range(len(words.starts))]
                runs = {k: words.runs(k)[0].view(np.int64) for k in range(1, shingle + 1)}
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    m = min(b - a, window)
                    k, starts = min(m, shingle), range(a, b - m + 1) if m else ()
                    made = [[" ".join(lower[s : s + m]) for s in starts], [m] * len(starts), [runs[k][s : s + m - k + 1] for s in starts]]
                    items = part.column(1).take(pa.array([i] * len(starts), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(made, out)], items], names=out.names)

    return arrow_map(benchmark.select(benchmark[text].cast("string"), benchmark[item_id]), run, out)


def _bits(hashes: DataFrame) -> bytes:
    """Two bits for each value of the column h."""
    h = F.col("h")
    two = F.array(h.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(h, BITS).bitwiseAND(F.lit(_MASK)))
    return bitmap(hashes.select(F.explode(two).alias("at")), F.col("at"))


def _there(h: np.ndarray, enough: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where h, among those in ``enough``, has its bits."""
    at = np.flatnonzero(enough)
    for shift in (0, BITS):
        place = (h[at] >> np.uint64(shift)) & np.uint64(_MASK)
        at = at[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def shingle_counts(docs: DataFrame, text: str, bits: bytes, widths: list[int]) -> DataFrame:
    """``h``, ``n``: how often all documents hold a shingle, of those with their bits set."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for _, texts in pieces(batch, 0):
                words = Words(texts, _VALUES)
                for k in widths:
                    h, enough = words.runs(k)
                    of, n = np.unique(h[_there(h, enough, table)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return arrow_map(docs.select(docs[text].cast("string")), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _marked(docs: DataFrame, text: str, keep: tuple[str, ...], bits: bytes, widths: list[int], window: int) -> DataFrame:
    """A row for each document: its number ``r``, ``n_words``, the kept columns as k0.., and ``hits``: shingles with their bits set, with the words around. Further rows, without n_words, have what is beyond HITS."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(docs[text].cast("string").alias("text"), F.monotonically_increasing_id().alias("r"), *[docs[c].alias(n) for c, n in zip(keep, names)])
    out = T.StructType([T.StructField("r", T.LongType()), *[T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names)], T.StructField("n_words", T.LongType()), T.StructField("hits", _HIT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for part, texts in pieces(batch, 0):
                words = Words(texts, _VALUES)
                found = [(h, at) for h, at in ((h, _there(h, enough, table)) for h, enough in map(words.runs, widths)) if len(at)]
                at = np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]])
                h = np.concatenate([np.zeros(0, np.uint64), *[h[x] for h, x in found]]).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                edges, first = np.searchsorted(at, words.first).tolist(), words.first.tolist()
                numbers, which, n_words, hits = part.column(1).to_pylist(), [], [], []

                def rows(i: int) -> Iterator[list[dict]]:
                    a, b = first[i], first[i + 1]
                    for x in range(edges[i], edges[i + 1], HITS):
                        here = slice(x, min(x + HITS, edges[i + 1]))
                        yield [
                            {"h": v, "at": p - a, "first": max(a, p - window + 1) - a, "near": b" ".join(words.word(j).lower() for j in range(max(a, p - window + 1), min(b, p + window))).decode("utf-8", "replace")}
                            for v, p in zip(h[here].tolist(), at[here].tolist())
                        ]

                def flushed() -> pa.RecordBatch:
                    index = pa.array([i if n is not None else None for i, n in zip(which, n_words)], pa.int64())
                    kept = [c.take(index) for c in part.columns[2:]]
                    return pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in which], pa.int64()), *kept, pa.array(n_words, pa.int64()), pa.array(hits, to_arrow_type(_HIT))], names=out.names)

                for i in range(len(texts)):
                    for j, got in enumerate(rows(i) if edges[i] < edges[i + 1] else [[]]):
                        which.append(i)
                        n_words.append(None if j else first[i + 1] - first[i])
                        hits.append(got)
                        if len(got) == HITS:
                            yield flushed()
                            which, n_words, hits = [], [], []
                yield flushed()

    return arrow_map(source, run, out)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (r, [first, end]) the maximal runs."""
    for batch in batches:
        spans = []
        for got in batch.column(1).to_pylist():
            runs: list[dict] = []
            for x in sorted(got, key=lambda x: (x["first"], x["end"])):
                if runs and x["first"] <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], x["end"])
                else:
                    runs.append(x)
            spans.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, to_arrow_type(_SPANS))], names=["r", "spans"])


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and ``n_words``, ``spans`` (maximal runs of hit words: first, end) and ``items`` (ids whose windows occur, sorted as strings)."""
    rows = written(windows(benchmark, item_text, item_id, window, shingle), "windows-of-items")
    each = written(rows.groupBy("w").agg(F.first("m").alias("m"), F.first("shingles").alias("shingles")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    items_of = written(rows.join(each, "w").where("item is not null").select("wid", "item").distinct(), "items-of")
    widths = sorted(r.k for r in each.select(F.least("m", F.lit(shingle)).alias("k")).distinct().collect())
    shingles = each.select("wid", F.posexplode("shingles").alias("o", "h"))
    counts = written(shingle_counts(docs, text, _bits(shingles.select("h")), widths), "shingle-counts")
    # A window that no document's shingles cover has no row here, and occurs nowhere.
    rarest = shingles.join(counts, "h").groupBy("wid").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "o", "h")).alias("x"))
    prefixes = each.join(rarest, "wid").where(F.col("known") == F.size("shingles")).select("wid", "w", "m", "x.o", "x.h")
    prefixes = written(prefixes, "prefixes")
    marked = written(_marked(docs, text, keep, _bits(prefixes.select("h")), widths, window), "marked")

    hits = marked.where(F.size("hits") > 0).select("r", F.explode("hits").alias("hit")).select("r", "hit.*")
    totals = marked.where("n_words is not null")
    start = F.col("at") - F.col("o")
    held = F.array_join(F.slice(F.split("near", " "), (start - F.col("first") + 1).cast("int"), F.col("m")), " ")
    candidates = hits.join(prefixes, "h").where((start >= 0) & (start >= F.col("first")))
    found = candidates.where(held == F.col("w")).select("r", "wid", start.alias("first"), (start + F.col("m")).alias("end"))
    found = written(found, "found")
    spans = arrow_map(found.groupBy("r").agg(F.collect_set(F.struct("first", "end")).alias("got")), _merged, T.StructType([T.StructField("r", T.LongType()), T.StructField("spans", _SPANS)]))
    named = F.transform(F.array_sort(F.transform(F.collect_set("item"), lambda x: F.struct(x.cast("string").alias("s"), x.alias("x")))), lambda s: s["x"])
    items = found.select("r", "wid").distinct().join(items_of, "wid").groupBy("r").agg(named.alias("items"))
    none = F.array().cast(T.ArrayType(benchmark.schema[item_id].dataType))
    out = totals.drop("hits").join(spans, "r", "left").join(items, "r", "left")
    dropped(rows, each, counts)
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("n_words").alias(unused(keep, "n_words")),
        F.coalesce("spans", F.array().cast(_SPANS)).alias(unused(keep, "spans")),
        F.coalesce("items", none).alias(unused(keep, "items")),
    )


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the digest of the items' ids, and whether ``min_items`` or more items occur."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return with_hits(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which fewer than ``min_items`` items occur. Rows are told apart by their texts' length and two hashes, 96 bits; clean ones aren't shuffled."""
    name = unused(docs.columns, "place")
    whole = docs[text].cast("string")
    placed = docs.withColumn(name, F.concat_ws("-", F.octet_length(whole), F.xxhash64(whole), F.crc32(whole.cast("binary"))))
    leaks = with_hits(placed, benchmark, text, (name,)).where(F.size(unused((name,), "items")) >= min_items)
    return without_keys(placed, name, written(leaks.select(F.col(name).alias("place")).distinct(), "leaks"), "place").select(*docs.columns)


def digest(items: list) -> str:
    """What ``report`` gives as items_sha256 for these ids."""
    return hashlib.sha256(",".join(sorted({str(x) for x in items})).encode()).hexdigest()

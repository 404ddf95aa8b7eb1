"""Exact removal of long repeats with a logarithmic family of sparse suffix arrays.

A byte goes if it is covered by a string of ``match`` bytes that starts anywhere else too. Only
suffixes at anchors are indexed (see ``anchors``): equal windows have equal anchors, so two equal
windows always meet under one entry, and an index has about one entry for 140 bytes.

The index is a family of levels. Each batch of documents gets its suffix array: entries sorted by the
hash of the anchor's bytes, then by the hash of all bytes of the anchor's windows, with counts. It is
merge-scanned against each level (a sort-merge join) for anchors that occur before or in the batch
itself. Levels of one size merge into one of twice the size, so n batches cost log n merges of an entry.

What the scan finds is then decided exactly. Runs of windows that occur whole more than once go whole.
Other runs under an anchor found are compared window by window: a hash of each window of one run of
each kind. Anchors with more than HOT_KINDS kinds of runs (a passage in very many contexts) are not
gathered in a group: their windows are exploded and counted. Texts are scanned again for that, and
only those that hold such runs are shuffled.

Beside that, passages of over fifty words that other documents have too are counted, which may be
shorter than ``match`` (see ``passages``); they are not removed.

Texts are told apart by the first 128 bits of their SHA-256, windows by 128 bits (anchor and window).

Defined cases: a null text is empty. A text shorter than ``match`` keeps all. Matches never cross
documents; repeated rows are copies of each other, so their texts go whole if long enough. Extra
columns are ignored. Ties need no order: strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.anchors import GRAM, Sums, runs
from tripleweave.llm.passages import grams, shared_words
from tripleweave.llm.scratch import dropped, tidied, written
from tripleweave.llm.sieve import BITS, bitmap
from tripleweave.llm.textmap import arrow_map, pieces, with_text_columns

MATCH, BATCHES = 400, 4
#: Runs of this many kinds are compared in one group at most, some 5 MB.
HOT_KINDS = 4096

_LEVEL = "gram long, span long, n long"
_RUN = np.dtype([("gram", "<u8"), ("span", "<u8"), ("low", "<i8"), ("width", "<i4")])


class SuffixIndex:
    """The family of levels. ``add`` takes a batch's entries (gram, span), and returns the grams that occur elsewhere too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, {}

    def _sorted(self, entries: DataFrame) -> DataFrame:
        return written(entries.groupBy("gram", "span").agg(F.sum("n").alias("n")).sortWithinPartitions("gram", "span"), "level")

    def _merge(self) -> None:
        for size in sorted(self.levels):
            while len(same := self.levels.get(size, [])) > 1:
                a, b, *rest = same
                self.levels[size] = rest
                self.levels.setdefault(2 * size, []).append(self._sorted(a.union(b)))
                dropped(a, b)

    def add(self, entries: DataFrame) -> DataFrame:
        while any(len(v) > 1 for v in self.levels.values()):
            self._merge()
        new = self._sorted(entries.withColumn("n", F.lit(1).cast("long")))
        found = new.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
        mine = new.select("gram").distinct()
        for level in (x for v in self.levels.values() for x in v):
            found = found.union(mine.join(level.select("gram").distinct(), "gram", "left_semi"))
        found = written(found.distinct(), "found")
        self.levels.setdefault(1, []).append(new)
        return found

    def save(self, path: str) -> None:
        """Writes the levels to a new folder, for :meth:`open`; a saved family is never changed."""
        every = self.spark.createDataFrame([], f"{_LEVEL}, size int, level int")
        for size, same in self.levels.items():
            for i, level in enumerate(same):
                every = every.union(level.select("gram", "span", "n", F.lit(size).alias("size"), F.lit(i).alias("level")))
        every.sortWithinPartitions("size", "level", "gram", "span").write.option("compression", "zstd").partitionBy("size", "level").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        """The family that was saved there; the next batches are merge-scanned against it and merge with it."""
        out, saved = cls(spark), spark.read.schema(f"{_LEVEL}, size int, level int").parquet(path)
        for size, level in sorted(map(tuple, saved.select("size", "level").distinct().collect())):
            out.levels.setdefault(size, []).append(saved.where((F.col("size") == size) & (F.col("level") == level)).select("gram", "span", "n"))
        return out

    def drop(self) -> None:
        dropped(*(x for v in self.levels.values() for x in v))
        self.levels = {}


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def suffixes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """The kept columns under names k0.., ``n_bytes``, ``sha`` of the text, its halves ``a``, ``b``, all its runs, packed, and its ``n_words`` and word grams (see ``passages``)."""

    def kernel(texts: list[bytes | None]) -> list:
        shas = [hashlib.sha256(t or b"").digest() for t in texts]
        found = runs([t or b"" for t in texts], match, gram)
        rows = np.zeros(len(found["low"]), _RUN)
        rows["gram"], rows["span"], rows["low"], rows["width"] = found["gram"], found["span"], found["low"], found["high"] - found["low"]
        bounds = np.searchsorted(found["text"], np.arange(len(texts) + 1)).tolist()
        a, b = zip(*map(_halves, shas)) if shas else ((), ())
        return [[len(t or b"") for t in texts], shas, list(a), list(b), [rows[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], *grams(texts)]

    named = docs.select(docs[text].alias("text"), *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = (("n_bytes", T.LongType()), ("sha", T.BinaryType()), ("a", T.LongType()), ("b", T.LongType()), ("runs", T.BinaryType()), ("n_words", T.LongType()), ("grams", T.BinaryType()))
    return with_text_columns(named, "text", tuple(f"k{i}" for i in range(len(keep))), [T.StructField(n, k) for n, k in kinds], kernel)


def _exploded(table: DataFrame) -> DataFrame:
    """A row for each run of each text: a, b, gram, span, low, width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            n = [len(x) // _RUN.itemsize for x in packed]
            rows = np.frombuffer(b"".join(packed), _RUN)
            ids = [np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1)]
            columns = [*ids, rows["gram"].view(np.int64) if len(rows) else np.zeros(0, np.int64), np.ascontiguousarray(rows["span"]).view(np.int64), rows["low"], rows["width"]]
            for i in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + (1 << 16)])) for c in columns], names=["a", "b", "gram", "span", "low", "width"])

    return arrow_map(table.select("a", "b", "runs"), run, "a long, b long, gram long, span long, low long, width int")


def _texts(docs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """``a``, ``b``, ``text`` for the keys (columns a, b), each once, with few other texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(keys, F.col("a").bitwiseAND(F.lit((1 << BITS) - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for _, texts in pieces(batch, 0):
                found = []
                for t in texts:
                    if t:
                        a, b = _halves(hashlib.sha256(t).digest())
                        bit = a & ((1 << BITS) - 1)
                        if bits[bit >> 3] >> (bit & 7) & 1 and (a, b) not in seen:
                            seen.add((a, b))
                            found.append((a, b, t))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "text"])

    scanned = arrow_map(docs.select(docs[text].cast("string")), run, "a long, b long, text binary")
    return scanned.groupBy("a", "b").agg(F.first("text").alias("text"))


def _window_hashes(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, texts, wanted = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for x, y, t, runs_of in zip(a, b, texts, wanted):
                for r in runs_of:
                    data = np.frombuffer(t, np.uint8)[r["low"] : r["low"] + r["width"] + match]
                    rows.append((r["gram"], r["hot"], x, y, r["low"], r["n"], Sums(data).windows(0, r["width"], match).tobytes()))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["gram", "hot", "a", "b", "low", "n", "windows"]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _stretches(low: int, hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
    return [(low + x, low + y - 1) for x, y in zip(edge[0::2], edge[1::2])]


def _compared() -> object:
    """Rows come sorted by gram; whole grams are compared at once."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(r[5]) // 8 for r in rows]
        hashes = np.frombuffer(b"".join(r[5] for r in rows), np.uint64)
        gram = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
        order = np.lexsort((hashes, gram))
        same = (hashes[order][1:] == hashes[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        hit = np.zeros(len(hashes), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out, at = [], 0
        for r, n in zip(rows, sizes):
            if r[4] == 1 and hit[at : at + n].any():
                out += [(r[1], r[2], x, y) for x, y in _stretches(r[3], hit[at : at + n])]
            at += n
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["a", "b", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(6)))
            if sum(len(r[5]) for r in held) < 8 << 20:
                continue
            cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            if cut:
                yield found(held[:cut])
                held = held[cut:]
        if held:
            yield found(held)

    return run


def _counted(hot: DataFrame) -> DataFrame:
    """The same for grams of many kinds: their windows exploded and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, a, b, low, n, packed = (batch.column(i).to_pylist() for i in range(6))
            for i in range(len(gram)):
                w = np.frombuffer(packed[i], np.int64)
                fixed = [np.full(len(w), x[i], np.int64) for x in (gram, a, b, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fixed[0], w, fixed[1], fixed[2], low[i] + np.arange(len(w)), fixed[3])], names=["gram", "w", "a", "b", "at", "n"])

    rows = arrow_map(hot, run, "gram long, w long, a long, b long, at long, n long")
    several = rows.groupBy("gram", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "w")
    return rows.where("n = 1").join(several, ["gram", "w"], "left_semi").select("a", "b", F.col("at").alias("low"), F.col("at").alias("high"))


def _removed(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts = [], []
            for got in batch.column(2).to_pylist():
                merged: list[list[int]] = []
                for low, high in sorted((x["low"], x["high"]) for x in got):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high + match)
                    else:
                        merged.append([low, high + match])
                spans.append([{"first": x, "end": y} for x, y in merged])
                counts.append(sum(y - x for x, y in merged))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["a", "b", "n_removed", "spans"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            h, at = hashlib.sha256(), 0
            for s in spans:
                h.update(t[at : s["first"]])
                at = s["end"]
            h.update(t[at:])
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "kept"])


def repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), match: int = MATCH, batches: int = BATCHES, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """The kept columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_passage_words`` (words in passages that other documents have too) and ``spans`` (first, end of what goes)."""
    spark = docs.sparkSession
    table = written(suffixes(docs, text, keep, match), "suffixes")
    passages = shared_words(table, lambda keys: _texts(docs, text, keys))
    tidied(spark)
    index, found = SuffixIndex(spark), []
    for b in range(batches):
        part = table.where(F.pmod(F.col("b"), F.lit(batches)) == b)
        found.append(index.add(_exploded(part).select("gram", "span")))
    index.drop()
    tidied(spark)
    anchored = found[0]
    for f in found[1:]:
        anchored = anchored.union(f)
    anchored = written(anchored.distinct(), "grams")  # a table, so that the join can be split where a gram is hot
    several = written(_exploded(table).join(anchored, "gram", "left_semi"), "runs")
    dropped(anchored, *found)
    tidied(spark)

    kinds = several.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "low", "width")).alias("one"))
    kinds = written(kinds, "kinds")
    whole = several.join(kinds.where("n > 1").select("gram", "span"), ["gram", "span"], "left_semi").select("a", "b", "low", (F.col("low") + F.col("width")).alias("high"))
    whole = written(whole.distinct(), "whole")

    of = written(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds-of")
    detail = kinds.join(of, "gram").select("one.a", "one.b", F.struct("gram", "n", "one.low", "one.width", (F.col("kinds") > hot_kinds).alias("hot")).alias("r"))
    detail = written(detail.groupBy("a", "b").agg(F.collect_list("r").alias("wanted")), "detail")
    dropped(several, kinds, of)
    joined = _texts(docs, text, detail).join(detail, ["a", "b"]).select("a", "b", "text", "wanted")
    windows = written(arrow_map(joined, _window_hashes(match), "gram long, hot boolean, a long, b long, low long, n long, windows binary"), "windows")
    tidied(spark)
    columns = ("gram", "a", "b", "low", "n", "windows")
    usual = windows.where("not hot").select(*columns).repartition("gram").sortWithinPartitions("gram")
    parts = arrow_map(usual, _compared(), "a long, b long, low long, high long").union(_counted(windows.where("hot").select(*columns)))

    marks = whole.union(parts).groupBy("a", "b").agg(F.collect_set(F.struct("low", "high")).alias("got"))
    span = "array<struct<first:bigint,end:bigint>>"
    marks = arrow_map(marks, _removed(match), f"a long, b long, n_removed long, spans {span}")
    names = [f"k{i}" for i in range(len(keep))]
    judged = table.select(*names, "n_bytes", "sha", "a", "b").join(marks, ["a", "b"], "left")
    judged = written(judged.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))), "judged")
    dropped(whole, detail, windows)
    partly = judged.where("n_removed > 0 and n_removed < n_bytes").select("a", "b", "spans")
    texts = _texts(docs, text, partly)
    kept = arrow_map(texts.join(partly, ["a", "b"]).select("a", "b", "text", "spans"), _kept, "a long, b long, kept string").distinct()
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = judged.join(kept, ["a", "b"], "left").join(passages, ["a", "b"], "left")
    digest = F.when(F.col("n_removed") == 0, F.lower(F.hex("sha"))).when(F.col("n_removed") == F.col("n_bytes"), empty).otherwise(F.col("kept"))
    spans = F.coalesce("spans", F.array().cast(span))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_bytes", "n_removed", F.size(spans).cast("long").alias("n_spans"), digest.alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"), spans.alias("spans"))


def without_repeats(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What stays of a text."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])

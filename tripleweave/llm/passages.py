"""Word passages that several documents share.

A passage is a run of ``window`` words, compared in their exact bytes, that another document holds
too. Every window has one gram, its run of ``gram`` words with the least hash; equal windows have equal
grams. So only windows whose gram stands in two texts are compared, by hash. All sharing is found by
counts (least and greatest text of a gram or window), which are combined before the shuffle: a passage
in very many documents is no hot group.

Defined cases: a text of fewer words than a window shares nothing. Rows with equal texts share all
their words. A repeat within one document is no shared passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.anchors import least
from tripleweave.llm.scratch import dropped, tidied, written
from tripleweave.llm.textmap import arrow_map, pieces
from tripleweave.llm.wordhash import Words, byte_values

#: Words of a passage at least, and of a gram.
WINDOW, GRAM = 51, 8
_VALUES = byte_values(bytes(b for b in range(256) if b not in b" \t\n\v\f\r"), fold_case=False)


def _least_grams(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window (by its first word) the gram, and where the windows are."""
    at = np.flatnonzero(words.left() >= window)
    if not len(at):
        return np.zeros(0, np.uint64), at
    return least(words.runs(gram)[0], window - gram + 1)[at], at


def grams(texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM) -> tuple[list[int], list[bytes]]:
    """Of each text the number of words, and the distinct grams of its windows, packed."""
    words = Words(texts, _VALUES)
    of, at = _least_grams(words, window, gram)
    edges = np.searchsorted(at, words.first)
    return np.diff(words.first).tolist(), [np.unique(of[a:b]).tobytes() for a, b in zip(edges, edges[1:])]


def _unpacked(table: DataFrame) -> DataFrame:
    """``gram``, ``a``, ``b`` from the packed column ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            n, rows = [len(x) // 8 for x in packed], np.frombuffer(b"".join(packed), np.int64)
            columns = [rows, *(np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1))]
            for i in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["gram", "a", "b"])

    return arrow_map(table.select("a", "b", "grams"), run, "gram long, a long, b long")


def _windows(window: int, gram: int):
    """From rows (t, text, grams of it that others have too): t, the windows' hashes and first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 1):
                words = Words(texts, _VALUES)
                of, at = _least_grams(words, window, gram)
                h, edges = words.runs(window)[0], np.searchsorted(at, words.first)
                for t, first, a, b, wanted in zip(part.column(0).to_pylist(), words.first.tolist(), edges, edges[1:], part.column(2).to_pylist()):
                    here = at[a:b][np.isin(of[a:b], np.array(wanted, np.int64).view(np.uint64))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), t, np.int64)), pa.array(h[here].view(np.int64)), pa.array((here - first).astype(np.int32))], names=["t", "h", "at"])

    return run


def _in_two(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The keys that stand in two texts at least."""
    ends = rows.groupBy(key).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    return ends.where("low < high").select(key)


def shared_words(table: DataFrame, texts_of, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``a``, ``b``, ``n_passage_words``: how many words of a text stand in windows that other rows' texts have too, where there are any.

    table: a row for each document, with the key a, b of its text and what :func:`grams` gives as
    ``n_words`` and ``grams``. texts_of: from a table of keys to their texts (a, b, text).
    """
    spark, every = table.sparkSession, _unpacked(table)
    common = written(_in_two(every, "gram", "a"), "common-grams")
    near = every.join(common, "gram", "left_semi").groupBy("a", "b").agg(F.collect_set("gram").alias("wanted"))
    near = written(near.withColumn("t", F.monotonically_increasing_id()), "near")
    dropped(common)
    joined = texts_of(near).join(near, ["a", "b"]).select("t", "text", "wanted")
    rows = written(arrow_map(joined, _windows(window, gram), "t long, h long, at int"), "passages")
    tidied(spark)
    shared = written(_in_two(rows, "h", "t"), "shared")
    starts = rows.join(shared, "h", "left_semi").groupBy("t").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # Words from each start on to the next, at most the window's.
    step = lambda s, x: F.struct((s["n"] + F.least(x - s["to"] + window, F.lit(window))).alias("n"), (x + window).alias("to"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("long")
    found = written(starts.select("t", covered.alias("n_passage_words")), "covered")
    tidied(spark)
    copies = table.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words")).where((F.col("n") > 1) & (F.col("n_words") >= window))
    both = near.join(found, "t").select("a", "b", "n_passage_words").union(copies.select("a", "b", "n_words"))
    out = written(both.groupBy("a", "b").agg(F.max("n_passage_words").alias("n_passage_words")), "shared-words")
    dropped(near, rows, shared, found)
    return out

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector is the
product of its letters' vectors, the first rotated twice and the second once, so order counts. A
document's vector is the sum over its trigrams, a language's prototype the sum over its documents of
unit length. A document gets the language whose prototype has the largest cosine with it.

Letters are compared in lower case; each run of other characters is one boundary, a symbol like a
letter. Vectors are made by array operations for each distinct trigram of a batch, never for each
place in a text. Prototypes are summed as integers, so their sum doesn't depend on how rows are dealt.

The model is fitted on a bounded sample: of each language at most about MAX_TRAINING labelled
documents, chosen by a hash of their id, all of each text. Only sums of one vector for each language and task are shuffled.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as are all texts if
nothing is labelled. Of equal cosines the first language by name wins. Repeated rows are judged alike.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.textmap import arrow_map, pieces, unused, with_text_columns

DIMENSIONS, SEED = 1024, 7
MAX_TRAINING = 20_000
UNKNOWN = "und"
_SCALE = 1 << 24
#: Cells of the matrices made at once.
_CELLS = 8 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its letter's number in lower case plus one, and 0 for other characters."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = (ord(low) if len(low) == 1 else c) + 1
    return out


@lru_cache(maxsize=1 << 14)
def letter_vector(number: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Of a letter's number; 0 is the boundary."""
    return np.random.Generator(np.random.PCG64([SEED, number])).integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)


class Grams:
    """The trigrams of a list of texts: ``key`` of each distinct one (three columns of letter numbers), and for each place its text and distinct trigram."""

    def __init__(self, texts: list[bytes | None]):
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        newline = np.cumsum([len((t or b"").decode("utf-8", "replace")) + 1 for t in texts], dtype=np.int64) - 1 if texts else np.zeros(0, np.int64)
        x = np.concatenate([np.zeros(1, np.int32), _letters()[points]])
        newline = newline + 1
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        place = np.cumsum(keep) - 1
        bounds = np.concatenate([[0], place[newline]])
        x = x[keep]
        self.has_letter = np.diff(bounds) > 1
        if len(x) < 3:
            self.key, self.text, self.gram = np.zeros((0, 3), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        whole = np.ones(len(x) - 2, bool)
        crossing = bounds[1:] - 1
        whole[crossing[(crossing >= 0) & (crossing < len(whole))]] = False
        letters = np.flatnonzero(np.bincount(x))
        number = np.zeros(int(letters[-1]) + 1, np.int64)
        number[letters] = np.arange(len(letters))
        y, a = number[x], len(letters)
        code = ((y[:-2] * a + y[1:-1]) * a + y[2:])[whole]
        self.text = (np.searchsorted(bounds, np.arange(len(x) - 2), "right") - 1)[whole]
        if a**3 <= 1 << 22:
            there = np.flatnonzero(np.bincount(code, minlength=1))
            index = np.zeros(a**3, np.int64)
            index[there] = np.arange(len(there))
            self.gram = index[code]
        else:
            there, self.gram = np.unique(code, return_inverse=True)
        self.key = letters[np.stack([there // (a * a), there // a % a, there % a], axis=1)] if len(there) else np.zeros((0, 3), np.int32)

    def vectors(self, n_texts: int, dimensions: int = DIMENSIONS) -> np.ndarray:
        """A row for each text: the sum of its trigrams' vectors."""
        out = np.zeros((n_texts, dimensions), np.float32)
        if not len(self.key):
            return out
        letters, of = np.unique(self.key, return_inverse=True)
        of = of.reshape(self.key.shape)
        base = np.stack([letter_vector(int(c), dimensions) for c in letters]).astype(np.float32)
        rolled = [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
        step = max(1, _CELLS // (2 * dimensions))
        for g in range(0, len(self.key), step):
            part = of[g : g + step]
            vectors = rolled[0][part[:, 0]] * rolled[1][part[:, 1]] * rolled[2][part[:, 2]]
            inside = (self.gram >= g) & (self.gram < g + step)
            text, gram, m = self.text[inside], self.gram[inside] - g, len(part)
            rows = max(1, _CELLS // m)
            for t in range(0, n_texts, rows):
                a, b = np.searchsorted(text, [t, t + rows])
                n = min(rows, n_texts - t)
                out[t : t + n] += np.bincount((text[a:b] - t) * m + gram[a:b], minlength=n * m).reshape(n, m).astype(np.float32) @ vectors
        return out


def unit_vectors(texts: list[bytes | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """A row of length 1 (or 0, without letters) for each text, and which texts have letters."""
    grams = Grams(texts)
    v = grams.vectors(len(texts), dimensions)
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    return v / np.maximum(norm, 1e-9)[:, None], grams.has_letter


def held_out(doc_id: Column) -> Column:
    """Documents that the query never learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dimensions: int = DIMENSIONS, max_training: int = MAX_TRAINING) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, from rows with a language. A language with more than ``max_training`` rows is learned from about so many, chosen by a hash of ``key``; any other from all its rows."""
    rows = labelled.where(labelled[lang].isNotNull())
    large = rows.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_training).collect()
    if large:
        limits = F.create_map(*[F.lit(x) for r in large for x in (r.lang, int((1 << 30) * max_training / r.n))])
        limit = F.coalesce(F.try_element_at(limits, F.col(lang).cast("string")), F.lit(1 << 30))
        rows = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < limit)
    rows = rows.select(F.col(text).cast("string"), F.col(lang).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in pieces(batch, 0):
                v, _ = unit_vectors(texts, dimensions)
                v, of = np.rint(v * _SCALE).astype(np.int64), np.array(part.column(1).to_pylist(), object)
                for name in set(of.tolist()):
                    sums[name] = sums.get(name, 0) + v[of == name].sum(axis=0)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    sums = arrow_map(rows, run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # one number for each language and dimension
        out.setdefault(r.lang, np.zeros(dimensions))[r.i] = r.x
    return {k: v / max(float(np.sqrt((v**2).sum())), 1e-9) for k, v in sorted(out.items())}


def predicted(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), dimensions: int = DIMENSIONS) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` (the cosine, 0 at least)."""
    names, matrix = list(prototypes), np.stack(list(prototypes.values())).astype(np.float32) if prototypes else None

    def kernel(texts: list[bytes | None]) -> list:
        if matrix is None:
            return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
        v, letters = unit_vectors(texts, dimensions)
        cosine = v @ matrix.T
        best = cosine.argmax(axis=1)
        score = np.where(letters, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0).astype(np.float64)
        return [[names[i] if x else UNKNOWN for i, x in zip(best.tolist(), letters.tolist())], score]

    return with_text_columns(docs, text, keep, [T.StructField(unused(keep, "lang_pred"), T.StringType()), T.StructField(unused(keep, "score"), T.DoubleType())], kernel)

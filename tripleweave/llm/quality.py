"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once. The ledger holds each document's measurements and one integer with a
bit for each rule that it fails. Policies are versions: a policy is a mask of rules, so applying one,
or finding what would change without a rule, is integer arithmetic on the ledger and never reads the
texts again.

Defined cases: a null or empty text has no words and all measurements are 0. Words are split at
ASCII white space only. Repeated rows are judged each on its own. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.textmap import text_column, unused, with_text_columns
from tripleweave.llm.wordhash import Words, byte_values

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: A rule's place is its bit; rules are added at the end and never moved. Each is SQL over the measurements and says when a document fails.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)

#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
PRODUCTION = "v1"

_SPACES = b" \t\n\v\f\r"
_VALUES = byte_values(bytes(b for b in range(256) if b not in _SPACES), fold_case=False)


def repeat_counts(words: Words) -> np.ndarray:
    """For each text, how many of its words stand in 8-word windows that it has twice or more. Windows are found by hash and compared by bytes."""
    n_texts = len(words.first) - 1
    h, whole = words.runs(WINDOW)
    at = np.flatnonzero(whole)
    text = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((at, h[at], text))
    at, text = at[order], text[order]
    same = (h[at][1:] == h[at][:-1]) & (text[1:] == text[:-1]) if len(at) else np.zeros(0, bool)
    candidates = np.zeros(len(at), bool)
    candidates[1:] |= same
    candidates[:-1] |= same
    out = np.zeros(n_texts, np.int64)
    if not candidates.any():
        return out
    seen: dict[tuple[int, bytes], int] = {}
    marks = np.zeros(len(words.hashes) + 1, np.int64)

    def mark(i: int) -> None:
        marks[i] += 1
        marks[i + WINDOW] -= 1

    for i, t in zip(at[candidates].tolist(), text[candidates].tolist()):
        key = (t, b" ".join(words.word(j) for j in range(i, i + WINDOW)))
        if key in seen:
            if seen[key] >= 0:
                mark(seen[key])
                seen[key] = -1
            mark(i)
        else:
            seen[key] = i
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def measure(texts: list[bytes | None]) -> list:
    """The columns MEASURES of these texts."""
    words = Words(texts, _VALUES)
    n_words = np.diff(words.first)
    chars, symbols, dups, lines = [], [], [], []
    for t in texts:
        t = t or b""
        chars.append(len(t.translate(None, _SPACES).decode("utf-8", "replace")))
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        worded = [x for x in t.split(b"\n") if x.strip()]
        lines.append(len(worded))
        dups.append(len(worded) - len(set(worded)))
    return [n_words, chars, symbols, dups, repeat_counts(words), lines]


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _bits(names: dict[str, str]) -> Column:
    """The failure bits, where the measurement m is in the column names[m]."""

    def fails(rule: str) -> Column:
        for m in sorted(names, key=len, reverse=True):
            rule = rule.replace(m, f"`{names[m]}`")
        return F.expr(rule)

    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails(r), F.lit(1 << i)).otherwise(0) for i, (_, r) in enumerate(RULES)]).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the measurements and ``fail_bits``; where a kept column has such a name, the ledger's gets underscores before it."""
    names = {m: unused(keep, m) for m in MEASURES}
    measured = with_text_columns(docs, text, keep, [T.StructField(names[m], T.LongType()) for m in MEASURES], measure)
    return measured.withColumn(unused(keep, "fail_bits"), _bits(names))


def verdict(fail_bits: Column, policy: str = PRODUCTION) -> Column:
    """True where no rule of the policy fails."""
    return fail_bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it rejects (that is, what is kept more without it). One row for each set of failure bits is all that is shuffled."""
    m = mask(policy)
    sums = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if m >> i & 1])
    return (
        sums.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_rejected_alone"),
        )
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the policy doesn't reject. Only the texts go to the workers."""
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def kernel(texts: list[bytes | None]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measure(texts)], list(MEASURES))

    measured = unused(docs.columns, "measured")
    book = docs.withColumn(measured, text_column(docs, text, kind, kernel))
    bits = _bits({m: f"{measured}`.`{m}" for m in MEASURES})
    return book.where(verdict(bits, policy)).select(*docs.columns)

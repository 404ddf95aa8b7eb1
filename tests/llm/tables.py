"""Small documents with the cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, fp string, `copy` int, fail_bits string, score string"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows(seed=5):
    """(doc_id, text) with nulls, empty, blank and very long texts, exact and near copies, repeated rows and lines."""
    r = random.Random(seed)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, "É ñ ß 漢字 \u00a0 x"), (7, None), (8, "a" * 1500), (9, "# * $ % & | < > " * 30)]
    base = [words(r, 200) for _ in range(6)]
    out += [(10 + i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(base[:3])]
    for i, t in enumerate(base[:3]):  # near copies
        w = t.split()
        w[50 + i] = "changed"
        out.append((30 + i, " ".join(w).upper() if i == 2 else " ".join(w)))
    passage = words(r, 120)
    out += [(40 + i, words(r, 60) + " " + passage + " " + words(r, 60)) for i in range(5)]
    out += [(50, "same line here\n" * 40), (51, words(r, 20) + "\n" + (words(r, 10) + "\n") * 3), (52, words(r, 60_000, 5000)), (53, passage + "\n" + passage)]
    return out


def frame(spark, given=None):
    given = rows() if given is None else given
    full = [(d, t, None if d is not None and d % 7 == 0 else "en", None if d == 3 else ["big", "big", "s1", "s2"][(d or 0) % 4], len(t or ""), 9, "x", "y", 3, "z", "s") for d, t in given]
    return spark.createDataFrame(full, SCHEMA).repartition(3)

"""Joins of solution tables. Columns are variables; shared names are equal in a solution."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural(left: DataFrame, right: DataFrame, shared: list[str] | None = None) -> DataFrame:
    """Inner join on the shared variables; without any, all pairs, as the algebra asks."""
    shared = [c for c in left.columns if c in right.columns] if shared is None else shared
    return left.join(right, shared, "inner") if shared else left.crossJoin(right)


def reduced(left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
    """The rows of left that have a partner; the sets intersect where left has only the shared variables."""
    return left.join(right.select(*shared), shared, "left_semi")


def intersection(sets: list[DataFrame], column: str) -> DataFrame:
    """Values in all of k candidate sets of one variable: a chain of semi-joins from the first set."""
    return reduce(lambda a, b: reduced(a, b, [column]), sets)


def existing(left: DataFrame, triples: DataFrame) -> DataFrame:
    """All rows of left if any triple is there, else none. The other side has one row at most."""
    return left.crossJoin(triples.limit(1).select())


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [x for n in range(len(names) + 1) for x in combinations(names, n)]


def _bound(df: DataFrame, names: list[str], unbound: tuple[str, ...]) -> DataFrame:
    """The rows where, of these variables, exactly ``unbound`` have no value."""
    for c in names:
        df = df.where(F.col(c).isNull() if c in unbound else F.col(c).isNotNull())
    return df


def optional(left: DataFrame, right: DataFrame, certain: set[str], when: Column | None = None, certain_right: set[str] | None = None) -> DataFrame:
    """Left outer join of compatible solutions: on shared variables they are equal, or unbound on one side.

    A shared variable that may be unbound (one that isn't in ``certain``, or on the right in
    ``certain_right``, by default all) makes no nested loop: each side is split by what is unbound, and
    each pair of parts is an equi-join on what both have bound.

    when: a further condition, over right columns under their names with ``__r`` after them and left columns.
    """
    shared = [c for c in left.columns if c in right.columns]
    new = [c for c in right.columns if c not in shared]
    renamed = right.select(*[F.col(c).alias(f"{c}__r") for c in right.columns])
    when = F.lit(True) if when is None else when
    open_left = [c for c in shared if c not in certain]
    open_right = [c for c in shared if certain_right is not None and c not in certain_right]
    out = [F.coalesce(c, f"{c}__r").alias(c) if c in open_left else F.col(c) for c in left.columns] + [F.col(f"{c}__r").alias(c) for c in new]

    def on(free: tuple[str, ...]) -> Column:
        return reduce(lambda a, c: a & (F.col(c) == F.col(f"{c}__r")), [c for c in shared if c not in free], when)

    if not open_left and not open_right:
        return left.join(renamed, on(()), "left").select(*out)
    kinds = dict(right.dtypes)
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in new]
    parts = []
    for free in _subsets(open_left):
        rows = alone = _bound(left, open_left, free)
        for free_right in _subsets(open_right):
            partners = _bound(renamed, [f"{c}__r" for c in open_right], tuple(f"{c}__r" for c in free_right))
            parts.append(rows.join(partners, on(free + free_right), "inner").select(*out))
            alone = alone.join(partners, on(free + free_right), "left_anti")
        parts.append(alone.select(*left.columns, *nothing))
    return reduce(DataFrame.unionAll, parts)

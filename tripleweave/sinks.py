"""Results as text and as JSON, row by row: nothing holds a whole result."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

_LITERAL = re.compile(r'"(.*)"(?:@(.+)|\^\^<(.*)>)?', re.DOTALL)


def rows(df: DataFrame) -> Iterator[tuple[str | None, ...]]:
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield tuple(r)


def tab_separated(df: DataFrame) -> Iterator[str]:
    """A header of variables, then rows; an unbound variable is empty."""
    yield "\t".join(f"?{c}" for c in df.columns)
    for r in rows(df):
        yield "\t".join("" if x is None else x.replace("\t", "\\t").replace("\n", "\\n") for x in r)


def _w3c(term: str) -> dict[str, str]:
    if term.startswith("<"):
        return {"type": "uri", "value": term[1:-1]}
    if term.startswith("_:"):
        return {"type": "bnode", "value": term[2:]}
    m = _LITERAL.fullmatch(term)
    if not m:
        return {"type": "literal", "value": term}
    out = {"type": "literal", "value": m[1]}
    return out | ({"xml:lang": m[2]} if m[2] else {}) | ({"datatype": m[3]} if m[3] else {})


def json_chunks(df: DataFrame, w3c: bool = False) -> Iterator[str]:
    """``{"head": {"vars": ["?x"]}, "results": {"bindings": [["…"]]}}``; with w3c the standard's objects, names without ``?``."""
    names = df.columns
    yield json.dumps({"vars": names if w3c else [f"?{c}" for c in names]}).join(('{"head": ', ', "results": {"bindings": ['))
    first = True
    for r in rows(df):
        row = {c: _w3c(x) for c, x in zip(names, r) if x is not None} if w3c else [x or "" for x in r]
        yield ("" if first else ",") + json.dumps(row, ensure_ascii=False)
        first = False
    yield "]}}"

"""Terms are compared as exact strings; only \\uXXXX and \\UXXXXXXXX are turned into their characters, in data and in queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

_ESCAPE = re.compile(r"(?<!\\)\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")


def plain(term: str) -> str:
    """The term with its \\u escapes as characters."""
    if "\\" not in term:
        return term
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), term)


def plain_column(term: Column) -> Column:
    """The same for a column, by built-in functions; terms without such escapes pass unchanged."""
    found = F.array_distinct(F.regexp_extract_all(term, F.lit(r"(?<!\\)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"), F.lit(1)))
    character = lambda m: F.decode(F.unhex(F.lpad(F.substring(m, 3, 8), 8, "0")), "UTF-32")
    return F.when(term.contains("\\u") | term.contains("\\U"), F.aggregate(found, term, lambda s, m: F.replace(s, m, character(m)))).otherwise(term)


def iri(text: str) -> str:
    return f"<{text}>"


def literal(text: str) -> str:
    """A plain literal of a value without quotes or backslashes."""
    return f'"{text}"'


def lexical(term: Column) -> Column:
    """What a term says: an IRI without brackets, a literal without quotes, language and type."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'(?s)^"(.*)"', 1)).when(term.startswith("<"), F.regexp_extract(term, r"(?s)^<(.*)>$", 1)).otherwise(term)

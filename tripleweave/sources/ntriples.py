"""Triple text: one triple a line, subject, predicate and object up to the final dot.

White space of any kind separates; dots within the object stay; empty lines and lines that begin with
``#`` are skipped; a line that isn't a triple is not loaded, and kept apart so that it can be counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions.terms import plain_column

LINE = r"^\s*(\S+)\s+(\S+)\s+(\S.*?)\s*\.\s*$"


@dataclass
class Loaded:
    """``triples`` (s, p, o; repeats not yet removed) and ``malformed`` (line)."""

    triples: DataFrame
    malformed: DataFrame


def parsed(lines: DataFrame, column: str = "value") -> Loaded:
    """Lines to triples; works on static and streaming DataFrames."""
    line = F.col(column)
    said = lines.where(~line.rlike(r"^\s*(#|$)"))
    good = said.where(line.rlike(LINE))
    triples = good.select(*[plain_column(F.regexp_extract(line, LINE, i)).alias(n) for i, n in enumerate("spo", 1)])
    return Loaded(triples, said.where(~line.rlike(LINE)).select(line.alias("line")))


def ntriples(spark: SparkSession, path: str | list[str]) -> Loaded:
    """Files or folders, compressed or not; Spark splits large files."""
    return parsed(spark.read.text(path))


def write_ntriples(triples: DataFrame, path: str, compression: str = "none") -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(path, compression=compression)


def queries_in(path: str) -> list[str]:
    """A query file has one query a line; empty lines are skipped."""
    return [x for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]

"""Relational tables as triples.

A row's subject is ``<http://ex.org/KIND/KEY>``, its class triple names ``<http://ex.org/class/KIND>``;
foreign keys become IRIs, other columns plain literals. Only strings, integers and dates become
literals, since systems print floating-point numbers differently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.functions.terms import RDF_TYPE

BASE = "http://ex.org/"


@dataclass(frozen=True)
class Mapping:
    """``links``: predicate -> (column, kind it refers to); ``literals``: column names, which are the predicates."""

    table: str
    kind: str
    key: tuple[str, ...]
    links: tuple[tuple[str, str, str], ...] = ()
    literals: tuple[str, ...] = ()


MAPPINGS = (
    Mapping("region", "region", ("r_regionkey",), (), ("r_name",)),
    Mapping("nation", "nation", ("n_nationkey",), (("n_region", "n_regionkey", "region"),), ("n_name",)),
    Mapping("customer", "customer", ("c_custkey",), (("c_nation", "c_nationkey", "nation"),), ("c_mktsegment",)),
    Mapping("supplier", "supplier", ("s_suppkey",), (("s_nation", "s_nationkey", "nation"),), ("s_name",)),
    Mapping("part", "part", ("p_partkey",), (), ("p_brand", "p_type", "p_size")),
    Mapping("orders", "order", ("o_orderkey",), (("o_cust", "o_custkey", "customer"),), ("o_orderstatus", "o_orderpriority")),
    Mapping(
        "lineitem", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        (("l_order", "l_orderkey", "order"), ("l_part", "l_partkey", "part"), ("l_supp", "l_suppkey", "supplier")), ("l_returnflag",),
    ),
    Mapping("events", "event", ("event_id",), (("e_user", "user_id", "customer"),), ("event_type",)),
)


def node(kind: str, *key: Column) -> Column:
    parts = [x for c in key for x in (F.lit("-"), c.cast("string"))][1:]
    return F.concat(F.lit(f"<{BASE}{kind}/"), *parts, F.lit(">"))


def predicate(name: str) -> str:
    return f"<{BASE}{name}>"


def pairs(m: Mapping) -> list[tuple[str, Column]]:
    """Predicate and object of each triple that a row gives."""
    out = [(RDF_TYPE, F.lit(f"<{BASE}class/{m.kind.capitalize()}>"))]
    out += [(predicate(p), node(kind, F.col(c))) for p, c, kind in m.links]
    return out + [(predicate(c), F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))) for c in m.literals]


def mapped(df: DataFrame, m: Mapping) -> DataFrame:
    """The triples of one table: each row is read once and exploded."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs(m)]))
    rows = df.select(node(m.kind, *map(F.col, m.key)).alias("s"), each.alias("t"))
    return rows.select("s", "t.p", "t.o").where("s is not null and o is not null")


def _names(mappings: tuple[Mapping, ...]) -> list[str]:
    return [p for m in mappings for p, *_ in m.links] + [c for m in mappings for c in m.literals]


def _labels(spark: SparkSession, mappings: tuple[Mapping, ...]) -> DataFrame:
    """A label for each predicate."""
    labels = F.explode(F.array(*[F.struct(F.lit(predicate(n)).alias("s"), F.lit(f'"{n}"').alias("o")) for n in _names(mappings)]))
    return spark.range(1).select(labels.alias("t")).select("t.s", "t.o")


def triples(spark: SparkSession, folder: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All triples of the mapped tables, and ``same_as`` from each region to itself and a label for each predicate."""
    parts = [mapped(spark.read.parquet(f"{folder}/{m.table}.parquet"), m) for m in mappings]
    region = spark.read.parquet(f"{folder}/region.parquet").select(node("region", F.col("r_regionkey")).alias("s"))
    parts.append(region.select("s", F.lit(predicate("same_as")).alias("p"), F.col("s").alias("o")))
    parts.append(_labels(spark, mappings).select("s", F.lit(predicate("label")).alias("p"), "o"))
    return reduce(DataFrame.unionByName, parts)


class Tables:
    """The triples of :func:`triples`, one predicate at a time, and what the mapping alone says of terms.

    Terms are of kinds, told apart by how they begin: nodes of each mapped kind (``customer``, …), ``class``,
    ``predicate`` and ``literal``. Terms of different kinds differ.
    """

    def __init__(self, spark: SparkSession, folder: str, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.spark, self.folder, self.mappings = spark, folder.rstrip("/"), mappings
        #: Kind -> predicates that its terms can have, as subjects and as objects.
        self.as_subject: dict[str, set[str]] = {"region": {predicate("same_as")}, "predicate": {predicate("label")}}
        self.as_object: dict[str, set[str]] = {"region": {predicate("same_as")}, "literal": {predicate("label")}}
        for m in mappings:
            self.as_subject.setdefault(m.kind, set()).update(p for p, _ in pairs(m))
            for p, kind in [(RDF_TYPE, "class"), *((predicate(p), kind) for p, _, kind in m.links), *((predicate(c), "literal") for c in m.literals)]:
                self.as_object.setdefault(kind, set()).add(p)
        self.predicates = tuple(sorted(set().union(*self.as_subject.values())))

    def table(self, m: Mapping) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{m.table}.parquet")

    def kinds(self, of_objects: bool = False) -> dict[str, set[str]]:
        return self.as_object if of_objects else self.as_subject

    @staticmethod
    def kind_of(term: str) -> str | None:
        if term.startswith('"'):
            return "literal"
        kind, slash, _ = term.removeprefix(f"<{BASE}").partition("/")
        return None if not term.startswith(f"<{BASE}") else kind if slash else "predicate"

    @classmethod
    def end_of(cls, term: str) -> str | None:
        """The kind of a constant as :meth:`ends` has it."""
        kind = cls.kind_of(term)
        return term.removeprefix(f"<{BASE}").removesuffix(">") if kind == "class" else kind

    @staticmethod
    def beginning(kind: str) -> str:
        """What all terms of a kind begin with."""
        return {"literal": '"', "predicate": f"<{BASE}"}.get(kind, f"<{BASE}{kind}/")

    def ends(self, p: str) -> set[tuple[str, str]]:
        """The kinds of subject and object that this predicate's triples can have; a class is a kind of its own."""
        out = {"same_as": {("region", "region")}, "label": {("predicate", "literal")}}.get(p.removeprefix(f"<{BASE}").removesuffix(">"), set())
        for m in self.mappings:
            objects = {RDF_TYPE: {f"class/{m.kind.capitalize()}"}}.get(p, set()) | {kind for name, _, kind in m.links if predicate(name) == p} | {"literal" for c in m.literals if predicate(c) == p}
            out = out | {(m.kind, o) for o in objects}
        return out

    def implied(self, p: str) -> tuple[str, Callable[[Column], Column]] | None:
        """Where the mapping makes this predicate's object from a whole number in the subject's key: the subject's kind, and the object for a subject. Then all subjects of that kind have the predicate once."""
        found = [(m, column, kind) for m in self.mappings for name, column, kind in m.links if predicate(name) == p]
        if len(found) != 1 or len(self.ends(p)) != 1:
            return None
        (m, column, kind), = found
        types = {f.name: f.dataType for f in self.table(m).schema.fields}
        if column not in m.key or not all(isinstance(types[c], T.IntegralType) for c in m.key):
            return None
        key = f"^<{BASE}{m.kind}/{'-'.join([r'(-?[0-9]+)'] * len(m.key))}>$"
        return m.kind, lambda s: F.concat(F.lit(f"<{BASE}{kind}/"), F.regexp_extract(s, key, m.key.index(column) + 1), F.lit(">"))

    def masked(self, kind: str, bits: dict[str, int], of_objects: bool = False) -> DataFrame:
        """``entity``, ``cs``: terms of a kind with the bits of predicates they have, to be joined by or. Each row of a table gives one row for its subject."""
        parts, left = [], set(bits)
        for m in self.mappings:
            if m.kind == kind and not of_objects:
                has = reduce(Column.bitwiseOR, [F.when(o.isNotNull(), F.lit(bits[p]).cast("long")).otherwise(F.lit(0).cast("long")) for p, o in pairs(m)])
                parts.append(self.table(m).select(node(kind, *map(F.col, m.key)).alias("entity"), has.alias("cs")))
                left -= {p for p, _ in pairs(m)}
        parts += [self.triples(p).select(F.col("o" if of_objects else "s").alias("entity"), F.lit(bits[p]).cast("long").alias("cs")) for p in sorted(left)]
        return reduce(DataFrame.unionByName, parts).where("entity is not null")

    def triples(self, p: str, kind: str | None = None) -> DataFrame:
        """``s``, ``o`` of this predicate, or of its subjects of one kind; repeats are not removed."""
        parts = []
        for m in (m for m in self.mappings if kind in (None, m.kind)):
            for name, o in pairs(m):
                if name == p:
                    parts.append(self.table(m).select(node(m.kind, *map(F.col, m.key)).alias("s"), o.alias("o")))
        if p == predicate("same_as"):
            region = self.spark.read.parquet(f"{self.folder}/region.parquet").select(node("region", F.col("r_regionkey")).alias("s"))
            parts.append(region.select("s", F.col("s").alias("o")))
        if p == predicate("label"):
            parts.append(_labels(self.spark, self.mappings))
        return reduce(DataFrame.unionByName, parts).where("s is not null and o is not null")

    def constants(self) -> list[str]:
        """The terms that the mapping names: predicates and classes that triples have."""
        parts = [self.triples(p).limit(1).select(F.lit(p).alias("t")) for p in self.predicates] + [self.triples(predicate("label")).select("s")]
        parts += [self.triples(RDF_TYPE, m.kind).limit(1).select("o") for m in self.mappings]
        return sorted({r[0] for r in reduce(DataFrame.union, parts).collect()})

    def keys(self, kind: str) -> list[tuple[DataFrame, Column]]:
        """Of a mapped kind or literals, columns that tell its terms apart and the term for a row; whole numbers stay numbers. A key that several columns of tables have, and a literal, is there once; others may repeat."""
        found = [(m, m.key) for m in self.mappings if m.kind == kind]
        found += [(m, (c,)) for m in self.mappings for c in (m.literals if kind == "literal" else [c for _, c, k in m.links if k == kind])]
        parts: dict[tuple[int, bool], list[DataFrame]] = {}
        for m, columns in found:
            table = self.table(m)
            whole = all(isinstance(table.schema[c].dataType, T.IntegralType) for c in columns)
            rows = table.dropna(subset=list({*m.key, *columns})).select(*[F.col(c).cast("long" if whole else "string").alias(f"k{i}") for i, c in enumerate(columns)])
            parts.setdefault((len(columns), whole), []).append(rows)
        out = []
        for (n, _), tables in parts.items():
            rows = reduce(DataFrame.unionByName, tables)
            term = F.concat(F.lit('"'), F.col("k0").cast("string"), F.lit('"')) if kind == "literal" else node(kind, *[F.col(f"k{i}") for i in range(n)])
            out.append((rows if len(tables) == 1 and kind != "literal" else rows.distinct(), term))
        if kind == "literal":
            out.append((self.triples(predicate("label")), F.col("o")))
        return out

    def n_triples(self) -> int:
        """With repeats and triples of nulls."""
        return sum(self.table(m).count() * len(pairs(m)) for m in self.mappings)

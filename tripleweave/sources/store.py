"""The triple store: a folder of Parquet tables.

    spo/, ops/     the set of triples, one copy sorted by subject and one by object
    dict/          term -> id, dense from 1 in term order (one space for all positions)
    ids_spo/       the same triples as ids, sorted by subject (with ``encode``)
    pred_stats/    per predicate: numbers of triples, distinct subjects and distinct objects
    cs_s/, cs_o/   entity -> id of its characteristic set, sorted by entity; cs_s_sets/, cs_o_sets/ id -> predicates
    meta.json     layout and counts

Up to MAX_PARTITIONED predicates, the copies are partitioned by predicate, so a constant predicate
prunes folders; beyond, by a bucket of its hash with the predicate as a column. Sorting gives narrow
statistics to row groups, so constants at the other positions skip most of them.
"""

from __future__ import annotations

import gc
import json
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PARTITIONED, BUCKETS = 1_000, 64


@dataclass
class Meta:
    layout: str
    encoded: bool
    n_triples: int
    n_predicates: int
    n_terms: int = 0
    sets: bool = False


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def removed(spark: SparkSession, path: str) -> None:
    at = _path(spark, path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Removes shuffle files that nothing uses; else they stay until the driver happens to collect its garbage. Events not yet heard still refer to them."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    gc.collect()
    spark._jvm.System.gc()


def _bucket(p: str) -> Column:
    return F.pmod(F.crc32(F.col(p).cast("binary")), F.lit(BUCKETS)).cast("int")


def dense_ids(terms: DataFrame, column: str, at: str, first: int = 1, options: dict[str, str] | None = None, repeats: bool = False) -> DataFrame:
    """``term``, ``id``: ids without gaps in the terms' order. repeats: terms repeat, and are made distinct once they are placed. Terms are range-partitioned and numbered within partitions, in a table at the path ``at``; only the partitions' sizes go to the driver."""
    spark = terms.sparkSession
    placed = terms.select(F.col(column).alias("term")).repartitionByRange("term")
    placed = (placed.dropDuplicates(["term"]) if repeats else placed).sortWithinPartitions("term")
    numbered = placed.withColumn("m", F.monotonically_increasing_id()).select("term", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    numbered.write.mode("overwrite").options(**(options or {})).parquet(at)
    numbered = spark.read.parquet(at)
    sizes = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    base, rows = first, []
    for part, n in sizes:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part long, base long")
    return numbered.join(F.broadcast(bases), "part").select("term", (F.col("base") + F.col("i")).alias("id"))


def characteristic_sets(triples: DataFrame, entity: str) -> DataFrame:
    """``entity``, ``predicates``: the sorted set of each subject's (or object's) predicates."""
    pairs = triples.select(F.col(entity).alias("entity"), "p").distinct()
    return pairs.groupBy("entity").agg(F.array_sort(F.collect_set("p")).alias("predicates"))


class Store:
    """Opened with :meth:`open`, made with :meth:`build`."""

    def __init__(self, spark: SparkSession, path: str, meta: Meta):
        self.spark, self.path, self.meta = spark, path.rstrip("/"), meta
        self._stats: dict[str, tuple[int, int, int]] = {}
        self._tables: dict[str, DataFrame] = {}
        self._beside: dict[tuple[frozenset[str], str | None, bool], frozenset[str] | None] = {}

    @classmethod
    def build(cls, spark: SparkSession, triples: DataFrame, path: str, encode: bool = False, sets: bool = True) -> Store:
        """Writes all tables; ``triples`` has s, p, o and may repeat. An existing store at the path is replaced."""
        path = path.rstrip("/")
        staging = f"{path}/staging"
        triples.select("s", "p", "o").dropDuplicates().write.mode("overwrite").parquet(f"{staging}/graph")
        graph = spark.read.parquet(f"{staging}/graph")
        n_predicates = graph.select("p").distinct().count()
        layout = "predicate" if n_predicates <= MAX_PARTITIONED else "bucket"
        placed = graph.withColumn("bucket", _bucket("p")) if layout == "bucket" else graph
        # Ranges of (predicate, entity): a hot predicate is spread over many files, and each file has few predicates.
        for name, order in (("spo", ("p", "s", "o")), ("ops", ("p", "o", "s"))):
            placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("p" if layout == "predicate" else "bucket").parquet(f"{path}/{name}")
        store = cls(spark, path, Meta(layout, encode, 0, n_predicates, sets=sets))
        stats = graph.groupBy("p").agg(F.count(F.lit(1)).alias("n_triples"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))
        stats.write.mode("overwrite").parquet(f"{path}/pred_stats")
        store.meta.n_triples = store.table("pred_stats").agg(F.sum("n_triples")).first()[0] or 0
        if sets:
            for name, entity in (("cs_s", "s"), ("cs_o", "o")):
                characteristic_sets(graph, entity).write.mode("overwrite").parquet(f"{staging}/{name}")
                of = spark.read.parquet(f"{staging}/{name}")
                keys = dense_ids(of.select(F.concat_ws("\n", "predicates").alias("key")).distinct(), "key", f"{staging}/{name}_keys")
                keys.select(F.col("id").alias("cs"), F.split("term", "\n").alias("predicates")).write.mode("overwrite").parquet(f"{path}/{name}_sets")
                named = of.join(spark.read.parquet(f"{path}/{name}_sets"), "predicates").select("entity", "cs")
                named.repartitionByRange("entity").sortWithinPartitions("entity").write.mode("overwrite").parquet(f"{path}/{name}")
        if encode:
            store._encode(graph, staging)
        store._say()
        at = _path(spark, staging)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return store

    def _encode(self, graph: DataFrame, staging: str) -> None:
        terms = graph.select(F.explode(F.array("s", "p", "o")).alias("t")).distinct()
        dense_ids(terms, "t", f"{staging}/terms").write.mode("overwrite").parquet(f"{self.path}/dict")
        known = self.spark.read.parquet(f"{self.path}/dict")
        predicates = known.join(graph.select(F.col("p").alias("term")).distinct(), "term", "left_semi")
        if self.meta.n_predicates <= MAX_PARTITIONED:
            predicates = F.broadcast(predicates)
        ids = graph
        for c, names in (("p", predicates), ("s", known), ("o", known)):
            ids = ids.join(names.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c)
        ids = ids.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))
        ids.repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s", "o").write.mode("overwrite").parquet(f"{self.path}/ids_spo")
        self.meta.n_terms = known.count()

    def _say(self) -> None:
        at = _path(self.spark, f"{self.path}/meta.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps(asdict(self.meta)).encode()))
        out.close()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        path = path.rstrip("/")
        said = "\n".join(r.value for r in spark.read.text(f"{path}/meta.json").collect())
        return cls(spark, path, Meta(**json.loads(said)))

    def table(self, name: str) -> DataFrame:
        """A stored table; triples as s, p, o."""
        if name not in self._tables:
            reader = self.spark.read
            if name in ("spo", "ops"):
                key = "p string" if self.meta.layout == "predicate" else "bucket int"
                columns = "s string, o string" if self.meta.layout == "predicate" else "s string, p string, o string"
                self._tables[name] = reader.schema(f"{columns}, {key}").parquet(f"{self.path}/{name}")
            else:
                self._tables[name] = reader.parquet(f"{self.path}/{name}")
        return self._tables[name]

    def triples(self, s: str | None = None, p: str | None = None, o: str | None = None, among: tuple[str, ...] | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
        """The triples with these constants, from the copy that is sorted for them; columns s, p, o. among: the only predicates to read. kinds: those of all subjects asked for, to a store that knows kinds."""
        t = self.table("ops" if o is not None and s is None else "spo")
        if p is not None and self.meta.layout == "bucket":
            t = t.where(F.col("bucket") == zlib.crc32(p.encode()) % BUCKETS)
        if among is not None:
            if self.meta.layout == "bucket":
                t = t.where(F.col("bucket").isin(sorted({zlib.crc32(x.encode()) % BUCKETS for x in among})))
            t = t.where(F.col("p").isin(list(among)))
        for name, value in (("p", p), ("s", s), ("o", o)):
            if value is not None:
                t = t.where(F.col(name) == F.lit(value))
        return t.select("s", "p", "o")

    def id_triples(self, ids: dict[str, int], s: str | None = None, p: str | None = None, o: str | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
        """The triples with these constants as ids; ids: those of the constants that exist."""
        t = self.table("ids_spo")
        for name, text in (("s", s), ("p", p), ("o", o)):
            if text is not None:
                t = t.where(F.col(name) == F.lit(ids.get(text, 0)))
        return t

    def sets_of(self, entity: str, of_objects: bool = False) -> DataFrame:
        """``entity``, ``cs`` of one subject (or object)."""
        return self.table("cs_o" if of_objects else "cs_s").where(F.col("entity") == F.lit(entity))

    def predicates_of(self, of_objects: bool = False, entity: str | None = None) -> DataFrame:
        """``entity``, ``p``: each subject's (or object's) predicates once, or one entity's, from the characteristic sets; no triple is read."""
        name = "cs_o" if of_objects else "cs_s"
        entities = self.table(name) if entity is None else self.sets_of(entity, of_objects)
        sets = self.table(f"{name}_sets").select("cs", F.explode("predicates").alias("p"))
        return entities.join(sets, "cs").select("entity", "p")

    def predicates_beside(self, predicates: frozenset[str], entity: str | None = None, of_objects: bool = False) -> frozenset[str] | None:
        """All predicates of the subjects (or objects) that have these ones at least, or of one entity, by the characteristic sets. None if there are more than MAX_PARTITIONED, too many to name in a scan."""
        key = (predicates, entity, of_objects)
        if key not in self._beside:
            name = "cs_o" if of_objects else "cs_s"
            sets = self.table(f"{name}_sets")
            for p in sorted(predicates):
                sets = sets.where(F.array_contains("predicates", p))
            if entity is not None:
                sets = sets.join(self.sets_of(entity, of_objects), "cs", "left_semi")
            rows = sets.select(F.explode("predicates").alias("p")).distinct().limit(MAX_PARTITIONED + 1).collect()
            self._beside[key] = frozenset(r.p for r in rows) if len(rows) <= MAX_PARTITIONED else None
        return self._beside[key]

    def implied(self, p: str):
        """Where this predicate's objects can be told from its subjects alone: what subjects they are, and how; else None."""
        return None

    def narrowed(self, patterns) -> dict:
        """Of patterns with a variable predicate, the predicates that what is known of the terms leaves."""
        return {}

    def subject_kinds(self, patterns) -> dict:
        """Of each pattern, the only kinds that its subjects can have, where the store knows kinds."""
        return {}

    def stats(self, predicates: list[str]) -> dict[str, tuple[int, int, int]]:
        """(triples, subjects, objects) of those of the predicates that exist."""
        ask = [p for p in dict.fromkeys(predicates) if p not in self._stats]
        if ask:
            for r in self.table("pred_stats").where(F.col("p").isin(ask)).collect():
                self._stats[r.p] = (r.n_triples, r.n_subjects, r.n_objects)
        return {p: self._stats[p] for p in predicates if p in self._stats}

    def statistics(self, predicates: list[str]) -> DataFrame:
        """Exact ``p``, ``n_triples``, ``n_subjects``, ``n_objects`` of those of the predicates that exist."""
        return self.table("pred_stats").where(F.col("p").isin(predicates))

    def terms(self, kinds=None) -> DataFrame:
        """The dictionary as far as any ids that were read need it; kinds: those of all terms asked for, to a store that knows kinds."""
        return self.table("dict")

    def kinds_of_variables(self, patterns) -> dict:
        """The only kinds that variables at the ends of these patterns can have, where the store knows kinds."""
        return {}

    def ids_of(self, terms: list[str]) -> dict[str, int]:
        """Ids of those of a query's constants that exist (exact strings)."""
        return {r.term: r.id for r in self.terms().where(F.col("term").isin(terms)).collect()} if terms else {}

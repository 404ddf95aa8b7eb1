"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its share of the output over its mass. A document's number
of copies is the inverse Poisson distribution function, with that rate as mean, at a uniform number
hashed from seed and document id. So a draw depends on nothing but the row: it is the same after a
lost executor, in any order and on any number of machines, and documents of one source may be drawn
in any number of tasks. Copies are exploded and sorted by a hash of their own, over all partitions.

Only DataFrame functions are used. A source's mass is pre-aggregated before the shuffle. The rate
table is broadcast up to MAX_BROADCAST sources; beyond, it is joined with salted keys.

Defined cases: mass is code points plus one, so sources of empty or null texts have a rate too; a null
source is a source of its own, as is the empty string. Rows with equal ids draw alike; null ids draw
as the text "null". A source that the weights don't name has weight 0 and no copies; an empty table
gives none. Extra columns are kept; ``copy`` and ``shuffle_key`` get underscores before them where
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.scratch import written
from tripleweave.llm.textmap import unused

SEED, ALPHA, EPOCHS = "mix-1", 0.7, 1.0
#: A Poisson draw is a sum of draws of at most this mean each; the distribution function of each has TERMS entries.
MEAN, TERMS = 16.0, 96
MAX_BROADCAST, SALTS = 50_000, 32


def text_mass(text: str = "text") -> Column:
    return F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1


def rates(docs: DataFrame, weights: dict[str, float] | None = None, mass: Column | None = None, source: str = "source", alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """``source``, ``mass``, ``rate`` (mean copies), ``parts`` and ``cdf`` (of one part of the draw).

    weights: relative shares of the output by source. Without it, shares go as mass to the power alpha.
    epochs: the output's expected mass over the input's.
    """
    sums = written(docs.groupBy(F.col(source).alias("source")).agg(F.sum(text_mass() if mass is None else mass).alias("mass")), "mass")
    if weights is None:
        share = F.pow(F.col("mass").cast("double"), F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for k, v in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(share)
    shares, everything = sums.agg(F.sum(share), F.sum("mass")).first()
    mean = F.col("rate") / F.col("parts")
    step = lambda s, k: F.struct((s["p"] * s["mu"] / k).alias("p"), s["mu"].alias("mu"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * s["mu"] / k)).alias("cdf"))
    first = F.struct(F.exp(-mean).alias("p"), mean.alias("mu"), F.array(F.exp(-mean)).alias("cdf"))
    return (
        sums.withColumn("rate", F.lit(float(epochs * (everything or 0))) * share / F.lit(float(shares or 1)) / F.col("mass"))
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1)).cast("int"))
        .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step)["cdf"])
        .select("source", "mass", "rate", "parts", "cdf")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) with 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, mass: Column | None = None, source: str = "source", doc_id: str = "doc_id", alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Each row as often as drawn, with ``copy`` (from 1) and ``shuffle_key``, sorted by the key."""
    names = docs.columns
    copy, key, rate = (unused(names, x) for x in ("copy", "shuffle_key", "rates"))
    per_source = rates(docs, weights, mass, source, alpha, epochs)
    table = per_source.select(F.col("source").alias("__source"), F.struct("parts", "cdf").alias(rate))
    if per_source.count() <= MAX_BROADCAST:
        joined = docs.join(F.broadcast(table), docs[source].eqNullSafe(table["__source"]))
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(docs[doc_id]), F.lit(SALTS)).cast("int")
        joined = docs.join(salted, docs[source].eqNullSafe(salted["__source"]) & (salt == salted["__salt"]))
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("|"))
    draws = F.transform(F.sequence(F.lit(1), F.col(rate)["parts"]), lambda i: uniform(F.concat(name, i.cast("string"))))
    n = F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= u)))
    copies = joined.withColumn(copy, n).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    keyed = copies.withColumn(key, F.md5(F.concat(name, F.lit("copy|"), F.col(copy).cast("string"))))
    return keyed.select(*names, copy, key).orderBy(key, copy)

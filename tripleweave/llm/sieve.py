"""A bitmap of fixed size that tells, without a shuffle, which rows surely have none of many keys.

A large set of keys can't be broadcast, and joining with it shuffles whole rows. The bitmap has
2 ** BITS bits however many keys there are, so it can: rows whose bit is not set pass or go at once,
and only the others are joined exactly. If so many keys set nearly all bits, nearly all rows are
joined; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.textmap import column_of

BITS = 26


def bitmap(df: DataFrame, place: Column) -> bytes:
    """Bits at the places (0 to 2 ** BITS - 1) of all rows; what goes to the driver is the bitmap's nonzero parts."""
    part, within = F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(0x7FFF)).alias("within")
    out = bytearray(1 << (BITS - 3))
    for r in df.select(part, within).groupBy("part").agg(F.bitmap_construct_agg("within").alias("bits")).collect():
        out[r.part << 12 : (r.part << 12) + len(r.bits)] = r.bits
    return bytes(out)


def place_of(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << BITS) - 1))


def sifted(df: DataFrame, key: str, bits: bytes, inside: bool) -> DataFrame:
    """The rows whose key's bit is set (or isn't). Only the bits' places go to the workers."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def hit(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        table = np.frombuffer(sent.value, np.uint8)
        return pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    found = column_of(df, place_of(F.col(key)), T.BooleanType(), hit)
    return df.where(found if inside else ~found)


def without_keys(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is in none of the rows of ``keys`` (its column ``name``); rows with a null key stay."""
    bits = bitmap(keys, place_of(F.col(name)))
    maybe = sifted(df, key, bits, True)
    gone = keys.select(F.col(name).alias("__gone"))
    return sifted(df, key, bits, False).unionByName(maybe.join(gone, maybe[key] == gone["__gone"], "left_anti"))

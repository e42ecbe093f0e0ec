"""Bit arrays of a fixed size over hashed keys, as tables of words.

They bound what is sent to every executor, whatever the data: a key's slot is its hash
modulo the size.  A slot can be shared, so a member test may say yes for a key that isn't there, never no for
one that is; everything that uses them stays right in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm._scratch import free_names

#: Bits of an array, which makes 262,144 words of 64 bits at most: the rows of the broadcast table.
BITS = 1 << 24


def _slot(keys: tuple[str | Column, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def members(df: DataFrame, *keys: str) -> DataFrame:
    """(word, bits): the bits of the slots of all keys, ``BITS`` / 64 rows at most.  Computed where it is broadcast, so ``df`` should be a saved table."""
    slots = df.select(_slot(keys).alias("s")).select(F.shiftright("s", 6).alias("word"), F.expr("shiftleft(1L, int(s & 63))").alias("b"))
    return slots.groupBy("word").agg(F.bit_or("b").alias("bits"))


def with_member(df: DataFrame, words: DataFrame, name: str, *keys: str | Column) -> DataFrame:
    """``df`` with a boolean column ``name``: true for every key that was there, and for few others."""
    slot, word, bits = free_names(df, "_slot", "_word", "_bits")
    named = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    joined = df.withColumn(slot, _slot(keys)).join(F.broadcast(named), F.shiftright(slot, 6) == F.col(word), "left")
    return joined.withColumn(name, F.coalesce(F.expr(f"(shiftright({bits}, int({slot} & 63)) & 1L) = 1L"), F.lit(False))).drop(slot, word, bits)


def only_members(df: DataFrame, words: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows of ``df`` whose key was there, and few others."""
    (name,) = free_names(df, "_member")
    return with_member(df, words, name, *keys).where(F.col(name)).drop(name)

"""A bitmap of fixed size that tells most rows of a wide table from those that a join looks for, so that they aren't shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap; with n keys, about n / BITS of the other rows pass, too. It is BITS / 64 rows at most, at any size.
BITS = 1 << 24


def _place(key: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """word, bits: of the values of a column, nulls among them."""
    word, bit = _place(F.col(column))
    return keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _met(df: DataFrame, column: Column, bits: DataFrame, how: str) -> DataFrame:
    word, bit = _place(column)
    return df.join(F.broadcast(bits), (word == bits["_word"]) & (bits["_bits"].bitwiseAND(bit) != 0), how)


def may_meet(df: DataFrame, column: Column, bits: DataFrame) -> DataFrame:
    """The rows of df whose column may be among the keys: all that are, and few others."""
    return _met(df, column, bits, "left_semi")


def cannot_meet(df: DataFrame, column: Column, bits: DataFrame) -> DataFrame:
    """All other rows of df."""
    return _met(df, column, bits, "left_anti")

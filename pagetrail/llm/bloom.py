"""A blocked Bloom filter as a table of bounded size.

A key sets eight bits inside the one 256-bit block that its hash names. The table has a row for each
block with bits set, `MAX_BLOCKS` at most (about 5 MB), so it may be broadcast however many keys
there are; with more keys more rows pass, and what passes must be joined exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS, BITS_A_KEY, PROBES = 1 << 17, 12, 8


def blocks_for(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, 1 << max(4, math.ceil(math.log2(max(1, keys) * BITS_A_KEY / 256))))


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def _bits(key: Column) -> list[Column]:
    """Places of a key's bits in its block, 0 to 255."""
    return [F.shiftright(F.xxhash64(key, F.lit("bits")), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(bloom_block, bloom_words): a row for each block that has bits set; the words are its four longs."""
    bits = keys.select(_block(F.col(key), blocks).alias("bloom_block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0))) for w in range(4)]
    return bits.groupBy("bloom_block").agg(F.array(*words).alias("bloom_words"))


def probed(rows: DataFrame, key: str, keys: DataFrame, keys_col: str, into: str = "maybe", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """rows with a boolean `into`: false means that row's key is surely not among the keys (or null).

    keys should be a written table: it is counted first and read again for the filter.
    """
    blocks = blocks_for(keys.count(), max_blocks)
    asked = rows.withColumn("bloom_block", _block(F.col(key), blocks))
    asked = asked.join(F.broadcast(bloom_blocks(keys, keys_col, blocks)), "bloom_block", "left")
    hit = F.col(key).isNotNull() & F.col("bloom_words").isNotNull()
    for bit in _bits(F.col(key)):
        hit = hit & (F.getbit(F.element_at("bloom_words", (F.floor(bit / 64) + 1).cast("int")), bit % 64) == 1)
    return asked.withColumn(into, F.coalesce(hit, F.lit(False))).drop("bloom_block", "bloom_words")


def joined_few(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined (inner, left, left_anti) with a written table that few of them have a partner in.

    Rows that surely have none are not shuffled. The columns `on` are equal null-safely.
    """
    key, of = "__few_key", F.xxhash64(*on)
    seen = probed(rows.withColumn(key, of), key, few.select(of.alias(key)), key, "__few_maybe")
    near, far = (seen.filter(c).drop(key, "__few_maybe") for c in (F.col("__few_maybe"), ~F.col("__few_maybe")))
    few = few.select(*[F.col(c).alias(f"__few_{c}") if c in on else F.col(c) for c in few.columns])
    same = F.lit(True)
    for c in on:
        same = same & near[c].eqNullSafe(few[f"__few_{c}"])
    near = near.hint("merge").join(few, same, how)
    if how == "inner":
        return near.drop(*[f"__few_{c}" for c in on])
    if how == "left_anti":
        return near.unionByName(far)
    near = near.drop(*[f"__few_{c}" for c in on])
    return near.unionByName(far.select("*", *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in few.columns if not c.startswith("__few_")]))

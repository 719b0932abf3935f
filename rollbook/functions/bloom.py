"""Blocked Bloom filters as tables: a row a block, a bit in each of its words for every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block: so many words of 2 ** LANE_BITS bits.
LANES, LANE_BITS = 8, 5
BLOCK_BITS = LANES << LANE_BITS
WORDS = [f"w{k}" for k in range(LANES)]


def n_blocks(n_keys: int, bits: int, most: int) -> int:
    """Blocks for so many keys of ``bits`` bits each, ``most`` at most."""
    return max(1, min(most, -(-n_keys * bits // BLOCK_BITS)))


def block_of(key: Column, blocks) -> Column:
    return F.pmod(F.xxhash64(key), blocks if isinstance(blocks, Column) else F.lit(blocks))


def bits_of(key: Column) -> list[Column]:
    """The bit of a key in each word of its block."""
    mixed = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(mixed, LANE_BITS * k).bitwiseAND((1 << LANE_BITS) - 1).cast("int")) for k in range(LANES)]


def bloom(keys: DataFrame, key: str, blocks, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, block, w0 ... w7: the filter of the column ``key`` (one for each value of ``by``), a row for each block that any key falls into."""
    rows = keys.select(*by, block_of(F.col(key), blocks).alias("block"), *[b.alias(w) for w, b in zip(WORDS, bits_of(F.col(key)))])
    return rows.groupBy(*by, "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def may_have(key: Column, words: list[str] | None = None) -> Column:
    """Whether a row joined with its block may be a key of the filter; false where there is no block or no key."""
    hit = key.isNotNull()
    for word, bit in zip(words or WORDS, bits_of(key)):
        hit = hit & (F.col(word).bitwiseAND(bit) != 0)
    return F.coalesce(hit, F.lit(False))

"""A Bloom filter built and probed with built-in expressions only.

The filter is an array of 64-bit words. A key sets ``BITS`` bits of one word
(chosen by a hash), so inserting is ``bit_or`` per word, a distributed
aggregation with map-side combine, and probing is one array access. The array
reaches the executors as a scalar subquery, hence as one broadcast value of
``8 * words`` bytes, for which the caller sets a bound; more keys than planned
only raise the share of false positives (1 % at 16 bits a key; see the README).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
KEYS_PER_WORD = 4
MAX_BYTES = 16 << 20


def words_for(keys: int, max_bytes: int = MAX_BYTES) -> int:
    """A power of two with 16 to 32 bits a key, never beyond ``max_bytes`` in all."""
    most = 1 << max(6, int(math.log2(max(64, max_bytes // 8))))
    return min(most, 1 << max(6, math.ceil(math.log2(max(1, keys) / KEYS_PER_WORD + 1))))


def _place(key: Column, words: int) -> Column:
    return F.pmod(key, F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    second = F.xxhash64(key)
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """One row, one column ``words``: the filter over the bigint hashes in ``key`` (nulls ignored)."""
    set_bits = keys.where(F.col(key).isNotNull()).groupBy(_place(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("mask"))
    every = keys.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word"))
    full = every.join(set_bits, "word", "left").select(F.struct("word", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask")).alias("cell"))
    cells = F.sort_array(F.collect_list("cell"))
    return full.agg(F.transform(cells, lambda c: c["mask"]).alias("words"))


def maybe_in(bloom: DataFrame, key: Column, words: int) -> Column:
    """False only if the key is certainly not among the keys the filter was built from."""
    mask = _mask(key)
    return F.get(bloom.scalar(), _place(key, words)).bitwiseAND(mask) == mask

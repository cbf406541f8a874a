"""References to records that do not exist.

A broadcast Bloom filter of the parent keys proves definite orphans; only the
references it lets through are verified by an exact join. The report is an
aggregation over the orphans alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuskel.operators import bloom

MISSING, DELETED, LATER = "MISSING", "DELETED", "LATER"


def snapshot_orphans(refs: DataFrame, parents: DataFrame, parent_rows: int, max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """References whose parent isn't in the snapshot of their period, with ``orphan_kind``.

    ``refs``: any columns plus ``ref_value`` string and ``ordinal`` int (its
    period). ``parents``: ``parent_key`` string, ``parent_ordinal`` int, rows
    may repeat. ``parent_rows``: rows of ``parents``, to size the filter.

    DELETED if an earlier period has the parent, else LATER if a later one has,
    else MISSING. Null references and references of an unknown period aren't
    judged. The filter holds one key per parent, whatever its periods. No hit
    proves MISSING without any join. Other references go through one exact join
    on the key against one row per parent key with its periods, whose size is
    bounded by the number of periods. A hot reference is split by adaptive skew
    handling, as the parent side has one row a key. ``max_bytes`` bounds the
    filter and so what is broadcast; a filter too small for its keys lets more
    references through to the join and changes no result.
    """
    words = bloom.words_for(parent_rows, max_bytes)
    known = parents.where(F.col("parent_key").isNotNull() & F.col("parent_ordinal").isNotNull())
    by_key = known.groupBy(F.col("parent_key").alias("_key")).agg(F.collect_set("parent_ordinal").alias("_periods"))
    filtered = bloom.build(by_key.select(F.xxhash64("_key").alias("key")), "key", words)

    judged = refs.where(F.col("ref_value").isNotNull() & F.col("ordinal").isNotNull())
    probed = judged.withColumn("_maybe", bloom.maybe_in(filtered, F.xxhash64("ref_value"), words))
    proved = probed.where(~F.col("_maybe")).withColumn("orphan_kind", F.lit(MISSING)).drop("_maybe")
    joined = probed.where("_maybe").join(by_key, F.col("ref_value") == F.col("_key"), "left")
    absent = ~F.coalesce(F.array_contains("_periods", F.col("ordinal")), F.lit(False))
    kind = F.when(F.array_min("_periods") < F.col("ordinal"), DELETED).when(F.array_max("_periods") > F.col("ordinal"), LATER).otherwise(MISSING)
    verified = joined.where(absent).withColumn("orphan_kind", kind).drop("_maybe", "_key", "_periods")
    return proved.unionByName(verified)


def registry_orphans(refs: DataFrame, registry: DataFrame, registry_rows: int, at: str = "at") -> DataFrame:
    """References to a registry entry that is not in force at the time in column ``at``.

    ``registry``: ``parent_key``, ``registered_at``, ``deleted_at``. MISSING if
    no entry has the key, DELETED if it was deleted at or before the time, LATER
    if it was registered after it. Of several entries for a key the reference
    is sound if any is in force; else DELETED goes before LATER. An entry with
    a null ``registered_at`` counts as always registered.
    """
    words = bloom.words_for(registry_rows)
    by_key = registry.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("_key")).agg(F.collect_set(F.struct("registered_at", "deleted_at")).alias("_entries"))
    filtered = bloom.build(by_key.select(F.xxhash64("_key").alias("key")), "key", words)
    judged = refs.where(F.col("ref_value").isNotNull() & F.col(at).isNotNull())
    probed = judged.withColumn("_maybe", bloom.maybe_in(filtered, F.xxhash64("ref_value"), words))
    proved = probed.where(~F.col("_maybe")).withColumn("orphan_kind", F.lit(MISSING)).drop("_maybe")
    doubtful = probed.where("_maybe")
    joined = doubtful.join(by_key, F.col("ref_value") == F.col("_key"), "left")

    def deleted(e: Column) -> Column:
        return F.coalesce(e["deleted_at"] <= F.col(at), F.lit(False))

    def later(e: Column) -> Column:
        return F.coalesce(e["registered_at"] > F.col(at), F.lit(False))

    kind = (
        F.when(F.col("_entries").isNull(), MISSING)
        .when(F.exists("_entries", lambda e: ~deleted(e) & ~later(e)), F.lit(None))
        .when(F.exists("_entries", deleted), DELETED)
        .otherwise(LATER)
    )
    verified = joined.withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).drop("_maybe", "_key", "_entries")
    return proved.unionByName(verified)


def orphan_report(orphans: DataFrame, *by: str) -> DataFrame:
    """Number of orphan references and of distinct missing parents per group."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("ref_value").alias("n_values"))

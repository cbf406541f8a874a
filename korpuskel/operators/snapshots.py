"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "ADDED", "REMOVED", "CHANGED"
_CURRENT, _PREVIOUS = 0, 1


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str, ordinal: str, version: Column, content: Column) -> DataFrame:
    """Keys added, removed or changed in ``content`` against the snapshot just before.

    ``rows``: the rows of all snapshots with the snapshot's ``ordinal`` (0, 1, ...)
    and ``key``. ``snapshots``: all ordinals as column ``ordinal``, also of empty
    snapshots. Of several rows for a snapshot and key the one with the largest
    ``version`` counts; ties go to the largest content hash. Result: ``ordinal``
    of the later snapshot, ``key``, ``change_kind``; nothing for the first.

    Each row is tagged twice, as the current side of its own snapshot and as the
    previous side of the next, and one aggregation by (snapshot, key) compares
    per-side hashes (128 bits; a null content differs from every string). That
    is the only shuffle; only key, version and hashes pass it.
    """
    empty = content.isNull()
    seen = F.struct(version.alias("v"), F.xxhash64(empty, content).alias("h"), F.xxhash64(content, F.lit("second"), empty).alias("g"))
    sides = F.array(
        F.struct(F.col(ordinal).alias("ordinal"), F.lit(_CURRENT).alias("side")),
        F.struct((F.col(ordinal) + 1).alias("ordinal"), F.lit(_PREVIOUS).alias("side")),
    )
    tagged = rows.where(F.col(key).isNotNull() & F.col(ordinal).isNotNull()).select(F.col(key), seen.alias("seen"), F.explode(sides).alias("s"))
    tagged = tagged.select(key, "seen", "s.ordinal", "s.side").where(F.col("ordinal") > 0)
    both = tagged.groupBy("ordinal", key).agg(
        F.max(F.when(F.col("side") == _CURRENT, F.col("seen"))).alias("now"),
        F.max(F.when(F.col("side") == _PREVIOUS, F.col("seen"))).alias("was"),
    )
    same = (F.col("now.h") == F.col("was.h")) & (F.col("now.g") == F.col("was.g"))
    kind = F.when(F.col("was").isNull(), ADDED).when(F.col("now").isNull(), REMOVED).when(~same, CHANGED)
    known = snapshots.select("ordinal").distinct()
    return both.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).join(known, "ordinal", "left_semi").select("ordinal", key, "change_kind")

"""Mixing sources to target weights.

Systematic sampling: within its source, the expected copies of each document
are summed up in order, one random offset is added, and a document is given out
once for each integer boundary it crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000


def rates(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of ``targets`` with a positive share: its tokens, and the expected copies of each of its documents.

    ``docs``: ``source``, ``n_tokens``. ``targets``: ``source``, ``target_share``,
    ``max_repeats``. ``total`` is the wanted number of tokens; without it, it is
    the largest that gives every source with any tokens its share within its
    repeats. A source that can't give its share of ``total`` gives all it may.
    """
    held = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
    wanted = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull())
    joined = wanted.join(held, "source", "left").fillna(0, ["available_tokens", "available_docs"])
    most = F.when(F.col("available_tokens") > 0, F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))
    size = F.lit(float(total)) if total is not None else F.min(most).over(Window.partitionBy())
    rate = F.least(F.try_divide(F.col("target_share") * size, F.col("available_tokens")), F.col("max_repeats").cast("double"))
    return joined.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def draw(docs: DataFrame, rated: DataFrame, total_rows: int, seed: int = 7, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``repeats`` of each document drawn at least once.

    ``docs``: ``doc_id``, ``source``, ``n_tokens``; documents without tokens or
    of a source without a target aren't drawn. Of n documents with rate r,
    floor(n r) or one more copies are drawn, no document more than ceil(r) times.

    The order within a source is by hash bucket, then size, then id. The prefix
    sum has two levels: over the buckets of a source (a small table), and within
    a bucket of about ``per_bucket`` rows, so a large source is never in one task.
    """
    buckets = max(1, -(-total_rows // per_bucket))
    kept = docs.where("n_tokens > 0").join(rated.select("source", "rate").where("rate > 0"), "source")
    placed = kept.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n")
    bases = counts.select("source", "_bucket", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("n_tokens", "doc_id"))
    ranked = placed.withColumn("_rank", rank).join(bases, ["source", "_bucket"])
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = F.col("_before") + F.col("_rank")
    repeats = F.floor(upto * F.col("rate") + offset) - F.floor((upto - 1) * F.col("rate") + offset)
    return ranked.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def shares(drawn: DataFrame, rated: DataFrame) -> DataFrame:
    """Per source: target and reached share of the drawn tokens, and what was drawn of what there is."""
    given = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"),
        F.sum("repeats").alias("drawn_copies"),
        F.count(F.lit(1)).alias("drawn_docs"),
        F.max("repeats").alias("most_repeats"),
    )
    joined = rated.join(given, "source", "left").fillna(0, ["drawn_tokens", "drawn_copies", "drawn_docs", "most_repeats"])
    reached = F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(Window.partitionBy()))
    names = ["source", "target_share", "max_repeats", "available_docs", "available_tokens", "drawn_docs", "drawn_copies", "drawn_tokens", "most_repeats"]
    return joined.select(*names, F.coalesce(reached, F.lit(0.0)).alias("reached_share"))

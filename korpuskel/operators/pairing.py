"""Pairs of passages that may contradict each other, found by their rarest shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.session import cut


def overlap(left: Column, right: Column) -> Column:
    """Shared members of two sets as a part of the smaller one; 0 if either is empty or null."""
    smaller = F.least(F.size(left), F.size(right))
    return F.coalesce(F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller), F.lit(0.0))


MOST_BROADCAST = 200_000  # rows of a scope and a token


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` written once, and broadcast where they are counted to be few."""
    held = cut(rows)
    return F.broadcast(held) if held.count() <= MOST_BROADCAST else held


def conflict_pairs(passages: DataFrame, scope: str, ident: str, text: str, rarest: int = 4, postings: int = 128, least: int = 2) -> DataFrame:
    """For each passage with a negation, the one without that shares most tokens with it: (scope, left_id, right_id, shared), ids in order.

    A passage is compared through its ``rarest`` tokens among the passages without
    negation (by number, then the token itself), each with its first ``postings``
    passages by id: these bounds are part of the rule, as is that the larger id
    wins a tie and that a pair shares ``least`` tokens at least. Tokens are those
    of ``functions.text.conflict_tokens``. Work is in proportion to the rows, not
    to the pairs: a token gives at most ``postings`` partners to each passage.
    A pair found from both sides comes once. Shared tokens are counted by 64-bit
    hashes. Null texts and keys are left out.
    """
    known = passages.where(F.col(scope).isNotNull() & F.col(ident).isNotNull() & F.col(text).isNotNull())
    made = known.select(F.col(scope).alias("s"), F.col(ident).alias("i"), F.col(text).rlike(X.TOPICS["negation"]).alias("negative"), X.conflict_tokens(F.col(text)).alias("tokens"))
    each = lambda negative: made.where(F.col("negative") == negative).select("s", "i", F.explode("tokens").alias("t"))
    held = _small(each(False).groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")))
    # Of a passage's tokens, as many as it has, the rarest; where the counts are broadcast nothing is shuffled for it.
    ordered = F.sort_array(F.collect_list(F.struct("n", "t")))
    rare = each(True).join(held, ["s", "t"]).groupBy("s", "i").agg(F.slice(ordered, 1, rarest)["t"].alias("rare"))
    tokens = made.select("s", "i", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    wanted = _small(rare.select("s", F.explode("rare").alias("t")).distinct())
    # Each task passes on a token's first ids only (a limit within groups runs before the shuffle), so a usual token gathers few.
    mine = each(False).join(wanted, ["s", "t"], "left_semi")
    first = mine.withColumn("n", F.row_number().over(Window.partitionBy("s", "t").orderBy("i"))).where(F.col("n") <= postings).select("s", "t", "i")
    # These come with their tokens, so that partners are compared where they meet and no pair is shuffled.
    partners = first.join(tokens, ["s", "i"]).groupBy("s", "t").agg(F.collect_list(F.struct("i", "tokens")).alias("partners"))
    asked = rare.join(tokens, ["s", "i"]).select("s", "i", "tokens", F.explode("rare").alias("t"))
    shared = F.transform("partners", lambda p: F.struct(F.size(F.array_intersect("tokens", p["tokens"])).alias("shared"), p["i"].alias("other")))
    met = asked.join(partners, ["s", "t"]).select("s", "i", F.array_max(shared).alias("b"))
    best = met.groupBy("s", "i").agg(F.max("b").alias("b")).where(F.col("b.shared") >= least)
    pair = best.select(F.col("s").alias(scope), F.least("i", "b.other").alias("left_id"), F.greatest("i", "b.other").alias("right_id"), F.col("b.shared").alias("shared"))
    return pair.distinct()

"""Fusion of ranked lanes, and choices along a ranked list: floors, heads, gates.

Ranked lists are frames of (query, ident, ``rank``) with at most a few hundred
rows a query. Choices that depend on one another are made on one row a query
with the list as an array, in built-in expressions, or, where a rule looks at
everything chosen so far, in one pandas group a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpuskel.operators.lanes import DIGITS

K = 60  # of reciprocal rank fusion
#: Roles that a head keeps one representative of, in their order. Fixed values.
SAFETY_ROLES = ["EXCEPTION_OR_CONTRAINDICATION", "APPLICABILITY", "DOSE_OR_THRESHOLD", "MONITORING"]
PRIMARY = "PRIMARY_SUPPORT"


def ranked(scores: DataFrame, query: str | list[str], ident: str, k: int | None) -> DataFrame:
    """The ``k`` best rows of each query by (score descending, id), or all for None, with ``rank`` from 1."""
    keys = [query] if isinstance(query, str) else query
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(ident))
    numbered = scores.withColumn("rank", F.row_number().over(order))
    return numbered if k is None else numbered.where(F.col("rank") <= k)


def fuse(lanes: DataFrame, weights: dict[str, float], query: str | list[str], ident: str, k: int = K) -> DataFrame:
    """Weighted reciprocal rank fusion of (lane, query, ident, rank): sum of weight / (k + rank).

    Weights must be finite, none negative, one positive, ``k`` positive. A lane
    without a weight and an id repeated within a lane are errors when the frame
    is run. A weight whose lane is missing or empty adds nothing.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must be finite, none negative and one positive")
    keys = [query] if isinstance(query, str) else query
    weight: Column = F.raise_error(F.concat(F.lit("no weight for lane "), "lane")).cast("double")
    for lane, w in weights.items():
        weight = F.when(F.col("lane") == lane, F.lit(float(w))).otherwise(weight)
    repeated = F.size(F.collect_set("lane")) < F.count("lane")
    score = F.when(repeated, F.raise_error(F.lit("a lane repeats an id")).cast("double")).otherwise(F.sum(F.col("_w") / (k + F.col("rank"))))
    summed = lanes.withColumn("_w", weight).groupBy(*keys, ident).agg(F.round(score, DIGITS).alias("score"))
    return summed.where(F.col("score") > 0)


def two_level(base: DataFrame, expansions: DataFrame, weights: dict[str, float], kinds: dict[str, float], query: str, ident: str, limit: int) -> DataFrame:
    """Fusion of the base lanes with expansions that are fused per kind first, each of their lanes at weight 1.

    ``expansions``: ``kind`` and the columns of lanes. A kind enters as one lane
    at the weight in ``kinds``; every level is cut at ``limit``. Kinds without
    a weight are left out. Result: query, ident, score, rank.
    """
    known = expansions.where(F.col("kind").isin(list(kinds)))
    score = F.round(F.sum(1 / (K + F.col("rank"))), DIGITS)
    per_kind = ranked(known.groupBy("kind", query, ident).agg(score.alias("score")), ["kind", query], ident, limit)
    lanes = base.select("lane", query, ident, "rank").unionByName(per_kind.select(F.col("kind").alias("lane"), query, ident, "rank"))
    return ranked(fuse(lanes, weights | kinds, query, ident), query, ident, limit)


def _listed(rows: DataFrame, query: str, ident: str, name: str, *more: str) -> DataFrame:
    """One row a query with its list in order as ``name``: id and ``more``."""
    item = F.struct("rank", F.col(ident).alias("id"), *more)
    return rows.groupBy(query).agg(F.sort_array(F.collect_list(item)).alias(name))


def _first_with(items: Column, role: str) -> Column:
    """The id of the first item that has a role, as an array of at most one."""
    return F.slice(F.filter(items, lambda x: F.coalesce(F.array_contains(x["roles"], role), F.lit(False))), 1, 1)["id"]


def _unnested(lists: DataFrame, query: str, ident: str, order: Column) -> DataFrame:
    return lists.select(query, F.posexplode(order).alias("pos", ident)).select(query, ident, (F.col("pos") + 1).alias("rank"))


def keep_floor(expanded: DataFrame, baseline: DataFrame, query: str, ident: str, depth: int, limit: int) -> DataFrame:
    """The expanded order with a floor of the baseline in its first ``depth`` places.

    ``baseline`` has a column ``roles``. Its first min(depth, max(2, depth // 2))
    ids and, for each safety role, the first of its ``depth`` ids with that role
    must be among the first ``depth``; the rest is filled from the expanded
    order. The head is in expanded order, then come mandatory ids that the
    expanded list lacks, then the rest. A query in the baseline only keeps it.
    Result: query, ident, rank.
    """
    lists = _listed(baseline, query, ident, "base", "roles").join(_listed(expanded, query, ident, "wide"), query, "full")
    none = F.array().cast(T.ArrayType(baseline.schema[ident].dataType))
    wide, base = F.coalesce(F.col("wide.id"), none), F.coalesce(F.col("base.id"), none)
    top = F.slice("base", 1, depth)
    firsts = [F.coalesce(_first_with(top, role), none) for role in SAFETY_ROLES]
    mandatory = F.slice(F.array_distinct(F.concat(F.slice(base, 1, min(depth, max(2, depth // 2))), *firsts)), 1, depth)
    lists = lists.withColumn("wide_ids", wide).withColumn("must", mandatory)
    fill = F.slice(F.array_except("wide_ids", "must"), F.lit(1), F.lit(depth) - F.size("must"))
    lists = lists.withColumn("chosen", F.concat("must", fill))
    head = F.filter("wide_ids", lambda i: F.array_contains("chosen", i))
    order = F.concat(head, F.array_except("must", "wide_ids"), F.array_except("wide_ids", "chosen"))
    return _unnested(lists, query, ident, F.slice(order, 1, limit))


def rerank_with_reserve(candidates: DataFrame, query: str, ident: str, depth: int, preserve: bool = True) -> DataFrame:
    """The ``depth`` best candidates by (``new_score`` descending, id).

    ``candidates``: query, ident, rank, ``roles``, ``new_score``. With
    ``preserve`` the first min(depth, max(2, depth // 2)) by rank, and the first
    with each safety role, keep a place; the order stays that of the new scores.
    Candidates without a finite new score are an error. Result: query, ident, rank.
    """
    finite = F.col("new_score").isNotNull() & ~F.isnan("new_score") & (F.abs("new_score") < float("inf"))
    checked = candidates.withColumn("new_score", F.when(finite, F.col("new_score")).otherwise(F.raise_error(F.lit("a candidate has no finite score")).cast("double")))
    before = F.sort_array(F.collect_list(F.struct("rank", F.col(ident).alias("id"), "roles")))
    after = F.sort_array(F.collect_list(F.struct((-F.col("new_score")).alias("s"), F.col(ident).alias("id"))))
    lists = checked.groupBy(query).agg(before.alias("old"), F.transform(after, lambda x: x["id"]).alias("new"))
    floor = F.slice("old", 1, min(depth, max(2, depth // 2)))["id"]
    reserved = F.slice(F.array_distinct(F.concat(floor, *[_first_with(F.col("old"), r) for r in SAFETY_ROLES])), 1, depth)
    lists = lists.withColumn("kept", reserved if preserve else F.slice("new", 1, 0))
    chosen = F.concat("kept", F.slice(F.array_except("new", "kept"), F.lit(1), F.lit(depth) - F.size("kept")))
    lists = lists.withColumn("chosen", chosen)
    return _unnested(lists, query, ident, F.filter("new", lambda i: F.array_contains("chosen", i)))


_TOKEN = regex.compile(r"[\w.-]+")


def overlaps(left: str | None, right: str | None, least: float = 0.85) -> bool:
    """Shared tokens are at least this part of the smaller token set; never so if either has none."""
    a, b = (set(_TOKEN.findall((x or "").casefold())) for x in (left, right))
    return bool(a and b) and len(a & b) / min(len(a), len(b)) >= least


def _conflict_order(items: list[dict], sides: list[list], depth: int, limit: int) -> list[tuple]:
    """(id, rule) in the order chosen; ``items`` are in fused order, ``sides`` the ranked ids of each conflict side."""
    by_id = {x["id"]: x for x in items}
    head: dict[object, str] = {}

    def take(ident: object, rule: str) -> None:
        if len(head) < depth and ident not in head:
            head[ident] = rule

    for number, side in enumerate(sides, 1):
        for ident in side[:2]:
            take(ident, f"SIDE {number}")
    for role in [PRIMARY, *SAFETY_ROLES]:
        holder = next((x["id"] for x in items[:depth] if role in x["roles"]), None)
        if holder is not None:
            take(holder, f"ROLE {role}")
    seen = {by_id[i]["version"] for i in head if i in by_id}
    for x in items:
        if len(seen) >= min(3, depth):
            break
        if x["version"] not in seen:
            take(x["id"], "VERSION")
            seen.add(x["version"])
    later = []
    for x in items:
        if x["id"] not in head:
            if any(overlaps(x["text"], by_id[kept]["text"]) for kept in head if kept in by_id):
                later.append(x["id"])
            else:
                take(x["id"], "DISTINCT")
    for ident in later:
        take(ident, "BACKFILL")
    rest = [(x["id"], "TAIL") for x in items if x["id"] not in head]
    return [*head.items(), *rest][:limit]


def conflict_head(fused: DataFrame, sides: DataFrame, query: str, ident: str, depth: int, limit: int) -> DataFrame:
    """A head that shows both sides of a conflict: query, ident, rank, ``rule``.

    ``fused``: query, ident, rank, ``roles``, ``version``, ``text`` (at most a few
    hundred rows a query). ``sides``: query, ident, ``side`` (a number), rank. The
    first ``depth`` places go to two of each side, one for each role among the
    first ``depth`` fused, up to three versions, then fused ones that don't repeat
    what is kept, then ones that do; the rest follows. Every choice depends on
    those before it, so a query's list is worked through in one pandas group.
    An id of a side that the fused list lacks is placed without text.
    """
    kind = fused.schema[ident].dataType
    one = fused.select(query, F.lit(0).alias("side"), F.col("rank"), F.col(ident).alias("id"), "roles", "version", "text")
    two = sides.select(query, "side", "rank", F.col(ident).alias("id"), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("text"))
    schema = T.StructType([fused.schema[query], T.StructField(ident, kind), T.StructField("rank", T.IntegerType()), T.StructField("rule", T.StringType())])

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "rank"])
        items = [{"id": r.id, "roles": [] if r.roles is None else list(r.roles), "version": r.version, "text": r.text} for r in group[group["side"] == 0].itertuples()]
        by_side = [part["id"].tolist() for side, part in group[group["side"] > 0].groupby("side")]
        order = _conflict_order(items, by_side, depth, limit)
        return pd.DataFrame([(key[0], i, n, rule) for n, (i, rule) in enumerate(order, 1)], columns=schema.names)

    return one.unionByName(two).groupBy(query).applyInPandas(choose, schema)


def distinct_best(order: DataFrame, query: str, ident: str, content: str, k: int) -> DataFrame:
    """First of each content along a ranked list wins, then the best ``k``; ``suppressed``: the ids each winner stands for.

    ``order``: query, ident, rank, content print. Result: query, ident, ``place``
    from 1, ``suppressed`` in rank order. Repeats of a winner count however deep
    they are; repeats of what isn't chosen don't.
    """
    best = order.groupBy(query, content).agg(F.min(F.struct("rank", F.col(ident).alias("id"))).alias("first"), F.sort_array(F.collect_list(F.struct("rank", F.col(ident).alias("id")))).alias("all"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("first.rank"))
    kept = best.withColumn("place", place).where(F.col("place") <= k)
    return kept.select(query, F.col("first.id").alias(ident), "place", F.transform(F.slice("all", 2, 1 << 30), lambda x: x["id"]).alias("suppressed"))


def role_gate(chosen: DataFrame, query: str, required: list[str], bearing: list[str], qualified: tuple[str, ...] = (PRIMARY,)) -> DataFrame:
    """Which required roles the chosen passages of each query cover: ``covered``, ``missing``, ``passes``, ``n_disqualified``.

    ``chosen``: query, ``roles``, ``kind``. A role in ``qualified`` counts from a
    passage only if its kind is among ``bearing``; such claims of other kinds are
    counted as disqualified. A query without passages gives no row.
    """
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    bears = F.coalesce(F.col("kind").isin(bearing), F.lit(False))
    special = F.array(*[F.lit(r) for r in qualified])
    counted = F.when(bears, roles).otherwise(F.array_except(roles, special))
    claims = F.when(bears, 0).otherwise(F.size(F.array_intersect(roles, special)))
    sums = chosen.withColumn("_roles", counted).withColumn("_claims", claims).groupBy(query)
    gathered = sums.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_roles")))).alias("covered"), F.sum("_claims").alias("n_disqualified"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("covered"))
    return gathered.withColumn("missing", missing).withColumn("passes", F.size("missing") == 0)


def isolated(spark: SparkSession, lanes: dict[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, dict[str, str]]:
    """(rows of all lanes, failure codes): a lane that can't be made or run counts as empty and leaves a code.

    Each lane is run and cut on its own, so that a failure shows here and not in the fusion.
    """
    from korpuskel.session import cut

    out, failures = spark.createDataFrame([], schema), {}
    for name, make in lanes.items():
        try:
            out = out.unionByName(cut(make().withColumn("lane", F.lit(name)).select(*out.columns)))
        except Exception as error:  # noqa: BLE001 - any failure of one lane is survivable
            failures[name] = f"{name.upper()}_LANE_FAILURE:{type(error).__name__}"
    return out, failures


def trace(gold: DataFrame, lanes: DataFrame, weights: dict[str, float], query: str, ident: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(gold, queries): where fusion loses gold.

    ``gold``: query, ident. ``lanes``: lane, query, ident, rank as they go into
    fusion. The first frame has, per gold id, the rank and the contribution
    weight / (k + rank) in each lane (null and 0 where the lane lacks it) and the
    fused rank; the second ``failure_class`` per query: CANDIDATE_GENERATION_FAILURE
    if a gold id beyond ``depth`` is in no lane, else SELECTION_FAILURE if one is
    beyond ``depth``, else NO_FAILURE. Queries without gold give no row.
    """
    fused = ranked(fuse(lanes, weights, query, ident), query, ident, None).select(query, ident, F.col("rank").alias("fused_rank"))
    held = gold.select(query, ident).distinct().join(lanes.select("lane", query, ident, "rank"), [query, ident], "left")
    own = {lane: F.max(F.when(F.col("lane") == lane, F.col("rank"))) for lane in weights}
    ranks = held.groupBy(query, ident).agg(*[r.alias(f"{lane}_rank") for lane, r in own.items()])
    parts = {f"{lane}_part": F.round(F.coalesce(F.lit(w) / (K + F.col(f"{lane}_rank")), F.lit(0.0)), DIGITS) for lane, w in weights.items()}
    each = ranks.withColumns(parts).join(fused, [query, ident], "left")
    beyond = F.coalesce(F.col("fused_rank") > depth, F.lit(True))
    nowhere = F.coalesce(*[F.col(f"{lane}_rank") for lane in weights]).isNull()
    kind = F.when(F.bool_or(beyond & nowhere), "CANDIDATE_GENERATION_FAILURE").when(F.bool_or(beyond), "SELECTION_FAILURE").otherwise("NO_FAILURE")
    return each, each.groupBy(query).agg(kind.alias("failure_class"))

"""Registry operators: latest and as-of rows, intervals, neighbourhoods, reachability, digests, idempotent appends."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.session import cut


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` LEFT or RIGHT; null keys are left out. One aggregation, no join."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.dropna(subset=keys).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).where(F.col("_l") != F.col("_r"))
    return sides.select(*keys, F.when(F.col("_l") == 1, "LEFT").otherwise("RIGHT").alias("side"))


def _carried(rows: DataFrame, group: list[str], bucket: str, order: list[str], values: list[str], known: str | None) -> DataFrame:
    """Per group and bucket what the buckets before it leave: rows, values of the last row, last known value of ``known``.

    A small row per bucket; only these are put in order over a whole group.
    """
    place = F.struct(*order)
    parts = rows.groupBy(*group, bucket).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(v), place).alias(f"_last_{v}") for v in values],
        *([F.max_by(known, F.when(F.col(known).isNotNull(), place)).alias("_known")] if known else []),
    )
    over = Window.partitionBy(*group).orderBy(bucket)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.lag(f"_last_{v}").over(over)[v].alias(f"_carried_{v}") for v in values]]
    if known:
        carried.append(F.last("_known", ignorenulls=True).over(before).alias("_carried_known"))
    return parts.select(*group, bucket, *carried)


def latest_before(rows: DataFrame, group: list[str], order: list[str], bucket: str, *values: str) -> DataFrame:
    """Each row with the ``values`` of the row before it in its group as ``previous_...`` (null for the first) and its ``sequence_no``.

    ``bucket`` is a coarse form of the first column of ``order``, as its day: rows
    are put in order within (group, bucket) only, and what earlier buckets leave
    is carried over, so a group with a third of all rows is never in one task.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    joined = rows.join(_carried(rows, group, bucket, order, list(values), None), [*group, bucket])
    number = F.row_number().over(inside)
    previous = {f"previous_{v}": F.when(number == 1, F.col(f"_carried_{v}")).otherwise(F.lag(v).over(inside)) for v in values}
    return joined.withColumns(previous | {"sequence_no": F.col("_before") + number}).drop("_before", *[f"_carried_{v}" for v in values])


def neighbourhood(anchors: DataFrame, rows: DataFrame, scope: str, position: str, radius: int) -> DataFrame:
    """Rows of the anchor's scope within ``radius`` of its position; anchor columns get the prefix anchor_.

    The band is turned into an equi-join: an anchor is put into the few position
    buckets its band touches, so a scope with many rows isn't paired with itself.
    """
    width = 2 * radius + 1
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    named = anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns])
    place = F.col(f"anchor_{position}")
    spread = named.withColumn("_b", F.explode(F.sequence(bucket(place - radius), bucket(place + radius))))
    cut = rows.withColumn("_b", bucket(F.col(position)))
    joined = spread.join(cut, (spread[f"anchor_{scope}"] == cut[scope]) & (spread["_b"] == cut["_b"]))
    return joined.where(F.abs(F.col(position) - place) <= radius).drop("_b")


def fill_forward(rows: DataFrame, group: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """The last known ``value`` at or before each row of its group; ``bucket`` as in ``latest_before``."""
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(_carried(rows, group, bucket, order, [], value), [*group, bucket])
    return joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried_known"))).drop("_before", "_carried_known")


def reachable(edges: DataFrame, start: str, end: str) -> DataFrame:
    """All (start, end, steps) along paths of the edges, with the fewest steps; cycles end, as a pair is taken once.

    Works in waves, each a join of the newest pairs with the edges; every wave
    is cut, so the plan doesn't grow with the depth.
    """
    links = edges.select(F.col(start).alias("_s"), F.col(end).alias("_e")).dropna().distinct()
    found = cut(links.select(F.col("_s").alias(start), F.col("_e").alias(end), F.lit(1).alias("steps")))
    newest, step = found, 1
    while True:
        step += 1
        further = newest.join(links, newest[end] == links["_s"]).select(start, F.col("_e").alias(end)).distinct()
        newest = cut(further.join(found, [start, end], "left_anti").withColumn("steps", F.lit(step)))
        if newest.isEmpty():
            return found
        found = cut(found.unionByName(newest))


def set_digest(rows: DataFrame, group: list[str], ident: Column, content: Column, bits: int = 12) -> DataFrame:
    """A digest of each group's set of (id, content), whatever the order: ``n_members``, ``digest``.

    Members are hashed, put in order within 2^bits hash buckets and digested per
    bucket, then the bucket digests in order: no task holds a group. ``bits`` is
    part of the digest: 12 serve groups of about a billion members, which are then
    250,000 to a bucket.
    """
    member = F.sha2(F.concat_ws("|", ident, content), 256)
    placed = rows.select(*group, member.alias("m")).distinct().withColumn("bucket", F.conv(F.substring("m", 1, 8), 16, 10).cast("bigint") % F.lit(1 << bits))
    partial = placed.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("m")), ""), 256).alias("d"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"])
    return partial.groupBy(*group).agg(F.sum("n").alias("n_members"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append to a keyed store: the first of each key that the store doesn't have yet."""
    first = incoming.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*order, *[c for c in incoming.columns if c not in {*key, *order}])).alias("_row"))
    flat = first.select(*key, "_row.*").select(*incoming.columns)
    return flat.join(stored.select(*key).distinct(), key, "left_anti")


def resolve_versions(specs: DataFrame, known: DataFrame) -> DataFrame:
    """``spec`` and the ``version`` it stands for: itself for an exact version that is known, the highest known patch for a range like 1.2.x.

    Pre-releases and builds match no range. Other specs, and ones that nothing
    matches, get null: they aren't deterministic. ``specs``: spec; ``known``: version.
    """
    parts = X.version_parts(F.col("version"))
    numbered = known.select("version", parts.alias("p")).where(F.col("p").isNotNull()).distinct()
    ranges = numbered.groupBy(F.col("p.major").alias("major"), F.col("p.minor").alias("minor")).agg(F.max(F.struct("p.patch", "version"))["version"].alias("highest"))
    named = specs.select("spec").distinct()
    exact = numbered.select(F.col("version").alias("spec"), "version")
    split = F.split("spec", r"\.")
    wanted = named.where(F.col("spec").rlike(r"^\d+\.\d+\.x$")).select("spec", split[0].try_cast("bigint").alias("major"), split[1].try_cast("bigint").alias("minor"))
    found = exact.unionByName(wanted.join(ranges, ["major", "minor"]).select("spec", F.col("highest").alias("version")))
    return named.join(found, "spec", "left")


def keyed_hash(key: str, value: Column) -> Column:
    """HMAC with SHA-256 of a text under a key, as hex; null for null."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pads = [F.lit(bytes(b ^ pad for b in raw.ljust(64, b"\0"))) for pad in (0x36, 0x5C)]
    inner = F.sha2(F.concat(pads[0], F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(pads[1], F.unhex(inner)), 256)


def keyed_halves(rows: DataFrame, ident: str, key: str) -> DataFrame:
    """(ident, ``half``): FIRST for the smaller half of the keyed hashes (rounded down), SECOND for the rest; null ids are left out.

    The middle is found by counts: over 65,536 buckets of the hash, and then over
    the rows of the one bucket that holds it, so no task ranks all rows.
    """
    hashed = rows.where(F.col(ident).isNotNull()).select(ident, keyed_hash(key, F.col(ident).cast("string")).alias("_k")).withColumn("_b", F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b"))
    whole = F.sum("_n").over(Window.partitionBy())
    placed = counts.select("_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.floor(whole / 2).alias("_half"))
    joined = hashed.join(placed, "_b")
    inside = joined.where((F.col("_before") < F.col("_half")) & (F.col("_upto") > F.col("_half")))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_k", ident))
    split = inside.select(ident, F.when(F.col("_before") + rank <= F.col("_half"), "FIRST").otherwise("SECOND").alias("half"))
    clear = joined.where((F.col("_before") >= F.col("_half")) | (F.col("_upto") <= F.col("_half")))
    return clear.select(ident, F.when(F.col("_upto") <= F.col("_half"), "FIRST").otherwise("SECOND").alias("half")).unionByName(split)


def all_pairs(spark: SparkSession, left: str, lefts: list[str], right: str, rights: list[str]) -> DataFrame:
    """Every pair of two short lists of names, as a frame to fill with zeros."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in lefts])).alias(left))
    return one.withColumn(right, F.explode(F.array(*[F.lit(x) for x in rights])))


def active_at(rows: DataFrame, key: list[str], at: Column, expires: str, order: list[Column], values: list[str]) -> DataFrame:
    """Per key the latest row (by ``order``) that hasn't expired at a time; a null expiry never comes. One aggregation."""
    live = rows.where(F.col(expires).isNull() | (F.col(expires) > at))
    best = live.dropna(subset=key).groupBy(*key).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(v) for v in values])).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{v}").alias(v) for v in values])


def accounted(expected: DataFrame, included: DataFrame, excepted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per ``by`` whether included and excepted ids make up the expected ones without overlap: ``n_expected``, ``n_missing``, ``n_extra``, ``n_both``, ``is_sound``.

    One aggregation over the three tagged together; null keys are left out.
    """
    sides = [df.select(*keys, *[F.lit(int(i == j)).alias(f"_s{j}") for j in range(3)]) for i, df in enumerate((expected, included, excepted))]
    one = sides[0].unionByName(sides[1]).unionByName(sides[2]).dropna(subset=keys).groupBy(*keys).agg(*[F.max(f"_s{j}").alias(f"_s{j}") for j in range(3)])
    listed, inside, out = (F.col(f"_s{j}") == 1 for j in range(3))
    sums = one.groupBy(*by).agg(F.count_if(listed).alias("n_expected"), F.count_if(listed & ~inside & ~out).alias("n_missing"), F.count_if(~listed).alias("n_extra"), F.count_if(inside & out).alias("n_both"))
    return sums.withColumn("is_sound", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_both") == 0))


def register_conflicts(rows: DataFrame, digest: str, *fields: str) -> DataFrame:
    """Digests that were registered with differing metadata: how many forms each field has; nulls count as a form."""
    form = lambda f: F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0null")))
    forms = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(*[form(f).alias(f"n_{f}") for f in fields])
    return forms.where(F.greatest(F.lit(0), *[F.col(f"n_{f}") for f in fields]) > 1)


def grounded(claims: DataFrame, retrieved: DataFrame, query: str, claim: str, cited: str, ident: str) -> DataFrame:
    """(query, claim, ``n_cited``, ``is_supported``): a claim stands if it cites something and all of it was retrieved for its query.

    ``claims``: query, claim, array of cited ids (null is empty, nulls in it and
    repeats don't count). ``retrieved``: query, ident; rows may repeat.
    """
    ids = F.array_distinct(F.array_compact(F.coalesce(F.col(cited), F.array().cast("array<string>"))))
    each = claims.select(query, claim, F.explode_outer(ids).alias(ident))
    have = retrieved.select(query, ident).distinct().withColumn("_have", F.lit(1))
    both = each.join(have, [query, ident], "left")
    return both.groupBy(query, claim).agg(F.count(ident).alias("n_cited"), (F.count("_have") == F.count(F.lit(1))).alias("is_supported"))


def with_cache(pairs: DataFrame, cache: DataFrame, key: Column, score: Column) -> DataFrame:
    """``pairs`` with ``cache_key``, ``score`` and ``is_cached``: scores that the cache has, and ``score`` for the others.

    ``cache``: cache_key, score; repeated keys take the largest score.
    """
    known = cache.groupBy("cache_key").agg(F.max("score").alias("_s"))
    joined = pairs.withColumn("cache_key", key).join(known, "cache_key", "left")
    return joined.withColumn("is_cached", F.col("_s").isNotNull()).withColumn("score", F.coalesce("_s", score)).drop("_s")

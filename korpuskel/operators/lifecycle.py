"""Versions over time: what is in force, what a relationship takes out of force, closures of dependencies, cycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpuskel.session import cut

#: Relationships that take their own version out of force. Fixed values.
INVALIDATING = ["SUPERSEDES", "PARTIALLY_SUPERSEDES", "AMENDS", "CORRECTS", "WITHDRAWS", "REPLACES_SECTION"]


def in_force(rows: DataFrame, moments: DataFrame, start: str, end: str, at: str) -> DataFrame:
    """Pairs of rows and moments with ``start`` <= ``at`` <= ``end`` (dates); a null bound is open.

    An equi-join on months: a row is put into the months that it is in force in,
    within the span of the moments, so neither side is paired with all of the
    other. Moments without a date are left out.
    """
    span = moments.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span.lo is None:
        return rows.crossJoin(moments.limit(0))
    month = lambda c: F.trunc(c, "month")
    first, last = F.greatest(F.coalesce(F.col(start), F.lit(span.lo)), F.lit(span.lo)), F.least(F.coalesce(F.col(end), F.lit(span.hi)), F.lit(span.hi))
    months = F.when(first <= last, F.sequence(month(first), month(last), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    spread = rows.withColumn("_month", F.explode(months))
    joined = spread.join(moments.withColumn("_month", month(F.col(at))), "_month").drop("_month")
    return joined.where(F.coalesce(F.col(start) <= F.col(at), F.lit(True)) & F.coalesce(F.col(end) >= F.col(at), F.lit(True)))


def taken_out(evidence: DataFrame, relationships: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Evidence with ``is_hit``: an invalidating relationship of its version is active at ``at`` and names it, or names nothing.

    ``evidence``: ``keys``, version_id, evidence_id, section_id, recommendation_id
    and ``at``. ``relationships``: version_id, kind, valid_from, valid_to (dates,
    null is open), evidence_ids, section_ids, recommendation_ids (arrays, null is
    empty). A join on the version; the rest is tested on its few relationships,
    which are gathered in one row a version.
    """
    active = relationships.where(F.col("kind").isin(INVALIDATING)).select("version_id", F.struct("valid_from", "valid_to", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("evidence_ids", "section_ids", "recommendation_ids")]).alias("r"))
    gathered = active.groupBy("version_id").agg(F.collect_list("r").alias("_r"))
    named = lambda r, ids, one: F.coalesce(F.array_contains(r[ids], F.col(one)), F.lit(False))
    hits = F.exists(
        "_r",
        lambda r: (r["valid_from"].isNull() | (r["valid_from"] <= F.col(at)))
        & (r["valid_to"].isNull() | (r["valid_to"] >= F.col(at)))
        & ((F.size(r["evidence_ids"]) + F.size(r["section_ids"]) + F.size(r["recommendation_ids"]) == 0) | named(r, "evidence_ids", "evidence_id") | named(r, "section_ids", "section_id") | named(r, "recommendation_ids", "recommendation_id")),
    )
    joined = evidence.join(gathered, "version_id", "left")
    return joined.select(*keys, "version_id", "evidence_id", at, F.coalesce(hits, F.lit(False)).alias("is_hit"))


@dataclass
class Closure:
    """What a closure found: its packages with their depth, the requirements met, and why it isn't complete."""

    packages: DataFrame  # package, depth (of the first requirement that led to it)
    requirements: DataFrame  # parent, package, depth
    issues: list[str]


PACKAGE_LIMIT, DEPTH_LIMIT, MISSING_PACKAGE, CYCLE = "PACKAGE_LIMIT", "DEPTH_LIMIT", "MISSING_PACKAGE", "CYCLE"


def closure(roots: DataFrame, dependencies: DataFrame, known: DataFrame, max_packages: int, max_depth: int) -> Closure:
    """All packages that ``roots`` (package) need, in waves: breadth first, each requirement once.

    ``dependencies``: parent, package. ``known``: package. A requirement of a
    package that isn't known is an issue and goes no further; so is one deeper
    than ``max_depth``; a wave that would bring more than ``max_packages`` ends it. Every wave is
    one join with the dependencies and is cut, so the plan doesn't grow.
    """
    links = dependencies.select("parent", "package").dropna().distinct()
    wave = cut(roots.select(F.lit("ROOT").alias("parent"), "package").dropna().distinct().withColumn("depth", F.lit(1)))
    requirements, packages, issues, depth = wave.limit(0), cut(wave.select("package", "depth").limit(0)), set(), 1
    while not wave.isEmpty():
        met = cut(wave.join(known.select("package").distinct(), "package", "left_semi").select("parent", "package", "depth"))
        if met.count() < wave.count():
            issues.add(MISSING_PACKAGE)
        fresh = cut(met.select("package").distinct().join(packages, "package", "left_anti").withColumn("depth", F.lit(depth)))
        if packages.count() + fresh.count() > max_packages:
            issues.add(PACKAGE_LIMIT)
            break
        requirements, packages = cut(requirements.unionByName(met)), cut(packages.unionByName(fresh))
        children = fresh.select(F.col("package").alias("parent")).join(links, "parent").select("parent", "package")
        depth += 1
        if depth > max_depth:
            if not children.isEmpty():
                issues.add(DEPTH_LIMIT)
            break
        wave = cut(children.withColumn("depth", F.lit(depth)))
    if has_cycle(requirements.where("parent <> 'ROOT'").select("parent", "package"), "parent", "package"):
        issues.add(CYCLE)
    return Closure(packages, requirements, sorted(issues))


def has_cycle(edges: DataFrame, start: str, end: str) -> bool:
    """Whether the edges hold a cycle: nodes without a way in are peeled off until none is left or all that are left have one."""
    left = cut(edges.select(F.col(start).alias("s"), F.col(end).alias("e")).dropna().distinct())
    count = left.count()
    while count:
        left = cut(left.join(left.select(F.col("e").alias("s")).distinct(), "s", "left_semi"))
        smaller = left.count()
        if smaller == count:
            return True
        count = smaller
    return False


def closing_edges(edges: DataFrame, new: DataFrame, start: str, end: str) -> DataFrame:
    """The new edges that would close a cycle: from a node to itself, or back to one that reaches them.

    Each is held against the edges there are, not against other new ones. The
    nodes reached from the new edges' ends are followed in waves, from these ends only.
    """
    links = cut(edges.select(F.col(start).alias("_s"), F.col(end).alias("_e")).dropna().distinct())
    wanted = new.select(start, end).dropna().distinct()
    found = cut(wanted.select(F.col(end).alias("origin"), F.col(end).alias("node")).distinct())
    newest = found
    while not newest.isEmpty():
        further = newest.join(links, newest["node"] == links["_s"]).select("origin", F.col("_e").alias("node")).distinct()
        newest = cut(further.join(found, ["origin", "node"], "left_anti"))
        found = cut(found.unionByName(newest))
    return wanted.join(found.select(F.col("origin").alias(end), F.col("node").alias(start)), [start, end], "left_semi")

"""Measures of retrieval per case, their summaries with intervals, and thresholds that they must reach."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ["recall", "ndcg", "reciprocal_rank", "precision", "precision_ceiling", "r_precision", "role_recall"]
ANSWERABLE, INSUFFICIENT, ALL = "ANSWERABLE", "INSUFFICIENT", "ALL"
_GOT = "array<struct<place:int,id:string,roles:array<string>>>"


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 1 without trials."""
    n = trials.cast("double")
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    none = trials == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def zero_bound(trials: Column, alpha: float = 0.05) -> Column:
    """Upper bound of a rate of which no case was seen in ``trials``; 1 without trials."""
    return F.when(trials <= 0, 1.0).otherwise(1.0 - F.pow(F.lit(alpha), F.lit(1.0) / trials))


def case_metrics(cases: DataFrame, retrieved: DataFrame, modes: list[str], depth: int, budget: int) -> DataFrame:
    """Measures of every case in every mode, also of cases and modes for which nothing was retrieved.

    ``cases``: case_id, ``gold`` array of (id, grade, required), ``sets`` array of
    arrays of ids, ``forbidden`` ids, ``required_roles``, ``insufficient`` boolean;
    null lists are empty. ``retrieved``: mode, case_id, id, place from 1, roles.

    A case is complete if one of its sets was retrieved, or without sets all its
    required gold if it has any. Precision is of what was retrieved, its ceiling
    of ``depth``. Cases of insufficient evidence score 1 if nothing was retrieved,
    else 0; their ceiling and role recall are 1. Repeated gold counts once, with
    its largest grade.
    """
    lists = retrieved.groupBy("mode", "case_id").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("id"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles")))).cast(_GOT).alias("got"))
    every = cases.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    both = every.join(lists, ["mode", "case_id"], "left").withColumn("got", F.coalesce("got", F.array().cast(_GOT)))
    empty = F.array().cast("array<string>")
    golds = F.filter(F.coalesce("gold", F.array().cast("array<struct<id:string,grade:int,required:boolean>>")), lambda g: g["id"].isNotNull())
    best = lambda i: F.aggregate(F.filter(golds, lambda g: g["id"] == i), F.lit(0), lambda acc, g: F.greatest(acc, F.coalesce(g["grade"], F.lit(0))))
    both = both.withColumn("grades", F.map_from_entries(F.transform(F.array_distinct(F.transform(golds, lambda g: g["id"])), lambda i: F.struct(i, best(i)))))
    both = both.withColumn("hits", F.filter("got", lambda g: F.map_contains_key("grades", g["id"])))
    needed = F.array_distinct(F.transform(F.filter(golds, lambda g: F.coalesce(g["required"], F.lit(False))), lambda g: g["id"]))
    sets = F.coalesce("sets", F.array().cast("array<array<string>>"))
    both = both.withColumn("complete_sets", F.when(F.size(sets) > 0, sets).when(F.size(needed) > 0, F.array(needed)).otherwise(F.slice(sets, 1, 0)))
    within = lambda n: F.transform(F.filter("got", lambda g: g["place"] <= n), lambda g: g["id"])
    complete = lambda n: F.exists("complete_sets", lambda s: F.size(F.array_except(s, within(n))) == 0)
    gain = lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1.0)
    dcg = F.aggregate("hits", F.lit(0.0), lambda acc, g: acc + gain(F.element_at("grades", g["id"]), g["place"].cast("double")))
    ideal = F.slice(F.sort_array(F.map_values("grades"), asc=False), 1, depth)
    most = F.aggregate(F.transform(ideal, lambda g, i: gain(g, i + 1.0)), F.lit(0.0), lambda acc, v: acc + v)
    n_gold = F.greatest(F.size("grades"), F.lit(1))
    r_depth = F.least(n_gold, F.lit(depth))
    got_roles = F.array_distinct(F.flatten(F.transform("hits", lambda g: g["roles"])))
    wanted = F.array_distinct(F.coalesce("required_roles", empty))
    abstained = F.size("got") == 0
    scored = lambda measure, otherwise=abstained: F.when(F.col("insufficient"), otherwise.cast("double")).otherwise(measure)
    one = F.lit(1.0)
    return both.select(
        "mode",
        "case_id",
        F.when(F.col("insufficient"), INSUFFICIENT).otherwise(ANSWERABLE).alias("population"),
        scored(F.size("hits") / n_gold).alias("recall"),
        scored(F.when(most > 0, dcg / most).otherwise(0.0)).alias("ndcg"),
        scored(F.coalesce(one / F.array_min(F.transform("hits", lambda g: g["place"])), F.lit(0.0))).alias("reciprocal_rank"),
        scored(F.when(F.size("got") > 0, F.size("hits") / F.size("got")).otherwise(0.0)).alias("precision"),
        scored(r_depth / F.lit(float(depth)), one).alias("precision_ceiling"),
        scored(F.size(F.filter("hits", lambda g: g["place"] <= r_depth)) / r_depth).alias("r_precision"),
        scored(F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, got_roles)) / F.size(wanted)).otherwise(1.0), one).alias("role_recall"),
        F.when(F.col("insufficient"), abstained).otherwise(complete(depth)).alias("complete"),
        F.when(F.col("insufficient"), abstained).otherwise(complete(budget)).alias("complete_at_budget"),
        F.size(F.array_intersect(F.array_distinct(F.transform("got", lambda g: g["id"])), F.coalesce("forbidden", empty))).alias("n_forbidden"),
    )


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Means and counts per group and population (all, answerable, insufficient), with Wilson intervals of completeness.

    Insufficient cases are scored by abstention, so a blended mean hides what
    happens to the answerable ones; hence the populations side by side.
    """
    each = metrics.withColumn("population", F.explode(F.array(F.lit(ALL), "population"))).groupBy(*by, "population")
    sums = each.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if("complete").alias("n_complete"),
        F.count_if("complete_at_budget").alias("n_at_budget"),
        F.count_if(F.col("n_forbidden") > 0).alias("n_leaking"),
        *[F.round(F.avg(m), 6).alias(m) for m in MEASURES],
    )
    low, high = wilson(F.col("n_complete"), F.col("n_cases"))
    budget_low, budget_high = wilson(F.col("n_at_budget"), F.col("n_cases"))
    rounded = {"complete_low": low, "complete_high": high, "at_budget_low": budget_low, "at_budget_high": budget_high}
    return sums.withColumns({n: F.round(c, 6) for n, c in rounded.items()})


def unmet(summaries: DataFrame, thresholds: list[tuple[str, str, str, float, bool]], *by: str) -> DataFrame:
    """Thresholds that a summary doesn't reach: ``by``, ``position``, ``code``, ``reached``, ``threshold``.

    A threshold is (code, population, measure, value, is_most). A measure below
    its value is unmet, or above it with ``is_most``; measures that are null, of
    populations without cases, are left out. Give a lower bound's column as the
    measure to hold the bound against the value.
    """
    none = F.lit(None).cast("struct<position:int,code:string,reached:double,threshold:double>")
    checks = []
    for position, (code, population, measure, value, is_most) in enumerate(thresholds, 1):
        reached = F.col(measure).cast("double")
        bad = (F.col("population") == population) & ((reached > value) if is_most else (reached < value))
        checks.append(F.when(bad, F.struct(F.lit(position).alias("position"), F.lit(code).alias("code"), reached.alias("reached"), F.lit(float(value)).alias("threshold"))).otherwise(none))
    return summaries.select(*by, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(*by, "x.*")


def _ends(population: int, successes: int, draws: int) -> tuple[int, int]:
    """The fewest and the most successes that there can be among the draws."""
    return max(0, draws - (population - successes)), min(successes, draws)


def _ways(population: int, successes: int, draws: int) -> Iterator[int]:
    """In how many of the comb(population, draws) draws there are k successes, for each k that can be."""
    low, high = _ends(population, successes, draws)
    rest = population - successes - draws
    ways = math.comb(successes, low) * math.comb(population - successes, draws - low)
    for k in range(low, high):
        yield ways
        ways = ways * ((successes - k) * (draws - k)) // ((k + 1) * (rest + k + 1))
    yield ways


def _weights(population: int, successes: int, draws: int, bits: int) -> tuple[int, list[int], int]:
    """(k of the first, weights, slack): ``_ways`` in units of 2**-bits of the largest, rounded down, without the ends where they are 0.

    Walked from the largest outwards, where each ratio is at most 1, so a step adds at most 1 to what a weight lacks. Any sum of
    weights, those of the ends included, lacks at most ``slack``.
    """
    low, high = _ends(population, successes, draws)
    rest = population - successes - draws
    mode = min(max((draws + 1) * (successes + 1) // (population + 2), low), high)
    up, down = [1 << bits], [1 << bits]
    for k in range(mode, high):
        up.append(up[-1] * ((successes - k) * (draws - k)) // ((k + 1) * (rest + k + 1)))
        if not up[-1]:
            break
    for k in range(mode, low, -1):
        down.append(down[-1] * (k * (rest + k)) // ((successes - k + 1) * (draws - k + 1)))
        if not down[-1]:
            break
    return mode - len(down) + 1, down[:0:-1] + up, max(len(up), len(down)) * (high - low + 1)


def _edge(population: int, successes: int, draws: int, half: Fraction) -> int:
    """The least k for which the chance of at most k successes is above ``half``."""
    low, high = _ends(population, successes, draws)
    if not 0 < half < 1:
        return low if half <= 0 else high
    first, weights, slack = _weights(population, successes, draws, 128)
    whole = sum(weights)
    sure, unsure = math.floor(half * (whole + slack)), math.floor(half * whole) - slack
    below = 0
    for k, weight in enumerate(weights, first):
        below += weight
        if below > sure or (below > unsure and sum(islice(_ways(population, successes, draws), k - low + 1)) > half * math.comb(population, draws)):
            return k
    return high


def _chance_of_rarer(population: int, successes: int, draws: int, observed: int) -> float:
    """Chance of a number of successes that is no likelier than the observed one; 0 for one that can't be."""
    low, high = _ends(population, successes, draws)
    if not low <= observed <= high:
        return 0.0
    rest = population - successes - draws

    def is_rarer(k: int) -> bool:
        """Exactly, by the product of the ratios between the two."""
        a, n = min(k, observed), abs(k - observed)
        larger, smaller = math.perm(successes - a, n) * math.perm(draws - a, n), math.perm(a + n, n) * math.perm(rest + a + n, n)
        return larger >= smaller if k < observed else larger <= smaller

    for bits in (128, 512, 2048):
        first, weights, slack = _weights(population, successes, draws, bits)
        bar = weights[observed - first] if 0 <= observed - first < len(weights) else 0
        if bar > slack << 64:
            rare, whole = sum(w for k, w in enumerate(weights, first) if w + slack <= bar or (w <= bar + slack and is_rarer(k))), sum(weights)
            if (p := rare / (whole + slack)) == (rare + slack) / whole:
                return p
    if bar <= slack << 64:
        return 0.0  # less than the least double
    bar = next(islice(_ways(population, successes, draws), observed - low, None))
    return sum(w for w in _ways(population, successes, draws) if w <= bar) / math.comb(population, draws)


def hypergeometric(population: int, successes: int, draws: int, observed: int, alpha: float = 0.05) -> tuple[int, int, float]:
    """(low, high, p): the central interval that leaves at most half of ``alpha`` in each tail, and the chance of an outcome no more likely than the observed one.

    Exact, p as the double nearest to it, in time that grows with the standard deviation of the successes. Counts of all outcomes,
    numbers of up to as many bits as the population, are taken only where fixed-point sums and their bounds can't decide: on a tie.
    """
    if not (0 <= successes <= population and 0 <= draws <= population):
        raise ValueError(f"{successes} successes and {draws} draws of {population}")
    if abs(2 * successes - population) > abs(2 * draws - population):
        successes, draws = draws, successes  # the same chances, shorter numbers
    half = Fraction(alpha).limit_denominator(10**9) / 2
    return _edge(population, successes, draws, half), draws - _edge(population, population - successes, draws, half), _chance_of_rarer(population, successes, draws, observed)


def draw_checks(rows: DataFrame, population: str, successes: str, draws: str, observed: str, alpha: float = 0.05) -> DataFrame:
    """``rows`` with ``low``, ``high``, ``p`` and ``is_inside`` of the exact hypergeometric test; nulls where a number is missing or impossible.

    Computed in Python: meant for strata of any size, not for rows by the million.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("is_inside", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for values in zip(*(frame[c] for c in (population, successes, draws, observed)), strict=True):
                if any(v is None or v != v or v < 0 for v in values) or values[1] > values[0] or values[2] > values[0]:
                    out.append((None, None, None, None))
                else:
                    n, k, d, x = map(int, values)
                    low, high, p = hypergeometric(n, k, d, x, alpha)
                    out.append((low, high, p, low <= x <= high))
            yield frame.assign(**{c: pd.Series([o[i] for o in out], index=frame.index, dtype=object) for i, c in enumerate(("low", "high", "p", "is_inside"))})

    return rows.mapInPandas(run, schema)


def goodness_of_fit(frame: list[int], drawn: list[int], trials: int = 20_000, seed: int = 20) -> float:
    """Monte Carlo p of a whole composition under a uniform draw without replacement: the share of simulated draws at least as far from the expected one."""
    import numpy as np

    counts, got = np.array(frame), np.array(drawn)
    expected = got.sum() * counts / counts.sum()
    some = expected > 0
    distance = lambda x: (((x - expected) ** 2)[..., some] / expected[some]).sum(-1)
    simulated = np.random.default_rng(seed).multivariate_hypergeometric(counts, int(got.sum()), trials)
    return float((distance(simulated) >= distance(got) - 1e-12).mean())


def compared_scores(left: DataFrame, right: DataFrame, query: str, ident: str) -> DataFrame:
    """How two score maps of the same queries differ: ``n_left``, ``n_right``, ``n_common``, ``max_delta``, ``n_moved`` and ``n_moved_by_ties``.

    Both: query, ident, score, rank. An id has moved if its rank differs, and by a
    tie only if its score doesn't. The largest difference is null without common ids.
    """
    both = left.select(query, ident, F.col("score").alias("a"), F.col("rank").alias("ra")).join(right.select(query, ident, F.col("score").alias("b"), F.col("rank").alias("rb")), [query, ident], "full")
    common = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    moved = common & (F.col("ra") != F.col("rb"))
    return both.groupBy(query).agg(
        F.count("ra").alias("n_left"),
        F.count("rb").alias("n_right"),
        F.count_if(common).alias("n_common"),
        F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_delta"),
        F.count_if(moved).alias("n_moved"),
        F.count_if(moved & (F.col("a") == F.col("b"))).alias("n_moved_by_ties"),
    )

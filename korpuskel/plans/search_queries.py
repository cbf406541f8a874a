"""Search, fusion, choice and evaluation over the evidence, for every case whose number is divisible by 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpuskel.functions import expansion as V
from korpuskel.functions import text as X
from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.operators import dense, evaluation, fusion, lanes, presentation
from korpuskel.operators.lanes import DENSE, PLAIN, PRESENCE, SPARSE
from korpuskel.plans import sqlparts as S
from korpuskel.session import cut, read_table

POOL, DEPTH, BUDGET = 50, 10, 5
WEIGHTS = {SPARSE: 0.6, DENSE: 0.4}
#: Weights of the kinds of expansions, as parts of the sparse lane's. Fixed values.
KIND_WEIGHTS = {V.TERMINOLOGY: 0.5, V.SAFETY: 1.0}
HYBRID = "hybrid"
#: Filters of a case, and the columns of evidence that they are on.
FILTERS = {"jurisdictions": "jurisdiction", "languages": "language", "publisher_ids": "publisher_id", "source_classes": "source_class", "source_version_ids": "source_version_id", "lifecycle_statuses": "lifecycle_status"}
REQUIRED_ROLES = [fusion.PRIMARY, "APPLICABILITY"]
SERVABLE = ["EFFECTIVE"]  # states in which evidence may be served. Fixed value.
RELEASE, EVIDENCE = "corpus_release_id", "evidence_id"
MOST_KEYS = 200_000  # of about a hundred bytes, that are broadcast


def _evidence(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    """All deliveries of evidence by tidied keys."""
    return read_table(spark, sf_dir, "corpus_evidence").select(tidy(RELEASE).alias(RELEASE), tidy(EVIDENCE).alias(EVIDENCE), "delivered_at", *[v.alias(n) for n, v in values.items()])


def _filterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with the columns that filters are on; the class is that of its source version."""
    classes = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("source_version_id"), tidy("source_class").alias("source_class")).dropDuplicates(["source_version_id"])
    own = {c: tidy(c) for c in FILTERS.values() if c != "source_class"}
    rows = _evidence(spark, sf_dir, text=F.col("content_search"), approval_status=tidy(F.col("verification.approval_status")), **own)
    return rows.join(classes, "source_version_id", "left")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_type = "array<struct<evidence_id:string,relevance_grade:int,required:boolean>>"
    gold = F.transform(F.coalesce("gold_evidence", F.array().cast(gold_type)), lambda g: F.struct(tidy(g["evidence_id"]).alias("id"), g["relevance_grade"].alias("grade"), g["required"].alias("required")))
    ids = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), tidy))
    sets = F.transform("minimum_complete_evidence_sets", lambda s: ids(s["evidence_ids"]))
    cases = latest_rows(
        read_table(spark, sf_dir, "benchmark_cases"),
        {"case_id": tidy("case_id")},
        F.col("created_at"),
        {
            RELEASE: tidy(RELEASE),
            "text": F.col("question"),
            "gold": F.filter(gold, lambda g: g["id"].isNotNull()),
            "sets": sets,
            "forbidden": ids(F.col("forbidden_evidence_ids")),
            "required_roles": F.col("required_evidence_roles"),
            "expectation": tidy("evidence_expectation"),
            "strata": F.array_sort(F.transform(F.map_entries("strata"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))),
            "topics": F.col("safety_topics"),
            **{column: ids(F.col(f"retrieval_filter.{name}")) for name, column in FILTERS.items()},
        },
    )
    cases = cases.where(F.regexp_extract("case_id", r"([0-9]+)$", 1).try_cast("bigint") % 100 == 0)
    return cases.withColumn("insufficient", F.coalesce(F.col("expectation") == "INSUFFICIENT_EVIDENCE", F.lit(False)) | (F.size("gold") == 0))


def _searched(docs: DataFrame, queries: DataFrame, names: tuple[str, ...], k: int = POOL, query: str = "case_id", filters: tuple[str, ...] = ()) -> DataFrame:
    counting = ({RELEASE: F.col(RELEASE), EVIDENCE: F.col(EVIDENCE)}, F.col("delivered_at"))
    scores = lanes.search(docs, queries, RELEASE, EVIDENCE, query, names, k, filters, counting)
    return fusion.ranked(scores, ["lane", query], EVIDENCE, k)


def _lanes(spark: SparkSession, sf_dir: str, *names: str, k: int = POOL) -> DataFrame:
    """(lane, case_id, evidence_id, score, rank) of the best ``k`` of each lane, all lanes from one index."""
    docs = _evidence(spark, sf_dir, text=F.col("content_search"))
    return _searched(docs, _cases(spark, sf_dir).select("case_id", RELEASE, "text"), names, k)


def _top(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("rank") <= DEPTH).select("case_id", EVIDENCE, "rank", F.round("score", 6).alias("score"))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_lanes(spark, sf_dir, SPARSE, k=DEPTH))


def plain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As sparse_topk, without the weight of rare tokens."""
    return _top(_lanes(spark, sf_dir, PLAIN, k=DEPTH))


def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_lanes(spark, sf_dir, PRESENCE, k=DEPTH))


def hashed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the cosine of hashed vectors of words and pairs of words."""
    return _top(_lanes(spark, sf_dir, DENSE, k=DEPTH))


def rarity_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the weight of rare tokens changes scores and order of the best of each case."""
    rows = cut(_lanes(spark, sf_dir, SPARSE, PLAIN))
    side = lambda lane: rows.where(F.col("lane") == lane)
    return evaluation.compared_scores(side(SPARSE), side(PLAIN), "case_id", EVIDENCE)


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved evidence that passes the filters of the case; empty filters pass all."""
    docs, filters = _filterable(spark, sf_dir), (*FILTERS.values(), "approval_status")
    queries = _cases(spark, sf_dir).select("case_id", RELEASE, "text", *FILTERS.values(), F.array(F.lit("APPROVED")).alias("approval_status"))
    return _top(_searched(docs, queries, (SPARSE,), DEPTH, filters=filters))


def served_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved evidence in a servable state, of the jurisdictions (widened by WORLD) and languages of the case."""
    wide = F.when(F.size("jurisdiction") > 0, F.array_union("jurisdiction", F.array(F.lit("WORLD")))).otherwise(F.col("jurisdiction"))
    queries = _cases(spark, sf_dir).select("case_id", RELEASE, "text", wide.alias("jurisdiction"), "language", F.array(*[F.lit(s) for s in SERVABLE]).alias("lifecycle_status"), F.array(F.lit("APPROVED")).alias("approval_status"))
    return _top(_searched(_filterable(spark, sf_dir), queries, (SPARSE,), DEPTH, filters=("jurisdiction", "language", "lifecycle_status", "approval_status")))


def _counted(spark: SparkSession, sf_dir: str, keys: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """The counting evidence of the given (release, id), with its values; only those rows leave the scan.

    The keys are those of a query set's results; they are broadcast where they are counted to be few.
    """
    named = cut(keys.select(RELEASE, EVIDENCE).distinct())
    mine = rows.join(F.broadcast(named) if named.count() <= MOST_KEYS else named, [RELEASE, EVIDENCE], "left_semi")
    return latest_rows(mine, {RELEASE: F.col(RELEASE), EVIDENCE: F.col(EVIDENCE)}, F.col("delivered_at"), {v: F.col(v) for v in values})


def _violations(spark: SparkSession, sf_dir: str, pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Of (case_id, id) pairs, how many were held against each filter, and how many don't pass it."""
    asked = cases.select("case_id", RELEASE, *[F.col(c).alias(f"f_{c}") for c in FILTERS.values()])
    named = pairs.join(asked, "case_id")
    held = _counted(spark, sf_dir, named, _filterable(spark, sf_dir), [*FILTERS.values()])
    both = named.join(held, [RELEASE, EVIDENCE])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("filter"), F.col(f"f_{c}").alias("allowed"), F.col(c).alias("value")) for c in FILTERS.values()]))
    flat = both.select(each.alias("x")).select("x.*").where(F.size("allowed") > 0)
    return flat.groupBy("filter").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))).alias("n_violations"))


def filter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of filtered_topk held against their filters once more; there should be no violations."""
    return _violations(spark, sf_dir, filtered_topk(spark, sf_dir).select("case_id", EVIDENCE), _cases(spark, sf_dir))


def gold_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold evidence held against the filters of its own case."""
    cases = _cases(spark, sf_dir)
    return _violations(spark, sf_dir, cases.select("case_id", F.explode("gold.id").alias(EVIDENCE)).distinct(), cases)


def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each gold evidence among all that share a token with its case, in two lanes; null where it shares none."""
    names = (SPARSE, PRESENCE)
    gold = _cases(spark, sf_dir).select("case_id", F.explode("gold.id").alias(EVIDENCE)).distinct()
    wanted: dict[object, list] = {}
    for row in gold.collect():  # of the query set
        wanted.setdefault(row.case_id, []).append(row.evidence_id)
    docs, queries = _evidence(spark, sf_dir, text=F.col("content_search")), _cases(spark, sf_dir).select("case_id", RELEASE, "text")
    counting = ({RELEASE: F.col(RELEASE), EVIDENCE: F.col(EVIDENCE)}, F.col("delivered_at"))
    found = lanes.union([lanes.exact_ranks(index, RELEASE, EVIDENCE, "case_id", asked, names, wanted) for index, asked in lanes.indexes(docs, queries, RELEASE, EVIDENCE, "case_id", names, (), counting)])
    rank = {n: F.max(F.when(F.col("lane") == n, F.col("rank"))).alias(f"{n}_rank") for n in names}
    return gold.join(found, ["case_id", EVIDENCE], "left").groupBy("case_id", EVIDENCE).agg(*rank.values())


def _fused(rows: DataFrame) -> DataFrame:
    return fusion.ranked(fusion.fuse(rows.select("lane", "case_id", EVIDENCE, "rank"), WEIGHTS, "case_id", EVIDENCE), "case_id", EVIDENCE, None)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse and the dense lane fused."""
    return _top(_fused(_lanes(spark, sf_dir, SPARSE, DENSE)))


def isolated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rrf_fusion, where the dense lane fails: the sparse one goes on alone."""

    def failing() -> DataFrame:
        raise ValueError("the vectors have the wrong dimension")

    schema = f"lane string, case_id string, {EVIDENCE} string, rank int"
    rows, failures = fusion.isolated(spark, {SPARSE: lambda: _lanes(spark, sf_dir, SPARSE), DENSE: failing}, schema)
    return _top(_fused(rows)).withColumn("failures", F.lit(",".join(failures.values())))


def fusion_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and contributions of each gold evidence in the lanes that go into fusion."""
    gold = _cases(spark, sf_dir).select("case_id", F.explode("gold.id").alias(EVIDENCE))
    return fusion.trace(gold, cut(_lanes(spark, sf_dir, SPARSE, DENSE)), WEIGHTS, "case_id", EVIDENCE, DEPTH)[0]


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each case loses gold."""
    gold = _cases(spark, sf_dir).select("case_id", F.explode("gold.id").alias(EVIDENCE))
    return fusion.trace(gold, cut(_lanes(spark, sf_dir, SPARSE, DENSE)), WEIGHTS, "case_id", EVIDENCE, DEPTH)[1]


def query_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the questions."""
    made = _cases(spark, sf_dir).select("case_id", F.explode(V.expansions(F.col("text"))).alias("x"))
    return made.select("case_id", "x.lane", "x.kind", "x.origin", "x.text")


def _expanded(spark: SparkSession, sf_dir: str, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base lanes, lanes of the variants with their kind and origin), from one index."""
    variants = cases.select("case_id", RELEASE, F.explode(V.expansions(F.col("text"))).alias("x")).select("case_id", RELEASE, "x.lane", "x.kind", "x.origin", "x.text")
    own = cases.select("case_id", RELEASE, F.lit("base").alias("variant"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("origin"), "text")
    every = cut(own.unionByName(variants.withColumnRenamed("lane", "variant")).withColumn("query_id", F.concat_ws("|", "case_id", "variant")))
    docs = _evidence(spark, sf_dir, text=F.col("content_search"))
    found = cut(_searched(docs, every.select("query_id", RELEASE, "text"), (SPARSE, DENSE), POOL, "query_id"))
    named = found.join(every.select("query_id", "case_id", "variant", "kind", "origin"), "query_id")
    base = named.where("variant = 'base'").select("lane", "case_id", EVIDENCE, "score", "rank")
    more = named.where((F.col("variant") != "base") & (F.col("lane") == SPARSE)).select(F.col("variant").alias("lane"), "kind", "origin", "case_id", EVIDENCE, "rank")
    return base, more


def _two_level(base: DataFrame, more: DataFrame) -> DataFrame:
    return fusion.two_level(base, more, WEIGHTS, {k: WEIGHTS[SPARSE] * w for k, w in KIND_WEIGHTS.items()}, "case_id", EVIDENCE, POOL)


def two_level_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes fused with those of the variants, which are fused per kind first."""
    return _top(_two_level(*_expanded(spark, sf_dir, _cases(spark, sf_dir))))


def _with_release(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return rows.join(cases.select("case_id", RELEASE), "case_id")


def _described(spark: SparkSession, sf_dir: str, rows: DataFrame, cases: DataFrame, **values: Column) -> DataFrame:
    """Rows (case_id, id, ...) with values of their counting evidence."""
    named = _with_release(rows, cases)
    held = _counted(spark, sf_dir, named, _evidence(spark, sf_dir, **values), list(values))
    return named.join(held, [RELEASE, EVIDENCE])


def retrieval_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expanded order with the floor of the order without expansions."""
    cases = _cases(spark, sf_dir)
    base, more = _expanded(spark, sf_dir, cases)
    plain = fusion.ranked(fusion.fuse(base, WEIGHTS, "case_id", EVIDENCE), "case_id", EVIDENCE, POOL).select("case_id", EVIDENCE, "rank")
    roles = _described(spark, sf_dir, plain, cases, roles=F.col("evidence_roles"))
    return fusion.keep_floor(_two_level(base, more), roles, "case_id", EVIDENCE, DEPTH, POOL).where(F.col("rank") <= DEPTH)


def conflict_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads for questions that ask for both sides of a conflict: each case's question against the one of the next case of its release."""
    cases = _cases(spark, sf_dir).where("text IS NOT NULL")
    along = Window.partitionBy(RELEASE).orderBy("case_id")
    other = F.coalesce(F.lead("text").over(along), F.first("text").over(along))
    asked = cases.select("case_id", RELEASE, F.concat(F.lit("Retrieve both source passages needed to inspect a potential conflict: "), F.col("text"), F.lit(" | "), other).alias("text"))
    base, more = _expanded(spark, sf_dir, asked)
    fused = _two_level(base, more).select("case_id", EVIDENCE, "rank")
    described = _described(spark, sf_dir, fused, asked, roles=F.coalesce("evidence_roles", F.array().cast("array<string>")), version=F.col("source_version_id"), text=F.col("content_search"))
    sides = more.where(F.col("origin") == V.SIDE).select("case_id", EVIDENCE, F.regexp_extract("lane", r"([0-9]+)$", 1).cast("int").alias("side"), "rank")
    return fusion.conflict_head(described, sides, "case_id", EVIDENCE, DEPTH, POOL)


def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool by a new score, the share of the question's words that a passage holds, with places kept for floor and roles."""
    cases = _cases(spark, sf_dir)
    pool = _fused(_lanes(spark, sf_dir, SPARSE, DENSE)).where(F.col("rank") <= POOL).select("case_id", EVIDENCE, "rank")
    described = _described(spark, sf_dir, cut(pool), cases, roles=F.coalesce("evidence_roles", F.array().cast("array<string>")), words=X.loose_tokens(F.col("content_search")))
    asked = cases.select("case_id", X.loose_tokens(F.col("text")).alias("asked"))
    scored = described.join(asked, "case_id").withColumn("new_score", F.when(F.size("asked") > 0, F.round(F.size(F.array_intersect("asked", "words")) / F.size("asked"), 9)).otherwise(0.0))
    return fusion.rerank_with_reserve(scored, "case_id", EVIDENCE, DEPTH)


def _selected(spark: SparkSession, sf_dir: str, fused: DataFrame, cases: DataFrame) -> DataFrame:
    """The best distinct passages along the fused list, by the fingerprint of what a reader sees."""
    rows = _evidence(spark, sf_dir, content_exact=F.col("content_exact"), anchors=F.col("anchors"))
    named = cut(_with_release(fused.select("case_id", EVIDENCE, "rank"), cases))
    held = presentation.with_rows(_counted(spark, sf_dir, named, rows, ["content_exact", "anchors"]), "content_exact", "anchors")
    held = held.select(RELEASE, EVIDENCE, presentation.print_of(F.col("content_exact"), F.col("cells"), F.col("anchor")).alias("print"))
    own = F.coalesce("print", F.concat(F.lit("without text "), EVIDENCE))
    return fusion.distinct_best(named.join(held, [RELEASE, EVIDENCE]).withColumn("print", own), "case_id", EVIDENCE, "print", DEPTH)


def deduplicated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best distinct passages, with the ids that each stands for."""
    picked = _selected(spark, sf_dir, cut(_fused(_lanes(spark, sf_dir, SPARSE, DENSE))), _cases(spark, sf_dir))
    return picked.select("case_id", EVIDENCE, "place", F.size("suppressed").alias("n_suppressed"), F.array_join("suppressed", ",").alias("suppressed"))


def uncited_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen passages that no gold evidence cites, in the order of the list."""
    cases = _cases(spark, sf_dir)
    picked = _selected(spark, sf_dir, cut(_fused(_lanes(spark, sf_dir, SPARSE, DENSE))), cases).select("case_id", EVIDENCE, "place")
    return picked.join(cases.select("case_id", F.explode("gold.id").alias(EVIDENCE)), ["case_id", EVIDENCE], "left_anti")


def role_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the chosen passages of each case cover the roles that an answer needs."""
    cases = _cases(spark, sf_dir)
    picked = cut(_selected(spark, sf_dir, cut(_fused(_lanes(spark, sf_dir, SPARSE, DENSE))), cases).select("case_id", EVIDENCE))
    described = _described(spark, sf_dir, picked, cases, roles=F.col("evidence_roles"), content_exact=F.col("content_exact"), anchors=F.col("anchors"))
    rows = presentation.with_rows(described, "content_exact", "anchors")
    kind = presentation.kind_of(F.col("cells"), F.col("anchor"), F.lit(None).cast(presentation.SCHEMA))
    gates = fusion.role_gate(rows.select("case_id", "roles", kind.alias("kind")), "case_id", REQUIRED_ROLES, presentation.BEARING)
    return gates.select("case_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "passes", "n_disqualified")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every case in the sparse, the dense and the hybrid mode; the hybrid one chooses distinct passages."""
    cases = _cases(spark, sf_dir)
    rows = cut(_lanes(spark, sf_dir, SPARSE, DENSE))
    alone = rows.where(F.col("rank") <= DEPTH).select(F.col("lane").alias("mode"), "case_id", EVIDENCE, F.col("rank").alias("place"))
    hybrid = _selected(spark, sf_dir, _fused(rows), cases).select(F.lit(HYBRID).alias("mode"), "case_id", EVIDENCE, "place")
    picked = cut(alone.unionByName(hybrid))
    described = _described(spark, sf_dir, picked, cases, roles=F.col("evidence_roles")).withColumnRenamed(EVIDENCE, "id")
    return evaluation.case_metrics(cases, described, [SPARSE, DENSE, HYBRID], DEPTH, BUDGET)


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("mode", "case_id", "population", *[F.round(m, 6).alias(m) for m in evaluation.MEASURES], "complete", "complete_at_budget", "n_forbidden")


def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the query set (every hundredth case) by mode, of all, the answerable and the insufficient cases."""
    return evaluation.summary(_metrics(spark, sf_dir), "mode")


def stratum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As mode_summary for the hybrid mode, per stratum and topic; a case counts in each of its own."""
    cases = _cases(spark, sf_dir)
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(F.lit("safety_topic").alias("key"), t.alias("value")))
    each = cases.select("case_id", F.explode(F.array_distinct(F.concat(F.coalesce("strata", F.array().cast("array<struct<key:string,value:string>>")), topics))).alias("s"))
    strata = each.select("case_id", F.col("s.key").alias("stratum"), F.col("s.value").alias("value"))
    return evaluation.summary(_metrics(spark, sf_dir).where(F.col("mode") == HYBRID).join(strata, "case_id"), "stratum", "value")


#: (code, population, measure, value, is_most): examples of what a run may be held to.
THRESHOLDS = [
    ("TOTAL_CASE_COUNT_BELOW_THRESHOLD", evaluation.ALL, "n_cases", 5, False),
    ("MEAN_RECALL_AT_K_BELOW_THRESHOLD", evaluation.ALL, "recall", 0.2, False),
    ("MEAN_NDCG_AT_K_BELOW_THRESHOLD", evaluation.ALL, "ndcg", 0.2, False),
    ("REQUIRED_ROLE_RECALL_BELOW_THRESHOLD", evaluation.ALL, "role_recall", 0.1, False),
    ("ANSWERABLE_COMPLETE_EVIDENCE_SET_RATE_BELOW_THRESHOLD_LOWER_BOUND", evaluation.ANSWERABLE, "complete_low", 0.5, False),
    ("FORBIDDEN_EVIDENCE_LEAKAGE_EXCEEDS_THRESHOLD", evaluation.ALL, "n_leaking", 0, True),
    ("INSUFFICIENT_EVIDENCE_ACCURACY_BELOW_THRESHOLD", evaluation.INSUFFICIENT, "recall", 0.9, False),
]


def unmet_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode doesn't reach, in the order of the thresholds."""
    return evaluation.unmet(mode_summary(spark, sf_dir), THRESHOLDS, "mode")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 100 = 0")


VECTOR_DIMENSION = 64


def _near(spark: SparkSession, sf_dir: str, metric: str, itself: bool = False) -> DataFrame:
    vectors, queries = _vectors(spark, sf_dir)
    scores = dense.nearest(vectors, queries, "vec_id", "embedding", DEPTH, VECTOR_DIMENSION, metric, itself)
    return fusion.ranked(scores, "query_id", "vec_id", DEPTH).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of each vector whose id is divisible by 100."""
    return _near(spark, sf_dir, "cosine")


def dense_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_topk, by the product."""
    return _near(spark, sf_dir, "dot")


def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each queried vector among the ten nearest of itself: 1 in a sound index, unless another is its equal; null if it isn't found."""
    own = _near(spark, sf_dir, "cosine", True).where("query_id = vec_id").select("query_id", F.col("rank").alias("own_rank"))
    return _vectors(spark, sf_dir)[1].select(F.col("vec_id").alias("query_id")).join(own, "query_id", "left")


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with faults at fixed ids: missing, doubled, zero, infinite, short, and one number off."""
    v, number = F.col("embedding"), F.col("vec_id")
    off = F.transform(v, lambda x, i: F.when(i == 3, x + F.lit(0.01).cast("float")).otherwise(x))
    changed = (
        F.when(number % 50 == 1, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(number % 50 == 2, F.transform(v, lambda x, i: F.when(i == 0, F.lit(float("inf")).cast("float")).otherwise(x)))
        .when(number % 50 == 3, F.slice(v, 1, 63))
        .when(number % 50 == 4, off)
        .when(number % 50 == 5, F.transform(v, lambda x: x * F.lit(1.0000001).cast("float")))
        .otherwise(v)
    )
    rows = _vectors(spark, sf_dir)[0].where("vec_id % 50 <> 6").select("vec_id", changed.alias("embedding"))
    return rows.unionByName(rows.where("vec_id % 50 = 7")).unionByName(rows.where("vec_id % 50 = 8").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "embedding"))


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension, length, length of the first half, and what is wrong with each vector, faults planted."""
    v = F.col("embedding").cast("array<double>")
    return _bent(spark, sf_dir).select("vec_id", F.size(v).alias("dimension"), F.round(dense.length(v), 6).alias("length"), F.round(dense.length(F.slice(v, 1, 32)), 6).alias("half_length"), dense.fault(F.col("embedding"), VECTOR_DIMENSION).alias("fault")).distinct()


def vector_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors against those that were expected: unexpected, missing, doubled and differing ones."""
    return dense.differences(_vectors(spark, sf_dir)[0], _bent(spark, sf_dir), "vec_id", "embedding")


_LISTED = [
    sparse_topk, plain_topk, lexical_rank, hashed_topk, rarity_effect, filtered_topk, served_topk, filter_violations, gold_filters, gold_ranks, rrf_fusion, isolated_fusion, fusion_trace,
    failure_classes, query_expansions, two_level_fusion, retrieval_floor, conflict_selection, reranked_topk, deduplicated_topk, uncited_candidates, role_gates, case_metrics, mode_summary, stratum_summary,
    unmet_thresholds, dense_topk, dense_dot_topk, self_retrieval, vector_checks, vector_differences,
]
QUERIES = {f.__name__: f for f in _LISTED}

_IDS = "[{0} FOR x IN coalesce({1}, []) IF {0} IS NOT NULL]"


def _ids(column: str) -> str:
    return _IDS.format(S.t("x"), column)


_EV = f"""ev AS (
  SELECT {S.t("e.corpus_release_id")} AS rel, {S.t("e.evidence_id")} AS id, content_search AS text, content_exact, anchors, evidence_roles AS roles, e.source_version_id AS version,
    {", ".join(f"{S.t(f'e.{c}')} AS {c}" for c in FILTERS.values() if c != "source_class")}, {S.t("v.source_class")} AS source_class, {S.t("verification.approval_status")} AS approval_status
  FROM corpus_evidence e LEFT JOIN (SELECT DISTINCT ON ({S.t("source_version_id")}) * FROM source_versions) v ON {S.t("v.source_version_id")} = {S.t("e.source_version_id")}
  QUALIFY row_number() OVER (PARTITION BY {S.t("e.corpus_release_id")}, {S.t("e.evidence_id")} ORDER BY delivered_at DESC) = 1)"""
_CASES = f"""cases AS (
  SELECT {S.t("case_id")} AS case_id, {S.t("corpus_release_id")} AS rel, question AS text, [{{'id': {S.t("g.evidence_id")}, 'grade': coalesce(g.relevance_grade, 0), 'required': coalesce(g.required, false)}} FOR g IN coalesce(gold_evidence, []) IF {S.t("g.evidence_id")} IS NOT NULL] AS gold,
    [{_ids("s.evidence_ids")} FOR s IN coalesce(minimum_complete_evidence_sets, [])] AS sets, {_ids("forbidden_evidence_ids")} AS forbidden, list_distinct(coalesce(required_evidence_roles, [])) AS required_roles, strata, safety_topics,
    {S.t("evidence_expectation")} AS expectation, {", ".join(f"{_ids(f'retrieval_filter.{n}')} AS f_{c}" for n, c in FILTERS.items())}
  FROM benchmark_cases WHERE CAST(regexp_extract({S.t("case_id")}, '([0-9]+)$', 1) AS BIGINT) % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY {S.t("case_id")} ORDER BY created_at DESC) = 1)"""
_OWN = "qs AS (SELECT case_id, 'base' AS variant, rel, text FROM cases)"
_VARIANTS = "qs AS (SELECT case_id, 'base' AS variant, rel, text FROM cases UNION ALL SELECT case_id, lane, rel, text FROM variants)"
_ADDED = " ".join(f"CASE WHEN regexp_matches(text, {S.q(p)}) THEN trim(text) || ' {w}' END," for p, w in V.ADDED.items())
_EXPANDED = f"""variants AS (
  SELECT case_id, rel, 'safety-query-' || i AS lane, 'SAFETY_QUERY' AS kind, 'CONTROLLED_VOCABULARY' AS origin, {S.view("l[i]")} AS text
  FROM (SELECT case_id, rel, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT case_id, rel, [x FOR x IN [{_ADDED.rstrip(",")}] IF x IS NOT NULL] AS l FROM cases WHERE text IS NOT NULL)))"""
_SPARSE = f"""docs AS (SELECT rel, id, len(tokens) AS n, tokens FROM (SELECT rel, id, {S.tokens("text")} AS tokens FROM ev) WHERE len(tokens) > 0),
whole AS (SELECT rel, count(*) AS docs, avg(n) AS mean_n FROM docs GROUP BY rel),
asked AS (SELECT DISTINCT rel, case_id, variant, unnest({S.tokens("text")}) AS term FROM qs),
post AS (SELECT rel, id, n, term, count(*) AS tf FROM (SELECT rel, id, n, unnest(tokens) AS term FROM docs) WHERE (rel, term) IN (SELECT rel, term FROM asked) GROUP BY ALL),
dfs AS (SELECT rel, term, count(*) AS df FROM post GROUP BY ALL),
hits AS (SELECT rel, case_id, variant, id, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n)) AS part, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf, ln(1 + docs / df) AS rarity FROM asked JOIN post USING (rel, term) JOIN dfs USING (rel, term) JOIN whole USING (rel)),
scores AS (SELECT rel, case_id, variant, id, round(sum(part * idf), 9) AS sparse, round(sum(part), 9) AS plain, round(sum(rarity), 9) AS presence FROM hits GROUP BY ALL)"""
_FEATURES = """f_{0} AS (SELECT {1}, 'u:' || unnest(w) AS f, 1.0 AS v FROM w_{0} UNION ALL SELECT {1}, 'b:' || unnest([w[i] || chr(31) || w[i + 1] FOR i IN range(1, len(w))]), 0.5 FROM w_{0}),
h_{0} AS (SELECT {1}, v, sha256(f) AS h FROM f_{0}),
s_{0} AS (SELECT {1}, CAST(('0x' || {2}) AS UBIGINT) % 384 AS idx, sum(CASE WHEN substr(h, 18, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -v ELSE v END)::DOUBLE AS v FROM h_{0} GROUP BY ALL),
n_{0} AS (SELECT {1}, sqrt(sum(v * v)) AS norm FROM s_{0} GROUP BY ALL)"""
_HEX8 = "concat(" + ", ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + ")"
_DENSE = f"""w_d AS (SELECT rel, id, {S.words("text")} AS w FROM ev WHERE rel IN (SELECT rel FROM cases)), {_FEATURES.format("d", "rel, id", _HEX8)},
w_q AS (SELECT rel, case_id, {S.words("text")} AS w FROM cases), {_FEATURES.format("q", "rel, case_id", _HEX8)},
dense_scores AS (
  SELECT n_q.case_id, n_d.rel, n_d.id, round(coalesce(p.v, 0) / (n_d.norm * n_q.norm), 9) AS dense
  FROM n_q JOIN n_d USING (rel) LEFT JOIN (SELECT rel, case_id, id, sum(s_d.v * s_q.v) AS v FROM s_d JOIN s_q USING (rel, idx) GROUP BY ALL) p USING (rel, case_id, id) WHERE n_d.norm > 0 AND n_q.norm > 0)"""


def _rank(column: str, source: str, keys: str = "case_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {column} DESC, id) AS rank FROM {source}"


def _top_sql(ctes: str, column: str, source: str) -> str:
    return f"WITH {ctes} SELECT case_id, id AS evidence_id, CAST(rank AS INTEGER) AS rank, round({column}, 6) AS score FROM ({_rank(column, source)}) WHERE rank <= {DEPTH}"


_BASE = ", ".join([_EV, _CASES, _OWN, _SPARSE])
_PASS = " AND ".join(f"(len(f_{c}) = 0 OR coalesce(list_contains(f_{c}, ev.{c}), false))" for c in FILTERS.values())
_FILTERED = f"filtered AS (SELECT s.* FROM scores s JOIN ev USING (rel, id) JOIN cases c USING (case_id) WHERE approval_status = 'APPROVED' AND {_PASS})"
_SERVED = f"""served AS (SELECT s.* FROM scores s JOIN ev USING (rel, id) JOIN cases c USING (case_id) WHERE approval_status = 'APPROVED' AND lifecycle_status IN ('EFFECTIVE')
  AND (len(f_jurisdiction) = 0 OR coalesce(list_contains(list_append(f_jurisdiction, 'WORLD'), jurisdiction), false)) AND (len(f_language) = 0 OR coalesce(list_contains(f_language, language), false)))"""
_CHECKS = " UNION ALL ".join(f"SELECT '{c}' AS filter, f_{c} AS allowed, ev.{c} AS value FROM pairs p JOIN cases USING (case_id) JOIN ev ON ev.rel = cases.rel AND ev.id = p.id" for c in FILTERS.values())
_CHECKED = f"SELECT filter, count(*) AS n_checked, count(*) FILTER (NOT coalesce(list_contains(allowed, value), false)) AS n_violations FROM ({_CHECKS}) WHERE len(allowed) > 0 GROUP BY filter"
_GOLD = "gold AS (SELECT case_id, id, max(grade) AS grade FROM (SELECT case_id, unnest(gold).id AS id, unnest(gold).grade AS grade FROM cases) GROUP BY ALL)"
_POOLS = f"""lane_rows AS (
  SELECT 'sparse' AS lane, case_id, rel, id, sparse AS score, rank FROM ({_rank("sparse", "scores WHERE variant = 'base'")}) WHERE rank <= {POOL}
  UNION ALL SELECT 'dense', case_id, rel, id, dense, rank FROM ({_rank("dense", "dense_scores")}) WHERE rank <= {POOL})"""
_FUSE = f"""fused_scores AS (SELECT case_id, rel, id, round(sum(CASE lane WHEN 'sparse' THEN {WEIGHTS[SPARSE]} ELSE {WEIGHTS[DENSE]} END / (60 + rank)), 9) AS score FROM lane_rows GROUP BY ALL),
fused AS ({_rank("score", "fused_scores")})"""
_HYBRID = ", ".join([_BASE, _DENSE, _POOLS, _FUSE])
_PICK = f"""seen AS (SELECT DISTINCT ev.rel, ev.id, content_exact, len([a FOR a IN coalesce(anchors, []) IF a.kind = 'TABLE_CELL' AND a.table_id IS NOT NULL]) > 0 AS anchored FROM fused JOIN ev USING (rel, id)),
{S.cells("seen", "rel, id")}, {S.row_prints("rel, id")},
printed AS (SELECT f.case_id, f.rel, f.id, f.rank, coalesce(CASE WHEN anchored THEN p.print END, sha256({S.fold(S.present("content_exact"))} || chr(31)), 'without text ' || f.id) AS print FROM fused f JOIN seen USING (rel, id) LEFT JOIN row_prints p USING (rel, id)),
firsts AS (SELECT * FROM printed QUALIFY row_number() OVER (PARTITION BY case_id, print ORDER BY rank) = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS place FROM firsts QUALIFY place <= {DEPTH})"""
_PICKED = f"{_HYBRID}, {_PICK}"
_COVERED = """(CASE WHEN len(sets) > 0 THEN len([s FOR s IN sets IF len([i FOR i IN s IF NOT list_contains({0}, i)]) = 0]) > 0 ELSE len([g FOR g IN gold IF g.required]) > 0 AND len([g FOR g IN gold IF g.required AND NOT list_contains({0}, g.id)]) = 0 END)"""
_METRICS = f"""{_PICKED}, {_GOLD},
taken AS (SELECT lane AS mode, case_id, rel, id, rank AS place FROM lane_rows WHERE rank <= {DEPTH} UNION ALL SELECT 'hybrid', case_id, rel, id, place FROM picked),
hit AS (SELECT t.mode, t.case_id, t.id, t.place, ev.roles, g.grade FROM taken t JOIN gold g USING (case_id, id) JOIN ev USING (rel, id)),
golds AS (SELECT case_id, count(*) AS n_gold, list_sort(list(grade), 'DESC') AS ideal FROM gold GROUP BY ALL),
got AS (SELECT mode, case_id, count(*) AS n_got, list(id) AS ids, list(id) FILTER (place <= {BUDGET}) AS few FROM taken GROUP BY ALL),
agg AS (SELECT h.mode, h.case_id, count(*) AS n_hit, sum((2 ** grade - 1) / log2(place + 1)) AS dcg, min(place) AS first, count(*) FILTER (place <= least(n_gold, {DEPTH})) AS r_hit, list_distinct(flatten(list(coalesce(roles, [])))) AS got_roles FROM hit h JOIN golds USING (case_id) GROUP BY ALL),
m AS (
  SELECT mode, c.case_id, c.strata, c.safety_topics, coalesce(c.expectation = 'INSUFFICIENT_EVIDENCE', false) OR len(c.gold) = 0 AS lacking, coalesce(n_got, 0) = 0 AS abstained,
    coalesce(n_hit, 0) / n_gold AS recall, coalesce(coalesce(dcg, 0) / nullif(list_sum([(2 ** ideal[i] - 1) / log2(i + 1) FOR i IN range(1, least(n_gold, {DEPTH}) + 1)]), 0), 0) AS ndcg,
    coalesce(1.0 / first, 0) AS reciprocal_rank, coalesce(n_hit / n_got, 0) AS precision, least(n_gold, {DEPTH}) / {DEPTH} AS precision_ceiling, coalesce(r_hit, 0) / least(n_gold, {DEPTH}) AS r_precision,
    CASE WHEN len(required_roles) > 0 THEN len(list_intersect(required_roles, coalesce(got_roles, []))) / len(required_roles) ELSE 1 END AS role_recall,
    {_COVERED.format("coalesce(ids, [])")} AS complete, {_COVERED.format("coalesce(few, [])")} AS complete_at_budget, CAST(len(list_intersect(coalesce(ids, []), forbidden)) AS INTEGER) AS n_forbidden
  FROM cases c CROSS JOIN (SELECT unnest(['sparse', 'dense', 'hybrid']) AS mode) LEFT JOIN golds USING (case_id) LEFT JOIN agg USING (mode, case_id) LEFT JOIN got USING (mode, case_id)),
metrics AS (
  SELECT mode, case_id, strata, safety_topics, CASE WHEN lacking THEN 'INSUFFICIENT' ELSE 'ANSWERABLE' END AS population,
    {", ".join(f"CASE WHEN lacking THEN CAST(abstained AS DOUBLE) ELSE {x} END AS {x}" for x in ("recall", "ndcg", "reciprocal_rank", "precision", "r_precision"))},
    CASE WHEN lacking THEN 1 ELSE precision_ceiling END AS precision_ceiling, CASE WHEN lacking THEN 1 ELSE role_recall END AS role_recall,
    CASE WHEN lacking THEN abstained ELSE complete END AS complete, CASE WHEN lacking THEN abstained ELSE complete_at_budget END AS complete_at_budget, n_forbidden FROM m)"""


def _summary_sql(source: str, *by: str) -> str:
    keys = ", ".join(by)
    low, high = S.wilson("n_cases", "n_complete")
    b_low, b_high = S.wilson("n_cases", "n_at_budget")
    return f"""SELECT *, {low} AS complete_low, {high} AS complete_high, {b_low} AS at_budget_low, {b_high} AS at_budget_high FROM (
  SELECT {keys}, population, count(*) AS n_cases, count(*) FILTER (complete) AS n_complete, count(*) FILTER (complete_at_budget) AS n_at_budget, count(*) FILTER (n_forbidden > 0) AS n_leaking, {", ".join(f"round(avg({x}), 6) AS {x}" for x in evaluation.MEASURES)}
  FROM (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('ALL' AS population) FROM {source}) GROUP BY {keys}, population)"""


_TWO = f"""variant_rows AS (SELECT case_id, rel, variant, id, rank FROM ({_rank("sparse", "scores WHERE variant <> 'base'", "case_id, variant")}) WHERE rank <= {POOL}),
kind_scores AS (SELECT case_id, rel, id, round(sum(1 / (60 + rank)), 9) AS score FROM variant_rows GROUP BY ALL),
wide_rows AS (SELECT case_id, rel, id, CASE lane WHEN 'sparse' THEN {WEIGHTS[SPARSE]} ELSE {WEIGHTS[DENSE]} END AS w, rank FROM lane_rows UNION ALL SELECT case_id, rel, id, {WEIGHTS[SPARSE]}, rank FROM ({_rank("score", "kind_scores")}) WHERE rank <= {POOL}),
wide_scores AS (SELECT case_id, rel, id, round(sum(w / (60 + rank)), 9) AS score FROM wide_rows GROUP BY ALL),
wide AS (SELECT * FROM ({_rank("score", "wide_scores")}) WHERE rank <= {POOL})"""
_WIDE = ", ".join([_EV, _CASES, _EXPANDED, _VARIANTS, _SPARSE, _DENSE, _POOLS, _FUSE, _TWO])
_ROLE_FIRSTS = " UNION ALL ".join(f"SELECT case_id, {5 + i} AS step, min(rank) AS rank FROM base WHERE rank <= {DEPTH} AND list_contains(coalesce(roles, []), '{r}') GROUP BY case_id" for i, r in enumerate(fusion.SAFETY_ROLES, 1))
_FLOOR = f"""base AS (SELECT f.case_id, f.id, f.rank, ev.roles FROM fused f JOIN ev USING (rel, id) WHERE f.rank <= {POOL}),
steps AS (SELECT case_id, rank AS step, rank FROM base WHERE rank <= {min(DEPTH, max(2, DEPTH // 2))} UNION ALL {_ROLE_FIRSTS}),
must AS (SELECT case_id, b.id, row_number() OVER (PARTITION BY case_id ORDER BY s.step) AS n FROM (SELECT case_id, rank, min(step) AS step FROM steps GROUP BY ALL) s JOIN base b USING (case_id, rank) QUALIFY n <= {DEPTH}),
fill AS (SELECT w.case_id, w.id, row_number() OVER (PARTITION BY w.case_id ORDER BY w.rank) AS n FROM wide w ANTI JOIN must m USING (case_id, id)),
chosen AS (SELECT case_id, id FROM must UNION ALL SELECT f.case_id, f.id FROM fill f JOIN (SELECT case_id, count(*) AS c FROM must GROUP BY ALL) k USING (case_id) WHERE n <= {DEPTH} - c),
ordered AS (
  SELECT c.case_id, c.id, 0 AS part, w.rank AS n FROM chosen c JOIN wide w USING (case_id, id)
  UNION ALL SELECT m.case_id, m.id, 1, m.n FROM must m ANTI JOIN wide w USING (case_id, id)
  UNION ALL SELECT w.case_id, w.id, 2, w.rank FROM wide w ANTI JOIN chosen c USING (case_id, id))"""
_RERANK_FIRSTS = " UNION ALL ".join(f"SELECT case_id, {5 + i} AS step, min(rank) AS rank FROM pool WHERE list_contains(coalesce(roles, []), '{r}') GROUP BY case_id" for i, r in enumerate(fusion.SAFETY_ROLES, 1))


def _loose(column: str) -> str:
    return f"list_distinct([{S.fold('x')} FOR x IN regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{N}}_+.-]+') IF length(x) >= 3])"


_RERANK = f"""pool AS (SELECT f.case_id, f.id, f.rank, ev.roles, CASE WHEN len({_loose("c.text")}) > 0 THEN round(len(list_intersect({_loose("c.text")}, {_loose("ev.text")})) / len({_loose("c.text")}), 9) ELSE 0 END AS s FROM fused f JOIN ev USING (rel, id) JOIN cases c USING (case_id) WHERE f.rank <= {POOL}),
steps AS (SELECT case_id, rank AS step, rank FROM pool WHERE rank <= {min(DEPTH, max(2, DEPTH // 2))} UNION ALL {_RERANK_FIRSTS}),
kept AS (SELECT case_id, p.id, row_number() OVER (PARTITION BY case_id ORDER BY k.step) AS n FROM (SELECT case_id, rank, min(step) AS step FROM steps GROUP BY ALL) k JOIN pool p USING (case_id, rank) QUALIFY n <= {DEPTH}),
again AS (SELECT p.case_id, p.id, row_number() OVER (PARTITION BY p.case_id ORDER BY s DESC, id) AS n FROM pool p ANTI JOIN kept k USING (case_id, id)),
chosen AS (SELECT case_id, id FROM kept UNION ALL SELECT a.case_id, a.id FROM again a JOIN (SELECT case_id, count(*) AS c FROM kept GROUP BY ALL) k USING (case_id) WHERE n <= {DEPTH} - c)"""
_FILLED = f"filled AS (SELECT rel, id, count(*) AS n_filled, min_by(value, cell) AS first FROM cells WHERE NOT {S.placeholder('value')} GROUP BY ALL)"
_KIND = """CASE WHEN NOT anchored OR NOT regexp_matches(coalesce(content_exact, ''), '^[A-Z]{1,3}[0-9]+=') THEN 'NARRATIVE' WHEN n_filled = 2 AND lower(trim(first, E' \\t\\n\\r')) IN ('decision id', 'business rule', 'trigger', 'hit policy indicator', 'schedule id') THEN 'TABLE_METADATA'
  WHEN n_filled = 1 AND NOT contains(trim(first, E' \\t\\n\\r'), chr(10)) AND length(trim(first, E' \\t\\n\\r')) <= 120 THEN 'TABLE_SECTION_TITLE' WHEN n_filled = 1 THEN 'TABLE_NOTE' ELSE 'UNLABELLED_TABLE_ROW' END"""
_GATE = f"""{_PICKED}, {_FILLED},
judged AS (SELECT p.case_id, p.id, coalesce(ev.roles, []) AS roles, {_KIND.replace("content_exact", "seen.content_exact")} IN ('NARRATIVE', 'TABLE_NOTE', 'DECISION_RULE', 'SCHEDULE_ENTRY', 'INDICATOR_DEFINITION') AS bears FROM picked p JOIN seen USING (rel, id) JOIN ev USING (rel, id) LEFT JOIN filled USING (rel, id)),
gates AS (SELECT case_id, coalesce(list_sort(list_distinct(flatten(list([r FOR r IN roles IF bears OR r <> 'PRIMARY_SUPPORT'])))), []) AS covered, CAST(sum(CASE WHEN NOT bears AND list_contains(roles, 'PRIMARY_SUPPORT') THEN 1 ELSE 0 END) AS BIGINT) AS n_disqualified FROM judged GROUP BY case_id)"""
_TRACE = f"""{_HYBRID}, {_GOLD},
parts AS (SELECT g.case_id, g.id, max(l.rank) FILTER (lane = 'sparse') AS sparse_rank, max(l.rank) FILTER (lane = 'dense') AS dense_rank FROM gold g LEFT JOIN lane_rows l USING (case_id, id) GROUP BY ALL),
traced AS (SELECT p.*, coalesce(round({WEIGHTS[SPARSE]} / (60 + sparse_rank), 9), 0) AS sparse_part, coalesce(round({WEIGHTS[DENSE]} / (60 + dense_rank), 9), 0) AS dense_part, f.rank AS fused_rank FROM parts p LEFT JOIN fused f USING (case_id, id))"""
_BENT = """bent AS (SELECT vec_id, CASE vec_id % 50 WHEN 1 THEN [0.0::FLOAT FOR x IN embedding] WHEN 2 THEN list_concat(['inf'::FLOAT], embedding[2:]) WHEN 3 THEN embedding[1:63] WHEN 4 THEN list_concat(embedding[1:3], [embedding[4] + 0.01::FLOAT], embedding[5:]) WHEN 5 THEN [x * 1.0000001::FLOAT FOR x IN embedding] ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 50 <> 6),
stored AS (SELECT * FROM bent UNION ALL SELECT * FROM bent WHERE vec_id % 50 = 7 UNION ALL SELECT vec_id + 1000000, embedding FROM bent WHERE vec_id % 50 = 8)"""


def _unmet_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT mode, {i} AS position, '{code}' AS code, CAST({m} AS DOUBLE) AS reached, CAST({v} AS DOUBLE) AS threshold FROM s WHERE population = '{pop}' AND {m} {'>' if most else '<'} {v}" for i, (code, pop, m, v, most) in enumerate(THRESHOLDS, 1))
    return f"WITH {_METRICS}, s AS ({_summary_sql('metrics', 'mode')}) {rows}"


def _near_sql(score: str, itself: str) -> str:
    return f"SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, round({score}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON {itself} WHERE q.vec_id % 100 = 0) QUALIFY rank <= {DEPTH}"


SQL = {
    "sparse_topk": _top_sql(_BASE, "sparse", "scores"),
    "plain_topk": _top_sql(_BASE, "plain", "scores"),
    "lexical_rank": _top_sql(_BASE, "presence", "scores"),
    "hashed_topk": _top_sql(", ".join([_EV, _CASES, _DENSE]), "dense", "dense_scores"),
    "rarity_effect": f"WITH {_BASE}, a AS (SELECT * FROM ({_rank('sparse', 'scores')}) WHERE rank <= {POOL}), b AS (SELECT * FROM ({_rank('plain', 'scores')}) WHERE rank <= {POOL}) SELECT coalesce(a.case_id, b.case_id) AS case_id, count(a.rank) AS n_left, count(b.rank) AS n_right, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) AS n_common, round(max(abs(a.sparse - b.plain)), 6) AS max_delta, count(*) FILTER (a.rank <> b.rank) AS n_moved, count(*) FILTER (a.rank <> b.rank AND a.sparse = b.plain) AS n_moved_by_ties FROM a FULL JOIN b ON a.case_id = b.case_id AND a.id = b.id GROUP BY 1",
    "filtered_topk": _top_sql(f"{_BASE}, {_FILTERED}", "sparse", "filtered"),
    "served_topk": _top_sql(f"{_BASE}, {_SERVED}", "sparse", "served"),
    "filter_violations": f"WITH {_BASE}, {_FILTERED}, pairs AS (SELECT case_id, id FROM ({_rank('sparse', 'filtered')}) WHERE rank <= {DEPTH}) {_CHECKED}",
    "gold_filters": f"WITH {_EV}, {_CASES}, {_GOLD}, pairs AS (SELECT case_id, id FROM gold) {_CHECKED}",
    "gold_ranks": f"WITH {_BASE}, {_GOLD}, r AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY sparse DESC, id) AS sparse_rank, row_number() OVER (PARTITION BY case_id ORDER BY presence DESC, id) AS presence_rank FROM scores) SELECT g.case_id, g.id AS evidence_id, sparse_rank, presence_rank FROM gold g LEFT JOIN r USING (case_id, id)",
    "rrf_fusion": f"WITH {_HYBRID} SELECT case_id, id AS evidence_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fused WHERE rank <= {DEPTH}",
    "isolated_fusion": f"WITH {_BASE} SELECT case_id, id AS evidence_id, CAST(rank AS INTEGER) AS rank, round({WEIGHTS[SPARSE]} / (60 + rank), 6) AS score, 'DENSE_LANE_FAILURE:ValueError' AS failures FROM ({_rank('sparse', 'scores')}) WHERE rank <= {DEPTH}",
    "fusion_trace": f"WITH {_TRACE} SELECT case_id, id AS evidence_id, CAST(sparse_rank AS INTEGER) AS sparse_rank, CAST(dense_rank AS INTEGER) AS dense_rank, sparse_part, dense_part, CAST(fused_rank AS INTEGER) AS fused_rank FROM traced",
    "failure_classes": f"WITH {_TRACE} SELECT case_id, CASE WHEN bool_or(coalesce(fused_rank > {DEPTH}, true) AND sparse_rank IS NULL AND dense_rank IS NULL) THEN 'CANDIDATE_GENERATION_FAILURE' WHEN bool_or(coalesce(fused_rank > {DEPTH}, true)) THEN 'SELECTION_FAILURE' ELSE 'NO_FAILURE' END AS failure_class FROM traced GROUP BY case_id",
    "query_expansions": f"WITH {_CASES}, {_EXPANDED} SELECT case_id, lane, kind, origin, text FROM variants",
    "two_level_fusion": f"WITH {_WIDE} SELECT case_id, id AS evidence_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM wide WHERE rank <= {DEPTH}",
    "retrieval_floor": f"WITH {_WIDE}, {_FLOOR} SELECT case_id, id AS evidence_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY part, n) AS INTEGER) AS rank FROM ordered QUALIFY rank <= {DEPTH}",
    "reranked_topk": f"WITH {_HYBRID}, {_RERANK} SELECT case_id, id AS evidence_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM pool JOIN chosen USING (case_id, id)",
    "deduplicated_topk": f"WITH {_PICKED}, lost AS (SELECT p.case_id, p.print, string_agg(p.id, ',' ORDER BY p.rank) AS ids, count(*) AS n FROM printed p JOIN firsts f USING (case_id, print) WHERE p.rank > f.rank GROUP BY ALL) SELECT case_id, id AS evidence_id, CAST(place AS INTEGER) AS place, CAST(coalesce(n, 0) AS INTEGER) AS n_suppressed, coalesce(ids, '') AS suppressed FROM picked LEFT JOIN lost USING (case_id, print)",
    "uncited_candidates": f"WITH {_PICKED}, {_GOLD} SELECT case_id, id AS evidence_id, CAST(place AS INTEGER) AS place FROM picked ANTI JOIN gold USING (case_id, id)",
    "role_gates": f"WITH {_GATE} SELECT case_id, coalesce(array_to_string(covered, ','), '') AS covered, coalesce(array_to_string([r FOR r IN {REQUIRED_ROLES} IF NOT list_contains(covered, r)], ','), '') AS missing, len([r FOR r IN {REQUIRED_ROLES} IF NOT list_contains(covered, r)]) = 0 AS passes, n_disqualified FROM gates",
    "case_metrics": f"WITH {_METRICS} SELECT mode, case_id, population, {', '.join(f'round({m}, 6) AS {m}' for m in evaluation.MEASURES)}, complete, complete_at_budget, n_forbidden FROM metrics",
    "mode_summary": f"WITH {_METRICS} {_summary_sql('metrics', 'mode')}",
    "stratum_summary": f"WITH {_METRICS}, strata_of AS (SELECT DISTINCT case_id, s.key AS stratum, s.value AS value FROM (SELECT case_id, unnest(map_entries(strata)) AS s FROM cases) UNION SELECT DISTINCT case_id, 'safety_topic', unnest(safety_topics) FROM cases), each AS (SELECT m.*, stratum, value FROM metrics m JOIN strata_of USING (case_id) WHERE mode = 'hybrid') {_summary_sql('each', 'stratum', 'value')}",
    "unmet_thresholds": _unmet_sql(),
    "dense_topk": _near_sql("list_cosine_similarity", "q.vec_id <> v.vec_id"),
    "dense_dot_topk": _near_sql("list_inner_product", "q.vec_id <> v.vec_id"),
    "self_retrieval": f"SELECT vec_id AS query_id, CAST(own AS INTEGER) AS own_rank FROM embeddings LEFT JOIN (SELECT query_id, rank AS own FROM ({_near_sql('list_cosine_similarity', 'true')}) WHERE query_id = vec_id) ON query_id = vec_id WHERE vec_id % 100 = 0",
    "vector_checks": f"WITH {_BENT} SELECT DISTINCT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, round(CASE WHEN len([x FOR x IN embedding IF isinf(x)]) > 0 THEN 'inf'::DOUBLE ELSE sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) END, 6) AS length, round(CASE WHEN len([x FOR x IN embedding[1:32] IF isinf(x)]) > 0 THEN 'inf'::DOUBLE ELSE sqrt(list_sum([x * x FOR x IN embedding[1:32]::DOUBLE[]])) END, 6) AS half_length, CASE vec_id % 50 WHEN 1 THEN 'ZERO_LENGTH' WHEN 2 THEN 'NOT_FINITE' WHEN 3 THEN 'WRONG_DIMENSION' END AS fault FROM stored",
    "vector_differences": f"WITH {_BENT} SELECT vec_id, 'MISSING' AS difference FROM embeddings WHERE vec_id % 50 = 6 UNION ALL SELECT vec_id, 'DUPLICATE' FROM embeddings WHERE vec_id % 50 = 7 UNION ALL SELECT vec_id + 1000000, 'UNEXPECTED' FROM embeddings WHERE vec_id % 50 = 8 UNION ALL SELECT vec_id, 'VECTOR_MISMATCH' FROM embeddings WHERE vec_id % 50 IN (1, 2, 3, 4)",
}

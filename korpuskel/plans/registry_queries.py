"""Queries on joins, sets, intervals, windows and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.operators import lifecycle as L
from korpuskel.operators import registry as R
from korpuskel.session import read_table


def registry_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-way inner join: line items with order, customer, nation and region, summed per region, nation and segment."""
    t = lambda name: read_table(spark, sf_dir, name)
    joined = (
        t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("amount"))


def evidence_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting evidence with its release and source version, per release state and source class."""
    evidence = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"rel": tidy("corpus_release_id"), "id": tidy("evidence_id")}, F.col("delivered_at"), {"svid": tidy("source_version_id")})
    releases = read_table(spark, sf_dir, "corpus_releases").select(tidy("corpus_release_id").alias("rel"), "release_state")
    versions = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("svid"), "source_class", "publisher_id")
    return evidence.join(releases, "rel").join(versions, "svid").groupBy("release_state", "source_class", "publisher_id").agg(F.count(F.lit(1)).alias("n_evidence"))


def servable_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have an order of the highest priority."""
    urgent = read_table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence listed by the manifest or delivered, but not both, per release."""
    keys = {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}
    sides = [read_table(spark, sf_dir, t).select(*[v.alias(k) for k, v in keys.items()]) for t in ("release_manifest", "corpus_evidence")]
    return R.missing_keys(*sides, list(keys))


def coverage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per release: listed, delivered, and listed and delivered; complete if they are the same set."""
    ids = {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}
    tag = lambda name, listed: read_table(spark, sf_dir, name).select(*[v.alias(k) for k, v in ids.items()], F.lit(listed).alias("listed"))
    both = tag("release_manifest", 1).unionByName(tag("corpus_evidence", 0)).dropna().groupBy(*ids).agg(F.max("listed").alias("l"), F.max(1 - F.col("listed")).alias("d"))
    sums = both.groupBy("corpus_release_id").agg(F.sum("l").alias("n_listed"), F.sum("d").alias("n_delivered"), F.sum(F.col("l") * F.col("d")).alias("n_both"))
    return sums.withColumn("is_complete", (F.col("n_listed") == F.col("n_both")) & (F.col("n_delivered") == F.col("n_both")))


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each year against those of the year before as inventories by customer and priority: NEW, REMOVED, CHANGED or UNCHANGED by fingerprint.

    An item whose number and largest price stay is CHANGED all the same if its
    fetched content (the sum of its prices) isn't the same. Each order is tagged as current
    in its year and as previous in the next; one aggregation compares the sides.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(14,2)").alias("p"), F.year("o_orderdate").alias("y"))
    span = orders.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("year"), F.lit(1).alias("now")), F.struct((F.col("y") + 1).alias("year"), F.lit(0).alias("now"))))
    tagged = orders.select("o_custkey", "o_orderpriority", "p", sides.alias("s")).select("o_custkey", "o_orderpriority", "p", "s.*")
    side = lambda n, f: f(F.when(F.col("now") == n, F.col("p")))
    prints = tagged.groupBy("year", "o_custkey", "o_orderpriority").agg(*[side(n, f).alias(f"{name}{n}") for n in (0, 1) for name, f in (("n", F.count), ("p", F.max), ("c", F.sum))])
    within = prints.join(span, (F.col("year") > F.col("lo")) & (F.col("year") <= F.col("hi")))
    state = F.when(F.col("n0") == 0, "NEW").when(F.col("n1") == 0, "REMOVED").when((F.col("n0") != F.col("n1")) | (F.col("p0") != F.col("p1")), "CHANGED").when(F.col("c0") != F.col("c1"), "CHANGED_ON_FETCH").otherwise("UNCHANGED")
    return within.select("year", "o_custkey", "o_orderpriority", state.alias("state"))


def effective_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source versions in effect at each release's cutoff."""
    versions = read_table(spark, sf_dir, "source_versions").select("source_version_id", "effective_from", "effective_to")
    moments = read_table(spark, sf_dir, "corpus_releases").select("corpus_release_id", F.to_date("cutoff_at").alias("at"))
    return L.in_force(versions, moments, "effective_from", "effective_to", "at").select("corpus_release_id", "source_version_id")


def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source version to the next of its source: it supersedes it, or cites it; every third in part, of the evidence whose id ends in an even digit."""
    versions = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("version_id"), tidy("source_id").alias("source_id"), "effective_from").dropDuplicates(["version_id"])
    following = F.lead("effective_from").over(Window.partitionBy("source_id").orderBy("effective_from", "version_id"))
    number = F.conv(F.substring(F.sha2("version_id", 256), 1, 6), 16, 10).cast("bigint")
    linked = versions.withColumn("valid_from", following).where("valid_from IS NOT NULL").withColumn("number", number)
    kind = F.when(F.col("number") % 5 == 0, "CITES").when(F.col("number") % 3 == 0, "PARTIALLY_SUPERSEDES").otherwise("SUPERSEDES")
    sections = F.when(F.col("number") % 3 == 0, F.array(*[F.lit(d) for d in "02468ACE"]))
    none = F.lit(None).cast("array<string>")
    return linked.select("version_id", kind.alias("kind"), "valid_from", F.lit(None).cast("date").alias("valid_to"), none.alias("evidence_ids"), sections.alias("section_ids"), none.alias("recommendation_ids"))


def effective_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting evidence of each release that a relationship of its version takes out of force at the cutoff, and the rest."""
    evidence = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}, F.col("delivered_at"), {"version_id": tidy("source_version_id")})
    releases = read_table(spark, sf_dir, "corpus_releases").select(tidy("corpus_release_id").alias("corpus_release_id"), F.to_date("cutoff_at").alias("at"))
    asked = evidence.join(releases, "corpus_release_id").withColumns({"section_id": F.substring("evidence_id", -1, 1), "recommendation_id": F.lit(None).cast("string")})
    hit = L.taken_out(asked, _relationships(spark, sf_dir), ["corpus_release_id"], "at")
    return hit.groupBy("corpus_release_id", "is_hit").agg(F.count(F.lit(1)).alias("n_evidence"))


def _dependencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, dependencies, known): parts that depend on the ones at half and at a third of their number; multiples of 97 are missing."""
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    links = parts.where("k > 2").select(name(F.col("k")).alias("parent"), F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3))).alias("c"))
    return parts.where("k % 10 = 0").select(name(F.col("k")).alias("package")), links.where("c > 0").select("parent", name(F.col("c")).alias("package")), parts.where("k % 97 <> 0").select(name(F.col("k")).alias("package"))


def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that every tenth part needs, by the wave that found them, and why the closure isn't complete."""
    found = L.closure(*_dependencies(spark, sf_dir), max_packages=1_000_000_000, max_depth=50)
    return found.packages.withColumn("issues", F.lit(",".join(found.issues)))


def closing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from low parts to high ones that would close a cycle in the dependencies."""
    links = _dependencies(spark, sf_dir)[1]
    new = read_table(spark, sf_dir, "part").where("p_partkey <= 20").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("parent"), F.concat(F.lit("P"), (F.col("p_partkey") * 7 + 1).cast("string")).alias("package"))
    return L.closing_edges(links, new, "parent", "package")


def previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the type of its user's event before it, and its number."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("day"))
    return R.latest_before(events, ["user_id"], ["ts", "event_id"], "day", "event_type").select("event_id", "previous_event_type", "sequence_no")


def row_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the same order within one place of each line."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    near = R.neighbourhood(lines, lines, "l_orderkey", "l_linenumber", 1)
    return near.select("anchor_l_orderkey", "anchor_l_linenumber", "l_linenumber", "l_partkey")


def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of the last purchase at or before each event of a user."""
    events = read_table(spark, sf_dir, "events").withColumns({"bought": F.when(F.col("event_type") == "purchase", F.col("value")), "day": F.to_date("ts")})
    return R.fill_forward(events, ["user_id"], ["ts", "event_id"], "day", "bought", "last_bought").select("event_id", F.round("last_bought", 6).alias("last_bought"))


def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight newest events of each user, one of each type."""
    events = read_table(spark, sf_dir, "events")
    newest = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("e")).select("user_id", "event_type", "e.*")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return newest.withColumn("place", place).where("place <= 8").select("user_id", "place", "event_type", "event_id")


def outbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to append to an outbox that holds the first ten days: one per user, type and day."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "event_id")
    stored = events.where(F.col("day") < "2024-01-11")
    return R.new_rows(events, stored, ["user_id", "event_type", "day"], ["event_id"])


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later releases that each release leads to, and in how many steps."""
    releases = read_table(spark, sf_dir, "corpus_releases").select("corpus_release_id", "cutoff_at")
    following = F.lead("corpus_release_id").over(Window.orderBy("cutoff_at", "corpus_release_id"))
    return R.reachable(releases.select("corpus_release_id", following.alias("later_id")), "corpus_release_id", "later_id")


def release_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each release's set of evidence and content."""
    rows = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}, F.col("delivered_at"), {"content": F.sha2(F.coalesce("content_exact", F.lit("")), 256)})
    return R.set_digest(rows, ["corpus_release_id"], F.col("evidence_id"), F.col("content"))


def review_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: cases with two adjudicators or more, and the share on which the latest levels are all the same."""
    said = latest_rows(
        read_table(spark, sf_dir, "review_decisions"),
        {"case_id": tidy("case_id"), "who": tidy("adjudicator_identity")},
        F.col("decided_at"),
        {"level": tidy(F.col("decided_case.strata")["clinical_risk"]), "suite": F.col("suite_partition")},
    ).where(F.col("level").isNotNull())
    each = said.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("lo"), F.max("level").alias("hi"), F.min("suite").alias("suite_partition")).where("n > 1")
    return each.groupBy("suite_partition").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg((F.col("lo") == F.col("hi")).cast("double")), 6).alias("agreement"))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation number of each gold evidence of a case, by first appearance."""
    cases = latest_rows(read_table(spark, sf_dir, "benchmark_cases"), {"case_id": tidy("case_id")}, F.col("created_at"), {"ids": F.col("gold_evidence.evidence_id")})
    first = cases.select("case_id", F.posexplode("ids").alias("pos", "raw")).select("case_id", "pos", tidy("raw").alias("evidence_id")).dropna().groupBy("case_id", "evidence_id").agg(F.min("pos").alias("pos"))
    return first.select("case_id", "evidence_id", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")).alias("citation_no"))


def complete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of whose alternative complete sets at least one lies in their gold evidence, and forbidden ids among it; ids compare without letter case and outer blanks."""
    empty = F.array().cast("array<string>")
    ids = lambda c: F.array_compact(F.transform(F.coalesce(c, empty), tidy))
    cases = latest_rows(
        read_table(spark, sf_dir, "benchmark_cases"),
        {"case_id": tidy("case_id")},
        F.col("created_at"),
        {"gold": ids(F.col("gold_evidence.evidence_id")), "sets": F.col("minimum_complete_evidence_sets"), "forbidden": ids(F.col("forbidden_evidence_ids"))},
    )
    covered = F.exists(F.coalesce("sets", F.array().cast(cases.schema["sets"].dataType)), lambda s: F.size(F.array_except(ids(s["evidence_ids"]), F.col("gold"))) == 0)
    return cases.select("case_id", covered.alias("is_covered"), F.size(F.array_intersect("gold", "forbidden")).alias("n_forbidden"))


def keyed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 50 documents with text, the same on every run: the smallest keyed hashes."""
    keyed = read_table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.sha2(F.concat(F.lit("sample-key|"), F.col("doc_id").cast("string")), 256).alias("k"))
    return keyed.orderBy("k").limit(50).select("doc_id")


def filter_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows that pass each form of filter: equality, membership, in a list, negation, boolean, empty, none."""
    rows = read_table(spark, sf_dir, "corpus_evidence")
    forms = {
        "equal": F.col("language") == "en",
        "contains": F.array_contains("evidence_roles", "MONITORING"),
        "any": F.col("jurisdiction").isin("WORLD", "TEST"),
        "must_not": ~(F.col("lifecycle_status") == "SUPERSEDED"),
        "boolean": F.col("render_allowed"),
        "empty": F.size("applicability.population") == 0,
        "no_match": F.col("language") == "xx",
    }
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{n}") for n, c in forms.items()])


def wide_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions of each case's filter, widened by WORLD; an empty filter stays empty."""
    cases = latest_rows(read_table(spark, sf_dir, "benchmark_cases"), {"case_id": tidy("case_id")}, F.col("created_at"), {"j": F.coalesce(F.col("retrieval_filter.jurisdictions"), F.array().cast("array<string>"))})
    wide = F.when(F.size("j") > 0, F.array_sort(F.array_union("j", F.array(F.lit("WORLD"))))).otherwise(F.col("j"))
    return cases.select("case_id", F.array_join(wide, ",").alias("jurisdictions"))


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by release and kind, and how many of them name a page."""
    each = read_table(spark, sf_dir, "corpus_evidence").select("corpus_release_id", F.explode("anchors").alias("a"))
    return each.groupBy("corpus_release_id", F.col("a.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_anchors"), F.count("a.pdf_page").alias("n_pages"))


def text_change_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts that several releases share, by narrative fingerprint."""
    rows = read_table(spark, sf_dir, "corpus_evidence").select("corpus_release_id", X.narrative_print(F.col("content_search")).alias("print_sha256")).dropna().distinct()
    return rows.groupBy("print_sha256").agg(F.count(F.lit(1)).alias("n_releases")).where("n_releases > 1")


def active_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and type the newest event that is still active in the middle of the month, where an event lasts as many hours as its value and purchases for good."""
    events = read_table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    lasting = events.withColumn("expires", F.when(F.col("event_type") != "purchase", F.timestamp_seconds(F.unix_timestamp("ts") + F.floor(F.coalesce("value", F.lit(0.0)) * 3600).cast("bigint"))))
    return R.active_at(lasting, ["user_id", "event_type"], F.lit("2024-01-15").cast("timestamp"), "expires", [F.col("ts"), F.col("event_id")], ["event_id"])


def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per release whether delivered evidence and entries without a version make up what the manifest lists."""
    keys = {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}
    pick = lambda df: df.select(*[v.alias(k) for k, v in keys.items()])
    manifest, evidence = read_table(spark, sf_dir, "release_manifest"), read_table(spark, sf_dir, "corpus_evidence")
    return R.accounted(pick(manifest), pick(evidence), pick(manifest.where(tidy("source_version_id").isNull())), [*keys], ["corpus_release_id"])


def registry_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting evidence against its source version, field by field: held, and not the same (nulls are the same as nulls only)."""
    fields = ["source_id", "publisher_id", "jurisdiction", "language", "lifecycle_status"]
    evidence = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}, F.col("delivered_at"), {"svid": tidy("source_version_id"), **{f: tidy(f) for f in fields}})
    versions = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("svid"), *[tidy(f).alias(f"v_{f}") for f in fields]).dropDuplicates(["svid"])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"v_{f}")).alias("same")) for f in fields]))
    flat = evidence.join(versions, "svid").select("corpus_release_id", each.alias("x")).select("corpus_release_id", "x.*")
    return flat.groupBy("corpus_release_id", "field").agg(F.count(F.lit(1)).alias("n_held"), F.count_if(~F.col("same")).alias("n_differing"))


def register_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that evidence names with differing sources, publishers or versions."""
    rows = read_table(spark, sf_dir, "corpus_evidence").select("source_artifact_sha256", tidy("source_id").alias("source_id"), tidy("publisher_id").alias("publisher_id"), tidy("source_version_id").alias("source_version_id"))
    return R.register_conflicts(rows, "source_artifact_sha256", "source_id", "publisher_id", "source_version_id")


def artifact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per release the evidence whose artifact is that of the release before (REUSED), another (DRIFTED), or new (NEW)."""
    releases = read_table(spark, sf_dir, "corpus_releases").select(tidy("corpus_release_id").alias("corpus_release_id"), F.row_number().over(Window.orderBy("cutoff_at", "corpus_release_id")).alias("n"))
    rows = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")}, F.col("delivered_at"), {"sha": F.col("source_artifact_sha256")}).join(releases, "corpus_release_id")
    sides = F.explode(F.array(F.struct(F.col("n").alias("at"), F.lit(True).alias("now")), F.struct((F.col("n") + 1).alias("at"), F.lit(False).alias("now"))))
    tagged = rows.select("evidence_id", "sha", sides.alias("s")).select("evidence_id", "sha", "s.*")
    both = tagged.groupBy("at", "evidence_id").agg(F.bool_or("now").alias("has_now"), F.bool_or(~F.col("now")).alias("had"), F.max(F.when(F.col("now"), F.col("sha"))).alias("a"), F.max(F.when(~F.col("now"), F.col("sha"))).alias("b")).where("has_now")
    state = F.when(~F.col("had"), "NEW").when(F.col("a").eqNullSafe(F.col("b")), "REUSED").otherwise("DRIFTED")
    return both.join(releases, F.col("at") == F.col("n")).groupBy("corpus_release_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n_evidence"))


def artifact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source version has an artifact: from delivered evidence, else from a manifest, else from nowhere."""
    versions = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("source_version_id")).dropna().distinct()
    have = lambda table, column: read_table(spark, sf_dir, table).where(F.col(column).isNotNull()).select(tidy("source_version_id").alias("source_version_id")).dropna().distinct()
    first, second = have("corpus_evidence", "source_artifact_sha256").withColumn("e", F.lit(True)), have("release_manifest", "artifact_sha256").withColumn("m", F.lit(True))
    both = versions.join(first, "source_version_id", "left").join(second, "source_version_id", "left")
    return both.select("source_version_id", F.when(F.col("e"), "EVIDENCE").when(F.col("m"), "MANIFEST").otherwise("NONE").alias("found_in"))


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by the state of their reviews: one level, several levels settled by the latest independent decision, or open."""
    said = latest_rows(read_table(spark, sf_dir, "review_decisions"), {"case_id": tidy("case_id"), "who": tidy("adjudicator_identity")}, F.col("decided_at"), {"level": tidy(F.col("decided_case.strata")["clinical_risk"]), "free": F.coalesce("independent_of_candidate_team", F.lit(False)), "at": F.col("decided_at")}).where("level IS NOT NULL")
    grouped = said.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.count_distinct("level").alias("n_levels"), F.min("level").alias("one"))
    resolution = said.where("free").groupBy("case_id").agg(F.max(F.struct("at", "who", "level"))["level"].alias("resolved"))
    joined = grouped.join(resolution, "case_id", "left")
    state = F.when(F.col("n_levels") == 1, "AGREED").when(F.col("resolved").isNotNull(), "RESOLVED").otherwise("OPEN")
    return joined.select("case_id", "n_reviews", "n_levels", state.alias("state"), F.when(F.col("n_levels") == 1, F.col("one")).otherwise(F.col("resolved")).alias("level"))


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document: that of its source version where it is known, else its own, tidied; by language and origin."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", tidy("lang").alias("own"), tidy("source_version_id").alias("svid"))
    versions = read_table(spark, sf_dir, "source_versions").select(tidy("source_version_id").alias("svid"), tidy("language").alias("outer")).dropDuplicates(["svid"])
    joined = docs.join(versions, "svid", "left")
    origin = F.when(F.col("outer").isNotNull(), "VERSION").when(F.col("own").isNotNull(), "DOCUMENT").otherwise("NONE")
    return joined.groupBy(F.coalesce("outer", "own").alias("language"), origin.alias("origin")).agg(F.count(F.lit(1)).alias("n_documents"))


def grounded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as claims that cite their gold evidence: supported if all of it is in the evidence of their release."""
    cases = latest_rows(read_table(spark, sf_dir, "benchmark_cases"), {"case_id": tidy("case_id")}, F.col("created_at"), {"rel": tidy("corpus_release_id"), "ids": F.transform("gold_evidence.evidence_id", tidy)})
    held = read_table(spark, sf_dir, "corpus_evidence").select(tidy("corpus_release_id").alias("rel"), tidy("evidence_id").alias("evidence_id"))
    return R.grounded(cases.where("rel IS NOT NULL"), held, "rel", "case_id", "ids", "evidence_id").select("case_id", "n_cited", "is_supported")


def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user and day: how many there were, and the first stage (event type) that is still missing."""
    stages = ["view", "click", "cart", "purchase"]
    events = read_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    done = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_attempts"), F.collect_set("event_type").alias("done"))
    missing = F.get(F.filter(F.array(*[F.lit(s) for s in stages]), lambda s: ~F.array_contains("done", s)), F.lit(0))
    return done.select("user_id", "day", (F.col("n_attempts") + 1).alias("next_attempt"), missing.alias("resume_at"))


def priority_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the group in which they are reviewed; a row that two groups claim is counted as ambiguous."""
    orders = read_table(spark, sf_dir, "orders")
    flags = {"large": F.col("o_totalprice") > 300_000, "urgent": F.col("o_orderpriority").startswith("1"), "open": F.col("o_orderstatus") == "O"}
    claims = sum((f.cast("int") for f in flags.values()), F.lit(0))
    group = F.when(claims > 1, "AMBIGUOUS")
    for name, f in flags.items():
        group = group.when(f, name.upper())
    return orders.groupBy(group.otherwise("REST").alias("review_group")).agg(F.count(F.lit(1)).alias("n_orders"))


def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of each source version (keys in order, nulls given) and its digest."""
    names = sorted(["source_version_id", "source_id", "publisher_id", "source_title", "jurisdiction", "language", "lifecycle_status", "source_class"])
    rows = read_table(spark, sf_dir, "source_versions").select("source_version_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("payload"))
    return rows.select("source_version_id", F.sha2("payload", 256).alias("payload_sha256"))


def uri_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that anchors name, by host and by whether they may be fetched: secure, without user or port, no bare address, within the publisher's domain."""
    each = read_table(spark, sf_dir, "corpus_evidence").select(F.explode("anchors.source_uri").alias("uri")).dropna()
    host = F.lower(F.regexp_extract("uri", r"^https?://(?:[^/@]*@)?([^/:?#]*)", 1))
    fault = (
        F.when(~F.col("uri").startswith("https://"), "NOT_SECURE")
        .when(F.col("uri").rlike(r"^https://[^/]*@"), "HAS_USER")
        .when(F.col("uri").rlike(r"^https://[^/]*:(?!443(?:/|$))"), "HAS_PORT")
        .when(host.rlike(r"^[0-9.]+$"), "BARE_ADDRESS")
        .when(~host.rlike(r"(?:^|\.)invalid$"), "FOREIGN_HOST")
    )
    return each.groupBy(host.alias("host"), F.coalesce(fault, F.lit("ALLOWED")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_anchors"))


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource types that anchors name."""
    each = read_table(spark, sf_dir, "corpus_evidence").select(F.explode("anchors.fhir_resource_type").alias("resource_type")).dropna()
    return each.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n_anchors"))


def cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of line items (share of the largest quantity) by a cache that has those of every other order, keyed by a hash of both sides."""
    pairs = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = F.sha2(F.concat_ws("\0", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string")), 256)
    score = F.round(F.col("l_quantity") / 50, 6)
    cache = pairs.where("l_orderkey % 2 = 0").select(key.alias("cache_key"), (score + 1).alias("score"))
    return R.with_cache(pairs, cache, key, score).select("l_orderkey", "l_linenumber", "score", "is_cached")


_NAMES = [
    registry_detail, evidence_detail, servable_semi, set_difference, coverage_accounting, inventory_diff, effective_as_of, effective_evidence, dependency_closure, closing_edges, previous_event,
    row_neighbourhood, last_purchase, recent_list, outbox_rows, lineage, release_digests, review_agreement, citation_numbers, complete_sets, keyed_sample, filter_forms,
    wide_jurisdictions, anchor_groups, text_change_prints, active_exceptions, partition_checks, registry_consistency, register_conflicts, artifact_reuse, artifact_sources, review_states,
    document_languages, grounded_cases, attempt_numbers, priority_groups, payload_digests, uri_checks, type_histogram, cached_scores,
]
QUERIES = {f.__name__: f for f in _NAMES}


def _t(column: str) -> str:
    return f"nullif(upper(trim({column}, E' \\t\\n')), '')"


_EV = f"""SELECT {_t("corpus_release_id")} AS rel, {_t("evidence_id")} AS id, * FROM corpus_evidence
QUALIFY row_number() OVER (PARTITION BY {_t("corpus_release_id")}, {_t("evidence_id")} ORDER BY delivered_at DESC) = 1"""
_CASES = f"SELECT * REPLACE ({_t('case_id')} AS case_id) FROM benchmark_cases QUALIFY row_number() OVER (PARTITION BY {_t('case_id')} ORDER BY created_at DESC) = 1"
_PRESENT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_search, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_SIDES = " UNION ALL ".join(f"SELECT {_t('corpus_release_id')} AS corpus_release_id, {_t('evidence_id')} AS evidence_id, {n} AS listed FROM {table}" for table, n in (("release_manifest", 1), ("corpus_evidence", 0)))
_BOTH = f"SELECT corpus_release_id, evidence_id, max(listed) AS l, max(1 - listed) AS d FROM ({_SIDES}) WHERE corpus_release_id IS NOT NULL AND evidence_id IS NOT NULL GROUP BY ALL"

SQL = {
    "registry_detail": "SELECT r_name, n_name, c_mktsegment, count(*) AS n_items, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "evidence_detail": f"SELECT release_state, source_class, v.publisher_id, count(*) AS n_evidence FROM ({_EV}) e JOIN corpus_releases r ON {_t('r.corpus_release_id')} = e.rel JOIN source_versions v ON {_t('v.source_version_id')} = {_t('e.source_version_id')} GROUP BY ALL",
    "servable_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "set_difference": f"SELECT corpus_release_id, evidence_id, CASE WHEN l = 1 THEN 'LEFT' ELSE 'RIGHT' END AS side FROM ({_BOTH}) WHERE l <> d",
    "coverage_accounting": f"SELECT *, n_listed = n_both AND n_delivered = n_both AS is_complete FROM (SELECT corpus_release_id, CAST(sum(l) AS BIGINT) AS n_listed, CAST(sum(d) AS BIGINT) AS n_delivered, CAST(sum(l * d) AS BIGINT) AS n_both FROM ({_BOTH}) GROUP BY ALL)",
    "inventory_diff": """WITH o AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, count(*) AS n, max(CAST(o_totalprice AS DECIMAL(14,2))) AS p, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS c FROM orders GROUP BY ALL), s AS (SELECT min(y) AS lo, max(y) AS hi FROM o),
f AS (SELECT coalesce(b.y, a.y + 1) AS year, coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, CASE WHEN a.n IS NULL THEN 'NEW' WHEN b.n IS NULL THEN 'REMOVED' WHEN a.n <> b.n OR a.p <> b.p THEN 'CHANGED' WHEN a.c <> b.c THEN 'CHANGED_ON_FETCH' ELSE 'UNCHANGED' END AS state
  FROM o a FULL JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.y = a.y + 1) SELECT CAST(year AS INTEGER) AS year, o_custkey, o_orderpriority, state FROM f, s WHERE year > lo AND year <= hi""",
    "effective_evidence": f"""WITH v AS (SELECT DISTINCT ON ({_t('source_version_id')}) {_t('source_version_id')} AS vid, {_t('source_id')} AS sid, effective_from FROM source_versions), n AS (SELECT vid, lead(effective_from) OVER (PARTITION BY sid ORDER BY effective_from, vid) AS valid_from, CAST('0x' || substr(sha256(vid), 1, 6) AS BIGINT) AS k FROM v),
r AS (SELECT * FROM n WHERE valid_from IS NOT NULL AND k % 5 <> 0), e AS (SELECT rel, id, {_t('source_version_id')} AS vid FROM ({_EV}) WHERE rel IS NOT NULL AND id IS NOT NULL)
SELECT rel AS corpus_release_id, coalesce(r.vid IS NOT NULL AND r.valid_from <= CAST(cutoff_at AS DATE) AND (k % 3 <> 0 OR substr(id, -1) IN ('0', '2', '4', '6', '8', 'A', 'C', 'E')), false) AS is_hit, count(*) AS n_evidence FROM e JOIN corpus_releases c ON {_t('c.corpus_release_id')} = rel LEFT JOIN r ON r.vid = e.vid GROUP BY ALL""",
    "dependency_closure": """WITH RECURSIVE links AS (SELECT 'P' || p_partkey AS parent, 'P' || (p_partkey // d) AS package FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey > 2 AND p_partkey // d > 0), known AS (SELECT 'P' || p_partkey AS package FROM part WHERE p_partkey % 97 <> 0),
walk AS (SELECT 'P' || p_partkey AS package, 1 AS depth FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 97 <> 0 UNION SELECT l.package, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.package JOIN known k ON k.package = l.package)
SELECT package, CAST(min(depth) AS INTEGER) AS depth, 'MISSING_PACKAGE' AS issues FROM walk GROUP BY package""",
    "closing_edges": """WITH RECURSIVE links AS (SELECT 'P' || p_partkey AS parent, 'P' || (p_partkey // d) AS package FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey > 2 AND p_partkey // d > 0), new AS (SELECT 'P' || p_partkey AS parent, 'P' || (p_partkey * 7 + 1) AS package FROM part WHERE p_partkey <= 20),
walk AS (SELECT package AS origin, package AS node FROM new UNION SELECT w.origin, l.package FROM walk w JOIN links l ON l.parent = w.node) SELECT parent, package FROM new JOIN walk ON origin = package AND node = parent""",
    "active_exceptions": "WITH e AS (SELECT *, CASE WHEN event_type <> 'purchase' THEN to_timestamp(CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(coalesce(value, 0) * 3600) AS BIGINT)) END AS expires FROM events WHERE ts < TIMESTAMP '2024-01-15') SELECT user_id, event_type, event_id FROM e WHERE expires IS NULL OR expires > TIMESTAMPTZ '2024-01-15 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "partition_checks": f"""WITH m AS (SELECT {_t('corpus_release_id')} AS r, {_t('evidence_id')} AS i, bool_or({_t('source_version_id')} IS NULL) AS x FROM release_manifest GROUP BY ALL), e AS (SELECT DISTINCT {_t('corpus_release_id')} AS r, {_t('evidence_id')} AS i FROM corpus_evidence),
f AS (SELECT coalesce(m.r, e.r) AS r, m.i IS NOT NULL AS listed, e.i IS NOT NULL AS inside, coalesce(x, false) AS out FROM m FULL JOIN e ON m.r = e.r AND m.i = e.i WHERE coalesce(m.r, e.r) IS NOT NULL AND coalesce(m.i, e.i) IS NOT NULL),
s AS (SELECT r AS corpus_release_id, count(*) FILTER (listed) AS n_expected, count(*) FILTER (listed AND NOT inside AND NOT out) AS n_missing, count(*) FILTER (NOT listed) AS n_extra, count(*) FILTER (inside AND out) AS n_both FROM f GROUP BY r) SELECT *, n_missing = 0 AND n_extra = 0 AND n_both = 0 AS is_sound FROM s""",
    "registry_consistency": " UNION ALL ".join(f"SELECT e.rel AS corpus_release_id, '{f}' AS field, count(*) AS n_held, count(*) FILTER ({_t(f'e.{f}')} IS DISTINCT FROM {_t(f'v.{f}')}) AS n_differing FROM ({_EV}) e JOIN (SELECT DISTINCT ON ({_t('source_version_id')}) * FROM source_versions) v ON {_t('v.source_version_id')} = {_t('e.source_version_id')} GROUP BY e.rel" for f in ("source_id", "publisher_id", "jurisdiction", "language", "lifecycle_status")),
    "register_conflicts": f"SELECT source_artifact_sha256, {', '.join(f'count(DISTINCT coalesce({_t(f)}, chr(1))) AS n_{f}' for f in ('source_id', 'publisher_id', 'source_version_id'))} FROM corpus_evidence WHERE source_artifact_sha256 IS NOT NULL GROUP BY 1 HAVING n_source_id > 1 OR n_publisher_id > 1 OR n_source_version_id > 1",
    "artifact_reuse": f"WITH r AS (SELECT {_t('corpus_release_id')} AS rel, row_number() OVER (ORDER BY cutoff_at, corpus_release_id) AS n FROM corpus_releases), e AS (SELECT x.rel, n, id, source_artifact_sha256 AS sha FROM ({_EV}) x JOIN r USING (rel) WHERE id IS NOT NULL) SELECT a.rel AS corpus_release_id, CASE WHEN b.id IS NULL THEN 'NEW' WHEN a.sha IS NOT DISTINCT FROM b.sha THEN 'REUSED' ELSE 'DRIFTED' END AS state, count(*) AS n_evidence FROM e a LEFT JOIN e b ON b.id = a.id AND b.n = a.n - 1 GROUP BY ALL",
    "artifact_sources": f"WITH v AS (SELECT DISTINCT {_t('source_version_id')} AS id FROM source_versions) SELECT id AS source_version_id, CASE WHEN id IN (SELECT {_t('source_version_id')} FROM corpus_evidence WHERE source_artifact_sha256 IS NOT NULL AND {_t('source_version_id')} IS NOT NULL) THEN 'EVIDENCE' WHEN id IN (SELECT {_t('source_version_id')} FROM release_manifest WHERE artifact_sha256 IS NOT NULL AND {_t('source_version_id')} IS NOT NULL) THEN 'MANIFEST' ELSE 'NONE' END AS found_in FROM v WHERE id IS NOT NULL",
    "review_states": f"WITH s AS (SELECT {_t('case_id')} AS c, {_t('adjudicator_identity')} AS who, {_t('decided_case.strata[' + chr(39) + 'clinical_risk' + chr(39) + ']')} AS level, coalesce(independent_of_candidate_team, false) AS free, decided_at AS t FROM review_decisions WHERE {_t('case_id')} IS NOT NULL AND {_t('adjudicator_identity')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_t('case_id')}, {_t('adjudicator_identity')} ORDER BY decided_at DESC) = 1), g AS (SELECT c, count(*) AS n, count(DISTINCT level) AS k, min(level) AS one, (list(level ORDER BY t DESC, who DESC) FILTER (free))[1] AS resolved FROM s WHERE level IS NOT NULL GROUP BY c) SELECT c AS case_id, n AS n_reviews, k AS n_levels, CASE WHEN k = 1 THEN 'AGREED' WHEN resolved IS NOT NULL THEN 'RESOLVED' ELSE 'OPEN' END AS state, CASE WHEN k = 1 THEN one ELSE resolved END AS level FROM g",
    "document_languages": f"SELECT coalesce({_t('v.language')}, {_t('d.lang')}) AS language, CASE WHEN {_t('v.language')} IS NOT NULL THEN 'VERSION' WHEN {_t('d.lang')} IS NOT NULL THEN 'DOCUMENT' ELSE 'NONE' END AS origin, count(*) AS n_documents FROM documents d LEFT JOIN (SELECT DISTINCT ON ({_t('source_version_id')}) * FROM source_versions) v ON {_t('v.source_version_id')} = {_t('d.source_version_id')} GROUP BY ALL",
    "grounded_cases": f"WITH c AS (SELECT case_id, {_t('corpus_release_id')} AS rel, list_distinct([{_t('g.evidence_id')} FOR g IN coalesce(gold_evidence, []) IF {_t('g.evidence_id')} IS NOT NULL]) AS ids FROM ({_CASES}) WHERE case_id IS NOT NULL), e AS (SELECT DISTINCT {_t('corpus_release_id')} AS rel, {_t('evidence_id')} AS id FROM corpus_evidence), x AS (SELECT case_id, rel, unnest(ids) AS id FROM c), k AS (SELECT case_id, count(*) AS have FROM x JOIN e USING (rel, id) GROUP BY case_id) SELECT c.case_id, len(ids) AS n_cited, len(ids) > 0 AND coalesce(have, 0) = len(ids) AS is_supported FROM c LEFT JOIN k USING (case_id) WHERE rel IS NOT NULL",
    "attempt_numbers": "SELECT user_id, day, count(*) + 1 AS next_attempt, [s FOR s IN ['view', 'click', 'cart', 'purchase'] IF NOT list_contains(list(event_type), s)][1] AS resume_at FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events) GROUP BY user_id, day",
    "priority_groups": "SELECT CASE WHEN CAST(o_totalprice > 300000 AS INTEGER) + CAST(o_orderpriority LIKE '1%' AS INTEGER) + CAST(o_orderstatus = 'O' AS INTEGER) > 1 THEN 'AMBIGUOUS' WHEN o_totalprice > 300000 THEN 'LARGE' WHEN o_orderpriority LIKE '1%' THEN 'URGENT' WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'REST' END AS review_group, count(*) AS n_orders FROM orders GROUP BY 1",
    "payload_digests": "SELECT source_version_id, sha256(CAST(json_object('jurisdiction', jurisdiction, 'language', language, 'lifecycle_status', lifecycle_status, 'publisher_id', publisher_id, 'source_class', source_class, 'source_id', source_id, 'source_title', source_title, 'source_version_id', source_version_id) AS VARCHAR)) AS payload_sha256 FROM source_versions",
    "uri_checks": "WITH u AS (SELECT unnest(anchors).source_uri AS uri FROM corpus_evidence), h AS (SELECT uri, lower(regexp_extract(uri, '^https?://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host FROM u WHERE uri IS NOT NULL) SELECT host, CASE WHEN NOT starts_with(uri, 'https://') THEN 'NOT_SECURE' WHEN regexp_matches(uri, '^https://[^/]*@') THEN 'HAS_USER' WHEN regexp_matches(uri, '^https://[^/]*:') THEN 'HAS_PORT' WHEN regexp_matches(host, '^[0-9.]+$') THEN 'BARE_ADDRESS' WHEN NOT regexp_matches(host, '(?:^|\\.)invalid$') THEN 'FOREIGN_HOST' ELSE 'ALLOWED' END AS verdict, count(*) AS n_anchors FROM h GROUP BY ALL",
    "type_histogram": "SELECT resource_type, count(*) AS n_anchors FROM (SELECT unnest(anchors).fhir_resource_type AS resource_type FROM corpus_evidence) WHERE resource_type IS NOT NULL GROUP BY 1",
    "cached_scores": "SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS score, l_orderkey % 2 = 0 AS is_cached FROM lineitem",
    "effective_as_of": "SELECT corpus_release_id, source_version_id FROM source_versions JOIN corpus_releases ON coalesce(effective_from <= CAST(cutoff_at AS DATE), true) AND coalesce(effective_to >= CAST(cutoff_at AS DATE), true)",
    "previous_event": "SELECT event_id, lag(event_type) OVER w AS previous_event_type, row_number() OVER w AS sequence_no FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "row_neighbourhood": "SELECT a.l_orderkey AS anchor_l_orderkey, a.l_linenumber AS anchor_l_linenumber, b.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 1",
    "last_purchase": "SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS last_bought FROM events",
    "recent_list": "WITH n AS (SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, event_type, event_id FROM n QUALIFY place <= 8",
    "outbox_rows": "SELECT user_id, event_type, day, min(event_id) AS event_id FROM (SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id FROM events) WHERE day >= '2024-01-11' GROUP BY user_id, event_type, day",
    "lineage": "WITH r AS (SELECT corpus_release_id, row_number() OVER (ORDER BY cutoff_at, corpus_release_id) AS i FROM corpus_releases) SELECT a.corpus_release_id, b.corpus_release_id AS later_id, CAST(b.i - a.i AS INTEGER) AS steps FROM r a JOIN r b ON b.i > a.i",
    "release_digests": f"WITH m AS (SELECT DISTINCT rel, sha256(id || '|' || sha256(coalesce(content_exact, ''))) AS m FROM ({_EV})), p AS (SELECT rel, CAST('0x' || substr(m, 1, 8) AS BIGINT) % 4096 AS bucket, count(*) AS n, sha256(string_agg(m, '' ORDER BY m)) AS d FROM m GROUP BY ALL) SELECT rel AS corpus_release_id, CAST(sum(n) AS BIGINT) AS n_members, sha256(string_agg(d, '' ORDER BY bucket)) AS digest FROM p GROUP BY rel",
    "review_agreement": f"WITH s AS (SELECT {_t('case_id')} AS c, {_t('decided_case.strata[' + chr(39) + 'clinical_risk' + chr(39) + ']')} AS level, suite_partition AS suite FROM review_decisions QUALIFY row_number() OVER (PARTITION BY {_t('case_id')}, {_t('adjudicator_identity')} ORDER BY decided_at DESC) = 1), e AS (SELECT c, min(suite) AS suite_partition, count(DISTINCT level) = 1 AS same FROM s WHERE level IS NOT NULL GROUP BY c HAVING count(*) > 1) SELECT suite_partition, count(*) AS n_cases, round(avg(CAST(same AS DOUBLE)), 6) AS agreement FROM e GROUP BY ALL",
    "citation_numbers": f"WITH g AS (SELECT case_id, unnest(gold_evidence).evidence_id AS raw, generate_subscripts(gold_evidence, 1) AS pos FROM ({_CASES})), f AS (SELECT case_id, {_t('raw')} AS evidence_id, min(pos) AS pos FROM g WHERE {_t('raw')} IS NOT NULL GROUP BY ALL) SELECT case_id, evidence_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) AS INTEGER) AS citation_no FROM f",
    "complete_sets": f"""WITH t AS (SELECT case_id, coalesce([{_t('g.evidence_id')} FOR g IN gold_evidence], []) AS gold, coalesce([{_t('x')} FOR x IN forbidden_evidence_ids], []) AS forbidden, minimum_complete_evidence_sets AS sets FROM ({_CASES}))
SELECT case_id, len(list_filter(coalesce(sets, []), lambda s: len(list_filter([{_t('i')} FOR i IN coalesce(s.evidence_ids, [])], lambda i: i IS NOT NULL AND NOT list_contains(gold, i))) = 0)) > 0 AS is_covered,
  CAST(len(list_intersect(list_filter(gold, lambda i: i IS NOT NULL), list_filter(forbidden, lambda i: i IS NOT NULL))) AS INTEGER) AS n_forbidden FROM t""",
    "keyed_sample": "SELECT doc_id FROM documents WHERE length(text) > 0 ORDER BY sha256('sample-key|' || doc_id) LIMIT 50",
    "filter_forms": "SELECT count(*) FILTER (language = 'en') AS n_equal, count(*) FILTER (list_contains(evidence_roles, 'MONITORING')) AS n_contains, count(*) FILTER (jurisdiction IN ('WORLD', 'TEST')) AS n_any, count(*) FILTER (lifecycle_status <> 'SUPERSEDED') AS n_must_not, count(*) FILTER (render_allowed) AS n_boolean, count(*) FILTER (len(applicability.population) = 0) AS n_empty, count(*) FILTER (language = 'xx') AS n_no_match FROM corpus_evidence",
    "wide_jurisdictions": f"SELECT case_id, array_to_string(CASE WHEN len(retrieval_filter.jurisdictions) > 0 THEN list_sort(list_distinct(list_append(retrieval_filter.jurisdictions, 'WORLD'))) ELSE [] END, ',') AS jurisdictions FROM ({_CASES})",
    "anchor_groups": "SELECT corpus_release_id, a.kind AS kind, count(*) AS n_anchors, count(a.pdf_page) AS n_pages FROM (SELECT corpus_release_id, unnest(anchors) AS a FROM corpus_evidence) GROUP BY ALL",
    "text_change_prints": f"SELECT print_sha256, count(DISTINCT corpus_release_id) AS n_releases FROM (SELECT corpus_release_id, sha256(replace(lower({_PRESENT}), 'ß', 'ss') || chr(31)) AS print_sha256 FROM corpus_evidence WHERE content_search IS NOT NULL) GROUP BY 1 HAVING n_releases > 1",
}

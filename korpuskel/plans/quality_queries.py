"""Queries on how passages read, what is evidence, pairs that conflict, rules against facts, partitions and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.operators import applicability, evaluation, pairing, presentation, quality
from korpuskel.operators import registry as R
from korpuskel.plans import sqlparts as S
from korpuskel.plans import text_queries
from korpuskel.session import read_table

RELEASE, EVIDENCE = "corpus_release_id", "evidence_id"
#: The tables here have no header rows, so a value that stands once in many of them takes the place of the outcome label.
OUTCOME = "Boolean"


def _counting(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    return latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {RELEASE: tidy(RELEASE), EVIDENCE: tidy(EVIDENCE)}, F.col("delivered_at"), values)


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counting(spark, sf_dir, source_version_id=tidy("source_version_id"), content_exact=F.col("content_exact"), anchor=presentation.table_anchor(F.col("anchors")))
    rows = rows.withColumn("cells", X.cells(F.col("content_exact")))
    table = [RELEASE, "source_version_id", "table_id"]
    schemas = presentation.headers(rows.where("source_version_id IS NOT NULL").withColumn("table_id", F.col("anchor.table_id")), table, OUTCOME)
    return presentation.rendered(rows, schemas, table, "content_exact")


def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that have exactly one header row, with its row, the number of labels and the outcome's column."""
    rows = _counting(spark, sf_dir, source_version_id=tidy("source_version_id"), content_exact=F.col("content_exact"), anchor=presentation.table_anchor(F.col("anchors")))
    rows = rows.where("source_version_id IS NOT NULL").withColumn("cells", X.cells(F.col("content_exact"))).withColumn("table_id", F.col("anchor.table_id"))
    found = presentation.headers(rows, [RELEASE, "source_version_id", "table_id"], OUTCOME)
    return found.select(RELEASE, "source_version_id", "table_id", F.col("schema.header_row").alias("header_row"), F.size("schema.labels").alias("n_labels"), F.col("schema.outcome").alias("outcome"))


def passage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each release by the kind of passage."""
    return _rendered(spark, sf_dir).groupBy(RELEASE, "kind").agg(F.count(F.lit(1)).alias("n_passages"))


def rendered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage as a reader sees it: kind, title, digest of its body, fingerprint."""
    return _rendered(spark, sf_dir).select(RELEASE, EVIDENCE, "kind", "title", F.sha2("body", 256).alias("body_sha256"), "print")


def anchor_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each evidence by the surface they are on, spoken for by the most precise one."""
    rows = _counting(spark, sf_dir, anchors=F.col("anchors"))
    return presentation.grouped_anchors(rows, [RELEASE, EVIDENCE], "anchors")


def passage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of passages by whether they could be paired with a page anchor."""
    rows = _counting(spark, sf_dir, content_exact=F.col("content_exact"), anchors=F.col("anchors"))
    blocks = presentation.passage_blocks(rows, [RELEASE, EVIDENCE], "content_exact", "anchors")
    return blocks.groupBy(RELEASE, F.col("anchor_place").isNotNull().alias("is_paired")).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("block")).alias("n_characters"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.upper(F.element_at(F.split(tidy("source_version_id"), ":"), -1))
    rows = _counting(spark, sf_dir, text=F.col("content_search"), asset=asset, table_id=presentation.table_anchor(F.col("anchors"))["table_id"], replayed=F.coalesce(F.size("anchors") > 0, F.lit(False)))
    return quality.classified(rows, RELEASE, EVIDENCE, "text", "asset", "table_id", "replayed", [F.coalesce("asset", F.lit(""))])


def classified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence is fit for use and in what roles, or why not."""
    return _classified(spark, sf_dir).select(RELEASE, EVIDENCE, "disposition", F.array_join("reasons", ",").alias("reasons"), F.array_join("roles", ",").alias("roles"))


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by reason, and the share of its release with an interval."""
    made = _classified(spark, sf_dir)
    whole = made.groupBy(RELEASE).agg(F.count(F.lit(1)).alias("n_release"))
    each = made.select(RELEASE, F.explode("reasons").alias("reason")).groupBy(RELEASE, "reason").agg(F.count(F.lit(1)).alias("n_evidence"))
    low, high = evaluation.wilson(F.col("n_evidence"), F.col("n_release"))
    return each.join(whole, RELEASE).select(RELEASE, "reason", "n_evidence", "n_release", F.round(low, 6).alias("share_low"), F.round(high, 6).alias("share_high"))


def approval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a classified release: every row judged, none approved with reasons or without roles, no text approved twice."""
    made = _classified(spark, sf_dir)
    texts = _counting(spark, sf_dir, print=F.sha2(X.fold_case(F.col("content_search")), 256))
    both = texts.join(made, [RELEASE, EVIDENCE], "left")
    ok = F.col("disposition") == "APPROVE"
    twice = both.where(ok & F.col("print").isNotNull()).groupBy(RELEASE, "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(RELEASE).agg(F.count(F.lit(1)).alias("n_twice"))
    sums = both.groupBy(RELEASE).agg(F.count_if(F.col("disposition").isNull()).alias("n_unjudged"), F.count_if(ok & ((F.size("reasons") > 0) | (F.size("roles") == 0))).alias("n_unsound"), F.count_if(ok).alias("n_approved"))
    return sums.join(twice, RELEASE, "left").select(RELEASE, "n_unjudged", "n_unsound", "n_approved", F.coalesce("n_twice", F.lit(0)).alias("n_twice"))


#: What a question of a topic asks for. Fixed values.
PROMPTS = {"CONTRAINDICATION": "restriction or contraindication", "APPLICABILITY": "population applicability", "DOSE": "dose or threshold", "MONITORING": "monitoring requirement", "NEGATION": "explicit negative statement"}
LONGEST_FRAGMENT = 320


def built_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each evidence by the first topic that its wording gives it, with the longest fragment that is allowed; evidence without one has none."""
    text = F.coalesce("content_search", F.lit(""))
    wordings = {"CONTRAINDICATION": X.EXCEPTION, "DOSE": X.TOPICS["dose"], "MONITORING": X.TOPICS["monitoring"], "APPLICABILITY": X.TOPICS["applicability"], "NEGATION": X.TOPICS["negation"]}
    topic = F.coalesce(*[F.when(text.rlike(p), F.lit(t)) for t, p in wordings.items()])
    asked = F.coalesce(*[F.when(F.col("topic") == t, F.lit(words)) for t, words in PROMPTS.items()])
    rows = _counting(spark, sf_dir, topic=topic, fragment=X.fragment(F.col("content_search"), LONGEST_FRAGMENT)).where("topic IS NOT NULL")
    return rows.select(RELEASE, EVIDENCE, "topic", F.concat(F.lit("Retrieve the source "), asked, F.lit(" stating: "), F.col("fragment")).alias("question"))


def statement_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the reason why they aren't in the frame of graded recommendations; the row without a reason is in it."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select(quality.dropped_for(F.col("text")).alias("reason"))
    return docs.groupBy("reason").agg(F.count(F.lit(1)).alias("n_documents"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a release that may contradict each other."""
    rows = _counting(spark, sf_dir, text=F.col("content_search"))
    return pairing.conflict_pairs(rows, RELEASE, EVIDENCE, "text").select(RELEASE, "left_id", "right_id", "shared")


def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the tokens of the two texts of each evidence overlap, by release: those of at least 0.85 and the mean."""
    rows = _counting(spark, sf_dir, a=X.loose_tokens(F.col("content_exact"), 1), b=X.loose_tokens(F.col("content_search"), 1))
    made = rows.select(RELEASE, F.round(pairing.overlap(F.col("a"), F.col("b")), 9).alias("o"))
    return made.groupBy(RELEASE).agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("o") >= 0.85).alias("n_redundant"), F.round(F.avg("o"), 6).alias("mean_overlap"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts, made of their numbers: some known, some not."""
    key = F.col("c_custkey")
    some = lambda n, *values: F.when(key % n != 0, F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<string>"))
    unit = F.when(key % 7 == 0, "mg").otherwise("ml")
    measures = F.when(key % 5 != 0, F.array(F.struct(F.when(key % 4 == 0, "CRCL").otherwise("EGFR").alias("concept"), F.round(F.abs("c_acctbal") / 100, 0).alias("value"), unit.alias("unit"))))
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(
            F.when(key % 6 != 0, (key % 90).cast("int")).alias("age"),
            some(3, "AF", "CKD").alias("conditions"),
            some(2, "DIABETES").alias("absent"),
            F.when(key % 11 == 0, F.array(F.lit("PREGNANCY"))).alias("populations"),
            F.when(key % 13 != 0, F.array(F.lit("PREGNANCY"))).alias("absent_populations"),
            F.when(key % 8 != 0, F.col("c_mktsegment")).alias("setting"),
            measures.alias("measurements"),
        ).cast(applicability.FACTS).alias("facts"),
    )


def tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about customers against one rule: match, mismatch or unknown, and the reasons."""
    rule = F.struct(
        F.lit(18).alias("min_age"),
        F.lit(75).alias("max_age"),
        F.array(F.lit("CKD"), F.lit("AF")).alias("required"),
        F.array(F.lit("DIABETES")).alias("excluded"),
        F.lit(False).alias("pregnancy_allowed"),
        F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")).alias("settings"),
        F.array(F.struct(F.lit("EGFR").alias("concept"), F.lit(">=").alias("operator"), F.lit(30.0).alias("value"), F.lit("ml").alias("unit"))).alias("measurements"),
    ).cast(applicability.RULE)
    made = _facts(spark, sf_dir).select("c_custkey", applicability.judged(rule, F.col("facts")).alias("j"))
    return made.select("c_custkey", "j.status", F.array_join("j.unknown", "; ").alias("unknown"), F.array_join("j.mismatched", "; ").alias("mismatched"))


PARTITION_KEY = "partition-key"


def keyed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in two halves by the rank of a keyed hash of their id."""
    cases = read_table(spark, sf_dir, "benchmark_cases").select(tidy("case_id").alias("case_id")).dropna().distinct()
    return R.keyed_halves(cases, "case_id", PARTITION_KEY)


PARTITIONS = ["DEVELOPMENT", "SEALED_HOLDOUT", "SYNTHETIC"]
TOPIC_CODES = ["CONTRAINDICATION", "APPLICABILITY", "DOSE", "MONITORING", "TERMINOLOGY", "MULTILINGUAL_CROSS_LINGUAL", "STALE_SOURCE", "WRONG_JURISDICTION", "CONFLICTING_EVIDENCE", "INSUFFICIENT_EVIDENCE", "NEGATION", "PARAPHRASED_INTENT"]


def _case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(read_table(spark, sf_dir, "benchmark_cases"), {"case_id": tidy("case_id")}, F.col("created_at"), {"suite_partition": tidy("suite_partition"), "topics": F.col("safety_topics"), "gold": F.col("gold_evidence.evidence_id"), "roles": F.col("required_evidence_roles"), RELEASE: tidy(RELEASE)})


def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per partition and topic against the least number wanted, zero where there are none."""
    each = _case_rows(spark, sf_dir).select("suite_partition", F.explode(F.array_distinct("topics")).alias("topic"), "case_id")
    counted = each.groupBy("suite_partition", "topic").agg(F.count(F.lit(1)).alias("n"))
    every = R.all_pairs(spark, "suite_partition", PARTITIONS, "topic", TOPIC_CODES)
    least = F.when(F.col("suite_partition") == "DEVELOPMENT", 10).otherwise(5)
    return every.join(counted, ["suite_partition", "topic"], "left").select("suite_partition", "topic", F.coalesce("n", F.lit(0)).alias("n_cases"), least.alias("least"), (F.coalesce("n", F.lit(0)) < least).alias("is_short"))


def topic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that could serve a case of each topic, by release: from its roles or its wording."""
    roles = F.coalesce("evidence_roles", F.array().cast("array<string>"))
    text = F.coalesce("content_search", F.lit(""))
    has = lambda role: F.array_contains(roles, role)
    scoped = F.coalesce(F.size("applicability.population") + F.size("applicability.care_settings") + F.size("applicability.inclusion_criteria") + F.size("applicability.exclusion_criteria") > 0, F.lit(False))
    rules = {
        "CONTRAINDICATION": has("EXCEPTION_OR_CONTRAINDICATION") | text.rlike(X.TOPICS["negation"]),
        "APPLICABILITY": has("APPLICABILITY") | scoped | text.rlike(X.TOPICS["applicability"]),
        "DOSE": has("DOSE_OR_THRESHOLD") | text.rlike(X.TOPICS["dose"]),
        "MONITORING": has("MONITORING") | text.rlike(X.TOPICS["monitoring"]),
        "TERMINOLOGY": text.rlike(X.TOPICS["terminology"]),
        "NEGATION": text.rlike(X.TOPICS["negation"]),
    }
    rows = _counting(spark, sf_dir, **{name.lower(): F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})
    return rows.groupBy(RELEASE).agg(F.count(F.lit(1)).alias("n_evidence"), *[F.count_if(name.lower()).alias(f"n_{name.lower()}") for name in rules])


def shared_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold evidence that cases of different partitions share, per pair of partitions; sound partitions share none."""
    each = _case_rows(spark, sf_dir).select("suite_partition", RELEASE, F.explode("gold").alias("g")).select("suite_partition", RELEASE, tidy("g").alias("id")).dropna()
    sets = each.groupBy(RELEASE, "id").agg(F.array_sort(F.collect_set("suite_partition")).alias("p")).where("size(p) > 1")
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, 99), lambda b: F.struct(a.alias("left_partition"), b.alias("right_partition")))))
    return sets.select(F.explode(pairs).alias("x")).groupBy("x.left_partition", "x.right_partition").agg(F.count(F.lit(1)).alias("n_shared"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per partition: cases, reviews by independent people, distinct gold evidence, and the share of reviewed cases with disagreement (null without any)."""
    cases = _case_rows(spark, sf_dir)
    said = latest_rows(read_table(spark, sf_dir, "review_decisions"), {"case_id": tidy("case_id"), "who": tidy("adjudicator_identity")}, F.col("decided_at"), {"level": tidy(F.col("decided_case.strata")["clinical_risk"]), "free": F.col("independent_of_candidate_team")})
    reviewed = said.where("level IS NOT NULL").groupBy("case_id").agg(F.count_if("free").alias("n_free"), (F.count_distinct("level") > 1).alias("differs"))
    gold = cases.select("suite_partition", F.explode("gold").alias("g")).select("suite_partition", tidy("g").alias("id")).dropna().groupBy("suite_partition").agg(F.count_distinct("id").alias("n_gold"))
    sums = cases.join(reviewed, "case_id", "left").groupBy("suite_partition").agg(F.count(F.lit(1)).alias("n_cases"), F.sum(F.coalesce("n_free", F.lit(0))).alias("n_reviews"), F.count("differs").alias("n_reviewed"), F.count_if("differs").alias("n_differing"))
    return sums.join(gold, "suite_partition", "left").select("suite_partition", "n_cases", "n_reviews", "n_reviewed", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.round(F.try_divide("n_differing", "n_reviewed"), 6).alias("disagreement"))


def draw_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each market segment's customers of nation 0 to 4 are drawn as a uniform sample of all would be."""
    customers = read_table(spark, sf_dir, "customer")
    sums = customers.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("successes"), F.count_if(F.col("c_nationkey") < 5).alias("observed"))
    whole = Window.partitionBy()
    return evaluation.draw_checks(sums.withColumns({"population": F.sum("successes").over(whole), "draws": F.sum("observed").over(whole)}), "population", "successes", "draws", "observed").withColumn("p", F.round("p", 9))


def chapter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type: all, purchases worth 50 or more as answered, with an interval and the bound where none was seen."""
    events = read_table(spark, sf_dir, "events")
    sums = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") >= 50)).alias("n_answered"))
    low, high = evaluation.wilson(F.col("n_answered"), F.col("n_events"), 1.959963985)
    zero = F.when(F.col("n_answered") == 0, F.round(evaluation.zero_bound(F.col("n_events")), 6))
    decision = F.when(high < 0.25, "BELOW").when(low > 0.5, "ABOVE").otherwise("OPEN")
    return sums.select("user_id", "n_events", "n_answered", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), zero.alias("zero_bound"), decision.alias("decision"))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that cases require, by tone then label: how many cases, and the place in that order."""
    counts = _case_rows(spark, sf_dir).select(F.explode(F.array_distinct("roles")).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n_cases"))
    tone = F.when(F.col("role").rlike("EXCEPTION|CONTRAINDICATION"), 1).when(F.col("role").rlike("PRIMARY|GUIDELINE"), 0).otherwise(2)
    label = X.humanised(F.col("role"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(tone, label))
    return counts.select("role", label.alias("label"), "n_cases", place.alias("place"))


def runtime_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events by type as if they were latencies: number, mean, 95th percentile by nearest rank, items a second."""
    events = read_table(spark, sf_dir, "events").where("value IS NOT NULL")
    sums = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("value"), 6).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_ms"), F.sum("value").alias("_total"))
    return sums.select("event_type", "n_items", "mean_ms", F.round("p95_ms", 6).alias("p95_ms"), F.round(F.try_divide(F.col("n_items") * 1000, "_total"), 6).alias("items_a_second"))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each case: numerals that no gold evidence holds, wide citation (four or more), and how many in all; only cases with any."""
    missing = text_queries.numeral_screen(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_numerals"))
    cited = _case_rows(spark, sf_dir).select("case_id", F.size(F.array_distinct(F.array_compact(F.transform("gold", tidy)))).alias("n_cited"))
    both = cited.join(missing, "case_id", "left").select("case_id", F.coalesce("n_numerals", F.lit(0)).alias("n_numerals"), F.coalesce(F.col("n_cited") >= 4, F.lit(False)).alias("is_wide"))
    return both.withColumn("n_flags", (F.col("n_numerals") > 0).cast("int") + F.col("is_wide").cast("int")).where("n_flags > 0")


_LISTED = [
    table_headers, passage_kinds, rendered_passages, anchor_surfaces, passage_blocks, classified_evidence, quarantine_counts, approval_checks, built_questions, statement_frame, conflict_pairs, text_overlap, tristate,
    keyed_partitions, topic_coverage, topic_candidates, shared_gold, provenance, draw_checks, chapter_coverage, role_counts, runtime_matrix, flag_counts,
]
QUERIES = {f.__name__: f for f in _LISTED}

_KEYS = "rel, id"
_ANCHORED = "[a FOR a IN coalesce(anchors, []) IF a.kind = 'TABLE_CELL' AND a.table_id IS NOT NULL]"
_EV = f"""ev AS (SELECT {S.t("corpus_release_id")} AS rel, {S.t("evidence_id")} AS id, {S.t("source_version_id")} AS version, content_exact, content_search, anchors, evidence_roles, applicability FROM corpus_evidence
  WHERE {S.t("corpus_release_id")} IS NOT NULL AND {S.t("evidence_id")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {S.t("corpus_release_id")}, {S.t("evidence_id")} ORDER BY delivered_at DESC) = 1)"""
_TRIM = "trim(value, E' \\t\\n\\r')"
_HEADS = f"""{_EV}, src AS (SELECT *, ({_ANCHORED})[1].table_id AS table_id, coalesce(({_ANCHORED})[1].row_index, 0) AS row_index FROM ev), {S.cells("src", _KEYS)},
heads AS (SELECT rel, version, table_id, min(row_index) AS header_row, min(id) AS id FROM src WHERE table_id IS NOT NULL AND version IS NOT NULL AND (rel, id) IN (SELECT rel, id FROM cells WHERE {_TRIM} = '{OUTCOME}') GROUP BY ALL HAVING count(*) = 1),
schemas AS (SELECT h.rel, h.version, h.table_id, h.header_row, count(*) FILTER ({_TRIM} <> '') AS n_labels, min(n) FILTER ({_TRIM} = '{OUTCOME}') AS outcome, min_by(col, cell) AS identity FROM heads h JOIN cells USING (rel, id) GROUP BY ALL),
label_of AS (SELECT h.rel, h.version, h.table_id, col, {_TRIM} AS label FROM heads h JOIN cells USING (rel, id) WHERE {_TRIM} <> '')"""
_FILLED = f"filled AS (SELECT rel, id, count(*) AS n_filled, min_by({_TRIM}, cell) AS first, string_agg({_TRIM}, ' | ' ORDER BY cell) AS columns, string_agg({S.present('value')}, ': ' ORDER BY cell) AS caption, string_agg('- ' || {S.present('value')}, chr(10) ORDER BY cell) AS listed, min_by({S.present('value')}, cell) AS alone FROM cells WHERE NOT {S.placeholder('value')} GROUP BY ALL)"
_KINDS = f"""{_HEADS}, {_FILLED}, {S.row_prints(_KEYS)},
kinds AS (
  SELECT src.*, f.*, s.header_row, s.outcome, s.identity, s.table_id AS schema_table, src.rel AS r, src.id AS i,
    CASE WHEN src.table_id IS NULL OR NOT regexp_matches(coalesce(content_exact, ''), '^[A-Z]{{1,3}}[0-9]+=') THEN 'NARRATIVE' WHEN s.header_row = src.row_index THEN 'TABLE_HEADER'
      WHEN n_filled = 2 AND lower(first) IN ({", ".join(map(S.q, presentation.CAPTIONS))}) THEN 'TABLE_METADATA' WHEN n_filled = 1 AND NOT contains(first, chr(10)) AND length(first) <= {presentation.LONGEST_TITLE} THEN 'TABLE_SECTION_TITLE'
      WHEN n_filled = 1 THEN 'TABLE_NOTE' WHEN s.table_id IS NULL THEN 'UNLABELLED_TABLE_ROW' ELSE 'DECISION_RULE' END AS kind
  FROM src LEFT JOIN filled f ON f.rel = src.rel AND f.id = src.id LEFT JOIN schemas s ON s.rel = src.rel AND s.version = src.version AND s.table_id = src.table_id)"""
_RULES = f"""lines AS (SELECT k.r, k.i, cell, n < k.outcome AS is_before, '- ' || coalesce(l.label, c.col) || ': ' || {S.present('value')} AS line FROM kinds k JOIN cells c ON c.rel = k.r AND c.id = k.i LEFT JOIN label_of l ON l.rel = k.r AND l.version = k.version AND l.table_id = k.table_id AND l.col = c.col
  WHERE kind = 'DECISION_RULE' AND c.col <> k.identity AND NOT {S.placeholder('value')}),
ruled AS (SELECT r, i, concat_ws(chr(10), 'When:' || chr(10) || string_agg(line, chr(10) ORDER BY cell) FILTER (is_before), 'Then:' || chr(10) || string_agg(line, chr(10) ORDER BY cell) FILTER (NOT is_before)) AS body FROM lines GROUP BY ALL),
named AS (SELECT k.r, k.i, {_TRIM} AS name FROM kinds k JOIN cells c ON c.rel = k.r AND c.id = k.i AND c.col = k.identity WHERE kind = 'DECISION_RULE' AND NOT {S.placeholder('value')})"""
_CALLED = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in presentation.CALLED.items()) + " END"
_FOLDED = S.fold(S.view("coalesce(content_search, '')"))
_SCOPED = " OR ".join(f"regexp_matches(v, {S.q(p)})" for p in [*X.POPULATIONS.values(), *X.CARE_SETTINGS.values(), X.INCLUSION.split("(.{1,180}?)")[0] + ".", X.EXCLUSION.split("(.{1,140}?)")[0] + "."])
_HEADS_LIKE = lambda starts: "(" + " OR ".join(f"starts_with(low, {S.q(s)})" for s in starts) + ")"
_CLASSIFIED = f"""{_EV}, judged AS (
  SELECT rel, id, {_FOLDED} AS low, coalesce({S.view("content_search")}, '') AS v, {S.fold("content_search")} AS folded, coalesce(upper(string_split(version, ':')[-1]), '') AS asset, ({_ANCHORED})[1].table_id AS table_id, coalesce(len(anchors) > 0, false) AS replayed FROM ev),
why AS (SELECT *, contains(low, 'object at 0x') OR contains(low, 'arrayformula') AS unstable FROM judged),
reasoned AS (SELECT *, CASE WHEN NOT replayed THEN CASE WHEN unstable THEN ['{quality.REPLAY}', '{quality.STRUCTURE}'] ELSE ['{quality.REPLAY}'] END WHEN unstable THEN ['{quality.STRUCTURE}']
    WHEN lower(trim(table_id)) IN ({", ".join(map(S.q, quality.ADMIN_SHEETS))}) OR (table_id IS NOT NULL AND asset LIKE '%ANNEX_D') THEN ['{quality.NO_EVIDENCE}'] WHEN table_id IS NOT NULL AND {_HEADS_LIKE(quality.HEADER_STARTS)} THEN ['{quality.HEADER}']
    WHEN table_id IS NOT NULL AND {_HEADS_LIKE(quality.METADATA_STARTS)} AND length(low) < 500 OR table_id IS NULL AND {_HEADS_LIKE(quality.PAGE_STARTS)} THEN ['{quality.NO_EVIDENCE}']
    WHEN NOT ({" OR ".join(f"asset LIKE '%{e}'" for e in quality.BASE_ROLES)}) THEN ['{quality.UNRESOLVED}'] ELSE [] END AS reasons FROM why),
dup AS (SELECT *, folded IS NOT NULL AND row_number() OVER (PARTITION BY rel, folded ORDER BY len(reasons) > 0, asset, id) > 1 AS again FROM reasoned),
final AS (SELECT rel, id, CASE WHEN again THEN list_append(reasons, '{quality.DUPLICATE}') ELSE reasons END AS reasons,
  list_sort([r FOR r IN list_distinct([{"CASE " + " ".join(f"WHEN asset LIKE '%{e}' THEN '{r}'" for e, r in quality.BASE_ROLES.items()) + " END"}, CASE WHEN {_SCOPED} THEN 'APPLICABILITY' END, CASE WHEN regexp_matches(v, {S.q(X.THRESHOLD)}) THEN 'DOSE_OR_THRESHOLD' END, CASE WHEN regexp_matches(v, {S.q(X.EXCEPTION)}) THEN 'EXCEPTION_OR_CONTRAINDICATION' END, CASE WHEN regexp_matches(v, {S.q(X.MONITORING)}) THEN 'MONITORING' END]) IF r IS NOT NULL]) AS roles FROM dup)"""
_LOOSE = lambda column, least: f"list_distinct([{S.fold('x')} FOR x IN regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{N}}_+.-]+') IF length(x) >= {least}])"
_CONFLICT = f"""{_EV}, made AS (SELECT rel, id, regexp_matches(content_search, {S.q(X.TOPICS['negation'])}) AS negative, [x FOR x IN {_LOOSE('content_search', 4)} IF NOT regexp_matches(x, '^\\p{{Nd}}+$') AND NOT list_contains({X.CONFLICT_STOPWORDS}, x)] AS tokens FROM ev WHERE content_search IS NOT NULL),
pos AS (SELECT rel, id, unnest(tokens) AS tok FROM made WHERE NOT negative), neg AS (SELECT rel, id, unnest(tokens) AS tok FROM made WHERE negative),
held AS (SELECT rel, tok, count(*) AS n FROM pos GROUP BY ALL),
useful AS (SELECT rel, id, tok FROM neg JOIN held USING (rel, tok) QUALIFY row_number() OVER (PARTITION BY rel, id ORDER BY n, tok) <= 4),
few AS (SELECT rel, tok, id AS other FROM pos QUALIFY row_number() OVER (PARTITION BY rel, tok ORDER BY id) <= 128),
cand AS (SELECT DISTINCT u.rel, u.id, other FROM useful u JOIN few USING (rel, tok)),
best AS (SELECT c.rel, c.id, other, len(list_intersect(a.tokens, b.tokens)) AS shared FROM cand c JOIN made a ON a.rel = c.rel AND a.id = c.id JOIN made b ON b.rel = c.rel AND b.id = c.other QUALIFY row_number() OVER (PARTITION BY c.rel, c.id ORDER BY shared DESC, other DESC) = 1)"""
_CASES = f"""cases AS (SELECT {S.t("case_id")} AS case_id, {S.t("suite_partition")} AS part, {S.t("corpus_release_id")} AS rel, safety_topics, required_evidence_roles AS roles, [{S.t("g.evidence_id")} FOR g IN coalesce(gold_evidence, []) IF {S.t("g.evidence_id")} IS NOT NULL] AS gold FROM benchmark_cases
  WHERE {S.t("case_id")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {S.t("case_id")} ORDER BY created_at DESC) = 1)"""
_VALUE = "CASE WHEN f.k % 7 = 0 THEN 'mg' ELSE 'ml' END"
_TRISTATE = """f AS (SELECT c_custkey, c_custkey AS k, c_mktsegment AS seg, round(abs(c_acctbal) / 100, 0) AS val FROM customer),
r AS (SELECT c_custkey,
  [x FOR x IN [CASE WHEN k % 6 = 0 THEN 'age not provided' END, CASE WHEN k % 3 = 0 THEN 'required condition not established: AF' END, CASE WHEN k % 3 = 0 THEN 'required condition not established: CKD' END, CASE WHEN k % 2 = 0 THEN 'excluded condition not assessed: DIABETES' END,
    CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'pregnancy status not established' END, CASE WHEN k % 8 = 0 THEN 'care setting not provided' END,
    CASE WHEN k % 5 = 0 THEN 'EGFR not provided' WHEN k % 4 = 0 THEN 'EGFR required; CRCL is not interchangeable' WHEN k % 7 = 0 THEN 'EGFR unit mismatch: expected ml, received mg' END] IF x IS NOT NULL] AS u,
  [x FOR x IN [CASE WHEN k % 6 <> 0 AND k % 90 < 18 THEN 'age below required minimum 18' WHEN k % 6 <> 0 AND k % 90 > 75 THEN 'age above allowed maximum 75' END, CASE WHEN k % 11 = 0 THEN 'pregnancy is excluded' END,
    CASE WHEN k % 8 <> 0 AND seg NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'care setting not allowed: ' || seg END, CASE WHEN k % 5 <> 0 AND k % 4 <> 0 AND k % 7 <> 0 AND val < 30 THEN 'EGFR does not satisfy >= 30' END] IF x IS NOT NULL] AS m FROM f)"""
_IPAD, _OPAD = ("".join(f"{b ^ pad:02x}" for b in PARTITION_KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))
_LOW, _HIGH = S.wilson("n_release", "n_evidence")
_C_LOW, _C_HIGH = (x.replace(S.Z, "1.959963985") for x in S.wilson("n_events", "n_answered"))
_RAW_LOW, _RAW_HIGH = (x.removeprefix("round(").removesuffix(", 6)") for x in (_C_LOW, _C_HIGH))
_SCREEN = text_queries.SQL["numeral_screen"]
_PRECISION = "CASE WHEN coalesce(len(a.bbox) = 4, false) OR (a.char_start IS NOT NULL AND a.char_end IS NOT NULL) THEN 1 WHEN a.table_id IS NOT NULL AND a.row_index IS NOT NULL AND a.column_index IS NOT NULL THEN 2 WHEN a.pdf_page IS NOT NULL THEN 3 ELSE 4 END"
_TOPIC = {
    "contraindication": f"list_contains(r, 'EXCEPTION_OR_CONTRAINDICATION') OR regexp_matches(t, {S.q(X.TOPICS['negation'])})",
    "applicability": f"list_contains(r, 'APPLICABILITY') OR coalesce(len(applicability.population) + len(applicability.care_settings) + len(applicability.inclusion_criteria) + len(applicability.exclusion_criteria) > 0, false) OR regexp_matches(t, {S.q(X.TOPICS['applicability'])})",
    "dose": f"list_contains(r, 'DOSE_OR_THRESHOLD') OR regexp_matches(t, {S.q(X.TOPICS['dose'])})",
    "monitoring": f"list_contains(r, 'MONITORING') OR regexp_matches(t, {S.q(X.TOPICS['monitoring'])})",
    "terminology": f"regexp_matches(t, {S.q(X.TOPICS['terminology'])})",
    "negation": f"regexp_matches(t, {S.q(X.TOPICS['negation'])})",
}

SQL = {
    "table_headers": f"WITH {_HEADS} SELECT rel AS corpus_release_id, version AS source_version_id, table_id, CAST(header_row AS INTEGER) AS header_row, CAST(n_labels AS INTEGER) AS n_labels, CAST(outcome AS INTEGER) AS outcome FROM schemas",
    "passage_kinds": f"WITH {_KINDS} SELECT r AS corpus_release_id, kind, count(*) AS n_passages FROM kinds GROUP BY ALL",
    "rendered_passages": f"""WITH {_KINDS}, {_RULES} SELECT k.r AS corpus_release_id, k.i AS evidence_id, kind, CASE WHEN kind = 'NARRATIVE' THEN '' ELSE k.table_id || ' - ' || {_CALLED} || coalesce(' ' || name, '') END AS title,
  sha256(CASE kind WHEN 'NARRATIVE' THEN {S.present('content_exact')} WHEN 'TABLE_HEADER' THEN 'Columns: ' || columns WHEN 'TABLE_SECTION_TITLE' THEN alone WHEN 'TABLE_NOTE' THEN alone WHEN 'TABLE_METADATA' THEN caption WHEN 'UNLABELLED_TABLE_ROW' THEN coalesce(listed, '') ELSE coalesce(ruled.body, '') END) AS body_sha256,
  CASE WHEN kind = 'NARRATIVE' THEN sha256({S.fold(S.present('content_exact'))} || chr(31)) ELSE p.print END AS print FROM kinds k LEFT JOIN ruled ON ruled.r = k.r AND ruled.i = k.i LEFT JOIN named ON named.r = k.r AND named.i = k.i LEFT JOIN row_prints p ON p.rel = k.r AND p.id = k.i""",
    "anchor_surfaces": f"""WITH {_EV}, e AS (SELECT rel, id, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS place FROM ev), s AS (SELECT *, {_PRECISION} AS precision, coalesce(CASE WHEN a.table_id IS NOT NULL AND a.row_index IS NOT NULL THEN 'row ' || a.table_id || '!' || (a.row_index + 1) END, CASE WHEN a.pdf_page IS NOT NULL THEN 'page ' || a.pdf_page END, 'anchor ' || place) AS surface FROM e WHERE a IS NOT NULL)
SELECT rel AS corpus_release_id, id AS evidence_id, surface, n AS n_anchors, CAST(precision AS INTEGER) AS precision, a.kind AS kind, CAST(place AS INTEGER) AS place FROM (SELECT *, count(*) OVER (PARTITION BY rel, id, surface) AS n FROM s QUALIFY row_number() OVER (PARTITION BY rel, id, surface ORDER BY precision, place) = 1)""",
    "passage_blocks": f"WITH {_EV}, b AS (SELECT rel, string_split(content_exact, chr(10) || chr(10)) AS b, len([a FOR a IN coalesce(anchors, []) IF a.pdf_page IS NOT NULL]) AS p FROM ev WHERE content_exact IS NOT NULL AND NOT regexp_matches(content_exact, '^[A-Z]{{1,3}}[0-9]+=')) SELECT rel AS corpus_release_id, is_paired, count(*) AS n_blocks, CAST(sum(length(x)) AS BIGINT) AS n_characters FROM (SELECT rel, len(b) > 1 AND len(b) = p AS is_paired, unnest(b) AS x FROM b) GROUP BY ALL",
    "classified_evidence": f"WITH {_CLASSIFIED} SELECT rel AS corpus_release_id, id AS evidence_id, CASE WHEN len(reasons) > 0 THEN 'QUARANTINE' ELSE 'APPROVE' END AS disposition, coalesce(array_to_string(reasons, ','), '') AS reasons, CASE WHEN len(reasons) > 0 THEN '' ELSE coalesce(array_to_string(roles, ','), '') END AS roles FROM final",
    "quarantine_counts": f"WITH {_CLASSIFIED}, e AS (SELECT rel, unnest(reasons) AS reason FROM final), c AS (SELECT rel AS corpus_release_id, reason, count(*) AS n_evidence, any_value(n) AS n_release FROM e JOIN (SELECT rel, count(*) AS n FROM final GROUP BY rel) USING (rel) GROUP BY ALL) SELECT *, {_LOW} AS share_low, {_HIGH} AS share_high FROM c",
    "approval_checks": f"WITH {_CLASSIFIED}, a AS (SELECT f.rel, f.id, f.reasons, f.roles, d.folded FROM final f JOIN dup d ON d.rel = f.rel AND d.id = f.id), t AS (SELECT rel, count(*) AS n FROM (SELECT rel, folded FROM a WHERE len(reasons) = 0 AND folded IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY rel) SELECT rel AS corpus_release_id, 0 AS n_unjudged, count(*) FILTER (len(reasons) = 0 AND len(roles) = 0) AS n_unsound, count(*) FILTER (len(reasons) = 0) AS n_approved, coalesce(any_value(t.n), 0) AS n_twice FROM a LEFT JOIN t USING (rel) GROUP BY rel",
    "built_questions": f"WITH {_EV}, v AS (SELECT rel, id, {S.view('content_search')} AS t, CASE {' '.join(f'WHEN regexp_matches(content_search, {S.q(p)}) THEN {S.q(t)}' for t, p in (('CONTRAINDICATION', X.EXCEPTION), ('DOSE', X.TOPICS['dose']), ('MONITORING', X.TOPICS['monitoring']), ('APPLICABILITY', X.TOPICS['applicability']), ('NEGATION', X.TOPICS['negation'])))} END AS topic FROM ev WHERE content_search IS NOT NULL) SELECT rel AS corpus_release_id, id AS evidence_id, topic, 'Retrieve the source ' || CASE topic {' '.join(f'WHEN {S.q(t)} THEN {S.q(w)}' for t, w in PROMPTS.items())} END || ' stating: ' || CASE WHEN length(t) <= {LONGEST_FRAGMENT} THEN t WHEN contains(substr(t, 1, {LONGEST_FRAGMENT}), ' ') AND regexp_replace(substr(t, 1, {LONGEST_FRAGMENT}), ' [^ ]*$', '') <> '' THEN regexp_replace(substr(t, 1, {LONGEST_FRAGMENT}), ' [^ ]*$', '') ELSE substr(t, 1, {LONGEST_FRAGMENT}) END AS question FROM v WHERE topic IS NOT NULL",
    "statement_frame": f"""WITH t AS (SELECT text, [lower(x) FOR x IN regexp_extract_all(text, {S.q(X.STRENGTH)}, 1)] AS s, [lower(x) FOR x IN regexp_extract_all(text, {S.q(X.CERTAINTY)}, 1)] AS c FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN NOT (len(list_distinct(s)) <= 1 AND len(list_distinct(c)) <= 1 AND len(s) + len(c) > 0) THEN 'not graded' WHEN length(text) < 120 THEN 'too short' WHEN regexp_matches(text, {S.q(quality.BULLET)}) THEN 'bullet fragment' WHEN regexp_matches(text, {S.q(quality.SECTION)}) THEN 'section heading' WHEN regexp_matches(text, {S.q(quality.FOOTNOTE)}) THEN 'footnote' WHEN NOT regexp_matches(text, {S.q(quality.DEONTIC)}) THEN 'no deontic verb' END AS reason, count(*) AS n_documents FROM t GROUP BY 1""",
    "conflict_pairs": f"WITH {_CONFLICT} SELECT DISTINCT rel AS corpus_release_id, least(id, other) AS left_id, greatest(id, other) AS right_id, CAST(shared AS INTEGER) AS shared FROM best WHERE shared >= 2",
    "text_overlap": f"WITH {_EV}, o AS (SELECT rel, {_LOOSE('content_exact', 1)} AS a, {_LOOSE('content_search', 1)} AS b FROM ev), s AS (SELECT rel, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 9) AS o FROM o) SELECT rel AS corpus_release_id, count(*) AS n_evidence, count(*) FILTER (o >= 0.85) AS n_redundant, round(avg(o), 6) AS mean_overlap FROM s GROUP BY rel",
    "tristate": f"WITH {_TRISTATE} SELECT c_custkey, CASE WHEN len(m) > 0 THEN 'MISMATCH' WHEN len(u) > 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS status, coalesce(array_to_string(u, '; '), '') AS unknown, coalesce(array_to_string(m, '; '), '') AS mismatched FROM r",
    "keyed_partitions": f"WITH c AS (SELECT DISTINCT {S.t('case_id')} AS case_id FROM benchmark_cases), k AS (SELECT case_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(case_id)))) AS k FROM c WHERE case_id IS NOT NULL) SELECT case_id, CASE WHEN row_number() OVER (ORDER BY k, case_id) <= count(*) OVER () // 2 THEN 'FIRST' ELSE 'SECOND' END AS half FROM k",
    "topic_coverage": f"WITH {_CASES}, n AS (SELECT part, topic, count(*) AS n FROM (SELECT part, unnest(list_distinct(safety_topics)) AS topic FROM cases) GROUP BY ALL), e AS (SELECT unnest({PARTITIONS}) AS part), t AS (SELECT unnest({TOPIC_CODES}) AS topic) SELECT e.part AS suite_partition, t.topic, coalesce(n, 0) AS n_cases, CASE WHEN e.part = 'DEVELOPMENT' THEN 10 ELSE 5 END AS least, coalesce(n, 0) < CASE WHEN e.part = 'DEVELOPMENT' THEN 10 ELSE 5 END AS is_short FROM e CROSS JOIN t LEFT JOIN n ON n.part = e.part AND n.topic = t.topic",
    "topic_candidates": f"WITH {_EV}, x AS (SELECT rel, coalesce(evidence_roles, []) AS r, coalesce(content_search, '') AS t, applicability FROM ev) SELECT rel AS corpus_release_id, count(*) AS n_evidence, {', '.join(f'count(*) FILTER ({p}) AS n_{n}' for n, p in _TOPIC.items())} FROM x GROUP BY rel",
    "shared_gold": f"WITH {_CASES}, g AS (SELECT DISTINCT part, rel, unnest(gold) AS id FROM cases) SELECT a.part AS left_partition, b.part AS right_partition, count(*) AS n_shared FROM g a JOIN g b USING (rel, id) WHERE a.part < b.part GROUP BY ALL",
    "provenance": f"""WITH {_CASES}, said AS (SELECT {S.t('case_id')} AS case_id, {S.t("decided_case.strata['clinical_risk']")} AS level, independent_of_candidate_team AS free FROM review_decisions QUALIFY row_number() OVER (PARTITION BY {S.t('case_id')}, {S.t('adjudicator_identity')} ORDER BY decided_at DESC) = 1),
v AS (SELECT case_id, count(*) FILTER (free) AS n_free, count(DISTINCT level) > 1 AS differs FROM said WHERE level IS NOT NULL GROUP BY case_id), g AS (SELECT part, count(DISTINCT id) AS n_gold FROM (SELECT part, unnest(gold) AS id FROM cases) GROUP BY part)
SELECT part AS suite_partition, count(*) AS n_cases, CAST(sum(coalesce(n_free, 0)) AS BIGINT) AS n_reviews, count(differs) AS n_reviewed, coalesce(any_value(n_gold), 0) AS n_gold, round(count(*) FILTER (differs) / nullif(count(differs), 0), 6) AS disagreement FROM cases LEFT JOIN v USING (case_id) LEFT JOIN g USING (part) GROUP BY part""",
    "chapter_coverage": f"SELECT user_id, n_events, n_answered, {_C_LOW} AS low, {_C_HIGH} AS high, CASE WHEN n_answered = 0 THEN round(1 - 0.05 ^ (1 / n_events), 6) END AS zero_bound, CASE WHEN {_RAW_HIGH} < 0.25 THEN 'BELOW' WHEN {_RAW_LOW} > 0.5 THEN 'ABOVE' ELSE 'OPEN' END AS decision FROM (SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase' AND value >= 50) AS n_answered FROM events GROUP BY user_id)",
    "role_counts": f"WITH {_CASES}, c AS (SELECT role, count(*) AS n_cases FROM (SELECT unnest(list_distinct(roles)) AS role FROM cases) GROUP BY role), l AS (SELECT *, upper(substr(role, 1, 1)) || lower(replace(substr(role, 2), '_', ' ')) AS label, CASE WHEN regexp_matches(role, 'EXCEPTION|CONTRAINDICATION') THEN 1 WHEN regexp_matches(role, 'PRIMARY|GUIDELINE') THEN 0 ELSE 2 END AS tone FROM c) SELECT role, label, n_cases, CAST(row_number() OVER (ORDER BY tone, label) AS INTEGER) AS place FROM l",
    "flag_counts": f"WITH {_CASES}, m AS (SELECT case_id, count(*) AS n FROM ({_SCREEN}) GROUP BY case_id), b AS (SELECT c.case_id, coalesce(n, 0) AS n_numerals, len(list_distinct(gold)) >= 4 AS is_wide FROM cases c LEFT JOIN m USING (case_id)) SELECT *, CAST(n_numerals > 0 AS INTEGER) + CAST(is_wide AS INTEGER) AS n_flags FROM b WHERE n_numerals > 0 OR is_wide",
    "runtime_matrix": "SELECT event_type, count(*) AS n_items, round(avg(value), 6) AS mean_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms, round(count(*) * 1000 / nullif(sum(value), 0), 6) AS items_a_second FROM events WHERE value IS NOT NULL GROUP BY event_type",
}

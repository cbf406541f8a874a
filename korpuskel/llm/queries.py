"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.llm import consensus, copies, mixing, packing, subjects, tokens
from korpuskel.session import cut, read_table


#: The levels a case can have. Fixed values.
RISK_LEVELS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = read_table(spark, sf_dir, "review_decisions")
    named = reviews.select(
        tidy("case_id").alias("case_id"),
        F.lower(tidy("adjudicator_identity")).alias("adjudicator_identity"),
        tidy(F.col("decided_case.strata")["clinical_risk"]).alias("said"),
        "decided_at",
    )
    return consensus.prepared(named, "case_id", "adjudicator_identity", F.col("said"), F.col("decided_at"), RISK_LEVELS)


def found_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level for each case that three adjudicators gave a level."""
    votes = _votes(spark, sf_dir)
    judged = consensus.consensus(votes, "case_id", consensus.fit(votes, RISK_LEVELS))
    return judged.where("n_labels >= 3").select("case_id", F.col("level").alias("risk_level"))


def case_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, certainty, difficulty and agreement of every case with a level."""
    votes = _votes(spark, sf_dir)
    judged = consensus.consensus(votes, "case_id", consensus.fit(votes, RISK_LEVELS))
    rounded = [F.round(c, 6).alias(c) for c in ("probability", "easiness", "agreement")]
    return judged.select("case_id", F.col("level").alias("risk_level"), "n_labels", *rounded)


def adjudicator_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every adjudicator."""
    model = consensus.fit(_votes(spark, sf_dir), RISK_LEVELS)
    rounded = [F.round(c, 6).alias(c) for c in ("accuracy", "skill", "information")]
    return consensus.reliability(spark, model).select(F.col("annotator").alias("adjudicator_identity"), "n_labels", *rounded)


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    evidence = read_table(spark, sf_dir, "corpus_evidence")
    bared = copies.bare_rows(evidence.select("corpus_release_id", "evidence_id", "delivered_at", "content_exact", "content_search"), "content_exact", "bare_exact")
    # A column of its own: within a condition an expression that is used twice is also made twice.
    bared = bared.withColumn("bare_search", copies.bare(F.col("content_search")))
    print_of = F.when(~copies.is_blank(F.col("content_exact")), copies.fingerprint(F.col("bare_exact"), F.col("bare_search")))
    counting = latest_rows(
        bared,
        {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")},
        F.col("delivered_at"),
        {"text_print": print_of},
    )
    texts = counting.where(F.col("text_print").isNotNull())
    return copies.collapse(texts, ["corpus_release_id", "text_print"], "evidence_id", evidence.count())


def found_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy but the first with the kept evidence of its text."""
    pairs = _collapsed(spark, sf_dir)[1]
    return pairs.select("corpus_release_id", F.col("kept").alias("evidence_id"), F.col("copy").alias("copy_evidence_id"))


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kept evidence per text and the number of its copies."""
    groups = _collapsed(spark, sf_dir)[0]
    return groups.select("corpus_release_id", F.col("kept").alias("evidence_id"), F.col("n_copies"))


CONTEXT_TOKENS = 2048


def _sized(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, int]:
    docs = read_table(spark, sf_dir, "documents")
    return tokens.with_token_counts(docs.select("doc_id", *more, "text"), "text"), docs.count()


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of 2,048 tokens with the documents in each."""
    sized, rows = _sized(spark, sf_dir)
    packed = packing.pack_items(sized, "doc_id", "n_tokens", CONTEXT_TOKENS, rows)
    return packed.select(F.col("container_id").alias("context_id"), F.col("ids").alias("doc_ids"), "starts", "sizes", F.col("used").alias("used_tokens"), F.col("unused").alias("unused_tokens"))


def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of contexts, the least there could be, and the unused space."""
    packed = contexts(spark, sf_dir)
    sums = packed.agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("used_tokens").alias("n_tokens"), F.sum("unused_tokens").alias("unused_tokens"))
    least = F.ceil(F.col("n_tokens") / CONTEXT_TOKENS)
    return sums.select("n_contexts", least.alias("least_contexts"), "n_tokens", "unused_tokens", F.round(F.try_divide("unused_tokens", F.col("n_contexts") * CONTEXT_TOKENS), 6).alias("unused_share"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized, rows = _sized(spark, sf_dir, "source")
    named = cut(sized.select("doc_id", F.lower(tidy("source")).alias("source"), "n_tokens"))
    targets = read_table(spark, sf_dir, "mix_targets").select(F.lower(tidy("source")).alias("source"), "target_share", "max_repeats")
    rated = mixing.rates(named, targets)
    return mixing.draw(named, rated, rows), rated


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for the mixture with their repeats."""
    return _mixed(spark, sf_dir)[0]


def mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mixed(spark, sf_dir))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, subjects.Model]:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "subject_labels").select("doc_id", tidy("subject").alias("subject"))
    known = read_table(spark, sf_dir, "subjects").select(tidy("subject").alias("subject")).dropna().distinct().orderBy("subject")
    areas = [row["subject"] for row in known.collect()]  # the 12 rows of a fixed table
    features = subjects.featurise(docs, "doc_id", "text", labels, areas)
    return features, subjects.train(features, areas)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.areas_of(*_trained(spark, sf_dir), "doc_id")


def found_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each document."""
    return _areas(spark, sf_dir).select("doc_id", "subject")


def area_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each document with their share of its sentences."""
    return _areas(spark, sf_dir).select("doc_id", "subject", F.round("share", 6).alias("share"), "n_sentences", "n_about")


def area_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of the corpus by area; the row without a subject has those about no area.

    Sentences are all that are about the area, also where it is a minor one.
    """
    return subjects.make_up(*_trained(spark, sf_dir))


QUERIES = {
    "p2_found": found_levels,
    "p2_agreement": case_agreement,
    "p2_reliability": adjudicator_reliability,
    "p3_found": found_copies,
    "p3_texts": kept_texts,
    "p6_contexts": contexts,
    "p6_report": context_report,
    "p7_draws": draws,
    "p7_shares": mix_shares,
    "p8_found": found_areas,
    "p8_shares": area_shares,
    "p8_composition": area_make_up,
}


def _t(column: str) -> str:
    return f"nullif(upper(trim({column}, E' \\t\\n')), '')"


def _bare(text: str) -> str:
    return f"upper(array_to_string(regexp_extract_all({text}, '{copies.CONTENT}'), ''))"


_LINES = f"list_filter([{_bare('l')} FOR l IN regexp_split_to_array(content_exact, '{copies.LINE_BREAK}')], lambda l: l <> '')"
_TEXTS = f"""latest AS (
  SELECT {_t("corpus_release_id")} AS corpus_release_id, {_t("evidence_id")} AS evidence_id, content_exact, content_search
  FROM corpus_evidence
  QUALIFY row_number() OVER (PARTITION BY {_t("corpus_release_id")}, {_t("evidence_id")} ORDER BY delivered_at DESC) = 1),
lined AS (SELECT *, {_LINES} AS lines FROM latest WHERE regexp_matches(content_exact, '[^{copies.BLANK}]')),
texts AS (
  SELECT corpus_release_id, evidence_id,
         CASE WHEN len(lines) > 1 AND len(list_filter(lines, lambda l: NOT regexp_matches(l, '{copies.CELL}'))) = 0
              THEN array_to_string(list_sort(lines), '') ELSE {_bare("content_exact")} END AS exact,
         {_bare("content_search")} AS search
  FROM lined),
kept AS (
  SELECT *, min(evidence_id) OVER (PARTITION BY corpus_release_id, exact, search) AS first,
         count(*) OVER (PARTITION BY corpus_release_id, exact, search) AS n FROM texts)"""

SQL = {
    "p3_found": f"WITH {_TEXTS} SELECT corpus_release_id, first AS evidence_id, evidence_id AS copy_evidence_id FROM kept WHERE evidence_id <> first",
    "p3_texts": f"WITH {_TEXTS} SELECT corpus_release_id, evidence_id, n AS n_copies FROM kept WHERE evidence_id = first",
}

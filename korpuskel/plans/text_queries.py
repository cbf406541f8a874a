"""Queries on tokens, statistics, fingerprints, patterns and spreadsheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpuskel.functions import exact as E
from korpuskel.functions import text as X
from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.operators import registry as R
from korpuskel.session import read_table

HASH_SEED, HASH_DIMENSION = "korpuskel-terms", 1 << 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def term_counts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Occurrences of each token in each row; map-side combined, one shuffle."""
    return docs.select(ident, F.explode(X.tokens(F.col(text))).alias("term")).groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(_docs(spark, sf_dir), "doc_id", "text")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each token; a document's distinct tokens are made before the shuffle."""
    each = _docs(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus statistics of token counts; median and 95th percentile by nearest rank. Documents without tokens are left out.

    The exact percentiles come from the histogram of lengths, not from the rows: a
    running count over the distinct lengths, of which there are few.
    """
    sizes = _docs(spark, sf_dir).select(F.size(X.tokens(F.col("text"))).cast("long").alias("n")).where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("n"))
    ranked = sizes.select("n", "c", upto.alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), F.col("n")))

    return ranked.agg(
        F.sum("c").alias("n_documents"),
        F.sum(F.col("n") * F.col("c")).alias("total_length"),
        F.min("n").alias("min_length"),
        at(0.5).alias("median_length"),
        at(0.95).alias("p95_length"),
        F.max("n").alias("max_length"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean_length"),
    )


def hashed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed sparse vectors: colliding terms are summed."""
    indexed = term_frequency(spark, sf_dir).select("doc_id", X.term_index(F.col("term"), HASH_SEED, HASH_DIMENSION).alias("idx"), "tf")
    return indexed.groupBy("doc_id", "idx").agg(F.sum("tf").alias("weight"))


def search_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.search_view(text), 256).alias("view_sha256"), X.narrative_print(text).alias("narrative_sha256"), X.short_id("EV-", F.col("doc_id").cast("string"), F.lit("view")).alias("view_id"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates by case-folded search text: size and survivor (smallest id) of each group of two or more."""
    keyed = _docs(spark, sf_dir).where(F.col("text").isNotNull()).select(F.sha2(X.fold_case(X.search_view(F.col("text"))), 256).alias("text_sha256"), "doc_id")
    return keyed.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("survivor")).where("n_documents > 1")


def role_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that a passage's wording gives it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", text.rlike(X.THRESHOLD).alias("has_threshold"), text.rlike(X.EXCEPTION).alias("has_exception"), text.rlike(X.MONITORING).alias("has_monitoring"))


def topic_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that a passage's wording gives it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", *[text.rlike(p).alias(f"is_{n}") for n, p in X.TOPICS.items()])


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and certainty of the grades of texts that have one; ambiguous ones have none."""
    return _docs(spark, sf_dir).select("doc_id", X.grade(F.col("text")).alias("g")).where(F.col("g").isNotNull()).select("doc_id", "g.strength", "g.certainty")


def scope_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations, care settings and phrases of inclusion and exclusion that a text names, one a row."""
    made = _docs(spark, sf_dir).select("doc_id", X.scope(F.col("text")).alias("s"))
    kinds = ["population", "care_settings", "inclusion_criteria", "exclusion_criteria"]
    kind_of = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("label"))
    each = F.flatten(F.array(*[F.transform(F.col(f"s.{k}"), kind_of(k)) for k in kinds]))
    return made.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.kind", "x.label")


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of contact for each customer, with shapes that identify people and one that is a measurement."""
    number = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("For Maria Okonkwo, file "), F.substring("c_name", 10, 9), F.lit(", seen 2024-03-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(": write to "), F.lower("c_mktsegment"), F.lit("."), number, F.lit("@example.org or call +49 30 "), F.lpad(number, 7, "4"), F.lit("; viral load 1200000 copies/mL."))
    return read_table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


def identifier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in lines of contact, with their places."""
    each = _contacts(spark, sf_dir).select("c_custkey", F.explode(E.identifiers("line")).alias("i"))
    return each.select("c_custkey", "i.start", "i.stop", "i.kind", "i.found")


def identifiers_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("c_custkey", E.stripped("line").alias("line"))


def document_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in the documents by kind."""
    each = _docs(spark, sf_dir).select("doc_id", F.explode(E.identifiers("text")).alias("i"))
    return each.groupBy("doc_id", F.col("i.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_found"))


def exact_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As term_frequency, exact for all scripts and compatibility forms."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(E.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of each document's baseline words, loose tokens and conflict tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = {"baseline": X.baseline_words(text), "loose": F.array_sort(X.loose_tokens(text)), "conflict": F.array_sort(X.conflict_tokens(text))}
    made = _docs(spark, sf_dir).select("doc_id", *[v.alias(n) for n, v in lists.items()])
    return made.select("doc_id", *[c for n in lists for c in (F.size(n).alias(f"n_{n}"), F.sha2(F.array_join(n, " "), 256).alias(f"{n}_sha256"))])


def hashed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed dense baseline: signed words and half-weighted pairs of words in 384 positions, of unit length; positions that aren't 0.

    A text whose features cancel out has its fallback position only.
    """
    words = X.baseline_words(F.col("text"))
    made = _docs(spark, sf_dir).select("doc_id", words.alias("w")).where(F.size("w") > 0)
    one = F.transform("w", lambda w: F.struct(F.concat(F.lit("u:"), w).alias("f"), F.lit(1.0).alias("v")))
    pairs = F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda w, i: F.struct(F.concat(F.lit("b:"), w, F.lit("\x1f"), F.get("w", i + 1)).alias("f"), F.lit(0.5).alias("v")))
    rest = F.struct(F.concat(F.lit("fallback:"), F.get("w", F.lit(0))).alias("f"), F.lit(0.0).alias("v"))
    each = made.select("doc_id", F.explode(F.concat(one, pairs, F.array(rest))).alias("x")).select("doc_id", "x.*")
    at, sign = X.feature_hash(F.col("f"), 384)
    summed = each.select("doc_id", at.alias("idx"), (sign * F.col("v")).alias("v"), (F.col("v") == 0).alias("is_rest")).groupBy("doc_id", "idx").agg(F.sum("v").alias("v"), F.bool_or("is_rest").alias("is_rest"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    value = F.when(norm > 0, F.col("v") / norm).when(F.col("is_rest"), 1.0).otherwise(0.0)
    return summed.withColumn("value", F.round(value, 6)).where("value <> 0").select("doc_id", "idx", "value")


def query_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 characters of each text, back to a whole word."""
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", X.fragment(F.col("text"), 80).alias("fragment"))


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each question worth pointing at, in order."""
    cases = read_table(spark, sf_dir, "benchmark_cases").select("case_id", "question").distinct()
    return cases.select("case_id", F.array_join(X.question_terms(F.col("question")), " ").alias("terms")).distinct()


def marked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document with the words of a fixed question marked: how many of each kind, and whether they make up the text."""
    terms = X.question_terms(F.lit("Who should be monitored during treatment and screening for adverse effects?"))
    made = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", E.marked("text", terms, F.lit("review")).alias("m"))
    count = lambda kind: F.size(F.filter("m", lambda x: x["kind"] == kind))
    return made.select("doc_id", count("term").alias("n_terms"), count("find").alias("n_finds"), (F.array_join("m.piece", "") == F.col("text")).alias("is_whole"))


def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic codes of the cases as words, with their number of cases."""
    each = read_table(spark, sf_dir, "benchmark_cases").select("case_id", F.explode("safety_topics").alias("code")).distinct()
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("n_cases")).withColumn("label", X.humanised(F.col("code")))


def json_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the depth of their payload."""
    rows = read_table(spark, sf_dir, "raw_records").select("record_id", X.json_depth(F.col("payload")).alias("depth")).distinct()
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n_records"))


POINT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # of names that are addresses, from the standard


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs of the source versions."""
    return read_table(spark, sf_dir, "source_versions").select("source_version_id", X.point_id(POINT_NAMESPACE, F.col("source_version_id")).alias("point_id"))


def resolved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges like 1.2.x resolved to the highest patch among the versions that documents mention, exact versions to themselves; null if there is none.

    Versions are made of the parts of an order: priority, month and day. Pre-releases don't count.
    """
    orders = read_table(spark, sf_dir, "orders")
    made = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("."), F.month("o_orderdate").cast("string"), F.lit("."), F.dayofmonth("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "-rc1").otherwise(""))
    known = orders.select(made.alias("version")).distinct()
    specs = orders.where("o_orderkey % 3 = 0").select(F.regexp_replace(F.regexp_replace(made, "-rc1$", ""), r"\d+$", "x").alias("spec")).distinct().unionByName(known.select(F.col("version").alias("spec"))).unionByName(spark.range(1).select(F.lit("9.9.x").alias("spec")))
    return R.resolve_versions(specs, known).select("spec", "version")


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the table cells that evidence is anchored to, with the number of anchors."""
    each = read_table(spark, sf_dir, "corpus_evidence").select(F.explode("anchors").alias("a")).where("a.kind = 'TABLE_CELL'")
    label = X.cell_label(F.col("a.table_id"), F.col("a.row_index"), F.col("a.column_index"))
    return each.groupBy(label.alias("cell")).agg(F.count(F.lit(1)).alias("n_anchors"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of anchors by release and by whether they are parts of the page: all four numbers within 0 and 1."""
    each = read_table(spark, sf_dir, "corpus_evidence").select("corpus_release_id", F.explode("anchors.bbox").alias("box")).where(F.size("box") == 4)
    part = F.forall("box", lambda v: F.coalesce(v.between(0, 1), F.lit(False)))
    return each.groupBy("corpus_release_id", F.when(part, "PROPORTIONAL").otherwise("UNPLACEABLE").alias("placement")).agg(F.count(F.lit(1)).alias("n_boxes"))


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the documents state outright, of those that state any."""
    made = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", X.stated_facts(F.col("text")).alias("f"))
    flat = made.select("doc_id", "f.age", F.array_join("f.conditions", ",").alias("conditions"), "f.egfr", "f.crcl", "f.renal_impairment", "f.topic", "f.question_type", F.array_join("f.inferred", ",").alias("inferred"))
    return flat.where("age IS NOT NULL OR conditions <> '' OR egfr IS NOT NULL OR crcl IS NOT NULL OR topic IS NOT NULL")


def vector_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", E.vector_digest("embedding").alias("sha256"))


#: Order in which assets of a source are preferred. Fixed values.
ASSET_ORDER = ["MAIN", "ANNEX_B", "ANNEX_C", "ANNEX_A", "ANNEX_D"]


def duplicate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a release with the same search text in folded case: the one that stays, and how many it stands for.

    Approved goes before not approved, then the order of assets, the source
    version, the id.
    """
    rows = latest_rows(
        read_table(spark, sf_dir, "corpus_evidence"),
        {"corpus_release_id": tidy("corpus_release_id"), "evidence_id": tidy("evidence_id")},
        F.col("delivered_at"),
        {"text_sha256": F.sha2(X.fold_case(F.col("content_search")), 256), "unit": F.lower(tidy("source_version_id")), "approved": F.col("verification.approval_status") == "APPROVED"},
    )
    place = F.array_position(F.array(*[F.lit(a) for a in ASSET_ORDER]), F.upper(F.element_at(F.split("unit", ":"), -1)))
    priority = F.when(place > 0, place).otherwise(10)
    order = F.struct((~F.coalesce("approved", F.lit(False))).alias("a"), F.coalesce(priority, F.lit(10)).alias("b"), F.coalesce("unit", F.lit("")).alias("c"), F.col("evidence_id").alias("id"))
    best = rows.where("text_sha256 IS NOT NULL").groupBy("corpus_release_id", "text_sha256").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n_evidence"))
    return best.where("n_evidence > 1").select("corpus_release_id", F.col("m.id").alias("evidence_id"), "n_evidence")


def numeral_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a case's question that none of its gold evidence holds; counting rows, ids compared without letter case and outer blanks."""
    release = tidy("corpus_release_id")
    cases = latest_rows(read_table(spark, sf_dir, "benchmark_cases"), {"case_id": tidy("case_id")}, F.col("created_at"), {"corpus_release_id": release, "question": F.col("question"), "ids": F.transform("gold_evidence.evidence_id", tidy)})
    asked = cases.where(F.col("question").isNotNull()).select("case_id", "corpus_release_id", "ids", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(X.NUMERAL), F.lit(0)))).alias("numeral"))
    cited = asked.select("case_id", "corpus_release_id", "numeral", F.explode_outer("ids").alias("evidence_id")).distinct()
    held = latest_rows(read_table(spark, sf_dir, "corpus_evidence"), {"corpus_release_id": release, "evidence_id": tidy("evidence_id")}, F.col("delivered_at"), {"held": F.regexp_extract_all("content_exact", F.lit(X.NUMERAL), F.lit(0))})
    found = F.max(F.coalesce(F.array_contains("held", F.col("numeral")), F.lit(False)))
    seen = cited.join(held, ["corpus_release_id", "evidence_id"], "left").groupBy("case_id", "numeral").agg(found.alias("found"))
    return seen.where(~F.col("found")).select("case_id", "numeral")


def _cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "corpus_evidence").select("corpus_release_id", "evidence_id", "content_exact").distinct()
    return rows.select("corpus_release_id", "evidence_id", "content_exact", X.cells(F.col("content_exact")).alias("cells")).where(F.size("cells") > 0)


def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of evidence written as spreadsheet rows."""
    each = _cell_rows(spark, sf_dir).select("corpus_release_id", "evidence_id", F.explode("cells").alias("c"))
    return each.select("corpus_release_id", "evidence_id", F.col("c.column").alias("col"), X.column_ordinal(F.col("c.column")).alias("col_no"), F.col("c.row").cast("int").alias("row_no"), F.col("c.value").alias("value")).distinct()


def row_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of spreadsheet rows and the number of evidence ids that share each."""
    prints = _cell_rows(spark, sf_dir).select("corpus_release_id", "evidence_id", X.row_print(F.col("cells")).alias("row_sha256")).distinct()
    return prints.groupBy("row_sha256").agg(F.count_distinct("evidence_id").alias("n_evidence"))


_LISTED = [
    term_frequency, document_frequency, length_statistics, hashed_vector, search_views, duplicate_groups, duplicate_survivors, role_patterns, topic_patterns, grades, scope_labels,
    identifier_spans, identifiers_removed, document_identifiers, exact_term_frequency, token_sets, hashed_dense, query_fragments, question_terms, marked_questions, code_labels,
    json_depths, point_ids, resolved_versions, cell_labels, placements, stated_facts, vector_digests, numeral_screen, spreadsheet_cells, row_prints,
]
QUERIES = {f.__name__: f for f in _LISTED}

_FOLD = "replace(lower({0}), 'ß', 'ss')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _tokens(text: str) -> str:
    return f"flatten([CASE WHEN strip_accents(w) <> w THEN [w, strip_accents(w)] ELSE [w] END FOR w IN regexp_extract_all({_FOLD.format(text)}, {_q(X.WORD)})])"


_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL"
_VIEW = "trim(regexp_replace({0}, '" + X.WHITE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), ' ')"
_PRESENT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_SWAP = "concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))"


def _found(pattern: str) -> str:
    return f"list_distinct([lower(x) FOR x IN regexp_extract_all(text, {_q(pattern)}, 1)])"


_STRIP = "' ' || chr(9) || chr(10) || chr(13)"
def _loose(least: int) -> str:
    return f"list_distinct([{_FOLD.format('x')} FOR x IN regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_+.-]+') IF length(x) >= {least}])"


_BASELINE = f"regexp_extract_all({_FOLD.format('text')}, {_q(X.BASELINE)})"
_SQUEEZED = f"regexp_replace({_FOLD.format('text')}, '[ \\t\\n\\x0B\\f\\r]', '', 'g')"
_WORDS = f"CASE WHEN len({_BASELINE}) > 0 THEN {_BASELINE} WHEN {_SQUEEZED} <> '' THEN [{_SQUEEZED}] ELSE [] END"
_HEX8 = "concat(" + ", ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + ")"
_INCLUSION = X.INCLUSION.replace("(?=(?:", "(?:(?:")
_EXCLUSION = r"(?i)\b(?:contraindicated (?:for|in)|not eligible (?:for|if)?)\s+.[^.;]{0,139}(?:[.;]|$)"
_LABELS = " UNION ALL ".join(
    [f"SELECT doc_id, {_q(kind)} AS kind, {_q(n)} AS label FROM v WHERE regexp_matches(t, {_q(p)})" for kind, patterns in (("population", X.POPULATIONS), ("care_settings", X.CARE_SETTINGS)) for n, p in patterns.items()]
    + [f"SELECT DISTINCT doc_id, 'inclusion_criteria', 'Required if ' || trim(unnest(regexp_extract_all(t, {_q(_INCLUSION)}, 1))) FROM v", f"SELECT DISTINCT doc_id, 'exclusion_criteria', trim(rtrim(unnest(regexp_extract_all(t, {_q(_EXCLUSION)})), '.;')) FROM v"]
)
_LINE = "'For Maria Okonkwo, file ' || substr(c_name, 10, 9) || ', seen 2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || ': write to ' || lower(c_mktsegment) || '.' || c_custkey || '@example.org or call +49 30 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '4') || '; viral load 1200000 copies/mL.'"
_CELLS = """rows AS (SELECT DISTINCT corpus_release_id, evidence_id, content_exact FROM corpus_evidence WHERE regexp_matches(content_exact, '^[A-Z]{1,3}[0-9]+=')),
lines AS (SELECT corpus_release_id, evidence_id, content_exact, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(content_exact, chr(10)) AS l FROM rows)),
parsed AS (SELECT *, regexp_extract(line, '^([A-Z]{1,3})[0-9]+=', 1) AS col, regexp_extract(line, '^[A-Z]{1,3}([0-9]+)=', 1) AS row_no, regexp_extract(content_exact, '^[A-Z]{1,3}([0-9]+)=', 1) AS own_row FROM lines),
numbered AS (SELECT *, CASE WHEN col <> '' AND row_no = own_row THEN list_sum([(ascii(substr(col, k, 1)) - 64) * CAST(26 ** (length(col) - k) AS BIGINT) FOR k IN range(1, length(col) + 1)]) END AS n FROM parsed),
opened AS (SELECT *, n IS NOT NULL AND n > coalesce(max(n) OVER w, 0) AS opens FROM numbered WINDOW w AS (PARTITION BY corpus_release_id, evidence_id, content_exact ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
owned AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY corpus_release_id, evidence_id, content_exact ORDER BY i) AS cell FROM opened),
cells AS (
  SELECT corpus_release_id, evidence_id, content_exact, cell, max(col) FILTER (opens) AS col, max(n) FILTER (opens) AS n, max(row_no) FILTER (opens) AS row_no,
    string_agg(CASE WHEN opens THEN substr(line, length(col) + length(row_no) + 2) ELSE line END, chr(10) ORDER BY i) AS value
  FROM owned GROUP BY corpus_release_id, evidence_id, content_exact, cell)"""


SQL = {
    "term_frequency": _TF,
    "document_frequency": f"SELECT term, count(*) AS df FROM ({_TF}) GROUP BY term",
    "length_statistics": f"SELECT count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS total_length, min(n) AS min_length, quantile_disc(n, 0.5) AS median_length, quantile_disc(n, 0.95) AS p95_length, max(n) AS max_length, round(avg(n), 6) AS mean_length FROM (SELECT len({_tokens('text')}) AS n FROM documents) WHERE n > 0",
    "hashed_vector": f"SELECT doc_id, idx, CAST(sum(tf) AS BIGINT) AS weight FROM (SELECT doc_id, tf, CAST(('0x' || {_SWAP}) AS BIGINT) % {HASH_DIMENSION} AS idx FROM (SELECT doc_id, tf, sha256('{HASH_SEED}' || chr(0) || term) AS h FROM ({_TF}))) GROUP BY ALL",
    "search_views": f"SELECT doc_id, sha256({_VIEW.format('text')}) AS view_sha256, sha256({_FOLD.format(_PRESENT.format('text'))} || chr(31)) AS narrative_sha256, 'EV-' || substr(sha256(doc_id || '|view'), 1, 32) AS view_id FROM documents",
    "duplicate_groups": f"SELECT sha256({_FOLD.format(_VIEW.format('text'))}) AS text_sha256, count(*) AS n_documents, min(doc_id) AS survivor FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_survivors": f"""WITH r AS (SELECT nullif(upper(trim(corpus_release_id, E' \\t\\n')), '') AS corpus_release_id, nullif(upper(trim(evidence_id, E' \\t\\n')), '') AS evidence_id, {_FOLD.format('content_search')} AS t, lower(nullif(upper(trim(source_version_id, E' \\t\\n')), '')) AS unit, coalesce(verification.approval_status = 'APPROVED', false) AS ok
  FROM corpus_evidence QUALIFY row_number() OVER (PARTITION BY nullif(upper(trim(corpus_release_id, E' \\t\\n')), ''), nullif(upper(trim(evidence_id, E' \\t\\n')), '') ORDER BY delivered_at DESC) = 1)
SELECT corpus_release_id, evidence_id, n AS n_evidence FROM (SELECT *, count(*) OVER (PARTITION BY corpus_release_id, t) AS n FROM r WHERE t IS NOT NULL AND corpus_release_id IS NOT NULL AND evidence_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY corpus_release_id, t ORDER BY NOT ok, coalesce(list_position({ASSET_ORDER}, upper(string_split(unit, ':')[-1])), 10), coalesce(unit, ''), evidence_id) = 1) WHERE n > 1""",
    "role_patterns": "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), {_q(p)}) AS has_{n}" for n, p in (("threshold", X.THRESHOLD), ("exception", X.EXCEPTION), ("monitoring", X.MONITORING))) + " FROM documents",
    "topic_patterns": "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), {_q(p)}) AS is_{n}" for n, p in X.TOPICS.items()) + " FROM documents",
    "grades": f"SELECT doc_id, s[1] AS strength, c[1] AS certainty FROM (SELECT doc_id, {_found(X.STRENGTH)} AS s, {_found(X.CERTAINTY)} AS c FROM documents) WHERE len(s) <= 1 AND len(c) <= 1 AND len(s) + len(c) > 0",
    "scope_labels": f"WITH v AS (SELECT doc_id, {_VIEW.format('text')} AS t FROM documents WHERE text IS NOT NULL) {_LABELS}",
    "identifier_spans": f"""WITH l AS (SELECT c_custkey, {_LINE} AS line FROM customer), f AS (
  SELECT c_custkey, line, 'name' AS kind, 'Maria Okonkwo' AS found FROM l
  UNION ALL SELECT c_custkey, line, 'record-number', regexp_extract(line, 'file ([0-9]+)', 1) FROM l
  UNION ALL SELECT c_custkey, line, 'date', regexp_extract(line, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') FROM l
  UNION ALL SELECT c_custkey, line, 'email', regexp_extract(line, '[a-z.0-9]+@example.org') FROM l
  UNION ALL SELECT c_custkey, line, 'record-number', lpad(CAST(c_custkey AS VARCHAR), 7, '4') FROM l)
SELECT c_custkey, CAST(p - 1 AS INTEGER) AS start, CAST(p - 1 + length(found) AS INTEGER) AS stop, kind, found FROM (SELECT *, CASE WHEN found = lpad(CAST(c_custkey AS VARCHAR), 7, '4') THEN instr(line, '30 ' || found) + 3 ELSE instr(line, found) END AS p FROM f)""",
    "identifiers_removed": f"SELECT c_custkey, 'For, file, seen: write to or call +49 30; viral load 1200000 copies/mL.' AS line FROM (SELECT c_custkey, {_LINE} AS line FROM customer)",
    "exact_term_frequency": _TF,
    "token_sets": f"""WITH t AS (SELECT doc_id, {_WORDS.replace('text', "coalesce(text, '')")} AS b, list_sort({_loose(3)}) AS l, list_sort([x FOR x IN {_loose(4)} IF NOT regexp_matches(x, '^\\p{{Nd}}+$') AND NOT list_contains({X.CONFLICT_STOPWORDS}, x)]) AS c FROM documents)
SELECT doc_id, {", ".join(f"CAST(len({v}) AS INTEGER) AS n_{n}, sha256(coalesce(array_to_string({v}, ' '), '')) AS {n}_sha256" for n, v in (("baseline", "b"), ("loose", "l"), ("conflict", "c")))} FROM t""",
    "hashed_dense": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, 'u:' || unnest(w) AS f, 1.0 AS v FROM w UNION ALL SELECT doc_id, 'b:' || unnest([w[i] || chr(31) || w[i + 1] FOR i IN range(1, len(w))]), 0.5 FROM w),
h AS (SELECT doc_id, v, sha256(f) AS h FROM f),
s AS (SELECT doc_id, CAST(CAST(('0x' || {_HEX8}) AS UBIGINT) % 384 AS INTEGER) AS idx, sum(CASE WHEN substr(h, 18, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -v ELSE v END)::DOUBLE AS v FROM h GROUP BY ALL)
SELECT doc_id, idx, value FROM (SELECT doc_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s) WHERE value <> 0""",
    "query_fragments": f"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN contains(c, ' ') AND regexp_replace(c, ' [^ ]*$', '') <> '' THEN regexp_replace(c, ' [^ ]*$', '') ELSE c END AS fragment FROM (SELECT doc_id, t, substr(t, 1, 80) AS c FROM (SELECT doc_id, {_VIEW.format('text')} AS t FROM documents WHERE text IS NOT NULL))",
    "question_terms": f"""WITH w AS (SELECT DISTINCT case_id, question, [regexp_replace(x, '^-+|-+$', '', 'g') FOR x IN regexp_split_to_array(lower(coalesce(question, '')), '[^\\p{{L}}\\p{{N}}-]+')] AS w FROM benchmark_cases),
k AS (SELECT case_id, [CASE WHEN length(regexp_replace(x, '{X.ENDING}', '')) >= {X.SHORTEST_STEM} THEN regexp_replace(x, '{X.ENDING}', '') ELSE x END FOR x IN w IF length(x) >= {X.SHORTEST_TERM} AND NOT list_contains({X.TERM_STOPWORDS}, x)] AS s FROM w)
SELECT DISTINCT case_id, coalesce(array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i)[1:{X.MOST_TERMS}], ' '), '') AS terms FROM k""",
    "code_labels": "SELECT code, count(*) AS n_cases, upper(substr(code, 1, 1)) || lower(replace(substr(code, 2), '_', ' ')) AS label FROM (SELECT DISTINCT case_id, unnest(safety_topics) AS code FROM benchmark_cases) GROUP BY code",
    "json_depths": r"""WITH m AS (SELECT DISTINCT record_id, payload, regexp_replace(regexp_replace(payload, '"(?:[^"\\]|\\.)*"', '', 'g'), '[^\[\]{}]+', '', 'g') AS m FROM raw_records),
c AS (SELECT record_id, payload, i, sum(CASE WHEN substr(m, i, 1) IN ('[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY record_id, payload ORDER BY i) AS d FROM (SELECT record_id, payload, m, unnest(range(1, length(m) + 1)) AS i FROM m)),
d AS (SELECT m.record_id, m.payload, CASE WHEN m.payload IS NULL THEN NULL ELSE greatest(0, coalesce(max(c.d), 0)) END AS depth FROM m LEFT JOIN c ON c.record_id = m.record_id AND c.payload = m.payload GROUP BY m.record_id, m.payload)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n_records FROM (SELECT DISTINCT record_id, depth FROM d) GROUP BY depth""",
    "resolved_versions": r"""WITH v AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) || '.' || month(o_orderdate) || '.' || day(o_orderdate) || CASE WHEN o_orderkey % 7 = 0 THEN '-rc1' ELSE '' END AS version FROM orders),
s AS (SELECT DISTINCT regexp_replace(substr(o_orderpriority, 1, 1) || '.' || month(o_orderdate) || '.' || day(o_orderdate), '\d+$', 'x') AS spec FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT version FROM v UNION ALL SELECT '9.9.x')
SELECT spec, CASE WHEN spec LIKE '%.x' THEN (SELECT arg_max(version, CAST(split_part(version, '.', 3) AS INTEGER)) FROM v WHERE version NOT LIKE '%-%' AND regexp_replace(version, '\d+$', 'x') = spec) WHEN spec LIKE '%-%' THEN NULL ELSE spec END AS version FROM s""",
    "cell_labels": "SELECT a.table_id || '!' || CASE WHEN a.column_index < 26 THEN chr(CAST(65 + a.column_index AS INTEGER)) ELSE chr(CAST(64 + a.column_index // 26 AS INTEGER)) || chr(CAST(65 + a.column_index % 26 AS INTEGER)) END || (a.row_index + 1) AS cell, count(*) AS n_anchors FROM (SELECT unnest(anchors) AS a FROM corpus_evidence) WHERE a.kind = 'TABLE_CELL' GROUP BY 1",
    "placements": "SELECT corpus_release_id, CASE WHEN len([v FOR v IN b IF v BETWEEN 0 AND 1]) = 4 THEN 'PROPORTIONAL' ELSE 'UNPLACEABLE' END AS placement, count(*) AS n_boxes FROM (SELECT corpus_release_id, unnest(anchors).bbox AS b FROM corpus_evidence) WHERE len(b) = 4 GROUP BY ALL",
    "point_ids": f"SELECT source_version_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT source_version_id, sha1(unhex('{POINT_NAMESPACE.replace('-', '')}') || encode(source_version_id)) AS h FROM source_versions)",
    "stated_facts": f"""WITH n AS (SELECT doc_id, text AS t, TRY_CAST(nullif(regexp_extract(text, {_q(X.AGE)}, 1), '') AS INTEGER) AS age, {", ".join(f"TRY_CAST(nullif(regexp_extract(text, {_q(p)}, 1), '') AS DOUBLE) AS {m.lower()}" for m, p in X.MEASUREMENTS.items())},
  array_to_string(list_sort([c FOR c IN [{", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN '{c}' END" for c, p in X.CONDITIONS.items())}] IF c IS NOT NULL]), ',') AS conditions, CASE WHEN contains(lower(text), 'anticoag') THEN 'anticoagulation' END AS topic FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, egfr IS NOT NULL OR crcl IS NOT NULL OR contains(conditions, 'CHRONIC') AS renal_impairment FROM n)
SELECT doc_id, age, coalesce(conditions, '') AS conditions, egfr, crcl, renal_impairment, topic, CASE WHEN topic IS NULL THEN 'guideline_lookup' ELSE 'treatment_guideline' END AS question_type,
  CASE WHEN renal_impairment THEN 'special_populations,' ELSE '' END || CASE WHEN topic IS NOT NULL THEN 'topic,' ELSE '' END || 'question_type' AS inferred
FROM r WHERE age IS NOT NULL OR coalesce(conditions, '') <> '' OR egfr IS NOT NULL OR crcl IS NOT NULL OR topic IS NOT NULL""",
    "spreadsheet_cells": f"WITH {_CELLS} SELECT DISTINCT corpus_release_id, evidence_id, col, CAST(n AS INTEGER) AS col_no, CAST(row_no AS INTEGER) AS row_no, value FROM cells",
    "row_prints": f"""WITH {_CELLS}, p AS (SELECT corpus_release_id, evidence_id, content_exact, sha256(string_agg(col || '=' || {_FOLD.format(_PRESENT.format('value'))} || chr(31), '' ORDER BY cell)) AS row_sha256 FROM cells GROUP BY ALL)
SELECT row_sha256, count(DISTINCT evidence_id) AS n_evidence FROM p GROUP BY row_sha256""",
    "numeral_screen": f"""WITH cases AS (SELECT nullif(upper(trim(case_id, E' \\t\\n')), '') AS c, nullif(upper(trim(corpus_release_id, E' \\t\\n')), '') AS r, question, [nullif(upper(trim(g.evidence_id, E' \\t\\n')), '') FOR g IN gold_evidence] AS ids FROM benchmark_cases QUALIFY row_number() OVER (PARTITION BY c ORDER BY created_at DESC) = 1),
ev AS (SELECT nullif(upper(trim(corpus_release_id, E' \\t\\n')), '') AS r, nullif(upper(trim(evidence_id, E' \\t\\n')), '') AS id, content_exact FROM corpus_evidence QUALIFY row_number() OVER (PARTITION BY r, id ORDER BY delivered_at DESC) = 1),
asked AS (SELECT c, r, ids, unnest(list_distinct(regexp_extract_all(question, '{X.NUMERAL}'))) AS numeral FROM cases WHERE c IS NOT NULL),
cited AS (SELECT c, r, numeral, unnest(CASE WHEN len(ids) > 0 THEN ids ELSE [NULL] END) AS id FROM asked)
SELECT c AS case_id, numeral FROM cited LEFT JOIN ev USING (r, id)
GROUP BY c, numeral HAVING NOT bool_or(coalesce(list_contains(regexp_extract_all(content_exact, '{X.NUMERAL}'), numeral), false))""",
}

"""Queries on orphan references, snapshot changes and nested records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuskel.functions.keys import latest_rows, ordinals, tidy
from korpuskel.operators import nested, orphans, snapshots
from korpuskel.session import read_table


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals(read_table(spark, sf_dir, "corpus_releases"), tidy("corpus_release_id"), F.col("cutoff_at"), "cutoff_at")


def _with_ordinal(rows: DataFrame, releases: DataFrame) -> DataFrame:
    return rows.join(releases.select(F.col("period").alias("release"), "ordinal"), "release")


REFERENCE = ["src_table", "corpus_release_id", "src_key", "ref_field", "ref_value"]


def found_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orphan references of the manifest, the benchmark cases and the evidence."""
    releases = _releases(spark, sf_dir)
    evidence = read_table(spark, sf_dir, "corpus_evidence")
    manifest = read_table(spark, sf_dir, "release_manifest")
    cases = read_table(spark, sf_dir, "benchmark_cases")
    versions = read_table(spark, sf_dir, "source_versions")

    held = _with_ordinal(evidence.select(tidy("corpus_release_id").alias("release"), tidy("evidence_id").alias("parent_key")), releases)
    listed = manifest.select(
        F.lit("release_manifest").alias("src_table"),
        tidy("corpus_release_id").alias("release"),
        tidy("evidence_id").alias("src_key"),
        F.lit("evidence_id").alias("ref_field"),
        tidy("evidence_id").alias("ref_value"),
    )
    gold = cases.select("corpus_release_id", "case_id", F.explode("gold_evidence.evidence_id").alias("gold_id")).select(
        F.lit("benchmark_cases").alias("src_table"),
        tidy("corpus_release_id").alias("release"),
        tidy("case_id").alias("src_key"),
        F.lit("gold_evidence.evidence_id").alias("ref_field"),
        tidy("gold_id").alias("ref_value"),
    )
    of_evidence = orphans.snapshot_orphans(
        _with_ordinal(listed.unionByName(gold), releases), held.select("parent_key", F.col("ordinal").alias("parent_ordinal")), evidence.count()
    )

    counting = latest_rows(
        evidence,
        {"release": tidy("corpus_release_id"), "src_key": tidy("evidence_id")},
        F.col("delivered_at"),
        {"ref_value": tidy("source_version_id")},
    )
    in_time = counting.join(releases.select(F.col("period").alias("release"), F.col("cutoff_at").alias("at")), "release")
    sourced = in_time.select(F.lit("corpus_evidence").alias("src_table"), "release", "src_key", F.lit("source_version_id").alias("ref_field"), "ref_value", "at")
    registry = versions.select(tidy("source_version_id").alias("parent_key"), "registered_at", "deleted_at")
    of_sources = orphans.registry_orphans(sourced, registry, versions.count())

    both = of_evidence.drop("ordinal").unionByName(of_sources.drop("at")).withColumnRenamed("release", "corpus_release_id")
    return both.select(*REFERENCE, "orphan_kind").distinct()


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, release and kind."""
    return orphans.orphan_report(found_orphans(spark, sf_dir), "src_table", "ref_field", "corpus_release_id", "orphan_kind")


def found_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence added, removed or changed in each release but the first."""
    releases = _releases(spark, sf_dir)
    evidence = read_table(spark, sf_dir, "corpus_evidence")
    rows = evidence.select(tidy("corpus_release_id").alias("release"), tidy("evidence_id").alias("evidence_id"), "content_exact", "delivered_at")
    changes = snapshots.snapshot_changes(
        _with_ordinal(rows, releases), releases, "evidence_id", "ordinal", F.col("delivered_at"), F.col("content_exact")
    )
    named = releases.select("ordinal", F.col("period").alias("corpus_release_id"))
    return changes.join(named, "ordinal").select("corpus_release_id", "evidence_id", "change_kind")


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per release and kind."""
    return found_changes(spark, sf_dir).groupBy("corpus_release_id", "change_kind").agg(F.count(F.lit(1)).alias("n_ids"))


ASSETS, ASSET_ANCHORS, ANCHORS, CHECKS = "content.assets", "content.assets.anchors", "content.anchors", "verification.checks"
FINDINGS = "verification.checks.details.findings"
#: Lists even where a lone object stands for a list of one, and the parts that may be JSON text.
LISTS, EMBEDDED = [ASSETS, ASSET_ANCHORS, ANCHORS, CHECKS, FINDINGS], ["content", "verification"]
#: Entity, list and the field that is its value.
ENTITIES = [("asset", ASSETS, "asset_id"), ("anchor", ANCHORS, "kind"), ("anchor", ASSET_ANCHORS, "kind"), ("check", CHECKS, "invariant")]
ANCHOR_TEXTS = ["kind", "source_uri", "printed_page", "dom_selector", "xpath", "fhir_resource_type", "fhir_resource_id", "fhir_path", "table_id"]
ANCHOR_NUMBERS = ["char_start", "char_end", "pdf_page", "row_index", "column_index"]


def _nodes(spark: SparkSession, sf_dir: str, keep: dict[str, list[str] | None] | None = None) -> DataFrame:
    raw = read_table(spark, sf_dir, "raw_records")
    return nested.flatten(raw, "record_id", "payload", LISTS, EMBEDDED, keep)


def _path() -> Column:
    """Path of an element, by which its children name it."""
    return F.concat("parent_path", F.lit("."), F.element_at(F.split("list_path", r"\."), -1), F.lit("["), "node_pos", F.lit("]"))


def _field(path: str) -> Column:
    return F.col("fields")[path]


def found_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List elements with a value, by entity."""
    entity, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, path, field in ENTITIES:
        entity = F.when(F.col("list_path") == path, name).otherwise(entity)
        value = F.when(F.col("list_path") == path, _field(field)).otherwise(value)
    nodes = _nodes(spark, sf_dir, {path: [field] for _, path, field in ENTITIES})
    valued = nodes.select("record_id", entity.alias("entity"), "parent_path", "node_pos", value.alias("node_value"))
    return valued.where(F.col("record_id").isNotNull() & F.col("node_value").isNotNull()).distinct()


def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records themselves: what lies under no list."""
    fields = {"schema_version": "content", "source_version_id": "content", "title": "content", "content_exact": "content", "approval_status": "verification"}
    nodes = _nodes(spark, sf_dir, {nested.ROOT: [f"{part}.{name}" for name, part in fields.items()]})
    return nodes.select("record_id", *[_field(f"{part}.{name}").alias(name) for name, part in fields.items()])


def asset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with their licensing."""
    fields = {c: c for c in ("asset_id", "authority_role", "experimental")} | {
        "license_id": "licensing.license_id",
        "render_allowed": "licensing.render_allowed",
        "license_notes": "licensing.notes",
    }
    nodes = _nodes(spark, sf_dir, {ASSETS: [*fields.values()]})
    return nodes.select("record_id", "parent_path", "node_pos", _path().alias("node_path"), *[_field(path).alias(name) for name, path in fields.items()])


def anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of contents and of assets; parent_path is the node_path of the asset. bbox has its numbers as they are written, joined by commas."""
    names = [*ANCHOR_TEXTS, *ANCHOR_NUMBERS, "bbox", "bbox[]"]
    nodes = _nodes(spark, sf_dir, {ANCHORS: names, ASSET_ANCHORS: names})
    typed = [_field(c).alias(c) for c in ANCHOR_TEXTS] + [_field(c).try_cast("int").alias(c) for c in ANCHOR_NUMBERS]
    return nodes.select("record_id", "parent_path", "node_pos", _path().alias("node_path"), *typed, F.array_join(nested.items("bbox"), ",", "null").alias("bbox"))


def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the anchors' boxes, one a row: a list of scalars as a child table."""
    nodes = _nodes(spark, sf_dir, {ANCHORS: ["bbox", "bbox[]"], ASSET_ANCHORS: ["bbox", "bbox[]"]})
    each = nodes.select("record_id", _path().alias("node_path"), F.posexplode(nested.items("bbox")).alias("item_pos", "value"))
    return each.select("record_id", "node_path", "item_pos", F.col("value").try_cast("double").alias("value"))


def check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification checks; details has all scalars below them by path, as a JSON object."""
    nodes = _nodes(spark, sf_dir, {CHECKS: None})
    fields = [_field(c).alias(c) for c in ("invariant", "outcome", "verifier", "evidence_digest")]
    details = F.transform_keys(F.map_filter("fields", lambda k, _: k.startswith("details.")), lambda k, _: F.substring(k, 9, 1 << 30))
    return nodes.select("record_id", "parent_path", "node_pos", _path().alias("node_path"), *fields, F.to_json(details).alias("details"))


def finding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the checks with their notes, joined by |; parent_path begins with the node_path of the check."""
    nodes = _nodes(spark, sf_dir, {FINDINGS: None})
    return nodes.select("record_id", "parent_path", "node_pos", _field("field").alias("field"), F.array_join(nested.items("notes"), "|", "null").alias("notes"))


def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the records by its repeated ancestor, with the number of its values and of the rows that have any."""
    return nested.path_report(_nodes(spark, sf_dir))


QUERIES = {
    "p1_found": found_orphans,
    "p1_report": orphan_counts,
    "p4_found": found_changes,
    "p4_report": change_counts,
    "p5_found": found_nodes,
    "p5_records": record_table,
    "p5_assets": asset_table,
    "p5_anchors": anchor_table,
    "p5_checks": check_table,
    "p5_findings": finding_table,
    "p5_boxes": box_table,
    "p5_paths": record_paths,
}

_TIDY = "nullif(upper(trim({0}, E' \\t\\n')), '')"


def _t(column: str) -> str:
    return _TIDY.format(column)


_RELEASES_SQL = f"""rel AS (
  SELECT {_t("corpus_release_id")} AS release, cutoff_at,
         row_number() OVER (ORDER BY cutoff_at, corpus_release_id) - 1 AS ordinal
  FROM corpus_releases)"""

_P1_SQL = f"""WITH {_RELEASES_SQL},
held AS (SELECT DISTINCT r.ordinal, {_t("evidence_id")} AS id FROM corpus_evidence e JOIN rel r ON r.release = {_t("e.corpus_release_id")}),
refs AS (
  SELECT 'release_manifest' AS src_table, {_t("corpus_release_id")} AS release, {_t("evidence_id")} AS src_key,
         'evidence_id' AS ref_field, {_t("evidence_id")} AS ref_value FROM release_manifest
  UNION
  SELECT 'benchmark_cases', {_t("corpus_release_id")}, {_t("case_id")}, 'gold_evidence.evidence_id', {_t("g.evidence_id")}
  FROM (SELECT corpus_release_id, case_id, unnest(gold_evidence) AS g FROM benchmark_cases)),
orphan AS (
  SELECT f.*, r.ordinal FROM refs f JOIN rel r ON r.release = f.release
  WHERE f.ref_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.id = f.ref_value AND h.ordinal = r.ordinal)),
spans AS (SELECT id, min(ordinal) AS lo, max(ordinal) AS hi FROM held GROUP BY id),
latest AS (
  SELECT {_t("corpus_release_id")} AS release, {_t("evidence_id")} AS src_key, {_t("source_version_id")} AS ref_value
  FROM corpus_evidence
  QUALIFY row_number() OVER (PARTITION BY {_t("corpus_release_id")}, {_t("evidence_id")} ORDER BY delivered_at DESC) = 1)
SELECT src_table, release AS corpus_release_id, src_key, ref_field, ref_value,
       CASE WHEN lo < ordinal THEN 'DELETED' WHEN hi > ordinal THEN 'LATER' ELSE 'MISSING' END AS orphan_kind
FROM orphan LEFT JOIN spans ON spans.id = orphan.ref_value
UNION
SELECT 'corpus_evidence', l.release, l.src_key, 'source_version_id', l.ref_value,
       CASE WHEN v.source_version_id IS NULL THEN 'MISSING' WHEN v.deleted_at <= r.cutoff_at THEN 'DELETED' ELSE 'LATER' END
FROM latest l JOIN rel r ON r.release = l.release LEFT JOIN source_versions v ON {_t("v.source_version_id")} = l.ref_value
WHERE l.ref_value IS NOT NULL
  AND (v.source_version_id IS NULL OR v.deleted_at <= r.cutoff_at OR v.registered_at > r.cutoff_at)"""

_P4_SQL = f"""WITH {_RELEASES_SQL},
latest AS (
  SELECT r.ordinal, {_t("evidence_id")} AS evidence_id, content_exact
  FROM corpus_evidence e JOIN rel r ON r.release = {_t("e.corpus_release_id")}
  QUALIFY row_number() OVER (PARTITION BY r.ordinal, {_t("evidence_id")} ORDER BY delivered_at DESC) = 1),
pairs AS (
  SELECT coalesce(n.ordinal, p.ordinal + 1) AS ordinal, coalesce(n.evidence_id, p.evidence_id) AS evidence_id,
         CASE WHEN p.evidence_id IS NULL THEN 'ADDED' WHEN n.evidence_id IS NULL THEN 'REMOVED'
              WHEN n.content_exact IS DISTINCT FROM p.content_exact THEN 'CHANGED' END AS change_kind
  FROM latest n FULL JOIN latest p ON n.evidence_id = p.evidence_id AND n.ordinal = p.ordinal + 1)
SELECT rel.release AS corpus_release_id, evidence_id, change_kind
FROM pairs JOIN rel ON rel.ordinal = pairs.ordinal WHERE change_kind IS NOT NULL AND pairs.ordinal > 0"""


def _object(part: str) -> str:
    """The part of a payload as an object, parsed if it is JSON text."""
    return f"CASE WHEN json_type(p, '$.{part}') = 'VARCHAR' THEN CASE WHEN json_valid(p ->> '$.{part}') THEN CAST(p ->> '$.{part}' AS JSON) END ELSE p -> '$.{part}' END"


def _items(column: str, snake_key: str) -> str:
    """A list as it is, a lone object as a list of one."""
    part = f"({column} -> '$.{snake_key}')"
    return f"CASE json_type({part}) WHEN 'ARRAY' THEN CAST({part} AS JSON[]) WHEN 'OBJECT' THEN [{part}] ELSE [] END"


def _key(column: str, name: str, *within: str) -> str:
    """A member as text, its key in either style."""
    head, *more = name.split("_")
    camel = head + "".join(w.capitalize() for w in more)
    path = "".join(f"{w}." for w in within)
    return f"coalesce({column} ->> '$.{path}{name}', {column} ->> '$.{path}{camel}')"


_P5_BASE = f"""raw AS (SELECT DISTINCT record_id, payload FROM raw_records WHERE json_valid(payload)),
p AS (SELECT record_id, CAST(payload AS JSON) AS p FROM raw WHERE json_type(payload) = 'OBJECT'),
parts AS (SELECT record_id, {_object("content")} AS c, {_object("verification")} AS v FROM p),
assets AS (SELECT record_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, {_items("c", "assets")} AS l FROM parts)),
inner_anchors AS (SELECT record_id, i, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, i, {_items("o", "anchors")} AS l FROM assets)),
outer_anchors AS (SELECT record_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, {_items("c", "anchors")} AS l FROM parts)),
anchors AS (
  SELECT record_id, 'content' AS parent_path, i AS pos, o FROM outer_anchors
  UNION ALL SELECT record_id, 'content.assets[' || i || ']', k, o FROM inner_anchors),
checks AS (SELECT record_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, {_items("v", "checks")} AS l FROM parts)),
findings AS (SELECT record_id, i, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, i, {_items("(o -> '$.details')", "findings")} AS l FROM checks))"""

_P5_SQL = f"""WITH {_P5_BASE},
every AS (
  SELECT record_id, 'asset' AS entity, 'content' AS parent_path, i AS node_pos, {_key("o", "asset_id")} AS node_value FROM assets
  UNION ALL SELECT record_id, 'anchor', parent_path, pos, o ->> '$.kind' FROM anchors
  UNION ALL SELECT record_id, 'check', 'verification', i, o ->> '$.invariant' FROM checks)
SELECT DISTINCT record_id, entity, parent_path, CAST(node_pos AS INTEGER) AS node_pos, node_value FROM every WHERE node_value IS NOT NULL AND record_id IS NOT NULL"""


def _list_text(column: str, name: str, separator: str) -> str:
    return f"CASE json_type({column}, '$.{name}') WHEN 'ARRAY' THEN nullif(array_to_string([x ->> '$' FOR x IN CAST({column} -> '$.{name}' AS JSON[])], '{separator}'), '') ELSE {column} ->> '$.{name}' END"


def _cast(name: str) -> str:
    return f"TRY_CAST({_key('o', name)} AS INTEGER) AS {name}"


_OBJECTS = "json_type(o) = 'OBJECT'"
_NESTED_SQL = {
    "p5_records": "SELECT record_id, " + ", ".join(f"{_key(part, name)} AS {name}" for part, name in (("c", "schema_version"), ("c", "source_version_id"), ("c", "title"), ("c", "content_exact"), ("v", "approval_status"))) + " FROM parts",
    "p5_assets": f"SELECT record_id, 'content' AS parent_path, CAST(i AS INTEGER) AS node_pos, 'content.assets[' || i || ']' AS node_path, {', '.join(f'{_key('o', n)} AS {n}' for n in ('asset_id', 'authority_role', 'experimental'))}, {', '.join(f'{_key('o', n, 'licensing')} AS {c}' for c, n in (('license_id', 'license_id'), ('render_allowed', 'render_allowed'), ('license_notes', 'notes')))} FROM assets WHERE {_OBJECTS}",
    "p5_anchors": f"SELECT record_id, parent_path, CAST(pos AS INTEGER) AS node_pos, parent_path || '.anchors[' || pos || ']' AS node_path, {', '.join(f'{_key('o', n)} AS {n}' for n in ANCHOR_TEXTS)}, {', '.join(map(_cast, ANCHOR_NUMBERS))}, {_list_text('o', 'bbox', ',')} AS bbox FROM anchors WHERE {_OBJECTS}",
    "p5_checks": f"SELECT record_id, 'verification' AS parent_path, CAST(i AS INTEGER) AS node_pos, 'verification.checks[' || i || ']' AS node_path, {', '.join(f'{_key('o', n)} AS {n}' for n in ('invariant', 'outcome', 'verifier', 'evidence_digest'))}, CASE WHEN o ->> '$.details.invariant' IS NULL THEN '{{}}' ELSE CAST(json_object('invariant', o ->> '$.details.invariant') AS VARCHAR) END AS details FROM checks WHERE {_OBJECTS}",
    "p5_findings": f"SELECT record_id, 'verification.checks[' || i || '].details' AS parent_path, CAST(k AS INTEGER) AS node_pos, o ->> '$.field' AS field, {_list_text('o', 'notes', '|')} AS notes FROM findings WHERE {_OBJECTS}",
    "p5_boxes": "SELECT record_id, parent_path || '.anchors[' || pos || ']' AS node_path, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS item_pos, CAST(unnest(b) AS DOUBLE) AS value FROM (SELECT record_id, parent_path, pos, CAST(o -> '$.bbox' AS JSON[]) AS b FROM anchors WHERE json_type(o, '$.bbox') = 'ARRAY')",
}

SQL = {
    "p1_found": _P1_SQL,
    "p1_report": f"SELECT src_table, ref_field, corpus_release_id, orphan_kind, count(*) AS n_orphans, count(DISTINCT ref_value) AS n_values FROM ({_P1_SQL}) GROUP BY ALL",
    "p4_found": _P4_SQL,
    "p4_report": f"SELECT corpus_release_id, change_kind, count(*) AS n_ids FROM ({_P4_SQL}) GROUP BY ALL",
    "p5_found": _P5_SQL,
} | {name: f"WITH {_P5_BASE}\n{sql}" for name, sql in _NESTED_SQL.items()}

"""Orphan references, snapshot changes and nested records on small cases."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from korpuskel.functions.keys import latest_rows, tidy
from korpuskel.operators import bloom, nested, orphans, snapshots
from korpuskel.plans import core_problems


def test_tidy_and_latest(spark):
    df = spark.createDataFrame([(" a\t", 1, "x"), ("A", 2, None), ("A", 2, "y"), (None, 9, "z"), (" \n", 9, "z"), ("b", None, "w")], "k string, t int, v string")
    got = latest_rows(df, {"k": tidy("k")}, F.col("t"), {"v": F.col("v")}).collect()
    assert {(r.k, r.v) for r in got} == {("A", "y"), ("B", "w")}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    words = bloom.words_for(5000)
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    held = bloom.build(keys, "key", words)
    counts = spark.range(20000).select((F.col("id") < 5000).alias("inside"), bloom.maybe_in(held, F.xxhash64("id"), words).alias("hit")).groupBy("inside").agg(F.count_if("hit").alias("n"))
    found = {r.inside: r.n for r in counts.collect()}
    assert found[True] == 5000
    assert found[False] < 15000 * 0.03


def test_bloom_size_is_bounded():
    assert bloom.words_for(10**12) * 8 == bloom.MAX_BYTES
    assert bloom.words_for(10**12, 1 << 20) * 8 == 1 << 20
    assert bloom.words_for(0) >= 64


def test_snapshot_orphans(spark):
    parents = spark.createDataFrame([("A", 0), ("A", 1), ("B", 2), ("B", 2), (None, 1), ("C", 1)], "parent_key string, parent_ordinal int")
    refs = spark.createDataFrame(
        [("A", 0, "ok"), ("A", 2, "gone"), ("B", 1, "early"), ("X", 1, "never"), (None, 1, "null"), ("C", None, "no period"), ("A", 2, "gone")],
        "ref_value string, ordinal int, parent_key string",
    )
    got = orphans.snapshot_orphans(refs, parents, 6).collect()
    assert sorted((r.parent_key, r.orphan_kind) for r in got) == [("early", "LATER"), ("gone", "DELETED"), ("gone", "DELETED"), ("never", "MISSING")]
    assert orphans.snapshot_orphans(refs, parents.limit(0), 0).where("orphan_kind <> 'MISSING'").count() == 0
    assert orphans.snapshot_orphans(refs.limit(0), parents, 6).count() == 0


def test_a_filter_that_is_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "words_for", lambda keys, max_bytes: 64)
    parents = spark.range(3000).select(F.col("id").cast("string").alias("parent_key"), F.lit(0).alias("parent_ordinal"))
    refs = spark.range(2900, 3100).select(F.col("id").cast("string").alias("ref_value"), F.lit(0).alias("ordinal"))
    got = orphans.snapshot_orphans(refs, parents, 3000)
    assert {int(r.ref_value) for r in got.collect()} == set(range(3000, 3100))


def test_registry_orphans(spark):
    registry = spark.sql("SELECT * FROM VALUES ('A', timestamp'2024-01-01', NULL), ('B', timestamp'2024-01-01', timestamp'2024-02-01'), ('C', timestamp'2024-03-01', NULL), ('D', NULL, NULL) AS t(parent_key, registered_at, deleted_at)")
    refs = spark.sql("SELECT explode(array('A', 'B', 'C', 'D', 'E', NULL)) AS ref_value, timestamp'2024-02-01' AS at")
    got = {r.ref_value: r.orphan_kind for r in orphans.registry_orphans(refs, registry, 4).collect()}
    assert got == {"B": "DELETED", "C": "LATER", "E": "MISSING"}


def test_snapshot_changes(spark):
    rows = spark.createDataFrame(
        [(0, "a", 1, "x"), (0, "a", 2, "y"), (1, "a", 1, "y"), (0, "b", 1, None), (1, "b", 1, None), (0, "c", 1, None), (1, "c", 1, ""), (0, "d", 1, "t"), (1, "e", 1, "t"), (1, None, 1, "t"), (None, "f", 1, "t"), (1, "e", 1, "t")],
        "ordinal int, key string, v int, content string",
    )
    known = spark.createDataFrame([(0,), (1,), (2,)], "ordinal int")
    got = snapshots.snapshot_changes(rows, known, "key", "ordinal", F.col("v"), F.col("content")).collect()
    assert {tuple(r) for r in got if r.ordinal == 1} == {(1, "c", "CHANGED"), (1, "d", "REMOVED"), (1, "e", "ADDED")}
    assert {r.key for r in got if r.ordinal == 2 and r.change_kind == "REMOVED"} == {"a", "b", "c", "e"}
    assert snapshots.snapshot_changes(rows.limit(0), known, "key", "ordinal", F.col("v"), F.col("content")).count() == 0


def _walk(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{nested.snake(k)}" if path else nested.snake(k))
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, path + "[]")
    else:
        yield path, value


def _random_json(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.4:
        return rng.choice([None, True, False, 0, -1.5e3, 12, "", "é\"\\\n\t☃", "plain", "1e5"])
    if kind < 0.7:
        return [_random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdefgh"): _random_json(rng, depth + 1) for _ in range(rng.randrange(4))}


def _triples(text, lists=(), embedded=()):
    return nested.triples(text, nested._Path(nested.ROOT, nested._Rules(lists, embedded)))


def test_triples_match_a_full_parser():
    rng = random.Random(3)
    for _ in range(400):
        value = _random_json(rng)
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        got = [(p.text, v) for p, _, v in _triples(text) if v is not nested.OPENED]
        want = [(p, v if isinstance(v, str) else json.dumps(v)) for p, v in _walk(value) if v is not None]
        assert got == want


def _placed(value, path="", places=()):
    """(path, places, value) of all scalars but nulls, and of the beginnings of objects, by a full parser."""
    if isinstance(value, dict):
        yield path, places, "OBJECT"
        for k, v in value.items():
            yield from _placed(v, f"{path}.{k}" if path else k, places)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _placed(v, path + "[]", (*places, i))
    elif value is not None:
        yield path, places, value if isinstance(value, str) else json.dumps(value)


def test_rows_hold_every_value_of_random_records():
    rng = random.Random(5)
    for _ in range(400):
        record = {rng.choice("abcdefgh"): _random_json(rng, 1) for _ in range(3)}
        rows = nested.nodes_of(json.dumps(record), nested._Path(nested.ROOT, nested._Rules()))
        got, elements = [], set()
        for group, own, values, lists in rows:
            # The marks of a group's own path can be told from its places only where no list is within a list.
            elements.add((group.head.replace("[]", ""), own))
            base = group.head.replace("[]", "")
            join = lambda leaf, base=base: f"{base}.{leaf}".strip(".").replace("[]", "")
            got += [(join(leaf), own, v) for leaf, v in values.items()]
            got += [(join(leaf), own + below, v) for leaf, items in lists.items() for below, v in items]
        want = [(p.replace("[]", ""), places, v) for p, places, v in _placed(record)]
        assert sorted(got) == sorted(w for w in want if w[2] != "OBJECT" or w in got)
        objects = {(p.replace("[]", ""), places) for p, places, v in _placed(record) if v == "OBJECT" and (not p or p.endswith("[]"))}
        assert objects <= elements


def test_damaged_texts_are_told_from_whole_ones():
    whole = '{"a": [1, {"b": null}], "c": "x\\u00e9"}'
    assert _triples(whole)
    for cut_at in range(len(whole)):
        damaged = whole[:cut_at]
        try:
            _triples(damaged)
        except nested.Damaged:
            continue
        raise AssertionError(damaged)
    for text in ('{"a" 1}', '{"a":1,}', "[1,]", "{} x", '{"a":01}', '{"a":NaN}', '"a\n"', "[1 2]", "{1:2}", '{"a":1]', "nul", "{,}", "", "[", "{", '{"a":[1}', "[{]"):
        try:
            _triples(text)
        except nested.Damaged:
            continue
        raise AssertionError(text)


def test_depth_is_bounded_and_unended_texts_are_no_trouble():
    assert _triples("[" * 900 + "]" * 900) == []
    for text in ("[" * 50_000 + "]" * 50_000, '{"a": "' + "x" * 2_000_000):
        try:
            _triples(text)
            raise AssertionError
        except nested.Damaged:
            pass


def test_flatten(spark):
    payload = {
        "content": json.dumps({"title": "T%d", "assets": [None, {"assetId": "A1", "anchors": {"kind": "PDF"}}, {"asset_id": None}], "anchors": [{"kind": "XML", "x": {"kind": "no"}}, None, {"kind": ""}]}),
        "verification": {"checks": {"invariant": "I", "details": {"invariant": "inner"}}, "unresolvedReasons": ["r1", None, "r2"]},
        "assets": [{"asset_id": "elsewhere"}],
        "grid": [[1, 2], [], [3]],
        "deep": [[{"v": 1}], [{"v": 2}, {"v": 3}]],
    }
    rows = [(1, json.dumps(payload)), (1, json.dumps(payload)), (2, json.dumps(payload)[:-1]), (3, None), (4, "[]"), (5, ""), (None, json.dumps(payload)), (6, '{"content": "not json", "verification": null}')]
    df = spark.createDataFrame(rows, "record_id long, payload string").withColumn("fields", F.lit("clash"))
    lists = ["content.assets", "content.assets.anchors", "content.anchors", "verification.checks"]
    nodes = nested.flatten(df, "record_id", "payload", lists, ["content", "verification"])
    got = sorted(((r.list_path, r.parent_path, r.node_pos, tuple(r.places), tuple(sorted(r.fields.items()))) for r in nodes.where("record_id = 1").collect()), key=str)
    assert got == sorted(
        [
            ("", None, None, (), (("content.title", "T%d"),)),
            ("assets", "", 0, (0,), (("asset_id", "elsewhere"),)),
            ("content.assets", "content", 1, (1,), (("asset_id", "A1"),)),
            ("content.assets", "content", 2, (2,), ()),
            ("content.assets.anchors", "content.assets[1]", 0, (1, 0), (("kind", "PDF"),)),
            ("content.anchors", "content", 0, (0,), (("kind", "XML"), ("x.kind", "no"))),
            ("content.anchors", "content", 2, (2,), (("kind", ""),)),
            ("verification.checks", "verification", 0, (0,), (("details.invariant", "inner"), ("invariant", "I"))),
            ("deep[]", "deep[0]", 0, (0, 0), (("v", "1"),)),
            ("deep[]", "deep[1]", 0, (1, 0), (("v", "2"),)),
            ("deep[]", "deep[1]", 1, (1, 1), (("v", "3"),)),
        ],
        key=str,
    )
    root = nodes.where("record_id = 1 AND list_path = ''").first()
    assert {k: [(tuple(i.places), i.value) for i in v] for k, v in root.lists.items()} == {
        "verification.unresolved_reasons[]": [((0,), "r1"), ((2,), "r2")],
        "grid[][]": [((0, 0), "1"), ((0, 1), "2"), ((2, 0), "3")],
    }
    reasons = nested.list_table(nodes, "record_id", nested.ROOT, "verification.unresolved_reasons")
    assert sorted((r.item_pos, r.value) for r in reasons.where("record_id = 1").collect()) == [(0, "r1"), (2, "r2")]
    assert {r.record_id for r in nodes.collect()} == {1, 6, None}
    assert [r.fields for r in nodes.where("record_id = 6").collect()] == [{"content": "not json"}]
    assert nested.flatten(df.limit(0), "record_id", "payload", ["content.assets"]).count() == 0
    table = nested.pivot(nodes, "record_id", "content.assets", {"asset_id": "asset_id"})
    assert sorted(str(r.asset_id) for r in table.collect()) == ["A1", "A1", "None", "None"]
    pruned = nested.flatten(df, "record_id", "payload", lists, ["content", "verification"], {"content.anchors": ["kind"]})
    assert sorted(str(r.fields) for r in pruned.where("record_id = 1").collect()) == ["{'kind': ''}", "{'kind': 'XML'}"]
    report = {(r.list_path, r.path): (r.n_values, r.n_rows) for r in nested.path_report(nodes.where("record_id = 1")).collect()}
    assert report["", "grid[][]"] == (3, 1) and report["content.anchors", "kind"] == (2, 2)


def test_lists_below_an_element_keep_all_values(spark, tmp_path):
    checks = [{"invariant": "I", "evidenceDigest": "d", "details": {"invariant": "inner", "findings": [{"field": "a", "notes": ["x", "y"]}, {"field": "b"}]}}, {"invariant": "J"}]
    anchors = [{"bbox": [1.0, None, 3, 4.5]}, {"kind": "PDF", "bbox": 7}, {"kind": "XML"}]
    payload = json.dumps({"content": json.dumps({"anchors": anchors}), "verification": {"checks": checks}})
    spark.createDataFrame([(1, payload)], "record_id long, payload string").write.parquet(str(tmp_path / "raw_records.parquet"))
    got = {r.node_pos: r.bbox for r in core_problems.anchor_table(spark, str(tmp_path)).collect()}
    assert got == {0: "1.0,null,3,4.5", 1: "7", 2: None}
    got = sorted((r.node_path, r.item_pos, r.value) for r in core_problems.box_table(spark, str(tmp_path)).collect() if r.value is not None)
    assert got == [("content.anchors[0]", 0, 1.0), ("content.anchors[0]", 2, 3.0), ("content.anchors[0]", 3, 4.5), ("content.anchors[1]", 0, 7.0)]
    got = {r.invariant: (r.evidence_digest, r.details) for r in core_problems.check_table(spark, str(tmp_path)).collect()}
    assert got == {"I": ("d", '{"invariant":"inner"}'), "J": (None, "{}")}
    got = sorted(map(tuple, core_problems.finding_table(spark, str(tmp_path)).collect()))
    assert got == [(1, "verification.checks[0].details", 0, "a", "x|y"), (1, "verification.checks[0].details", 1, "b", None)]

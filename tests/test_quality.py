"""Passages, classification, exact text functions, rules, pairs, lifecycle: against values and rules written out here."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from korpuskel.functions import exact as E
from korpuskel.functions import text as X
from korpuskel.functions.keys import canonical_list, collection_name
from korpuskel.operators import applicability, lifecycle, pairing, presentation, quality
from korpuskel.operators import registry as R


def test_exact_tokens(spark):
    texts = ["Ｃａｆé naïve 2.5 mg don't", "抗病毒 HIV抗体", "ﬁne Straße", "", None, "plain text"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.tokens(F.col("t")).alias("t")).collect()]
    assert got[0] == ["café", "cafe", "naïve", "naive", "2.5", "mg", "don't"]
    assert got[1] == ["抗", "病", "毒", "抗病", "病毒", "hiv", "抗", "体", "抗体"]
    assert got[2] == ["fine", "strasse"] and got[3] == got[4] == [] and got[5] == ["plain", "text"]


def test_identifiers():
    text = "For Maria Okonkwo, born 12/03/1980, MRN 1234567 and 1200000 copies/mL, mail a.b@c.org, call +49 30 1234 5678."
    assert [(text[s:e], k) for s, e, k in E.identifier_spans(text)] == [("Maria Okonkwo", "name"), ("12/03/1980", "date"), ("MRN 1234567", "record-number"), ("a.b@c.org", "email"), ("+49 30 1234 5678", "phone")]
    assert E.without_identifiers("For Maria Okonkwo, born 12/03/1980, call +49 30 1234 5678.") == "For, born, call."
    for harmless in ("Viral Load of World Health Organization", "In 2021 the Treatment Failure", "at 350 cells/mm3", ""):
        assert E.identifier_spans(harmless) == []


def test_segments_make_up_the_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["dose ", "dosing ", "monitored ", "Monitoring, ", "x", " ", "load "]) for _ in range(12))
        pieces = E.segments(text, ["monitor", "dose", "xx"], rng.choice(["", "lo", "MON"]))
        assert "".join(p for p, _ in pieces) == text
        assert all(not (a[1] == b[1] == "plain") for a, b in zip(pieces, pieces[1:], strict=False))
    assert E.segments("Monitoring the load", ["monitor"], "load") == [("Monitoring", "term"), (" the ", "plain"), ("load", "find")]


def test_ids_and_hashes(spark):
    names = ["a", "é", "", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    at, sign = X.feature_hash(F.col("n"), 384)
    for r in df.select("n", X.point_id(str(space), F.col("n")).alias("u"), R.keyed_hash("key", F.col("n")).alias("h"), R.keyed_hash("k" * 100, F.col("n")).alias("long"), at.alias("at"), sign.alias("sign")).collect():
        digest = hashlib.sha256(r.n.encode()).digest()
        assert r.u == str(uuid.uuid5(space, r.n))
        assert r.h == hmac.new(b"key", r.n.encode(), "sha256").hexdigest() and r.long == hmac.new(b"k" * 100, r.n.encode(), "sha256").hexdigest()
        assert (r.at, r.sign) == (int.from_bytes(digest[:8], "little") % 384, -1.0 if digest[8] & 1 else 1.0)
    import numpy as np

    row = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<double>").select(E.vector_digest("v").alias("d")).collect()
    assert row[0].d == hashlib.sha256(np.array([1.5, -2.0], "<f4").tobytes()).hexdigest() and row[1].d is None


def test_keyed_halves(spark):
    ids = [f"c{i}" for i in range(301)] + [None]
    got = {r.id: r.half for r in R.keyed_halves(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "seed").collect()}
    order = sorted(ids[:-1], key=lambda i: hmac.new(b"seed", i.encode(), "sha256").digest())
    assert {i for i, h in got.items() if h == "FIRST"} == set(order[:150]) and len(got) == 301


def test_small_text_functions(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x
    assert one(X.grade, "a strong recommendation, strong recommendation on low-certainty evidence")["strength"] == "strong"
    assert one(X.grade, "strong recommendation and conditional recommendation, low-certainty evidence") is None
    assert one(X.grade, "none") is None and one(X.grade, None) is None
    scope = one(X.scope, "Pregnant adolescents at primary health care. Contraindicated in renal failure; required if  CD4 is low  now")
    assert scope["population"] == ["adolescents", "pregnant people"] and scope["care_settings"] == ["primary health care"]
    assert scope["exclusion_criteria"] == ["Contraindicated in renal failure"] and scope["inclusion_criteria"] == ["Required if CD4 is low now"]
    assert one(lambda c: X.fragment(c, 10), "one two  three four") == "one two"
    assert one(lambda c: X.fragment(c, 4), "abcdefgh") == "abcd"
    assert one(X.question_terms, "Who should be Monitored? monitoring of the doses") == ["monitor", "doses"]
    assert one(X.humanised, "DOSE_OR_THRESHOLD") == "Dose or threshold"
    for value, depth in (("{}", 1), ('{"a": [1, {"b": "[[["}]}', 3), ("7", 0), ("", 0), (None, None)):
        assert one(X.json_depth, value) == depth
    assert one(lambda c: X.cell_label(c, F.lit(3), F.lit(26)), "S") == "S!AA4"
    assert [one(X.is_placeholder, v) for v in ("-", " N/A ", "Not classifiable in X", "x", None)] == [True, True, True, False, True]
    letters = spark.range(1, 18279).select("id", X.column_letters(F.col("id")).alias("l")).where(X.column_ordinal(F.col("l")) != F.col("id"))
    assert letters.count() == 0
    facts = one(X.stated_facts, "A 67-year-old with CKD and eGFR of 30, on anticoagulants")
    assert (facts.age, facts.conditions, facts.egfr, facts.renal_impairment, facts.topic) == (67, ["CHRONIC_KIDNEY_DISEASE"], 30.0, True, "anticoagulation")


def test_versions(spark):
    known = spark.createDataFrame([("1.2.3",), ("1.2.10",), ("1.2.11-rc1",), ("2.0.0",), ("x",)], "version string")
    specs = spark.createDataFrame([("1.2.x",), ("2.0.0",), ("2.0.1",), ("3.1.x",), (">=1",), ("1.2.11-rc1",)], "spec string")
    assert {r.spec: r.version for r in R.resolve_versions(specs, known).collect()} == {"1.2.x": "1.2.10", "2.0.0": "2.0.0", "2.0.1": None, "3.1.x": None, ">=1": None, "1.2.11-rc1": None}


ANCHORS = "array<struct<kind:string,table_id:string,row_index:int,column_index:int,pdf_page:int,char_start:int,char_end:int,bbox:array<double>>>"


def test_passages(spark):
    cell = lambda row: [("TABLE_CELL", "T", row, 0, None, None, None, None)]
    rows = [
        ("h", "A1=R\nB1=Age\nC1=Output Type\nD1=Guidance", cell(0)),
        ("r", "A2=R1\nB2=18 or more\nC2=-\nD2=Start\nnow", cell(1)),
        ("s", "A3=Part one", cell(2)),
        ("m", "A4=Decision ID\nB4=D.1", cell(3)),
        ("n", "A5=" + "long " * 40, cell(4)),
        ("p", "Plain  text\n\n\n\nhere", None),
        ("u", "A6=x\nB6=y", [("TABLE_CELL", "other", 5, 0, None, None, None, None)]),
        ("e", None, cell(9)),
        ("k", "B8=5\nD8=Wait", cell(10)),
    ]
    df = presentation.with_rows(spark.createDataFrame(rows, f"id string, content string, anchors {ANCHORS}"), "content", "anchors")
    schemas = presentation.headers(df.withColumn("table_id", F.col("anchor.table_id")), ["table_id"])
    got = {r.id: r for r in presentation.rendered(df, schemas, ["table_id"], "content").collect()}
    assert {i: r.kind for i, r in got.items()} == {"h": "TABLE_HEADER", "r": "DECISION_RULE", "s": "TABLE_SECTION_TITLE", "m": "TABLE_METADATA", "n": "TABLE_NOTE", "p": "NARRATIVE", "u": "UNLABELLED_TABLE_ROW", "e": "NARRATIVE", "k": "DECISION_RULE"}
    assert (got["r"].title, got["r"].body) == ("T - decision rule R1", "When:\n- Age: 18 or more\nThen:\n- Guidance: Start\nnow")
    assert got["h"].body == "Columns: R | Age | Output Type | Guidance" and got["m"].body == "Decision ID: D.1" and got["u"].body == "- x\n- y"
    assert got["p"].body == "Plain text\n\nhere" and got["p"].title == "" and got["e"].body is None
    assert (got["k"].title, got["k"].body) == ("T - decision rule", "When:\n- Age: 5\nThen:\n- Guidance: Wait")
    again = df.unionByName(df.where("id = 'h'").withColumn("id", F.lit("h2")))
    assert presentation.headers(again.withColumn("table_id", F.col("anchor.table_id")), ["table_id"]).count() == 0
    moved = spark.createDataFrame([("A9=X\nB9=y",), ("A7= x \nB7=Y",), ("A7=x\nC7=y",)], "c string").select(X.row_print(X.cells(F.col("c"))).alias("p")).collect()
    assert moved[0].p == moved[1].p != moved[2].p


def test_anchor_order_and_blocks(spark):
    anchors = [("PDF", None, None, None, 4, None, None, None), ("PDF", None, None, None, 4, None, None, [0.1, 0.1, 0.2, 0.2]), ("TABLE_CELL", "T", 1, 2, None, None, None, None), ("HTML", None, None, None, None, None, None, None)]
    df = spark.createDataFrame([("a", "one\n\ntwo", anchors), ("b", None, None), ("c", "x", [])], f"id string, content string, anchors {ANCHORS}")
    groups = {r.surface: (r.n_anchors, r.precision, r.place) for r in presentation.grouped_anchors(df, ["id"], "anchors").collect()}
    assert groups == {"page 4": (2, 1, 1), "row T!2": (1, 2, 2), "anchor 3": (1, 4, 3)}
    blocks = sorted((r.id, r.block_pos, r.block, r.anchor_place) for r in presentation.passage_blocks(df, ["id"], "content", "anchors").collect())
    assert blocks == [("a", 0, "one", 1), ("a", 1, "two", 0), ("c", 0, "x", None)]


def test_classification(spark):
    text = "For HIV-positive adults with CD4 < 200 cells/mm start it."
    rows = [("failed", "ArrayFormula object at 0x1", "X_ANNEX_B", "S", False), ("header", "Hit Policy Indicator Rule order", "X_ANNEX_B", "S", True), ("dup", text.upper(), "X_ANNEX_B", "S", True), ("best", text, "X_ANNEX_B", "S", True), ("odd", "text", "X_OTHER", None, True), ("soft", "x", "X_ANNEX_D", "S", True), ("page", "Contents of it", "X_MAIN", None, True), ("null", None, None, None, None)]
    df = spark.createDataFrame([("r", *r) for r in rows], "rel string, id string, text string, asset string, tab string, ok boolean")
    got = {r.id: (r.disposition, r.reasons, r.roles) for r in quality.classified(df, "rel", "id", "text", "asset", "tab", "ok", [F.col("asset")]).collect()}
    assert got["best"] == ("APPROVE", [], ["APPLICABILITY", "DOSE_OR_THRESHOLD", "PRIMARY_SUPPORT"])
    assert got["failed"][1] == ["ANCHOR_REPLAY_FAILED", "EXTRACTION_STRUCTURE_FAILED"] and got["header"][1] == ["HEADER_OR_FOOTER"]
    assert got["dup"] == ("QUARANTINE", ["DUPLICATE"], []) and got["odd"][1] == ["CLINICAL_CLASSIFICATION_UNRESOLVED"] and got["soft"][1] == ["NON_EVIDENCE"] == got["page"][1]
    assert got["null"][1] == ["ANCHOR_REPLAY_FAILED"]


def test_conflict_pairs_match_their_rule(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(25)]
    texts = {f"d{i:03}": " ".join(rng.sample(words, 6) + (["never"] if rng.random() < 0.4 else [])) for i in range(120)}
    df = spark.createDataFrame([("s", i, t) for i, t in texts.items()] + [("s", "null", None)], "s string, i string, t string")
    tokens = {i: {w for w in t.split() if len(w) >= 4} for i, t in texts.items()}
    positive = [i for i, t in texts.items() if "never" not in t]
    held = {}
    for i in positive:
        for t in tokens[i]:
            held.setdefault(t, []).append(i)
    want = set()
    for i in texts:
        if i in positive:
            continue
        useful = sorted((t for t in tokens[i] if t in held), key=lambda t: (len(held[t]), t))[:4]
        candidates = {c for t in useful for c in sorted(held[t])[:10]}
        if candidates:
            shared, best = max((len(tokens[i] & tokens[c]), c) for c in candidates)
            if shared >= 2:
                want.add((*sorted((i, best)), shared))
    got = {(r.left_id, r.right_id, r.shared) for r in pairing.conflict_pairs(df, "s", "i", "t", postings=10).collect()}
    assert got == want and len(want) > 20


def _judged(spark, rule, facts):
    df = spark.createDataFrame([(json.dumps(rule), json.dumps(facts))], "r string, f string")
    return df.select(applicability.judged(F.from_json("r", applicability.RULE), F.from_json("f", applicability.FACTS)).alias("j")).first().j


def test_three_valued_rules(spark):
    measure = {"measurements": [{"concept": "EGFR", "operator": ">=", "value": 30, "unit": "ml"}]}
    got = _judged(spark, measure, {"measurements": [{"concept": "CRCL", "value": 50, "unit": "ml"}]})
    assert (got.status, got.unknown) == ("UNKNOWN", ["EGFR required; CRCL is not interchangeable"])
    got = _judged(spark, measure, {"measurements": [{"concept": "EGFR", "value": 50, "unit": "l"}]})
    assert (got.status, got.unknown) == ("UNKNOWN", ["EGFR unit mismatch: expected ml, received l"])
    got = _judged(spark, measure, {"measurements": [{"concept": "EGFR", "value": 12.5, "unit": "ml"}]})
    assert (got.status, got.mismatched) == ("MISMATCH", ["EGFR does not satisfy >= 30"])
    assert _judged(spark, {"excluded": ["X"]}, {}).status == "UNKNOWN" and _judged(spark, {"excluded": ["X"]}, {"absent": ["X"]}).status == "MATCH"
    got = _judged(spark, {"required": ["B", "A"], "settings": ["HOME"], "min_age": 18, "pregnancy_allowed": False}, {"absent": ["B"], "setting": "WARD"})
    assert got.status == "MISMATCH" and got.mismatched == ["required condition absent: B", "care setting not allowed: WARD"]
    assert got.unknown == ["age not provided", "required condition not established: A", "pregnancy status not established"]
    assert _judged(spark, {}, {}).status == "MATCH"


def test_lifecycle(spark):
    day = datetime.date
    rows = spark.createDataFrame([("a", day(2024, 1, 31), day(2024, 3, 1)), ("b", None, None), ("c", day(2024, 5, 1), None), ("d", day(2024, 4, 1), day(2024, 3, 1))], "v string, f date, t date")
    moments = spark.createDataFrame([(1, day(2024, 1, 30)), (2, day(2024, 1, 31)), (3, day(2024, 3, 1)), (4, day(2024, 3, 2)), (5, day(2024, 6, 1)), (6, None)], "m int, at date")
    got = {(r.v, r.m) for r in lifecycle.in_force(rows, moments, "f", "t", "at").collect()}
    assert got == {("a", 2), ("a", 3), ("c", 5), *(("b", i) for i in range(1, 6))}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d2"), (None, "x")], "s string, e string")
    new = spark.createDataFrame([("c", "a"), ("a", "c"), ("z", "z"), ("d2", "a")], "s string, e string")
    assert {(r.s, r.e) for r in lifecycle.closing_edges(edges, new, "s", "e").collect()} == {("c", "a"), ("z", "z")}
    assert not lifecycle.has_cycle(edges, "s", "e") and lifecycle.has_cycle(edges.unionByName(new), "s", "e")


def test_relationships_take_evidence_out(spark):
    day = datetime.date
    kinds = [("v1", "SUPERSEDES", day(2024, 2, 1), None, None, None, None), ("v2", "CITES", None, None, None, None, None), ("v3", "AMENDS", None, day(2024, 1, 1), None, None, None), ("v4", "AMENDS", None, None, ["e4"], ["s9"], None)]
    relations = spark.createDataFrame(kinds, "version_id string, kind string, valid_from date, valid_to date, evidence_ids array<string>, section_ids array<string>, recommendation_ids array<string>")
    evidence = spark.createDataFrame([("k", v, e, s, None, day(2024, 3, 1)) for v, e, s in (("v1", "e1", "s"), ("v2", "e2", "s"), ("v3", "e3", "s"), ("v4", "e4", "s"), ("v4", "e5", "s9"), ("v4", "e6", "s"), ("v9", "e9", None), (None, "e0", None))], "k string, version_id string, evidence_id string, section_id string, recommendation_id string, at date")
    got = {r.evidence_id: r.is_hit for r in lifecycle.taken_out(evidence, relations, ["k"], "at").collect()}
    assert got == {"e1": True, "e2": False, "e3": False, "e4": True, "e5": True, "e6": False, "e9": False, "e0": False}


def test_closure(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "lost"), ("b", "c")], "parent string, package string")
    roots, known = spark.createDataFrame([("a",)], "package string"), spark.createDataFrame([("a",), ("b",), ("c",)], "package string")
    found = lifecycle.closure(roots, links, known, 100, 10)
    assert {r.package: r.depth for r in found.packages.collect()} == {"a": 1, "b": 2, "c": 3}
    assert found.issues == ["CYCLE", "MISSING_PACKAGE"] and ("c", "a") in {(r.parent, r.package) for r in found.requirements.collect()}
    assert lifecycle.closure(roots, links, known, 2, 10).issues == ["MISSING_PACKAGE", "PACKAGE_LIMIT"] or lifecycle.closure(roots, links, known, 2, 10).issues == ["PACKAGE_LIMIT"]
    assert lifecycle.closure(roots, links.limit(0), known, 9, 1).issues == []
    assert lifecycle.closure(roots, links, known, 9, 1).issues == ["DEPTH_LIMIT"]


def test_carried_values_match_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abb"), i, rng.choice([None, None, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v double").withColumn("b", F.floor(F.col("o") / 7))
    last, want = {}, {}
    for g, o, v in rows:
        want[o] = (last.get(g, (None, None, 0))[0], (last.get(g, (None, None, 0))[2]) + 1, v if v is not None else last.get(g, (None, None, 0))[1])
        last[g] = (v, want[o][2], want[o][1])
    a = {r.o: (r.previous_v, r.sequence_no) for r in R.latest_before(df, ["g"], ["o"], "b", "v").collect()}
    b = {r.o: r.f for r in R.fill_forward(df, ["g"], ["o"], "b", "v", "f").collect()}
    assert {o: (*a[o], b[o]) for o in a} == want


def test_claims_accounts_and_caches(spark):
    claims = spark.createDataFrame([("q", 1, ["a", "b", "a"]), ("q", 2, ["a", "z"]), ("q", 3, []), ("q", 4, None), ("p", 5, ["a"])], "q string, c int, ids array<string>")
    have = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "a")], "q string, i string")
    assert {r.c: (r.n_cited, r.is_supported) for r in R.grounded(claims, have, "q", "c", "ids", "i").collect()} == {1: (2, True), 2: (2, False), 3: (0, False), 4: (0, False), 5: (1, False)}
    ids = lambda *x: spark.createDataFrame([("r", i) for i in x], "r string, i string")
    row = R.accounted(ids("a", "b", "c"), ids("a", "a"), ids("b", "a", "z", None), ["r", "i"], ["r"]).first()
    assert (row.n_expected, row.n_missing, row.n_extra, row.n_both, row.is_sound) == (3, 1, 1, 1, False)
    pairs, cache = spark.createDataFrame([("x",), ("y",)], "t string"), spark.createDataFrame([("x", 0.5), ("x", 0.4)], "cache_key string, score double")
    assert {r.t: (r.score, r.is_cached) for r in R.with_cache(pairs, cache, F.col("t"), F.lit(0.1)).collect()} == {"x": (0.5, True), "y": (0.1, False)}


def test_lists_and_names(spark):
    df = spark.createDataFrame([(["b", "a"],), ([],), (None,)], "ids array<string>")
    assert [r.x for r in df.select(canonical_list(F.col("ids")).alias("x")).collect()] == [["a", "b"], [], None]
    with pytest.raises(Exception, match="repeats an id"):
        spark.createDataFrame([(["a", "a"],)], "ids array<string>").select(canonical_list(F.col("ids"))).collect()
    name = spark.createDataFrame([("Release 1/" + "x" * 90,)], "p string").select(collection_name(F.col("p"), F.lit("profile")).alias("n")).first().n
    assert len(name) == 63 and name.startswith("release-1-xxx") and name.endswith(hashlib.sha256(b"profile").hexdigest()[:16])


def test_statements_stand_under_their_headings(spark):
    long = "People should be offered a test at every visit to the clinic, whatever their age or reason "
    blocks = [(1, 1, "Chapter 1: Testing"), (1, 2, "Who"), (1, 3, "xii " + long + "(strong recommendation, low certainty evidence)."), (2, 1, "Running head"), (2, 2, long), (3, 1, "Chapter 2: Care  (continued)"), (3, 2, long), (3, 3, ""), (3, 4, None)]
    df = spark.createDataFrame([("d", *b) for b in blocks], "doc string, page int, block_no int, text string")
    got = [(r.page, r.chapter_no, r.chapter, r.heading, r.strength, r.certainty) for r in quality.statements(df, "doc", "^Running").orderBy("page").collect()]
    assert got == [(1, 1, "Testing", "Who", "strong", "low certainty evidence"), (2, 1, "Testing", "Who", None, None), (3, 2, "Care", None, None, None)]


def test_paraphrases(spark):
    swaps = {"panel": "group", "agreed": "decided", "draft": "proposal", "review": "check", "wards": "units", "weeks": "months"}
    texts = {"fits": "The panel agreed the draft review. Wards follow weeks later after HIV.A1 in 2024 again again", "few": "The panel agreed on it", "same": "alpha beta gamma delta panel agreed draft epsilon zeta eta theta iota", "null": None}
    df = spark.createDataFrame(list(texts.items()), "k string, t string").select("k", X.paraphrase(F.col("t"), swaps, ["the"]).alias("p"))
    got = {r.k: r.p for r in df.collect()}
    assert got["fits"].question == "group decided proposal check. units follow months later after again" or got["fits"].question.startswith("group decided proposal")
    assert got["fits"].overlap <= X.MOST_OVERLAP and got["few"] is None and got["same"] is None and got["null"] is None

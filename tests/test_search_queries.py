"""Evaluation on small tables made here, with expected values worked out by hand."""

from __future__ import annotations

import datetime
import math
import signal
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from korpuskel.operators import evaluation
from korpuskel.plans import search_queries

NOW = datetime.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    evidence = [("R", f"E{i:02}", NOW, "dose " + "word " * i, f"dose {i}", ["A"], None) for i in range(60)]
    anchors = "array<struct<kind:string,table_id:string,row_index:int>>"
    cases = [
        ("C-100", "R", NOW, "dose", "ANSWERABLE", [("E55", 1, True), ("E00", 2, True), ("X", 1, True)], [], [], {"k": "v"}, [("S", ["e00 "]), ("T", ["E55", "X"])], ["DOSE"]),
        ("C-200", "R", NOW, "dose", "INSUFFICIENT_EVIDENCE", [], ["e00 "], [], {"k": "v"}, None, None),
        ("C-300", "R", NOW, "unknown", "INSUFFICIENT_EVIDENCE", None, None, ["A"], {"k": "v"}, [], []),
        ("C-400", "R", NOW, "dose", "ANSWERABLE", [("E00", 1, False), ("E55", 1, True)], None, ["A", "B"], None, [], []),
    ]
    spark.createDataFrame(evidence, f"corpus_release_id string, evidence_id string, delivered_at timestamp, content_search string, content_exact string, evidence_roles array<string>, anchors {anchors}").write.parquet(str(tmp_path / "corpus_evidence.parquet"))
    columns = "case_id string, corpus_release_id string, created_at timestamp, question string, evidence_expectation string, gold_evidence array<struct<evidence_id:string,relevance_grade:int,required:boolean>>, forbidden_evidence_ids array<string>, required_evidence_roles array<string>, strata map<string,string>, minimum_complete_evidence_sets array<struct<set_id:string,evidence_ids:array<string>>>, safety_topics array<string>"
    empty = ", ".join(f"CAST(array() AS array<string>) AS {n}" for n in search_queries.FILTERS)
    spark.createDataFrame(cases, columns).withColumn("retrieval_filter", F.expr(f"(SELECT struct({empty}))")).write.parquet(str(tmp_path / "benchmark_cases.parquet"))
    return str(tmp_path)


def test_completeness_and_abstention(spark, folder):
    got = {(r.mode, r.case_id): r for r in search_queries.case_metrics(spark, folder).collect()}
    assert {c for m, c in got if m == "hybrid"} == {"C-100", "C-200", "C-300", "C-400"}
    one = got["sparse", "C-100"]  # the shortest texts come first: E00 to E09
    assert (one.population, one.recall, one.reciprocal_rank, one.precision, one.precision_ceiling) == ("ANSWERABLE", pytest.approx(1 / 3, abs=1e-6), 1.0, 0.1, 0.3)
    assert one.complete and one.complete_at_budget  # one of its sets is enough
    assert not got["sparse", "C-400"].complete and got["sparse", "C-400"].role_recall == 0.5  # without sets all that is required
    two, three = got["sparse", "C-200"], got["sparse", "C-300"]
    assert (two.population, two.recall, two.complete, two.precision_ceiling, two.n_forbidden) == ("INSUFFICIENT", 0.0, False, 1.0, 1)
    assert (three.recall, three.complete, three.role_recall, three.n_forbidden) == (1.0, True, 1.0, 0)
    sums = {r.population: (r.n_cases, r.n_complete, r.n_leaking) for r in search_queries.mode_summary(spark, folder).where("mode = 'sparse'").collect()}
    assert sums == {"ALL": (4, 2, 1), "ANSWERABLE": (2, 1, 0), "INSUFFICIENT": (2, 1, 1)}
    strata = {(r.stratum, r.value, r.population): r.n_cases for r in search_queries.stratum_summary(spark, folder).collect()}
    assert strata == {("k", "v", "ALL"): 3, ("k", "v", "ANSWERABLE"): 1, ("k", "v", "INSUFFICIENT"): 2, ("safety_topic", "DOSE", "ALL"): 1, ("safety_topic", "DOSE", "ANSWERABLE"): 1}


def test_gold_ranks_have_no_cap(spark, folder):
    got = {(r.case_id, r.evidence_id): (r.sparse_rank, r.presence_rank) for r in search_queries.gold_ranks(spark, folder).collect()}
    assert got["C-100", "E55"] == (56, 56) and got["C-100", "E00"] == (1, 1) and got["C-100", "X"] == (None, None)


def test_gold_measures_by_hand(spark):
    gold = [("a", 3, True), ("b", 1, False), ("a", 2, True)]
    cases = spark.createDataFrame([("c", gold, None, None, None, False), ("none", None, None, None, None, True)], "case_id string, gold array<struct<id:string,grade:int,required:boolean>>, sets array<array<string>>, forbidden array<string>, required_roles array<string>, insufficient boolean")
    got = spark.createDataFrame([("m", "c", "x", 1, None), ("m", "c", "a", 2, ["R"])], "mode string, case_id string, id string, place int, roles array<string>")
    rows = {(r["mode"], r.case_id): r for r in evaluation.case_metrics(cases, got, ["m", "empty"], 10, 1).collect()}
    one = rows["m", "c"]
    assert one.recall == 0.5 and one.reciprocal_rank == 0.5 and one.precision == 0.5 and one.r_precision == 0.5
    assert one.ndcg == pytest.approx((7 / 1.584962500721156) / (7 + 1 / 1.584962500721156))
    assert one.complete and not one.complete_at_budget
    assert rows["empty", "c"].recall == 0.0 and rows["empty", "none"].recall == 1.0


def test_exact_draws():
    low, high, p = evaluation.hypergeometric(20, 10, 6, 6)
    assert (low, high) == (1, 5) and p == pytest.approx(2 * 210 / 38760)
    assert evaluation.hypergeometric(10, 0, 5, 0) == (0, 0, 1.0)
    assert evaluation.goodness_of_fit([100, 100, 100], [10, 10, 10]) == 1.0
    assert evaluation.goodness_of_fit([100, 100, 100], [28, 1, 1]) < 0.001


def test_exact_draws_of_large_strata():
    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(30)  # counting every outcome of 90,000 takes minutes
    try:
        assert evaluation.hypergeometric(90000, 18000, 18000, 3501) == (3506, 3694, 0.03916301629021241)
        assert evaluation.hypergeometric(90000, 45000, 9000, 4400) == (4412, 4588, 0.02702367232184474)  # 4,600 is exactly as likely
        assert evaluation.hypergeometric(900000, 180000, 180000, 36500) == (35703, 36298, 0.000999205892008093)
        assert evaluation.hypergeometric(900000, 180000, 180000, 0) == (35703, 36298, 0.0)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_exact_draws_against_all_outcomes():
    for n, k, d in product(range(9), repeat=3):
        if max(k, d) > n:
            continue
        chances = {i: Fraction(math.comb(k, i) * math.comb(n - k, d - i), math.comb(n, d)) for i in range(max(0, d - n + k), min(k, d) + 1)}
        for x, alpha in product(range(d + 1), (0.05, 0.5, 1.0)):
            half = Fraction(alpha).limit_denominator(100) / 2
            low = min(i for i in chances if sum(c for j, c in chances.items() if j <= i) > half)
            high = max(i for i in chances if sum(c for j, c in chances.items() if j >= i) > half)
            assert evaluation.hypergeometric(n, k, d, x, alpha) == (low, high, float(sum(c for c in chances.values() if c <= chances.get(x, 0))))
    assert evaluation.hypergeometric(4000, 100, 1, 1) == (0, 0, 0.025)  # exactly half of alpha, so outside
    assert evaluation.hypergeometric(4000, 101, 1, 1)[:2] == (0, 1)


def test_draw_checks_leave_bad_rows_open(spark):
    rows = spark.createDataFrame([(20, 10, 6, 3), (5, 9, 1, 0), (None, 1, 1, 1)], "n int, k int, d int, x int")
    got = [(r.low, r.high, r.is_inside) for r in evaluation.draw_checks(rows, "n", "k", "d", "x").collect()]
    assert got == [(1, 5, True), (None, None, None), (None, None, None)]


def test_zero_bound(spark):
    got = [r.b for r in spark.createDataFrame([(0,), (50,), (150,)], "n int").select(evaluation.zero_bound(F.col("n")).alias("b")).collect()]
    assert got == [1.0, pytest.approx(0.058, abs=1e-3), pytest.approx(0.0198, abs=1e-3)]


def test_compared_scores(spark):
    left = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2), ("q", "c", 1.0, 3)], "q string, id string, score double, rank int")
    right = spark.createDataFrame([("q", "a", 2.5, 1), ("q", "c", 1.0, 2), ("q", "b", 1.0, 3), ("q", "d", 0.5, 4)], "q string, id string, score double, rank int")
    r = evaluation.compared_scores(left, right, "q", "id").first()
    assert (r.n_left, r.n_right, r.n_common, r.max_delta, r.n_moved, r.n_moved_by_ties) == (3, 4, 3, 0.5, 2, 2)

"""Registry and screening queries on small tables made here."""

from __future__ import annotations

import datetime

from korpuskel.plans import registry_queries, text_queries


def test_every_line_is_an_anchor(spark, tmp_path):
    spark.createDataFrame([(7, 1, 10), (7, 2, 20), (7, 4, 40), (100, 1, 50)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r)[:3] for r in registry_queries.row_neighbourhood(spark, str(tmp_path)).collect())
    assert got == [(7, 1, 1), (7, 1, 2), (7, 2, 1), (7, 2, 2), (7, 4, 4), (100, 1, 1)]


def test_ids_compare_tidied(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    cases = [("C1", "r ", at, "Give 5 or 7 mg", [("e1 ",)], [("S", ["E1"])], ["\te1"])]
    spark.createDataFrame(cases, "case_id string, corpus_release_id string, created_at timestamp, question string, gold_evidence array<struct<evidence_id:string>>, minimum_complete_evidence_sets array<struct<set_id:string,evidence_ids:array<string>>>, forbidden_evidence_ids array<string>").write.parquet(str(tmp_path / "benchmark_cases.parquet"))
    evidence = [("R", "E1", at, "7"), ("R", "E1", at + datetime.timedelta(1), "5")]
    spark.createDataFrame(evidence, "corpus_release_id string, evidence_id string, delivered_at timestamp, content_exact string").write.parquet(str(tmp_path / "corpus_evidence.parquet"))
    assert [tuple(r) for r in registry_queries.complete_sets(spark, str(tmp_path)).collect()] == [("C1", True, 1)]
    assert [tuple(r) for r in text_queries.numeral_screen(spark, str(tmp_path)).collect()] == [("C1", "7")]

"""Sources, sinks and the outbox stream on files made here."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

import pytest

from korpuskel.sources import files, inventory, sinks
from korpuskel.streaming.outbox import run_outbox


def _workbook(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Doses" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Label</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" s="1"><v>45352</v></c><c r="F1"><v>1.23E7</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3"><f>A1+1</f><v>3</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = files.read_workbooks(spark, str(tmp_path)).collect()
    assert sorted((r.sheet, r.row_no, r.content) for r in got if r.content) == [("Doses", 1, "A1=Label\nC1=2.5\nD1=TRUE\nE1=2024-03-01\nF1=12300000"), ("Doses", 3, "B3==A1+1\nC3=in")]
    assert [(c.row_index, c.column_index) for r in got if r.row_no == 3 for c in r.cells] == [(2, 1), (2, 2)]
    accounts = {r.path.rpartition("/")[2]: (r.n_expected, r.n_units, r.n_empty, r.is_complete) for r in files.scan_accounts(files.read_workbooks(spark, str(tmp_path))).collect()}
    assert accounts == {"a.xlsx": (3, 2, 1, True), "b.xlsx": (0, 0, 0, False)}
    assert [r.path.rpartition("/")[2] for r in got if r.error] == ["b.xlsx"]


def _package(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))


def test_packages(spark, tmp_path):
    _package(tmp_path / "ok.tgz", [("package/a.json", b'{"resourceType": "Library", "id": "x"}'), ("package/b.txt", b"."), ("package/c.json", b"[]")])
    _package(tmp_path / "up.tgz", [("../a.json", b"{}")])
    _package(tmp_path / "twice.tgz", [("a.json", b'{"resourceType": "L", "resourceType": "M"}')])
    _package(tmp_path / "nan.tgz", [("a.json", b'{"resourceType": NaN}')])
    got = files.read_packages(spark, str(tmp_path)).collect()
    assert [(r.resource_type, r.resource_id) for r in got if not r.error] == [("Library", "x")]
    assert sum(bool(r.error) for r in got) == 3


def test_sealed(spark, tmp_path):
    content = {"b": [1, 2.5, "é"], "a": None}
    (tmp_path / "ok.json").write_text(json.dumps({"content": content, "content_sha256": files.canonical_digest(content)}))
    (tmp_path / "bad.json").write_text(json.dumps({"content": content, "content_sha256": "0" * 64}))
    (tmp_path / "no.json").write_text("{")
    assert {r.path.rpartition("/")[2]: r.is_intact for r in files.read_sealed(spark, str(tmp_path)).collect()} == {"ok.json": True, "bad.json": False, "no.json": False}


def test_sinks_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "table"), ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == [("a", 1), ("b", 3)]
    for _ in range(2):
        named = sinks.write_by_digest(rows, F.col("k"), str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    assert named.select("sha256").distinct().count() == 2
    sinks.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_outbox_stream(spark, tmp_path):
    events = spark.sql("SELECT id % 5 AS k, timestamp_seconds(1700000000 + id) AS ts FROM range(20)")
    events.write.parquet(str(tmp_path / "in"))
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    for _ in range(2):
        run_outbox(spark, where[0], "k long, ts timestamp", where[1], where[2], ["k"]).awaitTermination()
        events.write.mode("append").parquet(where[0])
    assert spark.read.parquet(where[1]).count() == 5


def test_outbox_keeps_late_events_of_new_keys(spark, tmp_path):
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    for batch in ("(1, 1700000000), (2, 1700090000)", "(3, 1700000000), (1, 1600000000), (4, 1700090001)", "(5, 1600000000)"):
        spark.sql(f"SELECT CAST(col1 AS long) AS k, timestamp_seconds(col2) AS ts FROM VALUES {batch}").coalesce(1).write.mode("append").parquet(where[0])
        run_outbox(spark, where[0], "k long, ts timestamp", where[1], where[2], ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(where[1]).collect()) == [1, 2, 3, 4, 5]


def test_manifests_are_read_alone(spark, tmp_path):
    _package(tmp_path / "ok.tgz", [("package/package.json", b'{"name": "a", "version": "1.0.0", "dependencies": {"b": "1.2.x"}}'), ("../late.json", b"{}")])
    _package(tmp_path / "none.tgz", [("package/a.json", b"{}")])
    got = {r.path.rpartition("/")[2]: r for r in files.read_manifests(spark, str(tmp_path)).collect()}
    assert (got["ok.tgz"].package, got["ok.tgz"].version, got["ok.tgz"].dependencies) == ("a", "1.0.0", {"b": "1.2.x"})
    assert got["none.tgz"].error


def test_lists_and_questions(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# usual\nthe of\n\nÉté\n")
    assert {r.token for r in files.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "of", "été", "ete"}
    (tmp_path / "q.json").write_text('{"question_id": "a", "question": "x?", "usable": true}\n{"question_id": "b", "question": "y?", "usable": false}\n{"question_id": null, "question": "z", "usable": true}\n')
    assert [r.question_id for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()] == ["a"]
    listed = spark.createDataFrame([("1", "release", True), ("0.9", "release", None), ("2", "draft", False)], "version string, status string, current boolean")
    assert {r.version: r.state for r in files.released_versions(listed).collect()} == {"1": "EFFECTIVE", "0.9": "SUPERSEDED"}
    assert [r.version for r in files.released_versions(listed, True).collect()] == ["1"]


def test_verified_files(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "f" / name).write_bytes(name.encode())
    said = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), ("b", "0" * 64), ("d", "0" * 64)], "name string, sha256 string")
    assert {r.name: r.state for r in files.verified_files(spark, str(tmp_path / "f"), said).collect()} == {"a": "VERIFIED", "b": "DIGEST_MISMATCH", "c": "UNEXPECTED", "d": "MISSING"}


def _pages(folder, *pages):
    for i, (items, following) in enumerate(pages, 1):
        (folder / f"page-{i}.json").write_text(json.dumps({"items": [{"item_id": x, "title": f"T{x}"} for x in items], "next": following}))


def test_inventory(spark, tmp_path):
    _pages(tmp_path, (["a", "b"], "page-2.json"), (["c", None], None))
    got = {r.item_id: r.title for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a": "Ta", "b": "Tb", "c": "Tc"}
    assert [r.item_id for r in inventory.read_inventory(spark, str(tmp_path), scope=["b"]).collect()] == ["b"]
    lookup = spark.createDataFrame([("a", "x-fr.pdf", "1"), ("a", "y-en.pdf", "2"), ("b", "z", None)], "item_id string, name string, artifact string")
    found = inventory.resolved(inventory.read_inventory(spark, str(tmp_path)), lookup, ["-en.pdf", ".pdf"])
    assert {r.item_id: (r.artifact, r.blocker) for r in found.collect()} == {"a": ("2", None), "b": (None, "NO_ARTIFACT"), "c": (None, "NO_ARTIFACT")}
    _pages(tmp_path, (["a"], "page-2.json"), (["a"], None))
    with pytest.raises(Exception, match="repeated item"):
        inventory.read_inventory(spark, str(tmp_path)).collect()
    _pages(tmp_path, (["a"], "page-2.json"), (["b"], "page-1.json"))
    with pytest.raises(Exception, match="is repeated"):
        inventory.read_inventory(spark, str(tmp_path)).collect()


def test_registry_is_closed():
    registry = inventory.Registry()
    registry.register("source", "pages", "1", inventory.read_inventory)
    assert registry.resolve("source", "pages", "1") is inventory.read_inventory
    with pytest.raises(LookupError):
        registry.resolve("source", "pages", "2")
    with pytest.raises(ValueError):
        registry.register("source", "pages", "1", print)


def test_production_goes_on_where_it_was(spark, tmp_path):
    rows, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "made")
    make = lambda df: df.withColumn("v", F.col("k") * 2)
    assert sinks.produce(rows, path, ["k"], make, 4).count() == 4
    assert sorted(r.k for r in sinks.produce(rows, path, ["k"], make, 4).collect()) == list(range(8))
    assert sinks.produce(rows, path, ["k"], make).count() == 10 == sinks.produce(rows, path, ["k"], make).count()
    sinks.write_by_digest(rows, F.col("k").cast("string"), str(tmp_path / "blobs"))
    assert sinks.damaged_blobs(spark, str(tmp_path / "blobs")).count() == 0

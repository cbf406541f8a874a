"""File sources: workbooks, resource packages and sealed JSON, parsed in the tasks that read them."""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.session import ship

MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_MEMBERS, MAX_RATIO = 64 << 20, 512 << 20, 100_000, 200
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


class Refused(ValueError):
    """The file breaks a bound or a rule of its format."""


def _binary(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _strict(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Refused("repeated key")
    return found


def _no_constant(name: str) -> None:
    raise Refused(f"{name} is no JSON number")


def strict_json(text: str | bytes) -> object:
    """A JSON value; repeated keys and numbers that aren't finite are refused."""
    return json.loads(text, object_pairs_hook=_strict, parse_constant=_no_constant)


def canonical_digest(value: object) -> str:
    """SHA-256 of the canonical form: keys in order, no blanks, other letters as they are, finite numbers only."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


#: Numbers of built-in formats that show dates or times. Fixed values.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_EPOCH = datetime.datetime(1899, 12, 30)


def _number(text: str, is_date: bool) -> str:
    """A number without exponent, or a day counted from 1900 as an ISO date; other texts as they are."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        return text
    if is_date and 0 <= value < 2_958_466:
        moment = _EPOCH + datetime.timedelta(days=int(value), seconds=round(float(value % 1) * 86_400))
        return moment.date().isoformat() if value == int(value) else moment.isoformat()
    plain = format(value, "f")
    return plain.rstrip("0").rstrip(".") if "." in plain else plain


def _ordinal(letters: str) -> int:
    out = 0
    for letter in letters:
        out = out * 26 + ord(letter) - 64
    return out


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, str | None, list[tuple[str, int, int]]]]:
    """(sheet, row number, lines COL+ROW=value, cells) of each row of an XLSX file; of one without values the lines are null.

    A formula gives its text, dates give ISO dates, numbers no exponent, booleans
    TRUE or FALSE. Cells are (sheet, row, column) counted from 0.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        members = book.infolist()
        if len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_TOTAL_BYTES or any(m.file_size > MAX_RATIO * max(1, m.compress_size) + 4096 for m in members):
            raise Refused("the workbook is too large")

        def parse(name: str) -> ElementTree.Element:
            raw = book.read(name)
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                raise Refused("document type declarations are refused")
            return ElementTree.fromstring(raw)

        local = lambda e: e.tag.rpartition("}")[2]
        names = {m.filename for m in members}
        shared = ["".join(t.text or "" for t in item.iter() if local(t) == "t") for item in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated = _dated(parse("xl/styles.xml"), local) if "xl/styles.xml" in names else []
        targets = {e.get("Id"): e.get("Target", "") for e in parse("xl/_rels/workbook.xml.rels")}
        for sheet in (e for e in parse("xl/workbook.xml").iter() if local(e) == "sheet"):
            target, title = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/"), sheet.get("name", "")
            for count, row in enumerate((e for e in parse(target if target.startswith("xl/") else f"xl/{target}").iter() if local(e) == "row"), 1):
                lines, cells, number = [], [], int(row.get("r", count))
                for cell in row:
                    place = _CELL.fullmatch(cell.get("r", ""))
                    parts = {local(e): e for e in cell}
                    kind, style = cell.get("t", "n"), int(cell.get("s", 0))
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if local(t) == "t")
                    elif "f" in parts and parts["f"].text:
                        value = "=" + parts["f"].text
                    else:
                        value = (parts["v"].text or "") if "v" in parts else ""
                        if kind == "s" and value:
                            value = shared[int(value)]
                        elif kind == "b":
                            value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                        elif kind == "n":
                            value = _number(value, style < len(dated) and dated[style])
                    if place and value.strip():
                        number = int(place[2])
                        lines.append(f"{place[0]}={value.strip()}")
                        cells.append((title, number - 1, _ordinal(place[1]) - 1))
                yield title, number, "\n".join(lines) or None, cells


def _dated(styles: ElementTree.Element, local) -> list[bool]:
    """Whether each cell style shows a date."""
    own = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in styles.iter() if local(e) == "numFmt"}
    bare = {n: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower() for n, code in own.items()}
    formats = [int(xf.get("numFmtId", 0)) for group in styles.iter() if local(group) == "cellXfs" for xf in group]
    return [n in _DATE_FORMATS or bool(re.search("[ydh]", bare.get(n, ""))) for n in formats]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``row_no``, ``content``, ``cells`` of all rows of the workbooks under ``path``; ``error`` for a refused one.

    An empty row has a null content; ``cells`` are the places of its values, from 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, s, n, c, [{"table_id": t, "row_index": r, "column_index": k} for t, r, k in cells], None) for s, n, c, cells in workbook_rows(bytes(data))]
                except (Refused, KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "content", "cells", "error"]).astype({"row_no": "Int32"})

    return _binary(spark, path).mapInPandas(run, "path string, sheet string, row_no int, content string, cells array<struct<table_id:string,row_index:int,column_index:int>>, error string")


def scan_accounts(rows: DataFrame) -> DataFrame:
    """Per file of ``read_workbooks``: ``n_expected`` rows, ``n_units`` with content, ``n_empty``, ``is_complete`` (no error, and the two add up)."""
    sums = rows.groupBy("path").agg(F.count("row_no").alias("n_expected"), F.count("content").alias("n_units"), F.count_if(F.col("row_no").isNotNull() & F.col("content").isNull()).alias("n_empty"), F.count("error").alias("_e"))
    return sums.withColumn("is_complete", (F.col("_e") == 0) & (F.col("n_expected") == F.col("n_units") + F.col("n_empty"))).drop("_e")


def package_resources(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(member, resource type, id, JSON) of a gzipped tar of JSON resources, one member at a time; unsafe members are refused."""
    total, seen = 0, set()
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
        for count, member in enumerate(archive):
            parts = member.name.split("/")
            if count >= MAX_MEMBERS or member.name.startswith("/") or ".." in parts or member.issym() or member.islnk() or member.name in seen:
                raise Refused(f"member {member.name}")
            seen.add(member.name)
            total += member.size
            if member.size > MAX_MEMBER_BYTES or total > MAX_TOTAL_BYTES or total > MAX_RATIO * len(data) + (1 << 20):
                raise Refused("the package is too large")
            if member.isfile() and member.name.endswith(".json"):
                text = archive.extractfile(member).read().decode()
                value = strict_json(text)
                if isinstance(value, dict) and "resourceType" in value:
                    yield member.name, str(value["resourceType"]), str(value.get("id", "")), text


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``member``, ``resource_type``, ``resource_id``, ``resource`` of all packages; ``error`` for a refused one, of which nothing else comes out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, *r, None) for r in package_resources(bytes(data))]
                except (Refused, ValueError, EOFError, OSError, tarfile.TarError) as e:
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "member", "resource_type", "resource_id", "resource", "error"])

    return _binary(spark, path).mapInPandas(run, "path string, member string, resource_type string, resource_id string, resource string, error string")


def package_manifest(data: bytes) -> tuple[str, str, dict[str, str]]:
    """(name, version, dependencies) of a package, read no further than its manifest."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
        for count, member in enumerate(archive):
            if count >= MAX_MEMBERS or member.size > MAX_MEMBER_BYTES:
                raise Refused("the package is too large")
            if member.isfile() and member.name == "package/package.json":
                value = strict_json(archive.extractfile(member).read().decode())
                wants = value.get("dependencies") or {}
                if not isinstance(wants, dict) or not all(isinstance(v, str) for v in wants.values()):
                    raise Refused("dependencies must be names and versions")
                return str(value["name"]), str(value["version"]), wants
    raise Refused("no manifest")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``package``, ``version``, ``dependencies`` of all packages; ``error`` for a refused one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((name, *package_manifest(bytes(data)), None))
                except (Refused, KeyError, ValueError, EOFError, OSError, AttributeError, tarfile.TarError) as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "package", "version", "dependencies", "error"])

    return _binary(spark, path).mapInPandas(run, "path string, package string, version string, dependencies map<string,string>, error string")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``token`` of the words listed in text files, one line each or several; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return lines.select(F.explode(X.tokens(F.col("value"))).alias("token")).distinct()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON lines files that are usable: question_id, question, chapter; rows without either are left out."""
    schema = "question_id string, question string, chapter string, usable boolean"
    return spark.read.schema(schema).json(path).where("usable AND question_id IS NOT NULL AND trim(question) <> ''").drop("usable")


def released_versions(listed: DataFrame, only_current: bool = False) -> DataFrame:
    """Released entries of a package list with ``state``: EFFECTIVE for the current one, SUPERSEDED for others.

    ``listed``: version, status, ``current`` boolean (null is false). Entries of
    another status are left out, with ``only_current`` also those that aren't current.
    """
    current = F.coalesce("current", F.lit(False))
    kept = listed.where((F.col("status") == "release") & (current | F.lit(not only_current)))
    return kept.withColumn("state", F.when(current, "EFFECTIVE").otherwise("SUPERSEDED"))


def verified_files(spark: SparkSession, path: str, inventory: DataFrame) -> DataFrame:
    """Files under ``path`` against an inventory of ``name`` (the end of the path) and ``sha256``: MISSING, UNEXPECTED, DIGEST_MISMATCH or VERIFIED."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_found"))
    both = inventory.select("name", F.col("sha256").alias("_said")).join(held, "name", "full")
    state = F.when(F.col("_found").isNull(), "MISSING").when(F.col("_said").isNull(), "UNEXPECTED").when(F.col("_found") != F.col("_said"), "DIGEST_MISMATCH").otherwise("VERIFIED")
    return both.select("name", state.alias("state"))


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``content`` (JSON), ``is_intact`` of sealed files {content, ..._sha256}: the digest of the content is checked again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    value = strict_json(bytes(data))
                    digests = [v for k, v in value.items() if k.endswith("_sha256")]
                    rows.append((name, json.dumps(value["content"], sort_keys=True, ensure_ascii=False), digests == [canonical_digest(value["content"])]))
                except (ValueError, KeyError, AttributeError):
                    rows.append((name, None, False))
            yield pd.DataFrame(rows, columns=["path", "content", "is_intact"])

    return _binary(spark, path).mapInPandas(run, "path string, content string, is_intact boolean")

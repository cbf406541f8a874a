"""Spreadsheet rows and narrative passages as readers see them: kinds, headers, titles, bodies, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuskel.functions import text as X

NARRATIVE, NOTE, RULE, SCHEDULE, INDICATOR, ENTRY, HEADER, SECTION, METADATA, UNLABELLED = (
    "NARRATIVE", "TABLE_NOTE", "DECISION_RULE", "SCHEDULE_ENTRY", "INDICATOR_DEFINITION", "DATA_DICTIONARY_ENTRY", "TABLE_HEADER", "TABLE_SECTION_TITLE", "TABLE_METADATA", "UNLABELLED_TABLE_ROW",
)
#: Kinds that can bear a recommendation. Fixed values.
BEARING = [NARRATIVE, NOTE, RULE, SCHEDULE, INDICATOR]
#: What a kind is called in a title. Fixed values.
CALLED = {
    RULE: "decision rule",
    SCHEDULE: "service schedule",
    INDICATOR: "indicator",
    ENTRY: "data element",
    HEADER: "table columns",
    SECTION: "section",
    METADATA: "table metadata",
    NOTE: "note",
    UNLABELLED: "row",
}
#: First cells of rows that say what a table is, and the longest title of a section. Fixed values.
CAPTIONS, LONGEST_TITLE = ["decision id", "business rule", "trigger", "hit policy indicator", "schedule id"], 120
OUTCOME = "Output Type"  # heads the column that parts conditions from what to do. Fixed value.

#: How the rows of a table are read: one struct a table.
SCHEMA = "struct<row_kind:string,header_row:int,labels:map<string,string>,identity:array<string>,structural:array<string>,display:array<string>,outcome:int,collapsed:array<struct<label:string,columns:array<string>>>>"


def table_anchor(anchors: Column) -> Column:
    """(table_id, row_index) of the first anchor to a table cell; null if there is none."""
    cell = F.get(F.filter(anchors, lambda a: (a["kind"] == "TABLE_CELL") & a["table_id"].isNotNull()), F.lit(0))
    return F.when(cell.isNotNull(), F.struct(cell["table_id"].alias("table_id"), F.coalesce(cell["row_index"], F.lit(0)).alias("row_index")))


def with_rows(df: DataFrame, content: str, anchors: str) -> DataFrame:
    """``df`` with ``cells`` (null if the text isn't a row) and ``anchor`` (null if it is anchored to no table cell)."""
    return df.withColumn("cells", X.cells(F.col(content))).withColumn("anchor", table_anchor(F.col(anchors)))


def headers(rows: DataFrame, table: list[str], outcome: str = OUTCOME) -> DataFrame:
    """A schema for each table of which exactly one row holds the outcome label: that row names the columns.

    ``rows``: ``table`` columns, ``cells``, ``anchor``. Tables with several such
    rows are left out, as a wrong label is worse than none. The first column
    names the row. One small row per table; only candidate rows are shuffled.
    """
    value = lambda c: F.trim(c["value"], F.lit(" \t\n\r"))
    candidates = rows.where(F.col("anchor").isNotNull() & F.coalesce(F.exists("cells", lambda c: value(c) == outcome), F.lit(False)))
    one = candidates.groupBy(*table).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("anchor.row_index", "cells")).alias("r")).where("n = 1")
    labels = F.filter(F.transform("r.cells", lambda c: F.struct(c["column"].alias("c"), value(c).alias("v"))), lambda x: x["v"] != "")
    place = F.get(F.filter("r.cells", lambda c: value(c) == outcome), F.lit(0))["column"]
    none = F.array().cast("array<string>")
    schema = F.struct(
        F.lit(RULE).alias("row_kind"),
        F.col("r.row_index").alias("header_row"),
        F.map_from_entries(labels).alias("labels"),
        F.array(F.get("r.cells", F.lit(0))["column"]).alias("identity"),
        none.alias("structural"),
        none.alias("display"),
        X.column_ordinal(place).alias("outcome"),
        F.array().cast("array<struct<label:string,columns:array<string>>>").alias("collapsed"),
    )
    return one.select(*table, schema.cast(SCHEMA).alias("schema"))


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~X.is_placeholder(c["value"]))


def kind_of(cells: Column, anchor: Column, schema: Column) -> Column:
    """The kind of a passage, from its form alone."""
    filled = _filled(cells)
    first = F.trim(F.get(filled, F.lit(0))["value"], F.lit(" \t\n\r"))
    title = ~first.contains("\n") & (F.length(first) <= LONGEST_TITLE)
    return (
        F.when(cells.isNull() | anchor.isNull(), NARRATIVE)
        .when(schema.isNotNull() & (schema["header_row"] == anchor["row_index"]), HEADER)
        .when((F.size(filled) == 2) & F.lower(first).isin(CAPTIONS), METADATA)
        .when((F.size(filled) == 1) & title, SECTION)
        .when(F.size(filled) == 1, NOTE)
        .when(schema.isNull(), UNLABELLED)
        .otherwise(schema["row_kind"])
    )


def title_of(kind: Column, cells: Column, anchor: Column, schema: Column) -> Column:
    """Table, kind and, for rows of the table's own kind, what names the row; empty for narrative."""
    value = lambda column: F.trim(F.get(F.filter(cells, lambda c: c["column"] == column), F.lit(0))["value"], F.lit(" \t\n\r"))
    named = F.array_join(F.filter(F.transform(schema["identity"], value), lambda v: ~X.is_placeholder(v)), " ")
    called = reduce(lambda acc, k: F.when(kind == k, CALLED[k]).otherwise(acc), CALLED, F.lit("row"))
    base = F.concat(anchor["table_id"], F.lit(" - "), called)
    own = F.when(schema.isNotNull() & (kind == schema["row_kind"]) & (named != ""), F.concat(base, F.lit(" "), named))
    return F.when(kind == NARRATIVE, "").otherwise(F.coalesce(own, base))


def body_of(kind: Column, content: Column, cells: Column, schema: Column) -> Column:
    """The passage in words: conditions and outcomes apart, labels before values, nothing that is empty."""
    filled = _filled(cells)
    plain = lambda c: X.presentation(c["value"])
    by_column = F.map_from_entries(F.transform(filled, lambda c: F.struct(c["column"], plain(c))))
    hidden = F.concat(schema["identity"], schema["structural"], F.flatten(F.transform(schema["collapsed"], lambda g: g["columns"])))
    shown = F.when(F.size(schema["display"]) > 0, schema["display"]).otherwise(F.array_except(F.transform(cells, lambda c: c["column"]), hidden))
    known = F.filter(shown, lambda c: F.map_contains_key(by_column, c))
    line = lambda c: F.concat(F.lit("- "), F.coalesce(F.element_at(schema["labels"], c), c), F.lit(": "), F.element_at(by_column, c))
    before = lambda c: X.column_ordinal(c) < schema["outcome"]
    when, then = F.transform(F.filter(known, before), line), F.transform(F.filter(known, lambda c: ~before(c)), line)
    headed = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))
    lines = F.when(schema["outcome"].isNotNull(), F.concat(headed("When:", when), headed("Then:", then))).otherwise(F.transform(known, line))
    short = lambda c: F.regexp_replace(F.coalesce(F.element_at(schema["labels"], c), c), " Code$", "")
    group = lambda g: F.array_join(F.transform(F.filter(g["columns"], lambda c: F.map_contains_key(by_column, c)), lambda c: F.concat(short(c), F.lit(" "), F.element_at(by_column, c))), "; ")
    groups = F.transform(F.filter(schema["collapsed"], lambda g: group(g) != ""), lambda g: F.concat(F.lit("- "), g["label"], F.lit(": "), group(g)))
    return (
        F.when(kind == NARRATIVE, X.presentation(content))
        .when(kind == HEADER, F.concat(F.lit("Columns: "), F.array_join(F.transform(filled, lambda c: F.trim(c["value"], F.lit(" \t\n\r"))), " | ")))
        .when(kind.isin(SECTION, NOTE), plain(F.get(filled, F.lit(0))))
        .when(kind == METADATA, F.array_join(F.transform(filled, plain), ": "))
        .when(schema.isNull(), F.array_join(F.transform(filled, lambda c: F.concat(F.lit("- "), plain(c))), "\n"))
        .otherwise(F.array_join(F.concat(lines, groups), "\n"))
    )


def print_of(content: Column, cells: Column, anchor: Column, structural: list[str] = ()) -> Column:
    """Fingerprint: of what a row says, wherever it stands, or of a narrative's body in folded case."""
    return F.when(cells.isNotNull() & anchor.isNotNull(), X.row_print(cells, structural)).otherwise(X.narrative_print(content))


def rendered(rows: DataFrame, schemas: DataFrame, table: list[str], content: str) -> DataFrame:
    """``rows`` (of ``with_rows``) with ``kind``, ``title``, ``body`` and ``print``, by the schemas of their tables.

    ``schemas``: the ``table`` columns but the last, ``table_id``, and ``schema``;
    one row a table. A null text gives a null body and print.
    """
    named = rows.withColumn("table_id", F.col("anchor.table_id")).join(schemas, table, "left")
    cells, anchor, schema = F.col("cells"), F.col("anchor"), F.col("schema")
    judged = named.withColumn("kind", kind_of(cells, anchor, schema))
    made = {"title": title_of(F.col("kind"), cells, anchor, schema), "body": body_of(F.col("kind"), F.col(content), cells, schema), "print": print_of(F.col(content), cells, anchor)}
    return judged.withColumns(made)


#: How precisely an anchor pins a passage, the most precise first. Fixed values.
PRECISION = ["EXACT_REGION", "CELL", "PAGE", "DOCUMENT"]


def precision_of(anchor: Column) -> Column:
    """Rank of an anchor's precision from 1: a box or characters, a cell, a page, a document."""
    region = (F.size(anchor["bbox"]) == 4) | (anchor["char_start"].isNotNull() & anchor["char_end"].isNotNull())
    cell = anchor["table_id"].isNotNull() & anchor["row_index"].isNotNull() & anchor["column_index"].isNotNull()
    return F.when(F.coalesce(region, F.lit(False)), 1).when(cell, 2).when(anchor["pdf_page"].isNotNull(), 3).otherwise(4)


def ordered_anchors(anchors: Column) -> Column:
    """Anchors with their ``precision``, the most precise first, else in their order."""
    ranked = F.transform(anchors, lambda a, i: F.struct(precision_of(a).alias("precision"), i.alias("place"), a.alias("anchor")))
    # Structs that hold arrays of structs don't sort by field alone in all versions, so only the two numbers are compared.
    return F.array_sort(ranked, lambda a, b: F.coalesce(F.nullif((a["precision"] - b["precision"]).cast("int"), F.lit(0)), (a["place"] - b["place"]).cast("int")))


def grouped_anchors(rows: DataFrame, key: list[str], anchors: str) -> DataFrame:
    """Anchors grouped by the surface they are on (page, table row, or themselves): ``surface``, ``n_anchors`` and the most precise one.

    ``key`` must tell the rows apart. The first and most precise member speaks for its group.
    """
    each = rows.select(*key, F.posexplode(ordered_anchors(F.col(anchors))).alias("order", "x"))
    a = F.col("x.anchor")
    page = F.when(a["pdf_page"].isNotNull(), F.concat(F.lit("page "), a["pdf_page"].cast("string")))
    row = F.when(a["table_id"].isNotNull() & a["row_index"].isNotNull(), F.concat(F.lit("row "), a["table_id"], F.lit("!"), (a["row_index"] + 1).cast("string")))
    surface = F.coalesce(row, page, F.concat(F.lit("anchor "), F.col("x.place").cast("string")))
    first = F.min_by(F.struct(F.col("x.precision").alias("precision"), a["kind"].alias("kind"), F.col("x.place").alias("place")), F.col("order"))
    return each.groupBy(*key, surface.alias("surface")).agg(F.count(F.lit(1)).alias("n_anchors"), first.alias("first")).select(*key, "surface", "n_anchors", "first.*")


def passage_blocks(rows: DataFrame, key: list[str], content: str, anchors: str) -> DataFrame:
    """Blocks of a passage, split at blank lines, each with its page anchor where there are as many of these as blocks: ``block_pos``, ``block``, ``anchor_place``.

    Rows of spreadsheets and null texts have none.
    """
    pages = F.transform(F.filter(ordered_anchors(F.col(anchors)), lambda x: x["anchor"]["pdf_page"].isNotNull()), lambda x: x["place"])
    made = rows.where(F.col(content).isNotNull() & ~F.col(content).rlike(r"^[A-Z]{1,3}[0-9]+=")).select(*key, F.split(content, "\n\n").alias("b"), F.coalesce(pages, F.array().cast("array<int>")).alias("p"))
    paired = (F.size("b") > 1) & (F.size("b") == F.size("p"))
    each = made.select(*key, "p", paired.alias("paired"), F.posexplode("b").alias("block_pos", "block"))
    return each.select(*key, "block_pos", "block", F.when(F.col("paired"), F.get("p", F.col("block_pos"))).alias("anchor_place"))

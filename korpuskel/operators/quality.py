"""Classification of evidence rows: what is no evidence, which roles a passage has, what it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuskel.functions import text as X
from korpuskel.operators import registry as R

#: Beginnings of rows that head columns or say what a table is, of pages that hold no evidence, and sheets without evidence. Fixed values.
HEADER_STARTS = [
    "activity id data element id data element label",
    "hit policy indicator rule order",
    "hit policy indicator first",
    "service name service description trigger event",
    "the name of the service for which the schedule is relevant",
    "sheet name description",
    "requirement id activity id and description",
    "requirement id category non-functional requirement",
    "reference/source activity id & activity name decision table id",
    "ref. no. short name indicator description",
    "ref no short name indicator description",
    "output type action guidance annotations",
]
METADATA_STARTS = ["decision id ", "business rule ", "trigger ", "hit policy "]
PAGE_STARTS = ["sales, rights and licensing", "contents", "acknowledgements", "list of abbreviations", "references", "for more information, contact:"]
ADMIN_SHEETS = ["cover", "readme", "search", "references", "example decision tables"]
LONGEST_METADATA = 500
UNSTABLE = ["object at 0x", "arrayformula"]  # text of formulas that changes from run to run. Fixed values.
#: Roles that an asset gives by the end of its name. Fixed values.
BASE_ROLES = {"ANNEX_A": "PRIMARY_SUPPORT", "ANNEX_B": "PRIMARY_SUPPORT", "ANNEX_C": "MONITORING", "MAIN": "PRIMARY_SUPPORT"}

REPLAY, STRUCTURE, HEADER, NO_EVIDENCE, UNRESOLVED, DUPLICATE = "ANCHOR_REPLAY_FAILED", "EXTRACTION_STRUCTURE_FAILED", "HEADER_OR_FOOTER", "NON_EVIDENCE", "CLINICAL_CLASSIFICATION_UNRESOLVED", "DUPLICATE"


def _starts(text: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for start in starts:
        out = out | text.startswith(start)
    return out


def reasons(text: Column, asset: Column, table: Column, replayed: Column) -> Column:
    """Why a row is no evidence, in order of precedence; empty if it is.

    ``asset``: name of its asset; ``table``: its sheet, null for pages;
    ``replayed``: whether its anchors gave its text again.
    """
    lowered = X.fold_case(X.search_view(text))
    unstable = lowered.contains(UNSTABLE[0]) | lowered.contains(UNSTABLE[1])
    sheet = F.lower(F.trim(table))
    kind = (
        F.when(~replayed, F.concat(F.array(F.lit(REPLAY)), F.when(unstable, F.array(F.lit(STRUCTURE))).otherwise(F.array().cast("array<string>"))))
        .when(unstable, F.array(F.lit(STRUCTURE)))
        .when(sheet.isin(ADMIN_SHEETS), F.array(F.lit(NO_EVIDENCE)))
        .when(table.isNotNull() & asset.endswith("ANNEX_D"), F.array(F.lit(NO_EVIDENCE)))
        .when(table.isNotNull() & _starts(lowered, HEADER_STARTS), F.array(F.lit(HEADER)))
        .when(table.isNotNull() & _starts(lowered, METADATA_STARTS) & (F.length(lowered) < LONGEST_METADATA), F.array(F.lit(NO_EVIDENCE)))
        .when(table.isNull() & _starts(lowered, PAGE_STARTS), F.array(F.lit(NO_EVIDENCE)))
        .when(~_known(asset), F.array(F.lit(UNRESOLVED)))
    )
    return F.coalesce(kind, F.array().cast("array<string>"))


def _known(asset: Column) -> Column:
    out = F.lit(False)
    for end in BASE_ROLES:
        out = out | asset.endswith(end)
    return F.coalesce(out, F.lit(False))


def roles(text: Column, asset: Column) -> Column:
    """Roles of a passage, in order: that of its asset, and those that its wording gives it."""
    view = F.coalesce(X.search_view(text), F.lit(""))
    scope = X.scope(text)
    about = F.size(scope["population"]) + F.size(scope["care_settings"]) + F.size(scope["inclusion_criteria"]) + F.size(scope["exclusion_criteria"]) > 0
    base = F.coalesce(*[F.when(asset.endswith(end), F.lit(role)) for end, role in BASE_ROLES.items()])
    found = [base, F.when(about, F.lit("APPLICABILITY")), F.when(view.rlike(X.THRESHOLD), F.lit("DOSE_OR_THRESHOLD")), F.when(view.rlike(X.EXCEPTION), F.lit("EXCEPTION_OR_CONTRAINDICATION")), F.when(view.rlike(X.MONITORING), F.lit("MONITORING"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def classified(rows: DataFrame, scope: str, ident: str, text: str, asset: str, table: str, replayed: str, order: list[Column]) -> DataFrame:
    """(scope, ident, ``disposition``, ``reasons``, ``roles``): APPROVE with roles or QUARANTINE with reasons.

    Of rows with the same search text in folded case the first stays: approved
    before others, then by ``order``, then by id; the rest are duplicates, found
    after classification. Null texts are judged as empty and are no duplicates.
    """
    why = reasons(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(asset), F.lit("")), F.col(table), F.coalesce(F.col(replayed), F.lit(False)))
    kept = rows.select(scope, ident, why.alias("why"), roles(F.col(text), F.coalesce(F.col(asset), F.lit(""))).alias("r"), F.sha2(X.fold_case(F.col(text)), 256).alias("print"), F.struct(*order).alias("o"))
    first = kept.where("print IS NOT NULL").groupBy(scope, "print").agg(F.min(F.struct((F.size("why") > 0).alias("bad"), F.col("o"), F.col(ident).alias("id"))).alias("first"))
    both = kept.join(first.select(scope, "print", F.col("first.id").alias("first_id")), [scope, "print"], "left")
    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col(ident))
    every = F.when(again, F.array_append("why", F.lit(DUPLICATE))).otherwise(F.col("why"))
    judged = both.withColumn("reasons", every)
    return judged.select(scope, ident, F.when(F.size("reasons") > 0, "QUARANTINE").otherwise("APPROVE").alias("disposition"), "reasons", F.when(F.size("reasons") == 0, F.col("r")).otherwise(F.array().cast("array<string>")).alias("roles"))


#: Words of a recommendation, and shapes of fragments. Fixed values.
DEONTIC = r"(?i)\b(?:recommend(?:s|ed)?|suggest(?:s|ed)?|should|may be|can be|must|offer(?:ed)?|is preferred|are preferred|initiat\w+|provid\w+)\b"
BULLET, SECTION, FOOTNOTE = r"^[•●▪\-–]", r"^\d+\.\d+", r"^[a-z] [A-Z]"
SHORTEST_STATEMENT = 120


def dropped_for(text: Column) -> Column:
    """The first reason why a statement isn't in the frame of graded recommendations; null if it is."""
    return (
        F.when(X.grade(text).isNull(), "not graded")
        .when(F.length(text) < SHORTEST_STATEMENT, "too short")
        .when(text.rlike(BULLET), "bullet fragment")
        .when(text.rlike(SECTION), "section heading")
        .when(text.rlike(FOOTNOTE), "footnote")
        .when(~text.rlike(DEONTIC), "no deontic verb")
    )


#: A line that opens a chapter, page numbers in Roman numerals before a text, and the grade that ends a recommendation. Fixed values.
CHAPTER, FOLIO = r"^Chapter ([0-9]+):\s*(.+?)(?:\s*\(continued\))?\s*$", r"^[ivxlcIVXLC]+\s+"
GRADED = r"(?i)\((strong|conditional) recommendation[,;]?\s*([^)]*?certainty[^)]*)\)"
LONGEST_HEADING = 80  # characters, exclusive


def statements(blocks: DataFrame, document: str, running: str = r"^$") -> DataFrame:
    """Statement-shaped blocks with the chapter and heading they stand under, and their grade: ``chapter_no``, ``chapter``, ``heading``, ``statement``, ``strength``, ``certainty``.

    ``blocks``: document, ``page``, ``block_no``, ``text``. ``running`` matches
    running heads, which are left out as empty blocks are. A chapter line ends
    the heading before it; a block of fewer than ``LONGEST_HEADING`` characters is
    a heading. Both are carried forward over pages, so a long document is never
    in one task.
    """
    text = F.regexp_replace(X.search_view(F.col("text")), FOLIO, "")
    kept = blocks.select(document, "page", "block_no", text.alias("t")).where((F.col("t") != "") & ~F.col("t").rlike(running))
    opens = F.col("t").rlike(CHAPTER)
    heads = ~opens & (F.length("t") < LONGEST_HEADING)
    marked = kept.withColumns({"_opens": opens, "_heads": heads, "_chapter": F.when(opens, F.col("t")), "_heading": F.when(opens, F.lit("")).when(heads, F.col("t"))})
    order = ["page", "block_no"]
    filled = R.fill_forward(R.fill_forward(marked, [document], order, "page", "_chapter", "_under"), [document], order, "page", "_heading", "heading")
    grade = lambda n: F.nullif(F.lower(F.regexp_extract("t", GRADED, n)), F.lit(""))
    return filled.where(~F.col("_opens") & ~F.col("_heads")).select(
        document,
        "page",
        "block_no",
        F.regexp_extract("_under", CHAPTER, 1).try_cast("int").alias("chapter_no"),
        F.regexp_extract("_under", CHAPTER, 2).alias("chapter"),
        F.nullif("heading", F.lit("")).alias("heading"),
        F.col("t").alias("statement"),
        grade(1).alias("strength"),
        grade(2).alias("certainty"),
    )

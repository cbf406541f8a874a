"""Deterministic variants of a question for more search lanes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korpuskel.functions import text as X

TERMINOLOGY, SAFETY = "EXACT_TERMINOLOGY", "SAFETY_QUERY"
SIDE, CLAUSE, VOCABULARY, TERM = "CONFLICT_SIDE", "POLARITY_CLAUSE", "CONTROLLED_VOCABULARY", "TERMINOLOGY_TERM"
MOST_LANES, MOST_CHARACTERS = 8, 8192
#: Patterns of the grammar of questions. Fixed values.
CODE = r"(?<![\p{L}\p{N}_.])(?:[A-Za-z][A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]+)+(?![\p{L}\p{N}_.])"
QUOTED = r"\"[^\"\r\n]{2,200}\"|'[^'\r\n]{2,200}'"
TERMINOLOGY_START = r"(?i)^\s*retrieve\s+the\s+source\s+(?:definition|mapping)(?:\s+or\s+(?:definition|mapping))?\s+for\s+these\s+exact\s+terms\s*:\s*"
CONFLICT_START = r"(?i)^\s*retrieve\s+both\s+source\s+passages\s+needed\s+to\s+inspect\s+a\s+potential\s+conflict\s*:\s*"
BOUNDARY = r"(?i)(?:[.;]|\b(?:but|however|unless|except|whereas)\b)"
POLARITY = r"(?i)\b(?:no|not|without|unless|except|contraindicat\w*|avoid\w*|must(?:n't|\s+not)|should(?:n't|\s+not)|do(?:n't|\s+not)|only\s+if|required\s+if|greater\s+than|less\s+than|at\s+least)\b"
#: Words added to a question that matches. Fixed values.
ADDED = {
    r"(?i)\b(?:applicab|eligib|population|who\s+should|when\s+should|indicat)": "applicability eligibility inclusion exclusion target population",
    r"(?i)\b(?:contraindicat|avoid|do\s+not|must\s+not|harm|adverse)": "contraindication avoid exclusion warning adverse effect",
    r"(?i)\b(?:dose|dosage|threshold|maximum|minimum|mg|ml)\b": "dose dosage threshold minimum maximum adjustment",
    r"(?i)\b(?:monitor|follow[- ]?up|surveillance|reassess|test\s+again)": "monitoring follow-up surveillance reassessment interval",
    r"(?i)\b(?:jurisdiction|country|national|regional|local)\b": "jurisdiction country national regional local applicability",
    r"(?i)\b(?:current|latest|fresh|updated|supersed|withdrawn|version)\b": "current latest update superseded withdrawn version effective date",
}
_BLANKS = " \t\n\r\f\x0b"


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def is_conflict(question: Column) -> Column:
    """The question asks for both sides of a conflict; false for null."""
    body = _trim(F.regexp_replace(question, CONFLICT_START, ""))
    return F.coalesce((body != _trim(question)) & body.contains(" | "), F.lit(False))


def expansions(question: Column, conflict_aware: bool = True) -> Column:
    """Variants as an array of (``lane``, ``kind``, ``origin``, ``text``), in order; empty for null and blank questions.

    Terminology: the question without its opening, its dotted codes together and
    one by one, what is quoted. Safety: the sides of a conflict and (with
    ``conflict_aware``) their clauses of polarity, then the question with words
    of a controlled vocabulary. A variant without a letter or digit, or equal to
    the question or to an earlier one but for case and blanks, is left out; at most ``MOST_LANES`` a
    kind, each at most ``MOST_CHARACTERS`` long.
    """
    kind = "array<struct<kind:string,origin:string,text:string>>"
    none = F.array().cast(kind)
    made = lambda k, o: lambda x: F.struct(F.lit(k).alias("kind"), F.lit(o).alias("origin"), x.alias("text"))
    one = lambda k, o, x: F.array(made(k, o)(x))

    stripped = _trim(F.regexp_replace(question, TERMINOLOGY_START, ""))
    codes = F.array_distinct(F.regexp_extract_all(question, F.lit(CODE), F.lit(0)))
    quoted = F.transform(F.array_distinct(F.regexp_extract_all(question, F.lit(QUOTED), F.lit(0))), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    terms = F.concat(
        F.when(stripped != _trim(question), one(TERMINOLOGY, TERM, stripped)).otherwise(none),
        F.when(F.size(codes) > 0, one(TERMINOLOGY, TERM, F.array_join(codes, " "))).otherwise(none),
        F.transform(codes, made(TERMINOLOGY, TERM)),
        F.transform(quoted, made(TERMINOLOGY, TERM)),
    )
    body = _trim(F.regexp_replace(question, CONFLICT_START, ""))
    sides = F.filter(F.transform(F.split(body, r" \| "), _trim), lambda x: x != "")
    clauses = F.flatten(F.transform(sides, lambda s: F.filter(F.transform(F.split(s, BOUNDARY), lambda c: F.trim(c, F.lit(" -"))), lambda c: (c != "") & c.rlike(POLARITY))))
    conflict = F.concat(F.transform(sides, made(SAFETY, SIDE)), F.transform(clauses, made(SAFETY, CLAUSE)) if conflict_aware else none)
    added = [F.when(question.rlike(p), one(SAFETY, VOCABULARY, F.concat(_trim(question), F.lit(f" {words}")))).otherwise(none) for p, words in ADDED.items()]
    every = F.concat(terms, F.when(is_conflict(question), conflict).otherwise(none), *added)

    short = lambda x: F.rtrim(F.substring(X.search_view(x), 1, MOST_CHARACTERS))
    clean = F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["origin"].alias("origin"), short(x["text"]).alias("text")))
    keyed = F.filter(clean, lambda x: x["text"].rlike(r"[\p{L}\p{N}]") & (X.fold_case(x["text"]) != X.fold_case(X.search_view(question))))
    first = F.aggregate(keyed, none, lambda acc, x: F.when(F.exists(acc, lambda y: X.fold_case(y["text"]) == X.fold_case(x["text"])), acc).otherwise(F.array_append(acc, x)))
    lane = lambda k, name: F.transform(F.slice(F.filter(first, lambda x: x["kind"] == k), 1, MOST_LANES), lambda x, i: F.struct(F.concat(F.lit(f"{name}-"), (i + 1).cast("string")).alias("lane"), x["kind"].alias("kind"), x["origin"].alias("origin"), x["text"].alias("text")))
    out = F.concat(lane(TERMINOLOGY, "exact-terminology"), lane(SAFETY, "safety-query"))
    return F.coalesce(F.when(_trim(question) != "", out), F.array().cast("array<struct<lane:string,kind:string,origin:string,text:string>>"))

"""Rules held against facts of which some are unknown: match, mismatch or unknown, with ordered reasons.

Unknown is a value of its own, never the null of SQL: every comparison is made
on coalesced arrays and explicit nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, UNKNOWN, MISMATCH = "MATCH", "UNKNOWN", "MISMATCH"
#: Measures that are related but can't stand for one another. Fixed values.
RELATED = {"CRCL": ["EGFR"], "EGFR": ["CRCL"]}
RULE = "struct<min_age:int,max_age:int,required:array<string>,excluded:array<string>,pregnancy_allowed:boolean,settings:array<string>,measurements:array<struct<concept:string,operator:string,value:double,unit:string>>>"
FACTS = "struct<age:int,conditions:array<string>,absent:array<string>,populations:array<string>,absent_populations:array<string>,setting:string,measurements:array<struct<concept:string,value:double,unit:string>>>"
_REASON = "array<struct<kind:string,text:string>>"


def _reason(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _list(column: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _text(number: Column) -> Column:
    """A number in as few characters as it needs."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", "")


def judged(rule: Column, facts: Column) -> Column:
    """(``status``, ``unknown``, ``mismatched``) of facts of type ``FACTS`` against a rule of type ``RULE``.

    Any mismatch gives MISMATCH, else anything unknown UNKNOWN, else MATCH. In
    order: age, required conditions, excluded conditions (each sorted),
    pregnancy, setting, measurements as the rule lists them. A condition neither
    present nor known to be absent is unknown, as is a measure in another unit or
    one for which only a related measure is given. A null rule matches; null
    facts know nothing. Of several measurements of a concept the last counts.
    """
    none = F.array().cast(_REASON)
    yes, no = _list(facts["conditions"]), _list(facts["absent"])
    age, low, high = facts["age"], rule["min_age"], rule["max_age"]
    aged = (
        F.when(low.isNull() & high.isNull(), none)
        .when(age.isNull(), F.array(_reason(UNKNOWN, F.lit("age not provided"))))
        .when(F.coalesce(age < low, F.lit(False)), F.array(_reason(MISMATCH, F.concat(F.lit("age below required minimum "), low.cast("string")))))
        .when(F.coalesce(age > high, F.lit(False)), F.array(_reason(MISMATCH, F.concat(F.lit("age above allowed maximum "), high.cast("string")))))
        .otherwise(none)
    )

    def condition(good: Column, bad: Column, wrong: str, open_: str):
        return lambda c: F.when(F.array_contains(good, c), F.lit(None).cast("struct<kind:string,text:string>")).when(F.array_contains(bad, c), _reason(MISMATCH, F.concat(F.lit(wrong), c))).otherwise(_reason(UNKNOWN, F.concat(F.lit(open_), c)))

    required = F.array_compact(F.transform(F.array_sort(_list(rule["required"])), condition(yes, no, "required condition absent: ", "required condition not established: ")))
    excluded = F.array_compact(F.transform(F.array_sort(_list(rule["excluded"])), condition(no, yes, "excluded condition present: ", "excluded condition not assessed: ")))
    pregnant = (
        F.when(F.coalesce(rule["pregnancy_allowed"], F.lit(True)), none)
        .when(F.array_contains(_list(facts["populations"]), "PREGNANCY"), F.array(_reason(MISMATCH, F.lit("pregnancy is excluded"))))
        .when(F.array_contains(_list(facts["absent_populations"]), "PREGNANCY"), none)
        .otherwise(F.array(_reason(UNKNOWN, F.lit("pregnancy status not established"))))
    )
    settings = _list(rule["settings"])
    placed = (
        F.when(F.size(settings) == 0, none)
        .when(facts["setting"].isNull(), F.array(_reason(UNKNOWN, F.lit("care setting not provided"))))
        .when(F.array_contains(settings, facts["setting"]), none)
        .otherwise(F.array(_reason(MISMATCH, F.concat(F.lit("care setting not allowed: "), facts["setting"]))))
    )
    given = _list(facts["measurements"], "array<struct<concept:string,value:double,unit:string>>")
    concepts = F.transform(given, lambda m: m["concept"])
    related = lambda c: F.array_sort(F.array_intersect(F.coalesce(*[F.when(c == k, F.array(*[F.lit(x) for x in v])) for k, v in RELATED.items()], F.array().cast("array<string>")), concepts))

    def measured(rule_m: Column) -> Column:
        c, op, bar = rule_m["concept"], rule_m["operator"], rule_m["value"]
        own = F.try_element_at(F.filter(given, lambda m: m["concept"] == c), F.lit(-1))
        value = own["value"]
        holds = F.when(op == "<", value < bar).when(op == "<=", value <= bar).when(op.isin("=", "=="), value == bar).when(op == ">=", value >= bar).when(op == ">", value > bar)
        return (
            F.when(~F.array_contains(concepts, c) & (F.size(related(c)) > 0), _reason(UNKNOWN, F.concat(c, F.lit(" required; "), F.array_join(related(c), ", "), F.lit(" is not interchangeable"))))
            .when(~F.array_contains(concepts, c), _reason(UNKNOWN, F.concat(c, F.lit(" not provided"))))
            .when(~own["unit"].eqNullSafe(rule_m["unit"]), _reason(UNKNOWN, F.concat(c, F.lit(" unit mismatch: expected "), F.coalesce(rule_m["unit"], F.lit("none")), F.lit(", received "), F.coalesce(own["unit"], F.lit("none")))))
            .when(holds.isNull(), _reason(UNKNOWN, F.concat(F.lit("unsupported operator: "), F.coalesce(op, F.lit("none")))))
            .when(~holds, _reason(MISMATCH, F.concat(c, F.lit(" does not satisfy "), op, F.lit(" "), _text(bar))))
        )

    measures = F.array_compact(F.when(F.size(given) >= 0, F.transform(_list(rule["measurements"], "array<struct<concept:string,operator:string,value:double,unit:string>>"), measured)))
    reasons = F.coalesce(F.concat(aged, required, excluded, pregnant, placed, measures), none)
    texts = lambda kind: F.transform(F.filter(reasons, lambda r: r["kind"] == kind), lambda r: r["text"])
    status = F.when(F.size(texts(MISMATCH)) > 0, MISMATCH).when(F.size(texts(UNKNOWN)) > 0, UNKNOWN).otherwise(MATCH)
    return F.struct(status.alias("status"), texts(UNKNOWN).alias("unknown"), texts(MISMATCH).alias("mismatched"))

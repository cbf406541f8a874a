"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formatting characters, as inside of a class: punctuation, separators, white space, control and
#: format characters, and the letters and marks that show nothing. Fixed values.
FORMATTING = r"\p{P}\p{Z}\p{Cc}\p{Cf}\s\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}"
#: Of these, the ones that make a text blank.
BLANK = r"\p{Z}\p{Cc}\p{Cf}\s\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}"
#: What stays of a text: other characters, and runs of digits with the formatting between digits.
CONTENT = rf"[^{FORMATTING}\p{{Nd}}]+|\p{{Nd}}+(?:[{FORMATTING}]+\p{{Nd}}+)*"
# The same classes among ASCII characters alone, which Java looks up in a table. Fixed values.
_PLAIN = r"\x00-\x20\x7F!\"#%&'()*,\-./:;?@\[\\\]_{}"


def _formatting_runs(members: str, digit: str) -> str:
    """Runs of formatting but for those between two digits; other characters fail at the first look."""
    return rf"(?=[{members}])(?:[{members}]++(?!{digit})|(?<!{digit}|[{members}])[{members}]++)"


_PLAIN_RUNS = _formatting_runs(_PLAIN, "[0-9]")
_ALL_RUNS = _formatting_runs(rf"{_PLAIN}[[^\x00-\x7F]&&[{FORMATTING}]]", r"\p{Nd}")
_NOT_PLAIN = r"[^\x00-\x7F]"
LINE_BREAK = r"\r\n|[\n\x{0B}\x{0C}\r\x{85}\x{2028}\x{2029}]"
_LINE_MARK = "\ue000"  # private use: no formatting character, so it stays
CELL = r"^[A-Z]{1,3}[0-9]+="

MAX_HOT_KEYS = 4096


def bare(text: Column) -> Column:
    """A text in upper case without formatting characters, but for those between two digits."""
    left = F.when(text.rlike(_NOT_PLAIN), F.regexp_replace(text, _ALL_RUNS, "")).otherwise(F.regexp_replace(text, _PLAIN_RUNS, ""))
    return F.upper(left)


def is_blank(text: Column) -> Column:
    """True for a null text and for one of white space and invisible characters only."""
    return F.coalesce(~text.rlike(f"[^{BLANK}]"), F.lit(True))


def bare_rows(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``bare`` of ``text`` as ``out``; if each non-blank line begins with a cell address and =, with its lines in order.

    The lines get a column of their own, so that they are made once.
    """
    lines = F.split(bare(F.regexp_replace(text, LINE_BREAK, _LINE_MARK)), _LINE_MARK)
    lined = df.withColumn("_lines", F.when(F.col(text).contains("="), F.filter(lines, lambda line: line != "")))
    cells = (F.size("_lines") > 1) & F.forall("_lines", lambda line: line.rlike(CELL))
    return lined.withColumn(out, F.when(cells, F.array_join(F.array_sort("_lines"), "")).otherwise(bare(F.col(text)))).drop("_lines")


def fingerprint(*texts: Column) -> Column:
    """128 bits of SHA-256 over texts; null differs from every string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def collapse(members: DataFrame, group: list[str], ident: str, total_rows: int, hot_rows: int = 100_000, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Groups of members with equal ``group`` columns: (groups, copies).

    groups: ``group``, ``kept`` (smallest ``ident``), ``n_copies`` (members,
    the kept one among them), for every group. copies: ``group``, ``kept`` and
    ``copy`` for each member but the kept one. ``ident`` is unique in a group;
    rows with a null ``ident`` or a null in ``group`` are left out.

    Exact partial counts find the hot keys, those of more than ``hot_rows``
    members (raised so that there are at most ``MAX_HOT_KEYS``, which bounds
    what is broadcast). Hot keys are salted into a two-level aggregation, others
    take one shuffle; both choose the smallest identifier.
    """
    # Said for all columns: were it left to the joins, their sides would differ and the members be made once for each.
    members = members.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*group, ident]]))
    limit = max(hot_rows, -(-total_rows // MAX_HOT_KEYS))
    counted = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where(F.col("_n") > limit).select(*group)
    heads, cold = members.join(F.broadcast(hot), group, "left_semi"), members.join(F.broadcast(hot), group, "left_anti")

    salt = F.pmod(F.xxhash64(ident), F.lit(salts))
    salted = heads.groupBy(*group, salt.alias("_salt")).agg(F.min(ident).alias("kept"), F.count(F.lit(1)).alias("n_copies"))
    of_hot = salted.groupBy(*group).agg(F.min("kept").alias("kept"), F.sum("n_copies").alias("n_copies"))
    of_cold = cold.groupBy(*group).agg(F.min(ident).alias("kept"), F.count(F.lit(1)).alias("n_copies"))

    def spread(side: DataFrame, chosen: DataFrame, small: bool) -> DataFrame:
        several = chosen.where("n_copies > 1").select(*group, "kept")
        joined = side.join(F.broadcast(several) if small else several, group)
        return joined.where(F.col(ident) != F.col("kept")).select(*group, "kept", F.col(ident).alias("copy"))

    copies = spread(heads, of_hot, True).unionByName(spread(cold, of_cold, False))
    return reduce(DataFrame.unionByName, [of_hot, of_cold]), copies

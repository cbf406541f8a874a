"""Column functions for identifiers and row choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outer characters that never belong to an identifier: blank, tab, line feed.
OUTER_BLANKS = " \t\n"


def tidy(col: Column | str) -> Column:
    """An identifier in upper case without outer blanks, tabs and line feeds; null if nothing is left."""
    col = F.col(col) if isinstance(col, str) else col
    trimmed = F.upper(F.trim(col, F.lit(OUTER_BLANKS)))
    return F.when(trimmed != "", trimmed)


def latest_rows(df: DataFrame, keys: dict[str, Column], order: Column, values: dict[str, Column]) -> DataFrame:
    """One row per key: the values of the row with the largest ``order``.

    A single aggregation with map-side combine; no window, so a hot key never
    gathers its rows in one task. Ties in ``order`` go to the largest values in
    the order given (nulls smallest), so the result doesn't depend on row order.
    Rows with a null key are left out; a null ``order`` loses to any other.
    """
    known = df.select(*[v.alias(k) for k, v in keys.items()], order.alias("_o"), *[v.alias(f"_v_{k}") for k, v in values.items()])
    picked = F.max(F.struct(F.col("_o"), *[F.col(f"_v_{k}").alias(k) for k in values])).alias("_row")
    return known.dropna(subset=list(keys)).groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{k}").alias(k) for k in values])


def ordinals(df: DataFrame, key: Column, order: Column, *keep: str) -> DataFrame:
    """Dimension rows numbered from 0 by ``order`` then key: ``period``, ``ordinal`` and the kept columns.

    For small dimension tables only (one task numbers all rows).
    """
    named = df.select(key.alias("period"), order.alias("_order"), *keep).dropna(subset=["period", "_order"])
    named = named.groupBy("period").agg(F.min("_order").alias("_order"), *[F.min_by(c, "_order").alias(c) for c in keep if c != "_order"])
    number = F.row_number().over(Window.orderBy("_order", "period")) - 1
    return named.select("period", number.alias("ordinal"), *keep)


def canonical_list(ids: Column) -> Column:
    """A list of ids in order; a repeated id is an error when the column is run, null gives null."""
    return F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.raise_error(F.lit("a list repeats an id")).cast("array<string>")).otherwise(F.array_sort(ids))


def collection_name(prefix: Column, profile: Column, longest: int = 63) -> Column:
    """A name for a collection: the prefix in safe characters and a digest of the profile, no longer than allowed."""
    safe = F.regexp_replace(F.lower(prefix), r"[^a-z0-9]+", "-")
    return F.concat(F.substring(safe, 1, longest - 17), F.lit("-"), F.substring(F.sha2(profile, 256), 1, 16))

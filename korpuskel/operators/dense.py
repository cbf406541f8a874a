"""Vectors: exact nearest ones of a stated query set, validity, and differences between two stores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpuskel.operators.lanes import DIGITS, union

MAX_BLOCK_BYTES = 32 << 20  # of query vectors that are broadcast at a time


def length(v: Column) -> Column:
    """The length of a vector of doubles."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e * e))


def fault(v: Column, dimension: int) -> Column:
    """What is wrong with a vector: WRONG_DIMENSION (also null), NOT_FINITE (also with a null in it), ZERO_LENGTH; null if it is sound."""
    v = v.cast("array<double>")
    sound = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    some = F.exists(v, lambda e: e != 0)
    return F.when(F.coalesce(F.size(v) != dimension, F.lit(True)), "WRONG_DIMENSION").when(~sound, "NOT_FINITE").when(~some, "ZERO_LENGTH")


def sparse_fault(indices: Column, values: Column, dimension: int) -> Column:
    """What is wrong with a sparse vector: LENGTHS_DIFFER (also null or empty), BAD_INDEX (out of range or not rising), NOT_FINITE, ZERO_VALUE; null if it is sound."""
    n = F.size(indices)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i >= n) | (F.get(indices, i) > F.get(indices, i - 1)))
    inside = F.forall(indices, lambda i: F.coalesce((i >= 0) & (i < dimension), F.lit(False)))
    finite = F.forall(values, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return (
        F.when(F.coalesce((n != F.size(values)) | (n == 0), F.lit(True)), "LENGTHS_DIFFER")
        .when(~(inside & F.coalesce(rising, F.lit(False))), "BAD_INDEX")
        .when(~finite, "NOT_FINITE")
        .when(F.exists(values, lambda e: e == 0), "ZERO_VALUE")
    )


def close(left: Column, right: Column, relative: float = 1e-5, absolute: float = 1e-6) -> Column:
    """Two vectors of the same size agree in every number, relative to the larger or absolutely; false for nulls."""
    both = F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda a, b: F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))
    finite = F.forall(left.cast("array<double>"), lambda e: F.abs(e) < float("inf"))
    return F.coalesce((F.size(left) == F.size(right)) & finite & F.forall(both, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def _matrix(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are sound, their vectors) from flat Arrow values."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    starts = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(sizes == dimension)
    vectors = flat[starts[rows][:, None] + np.arange(dimension)[None, :]] if len(rows) else np.zeros((0, dimension))
    sound = np.isfinite(vectors).all(1) & vectors.any(1)
    return rows[sound], vectors[sound]


def nearest(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, dimension: int, metric: str = "cosine", itself: bool = False) -> DataFrame:
    """(``query_id``, ident, score): at least the ``k`` most similar others of each query; rank the union of the tasks.

    All sound vectors of ``dimension`` are held against all sound queries, by
    cosine or dot product; unsound ones (see ``fault``) are in no result. The ids
    may be of any type that sorts. Queries are broadcast in blocks of at most
    ``MAX_BLOCK_BYTES``; each block takes one pass over the vectors, which are not
    moved, and a task keeps the best of each query only. ``itself`` lets a query find its own id.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric is cosine or dot")
    per_block = max(1, MAX_BLOCK_BYTES // (8 * dimension))
    asked = queries.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dimension))
    blocks = max(1, -(-asked.count() // per_block))
    kind = vectors.schema[ident].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField(ident, kind), T.StructField("score", T.DoubleType())])
    source = vectors.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    number = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks))

    def passed(block: int) -> DataFrame:
        part = asked.where(number == block).toArrow().combine_chunks()
        rows, matrix = _matrix(part["v"].combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64())), dimension)
        ids = (part["id"].combine_chunks() if part.num_rows else part["id"].cast(part.schema.field("id").type).combine_chunks()).take(pa.array(rows, pa.int64()))
        sent = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            if metric == "cosine":
                q = q / np.linalg.norm(q, axis=1, keepdims=True)
            floor, held = np.full(len(q), -np.inf), []
            for whole in batches:
                for start in range(0, whole.num_rows, max(1, (1 << 21) // max(1, len(q)))):
                    batch = whole.slice(start, max(1, (1 << 21) // max(1, len(q))))
                    rows, m = _matrix(batch.column(1), dimension)
                    if not len(rows) or not len(q):
                        continue
                    if metric == "cosine":
                        m = m / np.linalg.norm(m, axis=1, keepdims=True)
                    own = batch.column(0).take(pa.array(rows))
                    scores = np.round(m @ q.T, DIGITS) + 0.0
                    if not itself:
                        scores[_same(own, q_ids)] = -np.inf
                    least = np.maximum(floor, np.partition(scores, len(scores) - k, 0)[len(scores) - k]) if len(scores) > k else floor
                    doc, query = np.nonzero((scores >= least) & np.isfinite(scores))
                    held.append(pa.table({"query": query, "score": scores[doc, query], "id": own.take(pa.array(doc))}))
                    if sum(t.num_rows for t in held) > 50_000 + 4 * k * len(q):
                        held = [_shrunk(held, k, floor)]
            if held:
                best = _shrunk(held, k, floor)
                yield pa.RecordBatch.from_arrays([q_ids.take(best["query"].combine_chunks()), best["id"].combine_chunks(), best["score"].combine_chunks()], names=schema.names)

        return source.mapInArrow(run, schema)

    return union([passed(block) for block in range(blocks)])


def _same(ids: pa.Array, queries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells at which a row's id is that of the query."""
    place = np.asarray(pc.index_in(ids, queries).fill_null(-1))
    rows = np.flatnonzero(place >= 0)
    return rows, place[rows]


def _shrunk(parts: list[pa.Table], k: int, floor: np.ndarray) -> pa.Table:
    """The ``k`` best of each query by (score descending, id); ``floor`` gets the score of the last."""
    table = pa.concat_tables(parts).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = np.asarray(table["query"])
    place = np.arange(len(query)) - np.searchsorted(query, query)
    last = place == k - 1
    floor[query[last]] = np.asarray(table["score"])[last]
    return table.filter(pa.array(place < k))


def differences(expected: DataFrame, stored: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, ``difference``): UNEXPECTED, MISSING, DUPLICATE (stored twice or more) or VECTOR_MISMATCH between two stores of vectors.

    One aggregation by id over both sides; of several stored vectors the first in
    order is compared. Null ids are left out.
    """
    none = F.lit(None).cast(expected.schema[vector].dataType)
    both = expected.select(ident, F.col(vector).alias("_e"), none.alias("_s"), F.lit(0).alias("_n")).unionByName(stored.select(ident, none.alias("_e"), F.col(vector).alias("_s"), F.lit(1).alias("_n")))
    sides = both.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count_if(F.col("_n") == 0).alias("e"), F.sum("_n").alias("s"), F.min("_e").alias("_e"), F.min("_s").alias("_s"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("e") == 0, "UNEXPECTED"),
            F.when(F.col("s") == 0, "MISSING"),
            F.when((F.col("s") > 1) & (F.col("e") > 0), "DUPLICATE"),
            F.when((F.col("e") > 0) & (F.col("s") > 0) & ~close(F.col("_s"), F.col("_e")), "VECTOR_MISMATCH"),
        )
    )
    return sides.select(ident, F.explode(kinds).alias("difference"))


def sparse_products(docs: DataFrame, queries: DataFrame, scope: str, ident: str, query: str, rarity: bool = True) -> DataFrame:
    """(query, ident, score) of stored sparse vectors against sparse queries of their scope: the sum of the products of shared positions.

    Both sides: ``indices`` and ``values`` arrays. With ``rarity`` each product is
    weighed by ln(1 + (N - df + 0.5) / (df + 0.5)) over the scope's documents.
    Documents that share no position with a query give no row. Only postings of
    queried positions are shuffled; a pair comes out of each scope once.
    """
    pairs = F.explode(F.arrays_zip("indices", "values"))
    asked = queries.select(scope, query, pairs.alias("_p")).select(scope, query, F.col("_p.indices").alias("_t"), F.col("_p.values").cast("double").alias("_q"))
    held = docs.select(scope, ident, pairs.alias("_p")).select(scope, ident, F.col("_p.indices").alias("_t"), F.col("_p.values").cast("double").alias("_v"))
    mine = held.join(asked.select(scope, "_t").distinct(), [scope, "_t"], "left_semi")
    whole = docs.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    df = mine.groupBy(scope, "_t").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) if rarity else F.lit(1.0)
    weighed = asked.join(df, [scope, "_t"]).join(whole, scope).select(scope, query, "_t", (F.col("_q") * idf).alias("_w"))
    return mine.join(weighed, [scope, "_t"]).groupBy(query, ident).agg(F.round(F.sum(F.col("_v") * F.col("_w")), DIGITS).alias("score"))

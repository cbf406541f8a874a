"""Exact search of a stated query set against all documents, without all pairs.

The queries of a block are broadcast: their tokens by scope, their filters and
their hashed vectors. Documents are turned into compact postings where they are
read, of only those tokens that a query of their scope asks for; the rows that
count are chosen on these postings, so no text is shuffled. Scoring goes through
the documents once, in small products of documents and queries, and a task keeps
only the best of each query: what leaves it is in proportion to the queries, not
to the pairs. Query sets beyond ``QUERIES_PER_BLOCK`` take several passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpuskel.functions import text as X
from korpuskel.functions.keys import latest_rows
from korpuskel.session import cut

DIGITS = 9  # scores are compared rounded, so that the order of additions doesn't matter
QUERIES_PER_BLOCK = 4096
CELLS = 1 << 21  # documents x queries of one product
K1, B = 1.2, 0.75
VECTOR = 384  # of the hashed dense vectors
SPARSE, PRESENCE, PLAIN, DENSE = "sparse", "presence", "plain", "dense"


@dataclass
class Asked:
    """A block of queries as arrays. A pair is a (scope, token) that some query asks for."""

    ids: list
    scopes: list[str]
    of_scope: np.ndarray  # number of the scope of each query
    terms: list[str]
    pairs: np.ndarray  # scope number * number of terms + term number, in order
    starts: np.ndarray  # the queries of pair i are queries[starts[i] : starts[i + 1]]
    queries: np.ndarray
    filters: dict[str, list[list[str]]] = field(default_factory=dict)  # allowed values of each query, empty for all
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # unit length, or zero
    found: np.ndarray = field(default_factory=lambda: np.zeros(0))  # documents that hold the pair
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # documents with tokens, by scope
    mean_n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kind: T.DataType = field(default_factory=T.StringType)  # of the query ids


class Features(dict):
    """(position, sign) of a feature in a hashed vector; SHA-256 once a feature."""

    MOST = 1 << 20

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, feature: str) -> tuple[int, float]:
        if len(self) >= self.MOST:
            self.clear()
        digest = hashlib.sha256(feature.encode("utf-8", "replace")).digest()
        made = self[feature] = (int.from_bytes(digest[:8], "little") % self.dimension, -1.0 if digest[8] & 1 else 1.0)
        return made


def hashed_dense(words: list[str], features: Features) -> np.ndarray:
    """Signed counts of words (1) and of pairs of adjacent words (0.5), not yet of unit length."""
    out = np.zeros(features.dimension)
    for word in words:
        at, sign = features[f"u:{word}"]
        out[at] += sign
    for left, right in zip(words, words[1:], strict=False):
        at, sign = features[f"b:{left}\x1f{right}"]
        out[at] += sign * 0.5
    if words and not out.any():  # everything cancelled out
        out[features[f"fallback:{words[0]}"][0]] = 1
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    vectors = np.asarray(vectors, np.float64)  # an empty count has whole numbers
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def ask(queries: DataFrame, scope: str, query: str, text: str, filters: tuple[str, ...] = (), dense: bool = False) -> Iterator[Asked]:
    """The query set in blocks. ``filters`` are columns with arrays of allowed values; null and empty allow all.

    Queries with a null scope or id are left out; a repeated id is an error.
    """
    named = queries.where(F.col(query).isNotNull() & F.col(scope).isNotNull())
    blocks = max(1, -(-named.count() // QUERIES_PER_BLOCK))
    lists = [F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f"f_{f}") for f in filters]
    words = F.col("words") if dense else F.array().cast("array<string>")
    made = named.withColumn("words", X.words(F.col(text))) if dense else named
    chosen = made.select(F.col(query).alias("id"), F.col(scope).alias("scope"), F.array_distinct(X.tokens(F.col(text))).alias("terms"), words.alias("words"), *lists)
    for number in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks)) == number).orderBy("id").toArrow().combine_chunks()
        ids = part["id"].to_pylist()
        if len(set(ids)) != len(ids):
            raise ValueError("a query id is repeated")
        scopes = sorted(set(part["scope"].to_pylist()))
        of_scope = np.array([scopes.index(s) for s in part["scope"].to_pylist()], np.int64)
        flat = part["terms"].combine_chunks()
        asked = flat.flatten().to_pylist()
        terms = sorted(set(asked))
        at = {t: i for i, t in enumerate(terms)}
        owner = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(flat), np.int64))
        keys = of_scope[owner] * max(1, len(terms)) + np.array([at[t] for t in asked], np.int64)
        order = np.lexsort((owner, keys))
        pairs, counts = np.unique(keys, return_counts=True)
        vectors = np.zeros((len(ids), 0))
        if dense:
            known = Features(VECTOR)
            vectors = _unit(np.stack([hashed_dense(w, known) for w in part["words"].to_pylist()]).reshape(len(ids), VECTOR)) if ids else np.zeros((0, VECTOR))
        allowed = {f: part[f"f_{f}"].to_pylist() for f in filters}
        yield Asked(ids, scopes, of_scope, terms, pairs, np.concatenate([[0], np.cumsum(counts)]), owner[order], allowed, vectors, kind=queries.schema[query].dataType)


_NUMBERS = T.ArrayType(T.IntegerType())
_POSTINGS = [T.StructField(n, k) for n, k in (("_n", T.IntegerType()), ("_pairs", _NUMBERS), ("_tfs", _NUMBERS), ("_vector", T.BinaryType()))]
_UNACCENT = str.maketrans(X.ACCENTED, X.PLAIN)


def _vectors(codes: np.ndarray, doc: np.ndarray, n_docs: int, vocabulary: list[str], features: Features) -> np.ndarray:
    """``hashed_dense`` of many documents at once, in halves: their words as codes, document by document."""
    hashed = lambda names: [np.array(x) for x in zip(*[features[n] for n in names], strict=True)] if names else [np.zeros(0, np.int64), np.zeros(0)]
    at, sign = hashed([f"u:{w}" for w in vocabulary])
    near = doc[1:] == doc[:-1]
    pairs, of = np.unique((codes[:-1] * len(vocabulary) + codes[1:])[near], return_inverse=True)
    pair_at, pair_sign = hashed([f"b:{vocabulary[p // len(vocabulary)]}\x1f{vocabulary[p % len(vocabulary)]}" for p in pairs.tolist()])
    cell = np.concatenate([doc * VECTOR + at[codes], doc[1:][near] * VECTOR + pair_at[of]]).astype(np.int64)
    halves = np.bincount(cell, np.concatenate([2 * sign[codes], pair_sign[of]]), n_docs * VECTOR).reshape(n_docs, VECTOR)
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    for first in firsts[~halves[doc[firsts]].any(1)]:  # everything cancelled out
        halves[doc[first], features[f"fallback:{vocabulary[codes[first]]}"][0]] = 2
    return halves


def _packed(vectors: np.ndarray) -> pa.BinaryArray:
    """Rows of whole numbers as bytes: for each that isn't 0 its distance from the one before and its value, in several steps where a byte is too small."""
    row, at = np.nonzero(vectors)
    value = vectors[row, at].astype(np.int64)
    far = np.diff(at, prepend=0)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    far[starts] = at[starts]
    wide = far > 255
    row, far, value = (np.insert(x, np.flatnonzero(wide), v) for x, v in ((row, row[wide]), (far, 255), (value, 0)))
    after = np.flatnonzero(wide) + np.arange(1, wide.sum() + 1)
    far[after] -= 255
    steps = np.maximum(1, -(-np.abs(value) // 127))
    number = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    left = np.abs(np.repeat(value, steps)) - 127 * number
    pairs = np.stack([np.where(number == 0, np.repeat(far, steps), 0).astype(np.uint8), (np.sign(np.repeat(value, steps)) * np.minimum(left, 127)).astype(np.int8).view(np.uint8)], 1)
    ends = 2 * np.searchsorted(np.repeat(row, steps), np.arange(len(vectors) + 1))
    return pa.BinaryArray.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pairs.tobytes())])


def _unpacked(column: pa.BinaryArray) -> np.ndarray:
    """What ``_packed`` packed; rows of zeros for nulls."""
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, 2)
    row = np.repeat(np.arange(len(column)), np.diff(ends) // 2)
    far = np.cumsum(data[:, 0].astype(np.int64))
    base = np.concatenate([[0], far])[(ends[:-1] - ends[0]) // 2] if len(column) else far
    cell = row * VECTOR + far - base[row]
    return np.bincount(cell, data[:, 1].view(np.int8).astype(np.float64), len(column) * VECTOR).reshape(len(column), VECTOR)


def postings(docs: DataFrame, scope: str, text: str, asked: Asked, dense: bool = False) -> DataFrame:
    """``docs`` without the text, with the number of its tokens, its postings of asked pairs, and its hashed vector, packed, in halves.

    Words are made in the JVM; forms without accents, numbers and counts a batch
    at a time, by the batch's vocabulary. Documents of scopes that nobody asks
    about have their size only.
    """
    kept = [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast(replace(asked, filters={}, vectors=np.zeros((0, 0))))
    source = docs.select(*kept, X.words(F.col(text)).alias("_words"))
    schema = T.StructType([*[docs.schema[c] for c in kept], *_POSTINGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        terms, scopes, n_terms, n_pairs = pa.array(a.terms, pa.string()), pa.array(a.scopes, pa.string()), max(1, len(a.terms)), max(1, len(a.pairs))
        features = Features(VECTOR)
        for batch in batches:
            rows = batch.num_rows
            doc = np.repeat(np.arange(rows), np.asarray(pc.list_value_length(batch.column("_words")).fill_null(0), np.int64))
            encoded = pc.dictionary_encode(batch.column("_words").flatten())
            codes, vocabulary = np.asarray(encoded.indices, np.int64), encoded.dictionary.to_pylist()
            bare = [w.translate(_UNACCENT) for w in vocabulary]
            differs = np.array([w != x for w, x in zip(vocabulary, bare, strict=True)], bool)
            twice = differs[codes]
            n = np.bincount(doc, minlength=rows) + np.bincount(doc[twice], minlength=rows)
            numbers = [np.asarray(pc.index_in(pa.array(v, pa.string()), terms).fill_null(-1), np.int64) for v in (vocabulary, bare)]
            of = np.concatenate([doc, doc[twice]])
            number = np.concatenate([numbers[0][codes], numbers[1][codes[twice]]])
            place = np.asarray(pc.index_in(batch.column(scope), scopes).fill_null(-1), np.int64)
            key = np.where((number >= 0) & (place[of] >= 0), place[of] * n_terms + number, -1)
            pair = np.minimum(np.searchsorted(a.pairs, key), n_pairs - 1)
            hit = (key >= 0) & (a.pairs[pair] == key) if len(a.pairs) else np.zeros(len(key), bool)
            both, tf = np.unique(of[hit] * n_pairs + pair[hit], return_counts=True)
            ends = pa.array(np.searchsorted(both // n_pairs, np.arange(rows + 1)), pa.int32())
            columns = [pa.array(n, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(both % n_pairs, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))]
            mine = place[doc] >= 0
            columns.append(_packed(_vectors(codes[mine], doc[mine], rows, vocabulary, features)) if dense and len(codes) else pa.nulls(rows, pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def weigh(index: DataFrame, scope: str, asked: Asked) -> Asked:
    """``asked`` with the statistics of the documents of ``index``: of the whole scope, before any filter."""
    found = index.select(F.explode("_pairs").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).toArrow()
    whole = index.where("_n > 0").groupBy(scope).agg(F.count(F.lit(1)).alias("docs"), F.avg("_n").alias("mean_n")).where(F.col(scope).isin(asked.scopes)).toArrow()
    counts, docs, mean_n = np.zeros(len(asked.pairs)), np.zeros(len(asked.scopes)), np.ones(len(asked.scopes))
    counts[np.asarray(found["p"], np.int64)] = np.asarray(found["n"])
    at = [asked.scopes.index(s) for s in whole[scope].to_pylist()]
    docs[at], mean_n[at] = np.asarray(whole["docs"]), np.asarray(whole["mean_n"])
    return replace(asked, found=counts, docs=docs, mean_n=mean_n)


class _Scorer:
    """Scores of documents against the queries of a block, lane by lane."""

    def __init__(self, asked: Asked, lanes: tuple[str, ...]):
        self.asked, self.lanes = asked, lanes
        per_scope = asked.docs[(asked.pairs // max(1, len(asked.terms))).astype(int)] if len(asked.pairs) else np.zeros(0)
        self.idf = np.log(1 + (per_scope - asked.found + 0.5) / (asked.found + 0.5))
        self.rarity = np.log(1 + per_scope / np.maximum(1, asked.found))
        self.codes: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        for name, lists in asked.filters.items():
            values = {v: i for i, v in enumerate(sorted({v for x in lists for v in x if v is not None}))}
            passes = np.zeros((len(values) + 1, len(lists)), bool)  # the last row is of other values and null
            for q, allowed in enumerate(lists):
                passes[[values[v] for v in allowed if v is not None], q] = True
                if not allowed:
                    passes[:, q] = True
            self.codes[name] = values, passes

    def parts(self, batches: Iterator[pa.RecordBatch], scope: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        """(documents, scores by lane): a row per document, a column per query; -inf where the lane doesn't have the document."""
        asked, n_queries = self.asked, len(self.asked.ids)
        rows = max(1, CELLS // max(1, n_queries))
        for whole in batches:
            for start in range(0, whole.num_rows if n_queries else 0, rows):
                batch = whole.slice(start, rows)
                place = np.asarray(pc.index_in(batch.column(scope), pa.array(asked.scopes, pa.string())).fill_null(-1), np.int64)
                allowed = place[:, None] == asked.of_scope[None, :]
                for name, (values, passes) in self.codes.items():
                    code = np.asarray(pc.index_in(batch.column(name), pa.array(list(values), pa.string())).fill_null(len(values)), np.int64)
                    allowed &= passes[code]
                yield batch, {lane: np.where(allowed, scores, -np.inf) for lane, scores in self._lanes(batch, place)}

    def _lanes(self, batch: pa.RecordBatch, place: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        asked, n_docs, n_queries = self.asked, batch.num_rows, len(self.asked.ids)
        if {SPARSE, PRESENCE, PLAIN} & set(self.lanes):
            lists = batch.column("_pairs")
            pair = np.asarray(lists.flatten(), np.int64)
            doc = np.repeat(np.arange(n_docs), np.asarray(pc.list_value_length(lists).fill_null(0), np.int64))
            tf = np.asarray(batch.column("_tfs").flatten(), np.float64)
            n = np.asarray(batch.column("_n"), np.float64)[doc]
            saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / asked.mean_n[place[doc]])) if len(doc) else tf
            reps = (asked.starts[pair + 1] - asked.starts[pair]) if len(pair) else np.zeros(0, np.int64)
            first = np.repeat(asked.starts[pair] - np.cumsum(reps) + reps, reps) if len(pair) else np.zeros(0, np.int64)
            cell = np.repeat(doc, reps) * n_queries + asked.queries[first + np.arange(len(first))]
            met = np.bincount(cell, minlength=n_docs * n_queries).reshape(n_docs, n_queries) > 0
            weights = {SPARSE: lambda: saturated * self.idf[pair], PRESENCE: lambda: self.rarity[pair], PLAIN: lambda: saturated}
            for lane in self.lanes:
                if lane in weights:
                    summed = np.bincount(cell, np.repeat(weights[lane](), reps), n_docs * n_queries).reshape(n_docs, n_queries)
                    yield lane, np.where(met, np.round(summed, DIGITS), -np.inf)
        if DENSE in self.lanes:
            vectors = _unit(_unpacked(batch.column("_vector")))
            scores = np.round(vectors @ asked.vectors.T, DIGITS) + 0.0
            some = vectors.any(1)[:, None] & asked.vectors.any(1)[None, :]
            yield DENSE, np.where(some, scores, -np.inf)


class _Best:
    """The ``k`` best of each query so far, by (score descending, id); beyond them nothing is kept."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.floor, self.held, self.parts = k, np.full(n_queries, -np.inf), 0, []

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        floor = self.floor
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, 0)[len(scores) - self.k])
        doc, query = np.nonzero((scores >= floor) & np.isfinite(scores))
        self.parts.append(pa.table({"query": query, "score": scores[doc, query], "id": ids.take(pa.array(doc))}))
        self.held += len(doc)
        if self.held > 50_000 + 4 * self.k * len(self.floor):
            self.shrink()

    def shrink(self) -> pa.Table:
        if not self.parts:
            return pa.table({"query": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.string())})
        table = pa.concat_tables(self.parts).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = np.asarray(table["query"])
        place = np.arange(len(query)) - np.searchsorted(query, query)
        table = table.filter(pa.array(place < self.k))
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[np.asarray(table["query"])[last]] = np.asarray(table["score"])[last]
        self.parts, self.held = [table], table.num_rows
        return table


def best(index: DataFrame, scope: str, ident: str, query: str, asked: Asked, lanes: tuple[str, ...], k: int) -> DataFrame:
    """(lane, query, ident, score): at least the ``k`` best of each query in each lane; rank the union of the tasks.

    Lanes: ``SPARSE`` weighs a token by ln(1 + (N - df + 0.5) / (df + 0.5)) and
    its saturated, length-normalised count, ``PLAIN`` by the count alone,
    ``PRESENCE`` by ln(1 + N / df); these have the documents of the query's scope
    that share a token with it. ``DENSE`` is the cosine of hashed vectors and has
    all of the scope. Repeated tokens of a query count once. Only documents that
    pass the query's filters come out.
    """
    sent = index.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("lane", T.StringType()), T.StructField(query, asked.kind), index.schema[ident], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value, lanes)
        tops = {lane: _Best(k, len(sent.value.ids)) for lane in lanes}
        for batch, scores in scorer.parts(batches, scope):
            for lane, matrix in scores.items():
                tops[lane].add(matrix, batch.column(ident))
        names = pa.array(sent.value.ids)
        for lane, top in tops.items():
            table = top.shrink()
            if table.num_rows:
                columns = [pa.array([lane] * table.num_rows, pa.string()), names.take(table["query"].combine_chunks()), table["id"].combine_chunks(), table["score"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return index.mapInArrow(run, schema)


def exact_ranks(index: DataFrame, scope: str, ident: str, query: str, asked: Asked, lanes: tuple[str, ...], wanted: dict[object, list]) -> DataFrame:
    """(lane, query, ident, rank) of the ``wanted`` documents of each query among all that the lane has, without listing them.

    One pass finds their scores, a second counts the better ones: (score, id) pairs
    before theirs. A wanted document that the lane doesn't have gives no row.
    ``wanted`` is bounded by the query set.
    """
    number = {name: i for i, name in enumerate(asked.ids)}
    targets = sorted((number[q], i) for q, ids in wanted.items() if q in number for i in set(ids))
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((asked, np.array([q for q, _ in targets], np.int64), [i for _, i in targets]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, of, names = sent.value
        lookup, mine = pa.array(names), {}
        for t, name in enumerate(names):
            mine.setdefault(name, []).append(t)
        for batch, scores in _Scorer(a, lanes).parts(batches, scope):
            own = batch.column(ident)
            for row in np.flatnonzero(np.asarray(pc.is_in(own, lookup))):
                for lane, matrix in scores.items():
                    have = [t for t in mine[own[int(row)].as_py()] if np.isfinite(matrix[row, of[t]])]
                    yield pa.RecordBatch.from_arrays([pa.array([lane] * len(have), pa.string()), pa.array(have, pa.int64()), pa.array(matrix[row, of[have]] if have else [], pa.float64())], names=["lane", "target", "score"])

    known = index.mapInArrow(scored, "lane string, target long, score double").collect()
    by_lane = {lane: sorted((r.target, r.score) for r in known if r.lane == lane) for lane in lanes}
    sent_scores = spark.sparkContext.broadcast(by_lane)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, of, names = sent.value
        wanted_of = {lane: np.array([t for t, _ in own], np.int64) for lane, own in sent_scores.value.items()}
        reached = {lane: np.array([s for _, s in own]) for lane, own in sent_scores.value.items()}
        ids = {lane: pa.array([names[t] for t, _ in own]) for lane, own in sent_scores.value.items()}
        totals = {lane: np.zeros(len(own), np.int64) for lane, own in wanted_of.items()}
        for batch, scores in _Scorer(a, lanes).parts(batches, scope):
            for lane, matrix in scores.items():
                if len(wanted_of[lane]):
                    columns = matrix[:, of[wanted_of[lane]]]
                    totals[lane] += (columns > reached[lane]).sum(0)
                    doc, target = np.nonzero(columns == reached[lane])
                    before = np.asarray(pc.less(batch.column(ident).take(pa.array(doc)), ids[lane].take(pa.array(target))), bool)
                    totals[lane] += np.bincount(target[before], minlength=len(totals[lane]))
        for lane, own in wanted_of.items():
            yield pa.RecordBatch.from_arrays([pa.array([lane] * len(own), pa.string()), pa.array(own), pa.array(totals[lane])], names=["lane", "target", "better"])

    summed = index.mapInArrow(counted, "lane string, target long, better long").groupBy("lane", "target").agg((F.sum("better") + 1).alias("rank"))
    schema = T.StructType([T.StructField("target", T.LongType()), T.StructField(query, asked.kind), index.schema[ident]])
    named = spark.createDataFrame([(t, asked.ids[q], i) for t, (q, i) in enumerate(targets)], schema)
    return summed.join(named, "target").select("lane", query, ident, "rank")


def union(parts: list[DataFrame]) -> DataFrame:
    """The blocks together."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search(
    docs: DataFrame, queries: DataFrame, scope: str, ident: str, query: str, lanes: tuple[str, ...], k: int, filters: tuple[str, ...] = (), counting: tuple[dict[str, Column], Column] | None = None
) -> DataFrame:
    """(lane, query, ident, score): at least the ``k`` best documents of each query in each lane.

    ``docs``: scope, ident, ``text``, a column per filter. ``queries``: scope,
    query, ``text``, and for each filter a column of its name with the allowed
    values. ``counting`` = (keys, order) chooses the row of each key with the
    largest order; without it every row is a document. Empty inputs give no rows.
    """
    return union([best(index, scope, ident, query, asked, lanes, k) for index, asked in indexes(docs, queries, scope, ident, query, lanes, filters, counting)])


def indexes(
    docs: DataFrame, queries: DataFrame, scope: str, ident: str, query: str, lanes: tuple[str, ...], filters: tuple[str, ...] = (), counting: tuple[dict[str, Column], Column] | None = None
) -> Iterator[tuple[DataFrame, Asked]]:
    """(index, block of queries) for each block; the index is written to the shared folder, as it is read for its statistics and for scoring."""
    dense = DENSE in lanes
    for asked in ask(queries, scope, query, "text", filters, dense):
        made = postings(docs, scope, "text", asked, dense)
        if counting:
            keys, order = counting
            values = {c: F.col(c) for c in made.columns if c.startswith("_") or c in filters}
            made = latest_rows(made, keys, order, values)
        index = cut(made)
        yield index, weigh(index, scope, asked)


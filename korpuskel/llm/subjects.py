"""Subject areas of documents.

A sentence is the unit that is about an area. Complement naive Bayes weighs the
words and word pairs of a sentence: the weight of a feature for an area compares
its frequency in everything with its frequency in everything but the area, so a
word that is usual anywhere weighs nothing. The model starts from labelled
documents, is refined by expectation-maximisation over the sentences of all
documents, and each area's score is turned into a posterior of its own by
calibration on the labelled documents. A document's areas are those with at
least a given share of its sentences about any area.

Texts are turned into hashed features once, in chunks of documents with their
features in order, written to the shared folder; each pass over them is one job
that returns sums of a fixed size, a few blocks for each of a bounded number of
tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpuskel.session import cut

FEATURES = 1 << 18
BINS, BIN_WIDTH = 32, 0.25  # of scores, for calibration; higher scores count as the highest
SELECT = 0.7  # a feature counts for an area from this log ratio on
SMOOTH = 1.0
CLEAR = 4.0  # log odds, in expectation steps, of no area against an area without evidence
CONTEXT = 4.0  # log odds, in expectation steps, that an area gains where its document is all about it
LONG = 64  # sentences; a longer document weighs as much as one of this length in expectation steps
MAX_LABELLED = 200_000  # documents; bounds what is broadcast

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"[-‐](?<=[^\W\d_][-‐])\r?\n\s*(?=[^\W\d_])")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CELL = re.compile(r"^[^\w\n]*[A-Za-z]{1,3}\d+\s*=", re.M)
_END = re.compile(r"[.!?…]+[\"»”’')\]]*(?:\s+|$)|;\s+(?=[^\Wa-zà-öø-ÿ\d])|\n\s*\n|[\r\n]+\s*(?=[^\Wa-zà-öø-ÿ\d]|[-*•·–]\s|[\"«“(\[])")
_CAPITAL = re.compile(r"(?<=[^\WA-ZÀ-ÖØ-Þ_])\s+(?=[A-ZÀ-ÖØ-Þ])")
_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = 16  # words, where nothing marks the ends of sentences


def sentences(text: str) -> list[str]:
    """The sentences of a text, tags and cell addresses taken out; mended where scanning or styling broke it."""
    text = _TAG.sub("\n\n", _CELL.sub("\n\n", _BROKEN.sub("", _INVISIBLE.sub("", text))))
    found = []
    for part in _END.split(text):
        words = part.count(" ") + part.count("\n") + 1
        if words <= 2 * _CHUNK + 8:
            found.append(part)
            continue
        pieces = _CAPITAL.split(part)  # its end marks are gone: a capital begins a sentence
        if len(pieces) * 5 > words or len(pieces) * 3 * _CHUNK < words:
            flat = part.split()
            pieces = [" ".join(flat[i : i + _CHUNK]) for i in range(0, len(flat), _CHUNK)]
        found += pieces
    return [s for s in found if s.strip()]


class _Codes(dict):
    """A number for each word, as bytes; words already seen are looked up."""

    MOST = 1 << 20

    def __init__(self) -> None:
        super().__init__({_GAP_MARK: _GAP})

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
            self[_GAP_MARK] = _GAP
        code = self[word] = zlib.crc32(word)
        return code


_GAP, _GAP_MARK = 1 << 32, b"\x01"  # between sentences; no word has it
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c == 1 else 32 for c in range(256))


_WORD_OR_MARK = re.compile("[^\\W\\d_]+|\x01")


def _words(found: list[str]) -> list[bytes]:
    """The words of sentences without marks, in lower case, with a mark after each sentence."""
    joined = " \x01 ".join([*found, ""])
    if joined.isascii():
        return joined.encode().translate(_LETTERS).split()
    return [w.encode("utf-8", "replace") for w in _WORD_OR_MARK.findall(joined.lower())]


CHUNK_CHARS, CHUNK_DOCS = 500_000, 2000  # of a chunk; a longer document is one of its own
_FIELDS = ["lengths", "labels", "features", "counts", "postings"]


def _postings(texts: list[str | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentences of each text, features in order, postings of each, their sentences) of some texts.

    Features are words and pairs of adjacent words of a sentence; one counts once in a sentence.
    """
    words, per_doc = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = sentences(text.replace("\x01", " "))
            per_doc[i] = len(found)
            words += _words(found)
    if not words:
        return per_doc.astype(np.int32), *[np.zeros(0, np.int32)] * 3
    one = np.array(list(map(codes.__getitem__, words)), np.uint64)
    gap = one == _GAP
    owner = np.cumsum(gap) - gap
    worded = np.zeros(int(per_doc.sum()), bool)
    worded[owner[~gap]] = True  # a sentence without a word is none
    renumbered = np.cumsum(worded) - 1
    doc = np.repeat(np.arange(len(texts)), per_doc)
    lengths = np.bincount(doc[worded], minlength=len(texts))
    joined = ~gap[1:] & ~gap[:-1]
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1))[joined]
    two ^= two >> np.uint64(29)
    ids = np.concatenate([one[~gap], two]) % np.uint64(FEATURES)
    of = renumbered[np.concatenate([owner[~gap], owner[1:][joined]])]
    n = max(1, int(lengths.sum()))
    pairs = np.sort(ids.astype(np.int64) * n + of)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    each = pairs // n
    starts = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(each)]]))
    return lengths.astype(np.int32), each[starts].astype(np.int32), counts.astype(np.int32), (pairs - each * n).astype(np.uint16 if n <= 1 << 16 else np.uint32)


def featurise(docs: DataFrame, ident: str, text: str, labels: DataFrame, areas: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Chunks of documents: ``ids``, ``lengths`` (sentences of each), ``labels`` (area numbers, null without), and the
    chunk's distinct ``features`` in order with the number and the sentences of their ``postings`` as packed numbers.

    Written to the shared folder. ``labels`` has ``ident`` and ``subject``; those of
    at most ``max_labelled`` documents, the ones of the smallest hashes, are used.
    Labels of other subjects are left out.
    """
    number = F.array_position(F.array(*[F.lit(a) for a in areas]), F.col("subject")).cast("int") - 1
    given = labels.select(ident, number.alias("_n")).where(F.col("_n") >= 0).groupBy(ident).agg(F.sort_array(F.collect_set("_n")).alias("labels"))
    bounded = given.orderBy(F.xxhash64(ident), ident).limit(max_labelled)
    source = docs.select(ident, text).join(F.broadcast(bounded), ident, "left").select(ident, text, "labels")
    numbers = T.ArrayType(T.IntegerType())
    kinds = [numbers, T.ArrayType(numbers), T.BinaryType(), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([T.StructField("ids", T.ArrayType(source.schema[ident].dataType)), *[T.StructField(n, k) for n, k in zip(_FIELDS, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            sizes = np.asarray(pa.compute.utf8_length(batch.column(1)).fill_null(0))
            start = 0
            while start < batch.num_rows:
                upto = np.searchsorted(np.cumsum(sizes[start : start + CHUNK_DOCS]), CHUNK_CHARS)
                part = batch.slice(start, max(1, int(upto)))
                start += part.num_rows
                lengths, features, counts, postings = _postings(part.column(1).to_pylist(), codes)
                ends = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column(0), pa.array(lengths), part.column(2))]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (features, counts, postings)]
                yield pa.RecordBatch.from_arrays([*lists, *packed], names=schema.names)

    return cut(source.mapInArrow(run, schema))


class _Chunk:
    """A row of ``featurise`` as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, areas: int):
        one = batch.slice(row, 1)
        self.ids = one.column("ids").flatten()
        self.lengths = np.asarray(one.column("lengths").flatten())
        self.docs, self.sentences = len(self.lengths), int(self.lengths.sum())
        self.features, self.counts, raw = (np.frombuffer(one.column(n)[0].as_py(), t) for n, t in (("features", np.int32), ("counts", np.int32), ("postings", np.uint8)))
        total = int(self.counts.sum())
        self.of = raw.view(np.uint16 if len(raw) == 2 * total else np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.lengths)
        labels = one.column("labels").flatten()
        owner = np.repeat(np.arange(self.docs), np.asarray(pa.compute.list_value_length(labels).fill_null(0)))
        self.labelled = np.asarray(labels.is_valid())
        self.given = np.zeros((self.docs, areas), np.float32)
        self.given[owner, np.asarray(labels.flatten(), dtype=np.int64)] = 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of the features of each sentence, by area."""
        own = weights[self.features]
        telling = own.any(1)
        of = self.of[np.repeat(telling, self.counts)]
        each = np.repeat(own[telling], self.counts[telling], 0)
        return np.stack([np.bincount(of, each[:, a], self.sentences) for a in range(weights.shape[1])], 1).astype(np.float32)

    def sums(self, share: np.ndarray) -> np.ndarray:
        """Rows of ``share`` (one a sentence) summed over the postings of each feature."""
        if not len(self.features):
            return np.zeros((0, share.shape[1]))
        starts = np.cumsum(self.counts) - self.counts
        return np.add.reduceat(share[self.of], starts, 0)


    def add_labelled(self, share: np.ndarray, total: np.ndarray) -> None:
        """Adds the shares of the sentences of labelled documents to the counts of their features; the others have none."""
        if not self.labelled.any():
            return
        mine = self.labelled[self.doc][self.of]
        per_feature = np.bincount(np.repeat(np.arange(len(self.features)), self.counts)[mine], minlength=len(self.features))
        used = per_feature > 0
        if used.any():
            counts = per_feature[used]
            total[self.features[used], : share.shape[1]] += np.add.reduceat(share[self.of[mine]], np.cumsum(counts) - counts, 0)


def _chunks(batches: Iterator[pa.RecordBatch], areas: int) -> Iterator[_Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Chunk(batch, row, areas)


@dataclass
class Model:
    """Weights of the features per area, and the calibration of each area's score."""

    areas: list[str]
    weights: np.ndarray  # feature, area
    slope: np.ndarray
    offset: np.ndarray
    moves: list[float] = field(default_factory=list)  # of the weights in each round, as a share of their sum

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.minimum(scores, BINS * BIN_WIDTH) * self.slope + self.offset)))


def weigh(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Complement weights from feature counts per area and overall; 0 for features that tell too little."""
    rest = total[:, None] - counts
    everywhere = np.log((total + SMOOTH) / (total.sum() + SMOOTH * len(total)))[:, None]
    elsewhere = np.log((rest + SMOOTH) / (rest.sum(0) + SMOOTH * len(total)))
    ratio = everywhere - elsewhere
    return np.where(ratio > SELECT, ratio, 0).astype(np.float32)


def _expect(scores: np.ndarray, given: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shares of the areas in each sentence (the rest is no area), from its score and its document.

    An area gains by the share that it has in the other sentences and the labels of the document.
    """
    share, gain = np.zeros_like(scores), np.float32(0)
    if not len(doc):
        return share
    starts = np.flatnonzero(np.diff(doc, prepend=-1))  # a document's sentences stand together
    filled = doc[starts]
    for _ in range(2):
        odds = scores - np.float32(CLEAR) + gain
        top = np.maximum(odds.max(1, keepdims=True), 0)
        share = np.exp(odds - top)
        share /= share.sum(1, keepdims=True) + np.exp(-top)
        inside = given.copy()
        inside[filled] += np.add.reduceat(share, starts, 0)
        inside = inside[doc] - share
        gain = np.log1p(np.float32(np.expm1(CONTEXT)) * inside / (0.5 + inside.sum(1, keepdims=True)))
    return share


BLOCK = 4096  # features whose sums travel together
MOST_BLOCKS = 64  # added up in one task


def _gathered(features: DataFrame) -> DataFrame:
    """The chunks in a few tasks a core: each gives out sums of a fixed size, so tasks must not grow with the data."""
    return features.coalesce(4 * features.sparkSession.sparkContext.defaultParallelism)


def _counts(features: DataFrame, areas: int, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts per area, and sums over all sentences: shares of the areas, weights, number.

    Without a model the areas of a document are its labels in equal parts, and
    each document weighs as one sentence, lest a long one with a wrong label
    prevail; two more columns then have the counts of all documents, so weighed
    and weighed as in the steps with a model.
    """
    sent = features.sparkSession.sparkContext.broadcast(model)
    width = areas + 2 * (model is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        total, sums = np.zeros((FEATURES, width)), np.zeros(areas + 2)
        for chunk in _chunks(batches, areas):
            length = chunk.lengths[chunk.doc]
            weight = usual = np.minimum(1, LONG / length).astype(np.float32)
            if model is None:
                weight = (1 / length).astype(np.float32)
                share = (chunk.given / np.maximum(1, chunk.given.sum(1, keepdims=True)))[chunk.doc] * weight[:, None]
                chunk.add_labelled(share, total)
                total[chunk.features, areas:] += chunk.sums(np.column_stack([weight, usual]))
            else:
                share = _expect(chunk.scores(model.weights), chunk.given, chunk.doc) * weight[:, None]
                total[chunk.features] += chunk.sums(share)
            sums += [*share[:, :areas].sum(0, dtype=np.float64), weight.sum(dtype=np.float64), chunk.sentences]
        used = [i for i in range(0, FEATURES, BLOCK) if total[i : i + BLOCK].any()]
        blocks = [total[i : i + BLOCK].astype(np.float32).tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([sums.tobytes(), *blocks], pa.binary())], names=["at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        kind = np.float64 if table["at"][0].as_py() < 0 else np.float32
        summed = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in table["sums"])
        return pa.Table.from_arrays([table["at"].slice(0, 1).combine_chunks(), pa.array([summed.astype(kind).tobytes()], pa.binary())], names=["at", "sums"])

    schema = "at int, sums binary"
    gathered = _gathered(features)
    parts = gathered.mapInArrow(run, schema)
    if (tasks := gathered.rdd.getNumPartitions()) > MOST_BLOCKS:  # else one block of all tasks might not fit a task
        salt = F.spark_partition_id() % (tasks // MOST_BLOCKS + 1)
        parts = parts.withColumn("salt", salt).groupBy("at", "salt").applyInArrow(lambda t: add(t.drop(["salt"])), schema)
    blocks = parts.groupBy("at").applyInArrow(add, schema).toArrow().to_pylist()
    sent.unpersist()
    counts, sums = np.zeros((FEATURES, width)), np.zeros(areas + 2)
    for block in blocks:
        values = np.frombuffer(block["sums"], np.float64 if block["at"] < 0 else np.float32)
        if block["at"] < 0:
            sums = values.copy()
        else:
            counts[block["at"] : block["at"] + BLOCK] = values.reshape(-1, width)
    return counts, sums


def _calibrate(features: DataFrame, model: Model) -> Model:
    """Slope and offset of each area's posterior, from scores of the sentences of labelled documents.

    A sentence counts for an area if its document has the label, against it otherwise.
    """
    areas = len(model.areas)
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((areas, 2, BINS))
        for chunk in _chunks(batches, areas):
            mine = chunk.labelled[chunk.doc]
            if mine.any():
                given = chunk.given[chunk.doc[mine]].astype(int)
                place = np.clip(chunk.scores(sent.value.weights)[mine] / BIN_WIDTH, 0, BINS - 1).astype(int)
                for a in range(areas):
                    np.add.at(seen[a], (given[:, a], place[:, a]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(seen.size), pa.int32()), pa.array(seen.ravel())], names=["cell", "n"])

    rows = _gathered(features).mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sent.unpersist()
    seen = np.zeros(areas * 2 * BINS)
    seen[rows["cell"]] = rows["n"]
    against, for_it = seen.reshape(areas, 2, BINS).transpose(1, 0, 2)
    x = (np.arange(BINS) + 0.5) * BIN_WIDTH
    for a in range(areas):
        model.slope[a], model.offset[a] = _logistic(x, for_it[a], against[a])
    return model


def _logistic(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, drawn to a usual one where data are few."""
    usual = np.array([1.0, -CLEAR])
    pull = np.array([4.0, 1.0])
    w = usual.copy()
    design = np.column_stack([x, np.ones_like(x)])
    n = yes + no
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (yes - n * p) - pull * (w - usual)
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        w = w + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return max(0.2, float(w[0])), float(w[1])


def train(features: DataFrame, areas: list[str], rounds: int = 5, tolerance: float = 0.01) -> Model:
    """The model from all rows of a frame of ``featurise``.

    The counts of the labelled documents, scaled up to the corpus, are held
    against the counts of the whole corpus from the start: a word that is rare
    among labels but usual elsewhere (as all words of a rare language are)
    tells nothing. Expectation-maximisation ends after ``rounds``, or where the
    weights move by less than ``tolerance`` of their sum.
    """
    n = len(areas)
    counts, sums = _counts(features, n, None)
    counts, total, usual = counts[:, :n], counts[:, n], counts[:, n + 1]
    longer = sums[-1] / max(1.0, sums[-2])  # as if all documents had the mean length
    scale = longer * sums[-2] / max(1.0, sums[:-2].sum())
    first = total * longer
    model = Model(areas, weigh(np.minimum(counts * scale, first[:, None]), first), np.ones(n), np.full(n, -CLEAR))
    for _ in range(rounds):
        before = model.weights
        counts, _ = _counts(features, n, model)
        model.weights = weigh(counts, usual)
        moved = np.abs(model.weights - before).sum() / max(1.0, np.abs(before).sum())
        model.moves.append(float(moved))
        if moved < tolerance:
            break
    return _calibrate(features, model)


def areas_of(features: DataFrame, model: Model, name: str, least_share: float = 0.25) -> DataFrame:
    """The document's id as ``name``, ``subject``, ``share``, ``n_sentences``, ``n_about`` for each area of a document.

    A sentence is about the areas with a posterior of one half or more. ``share``
    is of the ``n_about`` sentences that are about any area. Documents about no
    area give no row.
    """
    ident = features.schema["ids"].dataType.elementType
    sent = features.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("n_about", T.IntegerType())]
    schema = T.StructType([T.StructField(name, ident), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for chunk in _chunks(batches, len(model.areas)):
            per, any_area, _ = _about(chunk, model)
            share = per / np.maximum(1, any_area)[:, None]
            row, area = np.nonzero((share >= least_share) & (per > 0))
            yield pa.RecordBatch.from_arrays(
                [chunk.ids.take(pa.array(row)), pa.array([model.areas[a] for a in area], pa.string()), pa.array(share[row, area]), pa.array(chunk.lengths[row], pa.int32()), pa.array(any_area[row].astype(np.int32))],
                names=schema.names,
            )

    return features.mapInArrow(run, schema)


def _about(chunk: _Chunk, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Sentences of each document about each area and about any, and the number about none."""
    about = model.posteriors(chunk.scores(model.weights)) >= 0.5
    per = np.stack([np.bincount(chunk.doc, about[:, a], chunk.docs) for a in range(len(model.areas))], 1)
    return per, np.bincount(chunk.doc, about.any(1), chunk.docs), int((~about.any(1)).sum())


def make_up(features: DataFrame, model: Model, least_share: float = 0.25) -> DataFrame:
    """``subject``, ``n_documents``, ``n_sentences`` of each area, and of none (a null subject).

    All sentences about an area count; a document counts for the areas with
    ``least_share`` of its sentences about any area. The row of none has the
    documents and the sentences that are about no area. An area without any
    sentence gives a row of zeros. A sentence about two areas counts for both.
    """
    n = len(model.areas)
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = sent.value, np.zeros((2, n + 1), np.int64)
        for chunk in _chunks(batches, n):
            per, any_area, none = _about(chunk, model)
            share = per / np.maximum(1, any_area)[:, None]
            total[0] += [*((share >= least_share) & (per > 0)).sum(0), (any_area == 0).sum()]
            total[1] += [*per.sum(0).astype(np.int64), none]
        yield pa.RecordBatch.from_arrays([pa.array([*model.areas, None], pa.string()), pa.array(total[0]), pa.array(total[1])], names=names)

    names = ["subject", "n_documents", "n_sentences"]
    summed = features.mapInArrow(run, "subject string, n_documents long, n_sentences long")
    return summed.groupBy("subject").agg(*[F.sum(c).alias(c) for c in names[1:]])

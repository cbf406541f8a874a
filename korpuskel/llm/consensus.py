"""Consensus from several annotators' labels.

Latent ability-difficulty estimation. Given the true level k of an item, an
annotator answers level l with a probability in proportion to
exp(easiness_item * skill_annotator[k, l]): a skill matrix with a high diagonal
is an able annotator, a flat one a guesser, and a shifted, constant or reversed
one a biased annotator whose answers still tell something; easiness (the
inverse of difficulty) near 0 makes everybody guess. With skills that are a
number times the unit matrix this is the usual one-number ability model, which
throws away what biased annotators tell.

Gradient expectation-maximisation fits both jointly. An iteration is one Spark
job over all items: a task finds the level posteriors and the easiness of its
items from the current skills and adds up skill gradients and curvatures, which
are summed per annotator. Only these sums, of fixed size per annotator, reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpuskel.functions.keys import latest_rows
from korpuskel.session import cut

#: The model on the driver and in the tasks has this many annotators at most.
MAX_ANNOTATORS = 1_000_000
PRIOR_SKILL = 1.5  # of the right level, in the skill an annotator starts from
PRIOR_WEIGHT = 1.0  # pull of a skill towards it
EASINESS_SPREAD = 0.3  # standard deviation of the logarithm of easiness


@dataclass
class Annotators:
    """The fitted model."""

    levels: list[str]
    names: list[str]
    skills: np.ndarray  # annotator, true level, answer
    shares: np.ndarray  # of the true levels
    answers: np.ndarray = field(default_factory=lambda: np.zeros(0))  # labels given at each level
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # labels given by each annotator

    def chances(self) -> np.ndarray:
        """Probability of each answer given each true level, on an item of usual difficulty."""
        return _softmax(self.skills)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def by_item(decisions: DataFrame, item: str, annotator: str, level: str, levels: list[str]) -> DataFrame:
    """One row per item: ``item`` and ``votes``, an array of (annotator, level number).

    ``decisions`` has one row per item and annotator at most, so an array is no
    longer than there are annotators. Rows with a null or unknown level are left out.
    """
    number = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(level)).cast("int") - 1
    known = decisions.select(item, annotator, number.alias("_l")).where((F.col("_l") >= 0) & F.col(annotator).isNotNull() & F.col(item).isNotNull())
    return known.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(F.col(annotator).alias("who"), F.col("_l").alias("level")))).alias("votes"))


def _sums(index: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``weights`` summed by index: one count a column, far faster than adding in place."""
    flat = weights.reshape(len(index), -1)
    return np.stack([np.bincount(index, flat[:, j], n) for j in range(flat.shape[1])], 1).reshape(n, *weights.shape[1:])


def _infer(who: np.ndarray, level: np.ndarray, owner: np.ndarray, n: int, skills: np.ndarray, shares: np.ndarray, vote_start: bool, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, easiness, answer chances per vote) of n items from their votes."""
    k = len(shares)
    mine = skills[who]
    ease = np.zeros(n)
    if vote_start:
        post = 0.1 + np.bincount(owner * k + level, minlength=n * k).reshape(n, k)
        return post / post.sum(1, keepdims=True), np.ones(n), _softmax(mine)
    take = level[:, None, None]
    chosen = np.take_along_axis(mine, take, 2)[:, :, 0]
    for step in range(rounds + 1):
        b = np.exp(ease)[owner]
        q = _softmax(mine * b[:, None, None])
        said = np.take_along_axis(q, take, 2)[:, :, 0]
        post = _softmax(np.log(shares) + _sums(owner, np.log(np.maximum(said, 1e-12)), n))
        if step == rounds:
            return post, np.exp(ease), q
        # Gradient and curvature of the expected log likelihood in the logarithm of easiness.
        weighed = q * mine
        mean = weighed.sum(2)
        spread = (weighed * mine).sum(2) - mean * mean
        p = post[owner]
        slope = np.bincount(owner, (p * (chosen - mean)).sum(1) * b, n)
        bend = np.bincount(owner, (p * spread).sum(1) * b * b, n)
        pull = 1 / EASINESS_SPREAD**2
        ease = np.clip(ease + np.clip((slope - pull * ease) / (bend + pull), -0.5, 0.5), -2, 1)
    raise AssertionError


def _flat(batch: pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    votes = batch.column("votes")
    flat = votes.flatten()
    who = np.asarray(pa.compute.index_in(flat.field("who"), names).fill_null(-1))
    level = np.asarray(flat.field("level"))
    sizes = np.asarray(pa.compute.list_value_length(votes).fill_null(0))
    return who, level, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def _climb(skills: np.ndarray, start: np.ndarray, counts: np.ndarray, steps: int = 40) -> np.ndarray:
    """Gradient steps to the best skills for equal difficulty, where the expected answers (annotator, true level, answer) tell all.

    The prior counts as two answers given as the skills at the start have it.
    """
    told = counts + 2 * _softmax(start)
    given = told.sum(2, keepdims=True)
    for _ in range(steps):
        q = _softmax(skills)
        skills = skills + np.clip((told - given * q) / (given * q * (1 - q) + 0.1), -1, 1)
    return skills - skills.mean(2, keepdims=True)


def fit(items: DataFrame, levels: list[str], iterations: int = 14, tolerance: float = 0.02) -> Annotators:
    """Skills of all annotators from all items (a frame of ``by_item``, best written before).

    Gradient expectation-maximisation: an expectation over all items, then
    gradient steps on the skills; in the first two, where difficulty is still
    about equal, to the optimum. It ends where no skill moves by more than
    ``tolerance`` (the median of the annotators' largest moves), at the latest
    after ``iterations``. No items give a model without annotators and equal shares.
    """
    k = len(levels)
    spark = items.sparkSession
    who = items.select(F.explode("votes.who").alias("who")).groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    found = who.orderBy("who").limit(MAX_ANNOTATORS + 1).toPandas()
    if len(found) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    names = found["who"].tolist()
    start = np.tile(np.eye(k) * PRIOR_SKILL, (len(names), 1, 1))
    model = Annotators(levels, names, start.copy(), np.full(k, 1 / k), np.zeros(k), found["n"].to_numpy())
    if not names:
        return model
    schema = "who int, sums array<double>"
    for step in range(iterations):
        sent = spark.sparkContext.broadcast((names, model.skills, model.shares))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent, first=step == 0) -> Iterator[pa.RecordBatch]:
            names, skills, shares = sent.value
            lookup, a, k = pa.array(names), len(names), len(shares)
            total = np.zeros((a + 1, 3, k, k))
            for batch in batches:
                who, level, owner, n = _flat(batch, lookup)
                if not len(who):
                    continue
                post, ease, q = _infer(who, level, owner, n, skills, shares, first)
                p, b = post[owner], ease[owner]
                pb = p * b[:, None]
                answer = who * k + level
                chosen = lambda w, answer=answer: np.stack([np.bincount(answer, w[:, t], a * k) for t in range(k)], 1).reshape(a, k, k).transpose(0, 2, 1)
                total[:-1, 0] += chosen(pb) - _sums(who, pb[:, :, None] * q, a)
                total[:-1, 1] += _sums(who, (pb * b[:, None])[:, :, None] * q * (1 - q), a)
                total[:-1, 2] += chosen(p)
                total[-1, 0, 0] += post.sum(0)
                total[-1, 0, 1] += np.bincount(level, minlength=k)
            used = np.flatnonzero(total.any((1, 2, 3)))
            cells = total[0].size
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * cells), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), flat], names=["who", "sums"])

        cells = 3 * k * k
        parts = items.select("votes").mapInArrow(sums, schema)
        added = parts.groupBy("who").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(cells)]).alias("sums")).toArrow().combine_chunks()
        sent.unpersist()
        total = np.zeros((len(names) + 1, 3, k, k))
        if added.num_rows:
            total[np.asarray(added["who"])] = np.asarray(added["sums"].combine_chunks().flatten()).reshape(-1, 3, k, k)
        model.answers = total[-1, 0, 1]
        model.shares = (total[-1, 0, 0] + 1) / (total[-1, 0, 0] + 1).sum()
        slope, bend, counts = total[:-1, 0], total[:-1, 1], total[:-1, 2]
        before = model.skills
        if step < 2:
            model.skills = _climb(before, start, counts)
            continue
        pull = PRIOR_WEIGHT * (before - start + start.mean(2, keepdims=True))
        model.skills = before + np.clip((slope - 0.1 * pull) / (bend + 0.1 * PRIOR_WEIGHT + 0.5), -1, 1)
        if np.median(np.abs(model.skills - before).max((1, 2))) < tolerance:
            break
    return model


def consensus(items: DataFrame, item: str, model: Annotators) -> DataFrame:
    """Per item: ``level``, ``probability`` of it, ``easiness``, ``n_labels``, ``agreement``.

    agreement is the share of agreeing pairs of labels corrected for the share
    expected by chance from all labels; null for fewer than two labels. Of
    equally probable levels the first in the model's order is given.
    """
    key = items.schema[item]
    sent = items.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("level", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("easiness", T.DoubleType()), T.StructField("n_labels", T.IntegerType()), T.StructField("agreement", T.DoubleType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lookup = pa.array(m.names, pa.string())
        share = m.answers / max(1.0, m.answers.sum())
        chance = float((share**2).sum())
        for batch in batches:
            who, level, owner, n = _flat(batch, lookup)
            post, ease, _ = _infer(who, level, owner, n, m.skills, m.shares, False)
            votes = np.bincount(owner * len(m.levels) + level, minlength=n * len(m.levels)).reshape(n, -1).astype(float)
            size = votes.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                agree = ((votes * (votes - 1)).sum(1) / (size * (size - 1)) - chance) / (1 - chance)
            best = np.round(post, 9).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(item), pa.array([m.levels[i] for i in best], pa.string()), pa.array(post[np.arange(n), best]), pa.array(ease), pa.array(size, pa.int32(), safe=False), pa.array(agree, mask=~np.isfinite(agree))],
                names=[item, *[f.name for f in fields]],
            )

    return items.select(item, "votes").mapInArrow(judge, T.StructType([key, *fields]))


def reliability(spark: SparkSession, model: Annotators) -> DataFrame:
    """Per annotator: ``n_labels``, ``accuracy`` (chance of the right level), ``skill`` (accuracy corrected for
    chance agreement) and ``information`` (bits a label tells about the true level, also if it is biased)."""
    rows = []
    for name, n, q in zip(model.names, model.labels, model.chances(), strict=True):
        joint = model.shares[:, None] * q
        given = joint.sum(0)
        accuracy, chance = float(np.trace(joint)), float((model.shares * given).sum())
        bits = float((joint * np.log2(np.maximum(joint, 1e-300) / np.maximum(model.shares[:, None] * given, 1e-300))).sum())
        rows.append((name, int(n), accuracy, (accuracy - chance) / max(1e-9, 1 - chance), bits))
    return spark.createDataFrame(rows, "annotator string, n_labels long, accuracy double, skill double, information double")


def prepared(decisions: DataFrame, item: str, annotator: str, level: Column, order: Column, levels: list[str]) -> DataFrame:
    """``by_item`` of the latest decision of each annotator on each item, written to the shared folder."""
    latest = latest_rows(decisions, {item: F.col(item), annotator: F.col(annotator)}, order, {"_level": level})
    return cut(by_item(latest, item, annotator, "_level", levels))

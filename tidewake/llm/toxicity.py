"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its lower-cased words and all runs of 3 to 5 characters of them, word edges counted as
characters, each hashed to 32 bits; a text is the set of its terms, however long it is. The machine scores a text by a
bias, a weight for each term and, for each pair of terms, the product of their factors: an insult together with a group
that is mentioned may weigh more than both do alone. The pairs cost no more than the terms, as the sum over pairs is
half the squared sum of factors less the sum of their squares.

Which terms it knows and what they weigh is learned from a bounded sample of labelled rows (max_labelled): Spark counts
each term of the sample by class, the max_terms terms with the largest likelihood ratio G^2 (min_gain at least) are kept,
and their weights are fitted in numpy by stochastic gradient descent with a step for each weight (AdaGrad). Held-out rows are never read.
The model travels with the task: 4 bytes for each known term and factor, less than 0.1 MB.

Defined results: null and empty texts have no terms and get the score of the bias alone; without labelled rows of both
classes every score is all but 0, or all but 1 where all of them are toxic; a null doc_id counts as not held out but is not
learned from; labels that are null or not 0 or 1 and labels without a document are left out; a label that repeats counts
once, and of rows that repeat an id the text first by order is learned from; repeated rows get equal scores; an empty
table gives an empty result; a column _toxic of the input is refused, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, passing, small_batches, stored
from tidewake.llm.language_id import points

RUNS = (3, 4, 5)
FACTORS = 8
EPOCHS, BATCH = 12, 32


def terms(text: str | None) -> np.ndarray:
    """32-bit hashes of all words and runs of a text, repeats included."""
    x = points(text or "")
    blank = x == 32
    inner = np.flatnonzero(~blank)
    if not len(inner):
        return np.zeros(0, np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, RUNS[-1] + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1)
        if n in RUNS:
            some = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            # a run with a blank inside spans two words
            within = ~np.logical_or.reduce([blank[k : len(x) - n + 1 + k] for k in range(1, n - 1)])
            out.append(some[within])
    # whole words: a polynomial in the place of a letter within its word
    starts = inner[blank[inner - 1]]
    place = np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    powers = np.cumprod(np.full(int(place.max()) + 2, 0x01000193, np.uint32), dtype=np.uint32)
    body = np.where(blank, np.uint32(0), x)[starts[0] :] * powers[place]
    out.append(np.add.reduceat(body, starts - starts[0], dtype=np.uint32) * np.uint32(0x9E3779B1))
    h = np.concatenate(out)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


@dataclass
class Model:
    """known: sorted hashes of the terms; w, v: weight and factors of each; bias."""

    known: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.known >> np.uint32(14)] = True

    def slots(self, text: str | None) -> np.ndarray:
        """Which known terms a text has, in order."""
        h = terms(text)
        h = h[self.maybe[h >> np.uint32(14)]]
        if not len(h) or not len(self.known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.unique(at[self.known[at] == h])

    def score(self, text: str | None) -> float:
        return float(sigmoid(raw(self.slots(text), self.w, self.v, self.bias)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def raw(at: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> float:
    """Bias, weights and pairs of the terms at."""
    f = v[at].astype(np.float64)
    s = f.sum(0)
    return bias + float(w[at].sum(dtype=np.float64)) + 0.5 * float((s * s).sum() - (f * f).sum())


def fit(rows: list[np.ndarray], y: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, shrink: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, factors, bias) by AdaGrad on the log loss over rows of term numbers."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, factors))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    bias, seen_w, seen_v, seen_b = float(np.log(share / (1 - share))), np.full(n_terms, 1e-2), np.full((n_terms, factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at = np.concatenate([rows[j] for j in some])
            own = np.repeat(np.arange(len(some)), [len(rows[j]) for j in some])
            f = v[at]
            s = np.zeros((len(some), factors))
            np.add.at(s, own, f)
            q = np.bincount(own, (f * f).sum(1), len(some))
            z = bias + np.bincount(own, w[at], len(some)) + 0.5 * ((s * s).sum(1) - q)
            d = (sigmoid(z) - y[some]) / len(some)
            seen_b += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(seen_b)
            if not len(at):
                continue
            by = np.argsort(at, kind="stable")
            edge = np.flatnonzero(np.diff(at[by], prepend=-1))
            hit = at[by][edge]
            gw = np.add.reduceat(d[own][by], edge) + shrink * w[hit]
            gv = np.add.reduceat((d[own, None] * (s[own] - f))[by], edge) + shrink * v[hit]
            seen_w[hit] += gw * gw
            seen_v[hit] += gv * gv
            w[hit] -= rate * gw / np.sqrt(seen_w[hit])
            v[hit] -= rate * gv / np.sqrt(seen_v[hit])
    return w, v, bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """h, toxic, text of at most max_labelled labelled rows that are not held out, those with the smallest hash of their id; stored."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.where(~held_out(F.col("_id"))).distinct().withColumn("h", F.xxhash64("_id"))
    picked = own.orderBy("h", "_id", "toxic").limit(max_labelled)
    found = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).where("text IS NOT NULL").join(F.broadcast(picked), "_id")
    return stored(found.groupBy("h", "_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")


COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("bad", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> how many rows of the batch have each term, and how many of these are toxic."""
    for batch in batches:
        each = [np.unique(terms(x.as_py())) for x in batch.column("text")]
        if not sum(map(len, each)):
            continue
        bad = np.repeat(batch.column("toxic").to_numpy().astype(np.int64), [len(x) for x in each])
        term, at, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, bad, len(term)).astype(np.int64))], schema=COUNTS)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def known_terms(sample: DataFrame, n: int, bad: int, max_terms: int, min_gain: float) -> np.ndarray:
    """The max_terms terms of the sample with the largest G^2 against the class, min_gain at least; sorted."""
    counts = sample.select("toxic", "text").mapInArrow(_count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    c, d = F.lit(float(bad)) - a, F.lit(float(n - bad)) - b
    cells = _xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d)
    rows, cols = _xlogx(a + b) + _xlogx(c + d), _xlogx(a + c) + _xlogx(b + d)
    scored = counts.select("term", (2 * (cells - rows - cols + F.lit(float(n)) * F.log(F.lit(float(n))))).alias("g2"))
    picked = scored.where(F.col("g2") >= min_gain).orderBy(F.desc("g2"), "term").limit(max_terms).collect()
    return np.sort(np.array([r["term"] for r in picked], np.int64)).astype(np.uint32)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_terms: int = 1024, min_gain: float = 10.0, **options) -> Model:
    """The machine fitted on a sample; only max_labelled rows of known terms come to the driver."""
    spark = docs.sparkSession
    small_batches(spark, 250)
    with passing(spark):
        sample = labelled_sample(docs, labels, max_labelled)
        n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < bad < n:
            return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), 40.0 if bad else -40.0)
        model = Model(known_terms(sample, n, bad, max_terms, min_gain), np.zeros(0), np.zeros((0, FACTORS)), 0.0)

        @F.arrow_udf("array<int>")
        def slots(texts: pa.Array) -> pa.Array:
            return pa.array([model.slots(x.as_py()).tolist() for x in texts], pa.list_(pa.int32()))

        rows = sample.select("h", "_id", "toxic", slots("text").alias("at")).toPandas().sort_values(["h", "_id", "toxic"])
    w, v, bias = fit([np.asarray(x, np.int64) for x in rows["at"]], rows["toxic"].to_numpy(np.float64), len(model.known), **options)
    return Model(model.known, w.astype(np.float32), v.astype(np.float32), bias)


def score_udf(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in texts], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, Model]:
    """docs with a struct column _toxic: score (0 to 1) and predicted (1 from 0.5 on). Only text is an input of a score."""
    free_name(docs, "_toxic")
    model = learn(docs, labels, **options)
    small_batches(docs.sparkSession)
    out = docs.withColumn("_toxic", score_udf(model)(F.col("text")))
    return out.withColumn("_toxic", F.struct(F.col("_toxic").alias("score"), (F.col("_toxic") >= 0.5).cast("int").alias("predicted"))), model

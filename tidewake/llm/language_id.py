"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text becomes its lower-cased letters with one blank between words; all runs of 1 to 4 characters are hashed
into buckets. The embeddings of the buckets are averaged and fed to a linear softmax; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A temperature fitted on texts kept
apart calibrates the probabilities of whole texts, and a threshold on them marks predictions to reject.

The sample is bounded in rows by two parameters: per_lang texts of each language, and max_texts of all languages together
(but LEAST_TEXTS of each). Every sampled text is read whole, all of its segments of SEGMENT characters are
learned from, and all languages are. Predictions read whole texts too; the product of embeddings and weights is taken once, so a
text costs one table row for each run.
Defined results: null texts and texts without a letter are und with score 0; repeated rows get equal results;
without any labelled row everything is und; a null doc_id counts as not held out; ties go to the first language by name; a column _lang of the input is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, id_text, small_batches

BUCKETS = 1 << 16
DIM = 16
RUNS = (1, 2, 3, 4)
UND = "und"
SEGMENT = 240
LEAST_TEXTS = 20
STEP = 16  # segments in one update


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, everything but letters made a blank, runs of blanks made one."""
    x = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    x = np.where(letters()[np.minimum(x, 0x10FFFF)], x, np.uint32(32))
    blank = x == 32
    return x[~(blank & np.concatenate([[False], blank[:-1]]))]


def hashed(x: np.ndarray) -> np.ndarray:
    """Buckets of all runs of the code points."""
    out, h = [], np.zeros(len(x), np.uint32)
    for n in RUNS:
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append(mixed >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        x = points(text)
        if not (x != 32).any():
            return None
        return self.table[hashed(x)].mean(0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return UND, 0.0, True
        p = softmax(z / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k]), bool(p[k] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ends(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all buckets, where each bag starts, sizes)."""
    sizes = np.array([len(h) for h in bags])
    return np.concatenate(bags), np.cumsum(sizes) - sizes, sizes


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, segment: int = SEGMENT, accuracy: float = 0.995, seed: int = 7) -> Model:
    """SGD over all segments of the texts, STEP of them in an update; every fifth text is kept apart, whole, for the temperature and the rejection threshold."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    of = {x: k for k, x in enumerate(names)}
    bags: list[np.ndarray] = []
    label: list[int] = []
    apart: list[tuple[str, int]] = []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        if i % 5 == 4:
            apart.append((t, of[lang]))
            continue
        x = points(t or "")
        for a in range(0, len(x), segment):
            if (x[a : a + segment] != 32).any():
                bags.append(hashed(x[a : a + segment]))
                label.append(of[lang])
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    y = np.array(label, np.int64)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), STEP):
            some = order[k : k + STEP]
            h, starts, sizes = _ends([bags[j] for j in some])
            lr = rate * (1 - done / steps)
            done += len(some)
            g = np.add.reduceat(E[h], starts) / sizes[:, None].astype(np.float32)
            d = softmax(g @ W + b).astype(np.float32)
            d[np.arange(len(some)), y[some]] -= 1
            back = (d @ W.T) * (lr * 10 / sizes[:, None]).astype(np.float32)
            W -= lr * g.T @ d
            b -= lr * d.sum(0)
            # gradients of equal buckets are added up before they are taken off
            by = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.diff(h[by].astype(np.int64), prepend=-1))
            E[h[by][edge]] -= np.add.reduceat(np.repeat(back, sizes, 0)[by], edge)
    model = Model(names, (E @ W).astype(np.float32), b.astype(np.float64))
    seen = [(z, k) for z, k in ((model.logits(t or ""), k) for t, k in apart or list(zip(texts, map(of.get, langs), strict=True))) if z is not None]
    if seen:
        z, y = np.array([x for x, _ in seen]), np.array([k for _, k in seen])
        grid = np.geomspace(0.05, 5, 40)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(share >= accuracy)
        model.reject_below = float(top[order[ok[-1]]]) if len(ok) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _uniform(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def _shares(spark, counts: list, bound: int) -> DataFrame:
    """lang, share: the part of each language's rows that keeps it at about bound, at least its smallest hash. A row for each language, as many as the model has classes."""
    return spark.createDataFrame([(r["lang"], max(bound / r["n"], r["least"])) for r in counts], "lang string, share double")


def training_sample(docs: DataFrame, per_lang: int = 400, max_texts: int = 20_000) -> tuple[list[str], list[str]]:
    """(texts, languages): about per_lang whole texts of each language, max_texts of all together but LEAST_TEXTS of each.

    Texts are those whose hash of id and text is below their share of the language's rows; repeated rows count once.
    Held-out rows, null texts and null languages are not read.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.withColumn("h", _uniform(F.coalesce(id_text(), F.lit("")), F.lit("lang"), "text"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return [], []
    bound = max(min(per_lang, max_texts // len(counts)), min(per_lang, LEAST_TEXTS))
    rows = own.join(F.broadcast(_shares(spark, counts, bound)), "lang").where("h <= share").groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = rows.orderBy("h", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict_udf(model: Model):
    """The model travels with the task: its size is BUCKETS x languages x 4 bytes."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = [model.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, per_lang: int = 400, max_texts: int = 20_000, **options) -> tuple[DataFrame, Model]:
    """docs with a struct column _lang: lang_pred, score, rejected. Only text is an input of a prediction."""
    free_name(docs, "_lang")
    model = train(*training_sample(docs, per_lang, max_texts), **options)
    small_batches(docs.sparkSession)
    return docs.withColumn("_lang", predict_udf(model)(F.col("text"))), model

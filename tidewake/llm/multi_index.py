"""Embedding near-duplicates with an inverted multi-index.

Vectors are cut in halves and each half has a codebook of its own; the pairs of centroids are the cells of a
product grid, held for each label and vector length. A vector lies in the cell of its nearest centroids. As a query
it visits cells by multi-sequence traversal, nearest first, until it has passed the margin at which the target recall
is reached, and of these it keeps the cells numbered below its own: of two vectors the one in the higher cell visits
the other, so a pair is met once. The margin is measured on vectors turned to exactly the threshold and on all near pairs
of the sample. What shares a visited cell is verified by cosine in double precision, in blocks of matrix products:
only link counts and the edges of a spanning forest leave a task.

The codebooks of a length are fitted on a sample of its rows, SAMPLE or EACH rows for each centroid, whichever is more;
their size goes with the root of the rows of the largest label, so cells stay small. All rows are indexed, of every
length. Equal vectors of a label are one class from the start, known by a SHA-256 of their components.
Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; vectors of different lengths do not link; rows with a null vec_id are not compared, and those with an id that is no
whole number count as such; labels of any type are compared as they are; rows that repeat a vec_id are vectors of their own; an empty table gives an empty result;
columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import passing, small_batches, stored, whole_id
from tidewake.llm.components import components
from tidewake.llm.ngram_join import Forest, _stars, blocks_of, whole_groups

THRESHOLD = 0.98
TARGET_RECALL = 0.999
#: Rows of the sample at least, its rows for each centroid, rows of a label to a cell, and rows of the sample that are turned to the threshold.
SAMPLE, EACH, CELL, TURNED = 10_000, 16, 64, 4000
BLOCK = 1024


@dataclass
class Grid:
    """Codebooks of both halves and the margin of squared distance within which cells are visited."""

    dim: int
    one: np.ndarray
    two: np.ndarray
    margin: float = 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return _squared(x[:, :h], self.one), _squared(x[:, h:], self.two)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks."""
    return np.concatenate([_squared(x[k : k + 2048], c).argmin(1) for k in range(0, len(x), 2048)])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if x.shape[1] else 0):
        own = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def traverse(d1: np.ndarray, d2: np.ndarray, margin: float) -> list[int]:
    """Cells (i * len(d2) + j) by growing d1[i] + d2[j], up to the least sum plus margin: multi-sequence traversal."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    most = s1[0] + s2[0] + margin
    heap, out, width = [(s1[0] + s2[0], 0, 0)], [], len(s2)
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > most:
            break
        out.append(int(o1[i]) * width + int(o2[j]))
        if j + 1 < width:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _need(grid: Grid, x: np.ndarray, near: np.ndarray, ones: np.ndarray, twos: np.ndarray, own: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Margins that rows x, which lie in cells own, need to visit the cells of their near partners (a matrix of booleans) that lie lower."""
    d1, d2 = grid.distances(x)
    i, j = np.nonzero(near & (own[:, None] > cells[None, :]))
    return d1[i, ones[j]] + d2[i, twos[j]] - (d1.min(1) + d2.min(1))[i]


class Quantile:
    """A quantile of numbers in [0, 16) from counts of narrow bins; the upper edge of its bin."""

    def __init__(self, bins: int = 1 << 16):
        self.counts, self.width = np.zeros(bins, np.int64), 16 / bins

    def add(self, values: np.ndarray) -> None:
        at = np.clip(values / self.width, 0, len(self.counts) - 1).astype(np.int64)
        self.counts += np.bincount(at, minlength=len(self.counts))

    def of(self, share: float) -> float:
        upto = np.cumsum(self.counts)
        return float((np.searchsorted(upto, share * upto[-1]) + 1) * self.width) if upto[-1] else 0.0


def centroids(n_rows: int) -> int:
    """Centroids of each half for a label of n_rows vectors: as many as put CELL vectors into a cell, 4 at least."""
    return max(4, round(np.sqrt(n_rows / CELL)))


def fit(sample: np.ndarray, labels: np.ndarray, n_rows: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL, seed: int = 11) -> Grid:
    """Codebooks on unit vectors of a sample, with as many centroids as n_rows call for, and the margin for the target recall."""
    dim = sample.shape[1]
    k, h = centroids(n_rows), dim // 2
    grid = Grid(dim, k_means(sample[:, :h], k if h else 1), k_means(sample[:, h:], k, seed=4))
    width = len(grid.two)
    place = lambda x: (_nearest(x[:, :h], grid.one), _nearest(x[:, h:], grid.two))
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(len(sample), TURNED), replace=False)]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    # turned vectors, and all near pairs of the sample, must each reach the target
    turned, pairs = Quantile(), Quantile()
    y = threshold * x + np.sqrt(1 - threshold**2) * u
    for one, two in ((x, y), (y, x)):
        (a1, a2), (b1, b2) = place(one), place(two)
        for lo in range(0, len(x), 512):
            hi = min(lo + 512, len(x))
            cells = b1[lo:hi] * width + b2[lo:hi]
            turned.add(_need(grid, one[lo:hi], np.eye(hi - lo, dtype=bool), b1[lo:hi], b2[lo:hi], a1[lo:hi] * width + a2[lo:hi], cells))
    for lab in np.unique(labels):
        own = sample[labels == lab]
        c1, c2 = place(own)
        cells = c1 * width + c2
        for lo in range(0, len(own), 512):
            pairs.add(_need(grid, own[lo : lo + 512], own[lo : lo + 512] @ own.T >= threshold, c1, c2, cells[lo : lo + 512], cells))
    grid.margin = max(turned.of(target), pairs.of(target)) + 1e-9
    return grid


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are valid, their unit vectors in double precision) of vectors of equal length."""
    x = np.array(vectors, np.float64)
    scale = np.abs(x).max(1, initial=0)
    ok = np.isfinite(x).all(1) & (scale > 0)
    x = x[ok] / scale[ok, None]
    return np.flatnonzero(ok), x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = pa.schema([("key", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("home", pa.int64()), ("vec", pa.binary()), ("copies", pa.int64()), ("visits", pa.list_(pa.int64()))])
PLACED_DDL = "key long, label string, dim int, home long, vec binary, copies long, visits array<long>"


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, of four-byte numbers where these hold all of them exactly."""
    small = x.astype(np.float32)
    return [v.tobytes() for v in (small if (small == x).all() else x)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in rows], np.float64)


def _place(grids: dict[int, Grid]):
    """key, label, vec, copies -> home cell, and the cells to lie in: the home cell and those visited with lower numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(vecs.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            home, visits, out = np.zeros(len(vecs), np.int64), [[]] * len(vecs), [b""] * len(vecs)
            for dim in np.unique(sizes):
                rows, grid = np.flatnonzero(sizes == dim), grids[int(dim)]
                raw = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    d1, d2 = grid.distances(unit(raw[lo : lo + 1024])[1])
                    for k, p, q, v in zip(some, d1, d2, packed(raw[lo : lo + 1024]), strict=True):
                        cells = traverse(p, q, grid.margin)
                        home[k], out[k] = cells[0], v
                        visits[k] = [c for c in cells if c <= cells[0]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(sizes.astype(np.int32)), pa.array(home), pa.array(out, pa.binary()), batch.column("copies"), pa.array(visits, pa.list_(pa.int64()))], schema=PLACED)

    return run


LINKS = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])


def count_links(x: np.ndarray, here: np.ndarray, weights: np.ndarray, first: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted links of each row, roots of the forest they span) of the pairs of a cell: those at home here with each other and with visitors."""
    n = len(x)
    links, forest = np.zeros(n, np.int64), Forest(n)
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        near = x[lo:hi] @ x.T >= threshold
        near &= here[lo:hi, None] | here[None, :]
        near &= np.arange(lo, hi)[:, None] < np.arange(n)[None, :]
        if first is not None:
            near &= first[lo:hi, None] != first[None, :]
        i, j = np.nonzero(near)
        i += lo
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        forest.join(i, j)
    return links, forest.roots()


def _link(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["label", "dim", "cell", "bi", "bj"]):
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                g = t.slice(lo, hi - lo)
                ids = g.column("key").to_numpy()
                x = unit(unpacked(g.column("vec").to_pylist(), g.column("dim")[0].as_py()))[1]
                bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
                first = None if bi == bj else g.column("own").to_numpy() == bi
                links, up = count_links(x, g.column("home").to_numpy() == g.column("cell")[0].as_py(), g.column("copies").to_numpy(), first, threshold)
                some = np.flatnonzero(links)
                if not len(some):
                    continue
                a, b = _stars(ids, up)
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), none(len(some))], schema=LINKS)
                yield pa.RecordBatch.from_arrays([pa.array(a), none(len(a)), pa.array(b)], schema=LINKS)

    return run


def fitted(classes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, sample: int = SAMPLE) -> dict[int, Grid]:
    """The grid of each vector length in classes (key, label, vec).

    The sample of a length has about sample or EACH rows for each of its centroids, whichever is more; many lengths share
    what one has, but each gets 1 / 16 of it at least.
    """
    sizes = classes.groupBy(F.size("vec").alias("dim"), "label").agg(F.count("*").alias("n"), F.min(F.xxhash64("key")).alias("h"))
    sizes = sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("h").alias("h")).collect()
    bound = lambda r: max(sample // min(len(sizes), 16), EACH * centroids(r["most"]))
    top = float(1 << 63)
    # a row for each length of vectors
    limits = [(r["dim"], max(r["h"], int(min((2 * bound(r) / r["n"] - 1) * top, top - 1024)))) for r in sizes]
    if not limits:
        return {}
    limits = classes.sparkSession.createDataFrame(limits, "dim int, least long")
    picked = classes.join(F.broadcast(limits), F.size("vec") == F.col("dim")).where(F.xxhash64("key") <= F.col("least"))
    picked = picked.select("dim", "label", "vec", F.xxhash64("key").alias("h")).toPandas().sort_values("h")
    most = {r["dim"]: r["most"] for r in sizes}
    out = {}
    for dim, some in picked.groupby("dim"):
        ok, x = unit(list(some.vec))
        out[int(dim)] = fit(x, some.label.to_numpy()[ok], most[dim], threshold, target)
    return out


def _linked(own: DataFrame, threshold: float, target: float, sample: int) -> DataFrame:
    """Classes by digest with their copies, links and least ids, stored."""
    spark = own.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = own.where("digest IS NOT NULL").groupBy("digest").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("key", F.monotonically_increasing_id()), "vec-classes")
    grids = fitted(classes, threshold, target, sample)
    small_batches(spark)
    placed = stored(classes.select("key", "label", "vec", "copies").mapInArrow(_place(grids), PLACED_DDL), "vec-cells")
    lean = placed.select("key", "label", "dim", F.explode("visits").alias("cell"))
    cells = stored(placed.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("home").alias("_h")).distinct(), "vec-homes")
    # visits to cells in which nothing lies end here; both tables are stored, so AQE may split the joins of a hot cell
    lean = lean.join(cells.hint("merge"), (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_h")), "left_semi")
    lean = stored(lean, "vec-visits")
    members = blocks_of(lean, ["label", "dim", "cell"], BLOCK).join(placed.select("key", "home", "vec", "copies").hint("merge"), "key")
    dealt = members.repartition(n, "label", "dim", "cell", "bi", "bj").sortWithinPartitions("label", "dim", "cell", "bi", "bj", "key")
    found = stored(dealt.mapInArrow(_link(threshold), "key long, links long, b long"), "vec-links")
    links = found.where("links IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.where("b IS NOT NULL").select(F.col("key").alias("a"), "b")).select(F.col("id").alias("key"), "component")
    named = classes.select("key", "digest", "rep", "copies").join(links.hint("merge"), "key", "left").join(groups.hint("merge"), "key", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "key")), "vec-named")
    least = stored(named.groupBy("component").agg(F.min("rep").alias("least")), "vec-least")  # stored, so that AQE may split a large component
    named = stored(named.join(least.hint("merge"), "component").select(F.col("digest").alias("_digest"), "copies", "links", "least"), "vec-found")
    return named


def label_text(rows: DataFrame) -> Column:
    """The label as a text that is equal for equal labels only, of whatever type."""
    label, kind = F.col("label"), dict(rows.dtypes)["label"]
    if kind in ("float", "double"):
        return (label + F.lit(0.0).cast(kind)).cast("string")  # a negative zero equals zero
    if kind == "binary":
        return F.hex(label)
    return F.when(label.isNotNull(), F.to_json(F.struct(label))) if re.match("array|map|struct|variant", kind) else label.cast("string")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """rows (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; a row for each row."""
    spark = rows.sparkSession
    vec = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))
    own = rows.select(whole_id(rows, "vec_id").alias("vec_id"), label_text(rows).alias("label"), F.when(sound, vec).alias("vec"))
    digest = F.unhex(F.sha2(F.concat_ws("|", F.hex(F.col("label").cast("binary")), F.col("vec").cast("string")), 256))
    own = own.withColumn("digest", F.when(F.col("vec").isNotNull() & F.col("vec_id").isNotNull(), digest))
    with passing(spark, "vec-found"):
        named = _linked(own, threshold, target, sample)
    out = own.select("vec_id", "digest").join(named.hint("merge"), F.col("digest") == F.col("_digest"), "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    count = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select("vec_id", count.alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

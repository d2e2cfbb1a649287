"""Periodic run detection by internal pattern matching.

A run is a stretch of words that repeats a shortest period q at least four times (and has least words), and that no
neighbouring word extends. The words of many texts are numbered so that words of different texts differ, and one suffix
array is built over them by prefix doubling. Its ranks at level k number all blocks of 2^k words, so equal blocks are
one interval of the suffix array. For each aligned (dyadic) block that occurs again, a wavelet matrix over the suffix
array answers which occurrence comes next before and after it (range predecessor and successor). An occurrence within the
window of one block length makes the two a progression, whose difference is a candidate period. As a run of
period q holds an aligned block of 2^k words, q <= 2^k <= 2q, and its copy one period further or before, every run is met.
A candidate is extended both ways word for word, by descending the ranks of all levels, so it is exact.

Texts are handled in groups of about GROUP words, a longer text alone: memory is 4 bytes for each word
and level of the longest repeat of a group. A text is never cut, and only its own repeats count.

Defined results: null, empty and blank texts have no words and no runs, and collapse to the empty text; repeated rows get
equal results; an empty table gives an empty result; of equally strong runs the first by start, then period, counts as
the strongest; a column _runs of the input is refused, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import WHITE, free_name, small_batches

TIMES, LEAST = 4, 6
GROUP = 1 << 16
TYPE = (
    "struct<n_words:long,n_runs:long,start:long,length:long,period:long,exponent_milli:long,runs_sha256:string,collapsed_sha256:string,"
    "runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
)


def ranks_of(x: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks of all blocks of 1, 2, 4, ... words up to longest, suffix array by the last of them).

    A block's rank is where the interval of its equals starts in the suffix array; blocks that run over the end count as
    blocks of their own. Each round sorts only what is not yet unique, by the ranks of both halves.
    """
    n = len(x)
    array = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.diff(x[array], prepend=x[array[:1]] - 1))
    rank = np.empty(n, np.int64)
    rank[array] = np.repeat(new, np.diff(np.append(new, n)))
    ranks, size = [rank.astype(np.int32)], 1
    shared = lambda r: np.bincount(r, minlength=n)[r] > 1
    places = np.flatnonzero(shared(rank[array]))
    while len(places) and 2 * size <= longest:
        some = array[places]
        own = rank[some]
        after = some + size
        half = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = own * (n + 1) + half
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        array[places] = some
        new = np.flatnonzero(np.diff(key, prepend=-1))
        rank = rank.copy()
        # an interval starts at the place of its first entry, as equals of a half are next to each other
        rank[some] = np.repeat(places[new], np.diff(np.append(new, len(some))))
        ranks.append(rank.astype(np.int32))
        size *= 2
        places = places[shared(np.repeat(new, np.diff(np.append(new, len(some)))))]
    return ranks, array


class Wavelet:
    """Wavelet matrix over values below n: how many of an interval are smaller, and the k-th smallest, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many entries of [lo, hi) are below value."""
        found = np.zeros(len(lo), np.int64)
        for k, zeros in enumerate(self.zeros):
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = (value >> (self.bits - 1 - k) & 1).astype(bool)
            found += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest entry of [lo, hi), from 0; k is within it."""
        out = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out = out << 1 | one
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


def candidates(ranks: list[np.ndarray], array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of two equal blocks, distance) of each aligned block and the occurrences next to it, no further than its length."""
    n = len(array)
    los, his, ats, lengths = [], [], [], []
    for k, rank in enumerate(ranks[1:], 1):
        size = 1 << k
        at = np.arange(0, n - size + 1, size)
        lo = rank[at]
        count = np.bincount(rank, minlength=n)[lo]
        some = count > 1
        los.append(lo[some])
        his.append((lo + count)[some])
        ats.append(at[some])
        lengths.append(np.full(int(some.sum()), size))
    if not sum(map(len, ats)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi, at, length = (np.concatenate(v) for v in (los, his, ats, lengths))
    tree = Wavelet(array)
    below = tree.smaller(lo, hi, at)
    firsts, periods = [], []
    for k, ok in ((below + 1, below + 1 < hi - lo), (below - 1, below > 0)):
        other = tree.smallest(lo[ok], hi[ok], k[ok])
        own = at[ok]
        near = np.abs(other - own) <= length[ok]
        firsts.append(np.minimum(own, other)[near])
        periods.append(np.abs(other - own)[near])
    pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(periods)]), axis=1)
    return pairs[0], pairs[1]


def extended(ranks: list[np.ndarray], first: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretch with the period around each pair of equal words first, first + period."""
    n = len(ranks[0])
    left, right = first.copy(), first.copy()
    for step in range(2):
        for k in range(len(ranks) - 1, -1, -1):
            # the top level may fit many times, each lower one once
            while True:
                a = right if step else left - (1 << k)
                ok = (a >= 0) & (a + period + (1 << k) <= n)
                ok[ok] = ranks[k][a[ok]] == ranks[k][a[ok] + period[ok]]
                if step:
                    right[ok] += 1 << k
                else:
                    left[ok] -= 1 << k
                if k < len(ranks) - 1 or not ok.any():
                    break
    return left, right + period


def runs_of(x: np.ndarray, longest: int, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """start, length, period (columns) of all runs in numbered words, by start, then period. longest: words of the longest text in x."""
    if len(x) < least:
        return np.zeros((0, 3), np.int64)
    ranks, array = ranks_of(x, max(2, 2 * longest // times))
    first, period = candidates(ranks, array)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    start, end = extended(ranks, first, period)
    length = end - start
    ok = length >= np.maximum(least, times * period)
    return np.unique(np.stack([start[ok], length[ok], period[ok]], axis=1), axis=0)[:, [0, 1, 2]]


def texts_runs(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[np.ndarray]:
    """runs_of() each text, from one suffix array over all of them."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    if not sizes.sum():
        return [np.zeros((0, 3), np.int64)] * len(texts)
    codes = pa.array([w for x in texts for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    found = runs_of(own * (int(codes.max()) + 1) + codes, int(sizes.max()), times, least)
    of = np.searchsorted(starts, found[:, 0], side="right") - 1 if len(found) else np.zeros(0, np.int64)
    # empty texts share their start with the next one: the last of equal starts is the one with words
    found[:, 0] -= starts[of]
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    out = [found[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in out]


def row_of(words: list[bytes], runs: np.ndarray) -> tuple:
    """The values of TYPE for one text."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs.tolist():
        edge[s + q] += 1
        edge[s + n] -= 1
    kept = b" ".join(words if not len(runs) else [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c])
    listed = runs.tolist()
    best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    return (len(words), len(listed), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in listed], kept.decode())


def grouped(texts: list[str | None], times: int, least: int) -> list[tuple]:
    out: list[tuple] = []
    some: list[list[bytes]] = []
    held = 0

    def flush():
        nonlocal some, held
        out.extend(row_of(w, r) for w, r in zip(some, texts_runs(some, times, least), strict=True))
        some, held = [], 0

    for t in texts:
        words = (t or "").encode().split()  # white space of bytes is that of the words: blank and 9 to 13
        if held and held + len(words) > GROUP:
            flush()
        some.append(words)
        held += len(words)
    flush()
    return out


def runs_udf(times: int = TIMES, least: int = LEAST, collapsed: bool = True):
    """text -> TYPE; runs and the collapsed text are left out (null) without collapsed."""
    kinds = (pa.int64(),) * 6 + (pa.string(),) * 2 + (pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string())
    names = [x.partition(":")[0] for x in "n_words n_runs start length period exponent_milli runs_sha256 collapsed_sha256 runs collapsed".split()]

    @F.arrow_udf(TYPE)
    def run(texts: pa.Array) -> pa.Array:
        rows = grouped(texts.to_pylist(), times, least)
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c if collapsed or k < 8 else [None] * len(rows), t) for k, (c, t) in enumerate(zip(cols, kinds, strict=True))], names=names)

    return run


def words_array(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{WHITE}]+"), F.lit(0))


def repeated_from(words: Column, start: Column, period: Column) -> Column:
    """The words in which, from number start on, the next period words are repeated to the end; start is less than their number."""
    left = F.size(words) - start
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil(left / period).cast("int")))
    return F.concat(F.slice(words, F.lit(1), start), F.slice(again, F.lit(1), left))


def period_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, collapsed: bool = True) -> DataFrame:
    """docs with a struct column _runs (TYPE) of the column text.

    runs: all runs; start, length, period, exponent_milli: the one with the greatest length / period; collapsed: the
    words without those that repeat what precedes them by a run's period.
    """
    free_name(docs, "_runs")
    small_batches(docs.sparkSession, 500, "8m")
    return docs.withColumn("_runs", runs_udf(times, least, collapsed)(F.col("text")))

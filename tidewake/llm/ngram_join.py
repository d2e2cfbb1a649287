"""N-gram Jaccard join: a MinHash LSH forest followed by exact verification.

Documents are sets of five-word shingles; copies (equal sets, known by a SHA-256 of their hashes) are one class from the
start. A class has a signature of TREES slices of DEPTH hashes. Each tree of the forest is the sorted list of its slices,
a prefix trie. Matched prefixes are shortened, from DEPTH on, until the target recall is reached: the recall of each
length is measured on QUERIES sample classes against all classes (forest_recall), and a length is good enough if the
measurement shows the target, or, where the sample holds too few pairs for that, if the measurement does not speak
against it and a pair at the threshold meets in some tree with the target's probability 1 - (1 - t^k)^TREES. Within a
trie node of that depth classes are joined from the longest common prefixes down to the shortest, and only pairs not
joined yet are compared by their whole signatures.

What these comparisons join are clusters; within a cluster every pair of classes is verified exactly, in blocks of
matrix products over their sets of shingle hashes, so no list of pairs is ever written, no text is read twice and no link
between two classes of one cluster is lost. The result has a row for each document: its class (the smallest id that links
reach) and its number of links.

Defined results: words are runs of characters other than blank, tab and line ends; a text with 1 to 4 words has one
shingle of them all; null texts and texts without a word link with nothing; rows with a null id are not compared, and an id
that is no whole number counts as null; rows that repeat an id are documents of their own, each compared by its own text;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import passing, small_batches, stored, whole_id
from tidewake.llm.components import components

N_WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 6
TARGET_RECALL = 0.9999
#: Signatures that agree less than this are not compared further; at the threshold their share is binomial.
LIKELY = 0.62
BLOCK = 512
#: Shingles of a block of a cluster (of 8 bytes each): long documents make smaller blocks, so that a pair of them fits in a task.
BLOCK_SHINGLES = 1 << 22
#: Sample classes whose partners among all classes are looked up to measure the forest's recall.
QUERIES = 256
REMEMBERED = 400_000
_words: dict[bytes, int] = {}


def needed_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is met with the target's probability."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= target), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    get, codes = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(h)
    x = np.array(codes, np.uint64)
    k = max(1, len(x) - n + 1)
    out = np.zeros(k, np.uint64)
    for i in range(min(n, len(x))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[i : i + k] + np.uint64(i + 1))
    return np.unique(out)


_A = np.random.default_rng(20_24).integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(20_25).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash of each non-empty set: rows of TREES * DEPTH values."""
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat((low * _A[i] + _B[i]) ^ high, at)
    return out


PROFILE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("sig", pa.binary()), ("slices", pa.binary())])
PROFILE_DDL = "doc_id long, h long, digest binary, n int, sig binary, slices binary"


def digest_of(some: np.ndarray) -> bytes:
    """The class of a shingle set: a digest of its sorted hashes."""
    return hashlib.sha256(some.astype("<u8").tobytes()).digest()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> digest, set size, signature (a byte of each hash) and trie slices (two bytes of each hash). One pass over the texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            sets = [shingles(x.as_py()) for x in part.column(2)]
            some = [k for k, x in enumerate(sets) if len(x)]
            sigs: list[bytes | None] = [None] * len(sets)
            slices: list[bytes | None] = [None] * len(sets)
            if some:
                sig = signatures([sets[k] for k in some])
                low = ((sig ^ (sig >> np.uint32(11)) ^ (sig >> np.uint32(22))) & np.uint32(255)).astype(np.uint8)
                two = ((sig ^ (sig >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2")
                for row, k in enumerate(some):
                    sigs[k], slices[k] = low[row].tobytes(), two[row].tobytes()
            digests = [digest_of(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(sigs, pa.binary()), pa.array(slices, pa.binary())], schema=PROFILE)


def _slices(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), TREES, DEPTH)


def _nodes(depth: int):
    """key, slices -> a row for each tree: the trie node at depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _slices(batch.column(1)).astype(np.uint64)
            node = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(own), 1))
            for d in range(depth):
                node = _mix(node * np.uint64(0x9E3779B97F4A7C15) + own[:, :, d])
            key = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(own))), pa.array(node.ravel().view(np.int64))], names=["key", "tree", "node"])

    return run


def _partners(keys: np.ndarray, wanted: np.ndarray, threshold: float):
    """key, slices -> (prefix, pairs): near pairs of these rows with the sample, by the longest prefix they share in a tree. A pair is near if its signatures say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH + 1, np.int64)
        for batch in batches:
            own, key = _slices(batch.column(1)), batch.column(0).to_numpy()
            for q, w in zip(keys, wanted, strict=True):
                # the first slices tell most rows apart
                some = np.flatnonzero((own[:, :4] == w[:4]).sum((1, 2)) >= 2 * DEPTH)
                same = own[some] == w
                near = (same.mean((1, 2)) >= threshold) & (key[some] != q)
                total += np.bincount(np.cumprod(same[near], 2).sum(2).max(1), minlength=DEPTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEPTH + 1)), pa.array(total)], names=["prefix", "pairs"])

    return run


def forest_recall(classes: DataFrame, threshold: float = THRESHOLD, queries: int = QUERIES) -> tuple[int, list[float]]:
    """(pairs, recall by prefix length 0 .. DEPTH): which part of the near pairs of sample classes, looked up among all classes, shares a prefix of that length in some tree.

    classes: key, slices. The sample is the classes with the smallest hashes, at most queries of them.
    """
    sample = classes.select("key", "slices").orderBy(F.xxhash64("key", F.lit(9))).limit(queries).toArrow()
    if not sample.num_rows:
        return 0, [1.0] * (DEPTH + 1)
    keys, wanted = sample.column("key").to_numpy(), _slices(sample.column("slices").combine_chunks())
    rows = classes.select("key", "slices").mapInArrow(_partners(keys, wanted, threshold), "prefix long, pairs long").groupBy("prefix").agg(F.sum("pairs").alias("pairs")).collect()
    pairs = np.zeros(DEPTH + 1, np.int64)
    for r in rows:
        pairs[r["prefix"]] = r["pairs"]
    total = int(pairs.sum())
    return total, [float(x) for x in np.cumsum(pairs[::-1])[::-1] / max(total, 1)] if total else [1.0] * (DEPTH + 1)


def shortened_depth(pairs: int, recall: list[float], threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The prefix length at which shortening ends, from the measured recall of each length.

    The sample shows the target if it would with three more misses; it speaks against it with more than three misses beyond the target's.
    """
    sure = needed_depth(threshold, target)
    for k in range(DEPTH, 1, -1):
        missed = round((1 - recall[k]) * pairs)
        if missed + 3 <= (1 - target) * pairs or k <= sure and missed <= 3 + (1 - target) * pairs:
            return k
    return 1


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up[up], up):
            up = up[up]
        self.up = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join rows a[i] and b[i]."""
        while len(a):
            up = self.roots()
            x, y = up[a], up[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            open_ = lo < hi
            a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
            if len(a):
                np.minimum.at(self.up, hi, lo)


def _stars(ids: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each joined row to its root."""
    own = up != np.arange(len(up))
    return ids[up[own]], ids[own]


def likely_edges(ids: np.ndarray, sig: np.ndarray, tree: int, depth: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Join the rows of one trie node: from full prefixes up to the node, those that agree in LIKELY of their signature.

    rows: for two blocks of a large node, True for rows of the first; only pairs across are compared then.
    """
    forest = Forest(len(ids))
    part = sig[:, tree * DEPTH : (tree + 1) * DEPTH]
    for k in range(DEPTH, depth - 1, -1):
        key = np.unique(part[:, :k], axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            if b - a < 2:
                continue
            some = order[a:b]
            up = forest.roots()[some]
            if (up == up[0]).all():
                continue
            for lo in range(0, len(some), 64):
                one = some[lo : lo + 64]
                pair = np.flatnonzero(up[lo : lo + 64, None] != up[None, :])
                if not len(pair):
                    continue
                i, j = one[pair // len(some)], some[pair % len(some)]
                if rows is not None:
                    across = rows[i] != rows[j]
                    i, j = i[across], j[across]
                for s in range(0, len(i), 1 << 16):
                    x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    good = (sig[x] == sig[y]).mean(1) >= LIKELY
                    forest.join(x[good], y[good])
                up = forest.roots()[some]
    return _stars(ids, forest.roots())


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, offsets) of complete groups out of batches sorted by keys; only a group that is not ended is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first = tuple(c[0] for c in cols)
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last is not None and first != last and not cut:
            yield _offsets(pa.Table.from_batches(held), keys)
            held = []
        if cut:
            yield _offsets(pa.Table.from_batches([*held, batch.slice(0, cut)]), keys)
            held = []
        held.append(batch.slice(cut))
        last = tuple(c[-1] for c in cols)
    if held:
        yield _offsets(pa.Table.from_batches(held), keys)


def _offsets(t: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return t, np.append(np.flatnonzero(change), t.num_rows)


def _join_nodes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["tree", "node", "bi", "bj"]):
            ids = t.column("key").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), TREES * DEPTH)
            tree, own, bi, bj = (t.column(c).to_numpy() for c in ("tree", "own", "bi", "bj"))
            # nodes of two rows, most of all, are compared at once
            two = at[:-1][np.diff(at) == 2]
            two = two[(bi[two] == bj[two]) | (own[two] != own[two + 1])]
            two = two[(sig[two] == sig[two + 1]).mean(1) >= LIKELY]
            out = [(ids[two], ids[two + 1])]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 2:
                    out.append(likely_edges(ids[a:b], sig[a:b], int(tree[a]), depth, None if bi[a] == bj[a] else own[a:b] == bi[a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], schema=PAIRS)

    return run


def blocks_of(members: DataFrame, keys: list[str], block: int, member: str = "key", weight: str | None = None, most: int = 0) -> DataFrame:
    """members with bi, bj, own: each pair of blocks of a group is a unit of work, and a row goes to all pairs with its block.

    Groups of at most block rows, whose weights add up to at most most where a column tells them, have the one pair (0, 0). Block numbers come from a hash of the id, and a group's number
    of blocks from its size, so no window gathers a group; sizes are stored first, so that AQE may split the join.
    """
    blocks = F.ceil(F.col("_n") / block)
    if weight:  # more blocks than rows would be of no use
        blocks = F.greatest(blocks, F.least(F.col("_n"), F.ceil(F.col("_w") / most)))
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_n"), *([F.sum(weight).alias("_w")] if weight else [])).where("_n > 1")
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], blocks.cast("int").alias("_blocks"))
    sizes = stored(sizes, "group-sizes")
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    x = members.join(sizes.hint("merge"), on).withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(5)), F.col("_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least("own", k).alias("bi"), F.greatest("own", k).alias("bj")))
    return x.select(*members.columns, "own", F.explode(others).alias("_p")).select(*members.columns, "own", "_p.bi", "_p.bj")


def verify_block(docs: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], first: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, a, b): exact Jaccard of all pairs (across the blocks, where first tells a row's block).

    links count the other side's weight; a, b join linked rows to their root.
    """
    n = len(docs)
    size = np.array([len(s) for s in sets], np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    run = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    often = np.bincount(run)[run] > 1
    run, owner = run[often], owner[often]
    common = np.zeros((n, n), np.float32)
    if len(run):
        run = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
        for a in range(0, int(run[-1]) + 1, 4096):
            lo, hi = np.searchsorted(run, [a, a + 4096])
            m = np.zeros((n, min(4096, int(run[-1]) + 1 - a)), np.float32)
            m[owner[lo:hi], run[lo:hi] - a] = 1
            common += m @ m.T
    # |A and B| >= t |A or B| in whole numbers: (1 + t) common >= t (|A| + |B|), with t as a ratio of integers
    top, bottom = round(threshold * 10_000), 10_000
    linked = (bottom + top) * common.astype(np.int64) >= top * (size[:, None].astype(np.int64) + size[None, :].astype(np.int64))
    np.fill_diagonal(linked, False)
    if first is not None:
        linked &= first[:, None] != first[None, :]
    links = linked @ weights
    forest = Forest(n)
    i, j = np.nonzero(np.triu(linked))
    forest.join(i, j)
    a, b = _stars(docs, forest.roots())
    return links, a, b


SETS = pa.schema([("key", pa.int64()), ("shingles", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest, text -> key, shingle hashes of the classes whose set the text has."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            rows = [(key, some.tobytes()) for key, digest, some in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), (shingles(x.as_py()) for x in part.column(2)), strict=True) if digest_of(some) == digest]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=SETS)


VERIFIED = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["cluster", "bi", "bj"]):
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                g = t.slice(lo, hi - lo)
                ids, weights = g.column("key").to_numpy(), g.column("copies").to_numpy()
                bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
                first = None if bi == bj else g.column("own").to_numpy() == bi
                links, a, b = verify_block(ids, weights, [np.frombuffer(x.as_py(), np.uint64) for x in g.column("shingles")], first, threshold)
                some = np.flatnonzero(links)
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), none(len(some))], schema=VERIFIED)
                yield pa.RecordBatch.from_arrays([pa.array(a), none(len(a)), pa.array(b)], schema=VERIFIED)

    return run


def profiled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, profiles, classes) of docs (doc_id, text); h tells apart the texts of rows that share an id."""
    rows = docs.select(whole_id(docs, "doc_id").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    small_batches(docs.sparkSession)
    own = stored(rows.mapInArrow(_profile, PROFILE_DDL), "ngram-profiles")
    known = own.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("slices").alias("slices"))
    classes = classes.select("digest", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h"), "copies", "n", "sig", "slices")
    return rows, own, stored(classes.withColumn("key", F.monotonically_increasing_id()), "ngram-classes")


def _linked(docs: DataFrame, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(profiles of all rows, classes with their links and least ids), both stored."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, own, classes = profiled(docs)
    depth = shortened_depth(*forest_recall(classes, threshold), threshold, target)

    # trie nodes that hold two classes or more, and what their signatures join
    nodes = stored(classes.select("key", "slices").mapInArrow(_nodes(depth), "key long, tree int, node long"), "ngram-nodes")
    members = blocks_of(nodes, ["tree", "node"], 2 * BLOCK).join(classes.select("key", "sig").hint("merge"), "key")
    dealt = members.repartition(n, "tree", "node", "bi", "bj").sortWithinPartitions("tree", "node", "bi", "bj", "key")
    clusters = components(stored(dealt.mapInArrow(_join_nodes(depth), "a long, b long"), "ngram-likely"))

    # the sets of clustered classes, each from one text, then exact verification within clusters
    clusters = clusters.select(F.col("id").alias("key"), F.col("component").alias("cluster"))
    within = stored(clusters.join(classes.select("key", "digest", "rep", "rep_h", "copies", "n").hint("merge"), "key"), "ngram-clustered")
    same = (F.col("doc_id") == F.col("rep")) & (F.col("h") == F.col("rep_h"))
    texts = rows.where("text IS NOT NULL").join(within.select("rep", "rep_h").hint("merge"), same, "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    sets = texts.join(within.select("key", "digest", "rep", "rep_h").hint("merge"), same).select("key", "digest", "text")
    sets = stored(sets.mapInArrow(_sets, "key long, shingles binary"), "ngram-sets")
    placed = stored(blocks_of(within.select("key", "cluster", "copies", "n"), ["cluster"], BLOCK, weight="n", most=BLOCK_SHINGLES), "ngram-clusters")
    work = placed.join(sets.hint("merge"), "key").select("cluster", "bi", "bj", "own", "key", "copies", "shingles")
    work = work.repartition(n, "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "key")
    seen = stored(work.mapInArrow(_verify(threshold), "key long, links long, b long"), "ngram-verified")
    links = seen.where("links IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))

    # classes of linked documents by their smallest id
    groups = components(seen.where("b IS NOT NULL").select(F.col("key").alias("a"), "b")).select(F.col("id").alias("key"), "component")
    named = classes.select("key", "digest", "rep", "copies").join(links.hint("merge"), "key", "left").join(groups.hint("merge"), "key", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "key")), "ngram-links")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    found = named.join(least.hint("merge"), "component").select(F.col("digest").alias("_digest"), "rep", "copies", "links", "class_id")
    found = stored(found, "ngram-found")
    return own, found


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, copy_id, class_id, n_links; a row for each row of docs.

    copy_id: the smallest id with the same shingles. class_id: the smallest id that links (Jaccard >= threshold) reach.
    n_links: other rows linked directly, copies included.
    """
    with passing(docs.sparkSession, "ngram-profiles", "ngram-found"):
        own, found = _linked(docs, threshold, target)
    out = own.select("doc_id", "n", "digest").join(found.hint("merge"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
    )


def recall_report(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, queries: int = QUERIES) -> DataFrame:
    """docs (doc_id, text) -> a row for each prefix length 1 .. DEPTH: prefix, pairs (near pairs of the sample classes), recall (share of them that meet at that length), chosen (whether shortening ends there).

    An empty table has no near pair: recall is 1 at every length.
    """
    with passing(docs.sparkSession):
        pairs, recall = forest_recall(profiled(docs)[2], threshold, queries)
    depth = shortened_depth(pairs, recall, threshold, target)
    rows = [(k, pairs, recall[k], k == depth) for k in range(1, DEPTH + 1)]
    return docs.sparkSession.createDataFrame(rows, "prefix int, pairs long, recall double, chosen boolean")

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens that a batch of texts brings up for the first time lie in one linked list of bytes, with a fence
between them. A bucket for each merge rank holds the list positions whose pair has that rank; a bitmap of the ranks
in two levels gives, by find-first-set, the lowest rank in use. The positions of the lowest bucket are merged from
left to right; each merge may open two new pairs, and where one of them ranks lower the bitmap is asked again
before the next merge. Entries whose pair has changed meanwhile are stale and skipped. The cost is near-linear in
the length of the list, so very long pre-tokens are no trouble, and short ones share the cost of the queue.

Texts are cut at single blanks between non-blanks, where no match of the pattern can span, and the ids of such
a chunk are remembered; the memory is bounded. Defined results: null and empty texts have no ids; repeated rows
get equal results; lone surrogates cannot occur in Spark strings; a column of the input named like a result column is refused.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, small_batches

WORD = 8  # 256 ranks to a word of the lower level
MASK = (1 << WORD) - 1
#: Chunks, and pre-tokens, that one Python worker remembers; longer ones are not kept.
REMEMBERED = 800_000
LONG = 64
#: Stands between pre-tokens; no byte of UTF-8 text has this value, so no token that holds it can be in a text.
FENCE = b"\xff"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks:
    """A vocabulary as the queue needs it: ranks of tokens, and of all pairs of single bytes as a table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = {k: v for k, v in ranks.items() if FENCE not in k}
        self.size = max(ranks.values(), default=0) + 1
        self.byte = np.full(256, -1, np.int64)
        self.pair = np.full(1 << 16, -1, np.int64)
        for k, v in self.of.items():
            if len(k) == 1:
                self.byte[k[0]] = v
            elif len(k) == 2:
                self.pair[k[0] << 8 | k[1]] = v


def merge_ids(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
    if not pieces:
        return []
    raw = FENCE + FENCE.join(pieces) + FENCE
    data = np.frombuffer(raw, np.uint8)
    n, get = len(raw), ranks.of.get
    starts = np.append(ranks.pair[data[:-1].astype(np.int64) << 8 | data[1:]], -1)
    pair, ids = starts.tolist(), ranks.byte[data].tolist()  # rank of the pair that starts here, -1: none; id of the token that starts here
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # the queue: buckets by rank, words of the bitmap, and the bitmap of words in use
    buckets: dict[int, list[int]] = {}
    words, summary = [0] * ((ranks.size >> WORD) + 1), 0
    some = np.flatnonzero(starts >= 0)
    some = some[np.argsort(starts[some], kind="stable")]
    edge = [*np.flatnonzero(np.diff(starts[some], prepend=-1)).tolist(), len(some)]
    in_order = some.tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        rank = pair[in_order[a]]
        buckets[rank] = in_order[a:b]
        words[rank >> WORD] |= 1 << (rank & MASK)
        summary |= 1 << (rank >> WORD)
    while summary:
        w = (summary & -summary).bit_length() - 1
        bits = words[w]
        low = bits & -bits
        rank = (w << WORD) + low.bit_length() - 1
        words[w] = bits ^ low
        if bits == low:
            summary ^= 1 << w
        held = buckets.pop(rank)
        held.sort()
        for k, at in enumerate(held):
            if pair[at] != rank:
                continue
            gone = after[at]
            right = after[at] = after[gone]
            before[right] = at
            pair[gone] = ids[gone] = -1
            ids[at] = rank
            lowest = rank
            one = get(raw[at : after[right]], -1)
            pair[at] = one
            if one >= 0:
                if one in buckets:
                    buckets[one].append(at)
                else:
                    buckets[one] = [at]
                    words[one >> WORD] |= 1 << (one & MASK)
                    summary |= 1 << (one >> WORD)
                    if one < lowest:
                        lowest = one
            left = before[at]
            two = pair[left] = get(raw[left:right], -1)
            if two >= 0:
                if two in buckets:
                    buckets[two].append(left)
                else:
                    buckets[two] = [left]
                    words[two >> WORD] |= 1 << (two & MASK)
                    summary |= 1 << (two >> WORD)
                    if two < lowest:
                        lowest = two
            if lowest < rank:
                # a new pair goes first; what is left of this bucket waits its turn
                if k + 1 < len(held):
                    buckets[rank] = held[k + 1 :]
                    words[w] |= low
                    summary |= 1 << w
                break
    found = np.array(ids, np.int64)
    fence = data == FENCE[0]
    alive = (found >= 0) & ~fence
    ends = (np.cumsum(alive)[fence] * 4).tolist()
    out = found[alive].astype("<u4").tobytes()
    return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Codec:
    """encode and decode for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.ranks, self.pattern = Ranks(ranks), regex.compile(pattern)
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.of_rest: dict[str, bytes] = {}  # ids of chunks after a blank
        self.of_piece: dict[str, bytes] = {}  # ids of pre-tokens

    def _of_pieces(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens."""
        known = self.of_piece
        new = list(set(chain.from_iterable(lists)).difference(known))
        raw = [x.encode() for x in new]
        whole = list(map(self.ranks.of.get, raw))
        merged = iter(merge_ids([x for x, r in zip(raw, whole, strict=True) if r is None], self.ranks))
        fresh = {x: next(merged) if r is None else r.to_bytes(4, "little") for x, r in zip(new, whole, strict=True)}
        if not fresh:
            return [b"".join([known[x] for x in some]) for some in lists]
        out = [b"".join([fresh[x] if x in fresh else known[x] for x in some]) for some in lists]
        _remember(known, fresh)
        return out

    def _of_chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks that follow a blank."""
        return dict(zip(new, self._of_pieces([self.pattern.findall(" " + x) for x in new]), strict=True))

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        gc.disable()  # nothing here forms cycles, and the collector would walk all lists again and again
        try:
            return self._encode_all(texts)
        finally:
            gc.enable()

    def _encode_all(self, texts: Iterable[str]) -> list[bytes]:
        parts = [cut(x) for x in texts]
        known = self.of_rest
        heads = self._of_pieces([self.pattern.findall(x[0]) for x in parts])
        rest = [x[1:] for x in parts]
        fresh = self._of_chunks(list(set(chain.from_iterable(rest)).difference(known)))
        if len(known) + len(fresh) <= REMEMBERED:
            _remember(known, fresh)
            get = known.__getitem__ if all(len(x) <= LONG for x in fresh) else lambda x: known[x] if x in known else fresh[x]
            return [b"".join([a, *map(get, b)]) for a, b in zip(heads, rest, strict=True)]
        out = [b"".join([a, *[fresh[x] if x in fresh else known[x] for x in b]]) for a, b in zip(heads, rest, strict=True)]
        _remember(known, fresh)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


def _remember(known: dict[str, bytes], fresh: dict[str, bytes]) -> None:
    """Add the short ones of fresh to known; a full memory starts anew."""
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
    for x, ids in fresh.items():
        if len(x) <= LONG and len(known) < REMEMBERED:
            known[x] = ids


#: All white space but the blank: the ASCII part, and the rest.
SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace() and c != 32]
SPACES = [c for c in SPACES if c < "\x80"], [c for c in SPACES if c >= "\x80"]


def loose(text: str) -> bool:
    """Whether a blank stands next to other white space or at an end of the text."""
    some = SPACES[0] if text.isascii() else SPACES[0] + SPACES[1]
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(f" {c}" in text or f"{c} " in text for c in some)


def cut(text: str) -> list[str]:
    """The text in chunks, cut at single blanks with non-blanks on both sides, which are left out: no match of the pattern spans one, and the next match starts with it."""
    parts = text.split(" ")
    if not loose(text):
        return parts
    out = [parts[0]]
    for x in parts[1:]:
        last = out[-1]
        if x and last and not x[0].isspace() and not last[-1].isspace():
            out.append(x)
        else:
            out[-1] = f"{last} {x}"
    return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode_udf(path: str, pattern: str):
    """text -> binary ids."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(codec(path, pattern).encode_all(_texts(texts)), pa.binary())

    return encode


def decode_udf(path: str, pattern: str):
    """binary ids -> bytes of the text."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(x.as_py() or b"") for x in ids], pa.binary())

    return decode


DIGESTS = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def round_trip_udf(path: str, pattern: str):
    """text -> number and digest of its ids, and digest of the bytes decoded from them, in one pass."""

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def both(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        ids = own.encode_all(_texts(texts))
        cols = [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, DIGESTS, strict=True)], names=[n for n, _ in DIGESTS])

    return both


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids, binary little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "ids"), encode_udf(path, pattern)(F.col(f"`{text_col}`")))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the bytes of the text."""
    small_batches(encoded.sparkSession)
    return encoded.withColumn(free_name(encoded, "decoded"), decode_udf(path, pattern)(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column _bpe: n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "_bpe"), round_trip_udf(path, pattern)(F.col(f"`{text_col}`")))

"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Documents are sorted by id over range partitions; each task encodes its texts, appends the end id and cuts the
run of ids into blocks of whole documents. In a block, frequent neighbouring pairs are replaced by nonterminals
again and again; the block stores its rules, the expansion length of each nonterminal, the remaining symbols and
where documents start, so one document is decoded without expanding the symbols before it.

A file is a Parquet table with a row for each block, in the shared store. Its binary fields are little-endian:
rules (pairs of u4), lengths (u4 for each rule), symbols (u4, or u2 if width is 2), doc_ids (i8), doc_tokens (u4).

Defined results: null and empty texts consist of the end id; null doc_ids come first; rows with equal ids are
all kept, ordered by a hash of the text, equal rows in any order; an empty table gives an empty file; columns other than doc_id and text are
not read, and a doc_id that is no whole number becomes null. The tokenizers library encodes each piece once and its ids
are remembered (a bounded number), which gives its ids for the whole text since such a tokenizer drops white space and
merges nothing across it; with files of another make it encodes whole texts. The name of an added token in a text
becomes its id, as the library does unless told otherwise.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import scratch, small_batches, whole_id

END_ID = 1
FIRST_RULE = 1 << 17  # above all vocabulary ids
BLOCK_IDS = 1 << 18
LEAST_COUNT = 12  # a pair is frequent from here
REMEMBERED = 800_000
LONG_CHUNK = 64  # longer chunks are not remembered
BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_in_part", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("least_id", pa.int64()), ("width", pa.int32()),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.binary()), ("no_id", pa.int64()), ("doc_tokens", pa.binary()),
])
BLOCKS_DDL = "part int, block int, first_in_part long, n_ids long, n_docs long, least_id long, width int, rules binary, lengths binary, symbols binary, doc_ids binary, no_id long, doc_tokens binary"


def compress(ids: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths) of Re-Pair over ids, which goes on until no pair occurs least times any more.

    A round counts the neighbouring pairs and goes through the frequent ones from the most frequent down. A pair is
    taken if so far its first symbol is only first and its second only second in the pairs taken; such pairs never
    overlap, so all their occurrences are replaced at once. A pair of equal symbols is taken alone with its symbol, and
    a run of them is paired off from its left end. A pair that was rare stays rare unless a new symbol is in it, so
    a round looks only at places that were frequent before or touch a symbol of the round before.
    """
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    n_rules = 0
    at = np.arange(max(len(seq) - 1, 0))
    while len(at):
        pair, place = _by_pair(seq, at, FIRST_RULE + n_rules)
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.append(edge, len(pair)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        pairs, count = pair[edge[often]], count[often]
        frequent = np.zeros(len(edge), bool)
        frequent[often] = True
        at, which = place[np.repeat(frequent, np.diff(np.append(edge, len(pair))))], np.repeat(np.arange(len(pairs)), count)
        first: set[int] = set()
        second: set[int] = set()
        rule = np.full(len(pairs), -1, np.int64)
        own: list[int] = []
        best = np.lexsort((pairs, -count))
        for k, pair in zip(best.tolist(), pairs[best].tolist(), strict=True):
            x, y = pair >> 32, pair & 0xFFFFFFFF
            if x not in second and y not in first and (x != y or (x not in first and y not in second)):
                first.add(x)
                second.add(y)
                rule[k] = len(own)
                own.append(pair)
        number = rule[which]
        put, number = at[number >= 0], number[number >= 0]
        # places are in order within a pair; a run of twins lies within one
        twins = seq[put] == seq[put + 1]
        if twins.any():
            # in a run of equal symbols every second place, from its left end
            place = put[twins]
            start = np.maximum.accumulate(np.where(np.diff(place, prepend=-2) == 1, 0, np.arange(len(place))))
            keep = ~twins
            keep[np.flatnonzero(twins)] = (np.arange(len(place)) - start) % 2 == 0
            put, number = put[keep], number[keep]
        seq[put] = FIRST_RULE + n_rules + number
        stay = np.ones(len(seq), bool)
        stay[put + 1] = False
        look = np.zeros(len(seq), bool)
        look[at] = look[put] = look[np.maximum(put - 1, 0)] = True
        seq = seq[stay]
        at = np.flatnonzero(look[stay][:-1])
        new = np.array(own, np.int64)
        new = np.stack([new >> 32, new & 0xFFFFFFFF], 1)
        size_of = lambda s: np.where(s >= FIRST_RULE, lengths[np.maximum(s - FIRST_RULE, 0)] if len(lengths) else 1, 1)
        lengths = np.concatenate([lengths, size_of(new[:, 0]) + size_of(new[:, 1])])
        rules.append(new)
        n_rules += len(own)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths


def _by_pair(seq: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, places) of the neighbours at each place, ordered by pair and then place."""
    pair = seq[at] << 32 | seq[at + 1]
    bits, low = top.bit_length(), len(seq).bit_length()
    if 2 * bits + low > 63:
        order = np.argsort(pair, kind="stable")
        return pair[order], at[order]
    # pair and place fit one number, and numbers sort faster than their order
    both = np.sort((seq[at] << bits | seq[at + 1]) << low | at)
    pair = both >> low
    return (pair >> bits) << 32 | (pair & ((1 << bits) - 1)), both & ((1 << low) - 1)


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """All ids of symbols: each rule is spelled out once, and every symbol copies its spelling."""
    spelled: list[np.ndarray] = []
    for x, y in rules.tolist():
        parts = [spelled[s - FIRST_RULE] if s >= FIRST_RULE else np.array([s], np.uint32) for s in (x, y)]
        spelled.append(np.concatenate(parts))
    if not spelled:
        return symbols.astype(np.uint32)
    size = np.array([len(x) for x in spelled])
    at = np.cumsum(size) - size
    flat = np.concatenate(spelled)
    big = symbols >= FIRST_RULE
    rule = np.where(big, symbols - FIRST_RULE, 0)
    width = np.where(big, size[rule], 1)
    ends = np.cumsum(width)
    out = np.repeat(np.where(big, 0, symbols).astype(np.uint32), width)
    k = np.flatnonzero(big)
    w = width[k]
    step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    out[np.repeat(ends[k] - w, w) + step] = flat[np.repeat(at[rule[k]], w) + step]
    return out


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of a block: the expansion lengths locate the symbols that hold them and, within their rules, the halves that do, so no other rule is looked at."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    size = np.where(symbols >= FIRST_RULE, lengths[np.maximum(symbols - FIRST_RULE, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left")
    lo, hi = start - (int(ends[a - 1]) if a else 0), start + n - (int(ends[b - 1]) if b else 0)
    # symbols still to spell, the next one last, with the ids of their expansion that are wanted
    todo = [(int(s), lo if k == a else 0, hi if k == b else int(size[k])) for k, s in zip(range(b, a - 1, -1), symbols[a : b + 1][::-1])]
    out: list[int] = []
    while todo:
        s, lo, hi = todo.pop()
        if lo >= hi:
            continue
        if s < FIRST_RULE:
            out.append(s)
            continue
        x, y = rules[s - FIRST_RULE].tolist()
        left = int(lengths[x - FIRST_RULE]) if x >= FIRST_RULE else 1
        todo.append((y, max(lo - left, 0), hi - left))
        todo.append((x, lo, min(hi, left)))
    return np.array(out, np.uint32)


def chunks(text: str) -> list[str]:
    """The text between white space; four control characters that str.split() takes for white space are none here."""
    return text.split() if CONTROLS.search(text) is None else [x for x in SPACES.split(text) if x]


CONTROLS, SPACES = re.compile("[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")


class Remembered(dict):
    """A dict that computes a missing value from its key; keys up to LONG_CHUNK characters are kept, most at most."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Whole texts to ids with a tokenizers file.

    If the file's tokenizer parts tokens at white space, a text is cut there. Texts and chunks of printable ASCII and
    Latin-1 are their own normal form but for letter case, so they are lower-cased, cut at white space and, where a chunk is
    new, by the file's pattern, and each new piece goes straight to the library's BPE model; all other chunks, those that hold the name of an added token, and
    the whole texts of other tokenizers go through the whole library. names_as_text: such names are ordinary text.
    """

    def __init__(self, path: str, names_as_text: bool = True):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = names_as_text
        parts = json.loads(self.own.to_str())
        self.names = [x["content"].lower() for x in parts["added_tokens"]]
        self.parted = _parts_at_white_space(parts) and all(chunks(x) == [x] for x in self.names)
        if self.parted:
            self.cut = re.compile(LATIN_PIECES).findall
            self.model = self.own.model
            self.of_chunk, self.of_low = Remembered(self._chunk, REMEMBERED // 4), Remembered(self._low)

    def _library(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, text: str) -> bytes | None:
        """Ids of a text of simple characters and without names of added tokens, else None."""
        if SIMPLE.fullmatch(text) is None:
            return None
        low = text.lower()
        return None if any(x in low for x in self.names) else b"".join(map(self.of_low.__getitem__, low.split()))

    def _low(self, chunk: str) -> bytes:
        """Ids of a lower-cased simple chunk: letters alone are one piece, other chunks are put together from theirs."""
        pieces = [chunk] if chunk.isalpha() else self.cut(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.of_low.__getitem__, pieces))

    def _chunk(self, chunk: str) -> bytes:
        ids = self._simple(chunk)
        return self._library(chunk) if ids is None else ids

    def encode(self, text: str) -> np.ndarray:
        ids = self._simple(text) if self.parted else self._library(text)
        if ids is None:
            ids = b"".join(map(self.of_chunk.__getitem__, chunks(text)))
        return np.frombuffer(ids, "<u4")


PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: The pattern of pieces that LATIN_PIECES restates for simple characters, as the file has it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = re.compile("[\t-\r -~\u00a1-\u00ff]*")


def _of_category(letter: str) -> str:
    """The simple characters of a general category, as the body of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(33, 256)) if unicodedata.category(c)[0] == letter)


LATIN_PIECES = PIECES.replace(r"\p{L}", _of_category("L")).replace(r"\p{N}", _of_category("N"))


def _parts_at_white_space(parts: dict) -> bool:
    """Whether a tokenizer drops white space and merges nothing across it, by its normaliser and its pattern."""
    kinds = [[x["type"] for x in (parts.get(k) or {}).get(inner, [])] for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PIECES


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path, names_as_text=False)


def _block(part: int, number: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> dict:
    ids = np.concatenate([x for _, x in docs])
    symbols, rules, lengths = compress(ids)
    wide = len(symbols) and (symbols.max() >= 1 << 16)
    if wide and (ids.max(initial=0) < FIRST_RULE - (1 << 16)):
        # nonterminals are written right above the vocabulary if all symbols then fit 16 bits
        top = int(ids.max()) + 1
        if top + len(rules) <= 1 << 16:
            down = lambda s: np.where(s >= FIRST_RULE, s - FIRST_RULE + top, s)
            return _row(part, number, first, docs, len(ids), 2, top, down(symbols), down(rules), lengths)
    return _row(part, number, first, docs, len(ids), 4, FIRST_RULE, symbols, rules, lengths)


def _row(part, number, first, docs, n, width, top, symbols, rules, lengths) -> dict:
    known = [d for d, _ in docs if d is not None]
    return {
        "part": part, "block": number, "first_in_part": first, "n_ids": n, "n_docs": len(docs), "least_id": min(known, default=None), "width": width,
        "rules": np.append(np.array([top]), rules.ravel()).astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(),
        "doc_ids": np.array(known, "<i8").tobytes(), "no_id": len(docs) - len(known), "doc_tokens": np.array([len(x) for _, x in docs], "<u4").tobytes(),
    }


def _encode_part(path: str):
    def run(batches):
        own, part = encoder(path), TaskContext.get().partitionId()
        number = first = held = 0
        docs: list[tuple[int | None, np.ndarray]] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = own.encode(text.as_py() or "")
                docs.append((doc, np.append(x, np.uint32(END_ID))))
                held += len(x) + 1
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pylist([_block(part, number, first, docs)], BLOCKS)
                    number, first, held, docs = number + 1, first + held, 0, []
        if docs:
            yield pa.RecordBatch.from_pylist([_block(part, number, first, docs)], BLOCKS)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, partitions: int | None = None) -> None:
    """Encode docs (doc_id long, text) in ascending doc_id order and write the blocks to path."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), "h", "row"
    rows = docs.select(whole_id(docs, "doc_id").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    # the hash and the number keep rows that share an id, or have none, and rows that are equal from falling to one task
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_encode_part(tokenizer), BLOCKS_DDL).write.parquet(path)


def _grammar(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(row["rules"], "<u4").astype(np.int64)
    top, rules = head[0], head[1:].reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
    up = lambda s: np.where(s >= top, s - top + FIRST_RULE, s)
    return up(symbols), up(rules), np.frombuffer(row["lengths"], "<u4").astype(np.int64)


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _decode_blocks(digest: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, _ = _grammar(row)
                ids = expand(symbols, rules).astype("<u4")
                sizes = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                doc_ids = [None] * row["no_id"] + np.frombuffer(row["doc_ids"], "<i8").tolist()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                parts = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                last = [zlib.crc32(x) for x in parts] if digest else parts
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["base"] + row["first_in_part"]), pa.array(sizes), pa.array(last, (DIGEST if digest else DOCS)[3].type)], schema=DIGEST if digest else DOCS)

    return run


def _based(blocks: DataFrame) -> DataFrame:
    """blocks with base: the ids of all partitions before. The running sum is over one row for each partition."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each partition of the writing job, which the writer bounds
    return blocks.join(F.broadcast(bases), F.col("part") == F.col("_part")).drop("_part")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary u4) of every document in the file."""
    small_batches(spark)
    return _based(spark.read.schema(BLOCKS_DDL).parquet(path)).mapInArrow(_decode_blocks(False), "doc_id long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens() with the crc32 of the decoded ids in place of them."""
    small_batches(spark)
    return _based(spark.read.schema(BLOCKS_DDL).parquet(path)).mapInArrow(_decode_blocks(True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the named documents (a small list): only their symbols are expanded."""
    wanted = set(doc_ids)
    least = min(wanted, default=0)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known = np.frombuffer(row["doc_ids"], "<i8")
                at = np.flatnonzero(np.isin(known, list(wanted)))
                if not len(at):
                    continue
                symbols, rules, lengths = _grammar(row)
                sizes = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                some = at + row["no_id"]
                out = [expand_range(symbols, rules, lengths, int(starts[k]), int(sizes[k])).astype("<u4").tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    small_batches(spark)
    blocks = spark.read.schema(BLOCKS_DDL).parquet(path).where(F.col("least_id") <= max(wanted, default=least))
    return blocks.mapInArrow(run, "doc_id long, ids binary")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to a new file in the shared folder and read its digests back."""
    path = scratch(docs.sparkSession, "token-file")
    write_tokens(docs, tokenizer, path)
    return read_digests(docs.sparkSession, path)

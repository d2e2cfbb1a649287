"""License scans: fuzzy search for short notices.

A text becomes its lower-cased words joined by single blanks. A notice that may hold k edits is cut into k+1
pieces; by the pigeonhole principle each occurrence with at most k edits holds one piece unchanged, so exact
searches for the pieces locate all candidates. Only the window round a candidate is given to the regex
library, whose bounded-error matching verifies the edits and reports the span.

Edits never change a version: the first number in a finding, or else the word after it, is the notice's number or no
number at all. Defined results: null and empty texts have no words and no labels; repeated rows get equal results; of
overlapping findings the one with the fewest edits counts (then the longest, then the first by label); a column
_license of the input is refused.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, small_batches

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices searched with edits (text in words, label, edits allowed).
NOTICES = (
    ("under the mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("apache license version 2", "apache-2", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("under cc by nc", "cc-by-nc", 1),
    ("gnu general public license version 3", "gpl-3", 3),
    ("gnu general public license version 2", "gpl-2", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission to use copy modify and or distribute this software", "isc", 4),
    ("free and unencumbered software released into the public domain", "unlicense", 4),
)
#: A byte of a word stays (A-Z lower-cased); others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:array<struct<label:string,first_word:long,n_words:long,edits:int,text:string>>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def pieces(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """The notice in edits + 1 pieces of about equal length, each with its offset."""
    raw, n = notice.encode(), edits + 1
    cuts = [round(k * len(raw) / n) for k in range(n + 1)]
    return [(raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=8)
def compiled(notices: tuple = NOTICES) -> list[tuple]:
    return [(notice.encode(), label, k, pieces(notice, k), regex.compile(b"(?b)(?:" + regex.escape(notice.encode(), special_only=True) + b"){e<=%d}" % k)) for notice, label, k in notices]


def _places(text: bytes, some: bytes):
    at = text.find(some)
    while at >= 0:
        yield at
        at = text.find(some, at + 1)


def exact_places(joined: bytes, phrase: bytes) -> list[int]:
    """Offsets at which the phrase's words stand consecutively. joined: words with a blank before, between and after."""
    return [at + 1 for at in _places(joined, b" " + phrase + b" ")]


def same_version(joined: bytes, start: int, end: int, notice: bytes) -> bool:
    """Whether the first number in the words of a finding, and the word after it, is the one that ends the notice; notices without a number, and findings without one, pass."""
    version = notice.split()[-1]
    if not version.isdigit():
        return True
    a = joined.rfind(b" ", 0, start + 1) + 1 if joined[start : start + 1] != b" " else start
    stop = joined.find(b" ", end)
    inside = joined[a : stop if stop >= 0 else len(joined)].split()
    after = joined[stop + 1 : stop + 32].split()[:1] if stop >= 0 else []
    numbers = [x for x in inside + after if x.isdigit()]
    return not numbers or numbers[0] == version


def fuzzy_spans(joined: bytes, notices: tuple = NOTICES) -> list[tuple[int, int, int, str]]:
    """(start, end, edits, label) of all notices; overlapping findings are resolved.

    Each candidate window gives its best match; where a better finding overlaps that match, what the window holds on
    both sides of the finding is searched again, so a neighbour never hides an occurrence.
    """
    heap: list[tuple] = []

    def look(n: int, a: int, b: int) -> None:
        notice, label, k, _, pattern = compiled(notices)[n]
        while b - a >= len(notice) - k and (m := pattern.search(joined, a, b)):
            if same_version(joined, m.start(), m.end(), notice):
                heappush(heap, (sum(m.fuzzy_counts), m.start() - m.end(), label, m.start(), n, a, b))
                return
            a = m.start() + 1

    for n, (notice, _, k, seeds, _) in enumerate(compiled(notices)):
        for a, b in {(max(0, at - off - k), min(len(joined), at - off + len(notice) + k)) for seed, off in seeds for at in _places(joined, seed)}:
            look(n, a, b)
    kept: list[tuple[int, int, int, str]] = []  # in order and disjoint
    while heap:
        edits, minus, label, start, n, a, b = heappop(heap)
        at = bisect_left(kept, (start,))
        over = next((x for x in kept[max(0, at - 1) : at + 1] if x[0] < start - minus and start < x[1]), None)
        if over is None:
            kept.insert(at, (start, start - minus, edits, label))
        else:
            look(n, a, over[0])
            look(n, over[1], b)
    return kept


def scan_text(text: str | None, base: tuple = BASE, notices: tuple = NOTICES) -> dict:
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places = [(at, label) for phrase, label in base for at in exact_places(joined, phrase.encode())]
    fuzzy = fuzzy_spans(joined, notices)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if places or fuzzy else np.zeros(0, np.int64)

    def word_at(at: int) -> int:
        """The word at an offset, or the one after a blank there."""
        return int(np.searchsorted(blanks, at)) - (joined[at : at + 1] != b" ")

    exact = [(word_at(at), label) for at, label in places]
    spans = [{"label": label, "first_word": min(word_at(a), max(len(words) - 1, 0)), "n_words": len(joined[a:b].split()), "edits": e, "text": joined[a:b].decode("utf-8", "replace")} for a, b, e, label in fuzzy]
    starts, own = [w for w, _ in exact], {label for _, label in exact}
    score = max([1.0] * bool(own) + [1 - e / (b - a + e) for a, b, e, _ in fuzzy], default=0.0)
    return {
        "n_words": len(words), "n_base": len(exact), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[3] for x in fuzzy})), "score": score, "spans": spans,
    }


RESULT_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))),
])


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(x.as_py()) for x in texts], RESULT_ARROW)


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column _license: counts, base and all labels, score, and the spans of all notices."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "_license"), F.arrow_udf(_scan, RESULT)(F.col(f"`{text_col}`")))

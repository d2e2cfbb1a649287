"""Quality rules: decision lists learned by sequential covering.

Statistics of each whole text are computed in Arrow batches. From labelled statistics, rules (conjunctions
of thresholds that mean "reject") are grown greedily on two thirds of the sample and pruned on the rest;
accepted rules become one ordered Spark conditional expression, which then runs in the JVM over all rows.

Defined results: a null or empty text has no words, so all its counts are 0; repeated rows are treated
alike; an empty table gives an empty result; without labels of both classes the list is empty and only the
base rule rejects. Null labels and labels without a document are left out of the sample, and an id counts once in it
for each of its labels, however often it repeats; a column _quality of the input is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, small_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("n_upper", "long"), ("n_stops", "long"), ("n_distinct", "long"), ("n_lines", "long"),
)
STATS_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in STATS) + ">"
UPPER, STOPS, BLANKS = bytes(range(65, 91)), b".!?", b" \t\n\r\x0b\x0c"
#: Ratios on which rules may test, as SQL over the statistics.
FEATURES = {
    "words": "n_words",
    "word_len": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words that lie in a window of so many words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(key, np.unique(again)))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    count = lambda some: len(raw) - len(raw.translate(None, some))
    return (len(words), len(text) - blanks, count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), count(UPPER), count(STOPS), len(set(words)), len(lines))


def _stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py()) for x in texts]
    cols = np.array(rows, np.int64).reshape(-1, len(STATS)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=[n for n, _ in STATS])


def stats(text: str) -> Column:
    """The struct of STATS for a text column."""
    return F.arrow_udf(_stats, STATS_TYPE)(F.col(text))


@dataclass(frozen=True)
class Rule:
    """All tests hold => reject. tests: (feature, '<=' or '>', threshold)."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.tests)

    def hits(self, x: pd.DataFrame) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, op, t in self.tests:
            ok &= (x[f] <= t).to_numpy() if op == "<=" else (x[f] > t).to_numpy()
        return ok


def features(x: pd.DataFrame) -> pd.DataFrame:
    one = lambda c: np.maximum(x[c], 1)
    return pd.DataFrame({
        "words": x.n_words, "word_len": x.word_chars / one("n_words"), "symbols": x.n_symbols / one("n_words"), "dup_lines": x.n_dup_lines / one("n_lines"),
        "repeats": x.n_repeat_words / one("n_words"), "upper": x.n_upper / one("word_chars"), "stops": x.n_stops / one("n_words"), "distinct": x.n_distinct / one("n_words"),
    }).astype(float)


def _grow(x: pd.DataFrame, bad: np.ndarray, max_tests: int) -> tuple[tuple[str, str, float], ...]:
    """Add the test with the best information gain (FOIL) until no good row is covered."""
    tests: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), bool)
    while len(tests) < max_tests and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (0.0, None)
        for f in FEATURES:
            v, b = x[f].to_numpy()[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p_le, all_le = np.cumsum(b)[cut], cut + 1
            for op, p, n in (("<=", p_le, all_le - p_le), (">", p0 - p_le, (len(v) - all_le) - (p0 - p_le))):
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (f, op, round(float((v[cut[k]] + v[cut[k] + 1]) / 2), 6)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],), 0, 0).hits(x)
    return tuple(tests)


def _prune(tests, x: pd.DataFrame, bad: np.ndarray):
    """Drop final tests as long as (bad - good) / covered on the pruning rows does not fall."""
    def worth(some):
        hit = Rule(some, 0, 0).hits(x)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(hit.sum(), 1)

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn(sample: pd.DataFrame, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.97, min_share: float = 0.002, min_covered: int = 5) -> list[Rule]:
    """Sequential covering over labelled statistics (columns of STATS and quality 0/1; 0 is rejected).

    What the base rule rejects is left out. A rule is accepted when at least min_precision of what it covers, of the
    rows left and also of those of them that it was not grown on, is labelled 0 and these are min_covered rows and min_share of the sample, so that documents labelled
    good stay; what a rule covers that is not accepted is set aside, and covering goes on with the rest.
    """
    sample = sample[~((sample.n_words < 20) | (100 * sample.n_repeat_words > 30 * sample.n_words))] if len(sample) else sample
    x, bad = features(sample).reset_index(drop=True), (sample.quality == 0).to_numpy()
    rules: list[Rule] = []
    min_covered = max(min_covered, round(min_share * len(x)))
    left = np.ones(len(x), bool)
    turn = np.arange(len(x)) % 3
    for _ in range(4 * max_rules):
        if len(rules) >= max_rules or (left & bad).sum() < min_covered or not (left & ~bad).any():
            break
        grow, prune = left & (turn != 0), left & (turn == 0)
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        tests = _grow(x[grow], bad[grow], max_tests)
        if not tests:
            break
        tests = _prune(tests, x[prune], bad[prune])
        hit = Rule(tests, 0, 0).hits(x) & left
        good, wrong = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not hit.any():
            break
        # as precise on the rows that it was not grown on
        unseen, wrong_unseen = int((hit & prune & bad).sum()), int((hit & prune & ~bad).sum())
        if good >= min_covered and good / (good + wrong) >= min_precision and unseen >= min_precision * (unseen + wrong_unseen):
            rules.append(Rule(tests, round(good / (good + wrong), 4), good))
        left &= ~hit
        turn = (turn + 1) % 3
    return rules


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the number of the first rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(rules, 1):
        out = out.when(F.expr(r.sql()), F.lit(k))
    return out.otherwise(F.lit(None).cast("int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> pd.DataFrame:
    """Statistics of at most max_labelled labelled documents, those with the smallest hash of their id.

    The bound is a parameter, so the sample may be broadcast and the rules fitted on the driver.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("_id IS NOT NULL AND quality IN (0, 1)")
        .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "quality").limit(max_labelled)
    )
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(picked), "_id").select("_h", "_id", "quality", stats("_text").alias("s"))
    # rows that repeat an id would take the sample beyond its bound
    found = found.groupBy("_h", "_id", "quality").agg(F.min("s").alias("s"))
    return found.select("_h", "_id", "quality", "s.*").toPandas().sort_values(["_h", "_id", "quality"]).reset_index(drop=True)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with a struct column _quality: the statistics, base_failed, rule (number of the rule that rejects) and kept."""
    small_batches(docs.sparkSession)
    free_name(docs, "_quality")
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), stats("text").alias("_s"))
    judged = seen.select("_doc", "_s.*").select("_doc", *[n for n, _ in STATS], base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.select("_doc.*", F.struct(*[n for n, _ in STATS], "base_failed", "rule", "kept").alias("_quality"))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> tuple[DataFrame, list[Rule]]:
    """Learn from labels and judge all docs. Returns apply_rules() and the ordered rules."""
    rules = learn(labelled_sample(docs, labels, max_labelled), **options)
    return apply_rules(docs, rules), rules

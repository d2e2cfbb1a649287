"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds one row for each blob
and rule version that was ever scanned, with its findings, even if there are none. A run scans only blobs
whose pair with the current rule version is not in the ledger, appends them, and joins the ledger's findings
back to all paths that hold the blob.

Spans come from two regex passes that agree on the matches: split() gives what lies between them and
regexp_extract_all() the matches, so running lengths give code point positions. Running values over a text's matches
are taken in chunks (running()), so a text with very many of them costs no square of their number.

Defined results: null content counts as empty and has no spans; null and repeated paths keep their rows; a blob that two
runs appended at the same time counts once; a key block has at most 16 header lines and its body any number of lines, an
END line or none; an empty table gives an empty result; columns _spans and _blob of the
input are refused, others may have any name. Copies are scanned once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, scratch


def _either(words: str) -> str:
    """Letters of a pattern in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """A match of pattern is kept if its text, or its group where group > 0, has at least least characters. hint: a literal without which nothing matches."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str = ""


ASSIGN = "(" + _either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 12, 2), Rule("access", "AKIA[A-Z0-9]+", 18, 0, "AKIA"), Rule("hex", "[0-9a-f]{16,}", 16))
#: A key block: header lines, then all up to the END line, or, without one, the lines of nothing but the base-64 alphabet.
KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[\t\n\r ]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n]*\n){0,16}"
    r"(?:[A-Za-z0-9+/=\\\t\n\r ]*-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\\\n\r]*(?:[A-Za-z0-9+/=](?m:$)|\\[nr])|)"
)
#: What the method adds to the base kinds.
MORE = (
    Rule("private_key", KEY, 0, 0, "PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, "eyJ"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}", 0, 0, "AIza"),
    Rule("stripe", "sk_live_[0-9A-Za-z]{24,}", 0, 0, "sk_live_"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: Items to a chunk of running(), and code points to a piece of text in redacted().
CHUNK, PIECE = 64, 4096


def once(value: Column, use) -> Column:
    """use(value) with value computed a single time, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, kind: str, step) -> Column:
    """array<struct<at, out>> over chunks of items: each chunk starts from the at of the one before and collects an array of type kind.

    step(acc, item) gives the next struct(at, out). Appending copies what an aggregate has gathered, so within chunks it
    costs CHUNK for each item, and across chunks one entry for each.
    """
    none = F.expr(f"CAST(array() AS {kind})")
    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))

    def chunks(x):
        part = lambda acc, c: F.aggregate(F.slice(x, c * CHUNK + 1, CHUNK), F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out")), step)
        return F.aggregate(F.sequence(F.lit(0), (F.size(x) / CHUNK).cast("int")), first, lambda acc, c: F.concat(acc, F.array(part(acc, c))))

    return once(items, chunks)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """All kept matches of one rule, leftmost and non-overlapping, as SPAN."""
    both = once(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda hits: F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("gap")))

    def step(acc, x):
        hit, gap = x["hit"], x["gap"]
        a = acc["at"] + F.length(gap)
        z = a + F.length(hit)
        size = F.length(F.regexp_extract(hit, rule.pattern, rule.group)) if rule.group else F.length(hit)
        span = F.array(F.struct(a.alias("start"), F.lit(number).alias("kind_no"), z.alias("end")))
        return F.struct(z.alias("at"), F.when(size >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.flatten(F.transform(running(both, SPAN, step), lambda x: x["out"]))
    maybe = F.contains(text, F.lit(rule.hint)) if rule.hint else text.rlike(rule.pattern)
    return F.when(maybe, found).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules by start, then rule order."""
    return F.sort_array(F.concat(*[spans_of(text, r, k) for k, r in enumerate(rules)]))


def scan_versions(versions: DataFrame, ledger: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan unseen blobs of versions (any columns, one of them content) and return versions with _spans.

    ledger: path of the ledger table in shared storage; it is created if absent and appended to otherwise.
    """
    spark = versions.sparkSession
    for name in ("_spans", "_blob"):
        free_name(versions, name)
    version = rule_version(rules)
    blob = F.unhex(F.sha2(F.coalesce(F.col(f"`{content}`"), F.lit("")), 256))
    blobs = versions.select(blob.alias("blob_id"), F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("content"))
    if _exists(spark, ledger):
        seen = spark.read.parquet(ledger).where(F.col("rule_version") == version).select("blob_id")
        blobs = blobs.join(seen.hint("merge"), "blob_id", "left_anti")
    # copies agree on the content, so the map side keeps one of each before texts are shuffled
    unseen = blobs.groupBy("blob_id").agg(F.first("content").alias("content"))
    unseen.select("blob_id", F.lit(version).alias("rule_version"), all_spans(F.col("content"), rules).alias("spans")).write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger).where(F.col("rule_version") == version).groupBy(F.col("blob_id").alias("_blob")).agg(F.first("spans").alias("_spans"))
    return versions.withColumn("_blob", blob).join(known.hint("merge"), "_blob").drop("_blob")


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_ledger(spark) -> str:
    return scratch(spark, "blob-ledger")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with each span, overlapping ones merged, replaced by mark.

    Spans are in order of their start. A gap is put together from pieces of the text, as a position is found by
    walking from the start of a string.
    """

    def step(acc, s):
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def between(pieces, g):
        first = F.floor(g["a"] / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((g["b"] - 1) / PIECE).cast("int") - first + 1)
        cut = lambda x, k: F.substring(x, F.greatest(g["a"] - (first + k) * PIECE, F.lit(0)) + 1, F.least(g["b"] - (first + k) * PIECE, F.lit(PIECE)) - F.greatest(g["a"] - (first + k) * PIECE, F.lit(0)))
        return F.when(g["b"] > g["a"], F.array_join(F.transform(some, cut), "")).otherwise(F.lit(""))

    def put(found):
        gaps = F.concat(F.flatten(F.transform(found, lambda x: x["out"])), F.array(F.struct(F.element_at(found, -1)["at"].alias("a"), F.length(text).alias("b"))))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.array_join(once(pieces, lambda p: F.transform(gaps, lambda g: between(p, g))), mark)

    return F.when(F.size(spans) == 0, text).otherwise(once(running(spans, "array<struct<a:int,b:int>>", step), put))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

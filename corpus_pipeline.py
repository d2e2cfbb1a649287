"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns
of documents. Nulls: a null text fails the base quality rule and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import byte_bpe, mixing, ngram_join, quality_rules, secret_scan
from tidewake.llm.common import stored, table
from tidewake.llm.queries import bpe_parameters

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    out, _ = quality_rules.quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return out.where("_quality.kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of shingle similarity join, one row stays: that with the smallest id, nulls last.

    Rows are compared by a number of their own, so rows that repeat an id or have none are told apart.
    """
    rows = stored(docs.select(*COLUMNS).withColumns({"_row": F.monotonically_increasing_id(), "_digest": F.xxhash64("text")}), "pipeline-rows")
    groups = ngram_join.ngram_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest", "_row")
    first = rows.select("_row", "doc_id", "_digest").join(groups.hint("merge"), "_row").groupBy("class_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first._row").hint("merge"), "_row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold a secret are replaced in the text; n_chars follows. All documents stay."""
    found = secret_scan.scan_versions(docs.select(*COLUMNS), secret_scan.new_ledger(spark))
    clean = secret_scan.redacted(F.col("text"), F.col("_spans"))
    found = found.select("doc_id", clean.alias("_clean"), "lang", "source", "n_chars", (F.size("_spans") > 0).alias("_hit"))
    return found.select("doc_id", F.col("_clean").alias("text"), "lang", "source", F.when(F.col("_hit"), F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it; those taken 0 times go."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("_mix.copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes."""
    out = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), *bpe_parameters())
    return out.select("doc_id", "source", "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("byte-level BPE", tokens)]
#: The learned rules are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k + 1}")
    return docs

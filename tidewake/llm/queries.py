"""The queries opN_<name> of this subpackage; each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import byte_bpe, language_id, license_scan, mixing, multi_index, ngram_join, period_runs, quality_rules, secret_scan, token_file, toxicity, warc, whitening
from tidewake.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_license.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(f"_mix.{c}") for c in ("size", "source_size", "target", "taken")])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    out, _ = quality_rules.quality_rules(docs.select("doc_id", "text"), labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return out.select("doc_id", *[F.col(f"_quality.{c}") for c in names])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan_versions(docs, secret_scan.new_ledger(spark))
    base = F.filter("_spans", lambda s: s["kind_no"] < len(secret_scan.BASE))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind_no"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)], F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("_spans")).alias("spans"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, _ = language_id.identify(docs)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.rejected")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_parameters() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *bpe_parameters())
    return out.select("doc_id", "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_digest(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of the contract: in a tenth of the documents, told by crc32 of the id, a tail repeats its first words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, period_runs.words_array(F.col("text"))).alias("words"))
    n = F.size("words")
    docs = docs.withColumn("start", F.when(n > 0, (F.col("g") % n).cast("int")))
    docs = docs.withColumn("period", (F.lit(1) + F.floor((n - F.col("start")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    again = F.array_join(period_runs.repeated_from(F.col("words"), F.col("start"), F.col("period")), " ")
    return docs.select("doc_id", F.when(F.col("start").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = period_runs.period_runs(planted(docs), collapsed=False)
    return out.select("doc_id", *[F.col(f"_runs.{c}") for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")])


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip(F.col("_white.whitened").alias("whitened"), F.col("_white.explained").alias("explained"))).alias("at", "c")
    out = out.where("_white IS NOT NULL").select("vec_id", "_white.n", "_white.deviation", "_white.identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "_toxic.score", "_toxic.predicted")


_ALL = (
    op1_license_scan, op2_mix_sources, op3_quality_rules, op4_ngram_join, op5_secret_scan, op6_embedding_near_dedup, op7_language_id, op8_byte_bpe, op9_token_file, op10_warc_archive,
    op11_period_runs, op12_embedding_whitening, op13_toxicity,
)
QUERIES = {f.__name__: f for f in _ALL}

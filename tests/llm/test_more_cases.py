"""Cases of the operators that earlier tests leave out: keys, ledgers, records, grids, forests, clashing names, ties."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm import DOCS, PROSE, naive_links, near_copies, odd, vectors
from tidewake.llm import byte_bpe, language_id, license_scan, mixing, multi_index, ngram_join, quality_rules, secret_scan, token_file, warc
from tidewake.llm.common import drop_scratch, scratch, stored, table
from tidewake.llm.queries import bpe_parameters, tokenizer_path

BODY = "\n".join(["MIIEowIBAAKCAQEA" + "aB3+/x" * 8] * 5)
KEYS = {
    "pem": f"before\n-----BEGIN RSA PRIVATE KEY-----\n{BODY}==\n-----END RSA PRIVATE KEY-----\nafter it", "cut": f"before\n-----BEGIN PRIVATE KEY-----\n{BODY}\n\nplain words after, here",
    "encrypted": f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{BODY}\n-----END RSA PRIVATE KEY----- tail", "prose": "a line -----BEGIN PRIVATE KEY----- in prose stays as it is",
}


def clean(spark, texts):
    x = spark.createDataFrame(list(texts.items()), "path string, text string")
    out = secret_scan.scan_versions(x, secret_scan.new_ledger(spark))
    return {r.path: r.clean for r in out.select("path", secret_scan.redacted(F.col("text"), F.col("_spans")).alias("clean")).collect()}


def test_whole_keys_are_redacted(spark):
    got = clean(spark, KEYS)
    assert got == {"pem": "before\n[REDACTED]\nafter it", "cut": "before\n[REDACTED]\n\nplain words after, here", "encrypted": "[REDACTED] tail", "prose": "a line [REDACTED] in prose stays as it is"}


def test_a_blob_appended_twice_counts_once(spark):
    ledger = secret_scan.new_ledger(spark)
    x = spark.createDataFrame([("a", "token = abcdefghijklmnop"), ("b", "token = abcdefghijklmnop")], "path string, text string")
    secret_scan.scan_versions(x, ledger)
    spark.read.parquet(ledger).coalesce(1).write.mode("append").parquet(ledger)
    assert spark.read.parquet(ledger).count() == 2 and secret_scan.scan_versions(x, ledger).count() == 2


def test_many_hits_take_linear_time(spark):
    def took(n):
        began = time.time()
        text = "see token=abcdefghijklmnop1 now, " * n
        assert clean(spark, {"x": text})["x"] == "see [REDACTED] now, " * n
        return time.time() - began

    took(100)
    assert took(16_000) < 12


def test_warc_names_lines_and_ties(spark):
    big = "z" * 150
    rows = [(1, "http://a/\r\nWARC-Type: evil", big), (1, "u", big), (1, "u", big), (2, None, big), (3, "a b", "short"), (3, "a b", "short")]
    x = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_digest(x).collect())
    assert got == sorted([(1, "response", None, 150), (1, "revisit", 1, 150), (1, "revisit", 1, 150), (2, "revisit", 1, 150), (3, "response", None, 5), (3, "response", None, 5)], key=lambda r: (r[0], r[1]))
    path = scratch(spark, "test-warc")
    warc.write_archive(x, path)
    recs = warc.parsed(warc.rebuild(warc.read_archive(spark, path))).collect()
    assert len({r.warc_id for r in recs}) == len(rows) and all(r.record_type == r.warc_type for r in recs)
    heads = [bytes(r.record).partition(b"\r\n\r\n")[0] for r in recs]
    assert all(h.count(b"WARC-Type: ") == 1 for h in heads) and any(b"http://a/%0D%0AWARC-Type:%20evil" in h for h in heads)
    assert warc.archive_digest(x.limit(0)).count() == 0


def test_warc_record_that_was_changed_is_refused(spark):
    path = scratch(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    rows = warc.rebuild(warc.read_archive(spark, path)).withColumn("record", F.expr("overlay(record PLACING X'00' FROM octet_length(record) - 10)"))
    with pytest.raises(Exception, match="does not match"):
        warc.parsed(rows).collect()


def test_whole_texts_of_another_tokenizer(tmp_path):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    enc = token_file.Encoder(tokenizer_path("byte_bpe_50k.json"), names_as_text=False)
    assert not enc.parted
    for t in ("Hello  World\n two", "", "<|endoftext|>x", "é ü"):
        assert enc.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["runs", "words", "one", "random"])
def test_repair_leaves_no_frequent_pair(name):
    rng = np.random.default_rng(5)
    ids = {"runs": np.full(50_001, 9), "words": np.tile(rng.integers(0, 90, 37), 600), "one": np.array([4]), "random": rng.integers(0, 300, 60_000)}[name].astype("<u4")
    symbols, rules, lengths = token_file.compress(ids)
    assert (token_file.expand(symbols, rules) == ids).all()
    _, count = np.unique(symbols[:-1] << 32 | symbols[1:], return_counts=True) if len(symbols) > 1 else (0, np.zeros(1))
    assert count.max() < token_file.LEAST_COUNT
    if name == "runs":
        assert len(symbols) < 20 and lengths.max() > 4000


def test_rows_that_share_an_id_spread_over_tasks(spark):
    x = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    path = scratch(spark, "test-tokens")
    token_file.write_tokens(x, tokenizer_path("word_bpe_49k.json"), path, 4)
    assert spark.read.parquet(path).select("part").distinct().count() > 1 and token_file.read_tokens(spark, path).count() == 400


def test_grids_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 32)
    rows = vectors(120, 12) + [(20_000 + v, e, g) for v, e, g in vectors(90, 7, 3)] + [(40_000 + i, [float(i % 5 - 2)], 0) for i in range(20)] + [(None, [1.0] * 12, 1), (50_000, [1.0] * 12, 1)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(x).collect()]
    assert sorted(g for g in got if g[0] is not None) == naive_links([r for r in rows if r[0] is not None])
    assert [g for g in got if g[0] is None] == [(None, 0, None)]
    assert set(multi_index.fitted(spark.createDataFrame([(i, 0, e) for i, (_, e, _) in enumerate(rows) if e and None not in e], "key long, label int, vec array<double>"))) == {1, 3, 7, 12}


def test_embedding_recall_on_more_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings").collect()]
    x, ids, lab = np.array([r[1] for r in rows], float), [r[0] for r in rows], np.array([-1 if r[2] is None else r[2] for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :]) & (lab[:, None] >= 0)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings")).collect()}
    assert sum(got[i] for i in ids) >= 0.995 * near.sum() and all(got[i] <= n for i, n in zip(ids, near.sum(1), strict=True))


def test_forest_depth_follows_the_measured_recall(spark, sf_dir):
    exact = [1.0] * 7
    assert ngram_join.shortened_depth(0, exact) == ngram_join.needed_depth() == 5
    assert ngram_join.shortened_depth(10**6, exact) == 6
    assert ngram_join.shortened_depth(10**6, [1, 1, 1, 1, 1, 0.99, 0.9]) == 4
    assert ngram_join.shortened_depth(10**6, [1, 1, 0.5, 0.5, 0.5, 0.5, 0.5]) == 1
    _, _, classes = ngram_join.profiled(spark.createDataFrame(list(enumerate(near_copies(150))), "doc_id long, text string"))
    pairs, recall = ngram_join.forest_recall(classes)
    assert pairs > 100 and recall[1] == 1.0 and recall == sorted(recall, reverse=True)


def test_a_hot_id_with_many_texts(spark):
    texts = near_copies(40)
    rows = [(7, t) for t in texts] + [(7, texts[0])] * 60 + [(None, texts[0]), (None, None)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))).collect()
    assert len(got) == 102 and sum(r.class_id == 7 for r in got) == 100 and sum(r.n_links >= 60 for r in got) >= 61


def test_ids_that_are_no_numbers(spark):
    x = spark.createDataFrame([("a", PROSE), ("12", PROSE), ("13", PROSE)], "doc_id string, text string")
    assert sorted((r.doc_id or 0, r.n_links) for r in ngram_join.ngram_join(x).collect()) == [(0, 0), (12, 1), (13, 1)]


CLASHES = {
    "_license": license_scan.license_scan, "_mix": mixing.mix, "_quality": lambda d: quality_rules.apply_rules(d, []), "_lang": lambda d: language_id.identify(d)[0], "_bpe": lambda d: byte_bpe.round_trip(d, *bpe_parameters()),
    "_spans": lambda d: secret_scan.scan_versions(d, "nowhere"), "_blob": lambda d: secret_scan.scan_versions(d, "nowhere"),
}


@pytest.mark.parametrize("name", sorted(CLASHES))
def test_names_of_results_are_refused(spark, name):
    with pytest.raises(ValueError, match=name):
        CLASHES[name](odd(spark).withColumn(name.upper(), F.lit(1)))


def test_equal_ids_of_other_texts_are_mixed_apart(spark):
    x = spark.createDataFrame([(None if i % 2 else 5, f"some words of text number {i}", "en", "one" if i % 3 else "two", 0) for i in range(600)], DOCS)
    got = mixing.mix(x).select("source", "_mix.*").toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 12).all()


def test_many_sources_are_joined_by_merge(spark, monkeypatch):
    x = spark.createDataFrame([(i, "w " * (i % 30), "en", f"s{i % 7}" if i % 9 else None, 0) for i in range(900)], DOCS)
    key = lambda: sorted((r.doc_id, r.taken) for r in mixing.mix(x).select("doc_id", "_mix.taken").collect())
    few = key()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key() == few


def test_stored_tables_can_be_dropped(spark):
    x = stored(spark.range(5), "test-drop")
    assert x.count() == 5 and drop_scratch(spark) >= 1
    assert not secret_scan._exists(spark, x.inputFiles()[0].rsplit("/", 1)[0])


def test_pipeline_keeps_one_of_repeated_rows(spark, sf_dir):
    import corpus_pipeline as C

    a, b = near_copies(2, 1)[0], near_copies(2, 77)[0]
    x = spark.createDataFrame([(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, b, "en", "s", 1), (2, a, "en", "s", 1)], DOCS)
    assert sorted((r.doc_id, r.text) for r in C.near_duplicates(spark, x, sf_dir).collect()) == sorted([(1, a), (1, b)])
    none = x.limit(0)
    for _, stage in C.STAGES[1:]:
        assert stage(spark, none, sf_dir).count() == 0
    got = C.secrets(spark, spark.createDataFrame([(1, KEYS["pem"], "en", "s", 1)], DOCS), sf_dir).collect()[0]
    assert "MIIE" not in got.text and got.n_chars == len(got.text)


def test_bpe_of_one_very_long_pre_token():
    own = byte_bpe.Codec(*bpe_parameters())
    began = time.process_time()
    for text in ("ab" * 300_000, "a" * 400_000):
        assert own.decode(own.encode(text)) == text.encode()
    assert time.process_time() - began < 60 and hashlib.sha256(own.encode("x" * 70)).digest() == hashlib.sha256(own.encode("x" * 70)).digest()

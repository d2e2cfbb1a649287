"""Blocks of a cluster by what their documents weigh, and the measured recall as a table."""

from pyspark.sql import functions as F

from tests.llm.test_llm import naive_join, near_copies
from tidewake.llm import ngram_join


def test_long_documents_make_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1500)
    rows = list(enumerate(near_copies(60) + near_copies(30, 9) + ["a b c", "", None]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == naive_join(rows)


def test_pairs_of_blocks_stay_within_the_bound(spark):
    members = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 4).alias("cluster"), F.when(F.col("id") % 4 == 0, 1000).otherwise(1).alias("n"))
    x = ngram_join.blocks_of(members, ["cluster"], 512, weight="n", most=10_000)
    n_blocks = {r.cluster: r.b for r in x.groupBy("cluster").agg((F.max("bj") + 1).alias("b")).collect()}
    assert n_blocks == {0: 10, 1: 1, 2: 1, 3: 1}
    # every two members of a cluster meet in exactly one pair of blocks, across blocks or within one
    y = x.where("cluster = 0").collect()
    groups = {}
    for r in y:
        groups.setdefault((r.bi, r.bj), []).append(r)
    met = [tuple(sorted((a.key, b.key))) for (i, j), g in groups.items() for a in g for b in g if a.key < b.key and (i == j or a.own != b.own)]
    assert len(met) == len(set(met)) == 100 * 99 // 2
    # one document that is heavier than a block is a block, never more blocks than documents
    heavy = ngram_join.blocks_of(members.where("cluster = 0"), ["cluster"], 512, weight="n", most=3)
    assert heavy.agg(F.max("bj")).first()[0] < 100


def test_recall_as_a_table(spark):
    docs = spark.createDataFrame(list(enumerate(near_copies(150))), "doc_id long, text string").withColumn("prefix", F.lit(1))
    rows = ngram_join.recall_report(docs).orderBy("prefix").collect()
    assert [r.prefix for r in rows] == [1, 2, 3, 4, 5, 6] and rows[0].recall == 1.0 and rows[0].pairs > 100
    assert [r.recall for r in rows] == sorted((r.recall for r in rows), reverse=True) and sum(r.chosen for r in rows) == 1
    empty = ngram_join.recall_report(docs.limit(0)).collect()
    assert len(empty) == 6 and all(r.pairs == 0 and r.recall == 1.0 for r in empty)

"""Near-duplicates of rows without ids of their own."""

import corpus_pipeline as C

PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all of them in the end"
OTHER = "an entirely different text about harbours, tides and the boats that wait for the next high water of the day"
THIRD = "in the library nobody speaks while the old clock counts out its slow and even seconds until closing time"


def test_one_row_of_each_group_stays(spark):
    rows = [(7, PROSE), (7, PROSE), (7, OTHER), (3, OTHER), (None, THIRD), (None, THIRD), (9, PROSE), (None, PROSE), (5, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = C.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("7", PROSE), ("3", OTHER), ("None", THIRD), ("5", "short")])

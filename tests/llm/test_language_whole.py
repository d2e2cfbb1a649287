"""The language sample leaves out no language and no part of a text."""

from pyspark.sql import functions as F

from tidewake.llm import language_id


def test_all_languages_are_learned(spark):
    docs = spark.range(205 * 12).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 205).alias("lang"))
    _, langs = language_id.training_sample(docs)
    assert len(set(langs)) == 205
    _, langs = language_id.training_sample(docs, 1)
    assert len(set(langs)) == 205


def test_the_end_of_a_text_is_learned(spark):
    head = "lorem ipsum dolor " * 1000
    rows = [(i, head + (f"quick brown foxes jump {i} " if i % 2 else f"schnelle braune füchse springen {i} ") * 800, "en" if i % 2 else "de") for i in range(24)]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # rows are bounded, texts are not
    assert texts and all(len(t) > 30_000 and ("foxes" in t) != ("braune" in t) for t in texts)
    few, _ = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3)
    assert 2 <= len(few) < len(texts) and set(few) <= set(texts)
    assert len(language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 12, 2)[0]) >= 2
    model = language_id.train([head[:6000] + t[-6000:] for t in texts], langs)
    assert model.predict("quick brown foxes jump")[0] == "en" and model.predict("schnelle braune füchse springen")[0] == "de"


def test_scores_are_calibrated_on_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out, _ = language_id.identify(docs)
    held = out.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select((F.col("lang") == F.col("_lang.lang_pred")).alias("right"), "_lang.score").toPandas()
    assert abs(held.right.mean() - held.score.mean()) < 0.03
    for low, high in ((0, 0.9), (0.9, 1.01)):
        some = held[(held.score >= low) & (held.score < high)]
        assert len(some) < 20 or abs(some.right.mean() - some.score.mean()) < 0.15

"""Words counted where rows are read, against the column expressions, and kept indices whose ids repeat."""

from pyspark.sql import functions as F

from tesserine.functions import text as tx
from tesserine.operators import keyword

TEXTS = [None, "", "a b", "Seeding seeding seed-ed ved bed moved x-ING abceding abced\x0babc", "ÄÖ KK İng naïve re­ading", "one\ttwo\x1ftwo two  one::two a_b.c/d--e ing sing bring"]


def test_words_are_those_of_the_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    text = F.col("text")
    for words, tokens in ((tx.Words.keywords(text), tx.tokenize_keywords(text)), (tx.Words.plain(text), tx.tokenize(text)), (tx.Words.plain(text, True), tx.tokenize(text, True))):
        for given in (words, tokens):
            rows = tx.counted(docs, given)
            assert rows.select("id", "dl").exceptAll(docs.select("id", F.size(tokens).alias("dl"))).isEmpty() and rows.count() == len(TEXTS)
            mine = rows.select("id", F.inline("words"))
            listed = docs.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
            assert mine.exceptAll(listed).isEmpty() and listed.exceptAll(mine).isEmpty()


def test_kept_index_sorts_bounded_parts_and_reads_texts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "SORTED_ROWS", 50)
    docs = spark.range(200).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 17)).alias("text"))
    made = keyword.Bm25.build(docs, tx.Words.keywords(F.col("text")))
    index = made.keep(spark, "k", "s", str(tmp_path))
    assert index.postings.count() == 400 and len(list((tmp_path / "k-postings-s").glob("part-*"))) >= 8
    assert index.single and index.totals == (200, 2.0)
    # documents go by their rows: no posting is dealt out by its id
    left = index.remove(docs.where("id % 3 = 0").select("id"))
    assert left.postings.where("term = 'all'").count() == 133 and left.lengths.count() == 133
    plan = left.postings._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(id" not in plan


def test_kept_index_of_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (1, "one"), (2, "two"), (None, "one")], "id long, text string")
    made = keyword.Bm25.build(docs, tx.tokenize_keywords(F.col("text")))
    index = made.keep(spark, "k", "s", str(tmp_path))
    assert not index.single and index.totals == (4, 1.25)
    assert sorted(tuple(r) for r in index.postings.collect()) == [("one", 1, 2, 1), ("one", 1, 2, 2), ("two", 1, 1, 1), ("two", 1, 1, 2), ("two", 2, 1, 1)]

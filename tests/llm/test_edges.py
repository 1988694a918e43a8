"""Nulls, repeated rows, long texts and clashing names, for each operator and for the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

from tesserine.llm import fixity, leaks, licenses, packing, preferences, quality, queries, rans, substrings, urls

CLASH = ["piece", "start", "length", "ids", "offset", "sequence_id", "_row", "_text", "_part", "_rank", "n_words", "leaks", "labels", "kept", "archive", "digest", "host", "place"]
LONG = "word, other words and more of them. " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (None, "same"), (None, "same"), (2, ""), (2, "x y"), (2, "x z"), (3, LONG)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", *[F.lit(7).alias(c) for c in CLASH]).cache()


def test_names_that_operators_use_themselves(spark, odd):
    bench = spark.createDataFrame([(1, "word, other words and more of them")], "item_id long, text string")
    made = {"pack": packing.pack(odd, capacity=512), "leaks": leaks.screen(odd, bench), "scan": licenses.scan(odd), "cascade": quality.cascade(odd), "cut": substrings.deduplicate(odd)}
    for name, frame in made.items():
        assert len({c.lower() for c in frame.columns}) == len(frame.columns), name
        assert {"doc_id", "place", "host"} <= set(frame.columns), name
        assert frame.select(F.sum("place")).first()[0] >= 7 * 7, name
    assert [len(r.leaks) for r in made["leaks"].where("doc_id = 3").collect()] == [1]
    back = rans.round_trip(odd).collect()
    assert len(back) == 7 and sorted(r.start for r in back)[0] == 0
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/de/1").alias("url"), F.col("text").alias("html"), *[c for c in CLASH if c != "host"], F.lit("h").alias("host"))
    judged = urls.judge(pages)
    assert judged.count() == 7 and set(r.verdict for r in judged.collect()) == {"allow"}
    turns = odd.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *CLASH)
    assert preferences.pair(turns, turns.limit(0)).count() == 4


def test_long_pages(spark, tmp_path):
    link = '<a href="http://far.org/es/x">'
    rows = [(1, "http://a.io/" + "p" * 300_000, LONG + link), (2, "http://far.org/es/1", None), (2, "http://far.org/es/1", None), (None, None, LONG)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(queries.op1_url_filters(spark, str(tmp_path)).collect(), key=str)
    assert len(got) == 4 and {r.verdict for r in got if r.page_id == 1} == {"block"} and [len(r.path) for r in got if r.page_id == 1] == [300_001]


def test_repeated_pages_have_the_same_offsets_in_both_replicas(spark, tmp_path):
    rows = [(7 if i % 2 else None, f"http://x/{i % 5}", "h" * (i % 9)) for i in range(60)] + [(7, "http://x/long", LONG)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    # pages with the number 7 are lost from the replica, those without a number are whole
    got = queries.op2_warc_fixity(spark, str(tmp_path)).collect()
    assert {r.damage for r in got} == {"missing"} and {r.archive for r in got} == {"part-000000.warc"} and len(got) == 31


def test_replicas_of_long_records(spark):
    rows = [("f", 0, LONG), ("f", len(LONG), "short"), ("g", 0, None)]
    a = spark.createDataFrame(rows, "archive string, offset long, record string").withColumn("hash", F.lit(1)).withColumn("up", F.lit(2))
    b = a.withColumn("record", F.when(F.col("offset") == 0, F.concat(F.col("record"), F.lit("x"))).otherwise(F.col("record")))
    assert [(r.archive, r.offset, r.damage) for r in fixity.audit(a, b).collect()] == [("f", 0, "changed")]


def test_pipeline_on_odd_tables(spark, sf, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    prose = [" ".join(r.choice("alpha beta gamma delta river stone house tree".split()) + str(r.randint(0, 99)) for _ in range(90)) for _ in range(6)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(prose)] + [(None, prose[0] + " tail", "en", "s", 1), (2, prose[2], "en", "s", 1), (3, prose[5] + " more", None, None, None), (9, None, "en", "s", 1), (10, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf).cache()
            assert now.columns == docs.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert packed.count() == now.count()
    kept = {x.doc_id for x in corpus_pipeline.ngram_jaccard_join(spark, corpus_pipeline.quality_rules(spark, docs, sf), sf).collect()}
    # one of each text stays: 5 stands for the text that row 3 repeats, and the text of row 3 of its own stays too
    assert {0, 1, 2, 3, 4} <= kept and 9 not in kept and 10 not in kept


def test_documents_without_a_word_left_are_left_out(spark, sf):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 0), (2, text, 0), (3, text + " own words", 0), (4, "", 0), (5, None, 0)], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, sf).collect()}
    assert left == {3: "own words", 4: "", 5: None}


def test_screening_a_text_full_of_a_shared_opening(spark):
    opening = "consider the following question and answer "
    bench = spark.createDataFrame([(i, f"{opening} number {i} of the list with words {i * 7919}") for i in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(0, opening * 460)], "doc_id long, text string")
    assert leaks.screen(docs, bench).first().leaks == []

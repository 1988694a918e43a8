import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import hypervector as hv
from tesserine.functions import projection
from tesserine.functions import text as tx

MASK = (1 << 64) - 1


def words(row):
    return np.array([w & MASK for w in row], np.uint64)


def as_int(words_, first_most):
    """All words as one number; the order of words decides which is the most significant."""
    out = 0
    for w in words_ if first_most else reversed(words_):
        out = (out << 64) | int(w)
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.range(4).select("id", hv.seeded(F.col("id")).alias("v"))


def test_seeded_agrees_in_memory(vectors):
    for r in vectors.collect():
        assert (words(r.v) == tx.word_vector(str(r.id))).all()


@pytest.mark.parametrize("shift", [0, 1, 63, 64, 127, 128, 129, 5000, 10239])
def test_rotations(vectors, shift):
    r = vectors.where("id = 1").select("v", hv.permute(F.col("v"), shift).alias("a"), hv.permute_binary(F.col("v"), shift).alias("b")).first()
    turn = lambda x: ((x << shift) | (x >> (hv.BITS - shift))) & ((1 << hv.BITS) - 1)
    wide = words(r.v).reshape(-1, 2)[:, ::-1].reshape(-1)
    got = words(r.a).reshape(-1, 2)[:, ::-1].reshape(-1)
    assert as_int(got, True) == turn(as_int(wide, True))
    assert as_int(words(r.b), False) == turn(as_int(words(r.v), False))
    assert (tx.rotated(words(r.v), shift) == words(r.a)).all()


def test_bytes_round_trip(vectors):
    r = vectors.where("id = 2").select("v", hv.to_bytes(F.col("v")).alias("b")).first()
    assert bytes(r.b) == words(r.v).tobytes() and len(r.b) == hv.BYTES
    with pytest.raises(Exception, match="1280 bytes"):
        vectors.select(hv.from_bytes(F.lit(b"abc"))).collect()


def test_bundle_of_one_two_and_three(spark, vectors):
    rows = vectors.select(F.explode(F.array(F.lit("one"), F.lit("two"), F.lit("three"))).alias("g"), "id", "v").where("(g = 'one' and id = 0) or (g = 'two' and id < 2) or (g = 'three' and id < 3)")
    own = {r.id: words(r.v) for r in vectors.collect()}
    made = {r.g: words(r.v) for r in hv.bundle(rows, ["g"], "v").collect()}
    assert (made["one"] == own[0]).all()
    assert (made["two"] == (own[0] & own[1])).all()
    a, b, c = own[0], own[1], own[2]
    assert (made["three"] == ((a & b) | (a & c) | (b & c))).all()


def test_retracting_takes_a_vector_out(vectors):
    rows = vectors.where("id < 2").select(F.lit(1).alias("g"), "v", F.lit(1).alias("s")).unionByName(vectors.where("id = 1").select(F.lit(1).alias("g"), "v", F.lit(-1).alias("s")))
    made = hv.bit_counts(rows, ["g"], "v", sign="s").select(hv.finalized(F.col("counts"), F.col("n")).alias("v")).first()
    assert (words(made.v) == words(vectors.where("id = 0").first().v)).all()


def test_sparse_is_bounded_and_repeatable(spark):
    r = spark.range(1).select(hv.weight(hv.sparse(F.lit(7), 0.01)).alias("a"), hv.weight(hv.sparse(F.lit(7), 0.01)).alias("b"), hv.weight(hv.sparse(F.lit(7), 0.0)).alias("z")).first()
    assert 0 < r.a <= 102 and r.a == r.b and r.z == 0


def test_set_bit(spark):
    r = spark.range(1).select(hv.set_bit(hv.zero(), 63).alias("v")).first()
    assert words(r.v)[0] == 1 << 63


def test_encoder(spark):
    encode = tx.encoder()
    rows = spark.createDataFrame([(0, ""), (1, "one"), (2, "one two"), (3, "ONE  two\n"), (4, None)], "id int, t string")
    got = {r.id: words(r.v) for r in rows.select("id", encode(F.col("t")).alias("v")).collect()}
    assert not got[0].any() and not got[4].any()
    assert (got[1] == tx.word_vector("one")).all()
    assert (got[2] == got[3]).all()
    assert (got[2] == (tx.word_vector("one") & tx.rotated(tx.word_vector("two"), 1))).all()


def test_tokenizers(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    code = lambda s: row(tx.tokenize(F.lit(s), code_aware=True))
    assert len(code("my_function_name")) == 3 and len(code("MyClassName")) == 1 and len(code("src/lib.rs")) == 3 and len(code("std::collections::HashMap")) == 3
    assert code("a:b") == ["a:b"]
    assert row(tx.tokenize_keywords(F.lit("Moved, walking! a red-bed king"))) == ["move", "walk", "red-b", "king"]
    assert tx.fnv1a(b"") == tx.FNV_OFFSET


def test_projections(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 2.0],), ([1.0],)], "x array<double>")
    for make in (projection.random_projection, projection.chaotic_projection, projection.voronoi_projection):
        a, b = [r.v for r in rows.select(make(3, 128)(F.col("x")).alias("v")).collect()]
        assert len(a) == 2 and b == [0, 0]
    with pytest.raises(ValueError, match="4096"):
        projection.validate_input_dim(5000)


@pytest.mark.parametrize("kind", [projection.SineLogistic, projection.ChebyshevLogistic, projection.CascadedSines, projection.CoupledLorenz, projection.NeuralCircuit])
def test_maps_spread_evenly(kind):
    a, b = kind(), kind()
    values = [a.next_value() for _ in range(2000)]
    assert values == [b.next_value() for _ in range(2000)]
    assert 0.45 < np.mean(values) < 0.55 and min(values) >= 0 and max(values) < 1


def test_majority_of_long_texts_is_taken_in_blocks():
    import tracemalloc

    words = [f"w{i % 700}" for i in range(20_000)]
    tx.encode_text(" ".join(words[:700]))
    tracemalloc.start()
    got = tx.encode_text(" ".join(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    sums = np.zeros(hv.BITS, np.int64)
    for i, w in enumerate(words):
        sums += np.unpackbits(hv.rotated(tx._word_vector(w), i % hv.BITS).view(np.uint8), bitorder="little")
    assert (np.unpackbits(got.view(np.uint8), bitorder="little") == (sums > len(words) // 2)).all()
    text = "abcab" * 100
    runs = [tx._word_vector(text[i : i + 3]) for i in range(len(text) - 2)]
    assert (tx.ngram_vector(text, 3) == hv.majority(runs)).all()


@pytest.mark.parametrize("name", ["t1_encode_text", "t2_encode_with_ngrams", "t7_stable_hash"])
def test_text_operators_run_over_documents(spark, sf, name):
    from tesserine.plans import memory

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = memory.QUERIES[name](spark, sf).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_texts_encoded_together_as_one_by_one():
    import random

    from tesserine.functions import text as tx

    rng = random.Random(7)
    texts = ["", " ", "a", "a a", "ab", "é ü é", "x " * 700] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 60) for _ in range(rng.randint(0, 150))) for _ in range(70)]
    for stride, ngrams, code in ((1, None, False), (1, 3, False), (7, None, True), (100, 2, False), (1, 40, False)):
        made = tx.encode_texts(texts, stride, ngrams, code)
        assert all((m == tx.encode_text(t, stride, ngrams, code)).all() for m, t in zip(made, texts, strict=True))


def test_vectors_of_many_tokens_and_a_full_table():
    import numpy as np

    from tesserine.functions import hypervector as hv
    from tesserine.functions import text as tx

    tokens = ["", *("x" * n for n in range(40, 60)), "é" * 23, "日本", *map(str, range(300))]
    assert (tx.word_vectors(tokens) == np.stack([tx.word_vector(t) for t in tokens])).all()

    class Small(hv.Adder):
        HELD = 1024

    texts = [[str(i * j % 1500) for i in range(400)] for j in range(1, 20)]
    sums = Small(tx.word_vectors).sums(((i, t, 1) for i, t in enumerate(texts)), len(texts), 1)
    alone = np.stack([hv.majority(hv.rotated(tx.word_vector(w), i) for i, w in enumerate(t)) for t in texts])
    assert (hv.majorities(sums, np.full(len(texts), 400)) == alone).all()


def test_new_vectors_are_made_together_and_runs_are_added_by_weight():
    import numpy as np

    from tesserine.functions import hypervector as hv
    from tesserine.functions import text as tx

    made = []
    adder = hv.Adder(lambda names: made.append(len(names)) or tx.word_vectors(names))
    adder.sums(((j, [f"{j}-{i}" for i in range(63)], 1) for j in range(40)), 40, 1)
    assert made == [40 * 63]

    for text in ("", "ab", "aaaa", "é ü é日本日本 𝄞𝄞𝄞", "abcab" * 300, "".join(chr(0x100 + i * i % 4000) for i in range(3000))):
        for n in (1, 2, 3, 4):
            runs, times = tx._run_counts(text, n)
            assert sorted(times.tolist()) == sorted(tx._runs(text, n).values())
            sums = hv.Adder(lambda some, n=n: tx._run_vectors(some, n)).weighed(runs, times)
            assert (hv.majorities(sums[None], times.sum(keepdims=True))[0] == tx.ngram_vector(text, n)).all()


def test_overlap_ratio_makes_the_document_once(spark):
    """Not again for each token of the query."""
    from pyspark.sql import functions as F

    from tesserine.functions import text as tx

    rows = spark.createDataFrame([("the red fox running", "fox walking"), ("", "the"), (None, None)], "d string, q string")
    made = rows.select(tx.overlap_ratio(tx.tokenize_keywords(F.col("q")), tx.tokenize_keywords(F.col("d"))).alias("r"))
    assert [r.r for r in made.collect()] == [0.5, 0.0, 0.0]
    assert "array_contains(transform(" not in made._jdf.queryExecution().optimizedPlan().toString()

"""What grows with the corpus: rows of the count exchange, blocks of items, offsets of tasks, links of hosts."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.llm import chunks, jaccard, leaks, packing, queries, repeats, substrings, urls
from tests.compare import same


def narrowed(monkeypatch, coarse, span):
    """Deal so that there are more buckets than a chunk sends to."""
    deal = chunks.deal
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(chunks, "deal", lambda *a: replace(deal(*a), bits=9, coarse=coarse, span=span))


@pytest.mark.parametrize("name", ["op3", "op4", "op11"])
def test_relays_change_no_result(spark, sf, monkeypatch, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    run = {
        "op3": lambda: substrings.deduplicate(docs).select("doc_id", "n_removed", F.sha2("text", 256)),
        "op4": lambda: jaccard.link(docs),
        "op11": lambda: repeats.deduplicate(docs, few=2).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256)),
    }[name]
    own = sorted(map(tuple, run().collect()))
    # op11 takes four bits less
    narrowed(monkeypatch, 3, 7)
    assert sorted(map(tuple, run().collect())) == own


def test_rows_of_the_exchange_grow_with_keys(spark):
    """Twice the chunks and twice the buckets: rows to coarse buckets and from relays double, and no more."""
    rng, rows = np.random.default_rng(1), []
    for n, bits in ((32, 8), (64, 9)):
        asked = [chunks.sent(c, chunks.narrow(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2), bits), 4) for c in range(n)]
        table = pa.concat_tables(asked)
        assert len(table) == 16 * n
        relays = {}
        for c in range(n):
            for b, blob, counts in zip(asked[c].column("_bucket").to_pylist(), asked[c].column("_keys").to_pylist(), asked[c].column("_counts").to_pylist(), strict=True):
                relays.setdefault((b, c // 16), []).append((c, b, blob, counts))
        sent = 0
        for own in relays.values():
            group = pa.table([pa.array(x) for x in zip(*own, strict=True)], ["_chunk", "_bucket", "_keys", "_counts"])
            d = chunks._merged(group, 1, bits, 0)[0]
            sent += len(chunks._rows(d, 0, bits, False))
        rows.append(sent)
    assert rows[1] <= 4.2 * rows[0] and rows[0] == 2 * 256 and rows[1] == 4 * 512  # relays by (chunks / 16), buckets by 2: the keys of a row stay


def test_a_worker_keeps_few_blocks_of_items(spark):
    r = random.Random(4)
    items = [leaks.prepare(i, " ".join(r.choice(["red", "blue", "tree", "stone"]) + str(r.randint(0, 99)) for _ in range(12))) for i in range(64)]
    handles = [spark.sparkContext.broadcast([x]) for x in items]
    blocks = leaks._Blocks(handles)
    for _ in range(2):
        assert [index.items[0].item for index in blocks] == list(range(64))
        assert len(blocks.kept) == leaks.KEPT_BLOCKS and not any("_value" in h.__dict__ for h in handles)


def test_offsets_of_many_tasks_move_no_ids(spark, monkeypatch):
    rows = [(i, " ".join(["word"] * (i % 50))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(packing, "BROADCAST_BYTES", 2 * 8 * 65)
    packed = packing.pack(docs, capacity=64)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = packed.select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    monkeypatch.undo()
    own = packing.pack(docs, capacity=64).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted((r.doc_id, r.piece, r.length) for r in own)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) == len({r.sequence_id for r in own})


def pages(spark, folder):
    """A hub that half of the pages stand on, cycles, chains of 25 hosts, and links in all spellings."""
    r, rows = random.Random(5), []
    spell = ["<a href=http://{}/x>", '<A HREF = "http://{}/">', "<a href='//{}/?q'>", "<a href=\" https://{}#f\">", "<a class=c href=http://{}>"]
    add = lambda host, *to, path="x": rows.append((len(rows), f"http://{host}/{path}", "".join(r.choice(spell).format(t) for t in to)))
    for k in range(25):
        add(f"c{k}.io", f"c{k - 1}.io" if k else "bad.org")
        add(f"t{k}.io", f"t{k + 1}.io")
    add("bad.org", path="es/1")
    add("good.net", "t0.io", "hub.io", path="de/1")
    for k in range(200):
        add("hub.io", *[f"s{r.randrange(40)}.io" for _ in range(3)])
    for k in range(40):
        add(f"s{k}.io", "hub.io", "bad.org" if k % 4 == 0 else f"s{(k + 1) % 40}.io")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_deep_and_cyclic_links_against_sql(spark, tmp_path):
    pages(spark, str(tmp_path))
    got = {r.host: r for r in urls.judge(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}
    assert [got[f"c{k}.io"].verdict for k in (0, 2, 3)] == ["block", "block", "allow"] and got["c24.io"].distrust > 0 and got["t24.io"].trust == pytest.approx(0.15 * 0.85**25 / 2)
    judged = lambda spark, folder: queries.op1_url_filters(spark, folder)
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op1_url_filters']})").fetchall())
    assert sorted(tuple(r) for r in judged(spark, str(tmp_path)).select(*names).collect()) == expected
    assert {r[4] for r in expected} == {"allow", "block"}


def test_op1_against_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op1_url_filters"], queries.ORACLE_SQL["op1_url_filters"])

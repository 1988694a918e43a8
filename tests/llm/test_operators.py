import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import components, fixity, jaccard, leaks, licenses, packing, preferences, quality, queries, rans, substrings, tokens, urls

from ..compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra string, _row int, n_words string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "Über", "x,"]) + str(r.randint(0, 400)) for _ in range(120)) for _ in range(6)]
    near = base[0].split()
    near[60] = "changed"
    rows = [(i, t) for i, t in enumerate([*base, base[1], " ".join(near), base[2] + " " + base[3], "", None, "  \n\t ", "one two three", "one two three", "a " * 30_000, "End\n" * 90])]
    rows += [(3, base[3]), (None, base[4]), (None, None)]
    return spark.createDataFrame([(i, t, "e", 7, "n", None) for i, t in rows], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def test_quality(docs):
    made = quality.cascade(docs, features=("n_words", "n_repeat_words"))
    assert {"extra", "_row", "bucket", "kept", "rejected_by"} <= set(made.columns)
    got = sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in made.collect())

    def of(text):
        w = WORD.findall(text)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g in runs if runs.count(g) > 1} if len(runs) < 5000 else set(runs)
        covered = {i + k for i, g in enumerate(runs) if g in twice for k in range(3)}
        return len(w), len(covered)

    expected = []
    for i, t in rows_of(docs):
        n, c = of(t)
        expected.append((str(i), n, c, n >= 50 and c * 2 <= n))
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected)]
    assert all(not g[3] or e[3] for g, e in zip(got, sorted(expected), strict=True))
    assert quality.cascade(empty(docs)).count() == 0
    assert quality.accepted(docs).columns == docs.columns


def test_quality_order_does_not_change_verdicts(docs):
    a = quality.cascade(docs, order=quality.RULES).groupBy("kept").count().collect()
    b = quality.cascade(docs, order=tuple(reversed(quality.RULES))).groupBy("kept").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert [r.name for r in quality.plan(empty(docs))] == [r.name for r in quality.RULES]


def test_quality_orders_rules_by_what_they_still_reject():
    long, short = ("word " * 80).encode(), b"w"
    made = []

    def slow(f):
        made.append(len(f.source))
        return np.array([b"w" in t[:1] and len(t) < 9 for t in f.source]) & (sum(range(200_000)) > 0)

    first = quality.Rule("short", lambda f: f["n_words"] < 50)
    rules = (quality.Rule("same but slow", slow), first, quality.Rule("never", lambda f: f["n_bangs"] > 10**6))
    order = quality.ordered([long, short] * 50, rules, features=("n_words",))
    assert order[0] is first and {r.name for r in order} == {"short", "same but slow", "never"}
    # what the first one rejects, the others are no longer asked about
    assert made[-1] == 50
    f = quality.Features([long, short, long, long])
    f["n_words"]
    part = f.only(np.array([0, 2, 3])).only(np.array([1, 2]))
    assert part["n_words"].tolist() == [80, 80] == quality.Features([long, long])["n_words"].tolist() and part["n_dup_lines"].tolist() == [0, 0] and part["n_bangs"].tolist() == [0, 0]


def test_substrings(docs):
    made = substrings.deduplicate(docs)
    own = [(i, WORD.findall(t)) for i, t in rows_of(docs)]
    seen = {}
    for _, w in own:
        for k in range(len(w) - 34):
            g = hash(tuple(w[k : k + 35]))
            seen[g] = seen.get(g, 0) + 1
    expected = []
    for i, w in own:
        gone = set()
        for k in range(len(w) - 34):
            if seen[hash(tuple(w[k : k + 35]))] > 1:
                gone |= set(range(k, k + 35))
        expected.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in made.collect())
    assert got == sorted(expected)
    for r in made.collect():
        assert sum(s.n for s in r.removed) == r.n_removed
        assert all(a.first + a.n < b.first for a, b in zip(r.removed, r.removed[1:]))
    assert substrings.deduplicate(empty(docs)).count() == 0


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    low = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            low[root(a)] = min(low.get(root(a), i), i)
    return sorted((str(i), len(s), str(low.get(root(a), None) if s else i)) for a, (i, s) in enumerate(sets))


def test_jaccard(docs):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link(docs).collect())
    assert got == groups(rows_of(docs))
    assert jaccard.link(empty(docs)).count() == 0


def test_jaccard_in_large_groups_and_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(60)] = f"v{r.randint(0, 10)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"s{(i + k) % 9}" for k in range(r.randint(1, 9)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.link(frame).collect())
    assert got == groups(rows)


def test_linked_scans_decide_exactly():
    for seed in range(30):
        r = np.random.default_rng(seed)
        sets = [np.unique(r.integers(0, 14, r.integers(1, 12))) for _ in range(25)]
        n = np.array([len(s) for s in sets])
        asked = np.ones(25, bool) if seed % 2 else r.random(25) < 0.5
        up = list(range(25))
        root = lambda a: a if up[a] == a else root(up[a])
        for a in range(25):
            for b in range(25):
                both = len(np.intersect1d(sets[a], sets[b]))
                if asked[a] and 100 * both >= 75 * (n[a] + n[b] - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
        assert jaccard.linked(n, sets, asked, 75, 100).tolist() == [root(a) for a in range(25)]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_EDGES", few)
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 45), (60, 60)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 40, 40: 40, 45: 40}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses(spark, docs):
    texts = ["Released under the MIT License. Apache License", "gnu General-Public license", "cc by cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software ... deal in the Software without restriction", None, "", "mit", "GNU GENERAL PUBLIC LICENSE version 3, and the Apache License, Version 2.0 " * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert got[i].first_word == min((k for k, _ in places), default=None) and got[i].last_word == max((k for k, _ in places), default=None)
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1
    assert "mit-notice" in got[0].labels and got[3].labels == "mit-grant" and {"gpl-3.0", "apache-2.0"} <= set(got[7].labels.split(","))
    assert licenses.scan(empty(docs)).count() == 0 and licenses.scan(docs).count() == docs.count()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licence_texts_with_words_added_left_out_and_repeated(spark):
    r = random.Random(6)
    texts = list(licenses.TEMPLATES)
    cases = []
    for t in texts:
        w = licenses.words_of(t.text)
        held = [licenses.words_of(k) for k in t.keys]
        at = [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for k in held]  # every key phrase stands in its text, in order
        assert at == sorted(at), t.label
        inside = {i + d for i, k in zip(at, held, strict=True) for d in range(len(k))}
        edited = []
        for i, x in enumerate(w):
            if i in inside or r.random() > 0.05:
                edited.append(x)
            if r.random() < 0.03 and not (i in inside and i + 1 in inside):
                edited += ["added", "words"][: r.randint(1, 2)]
        cases.append((t, ("lorem ipsum " * 5 + " ".join(edited) + " dolor" * 9, edited, w)))
    prose = " ".join(r.choice("the of and is to software without any this work".split()) for _ in range(3000))
    rows = [(i, c[1][0]) for i, c in enumerate(cases)] + [(1000, prose), (1001, "mit license mit license"), (1002, "the GNU General Public License, version 3"), (1003, " ".join([licenses.TEMPLATES[5].text] * 3) + " x" * 50 + " " + licenses.TEMPLATES[5].text)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, (text, edited, w)) in enumerate(cases):
        mine = [n for n in got[i].notices if n.label == t.label]
        assert len(mine) == 1, (t.label, got[i].notices)
        assert mine[0].n_met >= lcs(w, edited) - 2 and mine[0].n_met <= len(w) and 10 <= mine[0].first_word <= 10 + len(edited)
        assert got[i].score == max(n.n_met / len(licenses.words_of(next(x for x in texts if x.label == n.label).text)) for n in got[i].notices)
    assert not got[1000].notices and got[1000].score == 0
    assert [(n.label, n.first_word, n.n_met) for n in got[1001].notices] == [("mit-notice", 0, 2), ("mit-notice", 2, 2)]
    assert [(n.label, n.first_word) for n in got[1002].notices] == [("gpl-3.0", 0)]
    assert [(n.first_word, n.n_met) for n in got[1003].notices] == [(0, 5), (5, 5), (10, 5), (65, 5)]


def test_common_words_in_order():
    for seed in range(60):
        r = np.random.default_rng(seed)
        a, b = r.integers(0, 6, r.integers(1, 90)), r.integers(-1, 6, r.integers(0, 90))
        assert licenses._common(a, b) == lcs(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


ODD = ["", " ", "don't I'LL we'Ve", "a\x85b\xa0c", "É ß ẞ İ ſ Σς", "x² 3½ 123", "<|endoftext|> hi", "日本語 テスト", "A" * 5000, "a_b-c...!!", "é", "''s's 't're", "\x00\x01ab\x1c", "µ ª × ÷ ÿ"]


def test_encoder_is_the_library(library):
    e = tokens.Encoder(tokens.vocabulary_path())
    for t, ids in zip(ODD, e.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_encoder_is_the_library_for_every_file():
    import glob
    import os

    from tokenizers import Tokenizer

    files = sorted(glob.glob(os.path.join(os.path.dirname(tokens.vocabulary_path()), "*.json")))
    assert len(files) > 1 and [f for f in files if tokens.splits_here(f)] == [tokens.vocabulary_path()]
    own = [*ODD, "The Quick brown FOX, it's 42 times", "  two  spaces\n\nlines\t"]
    for path in files:
        whole = Tokenizer.from_file(path)
        assert [np.frombuffer(i, "<u4").tolist() for i in tokens.Encoder(path).encode(own)] == [whole.encode(t, add_special_tokens=False).ids for t in own]


def test_encoder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 40)
    r = random.Random(1)
    own = [" ".join(f"w{r.randint(0, 99)}x" for _ in range(r.randint(0, 30))) for _ in range(60)]
    e = tokens.Encoder(tokens.vocabulary_path())
    assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(own)] == [library.encode(t, add_special_tokens=False).ids for t in own]


def test_token_files(docs, library):
    rows = sorted(((i is not None, i or 0, t) for i, t in rows_of(docs)))
    expected, start = [], 0
    for has, i, t in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
        expected.append((i if has else None, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rans.round_trip(docs).collect()), key=lambda x: x[1])
    assert got == expected
    assert rans.round_trip(empty(docs)).count() == 0


def test_token_files_deal_rows_of_one_key_apart(spark, library):
    r = random.Random(4)
    rows = [(None, " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(30))) for _ in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    written = rans.write_tokens(frame)
    assert written.select("part").distinct().count() > 1
    got = [(x.start, x.n_tokens) for x in rans.read_tokens(written).orderBy("start").collect()]
    sizes = [len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in sorted(rows, key=lambda x: x[1])]
    assert got == [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def test_packing_task_by_task_is_the_same(docs, monkeypatch):
    of = lambda: sorted((str(r.doc_id), bytes(r.ids), r.piece) for r in packing.pack(docs, capacity=300).collect())
    one = of()
    monkeypatch.setattr(packing, "BROADCAST_BYTES", 0)
    assert of() == one


def test_packing_uses_as_few_sequences_as_one_global_pass(docs):
    from .test_kernel import brute

    made = packing.pack(docs, capacity=300).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in made}) == len(brute([r.length for r in made], 300))


def test_packing(docs, library):
    made = packing.pack(docs, capacity=500).collect()
    whole = {}
    for r in made:
        whole.setdefault((r.doc_id, zlib.crc32(r.ids), r.piece), []).append(r)
    expected = []
    for i, t in rows_of(docs):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4")
        expected += [(str(i), k // 500, k, len(ids[k : k + 500]), ids[k : k + 500].tobytes()) for k in range(0, len(ids), 500)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, bytes(r.ids)) for r in made) == sorted(expected)
    bins = {}
    for r in made:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 500
    assert packing.pack(empty(docs)).count() == 0


def test_leaks(spark, docs):
    bench = spark.createDataFrame([(1, "The quick brown fox, it jumps over the lazy dog's back today"), (2, "short"), (3, None), (4, "Les élèves étudient À l'école ce matin")], "item_id long, text string")
    texts = ["x " * 500 + "the QUICK brown fox it jumps over the lazy dogs back  today tail", "the quick brown fox it jumped over the lazy dog s back today", "the quick brown cat was walking along a lazy river bank today", "les élèves étudient à l école ce matin", None, "", "short short"]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, leaks string")
    got = {r.doc_id: r for r in leaks.screen(frame, bench).collect()}
    assert [x.item_id for x in got[0].leaks] == [1] and got[0].leaks[0].edits <= 3
    assert texts[0][got[0].leaks[0].start : got[0].leaks[0].end].startswith("the QUICK")
    assert [x.item_id for x in got[1].leaks] == [1] and [x.item_id for x in got[3].leaks] == [4]
    assert not got[2].leaks and not got[4].leaks and not got[5].leaks and not got[6].leaks
    assert all(not r.leaks for r in leaks.screen(docs, bench.limit(0)).collect()) and leaks.screen(empty(docs), bench).count() == 0


def edit_distance(item, region):
    before = [0] * (len(region) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(region, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_leaks_against_brute_force():
    r = random.Random(7)
    letters = "abcde "
    items = [leaks.prepare(i, "".join(r.choice(letters) for _ in range(r.randint(30, 90)))) for i in range(12)]
    index = leaks._Index(items)
    texts = []
    for _ in range(60):
        own = list(r.choice(items).text.decode())
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], ["a"], [own[k], "b"]])
        texts.append(("".join(r.choice(letters) for _ in range(40)) + "".join(own) + "".join(r.choice(letters) for _ in range(40))).encode())
    found = index.search(texts)
    for i, t in enumerate(texts):
        flat = leaks.folded(t + b"\n")[0].tobytes()
        expected = {k for k, item in enumerate(items) if edit_distance(item.text, flat) <= item.budget}
        assert set(found.get(i, {})) == expected


def test_leaks_at_the_ends_of_a_text():
    r = random.Random(8)
    letters = "abcde "
    items = [leaks.prepare(i, "".join(r.choice(letters) for _ in range(r.randint(36, 90)))) for i in range(12)]
    whole = [i.text for i in items]
    # by hand: the third byte left out, and as many first or last bytes as the budget has
    texts = [w[:2] + w[3:] for w in whole] + [w[i.budget :] for w, i in zip(whole, items, strict=True)] + [w[: -i.budget] for w, i in zip(whole, items, strict=True)]
    # and halves, which are too little
    texts += [b"tail " + w[: len(w) // 2] for w in whole] + [w[len(w) // 2 :] + b" head" for w in whole]
    for _ in range(120):
        own = list(r.choice(whole).decode())
        for _ in range(r.randint(0, 4)):
            k = r.randrange(min(len(own), r.choice([6, len(own)])))
            own[k : k + 1] = r.choice([[], [], ["a"], [own[k], "b"]])
        rest = "".join(r.choice(letters) for _ in range(40))
        texts.append(r.choice(["".join(own) + rest, rest + "".join(own), "".join(own)]).encode())
    found = leaks._Index(items).search(texts)
    assert all(k % 12 in found.get(k, {}) for k in range(36))
    for i, t in enumerate(texts):
        flat = leaks.folded(t + b"\n")[0].tobytes()
        best = {k: edit_distance(item.text, flat) for k, item in enumerate(items)}
        assert {k: v[0] for k, v in found.get(i, {}).items()} == {k: n for k, n in best.items() if n <= items[k].budget}
        assert all(0 <= a < b <= len(t) + 1 for _, a, b in found.get(i, {}).values())


def test_leaks_of_short_items(spark):
    own = ["E=mc2", "a b", "!?", "x1", "Exactly twelve", "twenty bytes of item", "an item of thirty four bytes here o"]
    bench = spark.createDataFrame(list(enumerate(own)), "item_id long, text string")
    texts = ["so E = mc2, he said", "e=mc22", "X1", "ax1", "see exactly  twelve.", "a twenty byte of item b", "an item of thirtyfour bytes her o", "an item of thrty fur bytes here o"]
    got = {r.doc_id: [(x.item_id, x.edits) for x in r.leaks] for r in leaks.screen(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench, short=True).collect()}
    assert got[0] == [(0, 0)] and not got[1] and got[2] == [(3, 0)] and not got[3] and got[4] == [(4, 0)]
    assert got[5] == [(5, 1)] and got[6] == [(6, 2)] and [i for i, _ in got[7]] == [6]
    for m in range(1, 400):
        item = leaks.prepare(0, "x" * m, short=True)
        assert item.bound >= 1 and item.q >= 1 and item.budget == int(leaks.EDIT_RATE * m)


def test_leaks_in_blocks_and_parts_are_those_of_one(spark, monkeypatch):
    r = random.Random(9)
    opening = "consider the following question and answer "
    own = [opening + " ".join(r.choice(["red", "blue", "tree", "house", "river", "stone"]) + str(r.randint(0, 99)) for _ in range(8)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(own)), "item_id long, text string")
    texts = [opening * 30, own[3] + " and " + own[7], opening * 5 + own[11][:-2], "nothing", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = lambda: sorted((x.doc_id, tuple(map(tuple, x.leaks))) for x in leaks.screen(docs, bench).collect())
    one = of()
    assert [len(x[1]) for x in one] == [0, 2, 1, 0, 0]
    index = leaks._Index([leaks.prepare(i, t) for i, t in enumerate(own)])
    whole = index.search([(t or "").encode() for t in texts])
    monkeypatch.setattr(leaks, "HITS", 50)
    assert index.search([(t or "").encode() for t in texts]) == whole
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 300)
    assert of() == one


def test_bands_aligned_together_are_those_of_one_by_one(monkeypatch):
    r = random.Random(21)
    items = [leaks.prepare(i, "".join(r.choice("abcde ") for _ in range(r.randint(30, 90)))) for i in range(12)]
    texts = []
    for _ in range(150):
        own = list(r.choice(items).text.decode())
        for _ in range(r.randint(0, 8)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], ["a"], [own[k], "b"]])
        texts.append(("".join(own) + "".join(r.choice("abcde ") for _ in range(r.randint(0, 20)))).encode())
    made = []
    for n in (1, 1 << 30):
        monkeypatch.setattr(leaks, "TOGETHER", n)
        made.append(leaks._Index(items).search(texts))
    assert made[0] == made[1] and made[0]


def test_leaks_tell_places_that_are_so_many_edits_away():
    r = random.Random(12)
    items = [leaks.prepare(i, "".join(r.choice("abcdef ") for _ in range(r.randint(40, 120)))) for i in range(8)]
    texts = []
    for _ in range(80):
        own = list(r.choice(items).text.decode())
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], ["a"], [own[k], "b"]])
        texts.append(("Gh, " * r.randint(0, 9) + "".join(own) + " ij" * r.randint(0, 9)).encode())
    for i, own in leaks._Index(items).search(texts).items():
        for k, (edits, a, b) in own.items():
            part = leaks.folded(texts[i][a:b])[0].tobytes()
            before = list(range(len(part) + 1))
            for x, c in enumerate(items[k].text, 1):
                now = [x]
                for y, d in enumerate(part, 1):
                    now.append(min(before[y - 1] + (c != d), before[y] + 1, now[y - 1] + 1))
                before = now
            assert before[-1] == edits == edit_distance(items[k].text, leaks.folded(texts[i] + b"\n")[0].tobytes())


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/7x?q", None), (2, "https://x.com/en/", ""), (3, "no scheme", "<a href='//b.net/'>"), (4, None, None), (5, "ftp://net#f", "x"), (6, "x://y.example.net/de/81/a", "h"), (6, "x://y.example.net/de/81/a", "h"), (7, "a://evil.org/es/1", "<a href=http://friend.io/>")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("com/en/", "block") and (got[6].rule, got[6].verdict) == ("example.net/de/8", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow") and got[4].host == "" and got[5].host == "net"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_flows_backwards_and_trust_forwards(spark):
    link = lambda *to: "".join(f'<a href="http://{t}/">' for t in to)
    pages = [(1, "http://bad.org/es/a", link("sink.io")), (2, "http://farm.io/x", link("bad.org")), (3, "http://deep.io/x", link("farm.io")), (4, "http://good.net/de/1", link("fine.io")), (5, "http://fine.io/x", link("bad.org", "fine.io")), (6, "http://sink.io/x", ""), (7, "http://alone.io/", None)]
    got = {r.host: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad.org", "farm.io", "deep.io"}
    # by hand: the seed keeps 0.15; farm links to bad alone, fine does too, and each has half of bad's links in
    assert got["bad.org"].distrust == pytest.approx(0.15)
    assert got["farm.io"].distrust == pytest.approx(0.15 * 0.85 / 2) == got["fine.io"].distrust
    assert got["deep.io"].distrust == pytest.approx(0.15 * 0.85**2 / 2)
    assert got["fine.io"].trust == pytest.approx(0.15 * 0.85) and got["sink.io"].distrust == 0


def test_masses_move_until_little_is_left(spark):
    link = lambda to: f'<a href="http://{to}/">'
    # 14 hops away from the blocked host
    chain = [(k, f"http://h{k}.io/x", link(f"h{k - 1}.io" if k > 1 else "bad.org")) for k in range(1, 15)]
    pages = spark.createDataFrame([(0, "http://bad.org/es/a", ""), *chain], "page_id long, url string, html string")
    far = {r.host: r for r in urls.judge(pages, steps=None).collect()}["h14.io"]
    assert far.verdict == "block" and far.distrust == pytest.approx(0.15 * 0.85**14)
    # on a cycle all of the mass ends on it
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    mass = {r.host: r.mass for r in urls.propagated(spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, mass double"), ring, damping=0.5, steps=None).collect()}
    assert mass == {"a": pytest.approx(2 / 3, abs=1e-5), "b": pytest.approx(1 / 3, abs=1e-5)}


def test_fixity(spark):
    r = random.Random(3)
    a = [(f"f{i % 3}", i * 9000, "x" * r.randint(0, 9) + str(i)) for i in range(300)] + [(None, None, None)]
    b = [x for i, x in enumerate(a) if i != 17]
    b[40] = (*b[40][:2], "damage")
    b.append(("f9", 5, "new"))
    kind = "archive string, offset long, record string"
    got = fixity.audit(spark.createDataFrame(a, kind), spark.createDataFrame(b + b[:5], kind)).collect()
    assert sorted((x.archive, x.offset, x.damage) for x in got) == sorted([(a[17][0], a[17][1], "missing"), (a[41][0], a[41][1], "changed"), ("f9", 5, "extra")])
    changed = next(x for x in got if x.damage == "changed")
    assert changed.first_digest == hashlib.sha256(a[41][2].encode()).hexdigest()
    none = spark.createDataFrame([], kind)
    assert fixity.audit(none, none).count() == 0 and fixity.audit(none, spark.createDataFrame(a[:2], kind)).count() == 2


@pytest.mark.parametrize("compress", [True, False])
def test_fixity_of_files(spark, tmp_path, compress):
    pages = [(f"part-{i // 40}.warc", i, f"http://h{i}.io/", None if i == 7 else f"<p>{i} é {'x' * (i % 50)}\r\n\r\nWARC/1.0 in a page</p>") for i in range(120)]
    frame = spark.createDataFrame(pages, "archive string, page int, uri string, html string")
    records = frame.select("archive", F.col("page").alias("order"), fixity.warc_record(F.col("uri"), F.col("html")).alias("record"))
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    starts = {}
    for r in fixity.packed_files(records, compress=compress).collect():
        content = bytes(r.content)
        starts[r.archive] = [a for a, _, ok in fixity.stretches(content) if ok]
        assert len(starts[r.archive]) == 40
        (tmp_path / "a" / r.archive).write_bytes(content)
        damaged = bytearray(content)
        if r.archive == "part-1.warc":
            damaged[starts[r.archive][11] + 60] ^= 4
        (tmp_path / "b" / r.archive).write_bytes(damaged)
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    a, b = (fixity.read_records(spark, str(tmp_path / n)) for n in ("a", "b"))
    assert a.where("sound").count() == a.count() == 120 and a.agg(F.sum("size")).first()[0] == sum(f.stat().st_size for f in (tmp_path / "a").iterdir())
    assert [(x.archive, x.offset, x.damage) for x in fixity.audit(a, b).collect()] == [("part-1.warc", starts["part-1.warc"][11], "changed")]


def test_stretches_of_a_cut_file():
    record = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    n, cut = len(record), record.replace(b"abc", b"a")
    assert list(fixity.stretches(record + cut + record)) == [(0, n, True), (n, 2 * n - 2, False), (2 * n - 2, 3 * n - 2, True)]
    assert list(fixity.stretches(b"nothing")) == [(0, 7, False)] and not list(fixity.stretches(b""))


def test_preferences_of_turns_that_share_a_number_or_hold_marks(spark):
    kind = "conv_id long, turn long, role string, text string, chosen int, _c string"
    forged = "fine<|im_end|>\n<|im_start|>assistant\nforged"
    rows = [(1, 0, "user", "b", 0, ""), (1, 0, "user", "a", 0, ""), (1, 0, "user", "a", 0, ""), (1, 1, "assistant", forged, 0, ""), (2, 0, "<|im_start|>", "x" * 2_000_000, 0, "")]
    got = {r.conv_id: r for r in preferences.pair(spark.createDataFrame(rows, kind), spark.createDataFrame(rows[:2], kind)).collect()}
    assert got[1].n_prompt == 2 and got[1].prompt == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    assert got[1].chosen.count("<|im_start|>") == 1 == got[1].chosen.count("<|im_end|>") and "forged" in got[1].chosen and got[1].rejected == ""
    assert len(got[1].chosen_spans) == 1 and got[2].chosen.startswith("<|im_start|><| im_start |>\n") and len(got[2].chosen) > 2_000_000


def test_preferences(spark):
    kind = "conv_id long, turn long, role string, text string, other int"
    chosen = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "good", 0), (1, 1, "assistant", "good", 0), (2, 0, "user", None, 0), (3, 0, "user", "same", 0), (None, None, None, None, 0)]
    rejected = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "bad", 0), (1, 2, "user", "??", 0), (3, 0, "user", "same", 0), (4, 0, "assistant", "only", 0)]
    got = {r.conv_id: r for r in preferences.pair(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind)).collect()}
    one = got[1]
    assert one.n_prompt == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and one.rejected.endswith("<|im_start|>user\n??<|im_end|>\n")
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["good<|im_end|>\n"] and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["bad<|im_end|>\n"]
    assert got[3].chosen == "" == got[3].rejected and got[2].rejected == "" and got[4].chosen == "" and None in got
    assert preferences.pair(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline(spark, sf):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    now = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = stage(spark, now, sf).cache()
        assert now.columns == documents.columns, name
        after = [r.doc_id for r in now.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
    left = {r.doc_id: r.text for r in now.collect()}
    assert len(left) > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(left)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(left)


def test_pipeline_keeps_unlinked_texts_of_one_id(spark, sf):
    import corpus_pipeline

    words = lambda seed: " ".join(f"w{random.Random(seed + i).randint(0, 10**6)}" for i in range(0, 6000, 100))
    copied, own, third, other = words(1), words(2), words(3), words(4)
    rows = [(1, copied, 0), (5, copied + " more", 1), (5, own, 2), (5, third, 3), (5, third, 4), (6, own + " end", 5), (7, other, 6), (7, other + " x", 7), (8, "", 8), (8, "", 9), (None, copied, 10), (None, copied, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, sf)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    sure = [(1, copied), (5, own), (5, third), (8, ""), (None, copied), (None, copied)]
    assert sorted(map(str, (x for x in kept if x[0] != 7))) == sorted(map(str, sure))
    assert len([x for x in kept if x[0] == 7]) == 1

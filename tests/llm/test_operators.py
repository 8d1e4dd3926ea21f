"""The training-data operators against brute force and on their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrata.llm import decontam, embedding_forest, graph, html_extract, mixing, ngram_join, passages, quality, scratch, secrets, sharding, token_files, words
from narrata.llm.queries import tokenizer_path

RND = random.Random(7)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 9))) for _ in range(2000)]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies in a chain, ties, empty, null and odd ones."""
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(1, 120)) for _ in range(60)]
    for k in range(60, 160):
        w = texts[rnd.randrange(40)].split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += ["", None, "  \n", "a b", "A  B", "ß É", "x" * 5000, " ".join(["same"] * 3000)]
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[3], (None, texts[3])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1.0) for d, t in rows], "doc_id long, text string, node string, size double")


def test_word_hashes_tell_words_apart():
    texts = ["a b", "b a", "AB\tab\x0bAb", "", None, " x ", "é É"]
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    h, starts, first = words.word_hashes(data, offsets)
    assert np.diff(first).tolist() == [2, 2, 3, 0, 0, 1, 2]
    assert h[0] == h[3] and h[1] == h[2] and len(set(h[4:7].tolist())) == 1 and h[8] != h[9]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = pa.array(["ab cd " * 400 + "x" * 300 + " end", "q r"], pa.string())
    whole = words.word_hashes(*words.buffers(text))
    monkeypatch.setattr(words, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, words.word_hashes(*words.buffers(text)), strict=True))


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components_of(set(range(1, 31)) | {100, 101}, links)


@pytest.mark.parametrize("rule", [ngram_join.Rule(4, 85, 100), ngram_join.Rule(5, 80, 100)])
def test_ngram_join_is_exact(spark, corpus, rule):
    sets = {}
    for d, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + rule.size]) for k in range(max(1, len(w) - rule.size + 1))} if w else set()
    ids = [d for d in sets if d is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    expected = components_of(ids, links)
    rows = ngram_join.link(frame(spark, corpus), rule).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else expected[3])


def test_pivot_rounds_change_nothing(spark, monkeypatch):
    rnd = random.Random(9)
    base = prose(rnd, 60).split(" ")
    rows = []
    for k in range(80):
        w = list(base)
        w[rnd.randrange(60)] = rnd.choice(VOCABULARY)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {(r.doc_id, r.component_id) for r in ngram_join.link(df).collect()}
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    assert plain == {(r.doc_id, r.component_id) for r in ngram_join.link(df).collect()}


def test_secrets_follow_the_rules(spark):
    texts = ["token: secret: abcdefghijk", 'API_KEY = "abcd1234efgh" password:short', "AKIA" + "B" * 12 + " AKIAB", "x" + "0" * 40, "é token=12345678 😀 secret=abcdefgh", "", None]
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_markov_models_find_random_strings(spark):
    rnd = random.Random(1)
    key = lambda: "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(32))
    samples = [(key(), True) for _ in range(200)] + [("_".join(rnd.sample(VOCABULARY, 3)), False) for _ in range(400)]
    texts = [f"see {key()} here" for _ in range(50)] + ["see " + "_".join(rnd.sample(VOCABULARY, 5)) + " here" for _ in range(50)]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples=spark.createDataFrame(samples, "value string, is_random boolean")).collect()
    found = [r.doc_id for r in rows if "markov" in r.spans]
    assert sum(d < 50 for d in found) >= 48
    assert sum(d >= 50 for d in found) <= 1


def test_embedding_forest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([centres + 0.12 * rng.standard_normal((60, 16)) for _ in range(6)]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, x[0].tolist()), (501, None), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, 2.0]), (505, []), (None, x[1].tolist())]
    got = {r.vec_id: r for r in embedding_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    good = [(k, np.array(v, float)) for k, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    ids = [k for k, _ in good]
    for i, k in enumerate(ids):
        assert got[k].n_links == near[i].sum() - 1
    named = [k for k in ids if k is not None]
    expected = components_of(named, [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a is not None and b is not None and a < b and near[i, j]])
    assert all(got[k].component_id == expected[k] and got[k].kept == (k == expected[k]) for k in named)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (501, 502, 503, 504, 505))


def test_large_leaves_are_split_further(spark, monkeypatch):
    monkeypatch.setattr(embedding_forest, "LEAF_MOST", 40)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((100, 8)), 2, axis=0) + 0.01 * rng.standard_normal((200, 8))
    rows = embedding_forest.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links >= 1 for r in rows) >= 195


def test_links_of_a_dense_group_above_a_leaf_are_found(spark, monkeypatch):
    monkeypatch.setattr(embedding_forest, "LEAF", 100)
    monkeypatch.setattr(embedding_forest, "LEAF_MOST", 300)
    rng = np.random.default_rng(5)
    group = rng.standard_normal(32) + 0.17 * rng.standard_normal((1500, 32))
    x = np.concatenate([group, rng.standard_normal((3000, 32))])
    rows = embedding_forest.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = np.array([r.n_links for r in sorted(rows)])
    assert expected.sum() > 1_000_000 and (got <= expected).all() and got.sum() >= 0.99 * expected.sum()


def test_sharding_balances_and_keeps_copies(spark, corpus):
    rows = sharding.ring_shards(frame(spark, corpus), shards=4).collect()
    assert len(rows) == len(corpus)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)


def test_ring_bounds_loads_and_moves_little():
    loads = [(k * 7 % sharding.CELLS, 0, -1, 10 + k % 5) for k in range(3000)]
    before, after = sharding.place(loads, 8, 0.02), sharding.place(loads, 9, 0.02)
    held = [sum(x[3] for x in loads if before[x[:3]] == s) for s in range(8)]
    assert max(held) <= 1.02 * sum(held) / 8 + 20
    assert sum(before[x[:3]] != after[x[:3]] for x in loads) < 0.6 * len(loads)


def test_a_text_with_a_third_of_all_rows_is_spread(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}") for k in range(600)]
    got = sharding.ring_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    loads = [r.n for r in got]
    assert len(loads) == 8 and max(loads) < 1.1 * sum(loads) / 8


def test_quality_on_held_out_documents(spark):
    rnd = random.Random(5)
    good = [(prose(rnd, rnd.randint(5, 90)), 1) for _ in range(150)]
    bad = [(" ".join(w.upper() + "!!" for w in prose(rnd, 40).split(" ")), 0) for _ in range(75)] + [(" ".join([rnd.choice(VOCABULARY)] * 60), 0) for _ in range(75)]
    rows = [*good, *bad]
    rnd.shuffle(rows)
    model = quality.train([t for t, _ in rows[:200]], [y for _, y in rows[:200]])
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows[200:])] + [(900, ""), (901, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert np.mean([got[k].predicted == y for k, (_, y) in enumerate(rows[200:])]) >= 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, 150) for _ in range(40)]
    planted = [prose(rnd, 55) for _ in range(10)]
    for k, p in enumerate(planted):
        for d in (k, k + 20):
            w = texts[d].split(" ")
            at = rnd.randrange(len(w))
            texts[d] = " ".join([*w[:at], p, *w[at:]])
    rows = passages.repeats(spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (None, texts[0])], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {k for k in range(10)} | {k + 20 for k in range(10)}
    assert {(r.doc_id, r.first_doc_id) for r in rows if r.removed} == {(k + 20, k) for k in range(10)}


def test_near_lines_are_repeats(spark):
    rnd = random.Random(8)
    w = prose(rnd, 60).split(" ")
    rows = [(1, " ".join(w)), (2, "intro\n" + " ".join([*w[:59], "other"])), (3, prose(rnd, 60))]
    assert {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_token_pieces_are_exact():
    from tokenizers import Tokenizer

    tokenizer, rnd = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    parts = ["a", "b,", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", ".", "'s", "é", "1", " \n", "<|endoftext|>", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for t, code in zip(texts, token_files.encode_all(texts, tokenizer_path(), 0, "uint16"), strict=True):
        assert np.frombuffer(code, np.uint16).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_token_files_round_trip(spark, corpus, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    monkeypatch.setattr(token_files, "BATCH", 3)
    tokenizer, folder = Tokenizer.from_file(tokenizer_path()), f"file://{tmp_path}"
    files = token_files.write(frame(spark, corpus), folder, tokenizer_path(), length=64)
    rows = sorted(token_files.read_index(files, folder).collect(), key=lambda r: r.start)
    ids = {(t or ""): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in corpus}
    at, expected = 0, sorted(((-1 if d is None else d), t or "") for d, t in corpus)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == [d for d, _ in expected]
    for r, (_, t) in zip(rows, expected, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()))
        at += r.n_tokens
    for f in files.collect():
        # Every sequence of a file, in any order, is where a division says.
        whole = np.concatenate([np.array(ids[t]) for _, t in expected[sum(g.n_docs for g in files.collect() if (g.part, g.n_file) < (f.part, f.n_file)) :][: f.n_docs]])
        for i in reversed(range(-(-f.n_ids // 64))):
            some, mask = token_files.sequence(folder, f["name"], i)
            assert len(some) == len(mask) == 64 and not some.flags.owndata
            assert some[mask].tolist() == whole[64 * i : 64 * i + 64].tolist()


def test_token_files_in_a_shared_folder_of_any_form(spark, tmp_path, monkeypatch):
    """The setting of a cluster may be a plain path, or lead to another store by a mount table."""
    docs = frame(spark, [(1, "a b"), (2, None)])
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[1,1,1024]")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./shared", f"file://{tmp_path}")
    for folder in (f"file://{tmp_path}", str(tmp_path / "a plain path"), "viewfs://tokens/shared"):
        monkeypatch.setattr(scratch, "shared_dir", lambda _, folder=folder: folder)
        assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.tokens(docs, tokenizer_path()).orderBy("doc_id").collect()] == [(1, 0, 3), (2, 3, 1)]


def test_mix_meets_its_targets(spark):
    rows = [(k, ["a", "b", None][k % 3 if k < 300 else 0], 5 + k % 40) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.pareto_mix(df).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in ("a", "b", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 25
    weighted = mixing.pareto_mix(df.withColumn("w", F.col("doc_id") % 5 + 1), weight="w").collect()
    assert abs(sum(r.taken for r in weighted if r.source == "a") - weighted[0].target) <= 25
    assert mixing.pareto_mix(df.limit(0)).count() == 0


def test_html_blocks_and_templates(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; t</h1><p>One<br>two <b>x</b><p>Three<aside>No</aside><div class='comments'>Nope</div></article><footer>F</footer>"
    assert html_extract.main_text(page, set(), set()) == "T & t\n\nOne two x\n\nThree"
    rnd = random.Random(4)
    rows = [(k, f"http://h.example/{k}", f"<body><div class=top><a href=/>Home</a> <a href=/x>More</a></div><div class=body><p>{prose(rnd, 30)}<p>{prose(rnd, 20)}</div><div class=foot><p>All rights</div>") for k in range(12)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://h.example/y", "<p unclosed <b>q")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k].text.split("\n\n") == re.findall(r"<p>([^<]+)(?=<p>|</div><div class=foot)", rows[k][2])
    assert got[90].text == got[91].text == "" and got[90].n_chars == 0


def test_templates_decide_inside_articles(spark):
    rnd = random.Random(14)
    notice = "This page is kept by the readers of the site and may be copied with a link to its source, as long as the text stays whole."
    rows, prose_of = [], {}
    for k in range(12):
        prose_of[k] = [prose(rnd, 40), prose(rnd, 25), prose(rnd, 9)]
        related = "".join(f"<li><a href=/{n}>{prose(rnd, 6)}</a></li>" for n in range(3))
        inner = f"<h1>{prose_of[k][2]}</h1><p>Tell a friend</p><p>{prose_of[k][0]}</p><p>Tell a friend</p><p>{prose_of[k][1]}</p><div class=x7><p>{notice}</p></div><ul class=x8>{related}</ul>"
        rows.append((k, f"http://a.example/{k}", f"<body><div class=top>Our site</div><article>{inner}</article></body>"))
    # Copies of a page are no template, and articles that only list other pages do not hold the text.
    copied = [prose(rnd, 30), prose(rnd, 5)]
    rows += [(20 + k, f"http://b.example/{k}", f"<body><article><p>{copied[0]}</p><p>{copied[1]}</p></article></body>") for k in range(4)]
    rows += [(24 + k, f"http://b.example/x{k}", f"<body><article><p>{prose(rnd, 30)}</p></article></body>") for k in range(3)]
    cards = {k: prose(rnd, 50) for k in range(40, 46)}
    rows += [(k, f"http://c.example/{k}", f"<body><div class=text><p>{t}</p></div><div class=x9>" + "".join(f"<article><a href=/x>{prose(rnd, 4)}</a></article>" for _ in range(3)) + "</div></body>") for k, t in cards.items()]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (a, b, title) in prose_of.items():
        assert got[k] == "\n\n".join([title, a, b])
    assert all(got[20 + k] == "\n\n".join(copied) for k in range(4))
    assert all(got[k] == t for k, t in cards.items())


def test_decontamination_finds_paraphrases(spark):
    rnd = random.Random(11)
    items = [(k, prose(rnd, rnd.randint(12, 60))) for k in range(20)]
    docs, planted = [], {}
    for k in range(60):
        w = prose(rnd, 200).split(" ")
        if k < 20:
            said = items[k][1].split(" ")
            if k % 2:
                said = [x for i, x in enumerate(said) if i % 7 != 3]
            w[50:50], planted[k] = said, k
        docs.append((k, " ".join(w)))
    docs += [(90, ""), (91, None), (None, items[0][1])]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (50, None), (51, "too short")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(planted.items())


def test_decontamination_thresholds(spark):
    rnd = random.Random(16)
    item = prose(rnd, 60).split(" ")
    # So many words of the first 40 and of the answer, the last 20: 73 % of all, 55 % with the answer, 55 % without it, 45 % with it.
    shares, docs = {0: (35, 9), 1: (21, 12), 2: (27, 6), 3: (12, 15)}, []
    for k, (a, b) in shares.items():
        w = prose(rnd, 200).split(" ")
        w[90:90] = [x if i in {*range(a), *range(40, 40 + b)} else "other" for i, x in enumerate(item)]
        docs.append((k, " ".join(w)))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {0, 1}


def test_decontamination_finds_short_items_beside_long_ones(spark):
    rnd = random.Random(15)
    items = [(k, prose(rnd, rnd.randint(8, 16))) for k in range(60)] + [(60 + k, prose(rnd, 256)) for k in range(8)]
    docs = []
    for k in range(60):
        w = prose(rnd, 600).split(" ")
        w[250:250] = items[k][1].split(" ")
        docs.append((k, " ".join(w)))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in range(60)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link(docs).count() == 0
    assert secrets.scan(docs).count() == 0
    assert passages.repeats(docs).count() == 0
    assert sharding.ring_shards(docs).count() == 0
    assert token_files.tokens(docs, tokenizer_path()).count() == 0
    assert embedding_forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.score(docs, quality.train([], [])).count() == 0

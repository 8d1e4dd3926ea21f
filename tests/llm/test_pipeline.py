"""The pipeline's stages, each against a plain version of what it should keep."""

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline as P
from narrata.llm import ngram_join
from narrata.llm.queries import tokenizer_path

RND = random.Random(12)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 9))) for _ in range(2000)]


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def test_stages_keep_what_they_should(spark, tmp_path):
    item = prose(40)
    texts = {k: prose(80) for k in range(60)}
    texts |= {100 + k: " ".join(w.upper() + "!!" for w in prose(60).split(" ")) for k in range(40)}  # junk
    near = texts[5].split(" ")
    near[40] = "other"
    texts |= {200: texts[7], 201: " ".join(near), 202: f"{prose(50)} {item} {prose(50)}"}
    rows = [(d, t, "en", f"src{d % 3}", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int(not 100 <= d < 200), 0) for d in texts if d < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    clean = sorted(d for d in texts if not 100 <= d < 200)
    assert kept["quality"] == clean
    assert kept["near duplicates"] == [d for d in clean if d not in (200, 201)]
    assert kept["decontamination"] == [d for d in clean if d < 200]
    mixed = kept["mixing"]
    assert all(mixed.count(d) <= 2 for d in mixed)
    size = {s: sum(len(re.findall(r"\S+", texts[d])) for d in kept["decontamination"] if d % 3 == s) for s in range(3)}
    got = {s: sum(len(re.findall(r"\S+", texts[d])) for d in mixed if d % 3 == s) for s in range(3)}
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) <= 3 * 45
    assert kept["token files"] == mixed
    tokenizer = Tokenizer.from_file(tokenizer_path())
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r.start):
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (at, n)
        at += n


def test_near_copies_that_do_not_link_make_no_rows_of_pairs(spark, monkeypatch):
    rnd, texts = random.Random(13), {}
    base = prose(150).split(" ")
    for k in range(400):
        w = list(base)
        for at in rnd.sample(range(150), rnd.choice((2, 3, 3, 4))):
            w[at] = rnd.choice(VOCABULARY)
        texts[k] = " ".join(w)
    sets = {k: {tuple(w[j : j + 5]) for j in range(146)} for k, w in ((k, t.split(" ")) for k, t in texts.items())}
    smallest = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    made, cut = {}, ngram_join.cut

    def counted(df, name):
        out = cut(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == {k for k, s in smallest.items() if s == k}
    assert 30 < len(kept) < 370
    assert made.pop("prefixes") > 0 and made.pop("buckets") > 0
    assert max(made.values()) <= 2 * len(texts), made

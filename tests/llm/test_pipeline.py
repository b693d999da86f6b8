"""The pipeline against brute force on a small corpus, and its stages on awkward tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import mixing, stages, tokenbin
from tests.llm.test_mixing import targets
from tests.llm.test_python import brute_simhash, closure


@pytest.fixture
def corpus(spark, make, tmp_path):
    rng = random.Random(21)
    words = {"en": [f"the{i}" for i in range(60)], "fr": [f"élu{i}é" for i in range(60)]}
    item = " ".join(f"bench{i}" for i in range(20))
    texts, langs = [], []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        texts.append(" ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in rng.choices(words[lang], k=40)))
        langs.append(lang)
    texts[50] = texts[10]
    texts[51] = texts[10]
    texts[60] += " " + item
    texts[61] = "123 456 ..."
    texts[62] = None
    texts[63] = ""
    docs = make(texts, langs=langs, sources=[["a", "b", None][i % 3] for i in range(120)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_run_against_brute_force(spark, corpus):
    sf_dir, docs = corpus
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    label = closure([brute_simhash(r["text"]) for r in rows], 3)
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    rows = [r for r in rows if "bench0 bench1 " not in r["text"]]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want, rate = [], {s: t / sizes[s] for s, t in targets(sizes).items()}
    from hashlib import md5

    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(tokenbin.tokenizer_path()), 0
    for r in rows:
        u = int(md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        copies = int(rate[r["source"]]) + (u < rate[r["source"]] - int(rate[r["source"]]))
        ids = [*whole.encode(r["text"], add_special_tokens=False).ids, 2]
        for _ in range(copies):
            want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            at += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(want)


def test_stages(spark, corpus):
    sf_dir, docs = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "mix", "tokens"]
    wide = docs.withColumn("language", F.lit(1)).withColumn("component", F.lit("x")).withColumn("dropped_id", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, sf_dir)
        assert kept.columns == wide.columns, name
        assert stage(spark, wide.limit(0), sf_dir).count() == 0


def test_repeated_rows_are_one_document(spark, make):
    docs = make(["a b c d e f"] * 3 + ["a b c d e f", "other words here now"], ids=[5, 5, 6, None, 7])
    kept = stages.keep_one_of_near_copies(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "None"] and kept.columns == docs.columns


def test_ids_beyond_the_broadcast_bound(spark, make):
    docs = make(["x"] * 10)
    ids = docs.select("doc_id").where("doc_id % 2 = 0")
    a = stages.without_ids(docs, ids).count()
    assert a == stages.without_ids(docs, ids, broadcast_ids=1).count() == 5


def test_mix_seed_is_the_documented_one():
    assert mixing.SHARE == 1.5 and mixing.MAX_REPEAT == 2.0


def test_near_copies_by_shingles_against_brute_force(spark, make):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 90))) for _ in range(25)]
    for t in texts[:12]:
        for edits in (1, 1, 2, 3, 5):
            own = t.split()
            for at in rng.sample(range(len(own)), edits):
                own[at] = rng.choice(words)
            texts.append(" ".join(own[rng.randint(0, 3) :]))
    texts += ["a b", "a b", "a c", None, "", "v w x y z " * 2, "v w x y z " * 9]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for t in texts]
    fps = [brute_simhash(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or (bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if near(i, j)) for i in range(len(texts))]
    by_bits = closure(fps, 3)
    assert len(set(label)) < len(set(by_bits))
    from framesift.llm import shingles

    for pairwise, block in ((shingles.PAIRWISE, shingles.BLOCK), (2, shingles.BLOCK), (2, 150)):
        found = shingles.near_copies(make(texts), pairwise=pairwise, block=block).collect()
        assert {r["id"]: r["component"] for r in found} == dict(enumerate(label))
    kept = stages.keep_one_of_near_copies(make(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_language_stage_without_a_model(spark, make):
    texts = ["some words", "élu", "123 ...", None, ""]
    docs = make(texts)
    for labelled in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        kept = stages.keep_identified(docs, labelled)
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1] and kept.columns == docs.columns


def test_different_texts_under_one_id(spark, make):
    item = " ".join(f"bench{i}" for i in range(20))
    texts = ["one two three four five six", "seven eight nine ten more words", "one two three four five six", f"with {item} inside", "clean words of its own", f"and {item} too", "clean without an id"]
    docs = make(texts, ids=[3, 3, 3, 4, 4, None, None])
    kept = stages.keep_one_of_near_copies(docs.where("doc_id = 3"))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts[:2]) and kept.columns == docs.columns
    copy = make([texts[0], texts[1], texts[0]], ids=[3, 5, 5])
    for bound in (stages.BROADCAST_IDS, 0):
        kept = stages.keep_one_of_near_copies(copy, broadcast_ids=bound)
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, texts[0]), (5, texts[1])]
    kept = stages.drop_contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == sorted([*texts[:3], texts[4], texts[6]]) and kept.columns == docs.columns


def test_language_stage_rejects_what_no_language_claims(spark, make):
    taught = make(["the and of"] * 6 + ["der und die"] * 6 + ["le et la"] * 6, langs=["en"] * 6 + ["de"] * 6 + ["fr"] * 6)
    texts = ["the and of", "und die der", "漢字 漢", None, "1 2", "the and of", "ελ"]
    docs = make(texts, ids=[1, None, 3, 4, 5, 1, None])
    kept = stages.keep_identified(docs, taught)
    assert sorted(r["text"] for r in kept.collect()) == ["the and of", "the and of", "und die der"] and kept.columns == docs.columns


def test_identified_texts_stay(spark, make):
    texts = ["the house of the words is here"] * 20 + ["le mot de la maison est ici"] * 20 + ["the", "Maison.", "漢字", "123", None]
    docs = make(texts, langs=["en"] * 20 + ["fr"] * 20 + [None] * 5)
    kept = {r["doc_id"] for r in stages.keep_identified(docs, docs).collect()}
    assert kept == set(range(42))  # even one word that is known tells; other scripts and no letters don't
    alone = docs.where("lang = 'en' OR lang IS NULL")
    assert stages.keep_identified(alone, alone).count() == 23  # one language: all texts with a letter

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import components, decontam, langid, simhash, substring, tokenbin

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(5000)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCABULARY, k=n))


# ---- languages

LANGUAGES = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from word but what some".split(),
    "de": "der die und in den von zu das mit sich des auf nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "le la les de des un une et en que qui dans pour sur au avec ne pas par plus ce son cette il sont".split(),
}


def test_language_held_out_accuracy(spark, make):
    rng = random.Random(4)
    texts, langs = [], []
    for i in range(400):
        lang = list(LANGUAGES)[i % 3]
        texts.append(" ".join(rng.choices(LANGUAGES[lang], k=12)))
        langs.append(lang if i % 10 else None)
    texts += [None, "", "123 ...", "Auch NICHT werden!", "le la les\n" * 4000]
    langs += [None] * 5
    docs = make(texts, langs=langs)
    model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    found = langid.identify(docs.withColumn("held", langid.held_out(F.col("doc_id"))), model).collect()
    judged = [r for r in found if r["held"] and r["lang"] and r["doc_id"] < 400]
    assert len(judged) > 40 and all(r["language"]["lang_pred"] == r["lang"] for r in judged)
    by_id = {r["doc_id"]: r["language"] for r in found}
    assert [by_id[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and by_id[400]["score"] == 0.0
    assert by_id[403]["lang_pred"] == "de" and by_id[404]["lang_pred"] == "fr"
    assert all(0 <= r["language"]["score"] <= 1 for r in found)
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found}
    assert all(r["held"] == crc[r["doc_id"]] for r in found)


def test_unseen_words_back_off(spark):
    model = langid.Model({"schule": {"de": 3}, "schnee": {"de": 3}, "school": {"en": 3}, "snow": {"en": 3}}, {"de": 6, "en": 6})
    assert model.predict("schnule")[0] == "de" and model.predict("snool")[0] == "en"
    assert model.predict("漢字") == ("de", pytest.approx(0.5))  # nothing known: equal sums, first by code point


def test_characters_that_are_no_letters(spark, make):
    model = langid.Model({"schule": {"de": 3}, "school": {"en": 3}}, {"de": 3, "en": 3})
    assert [model.predict(t) for t in ("\u00b2", "\u00bd \u2167", "\u2460_9", None)] == [("und", 0.0)] * 4
    assert langid.count_words("x\u00b2y Schule9schule \u2167") == {"x": 1, "y": 1, "schule": 2}


def brute_language(trained, text, max_gram=5):
    """The language's sums from lists of (lang, text), by the definitions of langid, without its arrays."""
    import math

    words = collections.Counter((lang, w) for lang, t in trained for w in re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted({lang for lang, _ in words})
    vocabulary = {w for _, w in words}
    total = {lang: sum(n for (x, _), n in words.items() if x == lang) for lang in langs}
    grams = collections.defaultdict(float)
    for (lang, w), n in words.items():
        marked = f"^{w}$"
        for size in range(1, max_gram + 1):
            for i in range(len(marked) - size + 1):
                if marked[i : i + size] not in ("^", "$"):
                    grams[lang, marked[i : i + size]] += math.log1p(n)
    known = {g for _, g in grams}
    mass = {(lang, s): sum(v for (x, g), v in grams.items() if x == lang and len(g) == s) for lang in langs for s in range(1, max_gram + 1)}
    sizes = collections.Counter(map(len, known))
    sums = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for lang in langs:
            if w in vocabulary:
                sums[lang] += math.log((words[lang, w] + 0.5) / (total[lang] + 0.5 * (len(vocabulary) + 1)))
                continue
            marked, found = f"^{w}$", []
            for end in range(2, len(marked) + 1):
                longest = next((marked[a:end] for a in range(max(0, end - max_gram), end) if marked[a:end] in known), None)
                if longest:
                    found.append(math.log((grams.get((lang, longest), 0.0) + 0.5) / (mass[lang, len(longest)] + 0.5 * max(1, sizes[len(longest)]))))
            sums[lang] += 1.5 * sum(found) / len(found) if found else 0.0
    return sums


def test_language_against_brute_force(spark, make):
    rng = random.Random(5)
    trained = [(lang, " ".join(rng.choices(words, k=9))) for lang, words in LANGUAGES.items() for _ in range(12)]
    docs = make([t for _, t in trained], langs=[lang for lang, _ in trained])
    model = langid.train(docs)
    assert model.languages == sorted(LANGUAGES)
    for _ in range(60):
        mixed = [w[::-1] if rng.random() < 0.3 else w for w in rng.choices(sum(LANGUAGES.values(), []), k=rng.randrange(1, 12))]
        want, text = brute_language(trained, " ".join(mixed)), " ".join(mixed)
        got = dict(zip(model.languages, model.sums(langid.count_words(text)), strict=True))
        assert got == pytest.approx(want)
        assert want[model.predict(text)[0]] == pytest.approx(max(want.values()))


def test_language_held_out_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    judged = langid.identify(docs.where(langid.held_out(docs["doc_id"]) & docs["lang"].isNotNull()), model).select("lang", "language.lang_pred").collect()
    assert len(judged) > 100 and sum(r[0] == r[1] for r in judged) >= 0.98 * len(judged)


def test_a_column_of_no_languages_is_an_error(spark, make, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.train(make(["x"] * 5, langs=list("abcde")))


def test_language_without_training(spark, make):
    model = langid.train(make([None, "x"], langs=["en", None]))
    assert langid.identify(make(["text"]), model).head()["language"]["lang_pred"] == "und"
    assert langid.identify(make([]), model).count() == 0


# ---- substrings


def brute_substrings(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window,few", [(35, False), (6, True), (5, True), (1, True)])
def test_substrings_against_brute_force(spark, make, window, few, monkeypatch):
    rng = random.Random(window)
    vocabulary = ["a", "b", "c"] if few else VOCABULARY
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(60):
        t = " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 34, 35, 36, 120])))
        texts.append(t + " " + passage[rng.randrange(20) :] + "\n" + " ".join(rng.choices(vocabulary, k=20)) if i % 4 == 0 and not few else t)
    texts += [None, "", texts[8], texts[8], "x " * 80, "x\x1c y\x85z w " * 40, prose(12000, rng)]
    ids = [*range(len(texts) - 3), 5, None, None]
    found = substring.dedup_substrings(make(texts, ids=ids), window=window).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in found)
    want = sorted((i is None, i or 0, *w) for i, w in zip(ids, brute_substrings(texts, window), strict=True))
    assert got == want
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in found)


def test_batches_settle_alike():
    words = [f"w{i % 50}" .encode() for i in range(400)]
    rolling = substring.Rolling(words)
    h = rolling.windows(5)
    g = rolling.checks(5, np.arange(len(h)))
    settled = substring._settle([h, h[:3]], [g, g[:3]], [1, 2], [0, 0], [np.arange(len(h)), np.arange(3)], True)
    assert settled["known"].sum() == 2 and settled.loc[settled["known"], "len"].tolist() == [len(h), 3]
    assert (settled["ord"] == -1).sum() == len(np.unique(h))


def test_colliding_hashes_remove_nothing(spark, make, monkeypatch):
    """Eight bits of the windows' first hash: the second one tells different windows apart."""
    whole = substring.Rolling.windows
    monkeypatch.setattr(substring.Rolling, "windows", lambda self, k: whole(self, k) & np.uint64(255 if k == 6 else 2**64 - 1))
    rng = random.Random(3)
    texts = [" ".join(rng.choices(VOCABULARY[:30], k=80)) for _ in range(30)] + ["a b c d e f g h"] * 2
    found = substring.dedup_substrings(make(texts), window=6).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in found) == [(i, *w) for i, w in enumerate(brute_substrings(texts, 6))]


def test_rows_alike_in_id_and_text(spark, make):
    texts = ["p q r s t"] * 200 + ["p q r s t u"] + ["short one"] * 3
    found = substring.dedup_substrings(make(texts, ids=[None] * 200 + [7] + [8] * 3), window=4).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["text"]) for r in found) == [("7", 6, 5, "u")] + [("8", 2, 0, "short one")] * 3 + [("None", 5, 5, "")] * 200


def test_minimizers_are_the_last_smallest():
    rng = np.random.default_rng(1)
    for span in (1, 2, 5, 18):
        grams = rng.integers(0, 6, 100).astype(np.uint64)
        want = [max(j for j in range(i, i + span) if grams[j] == grams[i : i + span].min()) for i in range(100 - span + 1)]
        assert substring.minimizers(grams, span).tolist() == want


def test_no_texts(spark, make):
    assert substring.dedup_substrings(make([])).count() == 0


# ---- SimHash


def brute_simhash(text, k=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, bits):
    label = list(range(len(fps)))
    change = True
    while change:
        change = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= bits:
                    label[i], change = label[j], True
    return label


def test_simhash_against_brute_force(spark, make):
    rng = random.Random(9)
    base = prose(300, rng).split()
    texts = [None, "", " \n", "One", "one", "É one", "two words"] + [prose(40, rng) for _ in range(20)]
    for i in range(25):
        w = base[:]
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[10], texts[10], "x " * 40000]
    ids = [1000 - 3 * i for i in range(len(texts))]
    rows = simhash.near_duplicates(make(texts, ids=ids)).collect()
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component"]) for r in rows}
    fps = [brute_simhash(t) for t in texts]
    label = closure(fps, 3)
    least = {c: min(i for i, x in zip(ids, label, strict=True) if x == c) for c in set(label)}
    assert got == {i: (f, least[c]) for i, f, c in zip(ids, fps, label, strict=True)}


@pytest.mark.parametrize("bits", [1, 3])
def test_links_span_every_part(spark, bits, monkeypatch):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    spread = [rng.randrange(64) for _ in range(14)]
    fps = {centre ^ sum({1 << spread[rng.randrange(14)] for _ in range(rng.randrange(6))}) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    for pairwise in (simhash.PAIRWISE, 3):
        own = np.array(fps, dtype=np.uint64)
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        assert simhash._parts(own, bits).tolist() == closure(fps, bits)
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(rows, bits)).collect()}
    label = closure(fps, bits)
    for i, f in enumerate(signed):
        members = [signed[j] for j in range(len(fps)) if label[j] == label[i]]
        assert roots.get(f, f) == min(members)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_blocks_and_tally(bits):
    from itertools import combinations

    found = [set(b) for b in simhash.blocks(bits)]
    assert all(any(b.isdisjoint(d) for b in found) for d in combinations(range(8), bits))
    assert bits != 3 or len(found) == 14
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(3) << rng.integers(0, 62, 200).astype(np.uint64))
    want = [sum(x == y for x, y in zip(int(i).to_bytes(8), int(j).to_bytes(8), strict=True)) for i, j in zip(a, b, strict=True)]
    assert simhash.tally(a, b).tolist() == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 499), (499, 500)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {500: 499}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_repeats_nulls_empty(spark, make):
    rows = simhash.near_duplicates(make(["a b c d"] * 3 + ["q"], ids=[4, 4, None, None])).collect()
    assert sorted(str(r["component"]) for r in rows) == ["4", "4", "4", "None"]
    assert simhash.near_duplicates(make([])).count() == 0


# ---- token shards


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenbin.tokenizer_path()
    whole, words = Tokenizer.from_file(path), tokenbin.coder(path)
    rng = random.Random(11)
    letters = "abzABZéÉßİıſKσΣς'’0123.,!?-_/\\<|> \u0085 \x1c\x1f\t\n 漢字é😀‍ʼn"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(1500)]
    texts += ["it's we'll I'M", "<|endoftext|> x<|startoftext|>", "a" * 500, "ΑΣ ΣΑΣ", "", " ", "x" * 65 + "É"]
    for t in texts:
        assert np.frombuffer(tokenbin.encode_text(words, t), dtype=words.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = tokenbin.tokenizer_path("byte_bpe_50k.json")
    words, whole = tokenbin.coder(path), Tokenizer.from_file(path)
    assert not words.by_words and tokenbin.coder(tokenbin.tokenizer_path()).by_words
    for t in ("It's  Two words.", "", "\n x\u00e9"):
        assert np.frombuffer(tokenbin.encode_text(words, t), dtype=words.kind).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_full_caches_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenbin, "CACHE_WORDS", 3)
    whole = Tokenizer.from_file(tokenbin.tokenizer_path())
    words = tokenbin._Words(whole)
    text = "One one, two; TWO three 4x four-five \u00c9t\u00e9 \u00e9t\u00e9. " * 5
    assert np.frombuffer(tokenbin.encode_text(words, text), dtype=words.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 5000])
def test_block_round_trip_and_checksum(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 900).astype(np.uint32)
    seen = dict(zip(*map(list, np.unique(ids, return_counts=True)), strict=True)) or {2: 1}
    table = tokenbin.Table(*tokenbin.normalized_frequencies({int(k): int(v) for k, v in seen.items()}))
    lengths = np.array([n // 2, n - n // 2])
    block = tokenbin.encode_block(ids, lengths, table, lanes=64, steps=8)
    back, docs = tokenbin.decode_block(block, table, steps=8)
    assert (back == ids).all() and docs.tolist() == lengths.tolist()
    if n > 1000:
        broken = bytearray(block)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            tokenbin.decode_block(bytes(broken), table, steps=8)
        assert len(block) < 4 * n


def test_parts_decode_alone():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.002, tokenbin.BLOCK_IDS + 12_345), 40_000).astype(np.uint32)
    table = tokenbin.Table(*tokenbin.normalized_frequencies({int(k): int(v) for k, v in zip(*np.unique(ids, return_counts=True), strict=True)}))
    block = tokenbin.encode_block(ids, np.array([len(ids)]), table)
    held = tokenbin.Block(block)
    assert held.n_parts == 17 and held.states.nbytes < 0.02 * len(block)
    per = held.per_part
    for start, count in ((0, 1), (per - 1, 2), (3 * per, per), (5 * per + 7, 2 * per), (len(ids) - 3, 3), (len(ids), 0), (16 * per, 12_345)):
        assert (tokenbin.decode_range(block, table, start, count) == ids[start : start + count]).all()
    # Words of another part may be lost: part 9 decodes from its own checkpoint, and nothing else is read.
    words = len(block) - held.stream.nbytes
    broken = bytearray(block)
    broken[words + 4 * int(held.offsets[2]) : words + 4 * int(held.offsets[4])] = bytes(4 * int(held.offsets[4] - held.offsets[2]))
    assert (tokenbin.decode_range(bytes(broken), table, 9 * per, per) == ids[9 * per : 10 * per]).all()
    for start in (2 * per, 3 * per):
        with pytest.raises(ValueError):
            tokenbin.decode_range(bytes(broken), table, start, per)
    with pytest.raises(ValueError):
        tokenbin.decode_range(block, table, len(ids), 1)
    with pytest.raises(ValueError):
        tokenbin.decode_block(b"FSB1" + bytes(100), table)
    short = tokenbin.encode_block(ids[:3000], np.array([3000]), table)
    assert len(short) < 6000 and (tokenbin.decode_block(short, table)[0] == ids[:3000]).all()


def test_documents_are_read_by_their_parts(spark, make, tmp_path):
    texts = [prose(n) for n in (5, 900, 20, 3000)] + [None]
    ids = [9, 2, 7, 5, None]
    out = str(tmp_path / "o")
    tokenbin.write_shards(make(texts, ids=ids), out)
    every = {r["id"]: r["ids"] for r in tokenbin.read_shards(spark, out).collect()}
    some = tokenbin.read_documents(spark, out, spark.createDataFrame([(7,), (2,), (2,), (None,), (1000,)], "doc_id long")).collect()
    assert {r["id"]: r["ids"] for r in some} == {i: every[i] for i in (7, 2)} and len(some) == 2


def test_frequencies():
    ids, freq = tokenbin.normalized_frequencies({5: 1, 9: 10**9, 2: 3}, 12)
    assert ids.tolist() == [2, 5, 9] and freq.sum() == 4096 and freq.min() >= 1
    with pytest.raises(ValueError):
        tokenbin.normalized_frequencies({i: 1 for i in range(5)}, 2)


def test_shards(spark, make, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenbin.tokenizer_path())
    texts = [prose(n) for n in (1, 50, 3000)] + [None, "", "  ", "é 😀 'll", "same", "same"]
    ids = [50, -3, 7, 8, 1, 2, 99, 30, None]
    out = str(tmp_path / "o")
    tokenbin.write_shards(make(texts, ids=ids), out)
    found = {r["id"]: (r["start"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in tokenbin.read_shards(spark, out).collect()}
    at = 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert found[i] == (at, want)
        at += len(want)
    told = {r["id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenbin.describe_shards(spark, out).collect()}
    assert told == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, (_, x) in found.items()}
    monkeypatch.setattr(tokenbin, "BLOCK_IDS", 500)  # many blocks; a text longer than one
    many = str(tmp_path / "m")
    tokenbin.write_shards(make(texts, ids=ids), many)
    assert spark.read.parquet(f"{many}/blocks").count() >= 3
    assert {r["id"]: (r["start"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in tokenbin.read_shards(spark, many).collect()} == found
    empty = str(tmp_path / "e")
    tokenbin.write_shards(make([]), empty)
    assert tokenbin.read_shards(spark, empty).count() == 0


# ---- decontamination


def test_decontamination(spark, make):
    rng = random.Random(13)
    items = [prose(n, rng) for n in (40, 16, 60, 8, 3)] + [None, ""]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")

    def changed(text, every):
        return " ".join(w if i % every else "other" for i, w in enumerate(text.split(), 1))

    planted = {
        0: items[0], 1: items[1].upper().replace(" ", ", "), 2: changed(items[0], 9), 3: " ".join(items[2].split()[10:28]),
        4: items[3], 5: changed(items[2], 6),
    }
    texts = [prose(100, rng) + " " + t + ". " + prose(50, rng) for t in planted.values()]
    clean = [prose(200, rng) for _ in range(20)] + [items[4] + " " + prose(50, rng), " ".join(items[0].split()[:9]), changed(items[0], 2), None, "", "..."]
    docs = make(texts + clean + [items[0]])
    for bound in (decontam.BROADCAST_HASHES, 0):
        found = {(r["doc"], r["item"]): r for r in decontam.find_overlaps(docs, benchmark, broadcast_hashes=bound).collect()}
        last = len(texts) + len(clean)
        assert set(found) == {(0, 0), (1, 1), (2, 0), (3, 2), (4, 3), (5, 2), (26, 4), (last, 0)}
        assert (found[0, 0]["start"], found[0, 0]["n_matched"], found[0, 0]["item_words"]) == (100, 40, 40)
        assert (found[3, 2]["start"], found[3, 2]["n_words"]) == (100, 18)
        assert found[last, 0]["start"] == 0
    assert decontam.find_overlaps(make([]), benchmark).count() == 0
    assert decontam.find_overlaps(docs, benchmark.limit(0)).count() == 0
    same = decontam.find_overlaps(make([items[0]] * 3, ids=[1, 1, None]), benchmark).collect()
    assert sorted(str(r["doc"]) for r in same) == ["1", "None"]


def test_kept_text_is_hashed_as_asked(spark, make):
    text = "a  b\tc\n d"
    r = substring.dedup_substrings(make([text])).select(F.sha2("text", 256).alias("h")).head()
    assert r["h"] == hashlib.sha256(b"a b c d").hexdigest()


def test_language_model_is_bounded(spark, make):
    docs = make(["aa aa aa bb bb cc " + "x" * 100, "dd dd ee ee ee ff"] * 3, langs=["en", "de"] * 3, ids=[1, 2, 3, 4, 5, 6])
    whole, few = langid.train(docs), langid.train(docs, model_words=2)
    assert set(whole.words) == {"aa", "bb", "cc", "dd", "ee", "ff"} and set(few.words) == {"aa", "ee"}
    assert few.languages == whole.languages == ["de", "en"] and few.predict("aa")[0] == "en" and few.predict("ee dd")[0] == "de"

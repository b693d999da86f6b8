import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framesift.llm import chat, licenses, linededup, multihash, neighbours


# ---- licenses


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LONG = next(t for t, label in licenses.PASSAGES.items() if label == "bsd")
TEXTS = [
    None, "", "...", "MIT License", "the mit-license; MIT LICENSE mit license", "GNU General Public  License v3", "general public license", "cc by cc by-nc",
    "Kit MİT licenseé mit licenseé", "x " * 3000 + "apache license", LONG, " ".join(w for i, w in enumerate(LONG.split()) if i != 9), "mit",
]


def test_licenses_against_brute_force(spark, make):
    rows = {r["id"]: r for r in licenses.label_documents(make(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert rows[10]["labels"] == "bsd" and rows[10]["score"] == 1.0
    assert rows[11]["labels"] == "bsd" and 0.6 <= rows[11]["score"] < 1.0  # a word left out: two diagonals, merged
    assert rows[3]["score"] == 1.0 and rows[6]["score"] == 0.0


def votes(text):
    """(labels, score) by counting votes one by one."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for size, found in ((licenses.PHRASE_GRAM, licenses.PHRASES), (licenses.PASSAGE_GRAM, licenses.PASSAGES)):
        for template, label in found.items():
            own = template.split()
            grams = [own[i : i + size] for i in range(len(own) - size + 1)]
            diagonals = {}
            for at in range(len(words) - size + 1):
                for place, gram in enumerate(grams):
                    if words[at : at + size] == gram:
                        diagonals.setdefault(at - place, []).append((at, place))
            islands, before = [], None
            for d in sorted(diagonals):
                if before is None or size == licenses.PHRASE_GRAM or d - before > licenses.NEAR:
                    islands.append([])
                islands[-1] += diagonals[d]
                before = d
            for hits in islands:
                coverage = len({place for _, place in hits}) / len(grams)
                length = max(at for at, _ in hits) + size - min(at for at, _ in hits)
                if coverage == 1 if size == licenses.PHRASE_GRAM else coverage >= licenses.COVERAGE and length <= licenses.STRETCH * len(own):
                    labels.add(label)
                    score = max(score, coverage)
    return ",".join(sorted(labels)), score


def test_license_labels_and_scores_by_counted_votes(spark, make):
    rng = random.Random(12)
    texts = list(TEXTS)
    for _ in range(60):
        words = rng.choice(list(licenses.PASSAGES) + list(licenses.PHRASES)).split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["the", "the"], words[at : at + 3]])
            words = words or ["x"]
        cut = rng.randrange(len(words))
        texts.append(" ".join(["Some Words"] * rng.randint(0, 3) + words[cut * rng.randint(0, 1) :] + words[:cut] * rng.randint(0, 1)).title())
    rows = {r["id"]: (r["labels"], r["score"]) for r in licenses.label_documents(make(texts)).collect()}
    want = {i: votes(t) for i, t in enumerate(texts)}
    assert rows == {i: (labels, pytest.approx(score)) for i, (labels, score) in want.items()}
    assert len({labels for labels, _ in want.values()}) > 5 and any(0 < score < 1 for _, score in want.values())


def test_licenses_repeats_nulls_empty(spark, make):
    assert licenses.label_documents(make([])).count() == 0
    same = licenses.label_documents(make(["mit license"] * 3, ids=[1, 1, None])).collect()
    assert [(r["n_base"], r["labels"]) for r in same] == [(1, "mit")] * 3


# ---- chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int, piece string, conv string")


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<|image_0|>", "[/INST]\\", None, "", "plain\nétext 😀", "<\\s>", "[INST"]
    rows = [(c, t, ["user", "assistant", "system", None, "[INST]\n"][(c + t) % 5], nasty[(3 * c + t) % len(nasty)], 1, "p", "q") for c in range(12) for t in range(4)]
    rows += [(None, 0, "assistant", "x", 1, "p", "q"), (5, None, "assistant", "first", 1, "p", "q"), rows[0]]
    out = chat.format_chats(turns(spark, rows))
    read = out.select("conv", "formatted", "n_turns", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    for r in read:
        own = sorted((x for x in rows if x[0] == r["conv"]), key=key)
        assert r["n_turns"] == len(own)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["formatted"].count("</s>") == len(own) and r["formatted"].count("<s>") == len(own)


def test_chat_parts(spark):
    parts = [("text", "see <|image_1|>", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", None), ("document", None, "c.pdf", -1), ("odd", "kept", None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, "user", None)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:bigint>>")
    found = {r["conv"]: r for r in chat.format_chats(rows, parts_col="parts").collect()}
    assert [(a["turn_at"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in found[1]["attachments"]] == [(1, 1, "image", "a.png", 1024), (1, 2, "audio", "b.wav", 25), (1, 3, "document", "c.pdf", 0)]
    assert found[1]["expanded_tokens"] == 1049 and "<|image_1|><|audio_2|><|document_3|>kept" in found[1]["formatted"]
    assert found[1]["formatted"].count("<|image_1|>") == 1
    assert found[2]["attachments"] == [] and found[2]["n_turns"] == 1
    assert chat.format_chats(turns(spark, [])).count() == 0


# ---- fingerprints


def test_fingerprints_are_multiset_sums(spark, make):
    p = ["one two three four", "five six", "seven", "one two three four five"]
    texts = ["\n".join(p), "\n".join(p[::-1]), "\n\n".join([*p, ""]), "\n".join([*p, p[0]]), "\n".join(p[:3]), p[3], None, "", "\n".join(p)]
    docs = make(texts, ids=[*range(8), 0])
    rows = multihash.fingerprint_documents(docs).collect()
    fp = {int(r["id"]): r["fingerprint"] for r in rows}
    assert len(rows) == 9 and [r["fingerprint"] for r in rows].count(fp[0]) == 4
    assert fp[0] == fp[1] == fp[2] != fp[3] and fp[6] == fp[7] == "0" * len(fp[0])
    both = spark.createDataFrame([(fp[4], fp[5], fp[0])], "a string, b string, c string")
    r = both.select(multihash.combine(F.col("a"), F.col("b")).alias("s"), multihash.combine(F.col("c"), F.col("b"), -1).alias("d")).head()
    assert r["s"] == fp[0] and r["d"] == fp[4]


def test_edits_and_neighbours(spark, make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)] + ["é😀" * 5, None, "", "same", "same"]
    ids = [3 * i - 50 for i in range(len(texts))]
    rows = {r["id"]: r for r in multihash.compare_with_edits(make(texts, ids=ids), buckets=6).collect()}
    for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (rows[k]["n_chars"], rows[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[k]["near_next"] <= 1 and 0 <= rows[k]["near_edited"] <= 1
        if i < 40:
            assert rows[k]["near_edited"] > rows[k]["near_next"] and abs(rows[k]["near_edited"] - 0.5) < 0.35
    assert rows[ids[-2]]["near_next"] == 1.0
    assert multihash.compare_with_edits(make([])).count() == 0
    assert multihash.compare_with_edits(make(["alone text here"])).head()["near_next"] == 1.0
    assert multihash.compare_with_edits(make(["a b", "a b", None], ids=[1, 1, None])).count() == 3


def plain_fingerprint(text):
    """(the fingerprint, its likeness lanes) by their definitions, word triple by word triple."""
    import xxhash

    def chained(*parts):  # xxhash64 of several columns: each one's hash is the next one's seed, nulls are passed over
        seed = 42
        for part in parts:
            if part is not None:
                seed = xxhash.xxh64_intdigest(part, seed=seed)
        return seed

    identity, ones, n = [0] * 16, {(h, j, k): 0 for h in (0, 1) for j in range(31) for k in (0, 31)}, 0
    for paragraph in re.split(r"\n+", text):
        if paragraph == "":
            continue
        digest = hashlib.sha512(paragraph.encode()).hexdigest()
        identity = [(x + int(digest[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(identity)]
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", paragraph)] or [b""]
        for i in range(max(len(words) - 2, 1)):
            a, b, c = (words[i + k] if i + k < len(words) else None for k in range(3))
            n += 1
            for h, value in enumerate((chained(a, b, c), chained(c, a, b, (1).to_bytes(4, "little")))):
                for j in range(31):
                    for k in (0, 31):
                        ones[h, j, k] += value >> (j + k) & 1
    lanes = [2 * ones[h, j, k] - n for h in (0, 1) for j in range(31) for k in (0, 31)]
    return "".join(f"{x % 2**32:08x}" for x in [n, *identity, *lanes]), lanes


def plain_likeness(one, two, same):
    size = (sum(x * x for x in one) * sum(x * x for x in two)) ** 0.5
    return 1.0 if same else 0.0 if size == 0 else max(0.0, min(1.0, sum(x * y for x, y in zip(one, two, strict=True)) / size))


def test_fingerprints_digit_by_digit(spark, make):
    rng = random.Random(9)
    texts = ["x " * 40_000, "one two three four\n\nfive six\nseven", "\n", None, " \t\n a", "Ä é 😀 b\n" * 3, "p q r s t\nu v w"] + [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(5)]
    rows = {r["id"]: r for r in multihash.compare_with_edits(make(texts)).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        (own, lanes), (edited, edited_lanes), (nxt, next_lanes) = (plain_fingerprint(x) for x in (text, text[: len(text) - half] + after[:half], after))
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (own, edited)
        assert rows[i]["near_edited"] == pytest.approx(plain_likeness(lanes, edited_lanes, own == edited))
        assert rows[i]["near_next"] == pytest.approx(plain_likeness(lanes, next_lanes, own == nxt))
    assert rows[0]["near_edited"] > 0.9  # half of one triple's 39,998 repeats: 16-bit lanes would wrap
    repeated = multihash.fingerprint_documents(make([*texts, texts[1], texts[1]], ids=[*range(len(texts)), 1, 9])).collect()
    assert sorted((r["id"], r["fingerprint"]) for r in repeated) == sorted((str(i), plain_fingerprint(t or "")[0]) for i, t in [*enumerate(texts), (1, texts[1]), (9, texts[1])])


def test_successors_for_any_bucket_count(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-1000, 100000), 200))
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "k long, t string")
    from pyspark.sql import Window

    for buckets in (1, 2, 7, 300):
        placed = neighbours.with_successors(rows, "k", ["t"], buckets)
        found = placed.withColumn("nxt", F.lead("k").over(Window.partitionBy("bucket").orderBy("at"))).where(~F.col("guest")).collect()
        assert {r["k"]: r["nxt"] for r in found} == {k: keys[(i + 1) % 200] for i, k in enumerate(keys)}


# ---- lines


def test_line_dedup(spark):
    page = "<html><script>x</script><nav>Home</nav><p>Body {i} &amp; more<br>Twice</p><p>Twice</p></html>"
    rows = [(i, "https://U@Host.example:80/a", page.replace("{i}", str(i)), "h", 1) for i in range(5)]
    rows += [(10, "http://few.example/", "<p>Home</p>", "h", 1), (11, None, "<p>Home</p>", "h", 1), (12, "http://few.example/", None, "h", 1), (None, "not a url", "", "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines int")
    for bound in (linededup.BROADCAST_LINES, 0):
        found = {r["id"]: r for r in linededup.drop_boilerplate(pages, broadcast_lines=bound).collect()}
        assert len(found) == 9
        assert [(found[i]["host"], found[i]["n_lines"], found[i]["n_dropped"], found[i]["text"]) for i in range(5)] == [("host.example", 4, 3, f"Body {i} & more") for i in range(5)]
        assert found[10]["text"] == "Home" and found[11]["host"] == "" and found[12]["n_lines"] == 0
    assert linededup.drop_boilerplate(pages.limit(0)).count() == 0
    two = [(1, "http://two.example/a", "<p>Both</p><p>One</p>", "h", 1), (2, "http://two.example/b", "<p>\x0b Both\t</p>" + "<p>y </p>" * 5000, "h", 1)]
    found = {r["id"]: r for r in linededup.drop_boilerplate(spark.createDataFrame(two, pages.schema)).collect()}
    assert found[1]["text"] == "One" and (found[2]["n_lines"], found[2]["n_dropped"], found[2]["text"][:4]) == (5001, 1, "y\ny\n")


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_substring_dedup", "op5_chat_format", "op9_decontaminate", "op10_site_lines"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from framesift.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for file in os.listdir(sf):
        c.execute(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    got = queries.queries()[name](spark, sf).toPandas()
    want = c.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(repr, got.round(6).values.tolist())) == sorted(map(repr, want.round(6).values.tolist()))

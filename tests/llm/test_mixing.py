import re

import pytest

from framesift.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling by repeated sharing. sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total, given = sum(w[s] for s in open_), left
        left = 0.0
        for s in sorted(open_, key=str):
            out[s] += given * w[s] / total
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
        open_ = {s for s in open_ if out[s] < cap * sizes[s]}
    return out


def test_plan_and_draw(spark, make):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(300)] + [None, "", "  \t"]
    sources = [["b", "a", None, "é", "Z"][min(4, i * i % 11)] for i in range(303)]
    docs = make(texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    assert len(rows) == 303
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (r["size"] * int(r["rate"]), r["size"] * (int(r["rate"]) + 1)) and r["taken"] <= 2 * r["size"]
    again = {r["id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r["id"]: r["taken"] for r in rows}


def test_taken_is_near_target(spark, make):
    docs = make(["one two three four"] * 4000, sources=["hot"] * 2500 + ["b"] * 1000 + ["c"] * 500)
    got, want = {}, {}
    for r in mixing.mix_sources(docs).collect():
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        want[r["source"]] = r["target"]
    for s, n in got.items():
        assert n == pytest.approx(want[s], rel=0.06)


def test_copies_keep_all_columns(spark, make):
    docs = make(["a b c"] * 30 + [None], sources=["x", "y", None] * 10 + ["x"])
    emitted = mixing.emit_copies(docs)
    assert emitted.columns == docs.columns
    planned = {r["id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    found = {}
    for r in emitted.collect():
        found[str(r["doc_id"])] = found.get(str(r["doc_id"]), 0) + 1
    assert found == {k: v for k, v in planned.items() if v}
    joined = mixing.mix_sources(docs, broadcast_sources=1).collect()
    assert {r["id"]: r["copies"] for r in joined} == planned


def test_empty(spark, make):
    assert mixing.mix_sources(make([])).count() == 0
    assert mixing.emit_copies(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(make([None, ""])).collect()] == [0, 0]

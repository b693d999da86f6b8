import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framesift.llm import partcodes


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows of (id, vector, label) -> (id, code, error, label_error), digest; by the contract's words in plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        new = []
        for p in range(parts):
            own = {}
            for f, c in zip(found, cut, strict=True):
                own.setdefault(f[p], []).append(c[p])
            new.append([[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = new
    best = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{k:02x}" for _, k in b), e, by[label]) for (i, _, label), b, e in zip(kept, best, errors, strict=True)], key=repr), digest


SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, error int, part long, total string"


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)
    coded, books = partcodes.compress(df, **sizes)
    found = partcodes.with_label_errors(partcodes.materialized(coded))
    return sorted([(r["id"], r["code"], r["error"], r["label_error"]) for r in found.collect()], key=repr), books


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(size=(n, dim))]


def test_against_plain_integers(spark):
    own = vectors(150, 32, 1)
    rows = [(i * 3 - 50, v, i % 4 if i % 7 else None) for i, v in enumerate(own)]
    rows += [(1000 + i, own[0], 9) for i in range(90)]  # one vector very often
    rows += [(-49, own[5], 1), (-50, own[6], 1), (None, own[7], None)]  # ids that repeat or are null
    rows += [(5000, None, 1), (5001, [], 1), (5002, [math.nan] * 32, 1), (5003, [None] + [0.0] * 31, 1), (5004, [math.inf] * 32, 1), (5005, [-math.inf] * 32, 1)]
    found, books = run(spark, rows)
    want, digest = brute(rows)
    assert found == want and partcodes.books_digest(books) == digest


def test_ties_small_tables_and_other_lengths(spark):
    rows = [(i, [float(i % 3), -0.001] * 16, 0) for i in range(9)]  # equal entries: the lower one counts
    found, books = run(spark, [*rows, (50, [1.0] * 16, 0), (51, [1.0] * 17, 0), (52, [2e6] * 32, 0)])
    want, digest = brute(rows)
    assert found == want and partcodes.books_digest(books) == digest
    assert books.shape == (16, 9, 2)


def test_empty(spark):
    assert run(spark, []) == ([], pytest.approx(np.zeros((16, 0, 0))))
    assert run(spark, [(1, None, 1)])[0] == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.sampled_from([2, 5, 1000, 1 << 27]), st.integers(0, 10_000))
def test_tree_finds_the_first_nearest(k, width, spread, seed):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (40, width))
    far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    found, best = partcodes.VantageTree(entries).nearest(points)
    assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_bounds_leave_out_most_entries():
    rng = np.random.default_rng(3)
    centres = rng.integers(-10_000, 10_000, (64, 4))
    points = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 4))
    tree, held = partcodes.VantageTree(centres), []
    hold = tree._hold
    tree._hold = lambda node, points, rows: (held.append(len(rows)), hold(node, points, rows))[1]
    tree.nearest(points)
    assert sum(held) < 0.6 * 64 * len(points)

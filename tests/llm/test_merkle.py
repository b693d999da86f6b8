import hashlib
import zlib

import pytest

from framesift.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """(root, path of each node): a path is a list of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, i in enumerate(at):
            run, k = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        at = [i // fanout for i in at]
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=8):
    """rows of (doc_id, source, lang, n_chars, text) -> the query's rows, by the contract's words."""
    groups = {}
    for r in rows:
        leaf = H(*map(field, r))
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0], leaf, H(*map(field, (*r[:4], low))) if hit else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    inner = {g: tree([x[1] for x in groups[g]], fanout) for g in order}
    root, over = tree([inner[g][0] for g in order], fanout) if order else (None, [])
    found = []
    for g, up in zip(order, over, strict=True):
        for (i, leaf, used), path in zip(groups[g], inner[g][1], strict=True):
            h = used
            for left, right in path + up:
                h = H(left, h, right)
            found.append((i, leaf, inner[g][0], root, H(*[a + b for a, b in path + up]), h, h == root))
    return sorted(found, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, n string, h string, own int, levels int, up int, group string"
EXTRA = ("x", "x", "x", 1, 2, 3, "y")


def check(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    assert rows_of(merkle.audit(docs, **sizes)) == brute(rows, sizes.get("fanout", 8))


def awkward():
    rows = [(i, "s", "en", 3, f"Text {i} Ä") for i in range(70)]
    rows += [(100, "s", "de", 3, "A lone Leaf"), (200, None, None, None, None), (201, "", "", 0, ""), (None, "s", "fr", 1, "NULL id"), (None, "s", "fr", 1, "other")]
    rows += [(7, "s", "en", 3, "Text 7 Ä"), (7, "t", "en", 3, "another Seven"), (300, "-", "es", 1, "-"), (301, "s", "es", -5, "Z" * 50_000)]
    return rows + [(400 + i, "s", f"l{i:02}", 1, "many Languages") for i in range(9)]


def test_against_plain_trees(spark):
    check(spark, awkward())


@pytest.mark.parametrize("n", [1, 17])
def test_rounds_of_small_blocks(spark, n):
    check(spark, [(i, "s", "en", 1, f"Word {i}") for i in range(n)] + [(1000 + i, "s", "de", 1, "B") for i in range(3)], fanout=2, steps=2)


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_partitioning_gives_the_same_root(spark):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in awkward()], SCHEMA)
    assert len({r["root"] for p in (1, 7) for r in merkle.audit(docs.repartition(p)).collect()}) == 1

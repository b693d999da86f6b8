"""Vectors as short codes: a codebook for each of PARTS consecutive parts, all in integers.

Components become floor(SCALE * x). Each part has a codebook of ENTRIES entries, first that part of the vectors with the smallest ids.
A round assigns every part to its nearest entry and replaces each entry by its parts' componentwise floored mean. A code is the entries' numbers.

The nearest entry is found by branch and bound in a vantage-point tree over the entries of a part. A node is an entry, the vantage point;
each of its two subtrees keeps the least and the greatest distance of its entries to it. Those radii are whole numbers, rounded outwards
(down and up), as is a vector's own distance, so that the triangle inequality's bound on a subtree is never above the true least distance.
A subtree is visited unless its bound is beyond the best distance found (not strictly: equal distances go to the lower entry). What decides is
the exact squared distance in 64-bit integers. A batch of vectors walks the tree together: first each goes down to its own side for a
good start, then every node is held against those vectors that can't leave it out.

The work on vectors runs in Arrow batches, a task for each partition of the input; sums of a round are added up per task first, and the driver
gets one row for each component of the codebooks. Only codebooks are sent to tasks.

Defined results: vectors that are null or empty, or hold null, NaN, an infinity or a component of LIMIT or more (whose squares
don't fit), are dropped. So are those whose length isn't the commonest length (the shorter one of two) among lengths that PARTS divides.
Rows that repeat an id are rows of their own; for the first codebook they are ordered by their components, null ids come last. With fewer than ENTRIES rows there
are as many entries. Null labels count as equal. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized, releasing, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components at or beyond it are no data: the sum of their squares may pass 63 bits.
LIMIT = 1 << 20
#: Rows worked on at once in a task.
ROWS_AT_ONCE = 4096
#: Labels whose sums may be broadcast (a row of some 50 bytes each); beyond it they are joined by exchange.
BROADCAST_LABELS = 100_000
SCHEMA = "id long, label string, code string, error long"


# ---- the tree


def floor_root(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, exactly."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


def distances(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    gap = points - entry
    return np.einsum("ij,ij->i", gap, gap)


class VantageTree:
    """Entries of one part. Node k is the k-th in preorder: its entry, and for each side the child's node (or -1) with its least and greatest radius."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.vantage: list[int] = []
        self.child: list[list[int]] = []
        self.radii: list[list[tuple[int, int]]] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        node, point = len(self.vantage), int(members[0])
        self.vantage.append(point)
        self.child.append([-1, -1])
        self.radii.append([(0, 0), (0, 0)])
        rest = members[1:]
        far = distances(self.entries[rest], self.entries[point])
        order = np.argsort(far, kind="stable")
        half = (len(rest) + 1) // 2
        for side, chosen in enumerate((order[:half], order[half:])):
            if len(chosen):
                own = far[chosen]
                self.radii[node][side] = (int(floor_root(own.min(keepdims=True))[0]), int(ceil_root(own.max(keepdims=True))[0]))
                self.child[node][side] = self._grow(np.sort(rest[chosen]))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest entry, the lower one of equals, and the squared distance."""
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.found = np.full(len(points), len(self.entries))
        everyone = np.arange(len(points))
        if len(points):
            self._go_down(0, points, everyone)
            self._visit(0, points, everyone)
        return self.found, self.best

    def _hold(self, node: int, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Holds a node's entry against the rows; their squared distances."""
        point = self.vantage[node]
        far, best = distances(points[rows], self.entries[point]), self.best[rows]
        better = (far < best) | ((far == best) & (point < self.found[rows]))
        self.best[rows[better]], self.found[rows[better]] = far[better], point
        return far

    def _go_down(self, node: int, points: np.ndarray, rows: np.ndarray) -> None:
        far = self._hold(node, points, rows)
        near, beyond = self.child[node]
        inside = far <= self.radii[node][0][1] ** 2 if beyond >= 0 else np.ones(len(rows), dtype=bool)
        for child, own in ((near, rows[inside]), (beyond, rows[~inside])):
            if child >= 0 and len(own):
                self._go_down(child, points, own)

    def _visit(self, node: int, points: np.ndarray, rows: np.ndarray) -> None:
        far = self._hold(node, points, rows)
        low = floor_root(far)
        high = low + (low * low < far)
        for child, (least, most) in zip(self.child[node], self.radii[node], strict=True):
            if child >= 0:
                bound = np.maximum(np.maximum(low - most, least - high), 0)
                open_ = bound * bound <= self.best[rows]
                if open_.any():
                    self._visit(child, points, rows[open_])


def assign(vectors: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts entries, rows x parts squared distances)"""
    cut = vectors.reshape(len(vectors), len(trees), -1)
    found = [tree.nearest(np.ascontiguousarray(cut[:, p])) for p, tree in enumerate(trees)]
    return np.stack([f for f, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


# ---- Spark


def kept_vectors(df: DataFrame, *, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """id, label, v: whole-number components of the rows that are kept."""
    vector = df[vector_col].cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("string").alias("label"), vector.alias("v"))
    rows = rows.where(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(at, ROWS_AT_ONCE)
            yield piece, piece.column("v").flatten().to_numpy().reshape(piece.num_rows, -1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the codebooks (parts x entries x components) whose entries are the floored means of the parts assigned to them."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in shared.value]
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, vectors in _pieces(batches):
            found, _ = assign(vectors, trees)
            cut = vectors.reshape(len(vectors), parts, width)
            for p in range(parts):
                np.add.at(sums[p], found[:, p], cut[:, p])
                counts[p] += np.bincount(found[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            place = np.tile(np.arange(width), len(part))
            part, entry = np.repeat(part, width), np.repeat(entry, width)
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "at": place, "total": sums[part, entry, place], "n": counts[part, entry]})

    sums = rows.select("v").mapInArrow(releasing(run), "part long, entry long, at long, total long, n long")
    better = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row for each component of the codebooks
        better[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]  # floors
    return better


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of rows id, label, v."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in shared.value]
        words = np.array([f"{i:0{digits}x}" for i in range(books.shape[1])])
        for piece, vectors in _pieces(batches):
            found, far = assign(vectors, trees)
            codes = ["".join(r) for r in words[found].tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label").cast(pa.string()), pa.array(codes, pa.string()), pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(releasing(run), SCHEMA)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error for each kept row; the codebooks, parts x entries x components)"""
    rows = kept_vectors(df, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, scale=scale)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return df.sparkSession.createDataFrame([], SCHEMA), np.zeros((parts, 0, 0), dtype=np.int64)
    books = np.ascontiguousarray(np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = improved(rows, books)
    return encode(rows, books), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over equal labels. coded is stored."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    if coded.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["own"])).drop("own")


def query(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    found = with_label_errors(materialized(coded))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """assigned_i by books_i, and books_(i + 1)."""
    return f"""
assigned_{i} AS (
  SELECT p.vec_id, p.part, min({{'far': list_sum([(p.q[j] - b.q[j]) * (p.q[j] - b.q[j]) FOR j IN range(1, len(p.q) + 1)]), 'entry': b.entry}}) AS best
  FROM cut p JOIN books_{i} b USING (part) GROUP BY p.vec_id, p.part
),
means_{i} AS (
  SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS q
  FROM (SELECT p.part, best.entry AS entry, place, sum(p.q[place]::HUGEINT) AS total, count(*) AS n FROM assigned_{i} JOIN cut p USING (vec_id, part), range(1, len(p.q) + 1) t(place) GROUP BY ALL)
  GROUP BY part, entry
),
books_{i + 1} AS (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM books_{i} b LEFT JOIN means_{i} m USING (part, entry)),"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
cut AS (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) t(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
books_0 AS (SELECT part, entry, q FROM cut JOIN firsts USING (vec_id)),
{''.join(_round_sql(i) for i in range(ROUNDS + 1))}
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error
  FROM assigned_{ROUNDS} JOIN (SELECT vec_id, label FROM kept) USING (vec_id) GROUP BY vec_id
),
digest AS (SELECT sha256(string_agg(q[place]::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books_{ROUNDS}, range(1, len(q) + 1) t(place))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded CROSS JOIN digest
"""

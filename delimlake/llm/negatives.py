"""Hard negatives: rows of other labels that score nearly as high as an anchor's positives.

Anchors and candidates are cut into blocks of bounded size; a tile joins one
block of anchors to one of candidates and multiplies them as int64 matrices by
Strassen's recursion, with zeros where a side is odd or a vector short. Sums are
exact: they are taken modulo 2^64, so intermediate ones may wrap. Two passes
over the tiles: the first keeps a heap of best positives per anchor, the second a
heap per anchor and positive of the negatives within the positive's window of
scores. A tile's heaps hold a fixed number of entries, and Spark merges them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delimlake.llm.common import cut

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between these percentages of its positive's score.
LEAST, MOST = 80, 100
#: Rows of a block of anchors, and of candidates: a tile's scores take 16 MB.
ANCHORS, BLOCK = 1024, 2048
#: Columns of a tile that are multiplied and pushed at a time.
STRIP = 512
#: Sides up to which numpy multiplies directly.
LEAF = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b, modulo 2^64, with seven products of halves for each two by two blocks."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    c = np.zeros((2 * h, 2 * j), np.int64)
    c11, c12, c21, c22 = c[:h, :j], c[:h, j:], c[h:, :j], c[h:, j:]
    for x, y, plus, minus in (
        (a11 + a22, b11 + b22, (c11, c22), ()),
        (a21 + a22, b11, (c21,), (c22,)),
        (a11, b12 - b22, (c12, c22), ()),
        (a22, b21 - b11, (c11, c21), ()),
        (a11 + a12, b22, (c12,), (c11,)),
        (a21 - a11, b11 + b12, (c22,), ()),
        (a12 - a22, b21 + b22, (c11,), ()),
    ):
        p = strassen(x, y, leaf)
        for to in plus:
            to += p
        for to in minus:
            to -= p
    return c[:m, :n]


def matrix(vectors, width: int) -> np.ndarray:
    """An Arrow array of lists as rows of int64, zeros behind short ones."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Heaps:
    """For each of n rows the k best (score, id): higher scores first, then smaller ids. Ids must come in rising order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.held = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), bool)

    def push(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        scores = np.hstack([self.scores, scores])
        ids = np.hstack([self.ids, np.broadcast_to(ids, allowed.shape)])
        held = np.hstack([self.held, allowed])
        # ~x orders like -x and can't overflow; a stable sort leaves ties in the order of ids.
        best = np.argsort(np.where(held, ~scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, : self.k]
        self.scores, self.ids, self.held = (np.take_along_axis(x, best, 1) for x in (scores, ids, held))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of all entries."""
        row, at = np.nonzero(self.held)
        return row, self.ids[row, at], self.scores[row, at]


def strips(a, b):
    """(scores, ids, labels) of a tile, a strip of candidates at a time, by rising id."""
    b = b.sort_by("id")
    va, vb = a["v"].combine_chunks(), b["v"].combine_chunks()
    width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (va, vb))
    left, right = matrix(va, width), matrix(vb, width)
    ids, labels = b["id"].to_numpy(), b["label"].to_numpy()
    for i in range(0, len(ids), STRIP):
        part = slice(i, i + STRIP)
        yield strassen(left, np.ascontiguousarray(right[part].T)), ids[part], labels[part]


def _positive_heaps(a, b):
    import pyarrow as pa

    names = ["row", "positive_id", "positive_score"]
    if not (a.num_rows and b.num_rows):
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    ids, labels = a["id"].to_numpy()[:, None], a["label"].to_numpy()[:, None]
    heaps = Heaps(a.num_rows, POSITIVES)
    for scores, cid, clabel in strips(a, b):
        heaps.push(scores, cid, (labels == clabel) & (ids != cid))
    row, ident, score = heaps.entries()
    return pa.table([a["row"].to_numpy()[row], ident, score], names=names)


def _window_heaps(a, b):
    import pyarrow as pa

    names = ["row", "positive_no", "negative_id", "negative_score"]
    if not (a.num_rows and b.num_rows):
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    labels = a["label"].to_numpy()[:, None]
    rows, out = a["row"].to_numpy(), []
    # One heap a positive; anchors with fewer have an empty window there, from 1 to 0.
    low, high = np.ones((len(rows), POSITIVES), np.int64), np.zeros((len(rows), POSITIVES), np.int64)
    for side, bounds in ((low, a["least"].to_pylist()), (high, a["most"].to_pylist())):
        for i, x in enumerate(bounds):
            side[i, : len(x)] = x
    heaps = [Heaps(a.num_rows, NEGATIVES) for _ in range(POSITIVES)]
    for scores, cid, clabel in strips(a, b):
        other = labels != clabel
        for i, heap in enumerate(heaps):
            heap.push(scores, cid, other & (scores >= low[:, i : i + 1]) & (scores <= high[:, i : i + 1]))
    for i, heap in enumerate(heaps):
        row, ident, score = heap.entries()
        out.append(pa.table([rows[row], np.full(len(row), i, np.int64), ident, score], names=names))
    return pa.concat_tables(out)


def _tiles(anchors: DataFrame, rows: DataFrame, na: int, nc: int, heaps, schema: str) -> DataFrame:
    """heaps(anchors of a tile, candidates of a tile), as Arrow tables, for every tile."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(na)).cast("int").alias("x"), every(nc).alias("y"))
    # Aliases make the sides' columns distinct; they come from one table.
    right = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "v")], F.pmod(F.xxhash64("row"), F.lit(nc)).cast("int").alias("y"), every(na).alias("x"))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(heaps, schema)


def _ranked(rows: DataFrame, keys: list[str], ident: str, score: str, k: int) -> DataFrame:
    """rows with rank, the k best by keys."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, is_anchor: Column, *, ident: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each anchor and each of its POSITIVES best other rows of its label: the
    NEGATIVES best rows of other labels whose score lies between LEAST and MOST
    percent of the positive's. Score: inner product; ties go to the smaller
    ident. vector is an array of longs, label whole. Rows where ident, label or
    vector is null take no part, and anchors without positives or negatives give
    no row. Other rows are those of another ident. Repeated rows: each is a
    candidate and an anchor of its own. Vectors of different lengths are compared
    over their common components. Scores must fit in 64 bits; a positive score
    below 0 has an empty window. Empty tables give no rows; other columns are
    not read, whatever their names.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = cut(rows.where("id is not null and label is not null and v is not null"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), True)).alias("a")).first()
    na, nc = max(1, -(-sizes["a"] // ANCHORS)), max(1, -(-sizes["n"] // BLOCK))
    anchors = rows.where("anchor").select("row", "id", "label", "v")

    found = _tiles(anchors, rows, na, nc, _positive_heaps, "row long, positive_id long, positive_score long")
    best = cut(_ranked(found, ["row"], "positive_id", "positive_score", POSITIVES).withColumn("positive_no", (F.col("rank") - 1).cast("long")).drop("rank"))
    p = F.col("positive_score")
    # The least whole score of a window: upwards of LEAST percent, in decimals that can't overflow.
    least = F.ceil(p.cast("decimal(20,0)") * LEAST / 100).cast("long")
    most = F.floor(p.cast("decimal(20,0)") * MOST / 100).cast("long")
    windows = best.select("row", F.struct("positive_no", least.alias("least"), most.alias("most")).alias("w"))
    windows = windows.groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("w")).select("row", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    found = _tiles(anchors.join(windows, "row"), rows, na, nc, _window_heaps, "row long, positive_no long, negative_id long, negative_score long")
    mined = _ranked(found, ["row", "positive_no"], "negative_id", "negative_score", NEGATIVES)
    out = mined.join(best, ["row", "positive_no"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

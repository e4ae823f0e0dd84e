"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Queries and candidates are cut into blocks of bounded size; a cell joins one
query block to one candidate block. Within a cell, candidates become postings by
term (vector component); term by term, the queries that have the term scatter
its weighted postings into a dense array of scores. Partition selection leaves
each query's k best of the cell, and Spark merges them over the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
#: Vectors of a block of queries, and of candidates: a cell's scores take 64 MB.
QUERY_BLOCK, BLOCK = 2048, 4096


def quantize(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component, as longs; null if any is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _terms(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components of an Arrow array of lists."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    keep = flat != 0
    return row[keep], term[keep], flat[keep]


def scores(queries, candidates) -> np.ndarray:
    """Inner products of two Arrow arrays of lists, term at a time: queries x candidates."""
    out = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    qr, qt, qw = _terms(queries)
    cr, ct, cw = _terms(candidates)
    q_order, c_order = np.argsort(qt, kind="stable"), np.argsort(ct, kind="stable")
    qr, qt, qw, cr, ct, cw = qr[q_order], qt[q_order], qw[q_order], cr[c_order], ct[c_order], cw[c_order]
    for t in np.unique(qt):
        a, b = np.searchsorted(qt, (t, t + 1))
        c, d = np.searchsorted(ct, (t, t + 1))
        if c == d:
            continue
        for i in range(a, b):  # a term's postings hold each candidate once
            out[qr[i], cr[c:d]] += qw[i] * cw[c:d]
    return out


def block_of(n: int) -> Column:
    """The block of a row by the hash of its number, which spreads rows of few and of many partitions alike."""
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")


def top_k(vectors: DataFrame, is_query: Column, *, ident: str = "vec_id", vector: str = "vector", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k best other rows.

    vector is an array of longs; rows where it is null take no part, rows
    without ident neither. Ties go to the smaller ident. A query is compared to
    every row but those of its own ident. Repeated rows: each row is a candidate
    of its own, and each query row has ranks of its own. Vectors of different
    lengths are compared over their common components. Scores must fit in 64
    bits. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)).alias("q")).first()
    nq, nc = max(1, -(-sizes["q"] // QUERY_BLOCK)), max(1, -(-sizes["n"] // BLOCK))
    # Blocks by the rows' numbers, hashed: repeated rows spread like others.
    no = F.monotonically_increasing_id()
    left = rows.where("q").select(no.alias("row"), "id", "v").select("*", block_of(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    right = rows.select(no.alias("row"), "id", "v").select("*", block_of(nc).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def cell(a, b):
        import pyarrow as pa

        names = ["row", "query_id", "vec_id", "score"]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")  # ties of scores then fall in the order of ids
            qid, cid, row_no = a["id"].to_numpy(), b["id"].to_numpy(), a["row"].to_numpy()
            got = scores(a["v"].combine_chunks(), b["v"].combine_chunks())
            for i, row in enumerate(got):
                other = np.flatnonzero(cid != qid[i]) if (cid == qid[i]).any() else np.arange(len(cid))
                row = row[other]
                keep = np.arange(len(row))
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    sure = np.flatnonzero(row > least)
                    keep = np.concatenate([sure, np.flatnonzero(row == least)[: k - len(sure)]])
                for to, x in zip(out, (np.full(len(keep), row_no[i]), np.full(len(keep), qid[i]), cid[other[keep]], row[keep]), strict=True):
                    to.append(x)
        return pa.table([np.concatenate(x) for x in out], names=names)

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

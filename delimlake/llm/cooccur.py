"""Which keys occur with several nodes? A compact shuffle of (key, node) postings.

Postings are many (one for each shingle or band) and nearly all keys are alone.
Map tasks therefore sort a batch's postings in numpy and send them as binary
chunks, by ranges of the key; a range holds a bounded number of postings. What
is known to be shared within a batch goes to the result at once and sends its
key a single time, so a key that a third of all rows hold costs its range one
posting a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Bits of the postings that a key range holds: the first while ranges are at most 2^MANY, for then a map task's
#: chunks stay long; beyond that the second, which is what a task can hold.
FINE, COARSE, LEAST, MANY = 19, 22, 8, 16
#: Postings that a map task gathers before it cuts them into chunks: some 100 MB of a worker while it does.
FLUSH = 1 << 20
#: Postings that a map task makes at once, about.
PIECE = 1 << 17
CHUNK = "range long, known boolean, keys binary, nodes binary"
POSTS = "key long, node long"
COUNTS = "node long, n long"
#: Postings in one row of known ones.
KNOWN_ROWS = 1 << 16


def ranges_for(postings: int) -> int:
    """A power of two: key ranges for so many postings."""
    fine, coarse = (int(postings >> bits).bit_length() for bits in (FINE, COARSE))
    return 1 << max(LEAST, min(fine, max(MANY, coarse)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _distinct(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats, by key and then node. Most keys are alone: nodes are sorted in runs of equal keys only."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    same = keys[1:] == keys[:-1]
    if not same.any():
        return keys, nodes
    several = np.zeros(len(keys), bool)
    several[1:] |= same
    several[:-1] |= same
    at = np.flatnonzero(several)
    held = nodes[at]
    nodes[at] = held[np.lexsort((held, keys[at]))]
    keep = np.ones(len(keys), bool)
    keep[1:] = ~same | (nodes[1:] != nodes[:-1])
    return keys[keep], nodes[keep]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.intp)
    return at, np.diff(np.append(at, len(keys)))


def cut_keys(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Keys (uint64, well spread) as they come out: a key's range and its last 32 bits."""
    bits = ranges.bit_length() - 1
    return ((keys >> np.uint64(64 - bits)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def chunks(keys: np.ndarray, nodes: np.ndarray, ranges: int, turn: int = 0) -> list[tuple]:
    """Rows of CHUNK for a batch: keys (uint64, well spread) and nodes (int64, not 0).

    A key is cut to its range and its last 32 bits: a few keys may thereby look
    shared, at the same rate for every size of input."""
    cut, nodes = _distinct(cut_keys(keys, ranges), nodes)
    at, n = _runs(cut)
    many = np.repeat(n > 1, n)
    out = []
    known_keys, known_nodes = cut[many], nodes[many]
    for i in range(0, len(known_keys), KNOWN_ROWS):
        part = slice(i, i + KNOWN_ROWS)
        out.append(((turn + i // KNOWN_ROWS) % ranges, True, known_keys[part].tobytes(), known_nodes[part].tobytes()))
    nodes = np.where(many, 0, nodes)[at]  # node 0: known to be shared
    cut = cut[at]
    which = (cut >> np.uint64(32)).astype(np.int64)
    start, size = _runs(which)
    low = cut.astype(np.uint32)
    for a, k in zip(start.tolist(), size.tolist(), strict=True):
        out.append((int(which[a]), False, low[a : a + k].tobytes(), nodes[a : a + k].tobytes()))
    return out


def chunk_batches(postings, ranges: int):
    """Arrow batches of CHUNK for a task's (keys, nodes)."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())

    def cut(turn, held):
        rows = chunks(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]), ranges, turn)
        arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["range", "known", "keys", "nodes"])

    held, size, turn = [], 0, 0
    for keys, nodes in postings:
        held.append((keys, nodes))
        size += len(keys)
        if size >= FLUSH:
            yield cut(turn, held)
            held, size, turn = [], 0, turn + 1
    if size:
        yield cut(turn, held)


def shared(rows: DataFrame, counts: bool = False) -> DataFrame:
    """rows of CHUNK -> (key, node) postings of keys that several nodes hold, possibly
    repeated; with counts, (node, n): how many such postings a node has in a range."""

    def gather(pdf):
        import pandas as pd

        known = pdf["known"].to_numpy(dtype=bool)
        which = np.uint64(pdf["range"].iloc[0]) << np.uint64(32)
        keys = [np.frombuffer(x, np.uint32).astype(np.uint64) | which for x in pdf["keys"][~known]]
        nodes = [np.frombuffer(x, np.int64) for x in pdf["nodes"][~known]]
        keys, nodes = _distinct(np.concatenate(keys), np.concatenate(nodes)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, n = _runs(keys)
        keep = np.repeat(n > 1, n) & (nodes != 0)
        all_keys = [keys[keep], *(np.frombuffer(x, np.uint64) for x in pdf["keys"][known])]
        all_nodes = [nodes[keep], *(np.frombuffer(x, np.int64) for x in pdf["nodes"][known])]
        keys, nodes = np.concatenate(all_keys), np.concatenate(all_nodes)
        if counts:
            node, n = np.unique(nodes, return_counts=True)
            return pd.DataFrame({"node": node, "n": n})
        return pd.DataFrame({"key": keys.astype(np.int64), "node": nodes})

    return rows.groupBy("range").applyInPandas(gather, COUNTS if counts else POSTS)


#: Bits of a membership bitmap: 16 a node, within these bounds (128 KB to 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bitmap(nodes: DataFrame, node: str = "node") -> np.ndarray:
    """A bitmap of bounded size over hashed nodes (longs): a filter that lets some others pass,
    never loses one. Slices of it are built by tasks. Beyond MOST_BITS / 16 nodes it lets more
    pass; what it filters is joined exactly afterwards."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * nodes.count()).bit_length()))
    slices = 256
    per = bits // slices

    def place(batches):
        import pyarrow as pa

        for b in batches:
            at = mix64(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)
            at = np.unique(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // per), pa.array(at)], names=["slice", "at"])

    def fill(pdf):
        import pandas as pd

        part = np.zeros(per, bool)
        part[pdf["at"].to_numpy() % per] = True
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [np.packbits(part).tobytes()]})

    placed = nodes.select(node).where(f"{node} is not null").mapInArrow(place, "slice long, at long").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.groupBy("slice").applyInPandas(fill, "slice long, part binary").collect():
        out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["part"], np.uint8)
    return out


def in_bitmap(nodes: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = mix64(nodes.astype(np.uint64)) % np.uint64(len(table) * 8)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents longer than a bin are cut into full bins and a rest, so whole texts
are packed. Pieces are dealt over independent packing lots by a hash of the
document; a lot keeps its open bins ordered by their residual room and gives a
piece to the tightest bin that is compatible with it, by successor search over
a bitmap of the residuals in use.

Every bin carries two bitmaps. The source bitmap has the sources that hold their
share of the bin's words, told by counters: a source may hold as much of a bin as
of its lot and ``slack`` percent of the bin more, and gets no further piece there
once it does. A lone source so fills whole bins, and bins mix sources the more the
lot does. The cluster bitmap has one bit for each duplicate cluster that has
several pieces in the lot, and no two pieces of a cluster share a bin. Pieces
come in the order of decreasing size. The search goes on to the next residual
until a bin fits both; only if none does is a bin opened.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delimlake.llm.common import WORD, attach, lower_ascii

#: Words a bin holds.
CAPACITY = 2048
#: Percent of a bin that a source may hold beyond its share of the lot.
SLACK = 50
#: Documents a packing lot has, about; the number of lots grows with the input.
LOT = 20_000


class Bins:
    """Open bins of one lot, ordered by residual room."""

    def __init__(self, capacity: int, bounds: list[int]):
        self.capacity, self.bounds = capacity, bounds
        self.room: list[int] = []  # by bin
        self.held: list[Counter] = []  # words by source
        self.clusters: list[int] = []  # bitmap
        self.full: list[int] = []  # bitmap of the sources that hold their bound
        self.used = 0  # bitmap of the residuals that have bins
        self.at: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> full -> bins
        # source or cluster -> bitmap of residuals whose bins are all closed to it, and the other way round
        self.barred: dict[tuple, int] = {}
        self.bars: dict[int, set[tuple]] = defaultdict(set)

    def put(self, b: int) -> None:
        r = self.room[b]
        if r > 0:
            self.at[r].setdefault(self.full[b], []).append(b)
            self.used |= 1 << r
            for bar in [x for x in self.bars[r] if not (self.full if x[0] else self.clusters)[b] >> x[1] & 1]:
                self.bars[r].discard(bar)
                self.barred[bar] &= ~(1 << r)

    def bar(self, kind: bool, no: int, r: int) -> None:
        self.barred[kind, no] = self.barred.get((kind, no), 0) | 1 << r
        self.bars[r].add((kind, no))

    def successor(self, need: int, source: int, cluster: int) -> int | None:
        """Take out the bin of least residual >= need that is compatible."""
        above = (self.used & ~self.barred.get((True, source), 0) & ~self.barred.get((False, cluster), 0)) >> need
        while above:
            r = need + (above & -above).bit_length() - 1
            closed = held = True
            for full, bins in self.at[r].items():
                closed &= (at_bound := full >> source & 1)
                for i, b in enumerate(bins):
                    if cluster < 0 or not self.clusters[b] >> cluster & 1:
                        held = False
                        if at_bound:
                            break
                        bins.pop(i)
                        if not bins:
                            del self.at[r][full]
                            if not self.at[r]:
                                self.used &= ~(1 << r)
                        return b
            if closed:
                self.bar(True, source, r)
            if held:
                self.bar(False, cluster, r)
            above &= above - 1
        return None

    def open(self) -> int:
        self.room.append(self.capacity)
        self.held.append(Counter())
        for x in (self.clusters, self.full):
            x.append(0)
        return len(self.room) - 1

    def add(self, b: int, size: int, source: int, cluster: int) -> None:
        self.room[b] -= size
        self.held[b][source] += size
        if self.held[b][source] >= self.bounds[source]:
            self.full[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        self.put(b)


def source_bounds(sizes: list[int], sources: list, capacity: int, slack: int) -> dict:
    """source -> words of a bin at which it gets no further piece: its share of all words and slack percent of the bin."""
    words: Counter = Counter()
    for size, source in zip(sizes, sources, strict=True):
        words[source] += size
    total = 100 * max(1, words.total())
    return {s: min(capacity, -(-capacity * (100 * n + slack * (total // 100)) // total)) for s, n in words.items()}


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, slack: int) -> list[int]:
    """The bin of each piece, in the order in which they are packed."""
    bounds = source_bounds(sizes, sources, capacity, slack)
    source_no = {s: i for i, s in enumerate(bounds)}
    cluster_no: dict = {}
    many = {c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1}
    bins = Bins(capacity, list(bounds.values()))
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        source = source_no[s]
        cluster = cluster_no.setdefault(c, len(cluster_no)) if c in many else -1
        b = bins.successor(size, source, cluster)
        if b is None:
            b = bins.open()
        bins.add(b, size, source, cluster)
        out.append(b)
    return out


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of exact copies: hash of the lower-cased words; null and wordless texts have none."""
    words = F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(words) > 0, F.xxhash64(words))


def pack_documents(
    docs: DataFrame,
    size: Column,
    cluster: Column,
    *,
    ident: str = "doc_id",
    source: str = "source",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    lot: int = LOT,
) -> DataFrame:
    """One row a piece: ident, source, cluster, piece (from 0), start and size (in
    words), lot and bin (number within the lot), place (order in the bin).

    Documents without words get one piece of size 0 in no bin (bin and place
    null). Null idents and sources are values like others; a null cluster
    conflicts with nothing. Repeated rows are packed one by one. Texts do not
    travel: join the pieces to the documents to cut them. An empty table gives
    an empty result. A source's words in a bin, its last piece there aside, stay
    below its share of its lot's words and slack percent of the bin. Columns beyond ident and source are read by size and cluster alone.
    """
    if capacity < 1 or slack < 1:
        raise ValueError("capacity and slack must be positive")
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), cluster.cast("long").alias("cluster"), size.cast("long").alias("words"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lots = max(1, -(-docs.count() // lot))
    # By the rows' numbers, not by id, source or cluster: a lot gets its share of hot ones.
    rows = rows.repartition(lots, F.xxhash64("doc_id", F.monotonically_increasing_id()))

    def one_lot(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(batches) if (batches := [x for x in batches if x.num_rows]) else None
        if table is None:
            return
        words = table["words"].to_numpy()
        pieces = np.maximum(1, -(-words // capacity))
        row = np.repeat(np.arange(len(words)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(words[row] - start, capacity)
        none = table["cluster"].is_null().to_numpy()
        cl = pc.fill_null(table["cluster"], 0).to_numpy()
        src = table["source"].to_pylist()
        ident = table["doc_id"].cast(pa.string()).to_pylist()
        rest = np.flatnonzero((length > 0) & (length < capacity)).tolist()

        def decreasing(i):
            r = row[i]
            return (-int(length[i]), bool(none[r]), int(cl[r]), str(src[r]), str(ident[r]))

        todo = sorted(rest, key=decreasing)
        got = pack([int(length[i]) for i in todo], [src[row[i]] for i in todo], [None if none[row[i]] else int(cl[row[i]]) for i in todo], capacity, slack)
        where = np.full(len(row), -1, dtype=np.int64)
        where[todo] = got
        whole = np.flatnonzero(length == capacity)
        where[whole] = max(got, default=-1) + 1 + np.arange(len(whole))
        place = np.zeros(len(row), dtype=np.int64)
        seen: Counter = Counter()
        for i, b in zip(todo, got, strict=True):
            place[i] = seen[b]
            seen[b] += 1
        lot_no = np.full(len(row), TaskContext.get().partitionId(), dtype=np.int32)
        nowhere = where < 0
        kept = table.select(["doc_id", "source", "cluster"]).take(row)
        arrays = [*(c.combine_chunks() for c in kept.columns), pa.array(piece), pa.array(start), pa.array(length), pa.array(lot_no)]
        arrays += [pa.array(where, mask=nowhere), pa.array(place, mask=nowhere)]
        out = pa.Table.from_arrays(arrays, names=["doc_id", "source", "cluster", "piece", "start", "size", "lot", "bin", "place"])
        yield from out.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(one_lot, f"doc_id {kind}, source string, cluster long, piece long, start long, size long, lot int, bin long, place long")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bin_texts(docs: DataFrame, pieces: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(lot, bin, text): the words of a bin's pieces, each piece joined by spaces, pieces by blank lines.

    Idents must be distinct here; bins have bounded size, so a bin's texts meet in one row.
    """
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.col("start").cast("int") + 1, F.col("size").cast("int")), " ")
    rows = attach(pieces.where("bin is not null").withColumnRenamed("doc_id", ident), docs.select(ident, text), [ident], "inner")
    return (
        rows.select("lot", "bin", "place", cut.alias("text"))
        .groupBy("lot", "bin")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    )

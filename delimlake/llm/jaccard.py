"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Every document gets its set's size and a 128-bit signature; equal sets are
   one class.
2. A set of n shingles that has a partner leaves at most u = n - ceil(t n) of
   them unshared. Each class posts its 2 u + 2 smallest hashes; both of a pair
   then hold at least min(u + 1, ceil(t n)) postings of the other, whichever of
   the two posts fewer (see posted). Postings alone tell which classes can have
   partners; the others are done.
3. Classes that remain are ordered by rising document frequency; their prefix
   is what a partner must share. Classes with identical prefix and size
   collapse into one group. Group pairs are filtered by size and position, then
   expanded, and their members verified by exact set intersection.

The result is connectivity, so members already connected are not verified again
(see links); every other candidate pair is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delimlake.llm import cooccur
from delimlake.llm.common import WORD, attach, cut, drop, recut
from delimlake.llm.links import Test, resolve

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Bytes of text that are hashed at once (or one longer text).
BLOCK = 1 << 18
#: Hashes of whole sets that a task holds at once, about: 8 MB.
HELD = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Sets of shingle hashes of texts (UTF-8)."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.pow = self.inv = np.zeros(0, np.uint64)

    def sets(self, offsets: np.ndarray, data: np.ndarray):
        """(i, sorted distinct hashes) for each text i."""
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
            yield from self._block(i, offsets[i : j + 1], data[offsets[i] : offsets[j]])
            i = j

    def _block(self, first: int, offsets: np.ndarray, data: np.ndarray):
        offsets = offsets - offsets[0]
        if len(self.pow) < len(data):
            self.pow, self.inv = _powers(max(len(data), BLOCK), _BASE), _powers(max(len(data), BLOCK), _INVERSE)
        space = _SPACE[data]
        # A word starts after a space or at the start of a text.
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[True], space])[:-1] | edge[:-1] if len(data) else space
        start = np.flatnonzero(~space & before)
        after = np.concatenate([space, [True]])[1:] | edge[1:] if len(data) else space
        end = np.flatnonzero(~space & after) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * self.pow[: len(data)], dtype=np.uint64)])
        word = cooccur.mix64((sums[end] - sums[start]) * self.inv[start]) if len(start) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(start, offsets)
        k = self.words
        if len(word) >= k:
            roll = np.zeros(len(word) - k + 1, np.uint64)
            for j in range(k):
                roll = roll * _STEP + word[j : j + len(roll)]
            roll = cooccur.mix64(roll)
        for d in range(len(offsets) - 1):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= k:
                yield first + d, np.unique(roll[a : b - k + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in word[a:b]:
                        h = h * _STEP + w
                yield first + d, cooccur.mix64(np.array([h], np.uint64))
            else:
                yield first + d, np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    """128 bits of a set; equal sets agree."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(cooccur.mix64(s + np.uint64(0x1234567)), dtype=np.uint64)
        b = np.add.reduce(cooccur.mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
        a, b = cooccur.mix64(np.array([a + np.uint64(len(s)), b], np.uint64))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def node_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "big", signed=True) or 1


def need(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that a partner shares at least."""
    return -(-n * percent // 100)


def posted(n: int, percent: int = PERCENT) -> int:
    """Smallest hashes that a set of n posts: 2 u + 2 with u = n - need(n), or all.

    A pair of m <= n shingles with i in common (t is the threshold) posts the
    common ones up to the lower of its two last posted hashes twice. If that is
    the larger set's, they are 2 u + 2 - (n - i) > u(n) >= u(m). If it is the
    smaller set's, they are 2 u(m) + 2 - (m - i), where u(m) > (1 - t) m - 1 and
    i >= t (m + n) / (1 + t), so more than 2 (1 - t) m - (m - t n) / (1 + t).
    That is at least (1 - t) n >= u(n) for n = m and, if t > 1/2, for n = m / t,
    so, being linear, between them. A set that posts all of its hashes has all
    i >= need(n) of them below the cut; for t <= 1/2 every set does.
    """
    return min(n, 2 * (n - need(n, percent)) + 2)


def _texts(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return offsets, np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)


def document_classes(docs: DataFrame, ident: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, content, n, sig, node): a hash of the text, size, signature of its set and the first 64 bits of that; sig and node are null where it is empty."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for b in batches:
            n, sig = [], []
            for _, s in shingler.sets(*_texts(b.column(2))):
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
            node = [None if x is None else node_of(x) for x in sig]
            arrays = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(node, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "content", "n", "sig", "node"])

    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("doc_id"), F.xxhash64(text), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, content long, n long, sig binary, node long")


def posted_pieces(shingler: Shingler, offsets: np.ndarray, data: np.ndarray, percent: int = PERCENT):
    """(keys, nodes): what the different sets of the texts post, at most PIECE postings and one set's at a time."""

    def piece(keys, nodes):
        # The smallest hashes crowd at the low end: spread them anew.
        return cooccur.mix64(np.concatenate(keys)), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])

    keys, nodes, held, seen = [], [], 0, set()
    for _, s in shingler.sets(offsets, data):
        if not len(s) or (sig := signature(s)) in seen:
            continue
        seen.add(sig)
        # A copy: a view would hold the whole set until the piece is made.
        keys.append(s[: posted(len(s), percent)].copy())
        nodes.append(node_of(sig))
        held += len(keys[-1])
        if held >= cooccur.PIECE:
            yield piece(keys, nodes)
            keys, nodes, held = [], [], 0
    if held:
        yield piece(keys, nodes)


def screen(docs: DataFrame, text: str, ranges: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, n): of the posted hashes of each set, how many other sets post too, at least."""

    def postings(batches):
        shingler = Shingler(words)
        for b in batches:
            yield from posted_pieces(shingler, *_texts(b.column(0)), percent)

    def run(batches):
        yield from cooccur.chunk_batches(postings(batches), ranges)

    chunks = docs.select(F.col(text).cast("string")).mapInArrow(run, cooccur.CHUNK)
    return cooccur.shared(chunks, counts=True).groupBy("node").agg(F.sum("n").alias("n"))


def class_sets(docs: DataFrame, text: str, table: np.ndarray, words: int = WORDS) -> DataFrame:
    """(node, n, data) of the sets that the bitmap lets pass, once each; data: the sorted hashes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        shingler, names = Shingler(words), ["node", "n", "data"]
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        def batch(out):
            refs = np.array(list(out), np.int64)
            keep = refs[cooccur.in_bitmap(refs, shared.value)].tolist()
            rows = [(x, len(out[x]), out[x].astype("<u8").tobytes()) for x in keep]
            for a in range(0, len(rows), 1000):
                arrays = [pa.array(list(x), k) for x, k in zip(zip(*rows[a : a + 1000], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            out: dict[int, np.ndarray] = {}
            held, seen = 0, set()
            for _, s in shingler.sets(*_texts(b.column(0))):
                if len(s) and (node := node_of(signature(s))) not in seen:
                    seen.add(node)
                    out[node] = s
                    held += len(s)
                if held >= HELD:
                    yield from batch(out)
                    out, held = {}, 0
            if out:
                yield from batch(out)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "node long, n long, data binary").dropDuplicates(["node"])


class TokenSets(Test):
    """Sorted 64-bit hashes."""

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<u8")


def tokens(sets: DataFrame) -> DataFrame:
    """(node, n, h): the hashes of each set as rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.column(1).to_numpy()
            data = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(2)]
            # A batch has bounded rows; so have those that it makes.
            for i in range(0, len(data), 64):
                size = [len(x) for x in data[i : i + 64]]
                arrays = [pa.array(np.repeat(b.column(0).to_numpy()[i : i + 64], size)), pa.array(np.repeat(n[i : i + 64], size)), pa.array(np.concatenate(data[i : i + 64]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "h"])

    return sets.select("node", "n", "data").mapInArrow(run, "node long, n long, h long")


def class_labels(docs: DataFrame, classes: DataFrame, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, label) of the classes that link to a class of a smaller node."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    counts = screen(docs, text, cooccur.ranges_for(total // 2), words, percent)
    kept = classes.where("sig is not null").select("node", "n").distinct()
    shared = F.ceil(F.col("n") * percent / 100)
    possible = cut(kept.join(counts.withColumnRenamed("n", "held"), "node").where(F.col("held") >= F.least(F.col("n") - shared + 1, shared)).select("node"))
    if possible.isEmpty():
        return possible.select("node", F.col("node").alias("label"))
    table = cooccur.bitmap(possible)
    sets = recut(class_sets(docs, text, table, words).join(possible, "node", "left_semi"), possible)

    each = tokens(sets)
    df = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = attach(each, df, ["h"], "inner").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    alone = F.col("n") - F.size("o")  # hashes that no other class has come first
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    ranked = ranked.withColumns({"alone": alone, "p": prefix}).where("p > 0")
    ranked = ranked.withColumn("prefix", F.transform(F.slice("o", 1, F.col("p")), lambda x: x["h"]))
    # Identical prefix and size: one group.
    gid = F.xxhash64("n", "alone", "prefix")
    ranked = cut(ranked.select(gid.alias("gid"), "node", "n", "alone", "prefix"))
    groups = ranked.groupBy("gid").agg(*[F.first(c).alias(c) for c in ("n", "alone", "prefix")])
    posts = groups.select("gid", (F.col("n") - F.col("alone")).alias("rest"), F.posexplode("prefix").alias("pos", "key"))
    posts = cut(posts.select("key", "gid", (F.col("rest") - F.col("pos") - 1).alias("rest")))

    def near(l, r):
        n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
        # At the first hash that two sets share, at most it and what follows it in both is shared.
        best = 1 + F.least(F.col(f"{l}.rest"), F.col(f"{r}.rest"))
        return 100 * best >= percent * (n + m - best)

    out = resolve(posts, ranked.select("gid", "node", "n"), sets.select("node", "data"), TokenSets(percent), near)
    drop(ranked, posts, sets)
    return out


def jaccard_components(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer than `words` words is one shingle. Null, empty and blank texts have an
    empty set, link with nothing and are their own component. Null doc_ids link
    like others but never name a component unless there is no other; repeated
    rows are equal documents. Columns beyond ident and text are ignored.
    """
    classes = cut(document_classes(docs, ident, text, words))
    labels = class_labels(docs, classes, text, words, percent)
    first = classes.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("node").alias("node"))
    first = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = first.groupBy("label").agg(F.min("least").alias("component_id"))
    by_sig = attach(first.select("sig", "label"), names, ["label"], "inner").select("sig", "component_id")
    out = attach(classes, by_sig, ["sig"])
    named = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"))


def representatives(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: its smallest ident (null last), then by a hash of the text.

    Documents with an empty set all stay. Of rows that agree in ident and text one stays. idents may be of any
    type that can be ordered and written as text. An empty table gives an empty result.
    """
    classes = cut(document_classes(docs, ident, text, words))
    labels = class_labels(docs, classes, text, words, percent)
    rows = attach(classes, labels, ["node"]).withColumn("__null", F.col("doc_id").isNull())
    at = F.struct("__null", "doc_id", "content")
    best = rows.where("sig is not null").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(at).alias("at"))
    stay = best.select("at.*").union(rows.where("sig is null").select("__null", "doc_id", "content").distinct())
    keys = ["__null", "__id", "__content"]
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stay = stay.select("__null", told("doc_id").alias("__id"), F.col("content").alias("__content"))
    named = docs.withColumns({"__null": F.col(ident).isNull(), "__id": told(ident), "__content": F.xxhash64(text)})
    out = named.join(stay, keys, "left_semi")
    again = classes.where("sig is not null").groupBy("doc_id", "content").count().where("count > 1")
    if not again.isEmpty():
        wordy = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
        out = out.where(wordy).dropDuplicates(keys).union(out.where(~wordy))
    return out.drop(*keys)

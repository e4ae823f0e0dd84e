"""Fuzzy line deduplication by MinHash.

Character-shingle signatures (one permutation, densified) are cut into many
short bands, so that lines over the threshold share a band almost surely. Lines
that share one are verified by the exact Jaccard likeness of their shingle sets;
distributed union-find over the links gives components, and of each component
the first line in the order of documents stays.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delimlake.llm import cooccur
from delimlake.llm.common import attach, cut, drop, recut
from delimlake.llm.links import Test, resolve

#: Characters of a shingle, and likeness (percent) from which lines are duplicates.
CHARS, PERCENT = 8, 75
#: At the threshold a band of 4 matches with 0.32, one of 16 bands with 0.998.
BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: Characters that are hashed at once (or one longer line): what stays in a core's cache.
BLOCK = 1 << 17
#: Bytes of a line, about: only for the number of key ranges.
LINE_BYTES = 128
#: Line break, and white space that does not count at the ends of a line.
BREAK, BLANK = "\n", " \t\r\x0b\x0c"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.random.Generator(np.random.PCG64(5)).permutation(np.arange(1, BINS))


def line_id(line: str) -> bytes:
    return hashlib.md5(line.encode(), usedforsecurity=False).digest()


def refs_of(idents: list[bytes]) -> np.ndarray:
    """The first 64 bits of line ids, never 0."""
    refs = np.frombuffer(b"".join(idents), ">i8")[::2].astype(np.int64)
    return np.where(refs == 0, 1, refs)


def text_lines(text: str | None) -> list[str]:
    """The lines of a text that count: stripped, not blank."""
    return [x for line in (text or "").split(BREAK) if (x := line.strip(BLANK))]


def shingles(line: str) -> np.ndarray:
    """Exact shingle set, as sorted numbers: the 8 characters themselves where each is below U+0100, else a 64-bit
    hash of them. A line shorter than a shingle is one."""
    if len(line) < CHARS:
        return np.frombuffer(line_id(line)[:8], "<u8")
    raw = line.encode("latin-1", "replace")
    grams = np.sort(np.ndarray((len(raw) - CHARS + 1,), "<u8", raw, strides=(1,)) if line.isascii() or max(line) < "\u0100" else _wide(line))
    keep = np.empty(len(grams), bool)
    keep[0] = True
    np.not_equal(grams[1:], grams[:-1], out=keep[1:])
    return grams[keep]


def _wide(line: str) -> np.ndarray:
    code = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(code, CHARS)
    narrow = windows.max(axis=1) < 256
    plain, h = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.uint64)
    for k in range(CHARS):
        plain |= (windows[:, k] & np.uint64(255)) << np.uint64(8 * k)
        h = h * _MULT + windows[:, k]
    return np.where(narrow, plain, cooccur.mix64(h))


class LineSets(Test):
    """Lines as UTF-8."""

    def load(self, data: bytes) -> np.ndarray:
        return shingles(data.decode())


def _blocks(lines: list[str]):
    """(first, end) of runs of lines that are hashed at once."""
    i = 0
    while i < len(lines):
        j, held = i, 0
        while j < len(lines) and (j == i or held + len(lines[j]) <= BLOCK):
            held += len(lines[j])
            j += 1
        yield i, j
        i = j


def _minima(lines: list[str]) -> np.ndarray:
    """lines x BINS least hashes; all-ones where a bin is empty."""
    size = np.array([len(x) for x in lines])
    text = "".join(lines)
    if text.isascii():
        code = np.frombuffer(text.encode(), np.uint8)
    else:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # A byte a character; other characters may share one, which only adds candidates.
        code = (code ^ (code >> 8) * 31 ^ (code >> 16) * 17).astype(np.uint8)
    code = np.concatenate([code, np.zeros(CHARS, np.uint8)])
    x = np.ndarray((len(code) - CHARS,), "<u8", code, strides=(1,)).copy()
    start = np.cumsum(size) - size
    line = np.repeat(np.arange(len(lines)), size)
    counts = np.ones(len(x), bool)  # not the windows that cross the end of a line
    for k in range(1, CHARS):
        counts[(start + size - k)[size >= k]] = False
    if len(short := np.flatnonzero((size > 0) & (size < CHARS))):  # only the line's own characters, and its length
        at, n = start[short], size[short].astype(np.uint64)
        x[at] = (x[at] & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1))) ^ (n << np.uint64(60))
        counts[at] = True
    h = x * _MULT
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    cell = np.where(counts, line * BINS + (h >> np.uint64(58)).astype(np.int64), len(lines) * BINS)
    out = np.full(len(lines) * BINS + 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, cell, h)
    return out[:-1].reshape(len(lines), BINS)


def band_keys(lines: list[str]) -> np.ndarray:
    """lines x BANDS keys; equal keys make a candidate pair."""
    out = []
    for i, j in _blocks(lines):
        least = _minima(lines[i:j])
        full = least.ravel().copy()
        at = np.flatnonzero(full == np.iinfo(np.uint64).max)
        line, bins = at - at % BINS, at % BINS
        for shift in _SHIFTS:  # an empty bin takes the value of another, in a fixed order
            if not at.size:
                break
            value = least.ravel()[line + (bins + shift) % BINS]
            full[at] = value
            left = np.flatnonzero(value == np.iinfo(np.uint64).max)
            at, line, bins = at[left], line[left], bins[left]
        full = full.reshape(least.shape)
        keys = np.full((j - i, BANDS), 0, np.uint64)
        for r in range(ROWS):
            keys = cooccur.mix64(keys * _MULT + full[:, r::ROWS] + np.uint64(r + 1))
        out.append(cooccur.mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT))
    return np.concatenate(out) if out else np.zeros((0, BANDS), np.uint64)


def band_pieces(lines: list[str]):
    """(keys, refs): the bands of lines, at most PIECE at a time."""
    for i in range(0, len(lines), cooccur.PIECE // BANDS):
        part = lines[i : i + cooccur.PIECE // BANDS]
        yield band_keys(part).ravel(), np.repeat(refs_of([line_id(x) for x in part]), BANDS)


def copy_keys(refs: np.ndarray) -> np.ndarray:
    """A key for each line itself, odd; those of bands are made even."""
    return cooccur.mix64(refs.astype(np.uint64)) | np.uint64(1)


def band_posts(docs: DataFrame, text: str, ranges: int) -> DataFrame:
    """(key, ref): bands that several different lines share (even keys), and with ref 0 the lines that stand at several
    places (odd ones)."""

    def postings(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for turn, b in enumerate(batches):
            seen = Counter(x for t in b.column(0).to_pylist() for x in text_lines(t))
            several, at = np.fromiter(seen.values(), np.int64, len(seen)) > 1, 0
            here = np.int64((task << 32) + turn + 1)  # a line that two batches hold, or one holds twice, has two nodes
            for keys, refs in band_pieces(list(seen)):
                yield keys & ~np.uint64(1), refs
                own = copy_keys(refs[::BANDS])
                twice = own[several[at : at + len(own)]]
                at += len(own)
                yield np.concatenate([own, twice]), np.repeat([here, -here], [len(own), len(twice)])

    def run(batches):
        yield from cooccur.chunk_batches(postings(batches), ranges)

    chunks = docs.select(F.col(text).cast("string")).mapInArrow(run, cooccur.CHUNK)
    ref = F.when(F.col("key") % 2 == 0, F.col("node")).otherwise(0)
    return cooccur.shared(chunks).select("key", ref.alias("ref")).distinct()


def one_of_equal(posts: DataFrame) -> DataFrame:
    """posts(key, ref), each once, without the keys that hold the same lines as another: those make no further pair.
    Sets of lines are told by their sizes and 128 bits."""
    sums = [F.bit_xor(F.xxhash64("ref", F.lit(i))).alias(f"h{i}") for i in range(2)]
    sets = posts.groupBy("key").agg(*sums, F.count("*").alias("held")).groupBy("h0", "h1", "held")
    return attach(posts, sets.agg(F.min("key").alias("key")).select("key"), ["key"], "left_semi")


def line_places(docs: DataFrame, ident: str, text: str, table: np.ndarray, ranges: int) -> DataFrame:
    """(none, id, text, lines, pos, node, ref, data, n): the places of the lines that the bitmap lets pass, by their own
    key or one of their bands. node: line id; of the latter lines each batch has once data, the line, and n, the size of
    its shingle set. A row without pos for each text with lines says how many lines count."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.xxhash64(text).alias("text"), F.col(text).cast("string").alias("line"))

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        for b in batches:
            no: dict[str, int] = {}
            row, pos, which = [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for p, line in enumerate((t or "").split(BREAK)):
                    if line := line.strip(BLANK):
                        row.append(i)
                        pos.append(p)
                        which.append(no.setdefault(line, len(no)))
            if not no:
                continue
            lines = list(no)
            ids = [line_id(x) for x in lines]
            refs = refs_of(ids)
            banded = cooccur.in_bitmap(refs, shared.value)
            passed = banded | cooccur.in_bitmap(cooccur.cut_keys(copy_keys(refs), ranges).astype(np.int64), shared.value)
            row, pos, which = np.array(row), np.array(pos, np.int32), np.array(which)
            texts, lines_of = np.unique(row, return_counts=True)
            counted = [b.column(i).take(pa.array(texts)) for i in range(3)] + [pa.array(lines_of.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*counted, *(pa.nulls(len(texts), t) for t in kinds)], names=names)
            at = np.flatnonzero(passed[which])
            if not len(at):
                continue
            row, pos, which = row[at], pos[at], which[at]
            _, first = np.unique(which, return_index=True)
            told = np.zeros(len(at), bool)
            told[first] = banded[which[first]]
            data = [lines[k].encode() if x else None for k, x in zip(which.tolist(), told.tolist(), strict=True)]
            n = [len(shingles(lines[k])) if x else None for k, x in zip(which.tolist(), told.tolist(), strict=True)]
            held = [pos, [ids[k] for k in which.tolist()], refs[which], data, n]
            arrays = [*(b.column(i).take(pa.array(row)) for i in range(3)), pa.nulls(len(at), pa.int32()), *(pa.array(x, t) for x, t in zip(held, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = T.StructType(rows.schema.fields[:3])
    for name, of in (("lines", T.IntegerType()), ("pos", T.IntegerType()), ("node", T.BinaryType()), ("ref", T.LongType()), ("data", T.BinaryType()), ("n", T.LongType())):
        kind = kind.add(name, of)
    names = kind.names
    return rows.mapInArrow(run, kind)


def line_labels(posts: DataFrame, lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label) of lines(node, ref, data, n) that are fuzzy duplicates of others, by bands (key, ref); all but one of
    a component have a row."""
    if posts.isEmpty():
        return posts.select(F.lit(b"").alias("node"), F.lit(b"").alias("label")).limit(0)
    # Within the search a line is a number: short, and never two lines'.
    lines = cut(lines.dropDuplicates(["node"]).withColumn("no", F.monotonically_increasing_id()))
    named = attach(one_of_equal(posts), lines.groupBy("ref").agg(F.collect_list("no").alias("nodes")), ["ref"], "inner")
    named = cut(named.select("key", F.explode("nodes").alias("gid")))
    members = lines.select(F.col("no").alias("gid"), F.col("no").alias("node"), "n").join(named.select("gid").distinct(), "gid", "left_semi")
    found = resolve(named, members, lines.select(F.col("no").alias("node"), "data"), LineSets(percent), few_keys=True)
    names = lines.select("no", "node")
    out = found.join(names.toDF("node", "__line"), "node").select(F.col("__line").alias("node"), "label")
    out = attach(out, names.toDF("label", "__line"), ["label"], "inner").select("node", F.col("__line").alias("label"))
    return recut(out, lines, named)


def gone_lines(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with __n_lines (lines that are not blank) and __gone (the positions that go of them, from 0, among all).

    Of the lines of a component, the first stays: smallest ident (null last),
    then a hash of the text, then the position. Blank lines always stay.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = cooccur.ranges_for(size // LINE_BYTES * BANDS)
    posts = cut(band_posts(docs, text, ranges))
    bands = posts.where("key % 2 = 0")
    # What stands at one place and shares no band is the first of its component: it takes no part.
    table = cooccur.bitmap(posts.select(F.when(F.col("key") % 2 == 0, F.col("ref")).otherwise(F.col("key")).alias("node")))
    places = cut(line_places(docs, ident, text, table, ranges))
    labels = line_labels(bands, places.where("data is not null").select("node", "ref", "data", "n"), percent)
    drop(posts)
    firsts = places.where("pos is not null").groupBy("node").agg(F.min(F.struct("none", "id", "text", "pos")).alias("at"))
    firsts = firsts.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("at").alias("at"))
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = ["__null", "__id", "__text"]
    keyed = lambda rows, *more: rows.select(F.col("none").alias("__null"), told("id").alias("__id"), F.col("text").alias("__text"), *more)
    none = F.lit(None).cast("int")
    each = keyed(places, "lines", "pos", none.alias("stays")).union(keyed(firsts.select("at.*"), none.alias("lines"), none.alias("pos"), F.col("pos").alias("stays")))
    gone = F.array_except(F.collect_list("pos"), F.collect_list("stays"))
    each = each.groupBy(*keys).agg(F.max("lines").alias("__n_lines"), gone.alias("__gone"))
    named = docs.withColumns({"__null": F.col(ident).isNull(), "__id": told(ident), "__text": F.xxhash64(text)})
    out = named.join(each.hint("shuffle_hash"), keys, "left").drop(*keys)  # texts need not be sorted
    return out.withColumns({"__gone": F.coalesce("__gone", F.array().cast("array<int>")), "__n_lines": F.coalesce("__n_lines", F.lit(0))})


def cut_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at those positions."""

    def run(texts, positions):
        import pyarrow as pa

        out = []
        for t, p in zip(texts.to_pylist(), positions.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                continue
            go = set(p)
            out.append(BREAK.join(x for i, x in enumerate(t.split(BREAK)) if i not in go))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, gone)


def dedup_lines(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with text replaced by what stays of it, and n_lines, n_kept (long; lines that are not blank).

    Lines link at a shingle likeness of percent / 100; stripped of white space
    at their ends, equal lines are one. A null text stays null, with no lines.
    Rows that agree in ident and text keep the same lines. Other columns are
    kept; n_lines and n_kept of docs, if any, are replaced.
    """
    rows = gone_lines(docs.drop("n_lines", "n_kept"), ident=ident, text=text, percent=percent)
    rows = rows.withColumns({"n_lines": F.col("__n_lines").cast("long"), "n_kept": (F.col("__n_lines") - F.size("__gone")).cast("long")})
    # Only texts that lose lines travel to Python.
    changed = F.col("n_kept") < F.col("n_lines")
    cut = cut_lines(F.when(changed, F.col(text)), F.when(changed, F.col("__gone")))
    return rows.withColumn(text, F.when(changed, cut).otherwise(F.col(text))).drop("__n_lines", "__gone")

"""Repeated byte strings over a corpus, by Burrows-Wheeler transforms of candidate passages.

Every string of LENGTH bytes is led by its least gram (by hash, leftmost of
equals), which its content alone determines. So equal strings have one leading
gram at one offset, and only strings of one gram can be equal. A passage is a run
of strings of a text that share their leading gram's place.

* A compact shuffle finds the grams that lead passages in several places, and a
  bitmap of bounded size lets a second scan pass over the rest.
* Passages of equal content collapse by partial aggregation; all but the earliest
  repeat it as a whole. A passage that a third of all texts hold costs a task one
  row.
* What is left, different passages of one gram, is dealt to blocks of bounded
  size. A block's Burrows-Wheeler transform is expanded breadth-first: boundaries
  between sorted rotations whose common prefix has 0, 1, 2, ... bytes, each found
  from those one byte shorter by a backward step over the characters. It stops at
  LENGTH; rotations that no boundary parts are equal strings.
* A gram with too many different passages is split: strings led by it at a near
  or at a far offset are keyed by the longer content that they all share. After
  log2(LENGTH) halvings the content is the string itself, which collapses.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delimlake.llm import cooccur
from delimlake.llm.common import attach, cut, drop, recut
from delimlake.llm.cooccur import mix64

#: Bytes of a string that counts as a repeat.
LENGTH = 100
#: Bytes of a text that are hashed at a time, and of a block's passages, about.
SPAN, BLOCK = 1 << 18, 1 << 20
#: Different passages that a key may bring to a block.
MOST = 2048
#: Ends a passage within a block; UTF-8 has no such byte, and strings that hold it are not looked at.
SEPARATOR = 0xFF
_FACTOR = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def gram_size(length: int) -> int:
    """The largest power of two up to a third of length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, size: int, further: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of size bytes, and of those of further bytes, at each place; both are powers of two."""
    h, n, factor, out = data.astype(np.uint64) + np.uint64(1), 1, _FACTOR, {}
    while n <= further:
        out[n] = h
        h = h[:-n] * np.uint64(factor) + h[n:]
        h = h ^ (h >> np.uint64(32))
        n, factor = 2 * n, (factor * factor + 2) % (1 << 64)
    return mix64(out[size]), out[further]


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    m, n = h, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    count = len(h) - width + 1
    return np.minimum(m[:count], m[width - n : width - n + count])


def passages(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, whole: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, at, n, gram, content, lead) of the passages of texts that lie end to end in data: the text's
    number, the place of the first string in data, how many strings, hashes of the leading gram and of the
    passage, and how many bytes after its first string the gram starts; without whole, the last two are left out."""
    size = gram_size(length)
    width, further = length - size + 1, 1 << (length.bit_length() - 1) if whole else size
    for begin in range(0, len(data) - length + 1, SPAN):
        part = data[begin : begin + SPAN + length - 1]
        count = len(part) - length + 1
        h, wide = gram_hashes(part, size, further)
        least = least_of(h, width)
        new = np.ones(count, bool)
        # Another least gram, or the leading one has dropped out.
        new[1:] = (least[1:] != least[:-1]) | (h[: count - 1] == least[:-1])
        starts = ends[(ends > begin) & (ends < begin + count)] - begin
        new[starts] = True
        at = np.flatnonzero(new)
        last = np.append(at[1:], count) - 1
        text = np.searchsorted(ends, begin + at, side="right")
        last = np.minimum(last, ends[text] - length - begin)
        good = last >= at
        at, last, text = at[good], last[good], text[good]
        if not len(at):
            continue
        if not whole:
            yield text, begin + at, last - at + 1, least[at]
            continue
        # A string is told by the hashes of its two ends, a passage by its first and last string.
        first, final = (mix64(wide[x] * np.uint64(_FACTOR) + wide[x + length - further]) for x in (at, last))
        lead = last + np.lib.stride_tricks.sliding_window_view(h, width)[last].argmin(axis=1) - at
        content = mix64(first * np.uint64(_FACTOR) + final + (last - at).astype(np.uint64))
        yield text, begin + at, last - at + 1, least[at], content, lead


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of texts (no nulls), end to end, and where each ends."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs[1:] - offs[0]


def _range_key(gram: np.ndarray, ranges: int) -> np.ndarray:
    """The form in which cooccur hands keys back: their range and their last 32 bits."""
    bits = ranges.bit_length() - 1
    return (((gram >> np.uint64(64 - bits)) << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF))).astype(np.int64)


def shared_grams(docs: DataFrame, ranges: int, length: int = LENGTH) -> DataFrame:
    """(key): grams of docs(row, text) that lead several passages."""

    def postings(batches):
        for b in batches:
            rows = b.column(0).to_numpy().astype(np.uint64)
            data, ends = _texts(b.column(1))
            for text, at, _, gram in passages(data, ends, length, whole=False):
                place = mix64(rows[text] * np.uint64(_FACTOR) + mix64((at - (ends[text] - ends[0])).astype(np.uint64)))
                yield gram, (place | np.uint64(1)).astype(np.int64)

    def run(batches):
        yield from cooccur.chunk_batches(postings(batches), ranges)

    return cooccur.shared(docs.select("row", "text").mapInArrow(run, cooccur.CHUNK)).select("key").distinct()


PASSAGES = "gram long, content long, doc long, row long, at long, n int, lead int"


def shared_passages(docs: DataFrame, table: np.ndarray, ranges: int, length: int = LENGTH) -> DataFrame:
    """PASSAGES of docs(row, doc, text) whose gram the bitmap lets pass; at counts from the text's start."""
    grams = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        names = ["gram", "content", "doc", "row", "at", "n", "lead"]
        for b in batches:
            row, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, ends = _texts(b.column(2))
            begins = np.concatenate([[0], ends[:-1]])
            for text, at, n, gram, content, lead in passages(data, ends, length):
                keep = cooccur.in_bitmap(_range_key(gram, ranges), grams.value)
                text, at, n, gram, content, lead = (x[keep] for x in (text, at, n, gram, content, lead))
                arrays = [gram.astype(np.int64), content.astype(np.int64), doc[text], row[text], at - begins[text], n.astype(np.int32), lead.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return docs.select("row", "doc", "text").mapInArrow(run, PASSAGES)


PLACE = ["doc", "row", "at"]


def collapse(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The earliest of the rows of equal keys, with its columns; and (row, at, n) of the others, which repeat it. rows must be cut."""
    rest = [c for c in rows.columns if c not in (*keys, *PLACE)]
    # What depends on content alone is the same in all of them.
    first = rows.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("held"), *[F.first(c).alias(c) for c in rest])
    first = cut(first)
    again = attach(rows.select(*keys, *PLACE, "n"), first.where("held > 1").select(*keys, "first"), keys, "inner")
    again = again.where(F.struct(*PLACE) != F.col("first")).select("row", "at", "n")
    return first.select(*keys, "first.*", *rest), cut(again)


def rotations(data: np.ndarray, length: int) -> np.ndarray:
    """The starts of data's rotations, sorted by their first length bytes at least.

    Sorted prefixes double from 8 bytes; only rotations that still have equals are
    sorted further. A rank is the first place of a group of equals.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.roll(data, -i).astype(np.uint64)
    order = np.argsort(key)
    slots, sub, rank, done = np.arange(n), order, np.empty(n, np.int64), 8
    key = key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = slots[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        if done >= length:
            return order
        alone = new & np.append(new[1:], True)
        slots, sub = slots[~alone], sub[~alone]
        if not len(sub):
            return order
        key = (rank[sub].astype(np.uint64) << np.uint64(32)) | rank[(sub + done) % n].astype(np.uint64)
        again = np.argsort(key)
        key, sub = key[again], sub[again]
        order[slots] = sub
        done *= 2


def expand(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each sorted rotation, whether it shares less than length bytes with the one before it (the first: true).

    Level k holds the places where the common prefix has k bytes; together with
    those of lower levels they bound the intervals of rotations that share
    k + 1 bytes. A place of level k - 1 is stepped back over the characters of the
    interval before it: the last row of each character and the next row of that
    character, beyond the place, have predecessors that are neighbours and share k
    bytes, unless a lower level has parted them.
    """
    n = len(bwt)
    by_char = np.argsort(bwt, kind="stable")
    back, further = np.empty(n, np.int64), np.full(n, n)
    back[by_char] = np.arange(n)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    further[by_char[:-1][same]] = by_char[1:][same]
    parted = np.zeros(n + 1, bool)
    level = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])  # no common byte
    parted[level] = True
    for _ in range(length - 1):
        bounds = np.flatnonzero(parted)
        before = bounds[np.searchsorted(bounds, level) - 1]
        size = np.maximum(level - before, 0)  # none before place 0
        row = np.arange(int(size.sum())) + np.repeat(before - (np.cumsum(size) - size), size)
        last = further[row] >= np.repeat(level, size)
        place = back[row[last]] + 1
        level = np.unique(place[~parted[place]])
        if not len(level):
            break
        parted[level] = True
    return parted[:n]


def repeats_of(texts: list[bytes], strings: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, at, n): runs of strings that occur before, in an earlier text or earlier in theirs. A text has strings[i] strings, from its start."""
    size = np.array([len(x) + 1 for x in texts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), np.uint8)
    order = rotations(data, length)
    parted = expand(data[order - 1], length)
    good = np.zeros(len(data), bool)
    for s, k in zip(start.tolist(), strings.tolist(), strict=True):
        good[s : s + k] = True
    group = np.flatnonzero(parted)
    earliest = np.minimum.reduceat(np.where(good[order], order, len(data)), group)
    again = good[order] & (order != np.repeat(earliest, np.diff(np.append(group, len(data)))))
    lost = np.sort(order[again])
    run = np.flatnonzero(np.concatenate([[True], lost[1:] != lost[:-1] + 1])) if len(lost) else np.zeros(0, np.intp)
    begin = lost[run]
    text = np.searchsorted(start, begin, side="right") - 1
    return text, begin - start[text], np.diff(np.append(run, len(lost)))


def with_bytes(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """rows (of PASSAGES columns) with the passages' bytes, from docs(row, text)."""
    cols = [c for c in rows.columns if c != "row"]
    each = rows.groupBy("row").agg(F.collect_list(F.struct(*cols)).alias("p")).join(docs.select("row", F.encode("text", "UTF-8").alias("text")), "row")
    each = each.select("row", "text", F.explode("p").alias("p")).select("row", "p.*", "text")
    return each.select("row", *cols, F.substring(F.col("text"), F.col("at").cast("int") + 1, F.col("n") + length - 1).alias("bytes"))


def _in_blocks(rows: DataFrame, blocks: int, length: int) -> DataFrame:
    """(row, at, n): the strings of rows(key, doc, row, at, n, bytes) that repeat an earlier one of their key."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by([(c, "ascending") for c in PLACE])  # earlier places come first
        text, at, n = repeats_of(t["bytes"].to_pylist(), t["n"].to_numpy(), length)
        return pa.table([t["row"].to_numpy()[text], t["at"].to_numpy()[text] + at, n.astype(np.int32)], names=["row", "at", "n"])

    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *PLACE, "n", "bytes")
    return dealt.groupBy("block").applyInArrow(run, "row long, at long, n int")


def halves(rows: DataFrame, length: int) -> DataFrame:
    """rows(key, low, high, ...) as rows of half the range of leads: key tells what all strings of that range share."""
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("lo"), mid.alias("hi")), F.struct(F.lit(1).alias("side"), (mid + 1).alias("lo"), F.col("high").alias("hi")))
    rows = rows.select("*", F.inline(sides)).where("lo <= hi")
    # Strings of a passage have the leads lead, lead - 1, ..., lead - n + 1.
    top, bottom = F.least("lead", "hi"), F.greatest(F.col("lead") - F.col("n") + 1, F.col("lo"))
    rows = rows.withColumns({"top": top, "bottom": bottom}).where("top >= bottom")
    skip = F.col("lead") - F.col("top")
    count = F.col("top") - F.col("bottom") + 1
    core = F.substring(F.col("bytes"), F.col("lead") - F.col("lo") + 1, F.lit(length) - F.col("hi") + F.col("lo"))
    return rows.select(
        F.xxhash64("key", "side", core).alias("key"),
        F.col("lo").alias("low"), F.col("hi").alias("high"), "doc", "row", (F.col("at") + skip).alias("at"), count.alias("n"), F.col("top").alias("lead"),
        F.substring(F.col("bytes"), skip + 1, count + length - 1).alias("bytes"),
    )


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, at, n): all runs of n strings of length bytes of docs(row, doc, text), starting at byte at, that occur earlier: in a smaller doc, then row, then place. docs must be cut."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # A passage has half of the strings that a gram can lead.
    ranges = cooccur.ranges_for(2 * size // (length - gram_size(length)) if length > gram_size(length) else size)
    keys = cut(shared_grams(docs, ranges, length))
    grams = cooccur.bitmap(keys, "key")
    drop(keys)
    rows = cut(shared_passages(docs, grams, ranges, length))
    firsts, again = collapse(rows, ["gram", "content"])
    found = [again]
    several = firsts.groupBy("gram").agg(F.count("*").alias("of_gram")).where("of_gram > 1").select("gram")
    left = with_bytes(attach(firsts, several, ["gram"], "inner"), docs, length).drop("content")
    left = cut(left.withColumnRenamed("gram", "key").withColumns({"low": F.lit(0), "high": F.lit(length - gram_size(length))}))
    while True:
        counts = cut(left.groupBy("key").agg(F.count("*").alias("of_key"), F.sum(F.length("bytes")).alias("weight")).where("of_key > 1"))
        facts = counts.agg(F.coalesce(F.sum(F.when(F.col("of_key") <= MOST, F.col("weight"))), F.lit(0)).alias("size"), F.coalesce(F.max("of_key"), F.lit(0)).alias("top")).first()
        some = attach(left, counts.where(f"of_key <= {MOST}").select("key"), ["key"], "inner")
        found.append(cut(_in_blocks(some, max(1, facts["size"] // BLOCK), length)))
        if facts["top"] <= MOST:
            break
        many = attach(left, counts.where(f"of_key > {MOST}").select("key"), ["key"], "inner")
        many = recut(halves(many, length), left)
        firsts, again = collapse(many, ["key", "bytes"])
        found.append(again)
        left = recut(firsts, many)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The bytes that runs (at, n) of strings cover, as (start, end); those that touch are one."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(runs):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, ident: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept of each row, without its repeated bytes.

    A byte of the UTF-8 text goes where a string of length bytes covers it that
    also starts earlier: in a row of a smaller ident (a whole number), or earlier
    in the row. Strings are judged on the whole input, not on what is left. spans:
    start and end of each maximal removed run, in bytes; kept: the remaining
    bytes, which may cut a character apart (left out where kept is false).

    Null and empty texts have no bytes and keep none; texts of fewer than length
    bytes lose none. Null idents come last; rows of one ident follow each other in
    the order of the table, also equal ones, so of repeated rows the first stays.
    An empty table gives no rows. Other columns are not read, whatever their names. Texts are never
    cut short, however long. Exact but for collisions of hashes of 64 bits: two
    passages count as equal if their grams' and their contents' agree.
    """
    if length < 4:
        raise ValueError("a repeat has 4 bytes at least")
    i = F.col(ident)
    rows = docs.select(i.alias("doc_id"), F.coalesce(i.cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    runs = repeated(rows, length).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * kept
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pair] + [pa.binary()] * kept
        for b in batches:
            out = []
            for t, r in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = t.as_py().encode()
                spans = _spans([(x["at"], x["n"]) for x in r or []], length)
                edges = [0, *(x for s in spans for x in s), len(data)]
                rest = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(rest), len(spans), sha256(rest).hexdigest(), [{"start": s, "end": e} for s, e in spans], rest))
            columns = [pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds[1:], strict=False)] if out else [pa.array([], k) for k in kinds[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * kept
    return rows.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(run, schema)

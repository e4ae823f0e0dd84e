"""Spelling variants: words one edit apart, found among sorted permuterm rotations.

A word marked at its end with a terminator has one rotation for each of its
places. The rotation that starts behind a character has that character last, so
all words that agree but for it share the rotation's other characters as a
prefix; a word without the character has that prefix as a whole rotation. So a
replacement, an insertion or a deletion brings two words into one group: the
rotations of one prefix, with at most one skipped character behind it. Rotations
are sorted by that prefix over the cluster, and tasks scan the groups, which hold
at most one word for each character of the alphabet and one without it.

Words are numbered by falling count, then by code points, before they are
rotated: the best neighbour is the one of the least number, and a rotation
carries a number rather than a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delimlake.llm.common import attach, cut, recut

#: Words of fewer characters or occurrences take no part.
MIN_CHARS, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variants.
TIMES = 2
#: Marks the end of a word; words can't hold it.
END = "$"
#: Prefixes of more characters are sorted by their digest: equal ones stay together.
LONG = 128
#: Different words that a counting task holds, and characters of a text that it looks at together.
HELD, SLICE = 200_000, 1 << 20
_RUN, _GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
_NONE = np.iinfo(np.int64).max


def _lower(text: str) -> str:
    """With A-Z in lower case, and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _slices(text: str):
    """Parts of a text of about SLICE characters, none of which ends within a word."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def slip(head: int, word: str, every: int = 97) -> str:
    """word without one character, where every divides the CRC-32 of its bytes behind those that head stands for."""
    h = zlib.crc32(word.encode(), head)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, change: Callable[[int, str], str] | None = None, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-case runs of letters A-Z and U+00C0 to U+00FF, of MIN_CHARS characters and MIN_COUNT occurrences.

    Only A-Z are lower-cased. change(head, word), if given, says what an
    occurrence counts as; head is the CRC-32 of the document's ident (null:
    nothing) and a colon. Null texts have no words.
    """

    def run(batches):
        import pyarrow as pa

        def told():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                head = zlib.crc32(f"{'' if i is None else i}:".encode())
                for part in _slices(_lower(t.as_py() or "")):
                    words = Counter(_RUN.findall(part))
                    if change is None:
                        held.update({w: n for w, n in words.items() if len(w) >= MIN_CHARS})
                    else:
                        for w, n in words.items():
                            w = change(head, w)
                            if len(w) >= MIN_CHARS:
                                held[w] += n
                    if len(held) >= HELD:
                        yield told()
                        held.clear()
        yield told()

    counts = docs.select(F.col(ident), F.col(text)).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """(no, word, n): no rises with falling n, then with the code points of word."""
    return cut(words.orderBy(F.col("n").desc(), "word").select(F.monotonically_increasing_id().alias("no"), "word", "n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, no, skips, first): each rotation of words(no, word) as a key, and each without its last character.

    skips: a character is left out; first: none of those before it in the word
    equals it without another between, so that leaving out one of a double
    letter counts once.
    """
    w, i = F.col("word"), F.col("i")
    marked = F.when(F.contains(w, F.lit(END)), F.raise_error(F.lit(f"a word holds the terminator {END}"))).otherwise(w)
    rows = words.select("no", marked.alias("word"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    whole = F.concat(F.substr(w, i + 1), F.lit(END), F.substr(w, F.lit(1), i))
    skip = F.concat(F.substr(w, i + 2), F.lit(END), F.substr(w, F.lit(1), i))
    here = F.substr(w, i + 1, F.lit(1))
    none = F.lit(False)
    first = (i == 0) | (F.substr(w, i, F.lit(1)) != here)
    both = F.array(F.struct(whole.alias("key"), none.alias("skips"), none.alias("first")), F.struct(F.when(here != "", skip).alias("key"), (~none).alias("skips"), first.alias("first")))
    rows = rows.select("no", F.inline(both)).where("key is not null")
    return rows.select(F.when(F.length("key") > LONG, F.md5("key")).otherwise(F.col("key")).alias("key"), "no", "skips", "first")


def _groups(batches):
    """Batches cut so that no key crosses from one to the next."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
        if not t.num_rows:
            continue
        # The last key may go on.
        end = t.num_rows - int(pc.sum(pc.equal(t["key"], t["key"][-1])).as_py())
        kept = t.slice(end)
        if end:
            yield t.slice(0, end)
    if kept is not None:
        yield kept


def _neighbours(batches):
    """(no, near, best) of each rotation with neighbours in its group: how many, and the least number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for t in _groups(batches):
        keys = t["key"].combine_chunks()
        starts = np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
        at, g = np.flatnonzero(starts), np.cumsum(starts) - 1
        no = t["no"].to_numpy()
        skips, first = (t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("skips", "first"))
        least = lambda keep: np.minimum.reduceat(np.where(keep, no, _NONE), at)  # noqa: B023, E731
        whole, lone, many, one = least(~skips), least(skips & first), np.add.reduceat(skips.astype(np.int64), at), least(skips)
        two = least(skips & (no != one[g]))
        # Replaced: the others that skip a character. Inserted or deleted: the whole rotation, for one of a run of equal characters.
        has = (whole < _NONE)[g] & first
        near = np.where(skips, many[g] - 1 + has, np.add.reduceat((skips & first).astype(np.int64), at)[g])
        best = np.where(skips, np.minimum(np.where(no == one[g], two[g], one[g]), np.where(has, whole[g], _NONE)), lone[g])
        keep = near > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (no, near, best)], names=["no", "near", "best"])


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, n, form, form_n, n_near, root of words(word, n), each word once.

    Near words differ by exactly one inserted, deleted or replaced character;
    n_near counts them. form: the near word of the largest n, if that is at least
    TIMES the word's own; ties go to the smallest in code-point order. root: the
    last word when forms are followed, the word itself without a form. Rows whose
    word or n is null are left out; further columns are not read. An empty table
    gives none. A word of L characters has 2L + 1 rotations of L characters, and
    those of over LONG characters are sorted by digests. Words must not hold END,
    which is refused loudly.
    """
    words = numbered(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    sorted_ = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    near = sorted_.mapInArrow(_neighbours, "no long, near long, best long")
    near = cut(near.groupBy("no").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    forms = words.select(F.col("no").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = words.join(near, "no", "left").join(forms, "best", "left")
    good = F.col("form_n") >= TIMES * F.col("n")
    told = told.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    told = recut(told, near)
    # Each word with a form points to it, then to where that points: a form has twice the count, so rounds are few.
    ups = cut(told.where("best is not null").select("no", F.col("best").alias("to"), F.lit(True).alias("moved")))
    while not ups.where("moved").isEmpty():
        further = ups.select(F.col("no").alias("to"), F.col("to").alias("next"))
        ups = recut(attach(ups, further, ["to"]).select("no", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), ups)
    roots = attach(ups, words.select(F.col("no").alias("to"), F.col("word").alias("root")), ["to"]).select("no", "root")
    return told.join(roots, "no", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))

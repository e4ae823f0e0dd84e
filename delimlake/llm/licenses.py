"""Licence scans: fuzzy search for short notices.

A text is reduced to its words, joined by single spaces. A notice of n
characters may be off by up to k edits: it is split into k + 1 pieces, of which
one at least must occur unchanged (pigeonhole), so an Aho-Corasick pass over
all pieces finds every place worth a look. There the regex library's
bounded-error matching verifies the edits and reports the span.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices (words in lower case) and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("proprietary and confidential", "proprietary"),
    ("all rights reserved", "reserved"),
]
#: A notice may be off by one edit for so many characters.
CHARS_PER_EDIT = 12

# Bytes of words: 0-9, a-z and all of non-ASCII characters; A-Z count as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,edits:int,text:string>>"
)


def edits_of(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def seeds_of(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): the notice in as many pieces as it may have edits, and one."""
    parts = edits_of(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        for i, (notice, _) in enumerate(notices):
            for at, piece in seeds_of(notice):
                self.seeds.add_word(piece, [*self.seeds.get(piece, []), (i, at, len(piece))])
        self.seeds.make_automaton()
        self.exact = [regex.compile(rf"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_of(n)}}}") for n, _ in notices]
        self.phrases = [(p, re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in PHRASES.items()]

    def fuzzy(self, words: str):
        """(notice, start, end, edits) in words, a text of words joined by single spaces."""
        windows: dict[int, list[list[int]]] = {}
        for end, found in self.seeds.iter(words):
            for i, at, size in found:
                n, k = len(self.notices[i][0]), edits_of(self.notices[i][0])
                start = end - size + 1 - at
                a, b = max(0, start - k), start + n + k
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(a, mine[-1][0]), max(b, mine[-1][1])
                else:
                    mine.append([a, b])
        for i, mine in windows.items():
            for a, b in mine:
                for m in self.exact[i].finditer(words, a, min(b, len(words))):
                    yield i, m.start(), m.end(), sum(m.fuzzy_counts)

    def scan(self, text: bytes) -> tuple:
        flat = text.translate(_TABLE)
        parts = flat.split()
        words = b" ".join(parts).decode()
        hits = [(m.start(), label) for phrase, pattern, label in self.phrases if phrase in words for m in pattern.finditer(words)]
        found = sorted(set(self.fuzzy(words)), key=lambda x: (x[1], x[2], x[0]))
        if not hits and not found:
            return len(parts), 0, None, None, "", "", 0.0, []
        # Where each word starts in words, by one pass.
        starts = np.cumsum([0, *(len(p.decode()) + 1 for p in parts[:-1])])
        at = np.searchsorted(starts, [a for a, _ in hits]).tolist()
        spans, score = [], 1.0 if hits else 0.0
        if found:
            original = text.decode()
            ends = np.array([(start, end) for _, start, end, _ in found])
            first, last = self._originals(text, words, starts, ends[:, 0]), self._originals(text, words, starts, ends[:, 1] - 1) + 1
            for (i, _, _, edits), a, b in zip(found, first.tolist(), last.tolist(), strict=True):
                notice, label = self.notices[i]
                spans.append({"label": label, "start": a, "end": b, "edits": edits, "text": original[a:b]})
                score = max(score, 1.0 - edits / len(notice))
        base = sorted({label for _, label in hits})
        every = sorted({*base, *(x["label"] for x in spans)})
        return len(parts), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, spans

    @staticmethod
    def _originals(text: bytes, words: str, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code points of text that stand at `at` in words; of a space, what follows it."""
        data = np.frombuffer(text, np.uint8)
        wordy = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
        # Word starts in the text, as code points: bytes that don't continue a character, counted up to there.
        begins = np.flatnonzero(wordy & ~np.concatenate([[False], wordy[:-1]]))
        points = np.cumsum((data & 0xC0) != 0x80)[begins] - 1
        at = at + np.array([words[i] == " " for i in at.tolist()], dtype=np.int64)
        word = np.searchsorted(starts, at, side="right") - 1
        return points[word] + at - starts[word]


def scan_licenses(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """One row a document: ident, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (label, start, end in code points, edits, text).

    Base places are those of PHRASES; the fuzzy notices add their labels and
    spans. score is 1 with a base place, else 1 - edits / length of the best
    notice, 0 without any. Null and empty texts have no words: counts 0, first
    and last word null, labels ''. Repeated rows give repeated rows, an empty
    table none. The time for a text grows with its length and its number of
    matches, so a very long text full of notices takes no more than as many
    short ones. Other columns of docs are not read.
    """
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner(notices)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            got = [scanner.scan(x.as_py() or b"") for x in batch.column(1)]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)] if got else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    return rows.mapInArrow(scan, f"doc_id {kind}, {RESULT}")

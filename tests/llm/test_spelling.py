"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from delimlake.llm import spelling

COLUMNS = ["word", "form", "form_n", "n", "n_near", "root"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    around = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, xs in around.items():
        if xs:
            best = min(xs, key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), counts[form[w]] if w in form else None, n, len(around[w]), root(w)) for w, n in counts.items()), key=str)


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_variants(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed == 2:
        monkeypatch.setattr(spelling, "LONG", 4)  # most keys are digests
    # A small alphabet, double letters and accents: dense neighbourhoods and many ties.
    counts = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9))): rng.choice([1, 2, 3, 5, 6, 12, 40, 400]) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3 + seed)
    assert told(spelling.spelling_variants(df)) == brute(counts)


def test_chain_of_forms_and_hot_group(spark):
    chain = {"x" * 5 + "y" * i: 2 ** (12 - i) for i in range(12)}  # eleven steps to the root
    letters = {f"ab{chr(0xE0 + i)}cd": 100 + i for i in range(24)} | {"abcd": 1000}
    counts = chain | letters
    df = spark.createDataFrame([*counts.items(), (None, 5), ("null", None)], "word string, n long")
    got = told(spelling.spelling_variants(df))
    assert got == brute(counts)
    assert {r[5] for r in got if r[0] in chain} == {"xxxxx"}


def test_long_words_and_clashing_columns(spark):
    long = "ab" * 400
    counts = {long: 50, long + "c": 4, "c" + long[1:]: 3, long[:-1]: 9, "other": 3}
    df = spark.createDataFrame([(w, n, 1, "k", True) for w, n in counts.items()], "word string, n long, no int, key string, skips boolean")
    assert told(spelling.spelling_variants(df)) == brute(counts)
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_terminator_is_refused(spark):
    with pytest.raises(Exception, match="terminator"):
        spelling.spelling_variants(spark.createDataFrame([("a$b", 3)], "word string, n long")).collect()


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 40)
    monkeypatch.setattr(spelling, "SLICE", 50)
    rng = random.Random(5)
    words = ["Word", "ÉTUDE", "étude", "straße", "naïve-ness", "ABCDE", "übergröße", "x1yyyyy", "Ωmegaω", "letter", "Letters"]
    texts = [(i if i % 7 else None, rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randrange(90)))) for i in range(300)]
    texts += [(7, None), (8, ""), (9, "z" * 200 + " " + "z" * 200 + "!" + "Z" * 200), (9, "z" * 200)]
    docs = spark.createDataFrame([(t, i, 1) for i, t in texts], "text string, doc_id long, word int")
    plain, slipped = Counter(), Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            plain[w] += 1
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            slipped[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    for change, want in ((None, plain), (spelling.slip, slipped)):
        want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
        assert {r["word"]: r["n"] for r in spelling.count_words(docs, change).collect()} == want
    assert any(len(w) < len("Letters") and plain[w] < slipped[w] for w in slipped)
    assert spelling.count_words(docs.limit(0)).collect() == []

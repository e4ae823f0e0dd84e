"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from delimlake.llm import repeats

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def starts_again(texts, length):
    seen, out = set(), []
    for t in texts:
        again = []
        for a in range(len(t) - length + 1):
            if t[a : a + length] in seen:
                again.append(a)
            seen.add(t[a : a + length])
        out.append(again)
    return out


def brute(rows, length):
    """Of rows in the order of their ids."""
    texts, out = [(t or "").encode() for _, t in rows], []
    for (i, _), t, again in zip(rows, texts, starts_again(texts, length)):
        gone = np.zeros(len(t) + 1, bool)
        for a in again:
            gone[a : a + length] = True
        rest = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), len(t) - len(rest), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def told(spark, rows, length, schema="doc_id long, text string", parts=3):
    got = repeats.remove_repeats(spark.createDataFrame(rows, schema).coalesce(parts), length).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    return sorted((tuple(bytes(r[c]) if c == "kept" else r[c] for c in COLUMNS) for r in got), key=str)


def some_texts(rng, n):
    """Pieces of common passages, copies with edits, periodic and short texts."""
    common = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(5, 260))) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            text = "".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))
        elif kind < 0.6 and out:
            text = list(rng.choice(out))
            for _ in range(rng.randrange(3)):
                if text:
                    text[rng.randrange(len(text))] = "Z"
            text = "".join(text)
        elif kind < 0.8:
            text = rng.choice(["a", "ab", "\x00", "abc" * 9 + "d", "é"]) * rng.randrange(150)
        else:
            text = "".join(rng.choice("xy") for _ in range(rng.randrange(40)))
        out.append(text)
    return out


@pytest.mark.parametrize("length", [4, 5, 23, 100])
def test_block_against_brute_force(length):
    for seed in range(12):
        texts = [t.encode() for t in some_texts(random.Random(seed), 15)]
        got = [[] for _ in texts]
        for i, a, n in zip(*(x.tolist() for x in repeats.repeats_of(texts, np.array([max(0, len(t) - length + 1) for t in texts]), length))):
            got[i] += range(a, a + n)
        assert got == starts_again(texts, length)


@pytest.mark.parametrize("seed", range(2))
def test_passages_lead_equal_strings_alike(seed, monkeypatch):
    monkeypatch.setattr(repeats, "SPAN", 64)
    texts = [t.encode() for t in some_texts(random.Random(seed), 40)]
    data, ends, length = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), 23
    led, met = {}, set()
    for text, at, n, gram, _, lead in repeats.passages(data, ends, length):
        for i, a, k, g, l in zip(text.tolist(), at.tolist(), n.tolist(), gram.tolist(), lead.tolist()):
            for o in range(k):
                string = data[a + o : a + o + length].tobytes()
                assert a + o + length <= ends[i] and led.setdefault(string, (g, l - o)) == (g, l - o) and 0 <= l - o <= length - repeats.gram_size(length)
                met.add(a + o)
    begins = np.concatenate([[0], ends[:-1]])
    assert met == {a for b, e in zip(begins.tolist(), ends.tolist()) for a in range(b, e - length + 1)}


@pytest.mark.parametrize("most", [2048, 3])
def test_against_brute_force(spark, monkeypatch, most):
    """With few passages a key, keys are split down to the strings themselves."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "BLOCK", 1 << 12)
    rng = random.Random(most)
    rows = list(enumerate(some_texts(rng, 120)))
    # One passage between different neighbours in a third of all rows, and one text many times.
    hot = "".join(rng.choice("abcdefghijkl ") for _ in range(130))
    rows += [(200 + i, "".join(rng.choice("mnopqrst") for _ in range(80)) + hot + "".join(rng.choice("uvwxyz") for _ in range(80))) for i in range(40)]
    rows += [(300 + i, "the same text " * 12) for i in range(20)]
    want = brute(rows, 100)
    assert sum(r[2] > 0 for r in want) > 60
    rng.shuffle(rows)
    assert told(spark, rows, 100) == want


def test_nulls_ties_repeated_rows_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPAN", 1000)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000)) + text
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (5, text[:99]), (6, text), (6, "x" + text), (None, text), (None, "only here " * 3)]
    want = brute(rows, 100)
    assert told(spark, rows, 100, parts=1) == want
    assert [r[2] for r in want if r[0] == 4] == [0, len(long)]  # of repeated rows the first stays


def test_empty_table_and_clashing_columns(spark):
    assert told(spark, [], 100) == []
    rows = [(i, "a common text of some length", 1, 2, "k", b"b", 3) for i in range(3)]
    schema = "doc_id long, text string, row int, at int, key string, bytes binary, n int"
    assert told(spark, rows, 12, schema) == brute([r[:2] for r in rows], 12)
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 3)

"""Jaccard join, line dedup, fingerprints, components and links against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from delimlake.llm import common, cooccur, jaccard, linededup, links, spotsigs
from delimlake.llm.common import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


@pytest.mark.parametrize("few", [0, common.FEW_EDGES])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, x) for x in range(501, 560)]
    want = classes(600, pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got}) == len({x for a, b in pairs if a != b for x in (a, b)})
    assert all(want[r["node"]] == r["label"] for r in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", " \t\n", "one two", "One  TWO\n", "one two three", "a b c d e"]
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(rng.randrange(3, 90))) + (" " + passage if rng.random() < 0.6 else ""))
    for _ in range(160):
        w = rng.choice([t for t in texts if t and t.strip()]).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        texts.append(rng.choice([" ", "\n", "  "]).join(w[: len(w) - rng.randrange(3)]))
    texts += [passage] * 12
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    rng = random.Random(seed)
    texts = corpus(rng)
    ids = [rng.choice([i, i, i, None]) if i > 6 else i for i in range(len(texts))]
    ids[-1] = ids[-2] = 900  # a repeated row
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(pairs) > 100
    of = classes(len(texts), pairs)
    least: dict = {}
    for i, c in zip(ids, of, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted((str(i), len(s), str(least[c])) for i, s, c in zip(ids, sets, of, strict=True))
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n int, sig binary")
    if seed == 2:  # rounds, small blocks and small chunks of text give the same
        monkeypatch.setattr(links, "GOES_ON", 10**9)
        monkeypatch.setattr(links, "BLOCK", 3)
        monkeypatch.setattr(links, "HOT", 0)
        monkeypatch.setattr(jaccard, "BLOCK", 300)
    got = jaccard.jaccard_components(docs.repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    kept = jaccard.representatives(docs).collect()
    assert len(kept) == len({c for c, s in zip(of, sets, strict=True) if s}) + sum(not s for s in sets)
    assert set(kept[0].asDict()) == {"doc_id", "text", "n", "sig"}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_short_texts_of_unequal_length(spark):
    """7 words and the same with one more at either end: 3 shingles of 4, which link."""
    texts = []
    for i in range(40):
        seven = [f"w{i}x{j}" for j in range(7)]
        texts += [seven, [*seven, f"end{i}"]] if i % 2 else [[f"start{i}", *seven], seven]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(w) - 4, i - i % 2) for i, w in enumerate(texts)}
    assert jaccard.representatives(docs).count() == 40


@pytest.mark.parametrize("percent", [40, 50, 51, 60, 75, 90, 100])
def test_screen_bound(percent):
    """However the hashes of a pair interleave, both sets hold as many postings of the other as the screen asks for."""
    for m in range(1, 60):
        for n in range(m, m * 100 // percent + 1):
            i = -(-percent * (m + n) // (100 + percent))
            if i > m:
                continue
            asked = max(min(x - jaccard.need(x, percent) + 1, jaccard.need(x, percent)) for x in (m, n))
            # The unshared hashes of either set come first, up to what it posts.
            for x, y in ((m, n), (n, m)):
                alone = min(x - i, jaccard.posted(x, percent))
                common = min(i, jaccard.posted(x, percent) - alone, jaccard.posted(y, percent))
                assert common >= asked, (m, n, i)


@pytest.mark.parametrize(("hot", "few_keys"), [(links.HOT, False), (0, False), (5, True)])
def test_resolve_hot_key(spark, monkeypatch, hot, few_keys):
    """Chains of sets under one key that all nodes share, in small blocks, by brute force."""
    monkeypatch.setattr(links, "HOT", hot)
    monkeypatch.setattr(links, "ROUNDS", 1)  # the last step finds what one round of small blocks left
    monkeypatch.setattr(links, "BLOCK", 3)
    monkeypatch.setattr(links, "BATCH", 500)
    rng = random.Random(8)
    sets, base = [], 0
    for _ in range(40):
        base += 1000
        now = list(range(base, base + 24))
        for _ in range(rng.randrange(1, 9)):
            sets.append(sorted(now))
            now = now[2:] + [max(now) + 1, max(now) + 2]
    link = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]
    want = classes(len(sets), link)
    rows = [(i, bytearray(np.array(s, "<u8").tobytes()), len(s)) for i, s in enumerate(sets)]
    payload = spark.createDataFrame(rows, "node long, data binary, n long")
    members = payload.select(F.col("node").alias("gid"), "node", "n")
    posts = members.select(F.lit(1).cast("long").alias("key"), "gid").union(members.select(F.col("gid") % 7 + 2, "gid"))
    got = {r["node"]: r["label"] for r in links.resolve(posts, members, payload, jaccard.TokenSets(75), few_keys=few_keys).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == want
    assert len(set(want)) < len(sets)


@pytest.mark.parametrize("percent", [40, 50, 75, 90, 100])
def test_parts_meet(percent):
    """Two sets that just link share one of their first tokens, in whatever order tokens are put."""
    rng = np.random.default_rng(percent)
    for m in [*range(1, 40), 97, 300, 1777]:
        for n in {m, m * 100 // percent, (m + m * 100 // percent) // 2}:
            i = -(-percent * (m + n) // (100 + percent))
            if i > m:
                continue
            pool = rng.integers(0, 2**63, m + n - i, dtype=np.uint64)
            s, t = np.sort(pool[:m]), np.sort(np.concatenate([pool[:i], pool[m:]]))
            assert jaccard.TokenSets(percent)(s, t)
            salt = rng.integers(0, 2**62)
            for x, y in ((s, t), (t, s)):
                guest = {c: sorted(tokens.tolist(), key=lambda v: v ^ int(salt))[:least] for _, c, least, tokens in links.parts(x, percent)}
                ((c, own),) = [(c, sorted(tokens.tolist(), key=lambda v: v ^ int(salt))[:least]) for mine, c, least, tokens in links.parts(y, percent) if mine]
                assert set(guest[c]) & set(own)
    assert list(links.parts(np.zeros(0, np.uint64), percent)) == []


def test_hot_key_candidates(spark, monkeypatch):
    """Nodes that share one element and no more do not meet, however many; those alike in part are few pairs."""
    rng = np.random.default_rng(9)
    met = []
    for n in (1000, 4000):
        sets = [np.sort(np.append(rng.integers(10, 2**63, 19, dtype=np.uint64), np.uint64(7))) for _ in range(n)]
        payload = spark.createDataFrame([(i, bytearray(s.tobytes()), 20) for i, s in enumerate(sets)], "node long, data binary, n long")
        bits = payload.sparkSession.createDataFrame([(i, i, 20, links.sketch(s).tolist()) for i, s in enumerate(sets)], "node long, label long, n long, bits array<bigint>")
        monkeypatch.setattr(links, "overlap", lambda *a: F.lit(True))
        met.append(links._met(links._parted(payload, jaccard.TokenSets(75)), bits, 75).count())
    assert met[0] <= 1000 and met[1] <= 4000


def test_sketches_bound():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 5000):
        s, t = (np.unique(rng.integers(0, 3 * n, n).astype(np.uint64)) for _ in range(2))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(links.sketch(s).view(np.uint64).tolist(), links.sketch(t).view(np.uint64).tolist(), strict=True))
        assert apart <= len(set(s.tolist()) ^ set(t.tolist()))


def test_long_text_and_batches():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 3, 5, 40000, 7, 1)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = dict(jaccard.Shingler().sets(offsets, np.frombuffer(b"".join(data), np.uint8)))
    assert [len(got[i]) for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]
    assert jaccard.signature(got[1]) != jaccard.signature(got[2])


def test_shared_keys(spark):
    rng = np.random.default_rng(2)
    keys = cooccur.mix64(rng.integers(0, 500, 2000).astype(np.uint64))
    nodes = rng.integers(1, 400, 2000)
    rows = [r for i in range(4) for r in cooccur.chunks(keys[i::4], nodes[i::4], 8, i)]
    got = {tuple(r) for r in cooccur.shared(spark.createDataFrame(rows, cooccur.CHUNK)).collect()}
    holders: dict = {}
    for k, n in zip(keys.tolist(), nodes.tolist(), strict=True):
        holders.setdefault(k, set()).add(n)
    cut = lambda k: (k >> 61 << 32) | (k & 0xFFFFFFFF)
    assert got == {(cut(k), n) for k, s in holders.items() if len(s) > 1 for n in s}
    table = cooccur.bitmap(spark.createDataFrame([(int(n),) for n in nodes[:50]] + [(-5,)], "node long"))
    assert cooccur.in_bitmap(np.append(nodes[:50], -5), table).all()
    assert cooccur.in_bitmap(np.arange(10_000, 20_000), table).sum() < 10


def grams(line, k=linededup.CHARS):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def test_line_shingles():
    """Numbers agree where and only where the characters do, however wide they are."""
    rng = random.Random(6)
    lines = ["".join(rng.choice(rng.choice(["ab", "aé", "ab\u0142", "a\U0001d4b3"])) for _ in range(n)) for n in [*range(1, 12)] * 6 + [200] * 6]
    lines += ["a", "a\x00", "abcdefg", "abcdefg\x00", "abcdefgh"]
    seen: dict = {}
    for x in lines:
        got, want = linededup.shingles(x), grams(x)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        seen[x] = (set(got.tolist()), want)
    for (s, a), (t, b) in combinations(seen.values(), 2):
        assert len(s & t) == len(a & b)


def lines_corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    pool = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(60)] + ["}", "yes", "é", "𝒳" * 9]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.4 and len(line) > 20:
                p = rng.randrange(len(line))
                line = line[:p] + rng.choice("xyz") + line[p + 1 :]
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "\r"]))
            if rng.random() < 0.2:
                lines.append("")
        docs.append((i if i % 17 else None, "\n".join(lines), i))
    return [*docs, (500, None, 1), (501, "", 2), (502, "\n\n", 3), docs[5], (7, docs[8][1], 4)]


@pytest.mark.parametrize("hot", [links.HOT, 0])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(links, "HOT", hot)
    if not hot:  # what one round of small blocks leaves is met at parts
        monkeypatch.setattr(links, "ROUNDS", 1)
        monkeypatch.setattr(links, "BLOCK", 2)
    rows = lines_corpus(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_kept int")
    lines = sorted({x for _, t, _ in rows for x in linededup.text_lines(t)})
    sets = [grams(x) for x in lines]
    near = [(a, b) for a, b in combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(near) > 100
    of = dict(zip(lines, classes(len(lines), near), strict=True))
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    first: dict = {}
    for i, t, _ in rows:
        for p, x in enumerate((t or "").split("\n")):
            if s := x.strip(linededup.BLANK):
                at = (i is None, i or 0, hashes[t], p)
                first[of[s]] = min(first.get(of[s], at), at)
    want = []
    for i, t, _ in rows:
        key = (i is None, i or 0, hashes[t])
        stay = [x for p, x in enumerate((t or "").split("\n")) if not (s := x.strip(linededup.BLANK)) or first[of[s]] == (*key, p)]
        n = len(linededup.text_lines(t))
        want.append((str(i), n, n - (len((t or "").split("\n")) - len(stay)), None if t is None else "\n".join(stay)))
    got = linededup.dedup_lines(docs.repartition(3))
    assert sorted(got.columns) == ["doc_id", "n_kept", "n_lines", "text"]
    mine = sorted(((str(r["doc_id"]), r["n_lines"], r["n_kept"], r["text"]) for r in got.collect()), key=str)
    assert mine == sorted(want, key=str)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "long"), [(16, 71), (71, 400), (400, 1500)])
def test_band_recall(short, long):
    """Of pairs just over the threshold, lines of fewer shingles than bins among them."""
    rng = random.Random(short)
    pairs = []
    while len(pairs) < 300:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(short, long)))
        b = list(a)
        for _ in range(rng.randrange(1, 2 + len(a) // 40)):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b) + "".join(rng.choice("abc") for _ in range(rng.randrange(len(b) // 5 + 1)))
        s, t = grams(a), grams(b)
        if 0.75 <= len(s & t) / len(s | t) < 0.80:
            pairs.append((a, b))
    ka, kb = linededup.band_keys([a for a, _ in pairs]), linededup.band_keys([b for _, b in pairs])
    assert (ka == kb).any(axis=1).mean() >= 0.99
    other = linededup.band_keys(["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(500)])
    assert len(np.unique(other)) == other.size


def spot_set(text):
    w = re.sub(spotsigs.GAPS, " ", (text or "").lower()).strip().split(" ")
    any_ = set(spotsigs.ANCHORS)
    out = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in any_][: spotsigs.CHAIN]
        if x in any_ and len(chain) == spotsigs.CHAIN:
            out.add(hashlib.md5(f"{x} {' '.join(chain)} ".encode()).hexdigest()[:16])
    return out or {hashlib.md5(f" {' '.join(w)} ".encode()).hexdigest()[:16]}


def test_spots_pass_over_any_number_of_common_words(spark):
    """All common words of a long run have spots; a long run costs linear time."""
    texts = ["the " + "of " * 9 + "alpha beta gamma", "of " * 50 + "a1 " + "the " * 200_000 + "a2 and", "the " * 500_000 + "u v " * 100_000, "the of", "the a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] for r in spotsigs.with_fingerprint(docs, "text", "fp").collect()}
    assert len(spot_set(texts[0])) == 2
    for i in (0, 3, 4):
        assert got[i] == f"{len(spot_set(texts[i]))}:{','.join(sorted(spot_set(texts[i])))}"
    assert got[1] == "1:" + hashlib.md5(b"of a1 a2 ").hexdigest()[:16]
    assert got[2] == "1:" + hashlib.md5(b"the u v ").hexdigest()[:16]


def test_fingerprints(spark):
    rng = random.Random(11)
    vocab = ["the", "of", "der", "la", "alpha", "beta", "Gamma", "été", "x1", "the", "and"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + [None, "", "the " * 40 + "a b", "𝒳é" * 3, "the " + "of " * 20 + "alpha " + "and " * 30 + "beta x", "same of all things", "same of all things"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, ["c"] * len(ids), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda x: -x[0])
    jac = lambda a, b: len(a & b) / len(a | b)
    for buckets in (1, 7):
        got = {r["doc_id"]: r for r in spotsigs.fingerprint_documents(docs, buckets=buckets).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            r, a, e, n = got[i], spot_set(t), spot_set(edited), spot_set(nxt)
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == f"{len(a)}:{','.join(sorted(a))}" and r["edited_fingerprint"] == f"{len(e)}:{','.join(sorted(e))}"
            assert np.isclose(r["near_edited"], jac(a, e)) and np.isclose(r["near_next"], jac(a, n))
    assert spotsigs.fingerprint_documents(docs.limit(0)).count() == 0
    one = spotsigs.fingerprint_documents(docs.where("text = 'x1'").union(docs.limit(1))).collect()
    assert one and one[0]["near_next"] >= 0


def test_next_of_ties(spark):
    """Null, frequent and repeated doc_ids, whatever the ranges."""
    rng = random.Random(13)
    rows = [(rng.choice([None, None, 7, 7, 7, *range(20)]), f"text {rng.randrange(60)}") for _ in range(150)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for buckets in (1, 5, 40):
        got = spotsigs.fingerprint_documents(docs, buckets=buckets).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_next_of_copies(spark):
    """Many copies of texts without a doc_id, or of one, are dealt over parts; each copy but the last is followed by a copy."""
    rows = [(None, "all of one text")] * 3000 + [(None, ""), (None, "b c"), (None, None)] + [(5, "the five of them")] * 2500 + [(i, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = spotsigs.fingerprint_documents(docs, buckets=20).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_spot_pairs(spark):
    rng = random.Random(12)
    sets = [{f"{rng.randrange(90):08x}" for _ in range(rng.randrange(1, 30))} for _ in range(40)]
    for s in list(sets):
        t = set(s)
        if len(t) > 4:
            t.discard(min(t))
            sets.append(t)
    sets += sets[:3]
    prints = spark.createDataFrame([(i, f"{len(s)}:{','.join(sorted(s))}") for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    found, pairs = spotsigs.near_duplicates(prints)
    first: dict = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    assert found.count() == len(first)
    want = {(min(a, b), max(a, b)) for (s, a), (t, b) in combinations(first.items(), 2) if len(s & t) / len(s | t) >= 0.75}
    got = pairs.collect()
    assert want and {(min(r["doc_a"], r["doc_b"]), max(r["doc_a"], r["doc_b"])) for r in got} == want
    assert len(got) == len(want) and all(r["a"] < r["b"] for r in got)


def test_spot_pairs_of_repeated_and_null_doc_ids(spark):
    """Classes are told by fingerprint: different texts of one doc_id stay apart."""
    a = [f"{i:016x}" for i in range(20)]
    b = [f"{i:016x}" for i in range(100, 120)]
    rows = [(1, a), (1, b), (2, a[:19]), (None, b[:19]), (4, a)]
    prints = spark.createDataFrame([(i, f"{len(s)}:{','.join(s)}") for i, s in rows] + [(9, None)], "doc_id long, fingerprint string")
    found, pairs = spotsigs.near_duplicates(prints)
    assert sorted((r["doc_id"] or 0, r["members"]) for r in found.collect()) == [(0, 1), (1, 1), (1, 2), (2, 1)]
    assert sorted((sorted((r["doc_a"] or 0, r["doc_b"] or 0)), r["likeness"]) for r in pairs.collect()) == [([0, 1], 0.95), ([1, 2], 0.95)]
    classes, none = spotsigs.near_duplicates(prints.limit(0))
    assert classes.count() == 0 and none.count() == 0


def test_postings_come_in_bounded_pieces():
    """However many texts or lines a batch has, a task holds few postings at once, and none is lost."""
    texts = [" ".join(f"w{d}x{i}" for i in range(3000)).encode() for d in range(300)]
    offsets, data = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    pieces = list(jaccard.posted_pieces(jaccard.Shingler(), offsets, data))
    most = jaccard.posted(2996)
    assert sum(len(k) for k, _ in pieces) == 300 * most
    assert max(len(k) for k, _ in pieces) < cooccur.PIECE + most
    lines = [f"line {i} of some more words" for i in range(20_000)]
    pieces = list(linededup.band_pieces(lines))
    assert max(len(k) for k, _ in pieces) <= cooccur.PIECE
    assert (np.concatenate([k for k, _ in pieces]) == linededup.band_keys(lines).ravel()).all()


@pytest.mark.parametrize("share", [2**62, 500, 1])
def test_distinct_postings(share):
    rng = np.random.default_rng(3)
    keys, nodes = rng.integers(0, share, 5000).astype(np.uint64), rng.integers(-50, 50, 5000)
    got = list(zip(*(x.tolist() for x in cooccur._distinct(keys, nodes)), strict=True))
    assert got == sorted(set(zip(keys.tolist(), nodes.tolist(), strict=True)))


def test_band_keys_are_those_of_bins_filled_one_by_one():
    """Keys are those of bins filled one by one, and no more is hashed at once than a cache holds."""
    lines = [f"{i:09d}" for i in range(9000)] + ["ab", "", "x" * 300, "é" * 30, "some words of a longer line " * 20]
    empty = np.iinfo(np.uint64).max
    few = lines[-8:]
    full = linededup._minima(few)
    for row, least in zip(full, full.copy(), strict=True):
        for b in np.flatnonzero(least == empty):
            row[b] = next((x for s in linededup._SHIFTS if (x := least[(b + s) % linededup.BINS]) != empty), empty)
    keys = np.zeros((len(few), linededup.BANDS), np.uint64)
    for r in range(linededup.ROWS):
        keys = cooccur.mix64(keys * linededup._MULT + full[:, r :: linededup.ROWS] + np.uint64(r + 1))
    want = cooccur.mix64(keys + np.arange(1, linededup.BANDS + 1, dtype=np.uint64) * linededup._MULT)
    assert np.array_equal(linededup.band_keys(few), want)
    lines = lines * 9
    assert max(sum(map(len, lines[i:j])) for i, j in linededup._blocks(lines)) <= 1 << 17


def test_lines_that_share_many_bands_meet_at_one_key(spark, monkeypatch):
    """Keys that hold the same lines as another do not go through the search; what meets still does."""
    rng = random.Random(12)
    whole = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(150)).strip() for _ in range(40)]
    docs = spark.createDataFrame([(i, f"{x}\n{x[:-1]}!\n{x[:-2]}?!") for i, x in enumerate(whole)], "doc_id long, text string")
    seen = []

    def resolve(posts, *a, **b):
        seen.append([(r["key"], r["gid"]) for r in posts.collect()])
        return links.resolve(posts, *a, **b)

    monkeypatch.setattr(linededup, "resolve", resolve)
    assert [r["text"] for r in linededup.dedup_lines(docs).orderBy("doc_id").collect()] == whole
    held: dict = {}
    for key, node in seen[0]:
        held.setdefault(key, set()).add(node)
    assert len({frozenset(x) for x in held.values()}) == len(held)


def test_lines_that_stand_once_take_no_part(spark, monkeypatch):
    """Copies are found within a text, a batch, and across batches and tasks; other lines are not carried along."""
    rng = random.Random(13)
    line = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    own, text, both, every = [line() for _ in range(60)], line(), line(), line()
    rows = [(i, "\n".join([own[i], *[text, f" {text}"] * (i == 7), *[both] * (i in (3, 55)), "", *[every] * (i % 9 == 0)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held, cut = [], linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df: held.append(cut(df)) or held[-1])
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = linededup.dedup_lines(docs).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for r in got:
        i = r["doc_id"]
        assert r["text"] == "\n".join([own[i], *[text] * (i == 7), *[both] * (i == 3), "", *[every] * (i == 0)])
        assert r["n_lines"] == 1 + 2 * (i == 7) + (i in (3, 55)) + (i % 9 == 0)
        assert r["n_kept"] == 1 + (i == 7) + (i == 3) + (i == 0)
    places = next(x for x in held if "pos" in x.columns).where("pos is not null")
    assert places.count() == 2 + 2 + 7

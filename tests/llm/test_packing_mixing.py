"""Best-fit packing and source mixing."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from delimlake.llm import mixing, packing


def test_successor_search_is_tightest():
    """Each piece, by brute force over all open bins: the least room that fits and is compatible, else a new bin."""
    rng = random.Random(4)
    conflicts = 0
    for turn in range(120):
        n = rng.randrange(1, 90)
        clusters = [rng.choice([None, None, 1, 2, 3, 4]) for _ in range(n)]
        sources = [rng.choice("aab" if turn % 4 else "a") for _ in range(n)]
        sizes = [rng.randrange(1, 20) for _ in range(n)]
        if turn % 2:
            sizes.sort(reverse=True)
        slack = rng.choice([5, 20, 40])
        got = packing.pack(sizes, sources, clusters, 20, slack)
        words = Counter()
        for size, source in zip(sizes, sources, strict=True):
            words[source] += size
        most = {s: 20 * (words[s] / words.total() + slack / 100) - 1e-9 for s in words}
        bins: dict = {}
        for size, source, cluster, b in zip(sizes, sources, clusters, got, strict=True):
            fit = {k for k, x in bins.items() if x["room"] >= size and x["sources"][source] < most[source]}
            ok = {k for k in fit if cluster is None or cluster not in bins[k]["clusters"]}
            conflicts += bool(fit) and min(bins[k]["room"] for k in fit) < min((bins[k]["room"] for k in ok), default=99)
            if ok:
                assert b in ok and bins[b]["room"] == min(bins[k]["room"] for k in ok)
            else:
                assert b not in bins
                bins[b] = {"room": 20, "sources": Counter(), "clusters": set()}
            bins[b]["room"] -= size
            bins[b]["sources"][source] += size
            bins[b]["clusters"].add(cluster)
    assert conflicts > 50  # the cluster bitmap decides


def test_bins_are_full():
    """Over 90 % for any number of sources, evenly and unevenly drawn, short and long pieces, also where sources differ in length."""
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8):
        for low, high in ((5, 60), (20, 300)):
            for draw in (lambda: rng.randrange(k), lambda: min(rng.randrange(k), rng.randrange(k))):
                rows = sorted(((rng.randrange(low, high), draw()) for _ in range(4000)), reverse=True)
                apart = sorted(((low + (high - low) * s // k + rng.randrange(1 + (high - low) // k), s) for _, s in rows), reverse=True)
                for x in (rows, apart):
                    sizes, sources = [n for n, _ in x], [s for _, s in x]
                    got = packing.pack(sizes, sources, [None] * len(x), 2048, packing.SLACK)
                    assert sum(sizes) > (0.9 if x is apart else 0.95) * 2048 * len(set(got))
    copies = packing.pack([7] * 4000, ["a"] * 2000 + ["b"] * 2000, ["c"] * 4000, 2048, packing.SLACK)
    assert len(set(copies)) == 4000


def test_one_document_of_another_source_changes_little():
    """The bound moves with the shares; there is no switch."""
    rng = random.Random(2)
    sizes = sorted((rng.randrange(5, 60) for _ in range(3000)), reverse=True)
    lone, one_other = (len(set(packing.pack(sizes, ["a"] * 2999 + [last], [None] * 3000, 2048, packing.SLACK))) for last in "ab")
    assert abs(lone - one_other) <= 1


DOCS = [(i, " ".join(["w"] * (i * 7 % 45)), "src0" if i % 3 else f"src{i % 5}", "x") for i in range(120)]
DOCS += [(200 + i, "same words here", "src9", "y") for i in range(30)] + [(None, "a b", None, None), (7, None, "s", "z"), (8, DOCS[8][1], DOCS[8][2], "again"), (300, "w " * 95, "src1", "long")]


def test_pack_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, bin string")
    kept = packing.pack_documents(docs, packing.size_of(F.col("text")), packing.text_cluster(F.col("text")), capacity=40, slack=20, lot=50)
    rows = kept.collect()
    want = Counter()
    for i, t, _, _ in DOCS:
        n = len((t or "").split())
        want[(i, n)] += 1
    whole = defaultdict(int)
    for r in rows:
        whole[r["doc_id"]] += r["size"]
        assert (r["bin"] is None) == (r["size"] == 0)
    assert sum(whole.values()) == sum(n * k for (_, n), k in want.items())
    bins = defaultdict(list)
    for r in rows:
        if r["bin"] is not None:
            bins[r["lot"], r["bin"]].append(r)
    shares: dict = {}
    for lot in {r["lot"] for r in rows}:
        pieces = [r for r in rows if r["lot"] == lot and 0 < r["size"] < 40]
        words = Counter()
        for r in pieces:
            words[r["source"]] += r["size"]
        shares |= {(lot, s): n / words.total() for s, n in words.items()}
    for (lot, _), items in bins.items():
        assert sum(r["size"] for r in items) <= 40
        for s in {r["source"] for r in items if r["size"] < 40}:
            own = [r["size"] for r in sorted(items, key=lambda r: r["place"]) if r["source"] == s]
            assert sum(own[:-1]) < 40 * (shares[lot, s] + 0.2) + 1e-9
        cl = [r["cluster"] for r in items if r["cluster"] is not None]
        assert len(cl) == len(set(cl))
        assert sorted(r["place"] for r in items) == list(range(len(items)))
    assert [(r["piece"], r["start"], r["size"]) for r in sorted((r for r in rows if r["doc_id"] == 300), key=lambda r: r["piece"])] == [(0, 0, 40), (1, 40, 40), (2, 80, 15)]
    assert packing.pack_documents(docs.limit(0), F.lit(1), F.lit(None)).count() == 0
    one = docs.where("doc_id = 300")
    texts = packing.bin_texts(one, packing.pack_documents(one, packing.size_of(F.col("text")), F.lit(None), capacity=40)).collect()
    assert sorted(len(r["text"].split()) for r in texts) == [15, 40, 40]


def waterfill(sizes, weights, cap):
    total, free, out = sum(sizes.values()), dict(weights), {}
    while True:
        share = (total - sum(out.values())) / max(1, sum(free.values()))
        over = [s for s in free if share * weights[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weights[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            del free[s]


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, "src0" if i % 2 else f"src{i % 7}", rng.randrange(1, 60), 5.0) for i in range(2000)] + [(3000, None, 40, 1.0), (3001, "", 3, 1.0), (None, "src1", 20, 1.0), (3002, "src1", 0, 1.0), (3003, "none", 0, 1.0), (5, "src0", 10, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long, target double").withColumn("q", F.when(F.col("doc_id") % 3 == 0, 2.0).when(F.col("doc_id") % 3 == 1, 0.0))
    got = mixing.mix(docs, F.col("words"), F.col("q"), buckets=16)
    assert got.columns == ["doc_id", "source", "words", "q", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == len(rows)
    sizes, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in out:
        s = r["source"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = waterfill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(7), F.col("words"), F.col("q"), buckets=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0), F.col("words"), F.col("q")).count() == 0


def test_ending_bucket_is_cut_again(spark):
    """However many cuts find the last key, the mix is the same: nearly all keys of a source in one bucket, ties, null ids."""
    rows = [(i, "low", 1 + i % 7, 1e-4) for i in range(1500)] + [(None, "low", 3, 1e-4)] * 200 + [(i, "high", 5, 50.0) for i in range(400)] + [(9, "none", 0, 1.0), (10, None, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long, q double")
    want = sorted(map(str, mixing.mix(docs, F.col("words"), F.col("q"), most=10**6).collect()))
    assert len(want) == len(rows)
    for buckets, most in ((16, 20), (2, 1), (1024, 1)):
        got = mixing.mix(docs.repartition(5), F.col("words"), F.col("q"), buckets=buckets, most=most)
        assert sorted(map(str, got.collect())) == want


def test_copies_and_ties(spark):
    """Rows of one key are taken together; where the budget ends among them, each gives the same share."""
    rows = [(None, "a b c d", "hot", i) for i in range(300)] + [(i, "x " * (1 + i % 9), "hot", 0) for i in range(100)] + [(1, "x x", "cold", 0), (2, None, "cold", 0), (3, "", None, 0), (3, "y z", None, 0), (3, "y z", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes = mixing.with_quality(mixing.source_sizes(docs), spark.createDataFrame([(5, 1)], "doc_id long, quality int"))
    got = mixing.mix(sizes, F.col("words"), F.col("__weight"), weights=(1, 3, 2)).cache()
    total, target, most = Counter(), {}, Counter()
    for r in got.collect():
        total[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] += 1
        assert r["taken"] <= 3 * r["size"]
    assert len(target) == 3 and sum(most.values()) == len(rows)
    assert abs(total["hot"] - target["hot"]) <= 300 + 5  # each tied row may lose a part of a word
    out = mixing.copies(docs, got)
    assert out.columns == docs.columns
    want = {(r["__id"], r["source"], r["__text"]): r["taken"] // r["size"] for r in got.collect() if r["size"]}
    named = docs.withColumns(mixing._row_keys("doc_id", "source", "text")).collect()
    assert out.count() == sum(want.get((r["__id"], r["source"], r["__text"]), 0) for r in named)


def test_quality_weighs(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("words")).union(spark.range(4000, 4001).select("id", F.lit("t"), F.lit(200_000)))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = mixing.mix(mixing.with_quality(docs, labels), F.col("words"), F.col("__weight"), weights=(1, 9), cap=3)
    share = got.where("source = 's' and taken % 20 = 0").groupBy(F.col("doc_id") % 2).count().collect()
    n = {r[0]: r["count"] for r in share}
    few = got.where("source = 's'").groupBy(F.col("doc_id") % 2).agg(F.sum("taken")).collect()
    few = {r[0]: r[1] for r in few}
    assert few[1] > 1.1 * few[0], (few, n)

"""Exact top-k and language identification."""

import random

import numpy as np
from pyspark.sql import functions as F

from delimlake.llm import langid, topk


def test_top_k_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(12)], 1) for i in range(400)]
    rows += [(500 + i, [0.5] * 12, 1) for i in range(30)]
    rows += [(600, None, 1), (601, [None] * 12, 1), (602, [float("nan")] * 12, 1), (603, [float("inf")] * 12, 1), (604, [0.25] * 5, 1), (None, [1.0] * 12, 1), (500, [0.5] * 12, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(table.select("vec_id", topk.quantize(F.col("embedding")).alias("vector")), F.col("vec_id") % 50 == 0)
    ok = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    mine = sorted(tuple(r) for r in got.collect())
    assert mine == sorted(want)  # the repeated query row has ranks of its own
    assert [x[1] for x in mine if x[0] == 0] == list(range(1, 11))
    assert topk.top_k(table.limit(0).select("vec_id", topk.quantize(F.col("embedding")).alias("vector")), F.lit(True)).count() == 0


def test_blocks_are_even_over_many_partitions(spark):
    """65,536 rows of 400 partitions fill 1,024 blocks of about 64."""
    rows = spark.range(0, 65_536, numPartitions=400).select(F.monotonically_increasing_id().alias("row"))
    sizes = [r["count"] for r in rows.groupBy(topk.block_of(1024)).count().collect()]
    assert len(sizes) == 1024 and max(sizes) < 128


def test_few_candidates(spark):
    table = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(table, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2)]


WORDS = {"en": "the and of that with which this from".split(), "de": "der und das nicht mit für auf ist".split(), "fr": "les des que dans pour une est pas".split()}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 7))) if rng.random() < 0.4 else rng.choice(WORDS[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, text_of(rng, lang, rng.randrange(8, 120)), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(900))]
    odd = [(5000, None, "en"), (5001, "", "en"), (5002, "12 34 !!", "en"), (5003, text_of(rng, "de", 9000), None), (None, text_of(rng, "fr", 50), "fr")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = docs.select("doc_id", "lang", langid.held_out(F.col("doc_id")).alias("held"), langid.predict(F.col("text"), model).alias("p")).collect()
    test = [r for r in got if r["held"] and r["doc_id"] < 5000]
    assert len(test) > 150 and np.mean([r["p"]["lang"] == r["lang"] for r in test]) > 0.95
    by = {r["doc_id"]: r for r in got}
    for i in (5000, 5001, 5002):
        assert tuple(by[i]["p"]) == ("und", 0.0)
    assert by[5003]["p"]["lang"] == "de" and by[None]["p"]["lang"] == "fr" and by[None]["held"] is False
    assert all(0 <= r["p"]["score"] <= 1 for r in got)
    # Labels of held-out rows have no influence, and neither has the layout.
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).repartition(5)
    same = langid.fit(other)
    assert same.languages == model.languages and np.allclose(same.out, model.out)


def test_network_is_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, langid.WINDOW), dtype=np.uint8)
    model = langid.train(x, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"])
    emb, tops = model.embed[x], []
    for w, f in zip(langid.WIDTHS, model.filters, strict=True):
        resp = np.stack([np.einsum("nwe,wef->nf", emb[:, t : t + w], f) for t in range(langid.WINDOW - w + 1)], axis=1)
        tops.append(resp.max(axis=1))
    logits = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0) @ model.out + model.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    net = langid.Network(model)
    assert np.allclose(net.probabilities(x), p, atol=1e-4)
    offsets = np.array([0, 0, langid.WINDOW, 3 * langid.WINDOW - 5])
    got = net.documents(offsets, x.ravel())
    assert np.allclose(got[1], p[0], atol=1e-4) and got[0].sum() == 0 and np.isclose(got[2].sum(), 1, atol=1e-4)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model is None
    assert tuple(docs.select(langid.predict(F.col("text"), model).alias("p")).first()["p"]) == ("und", 0.0)
    assert docs.limit(0).select(langid.predict(F.col("text"), langid.Model([], *[None] * 5) if False else None).alias("p")).count() == 0

"""The pipeline over small tables, stage by stage against brute force, and the registered queries."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations, groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    words = {"en": "the and of that with which this from".split(), "fr": "les des que dans pour une est pas".split()}

    def line(lang):
        return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(3, 8))) if rng.random() < 0.5 else rng.choice(words[lang]) for _ in range(rng.randrange(8, 20)))

    rows = []
    for i in range(240):
        lang = rng.choice(["en", "fr"])
        rows.append((i, "\n".join(line(lang) for _ in range(rng.randrange(1, 6))), lang, f"s{i % 3}"))
    rows += [(1000 + i, rows[i][1], rows[i][2], "s0") for i in range(40)]
    rows += [(1100 + i, rows[i][1].replace(" the ", " that ", 1) + " end", rows[i][2], "s0") for i in range(40)]
    rows += [(2000, None, "en", "s1"), (2001, "", None, None), (2002, "123 456", "en", "s1"), (None, line("en"), None, None)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    table = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], KIND)
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert sorted(out.columns) == sorted(docs.columns)
            out = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = out
        docs = out
    ids = {r["doc_id"] for r in kept["language_id"].collect()}
    assert set(range(240)) <= ids and not ids & {2000, 2001, 2002}
    lines = kept["line_dedup"].collect()
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    every = [x for r in lines for x in r["text"].split("\n") if x.strip()]
    assert len(every) == len(set(every))
    assert set(range(240)) <= {r["doc_id"] for r in lines} and not {r["doc_id"] for r in lines} & set(range(1000, 1040))
    assert set(range(240)) <= {r["doc_id"] for r in kept["ngram_jaccard"].collect()}
    mixed = kept["source_mixing"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) > 1
    packed = kept["best_fit_packing"]
    words = sum(len(r["text"].split()) for r in kept["source_mixing"].collect())
    assert packed.agg(F.sum("size")).first()[0] == words


def groups_of(n, linked):
    """The least index that each of n indices reaches by links."""
    of = list(range(n))
    for a, b in combinations(range(n), 2):
        if linked(a, b):
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
    return of


def alike(s, t):
    return bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)


def order_of(row, hashes):
    return (row["doc_id"] is None, row["doc_id"] or 0, hashes[row["text"]])


def expect_language_id(spark, docs, rows, folder):
    from delimlake.llm import langid

    network = langid.Network(langid.fit(docs))
    for r in rows:
        data = (r["text"] or "").encode()
        if any(c.isalpha() for c in r["text"] or ""):
            p = network.documents(np.array([0, len(data)]), np.frombuffer(data, np.uint8))[0]
            if p.max() >= langid.MIN_SCORE:
                yield r


def expect_line_dedup(spark, docs, rows, folder):
    from delimlake.llm.linededup import BLANK, CHARS

    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    lines = sorted({x for r in rows for line in (r["text"] or "").split("\n") if (x := line.strip(BLANK))})
    sets = [{x[i : i + CHARS] for i in range(max(1, len(x) - CHARS + 1))} for x in lines]
    of = dict(zip(lines, groups_of(len(lines), lambda a, b: alike(sets[a], sets[b])), strict=True))
    first: dict = {}
    for r in rows:
        for i, line in enumerate((r["text"] or "").split("\n")):
            if x := line.strip(BLANK):
                first[of[x]] = min(first.get(of[x], (True, math.inf, 0, 0)), (*order_of(r, hashes), i))
    for r in rows:
        lines = (r["text"] or "").split("\n")
        stays = [not (x := line.strip(BLANK)) or first[of[x]] == (*order_of(r, hashes), i) for i, line in enumerate(lines)]
        text = None if r["text"] is None else "\n".join(x for x, y in zip(lines, stays, strict=True) if y)
        if not any(x.strip(BLANK) for x in lines) or any(y and x.strip(BLANK) for x, y in zip(lines, stays, strict=True)):
            yield {**r, "text": text, "n_chars": None if text is None else len(text)}


def expect_ngram_jaccard(spark, docs, rows, folder):
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = groups_of(len(rows), lambda a, b: alike(sets[a], sets[b]))
    best: dict = {}
    for i, r in enumerate(rows):
        if not sets[i]:
            yield r
        elif of[i] not in best or order_of(r, hashes) < order_of(rows[best[of[i]]], hashes):
            best[of[i]] = i
    yield from (rows[i] for i in best.values())


def expect_source_mixing(spark, docs, rows, folder):
    from delimlake.llm import mixing

    marks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        marks[r["doc_id"]].append({1: 2.0, 0: 0.5}.get(r["quality"], 1.0))
    sizes = [len((r["text"] or "").split()) for r in rows]
    per = Counter()
    for r, n in zip(rows, sizes, strict=True):
        per[r["source"]] += n
    names = sorted(x for x in per if x is not None) + [None] * (None in per)
    free, target = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}, {}
    while True:
        share = (sum(per.values()) - sum(target.values())) / max(1, sum(free.values()))
        over = [x for x in free if share * free[x] > mixing.CAP * per[x]]
        if not over:
            break
        for x in over:
            target[x] = mixing.CAP * per[x]
            del free[x]
    target |= {x: share * w for x, w in free.items()}
    for name in names:
        drawn = []
        for r, n in zip(rows, sizes, strict=True):
            if r["source"] == name and n:
                told = "" if r["doc_id"] is None else str(r["doc_id"])
                u = (int(hashlib.md5(f"mix\x1f{told}\x1f{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                marked = marks.get(r["doc_id"], [1.0])
                drawn.append((-math.log(u) / (sum(marked) / len(marked)), n, r))
        epochs = int(target[name] // per[name]) if per[name] else 0
        rest, before = target[name] - epochs * per[name], 0
        for _, n, r in sorted(drawn, key=lambda x: x[0]):
            yield from [r] * (epochs + (before + n / 2 <= rest))
            before += n


def expect_best_fit_packing(spark, docs, rows, folder, got):
    """Pieces cover the words; in each lot, in decreasing size, each piece has the tightest compatible bin."""
    from delimlake.llm import packing

    want = Counter()
    for r in rows:
        n = len((r["text"] or "").split())
        want.update((r["doc_id"], i, min(packing.CAPACITY, n - i * packing.CAPACITY)) for i in range(max(1, -(-n // packing.CAPACITY))))
    assert Counter((r["doc_id"], r["piece"], r["size"]) for r in got) == want
    for lot in {r["lot"] for r in got}:
        bins: dict = {}
        pieces = [r for r in got if r["lot"] == lot and 0 < r["size"] < packing.CAPACITY]
        words = Counter()
        for r in pieces:
            words[r["source"]] += r["size"]
        most = {s: packing.CAPACITY * (n / words.total() + packing.SLACK / 100) - 1e-9 for s, n in words.items()}
        copies = Counter(r["cluster"] for r in pieces)
        order = lambda r: (-r["size"], r["cluster"] is None, r["cluster"] or 0, str(r["source"]), str(r["doc_id"]))
        for _, equal in groupby(sorted(pieces, key=order), key=order):
            todo = list(equal)  # copies come in any order
            while todo:
                r = todo[0]
                c = r["cluster"] if copies[r["cluster"]] > 1 else None
                ok = [k for k, x in bins.items() if x[0] >= r["size"] and x[1][r["source"]] < most[r["source"]] and (c is None or c not in x[2])]
                least = min((bins[k][0] for k in ok), default=None)
                fit = [r for r in todo if (r["bin"] in ok and bins[r["bin"]][0] == least if ok else r["bin"] not in bins)]
                assert fit
                room, sources, clusters = bins.setdefault(fit[0]["bin"], [packing.CAPACITY, Counter(), set()])
                bins[fit[0]["bin"]][0] = room - r["size"]
                sources[r["source"]] += r["size"]
                clusters.add(c)
                todo.remove(fit[0])


def test_stages_by_brute_force(spark, folder):
    """Every stage over what it was given, with extra columns whose names the operators use themselves."""
    extra = {"size": F.lit(-1), "node": F.lit(b"n"), "label": F.lit("l"), "bin": F.lit(-2), "key": F.lit("k"), "words": F.lit(-3), "taken": F.lit(9)}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(extra)
    docs = docs.union(docs.where("doc_id in (5, 6, 2001)")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None)))
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
        rows = [r.asDict() for r in docs.collect()]
        got = [r.asDict() for r in stage(spark, docs, folder).collect()]
        expect = globals()[f"expect_{name}"]
        if name == "best_fit_packing":
            expect(spark, docs, rows, folder, got)
            break
        want = list(expect(spark, docs, rows, folder))
        told = lambda x: Counter(str(sorted(r.items())) for r in x)
        assert told(got) == told(want), name
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in got], docs.schema)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and "bin" in got.columns


def test_empty(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_nothing_to_learn(spark, folder):
    from delimlake.llm import langid

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(str(r["doc_id"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.col("lang")))
    for rows in (unlabelled, held):
        got = corpus_pipeline.language_id(spark, rows, folder)
        assert got.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))

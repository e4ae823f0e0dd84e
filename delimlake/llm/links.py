"""From candidate postings to classes of linked nodes, without all pairs of a group.

Candidates are the pairs of nodes that share a key. Only connectivity is asked
for, so a pair whose nodes are already connected need not be verified. In a
round every node goes, with its data, to one block of one of its keys; a task
verifies the pairs of a block that it has not yet united and returns at most one
edge a node. Labels are then contracted. A key with many nodes thus costs a few
pairs a node, in many tasks, and data travel once a node and round.

When rounds stop helping, a last step verifies what is left: pairs of different
components that share a key and that size, position and a parity sketch of
their sets allow. Where many nodes of a key are apart, pairs are met at parts of
their sets instead of at the key (see parts), so that nodes that share just that
key do not meet at all. No candidate is dropped: each is verified, ruled out by
a bound, or connected already.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delimlake.llm.common import Forest, attach, components, cut, drop, edge_batches, recut
from delimlake.llm.cooccur import mix64

log = logging.getLogger(__name__)

#: Nodes of a block, and elements of their sets, about.
BLOCK, WEIGHT = 64, 1 << 20
#: Partners of a node that travel together in the last step.
PARTNERS = 256
#: Rounds go on while the last one has united one in GOES_ON nodes with others; a round after the first looks
#: at one in SHARE keys.
ROUNDS, GOES_ON, SHARE = 12, 100, 4
#: Longs of a parity sketch.
SKETCH = 16
#: Nodes of a key outside its largest label from which pairs are met at parts. Both ways find the same links.
HOT = 2048
#: Tokens of parts that travel together.
BATCH = 1 << 16


class Test:
    """How data become sets (sorted arrays of 64-bit numbers) and whether two of them link at percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, data: bytes) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, x: np.ndarray, y: np.ndarray) -> bool:
        n, m, p = len(x), len(y), self.percent
        if 100 * min(n, m) < p * max(n, m):
            return False
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # merges the two
        i = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * i >= p * (n + m - i)


def differ(a: str, b: str, words: int) -> Column:
    """How many elements differ between two sets, at least: the bits in which their parity sketches do."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def fits(n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m elements may have that likeness."""
    return 100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m))


def overlap(a: str, b: str, n: str, m: str, percent: int, words: int = SKETCH) -> Column:
    """Whether sets of n and m elements with parity sketches a and b may have that likeness."""
    n, m = F.col(n), F.col(m)
    return (100 + percent) * (n + m - differ(a, b, words)) >= 2 * percent * (n + m)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: one bit a slot, set where an odd number of elements falls."""
    slot = (mix64(s) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = np.bincount(slot, minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(payload: DataFrame, test: Test) -> DataFrame:
    """(node, bits): parity sketches of the sets of payload(node, data)."""
    kind = payload.schema["node"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bits = [sketch(test.load(x)).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["node", "bits"])

    return payload.select("node", "data").mapInArrow(run, f"node {kind}, bits array<bigint>")


def parts(s: np.ndarray, percent: int) -> Iterator[tuple[bool, int, int, np.ndarray]]:
    """(own, size class, least, tokens): a set cut into parts by hash, for its own class of sizes and its neighbours.

    Sets that link have sizes of one class or of neighbouring ones, and if the
    second one is of this class, fewer than least elements differ. Each spoils
    one part, so that at most least - 1 of the parts (hence of their tokens) do
    not agree. In whatever order tokens are put, the same for all sets, two
    such sets thus share one of their first least ones.
    """
    if not len(s):
        return
    base = 1.001 * 100 / percent  # a bit wider than the ratio of linked sizes
    mine = int(math.log(len(s)) / math.log(base))
    slots, values = mix64(s), mix64(s ^ np.uint64(0x9E3779B97F4A7C15))
    for c in range(max(mine - 1, 0), mine + 2):
        least = int(base ** (c + 1) * (100 - percent) / percent) + 1
        count = least + least // 2 + 2  # spare parts: the empty ones and those of frequent elements alone come last
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, (slots % np.uint64(count)).astype(np.int64), values)
        places = np.arange(count, dtype=np.uint64) + np.uint64(c << 40)
        yield c == mine, c, least, mix64(sums ^ mix64(places)).view(np.int64)


def _parted(payload: DataFrame, test: Test) -> DataFrame:
    """(node, own, c, least, token): the tokens of the parts of payload(node, data)."""
    kind = payload.schema["node"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def batch(held):
            times = [len(t) for *_, t in held]
            columns = [np.repeat(np.array(x), times) for x in list(zip(*held, strict=True))[1:4]]
            nodes = pa.array([h[0] for h in held]).take(pa.array(np.repeat(np.arange(len(held)), times)))
            arrays = [nodes, pa.array(columns[0]), *(pa.array(x.astype(np.int32)) for x in columns[1:]), pa.array(np.concatenate([h[4] for h in held]))]
            return pa.RecordBatch.from_arrays(arrays, names=["node", "own", "c", "least", "token"])

        held, size = [], 0
        for b in batches:
            for node, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in parts(test.load(data), test.percent):
                    held.append((node, *row))
                    size += len(row[3])
                    if size >= BATCH:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return payload.select("node", "data").mapInArrow(run, f"node {kind}, own boolean, c int, least int, token bigint")


def _runs(batches, names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows (of names, then the others) in runs of equal values of names; batches are sorted by them."""
    run, now = [], None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if row[: len(names)] != now:
                if run:
                    yield run
                run, now = [], row[: len(names)]
            run.append(row[len(names) :])
    if run:
        yield run


def _dealt(rows: DataFrame, test: Test, unite: Callable) -> DataFrame:
    """rows(x, y, ..., label, data) dealt by x and y: the trees that unite(run, test, forest) makes of labels, as (u, v)."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        forest = Forest()
        for block in _runs(batches, ("x", "y")):
            unite(block, test, forest)
        yield from edge_batches(forest.edges(), pa.int64() if kind == "bigint" else pa.binary())

    return rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, f"u {kind}, v {kind}")


def _block(run: list[tuple], test: Test, forest: Forest) -> None:
    """All pairs of a block that are not united."""
    if len({label for label, _ in run}) < 2:
        return
    run = [(label, test.load(data)) for label, data in run]
    for i, (a, x) in enumerate(run):
        for b, y in run[:i]:
            if forest.find(a) != forest.find(b) and test(x, y):
                forest.unite(a, b)


def _star(run: list[tuple], test: Test, forest: Forest) -> None:
    """The one row of role 0 with each of the others."""
    run.sort(key=lambda r: r[0])
    _, a, x = run[0]
    x = test.load(x)
    for _, b, y in run[1:]:
        if forest.find(a) != forest.find(b) and test(x, test.load(y)):
            forest.unite(a, b)


def relabel(known: DataFrame, found: DataFrame) -> DataFrame:
    """known with the labels u of found replaced by v; known goes."""
    rows = attach(known, found.toDF("label", "__to"), ["label"])
    rows = rows.withColumn("label", F.coalesce("__to", "label")).select(known.columns)
    return recut(rows, known)


def resolve(posts: DataFrame, members: DataFrame, payload: DataFrame, test: Test, near: Callable[[str, str], Column] | None = None, few_keys: bool = False) -> DataFrame:
    """(node, label) of the nodes whose component has a smaller node; label is the smallest one.

    posts(key, gid, ...): groups of nodes by key, once each; members(gid, node,
    n): the nodes of each group, which are candidates of each other and share all
    its keys, with the size of their sets; payload(node, data): what test loads. near(l, r) may rule out a pair of
    groups at a key, over the aliases of two rows of posts with their n.
    few_keys: groups have a bounded number of keys, so that each row can hold
    them all and a pair is met at its first common key alone.
    """
    known = cut(members.select("gid", "node", "n", F.col("node").alias("label")))
    nodes = known.count()
    for turn in range(ROUNDS):
        if turn == 0:  # every node has a label of its own
            sizes = known.groupBy("gid").agg(F.count("*").alias("total"), F.sum("n").alias("weight"))
            sizes = posts.select("key", "gid").join(sizes, "gid").groupBy("key").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
            dealt = attach(posts.select("key", "gid"), sizes.where("total > 1"), ["key"], "inner")
            rank = F.struct("total", F.xxhash64("key"))
        else:
            dealt = _mixed(posts.where(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == turn % SHARE), known)
            rank = F.xxhash64("key", F.lit(turn))
        home = dealt.groupBy("gid").agg(F.max_by(F.struct("key", "total", "weight"), rank).alias("k")).select("gid", "k.*")
        blocks = F.ceil(F.greatest(F.col("total") / BLOCK, F.col("weight") / WEIGHT))
        dealt = attach(known, home, ["gid"], "inner").withColumn("y", F.pmod(F.xxhash64("node", F.lit(turn)), blocks))
        rows = dealt.select(F.col("key").alias("x"), "y", "label", "node").join(payload, "node").select("x", "y", "label", "data")
        found = cut(_dealt(rows, test, _block))
        united = found.count()
        if turn == 0:  # every node was in one task: its trees are the labels
            known = relabel(known, found)
        elif united:
            known = relabel(known, components(found, "u", "v"))
        drop(found)
        log.info("%d nodes, round %d united %d", nodes, turn, united)
        if united * GOES_ON < nodes and (turn or not united):
            break
    mixed = cut(_mixed(posts, known))
    if not mixed.isEmpty():
        pairs = _remaining(mixed, known, payload, test, near, few_keys)
        found = cut(_verified(pairs, payload, test))
        drop(pairs)
        if not found.isEmpty():
            known = relabel(known, components(found, "u", "v"))
        drop(found)
    drop(mixed)
    return known.where("node != label").select("node", "label")


def _mixed(posts: DataFrame, known: DataFrame) -> DataFrame:
    """posts by label (with n, and held: the group's nodes of that label), of the keys whose nodes have several; with
    the key's total and weight, its major label and how many nodes have that (most)."""
    groups = known.groupBy("gid", "label").agg(F.first("n").alias("n"), F.count("*").alias("held"))
    entries = posts.join(groups, "gid")
    sums = entries.groupBy("key", "label").agg(F.sum("held").alias("held"), F.sum(F.col("held") * F.col("n")).alias("weight"))
    keys = sums.groupBy("key").agg(F.max_by("label", "held").alias("major"), F.max("held").alias("most"), F.sum("held").alias("total"), F.sum("weight").alias("weight"), F.count("*").alias("labels"))
    return attach(entries, keys.where("labels > 1").drop("labels"), ["key"], "inner")


def _remaining(mixed: DataFrame, known: DataFrame, payload: DataFrame, test: Test, near, few_keys: bool) -> DataFrame:
    """Pairs (a, b, la, lb) of nodes of different components that may link, cut."""
    percent = test.percent
    # Groups that have a partner at some key are expanded; a pair passes only if its own sketches allow it.
    each = known.join(mixed.select("gid").distinct(), "gid", "left_semi")
    each = cut(each.join(sketches(payload.join(each.select("node"), "node", "left_semi"), test), "node"))
    hot = F.col("total") - F.col("most") > HOT
    rows = mixed.where(~hot).join(each.select("gid", "label", "node", "bits"), ["gid", "label"])
    if few_keys:  # those that are mixed: two labels that share a key make it so
        keys = mixed.groupBy("gid").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        rows = rows.join(keys, "gid")
    l, r = rows.where("label != major").alias("l"), rows.alias("r")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label"))
    on = on & ((F.col("r.label") == F.col("r.major")) | (F.col("l.label") < F.col("r.label"))) & fits("l.n", "r.n", percent)
    if near:
        on = on & near("l", "r")
    on = on & overlap("l.bits", "r.bits", "l.n", "r.n", percent)
    if few_keys:
        on = on & (F.get(F.array_intersect("l.keys", "r.keys"), F.lit(0)) == F.col("l.key"))
    swap = F.col("l.node") > F.col("r.node")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("l.node", "r.node", "a"), ("r.node", "l.node", "b"), ("l.label", "r.label", "la"), ("r.label", "l.label", "lb"))]
    pairs = l.join(r, on).select(*ends)
    apart = mixed.where(hot).select("gid", "label").distinct()
    if apart.isEmpty():
        return recut(pairs.distinct(), each)
    some = each.join(apart, ["gid", "label"], "left_semi")
    if few_keys:
        some = some.join(keys, "gid")
    tokens = cut(_parted(payload.join(some.select("node"), "node", "left_semi"), test))
    met = _met(tokens, some, percent)
    if few_keys:  # candidates share a key
        met = met.where(F.arrays_overlap("l.keys", "r.keys"))
    return recut(pairs.union(met.select(*ends)).distinct(), each, tokens)


def _met(tokens: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Pairs l, r of rows of some, of different labels, that share one of their first tokens, rarest first, and whose
    sketches allow a link. Tokens travel with label and size alone."""
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node", "c").orderBy("often", "token")
    first = attach(tokens, often.where("often > 1"), ["token"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    first = first.withColumn("rank", F.row_number().over(order)).where("rank <= least and often > 1")
    first = first.join(some.select("node", "label", "n"), "node").select("token", "own", "node", "label", "n")
    x, y = first.alias("x"), first.where("own").alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.label") < F.col("y.label")) & fits("x.n", "y.n", percent)
    pairs = x.join(y, on).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()
    l, r = some.alias("l"), some.alias("r")
    pairs = pairs.join(l, F.col("x") == F.col("l.node")).join(r, F.col("y") == F.col("r.node"))
    return pairs.where(overlap("l.bits", "r.bits", "l.n", "r.n", percent))


def _verified(pairs: DataFrame, payload: DataFrame, test: Test) -> DataFrame:
    """The trees of labels (u, v) that pairs make which link. Partners of a node come in parts, each with its data once."""
    parts = pairs.groupBy("a", "la").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    firsts = parts.select("a", "la", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("y"))
    others = attach(pairs, parts, ["a", "la"], "inner").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("y"), "b", "lb")
    firsts = firsts.select("a", "y", F.col("a").alias("node"), F.lit(0).alias("role"), F.col("la").alias("label"))
    others = others.select("a", "y", F.col("b").alias("node"), F.lit(1).alias("role"), F.col("lb").alias("label"))
    rows = firsts.union(others).join(payload, "node").select(F.col("a").alias("x"), "y", "role", "label", "data")
    return _dealt(rows, test, _star)

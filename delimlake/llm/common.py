"""What several operators share: shared folder, cut lineage, skew-safe joins,
connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Cuts made within calls of settled, innermost last.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our
    own where that is unset and the session runs in one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a
    lost executor costs no recomputation of what went before. The shuffle files
    that made it go at once."""
    spark = df.sparkSession
    path, was = new_path(spark, "cut"), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if _made:
        _made[-1].append(path)
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove the files of cuts. What was made of them must have been cut itself."""
    for df in cuts:
        if path := _folders.pop(df, None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()), after which all cuts that were made on the way go."""
    _made.append([])
    try:
        out = cut(make())
    finally:
        made = _made.pop()
    for path in made:
        if path != _folders[out]:
            _remove(out.sparkSession, path)
    if _made:
        _made[-1].append(_folders[out])
    return out


def recut(df: DataFrame, *used: DataFrame) -> DataFrame:
    """cut(df), after which the cuts that it was made of go."""
    out = cut(df)
    drop(*used)
    return out


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined to facts (at most one row a key), where a key may be hot in rows.

    facts mostly come from a groupBy on the same keys and would be joined in
    place, which leaves the hot key's rows in one task. A further key makes
    Spark exchange both sides for the join, and adaptive execution then splits
    the partitions of hot keys. Rows whose key is null match nothing.
    """
    place = "__place"
    h = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(16))
    out = rows.withColumn(place, h).join(facts.withColumn(place, h), [*keys, place], how)
    return out.drop(place)


class Forest:
    """Union-find; the least node of a tree is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def unite(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple]:
        """(node, root) of each node that is not a root."""
        return [(x, self.find(x)) for x in self.parent]


def edge_batches(edges: list[tuple], kind, names: tuple[str, str] = ("u", "v"), size: int = 10_000):
    import pyarrow as pa

    for i in range(0, len(edges), size):
        us, vs = zip(*edges[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(us, kind), pa.array(vs, kind)], names=list(names))


def _forests(batches):
    """The edges of a task as (node, root): at most one a node."""
    forest, kind = Forest(), None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.unite(u, v)
    yield from edge_batches(forest.edges(), kind)


#: Edges that one task may unite: some megabytes.
FEW_EDGES = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node reachable.

    Distributed union-find. Each task first unites the edges it holds, which
    leaves one edge a node. Then, in rounds, every node takes its smallest
    neighbour as its parent; its other smaller neighbours get an edge to that
    parent, and all edges are led on to the parent's parent. Edges point to
    smaller nodes, paths halve, and when nothing moves every node points to its
    label. A node may have any number of children (see attach). Once at most
    FEW_EDGES are left, which are counted, one task unites them.
    """
    kind = edges.schema[a].dataType.simpleString()
    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e, state = _told(ends.mapInArrow(_forests, f"u {kind}, v {kind}").distinct())
    while state[0]:
        if state[0] <= FEW_EDGES:
            e = recut(e.coalesce(1).mapInArrow(_forests, e.schema), e)
            break
        up = e.groupBy("u").agg(F.min("v").alias("p"))
        led = e.join(up, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("p").alias("v")), F.struct(F.col("v").alias("u"), F.col("p").alias("v")))).alias("e")).select("e.*").where("u != v")
        led = attach(led, up.toDF("v", "top"), ["v"]).select("u", F.coalesce("top", "v").alias("v")).distinct()
        last = e
        e, new = _told(led)
        drop(last)
        if new == state:
            break
        state = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _told(df: DataFrame) -> tuple[DataFrame, tuple]:
    """df cut, with its row count and a checksum of its edges, taken while it is written."""
    told = Observation()
    seen = df.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"))
    out = cut(seen)
    return out, (told.get["n"], told.get["h"])

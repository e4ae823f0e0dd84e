"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame
operations only.

Each document draws an exponential key, divided by its quality weight; within a
source, documents in the order of their keys are a weighted sample without
replacement. A source's word budget buys whole epochs of the source first; the
rest buys the documents with the smallest keys, by their prefix sum.

No source is sorted in one task: keys are cut into buckets of equal probability
and prefix sums run over the buckets' totals. The bucket in which a source's
budget ends is cut again, by its own least and largest key, until it is small;
its documents are then sorted and give the last key that the budget buys, and every document is then compared with its source's last key
where it stands. Texts take no part: mix a table of ids and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delimlake.llm.common import WORD, attach, cut, recut

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
CAP = 3
#: Key buckets a source, and those into which the bucket where a budget ends is cut again.
BUCKETS = 1024
#: Documents of a bucket that is sorted in one task, beside those of one key.
SORTED = 1 << 17
#: Sources up to which facts about them, one row each, are broadcast.
BROADCAST_SOURCES = 10_000
#: Quality weights of documents by their label; documents without one weigh 1.
QUALITY = {1: 2.0, 0: 0.5}


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone: 48 bits of MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("\x1f", F.lit(seed), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size), one row a source -> with weight and target (double).

    Sources by code point, null last, take the weights in turn. The targets
    share the sum of all sizes: a target is share x weight, or cap x size where
    that is less, and share is such that the targets add up. With sources in
    the order of size / weight the capped ones come first, so one pass of
    prefix sums finds the share. The table has one row a source, so a single
    task sorts it.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w.cast("long")).drop("rank")
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * cap
    out = (
        ranked.withColumn("limit", limit)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("share", (F.col("total") - F.col("capped")).cast("double") / F.col("open"))
    )
    # The first source, in this order, that its limit does not stop: all after it share alike.
    out = out.withColumn("free", F.col("share") * F.col("weight") <= F.col("limit"))
    share = F.max(F.when(F.col("free"), F.struct(-F.col("capped"), F.col("share")))).over(whole)["share"]
    target = F.when(F.col("free"), share * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column,
    *,
    source: str = "source",
    ident: str = "doc_id",
    seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    buckets: int = BUCKETS,
    most: int = SORTED,
) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of the document).

    size and quality are columns over docs; quality above 0 (null, 0 and below
    count as 1). taken is size times the epochs, once more for the documents that
    the rest of the budget buys, so at most cap times size. A source's taken
    words differ from its target by at most half its largest document. Null
    sources are a source of their own. Rows that agree in id, size and quality
    (all null ids of a size, say) have one key and are taken together; if the
    budget ends among several such rows, each gives the same share of its words,
    rounded down. An empty table gives an empty result; documents without words
    are taken 0 times. The columns size, source_size, target and taken of docs,
    if any, are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    q = F.when(quality > 0, quality).otherwise(1.0).cast("double")
    rows = docs.withColumns({"__size": size, "__quality": q}).drop(*made)
    rows = rows.withColumn("__key", -F.log(uniform(seed, F.col(ident), F.col("__size"))) / F.col("__quality"))
    # 1 - exp(-key) is uniform for a quality of 1, and keeps the order of the keys.
    rows = rows.withColumn("__bucket", F.floor((1.0 - F.exp(-F.col("__key"))) * buckets).cast("int"))
    rows = rows.withColumns({"__source": F.coalesce(F.col(source), F.lit("")), "__named": F.col(source).isNotNull()})
    keys = ["__named", "__source"]

    parts = _bucket_sums(rows, keys)
    named = F.when(F.col("__named"), F.col("__source")).alias("source")
    per = targets(parts.groupBy(*keys).agg(F.sum("__words").alias("source_size")).select(named, "source_size"), weights, cap)
    per = per.withColumns({"__source": F.coalesce("source", F.lit("")), "__named": F.col("source").isNotNull()}).drop("source", "weight")
    per = per.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    ends = cut(_last_begun(parts.join(per.select(*keys, "__rest").withColumn("__before", F.lit(0).cast("long")), keys), keys))
    while not (wide := ends.where((F.col("__n") > most) & (F.col("__lo") < F.col("__hi")))).isEmpty():
        inner = _by_source(rows.select(*keys, "__key", "__size"), wide, keys, "inner").where("__key between __lo and __hi")
        at = F.floor((F.col("__key") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets).cast("int")
        parts = _bucket_sums(inner.withColumn("__bucket", at), keys)
        parts = parts.join(wide.select(*keys, "__before", "__rest"), keys)
        ends = recut(_last_begun(parts, keys).unionByName(ends.join(wide.select(*keys), keys, "left_anti")), ends)

    order = F.struct("__key", F.col(ident).isNull().alias("none"), F.col(ident).cast("string").alias("id"), "__size").alias("__at")
    inside = _by_source(rows.select(*keys, "__key", "__size", order), ends, keys, "inner").where("__key between __lo and __hi")
    inside = inside.groupBy(*keys, "__at").agg(F.sum("__size").alias("__words"), F.count("*").alias("__n"), F.first("__before").alias("__before"), F.first("__rest").alias("__rest"))
    upto = F.sum("__words").over(Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__left", F.col("__rest") - F.col("__before") - (upto - F.col("__words")))
    bought = F.when(F.col("__n") == 1, F.when(F.col("__words") / 2 <= F.col("__left"), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__left") / F.greatest("__words", F.lit(1)))))
    inside = inside.withColumn("__share", bought)
    # Shares fall with the key: whole up to a last key, perhaps a part of the next, nothing after.
    lasts = inside.groupBy(*keys).agg(F.max(F.when(F.col("__share") == 1, F.col("__at"))).alias("__last"), F.max(F.when((F.col("__share") > 0) & (F.col("__share") < 1), F.struct("__at", "__share"))).alias("__part"))
    facts = cut(per.drop("__rest").join(ends.select(*keys, "__lo", "__hi"), keys, "left").join(lasts, keys, "left"))

    share = (
        F.when(F.col("__key") < F.col("__lo"), 1.0)
        .when((F.col("__key") > F.col("__hi")) | F.col("__hi").isNull(), 0.0)
        .when(F.col("__at") <= F.col("__last"), 1.0)
        .when(F.col("__at") == F.col("__part.__at"), F.col("__part.__share"))
        .otherwise(0.0)
    )
    out = _by_source(rows.withColumn("__at", order), facts, keys, "left")
    out = out.withColumn("taken", (F.col("__size") * F.col("__epochs") + F.floor(F.col("__size") * share)).cast("long"))
    names = [F.col(c) for c in docs.columns if c not in made]
    return out.select(*names, F.col("__size").alias("size"), "source_size", "target", "taken")


def _bucket_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Words, documents, least and largest key of each bucket."""
    return rows.groupBy(*keys, "__bucket").agg(F.sum("__size").alias("__words"), F.count("*").alias("__n"), F.min("__key").alias("__lo"), F.max("__key").alias("__hi"))


def _last_begun(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The last bucket of each source that begins within the budget __rest, __before words having been bought before
    the first one; the buckets before it are bought whole. Their count is bounded by that of buckets."""
    w = Window.partitionBy(*keys).orderBy("__bucket")
    parts = parts.withColumn("__before", F.col("__before") + F.sum("__words").over(w) - F.col("__words"))
    last = F.max_by(F.struct("__lo", "__hi", "__n", "__before", "__rest"), "__bucket").alias("e")
    return parts.where("__before <= __rest").groupBy(*keys).agg(last).select(*keys, "e.*")


def _by_source(rows: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined to facts, one row a source: in place while sources are few, else by a shuffle that splits hot ones."""
    if facts.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), keys, how)
    return attach(rows, facts, keys, how)


def copies(docs: DataFrame, sizes: DataFrame, *, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken whole.

    sizes is mix() over source_sizes(docs): texts are shuffled once, to where their counts are. Rows of one ident,
    source and text have one count. Columns of docs are kept as they are.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    keys = ["__id", "__of", "__text"]
    counts = sizes.select(*keys, times.alias("__times")).where("__times > 0").dropDuplicates(keys)
    rows = attach(docs.withColumns(_row_keys(ident, source, text)), counts, keys, "inner")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(c) for c in docs.columns])


def _row_keys(ident: str, source: str, text: str) -> dict[str, Column]:
    """Columns that name a row: ident and source (null apart from every value) and a hash of the text."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return {"__id": told(ident), "__of": told(source), "__text": F.xxhash64(text)}


def source_sizes(docs: DataFrame, *, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(ident, source, words, and what names the row) of docs: a narrow table to mix."""
    return docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("words"), *[c.alias(k) for k, c in _row_keys(ident, source, text).items()])


def label_quality(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality) -> one row a document: the mean weight of its labels."""
    q = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(1.0)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(q).alias("__weight"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with __weight: that of its labels, 1 without any."""
    return attach(docs, label_quality(labels), ["doc_id"]).withColumn("__weight", F.coalesce("__weight", F.lit(1.0)))

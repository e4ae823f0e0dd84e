"""SpotSigs document fingerprints, in DataFrame operations only.

A spot is a common word (anchor) and the chain of content words that follow it;
common words in between are skipped. A document's signature set holds the hashes
of its spots. Sets are compared by Jaccard likeness, pruned by set length: the
ratio of two lengths bounds their likeness, so only sets in the same or the next
length partition can reach a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delimlake.llm.common import attach, cut

#: Anchors: common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is it that for on with as was be by at or an are this from "
    "der die das und zu den von mit für auf ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que est pour dans au sur pas "
    "el los y una del se las por con para su no"
).split()
#: Content words of a spot.
CHAIN = 2
#: Characters between words: ASCII other than digits and letters (after lower-casing).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hexadecimal digits of a hash: 64 bits.
DIGITS = 16
#: Likeness of near duplicates.
THRESHOLD = 0.75
#: Parts of the rows that agree in a null or frequent doc_id and in their text, where these are many.
COPIES, MANY = 16, 1024


def _hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, DIGITS)


def _last_word(segments: str, i: Column) -> Column:
    return F.substring_index(F.get(segments, i), " ", -1)


def _spots(segments: str) -> Column:
    """Hashes of the spots of segments: common words and the content word they lead to, parted by spaces.
    The last segment holds the common words that lead to none."""

    def of_segment(s: Column, i: Column) -> Column:
        own = F.substring_index(s, " ", -1)
        chain = F.concat(F.lit(" "), *[y for k in range(CHAIN) for y in (_last_word(segments, i + k), F.lit(" "))])
        complete = i + CHAIN < F.size(segments)
        return F.transform(F.array_distinct(F.split(s, " ")), lambda w: F.when(complete & (w != own), _hash(F.concat(w, chain))))

    return F.array_compact(F.flatten(F.transform(segments, of_segment)))


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the fingerprint of a text column: length of the signature set, a colon and the set
    (sorted distinct hashes of spots, of 16 hex digits). A spot's common word and content words may have
    any number of common words between them. Of a text without spots the set is the hash of its words.
    Time is linear in the text."""
    # One step each, so that no step is computed twice.
    rows = rows.withColumn("__words", F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), GAPS, " ")))
    marked = F.transform(F.split("__words", " "), lambda w: F.concat(w, F.when(w.isin(ANCHORS), F.lit(" ")).otherwise(F.lit("\n"))))
    rows = rows.withColumn("__segments", F.split(F.array_join(marked, ""), "\n"))
    rows = rows.withColumn("__set", F.sort_array(F.array_distinct(_spots("__segments"))))
    whole = F.array(_hash(F.concat(F.lit(" "), "__words", F.lit(" "))))
    rows = rows.withColumn("__set", F.when(F.size("__set") > 0, F.col("__set")).otherwise(whole))
    return rows.withColumn(name, F.concat_ws(":", F.size("__set"), F.array_join("__set", ","))).drop("__words", "__segments", "__set")


def members(fp: Column) -> Column:
    return F.split(F.substring_index(fp, ":", -1), ",")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two fingerprints; 0 without comparing where their lengths keep it below least."""
    na, nb = (F.substring_index(x, ":", 1).cast("long") for x in (a, b))
    inter = F.size(F.array_intersect(members(a), members(b)))
    return F.when(a == b, 1.0).when(F.least(na, nb) < least * F.greatest(na, nb), 0.0).otherwise(inter / (na + nb - inter))


def _at(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are at most value, by bisection."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*[F.lit(x) for x in bounds]), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(table, acc + s - 1) <= value), acc + s).otherwise(acc))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, text) with their fingerprint fp, and next_text and next_fp: those of the next
    row in the order of descending doc_id (null last; ties by the text's MD5), of the
    first row for the last.

    Rows are cut into ranges of doc_id, those of one frequent doc_id (or none)
    further by their MD5, and copies of one text among them, where these are
    many, by their rows. Each range gets the first row of the one after it as a
    guest, so that no task sees more than its range. A text travels once;
    fingerprints are made where it arrives.
    """
    fractions = [i / buckets for i in range(1, buckets)] or [0.5]
    facts = docs.agg(F.percentile_approx("doc_id", fractions, 100 * buckets).alias("b"), F.count("*").alias("n"), F.count("doc_id").alias("held")).first()
    found = facts["b"] or []
    bounds = sorted(set(found))
    often = sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})
    rows = docs.withColumn("md5", F.md5(F.col("text").cast("binary")))
    split = F.col("doc_id").isNull() | (F.col("doc_id").isin(*often) if often else F.lit(False))
    copies: list[str] = []
    if often or facts["held"] < facts["n"]:
        same = rows.where(split).groupBy("doc_id", "md5").count().where(F.col("count") >= max(MANY, facts["n"] // buckets))
        copies = sorted({r["md5"] for r in same.collect()})  # one a bucket at most
    below = _at(copies, F.col("md5"))
    one = F.col("md5").isin(*copies) if copies else F.lit(False)
    part = F.floor(F.conv(F.substring("md5", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")
    part = (part * (2 * len(copies) + 1) + 2 * below - F.when(one, 1).otherwise(0)) * COPIES
    part = part + F.when(one, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COPIES))).otherwise(0)
    # Ranges in the order of their numbers: a frequent doc_id is the least of its range, so its parts come last.
    width = buckets * (2 * len(copies) + 1) * COPIES + 1
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(len(bounds) - _at(bounds, F.col("doc_id")))
    rows = rows.withColumn("bucket", place * F.lit(width).cast("long") + F.when(split, 1 + part).otherwise(F.lit(0)))
    # One row a range: where its first row is found, and the range that it is a guest of.
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("least"), F.col("md5").alias("h"))
    tops = rows.groupBy("bucket").agg(F.min(order).alias("top")).orderBy("bucket").select("bucket", (-F.col("top.least")).alias("top"), "top.h").collect()
    if not tops:
        rows = with_fingerprint(docs, "text", "fp")
        return rows.withColumns({"next_text": F.col("text"), "next_fp": F.col("fp")})
    guests_of = [(t["bucket"], t["top"], t["h"], tops[i - 1]["bucket"]) for i, t in enumerate(tops)]
    small = docs.sparkSession.createDataFrame(guests_of, "bucket long, top long, h string, host long")
    first = rows.join(F.broadcast(small), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("md5") == F.col("h")))
    first = first.groupBy("host").agg(F.min("text").alias("text"))
    guests = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("").alias("md5"), F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    every = with_fingerprint(rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket"), "text", "fp")
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "md5", "text")
    return every.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("not guest").drop("guest", "bucket", "md5")


def fingerprint_documents(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the first as many code points
    of the next document's text. Null texts are empty; equal texts have equal
    fingerprints, and likeness 1. The only row of a table is its own next.
    Documents of one doc_id, or without one, follow each other by the MD5 of
    their texts; repeated rows are rows of their own. An empty table gives an
    empty result. Columns other than ident and text are not read.
    """
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, n)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def near_duplicates(prints: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """prints(doc_id, fingerprint) -> (classes: class_id, fingerprint, doc_id of the smallest member, members),
    (pairs of classes: class ids a < b, their doc_ids doc_a and doc_b, likeness >= threshold).

    Equal fingerprints are one class; class_id is the MD5 of the fingerprint. Classes
    are partitioned by set length, in steps of 1 / threshold; within a partition, and
    between it and the next, a pair must share one of the rarest
    n - ceil(threshold n) + 1 hashes of each. Null fingerprints take no part. Repeated
    doc_ids may stand for several classes; a class without doc_ids has a null one and
    takes part. Empty input gives empty results.
    """
    classes = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))
    classes = cut(classes.select(F.md5(F.col("fingerprint").cast("binary")).alias("class_id"), "fingerprint", "doc_id", "members"))
    rows = classes.select("class_id", "doc_id", F.substring_index("fingerprint", ":", 1).cast("int").alias("n"), members(F.col("fingerprint")).alias("set"))
    each = rows.select("class_id", "n", F.explode("set").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    ranked = attach(each, df, ["h"], "inner").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    prefix = F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int") if threshold < 1 else F.col("n")
    hashes = F.explode(F.transform(prefix, lambda x: x["h"])).alias("h")
    posts = ranked.select("class_id", "n", part.alias("part"), hashes)
    left = posts.select("class_id", "n", "h", F.explode(F.array("part", F.col("part") + 1)).alias("part")).alias("l")
    right = posts.alias("r")
    ok = (F.col("l.h") == F.col("r.h")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.n") >= threshold * F.col("r.n")) & (F.col("r.n") >= threshold * F.col("l.n")) & (F.col("l.class_id") != F.col("r.class_id"))
    pairs = left.join(right, ok).select(F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")).distinct()
    sets = rows.select("class_id", "doc_id", "set")
    got = pairs.join(sets.toDF("a", "doc_a", "sa"), "a").join(sets.toDF("b", "doc_b", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    got = got.withColumn("likeness", inter / (F.size("sa") + F.size("sb") - inter)).where(F.col("likeness") >= threshold)
    return classes, got.select("a", "b", "doc_a", "doc_b", "likeness")

"""A training corpus from raw documents: STAGES in order, each over all that the one before kept.

Every stage takes documents with at least doc_id, text, lang and source, and all but the last return
the columns they got, extra ones as they are (names that begin with two underscores are reserved, and
n_lines and n_kept would be replaced). Null and empty values are values: each docstring says where they
go. Repeated rows are documents of their own unless it says otherwise. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delimlake.llm import jaccard, langid, linededup, mixing, packing
from delimlake.llm.common import cut, drop, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not those without letters, nor those of no clear language.

    Null and empty texts have no letters and go; repeated rows stay or go together. A null doc_id, lang or
    source changes nothing. Where nothing can be learned (no labels, or held-out ones alone), no language is
    unclear: all documents with a letter stay.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.withColumn("__p", langid.predict(F.col("text"), model))
    return rows.where((F.col("__p.lang") != langid.UNKNOWN) & (F.col("__p.score") >= langid.MIN_SCORE)).drop("__p")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove fuzzy duplicates of lines; documents of which no line stays go.

    The first line of a component stays, by doc_id (null last), a hash of the text and position. Documents that
    had no line to begin with (null, empty or blank texts) stay as they are; rows that agree in doc_id and text
    keep the same lines. n_chars follows the text.
    """
    rows = linededup.dedup_lines(docs)
    rows = rows.where("n_kept > 0 or n_lines = 0 or n_lines is null").withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id (null last).

    Documents without words (null, empty or blank texts) are near nothing and all stay. Of rows that agree in
    doc_id and text one stays.
    """
    return jaccard.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a document stands as often as the mix takes it.

    Documents without words are taken 0 times. A null source is a source of its own, a null doc_id a document
    without labels. Rows that agree in doc_id, source and text are taken equally often.
    """
    sizes = cut(mixing.with_quality(mixing.source_sizes(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixing.copies(docs, mixing.mix(sizes, F.col("words"), F.col("__weight")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: one row a piece of a document (see packing.pack_documents).

    Documents without words get one piece of size 0 in no bin. Copies of a text are one cluster, so no two of
    them share a bin; null doc_ids and sources are values like others.
    """
    return packing.pack_documents(docs, packing.size_of(F.col("text")), packing.text_cluster(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: A trained network and MinHash are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; what a stage wrote on the way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last, docs = docs, settled(partial(stage, spark, docs, sf_dir))
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)

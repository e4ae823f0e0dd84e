"""Texts to physical lines: lines(doc_id, block, line_no, line).

line_no orders the lines of a document, from 0. block cuts a document into
consecutive parts, so that a large one need not meet in one task. Or to blocks of
lines, as one text each: blocks(doc_id, block, of, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines of a block of a document that is held in a row.
LINES = 10_000


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """Lines of texts held in rows, in blocks of so many lines. Null and empty texts have none."""
    each = F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    rows = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("string").alias("doc_id"), each)
    return rows.select("doc_id", F.floor(F.col("line_no") / lines).alias("block"), F.col("line_no").cast("long"), "line")


def document_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """blocks(doc_id, block, of, text) of so many lines of texts held in rows: the number of the block's first line, how
    many blocks the document has, and its lines. Null and empty texts have none. Nothing is exchanged."""
    of = F.ceil((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1) / lines)
    # Generators: a text is made once, and split into lines once, not once a block.
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode(F.array(text)).alias("text")).where(F.length("text") > 0)
    rows = rows.select("doc_id", of.alias("of"), "text")
    rows = rows.select("doc_id", "of", F.explode(F.array(F.when(F.col("of") > 1, F.split("text", "\n")).otherwise(F.array("text")))).alias("all"))
    part = lambda b: F.struct((b * lines).alias("block"), F.array_join(F.slice("all", b.cast("int") * lines + 1, F.lit(lines)), "\n").alias("text"))
    rows = rows.select("doc_id", "of", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), part)).alias("b"))
    return rows.select("doc_id", "b.block", "of", "b.text")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """documents(doc_id, text): whole files, for many small ones."""
    files = spark.read.format("text").option("wholetext", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


#: File blocks whose numbers are sent to every task: five numbers each, some 64 MB.
BLOCKS = 1 << 20


def _blocks_at_most(files: DataFrame) -> int:
    """A bound for the blocks in which Spark reads files."""
    spark = files.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    per_core = size // max(1, spark.sparkContext.defaultParallelism)
    block = max(1, min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), per_core)))
    return len(files.inputFiles()) + -(-size // block)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files; doc_id is the file's path, block the start of the file block that a task reads.

    A task reads a block in order and its rows' ids rise by one, so a line's
    number is its id, less the least of the block, plus the lines of earlier
    blocks. Only a row a block is exchanged, and sent to all tasks; beyond BLOCKS
    of them (a bound is worked out from the files' sizes) lines are joined to
    those rows instead.
    """
    files = spark.read.format("text").option("lineSep", "\n").load(path)
    at = F.monotonically_increasing_id()
    raw = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), F.col("value").alias("line"))
    keys = [F.shiftright("at", 33).alias("task"), F.xxhash64("doc_id").alias("file"), F.col("block").alias("from")]
    counts = raw.groupBy("doc_id", *keys).agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", "file", "from", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    if _blocks_at_most(files) <= BLOCKS:
        counts = F.broadcast(counts)
    rows = raw.join(counts, (F.shiftright("at", 33) == F.col("task")) & (F.xxhash64("doc_id") == F.col("file")) & (F.col("block") == F.col("from")), "left")
    # Every block was counted: a line without a number is never passed on.
    shift = F.coalesce("shift", F.raise_error(F.lit("a file has changed while it was read")).cast("long"))
    return rows.select("doc_id", "block", (F.col("at") + shift).alias("line_no"), "line")

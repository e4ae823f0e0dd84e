"""Tables to report lines: lines(doc_id, block, line_no, line) that the readers would give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A quoted cell that reads back as c (line breaks fold)."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long").cast("string")


def line(*cells: Column | str, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[F.lit(c) if isinstance(c, str) else c for c in cells])


def number(rows: DataFrame, doc_id: Column, *order: Column, line: Column) -> DataFrame:
    """One line a row of each document, in the given order."""
    named = rows.select(doc_id.cast("string").alias("doc_id"), F.struct(*order).alias("at"), line.alias("line"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return named.select("doc_id", F.lit(0).cast("long").alias("block"), no.cast("long").alias("line_no"), "line")

"""Streams of whole records and of responses. Both are stateless: no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delimlake.functions.columns import error_message, is_success, parse_payload
from delimlake.operators.records import split_cells


def stream_records(rows: DataFrame, delimiter: str = ",", text: str = "value") -> DataFrame:
    """rows with cells, where each row's text is one whole record; blank records are left out."""
    out = rows.withColumn("cells", split_cells(F.col(text), F.lit(delimiter)))
    return out.where(F.exists("cells", lambda c: c != ""))


def stream_responses(responses: DataFrame) -> DataFrame:
    """responses(status, status_text, body) with payload, raw, payload_kind, ok and error_message (null if ok)."""
    rows = parse_payload(responses).withColumn("ok", is_success(F.coalesce(F.col("status"), F.lit(0))))
    return rows.withColumn("error_message", F.when(~F.col("ok"), error_message(F.col("payload"), F.col("status_text"))))

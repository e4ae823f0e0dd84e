"""Column rules: friendly amounts, zone-free timestamps, payloads and errors of stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_decimal(x: Column) -> Column:
    """One decimal, by the exact binary value; ties, which only quarters can be, go away from zero."""
    tie = (x * 4) % 1 == 0
    return F.call_function("format_number", F.when(tie, F.round(x, 1)).otherwise(x), F.lit("0.0"))


def _whole(x: Column) -> Column:
    """No decimals; halves go away from zero, and the sign of a negative value stays."""
    size = F.abs(x)
    down = F.floor(size)
    n = F.when(size - down >= 0.5, down + 1).otherwise(down)
    return F.concat(F.when(x < 0, "-").otherwise(""), n.cast("string"))


def friendly_amount(amount: Column) -> Column:
    """Amounts (double) as people write them: 950, 1.4k, -2m. Null stays null."""
    x = amount.cast("double")

    def scaled(unit: float, letter: str) -> Column:
        q = x / F.lit(unit)
        return F.concat(F.when(q % 1 == 0, q.cast("long").cast("string")).otherwise(_one_decimal(q)), F.lit(letter))

    return F.when(F.abs(x) >= 1e6, scaled(1e6, "m")).when(F.abs(x) >= 1e3, scaled(1e3, "k")).when(x.isNotNull(), _whole(x))


def local_timestamp(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of the wall clock, fractions cut."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def parse_payload(responses: DataFrame, body: str = "body") -> DataFrame:
    """With payload (VARIANT), raw (text that is no JSON) and payload_kind: empty, json or raw."""
    text = F.col(body)
    rows = responses.withColumn("payload", F.try_parse_json(text))
    empty = text.isNull() | (text == "")
    kind = F.when(empty, "empty").when(F.col("payload").isNotNull(), "json").otherwise("raw")
    return rows.withColumn("payload_kind", kind).withColumn("raw", F.when(F.col("payload_kind") == "raw", text))


def error_message(payload: Column, status_text: Column) -> Column:
    """The payload's message if it has a true one, else the status text."""
    found = F.try_variant_get(payload, "$.message", "variant")
    told = F.to_json(found)
    # Zeros come in many spellings (-0, 0.00, 0e1); a string is never a number here.
    zero = ~F.startswith(told, F.lit('"')) & (F.coalesce(F.try_variant_get(payload, "$.message", "double"), F.lit(1.0)) == 0)
    false = told.isNull() | told.isin('""', "false", "null") | zero
    return F.when(false, status_text).otherwise(F.try_variant_get(payload, "$.message", "string"))


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes with their payload, errors with error_message) of responses(status, status_text, body)."""
    rows = parse_payload(responses)
    good = is_success(F.coalesce(F.col("status"), F.lit(0)))
    errors = rows.where(~good).withColumn("error_message", error_message(F.col("payload"), F.col("status_text")))
    return rows.where(good), errors

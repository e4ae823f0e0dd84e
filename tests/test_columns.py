"""Column rules, as batches and as streams."""

from decimal import ROUND_HALF_UP, Decimal
import random

from pyspark.sql import functions as F

from delimlake.functions import columns
from delimlake.streaming import stream_records, stream_responses

AMOUNTS = {
    0.0: "0", 0.5: "1", -0.4: "-0", -2.5: "-3", 999.49: "999", 999.5: "1000", 1000.0: "1k", 1250.0: "1.3k", 1450.0: "1.4k",
    -1450.0: "-1.4k", 999999.0: "1000.0k", 1e6: "1m", 1049999.99: "1.0m", 1250000.0: "1.3m", -2e6: "-2m",
}


def exact(x):
    size, unit, letter = abs(x), 1.0, ""
    if size >= 1e3:
        unit, letter = (1e6, "m") if size >= 1e6 else (1e3, "k")
        q = x / unit
        return f"{int(q)}{letter}" if q % 1 == 0 else f"{Decimal(q).quantize(Decimal('0.1'), ROUND_HALF_UP)}{letter}"
    return ("-" if x < 0 else "") + str(Decimal(size).quantize(Decimal("1"), ROUND_HALF_UP))


def test_friendly_amount(spark):
    rng = random.Random(1)
    more = [round(rng.uniform(-3e6, 3e6), rng.randrange(4)) for _ in range(3000)] + [rng.randrange(-4000, 4000) * 12.5 for _ in range(2000)]
    cases = AMOUNTS | {x: exact(x) for x in more}
    got = spark.createDataFrame([(x,) for x in cases], "x double").select("x", columns.friendly_amount(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in got} == cases
    assert spark.sql("select cast(null as double) x").select(columns.friendly_amount(F.col("x"))).first()[0] is None


def test_local_timestamp(spark):
    got = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.979575' t").select(columns.local_timestamp(F.col("t"))).first()[0]
    assert got == "2024-01-01 00:00:07"


BODIES = [
    (200, "", "empty", None), (200, '{"k": 1}', "json", None), (299, "<html>", "raw", None), (200, "null", "json", None),
    (500, '{"message":"no"}', "json", "no"), (500, '{"message":"0"}', "json", "0"), (500, '{"message":0}', "json", "st"),
    (500, '{"message":0e1}', "json", "st"), (500, '{"message":-0.0}', "json", "st"), (500, '{"message":"0.0"}', "json", "0.0"),
    (404, '{"message":""}', "json", "st"), (300, '{"x":1}', "json", "st"), (199, "[1]", "json", "st"), (500, "null", "json", "st"),
    (500, "<html>", "raw", "st"), (500, "", "empty", "st"), (500, None, "empty", "st"), (None, "x", "raw", "st"),
]


def test_responses(spark, tmp_path):
    table = spark.createDataFrame([(i, s, "st", b) for i, (s, b, _, _) in enumerate(BODIES)], "id int, status int, status_text string, body string")
    good, bad = columns.split_responses(table)
    kinds = {r["id"]: r["payload_kind"] for r in good.select("id", "payload_kind").union(bad.select("id", "payload_kind")).collect()}
    assert kinds == {i: k for i, (_, _, k, _) in enumerate(BODIES)}
    assert {r["id"]: r["error_message"] for r in bad.collect()} == {i: m for i, (_, _, _, m) in enumerate(BODIES) if m}
    assert good.where("payload_kind = 'raw'").first()["raw"] == "<html>"

    table.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = stream_responses(stream).select("id", "ok", "error_message").writeStream.format("memory").queryName("responses").start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["error_message"] for r in spark.sql("select * from responses where not ok").collect()}
    assert got == {i: m for i, (_, _, _, m) in enumerate(BODIES) if m}


def test_stream_of_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('a,"b,c"\n , \nd\\,e,f\n')
    stream = spark.readStream.text(f"file://{tmp_path}/in")
    q = stream_records(stream).select("cells").writeStream.format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["cells"] for r in spark.sql("select * from cells").collect()) == [["a", "b,c"], ["d,e", "f"]]

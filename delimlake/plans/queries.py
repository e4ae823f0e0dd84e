"""Queries over the driver's tables: rows are rendered as delimited text, parsed back
and compared with plain SQL on the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delimlake.functions import columns
from delimlake.operators import records, sections
from delimlake.plans.render import cents, line, number, quoted
from delimlake.sources import document_blocks, scan_lines
from delimlake.sources.lines import LINES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("status"),
        cents(F.col("o_totalprice")).alias("cents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


def _with_header(orders: DataFrame, *headers: tuple[int, str]) -> DataFrame:
    """Rows (o_custkey, part, key, line) of headers before each customer's lines; part orders them."""
    heads = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(text).alias("line")) for part, text in headers])
    return orders.select("o_custkey").distinct().select("o_custkey", F.inline(heads)).select("o_custkey", "part", F.lit(-1).cast("long").alias("o_orderkey"), "line")


def _customer_report(orders: DataFrame, text, *headers: tuple[int, str], part=None) -> DataFrame:
    body = orders.select("o_custkey", (F.lit(headers[0][0]) if part is None else part).alias("part"), "o_orderkey", text.alias("line"))
    rows = body.unionByName(_with_header(orders, *headers)) if headers[0][1] else body
    return number(rows, F.col("o_custkey"), F.col("part"), F.col("o_orderkey"), line=F.col("line"))


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    lines = _customer_report(orders, line("Orders", "Data", F.col("key"), F.col("status"), F.col("cents"), F.col("day")), (0, "Orders,Header,key,status,cents,day"))
    rows = sections.parse_report(lines).section_rows
    return rows.select("doc_id", *[F.col("row")[c].alias(c) for c in ("key", "status", "cents", "day")])


def header_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    odd = F.col("o_orderkey") % 2 == 1
    text = F.when(odd, line("Orders", "Data", F.col("key"), F.col("status"), F.col("cents"))).otherwise(line("Orders", "Data", F.col("cents"), F.col("key"), F.col("status")))
    lines = _customer_report(orders, text, (0, "Orders,Header,key,status,cents"), (1, "Orders,Header,cents,key,status"), part=F.when(odd, 0).otherwise(1))
    report = sections.parse_report(lines)
    heads = report.section_headers.select("doc_id", F.array_join("headers", "|").alias("headers"))
    rows = report.section_rows.select("doc_id", *[F.col("row")[c].alias(c) for c in ("key", "status", "cents")])
    return rows.join(heads, "doc_id")


def _status_sections(spark: SparkSession, sf_dir: str) -> sections.Report:
    return sections.parse_report(_customer_report(_orders(spark, sf_dir), line(F.col("status"), "Data", F.col("key")), (0, "")))


def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status_sections(spark, sf_dir).section_index


def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sections.section_names(_status_sections(spark, sf_dir).section_index)
    return names.select("doc_id", F.array_join("names", ",").alias("names"))


def has_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.has_section(_status_sections(spark, sf_dir).section_index, "F")


def get_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.get_section(_status_sections(spark, sf_dir).section_rows, "F")
    return rows.select("doc_id", F.col("row")["col_0"].alias("key"))


def totals_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).withColumn("n", F.col("cents").cast("long"))
    sums = orders.groupBy("o_custkey", "status").agg(F.sum("n").alias("n"))
    part = sums.select("o_custkey", F.lit(1).alias("part"), "status", line("Orders", "SubTotal", F.col("status"), F.col("n").cast("string")).alias("line"))
    whole = sums.groupBy("o_custkey").agg(F.sum("n").alias("n")).select("o_custkey", F.lit(2).alias("part"), F.lit("").alias("status"), line("Orders", "Total", "", F.col("n").cast("string")).alias("line"))
    head = sums.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("part"), F.lit("").alias("status"), F.lit("Orders,Header,label,cents").alias("line"))
    lines = number(part.union(whole).union(head), F.col("o_custkey"), F.col("part"), F.col("status"), line=F.col("line"))
    rows = sections.parse_report(lines).section_rows
    return rows.select("doc_id", "kind", F.col("row")["label"].alias("label"), F.col("row")["cents"].alias("cents"))


def section_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = _table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("Info,Notes,  ")).otherwise(line("Info", "notes", F.lower("c_mktsegment"), F.concat(F.lit(" "), F.col("c_name"))))
    notes = sections.parse_report(number(who, F.col("c_custkey"), F.col("c_custkey"), line=text)).section_notes
    return notes.select("doc_id", "section", "note")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("o_orderkey") % 4
    text = F.when(rule == 0, F.col("key")).when(rule == 1, line("", "Data", F.col("key"))).when(rule == 2, line("Orders", "Odd", F.col("key"))).otherwise(line("Orders", "Data", F.col("key")))
    rows = sections.parse_report(_customer_report(_orders(spark, sf_dir), text, (0, ""))).unparsed
    return rows.select("doc_id", F.array_join("cells", "|").alias("cells"))


def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("o_orderkey") % 3
    text = F.when(rule == 0, line("Orders", "Data", F.col("key"))).when(rule == 1, line("Orders", "Data", F.col("key"), F.col("status"))).otherwise(line("Orders", "Data", F.col("key"), F.col("status"), F.col("day")))
    rows = sections.parse_report(_customer_report(_orders(spark, sf_dir), text, (0, "Orders,Header,key,status")), raw=True).section_rows
    return rows.select("doc_id", "record_no", F.explode("row").alias("name", "value"))


def duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _customer_report(_orders(spark, sf_dir), line("Orders", "Data", F.col("key"), F.col("status"), F.col("cents")), (0, "Orders,Header,a,a,b"))
    rows = sections.parse_report(lines).section_rows
    return rows.select("doc_id", "record_no", F.explode("row").alias("name", "value"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it stands, with raw, escaped and unclosed quotes."""
    return _split(_table(spark, sf_dir, "documents"))


def split_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As split_documents, every document in blocks of a few lines, which records and quotes cross."""
    return _split(_table(spark, sf_dir, "documents"), lines=4)


def _split(docs: DataFrame, lines: int = LINES) -> DataFrame:
    rows = records.parse_records(document_blocks(docs, lines=lines))
    return rows.select("doc_id", "record_no", F.posexplode("cells").alias("cell_no", "cell"))


def split_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.concat(line("first", quoted(F.col("text")), "end"), F.lit("\n"), line(quoted(F.col("text")), "second"))
    rows = records.parse_records(document_blocks(docs.select("doc_id", text.alias("text"))), ",")
    return rows.select("doc_id", "record_no", F.posexplode("cells").alias("cell_no", "cell"))


def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    delim = F.element_at(F.array(F.lit("\t"), F.lit(","), F.lit("|")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit('"a,b|c\td"'), delim, F.col("key"), delim, F.col("status"))
    rows = records.parse_records(number(orders, F.col("o_orderkey"), F.col("o_orderkey"), line=text))
    return rows.select("doc_id", F.posexplode("cells").alias("cell_no", "cell"))


def one_large_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one document in blocks; each record spans two lines."""
    orders = _orders(spark, sf_dir)
    halves = F.array(F.concat(F.lit("Orders,Data,"), F.col("key"), F.lit(',"'), F.col("status")), F.concat(F.col("cents"), F.lit('",'), F.col("day")))
    lines = orders.select(F.lit("all").alias("doc_id"), "o_orderkey", F.posexplode(halves).alias("no", "line"))
    lines = lines.select("doc_id", F.floor(F.col("o_orderkey") / 5000).alias("block"), (F.col("o_orderkey") * 2 + F.col("no")).alias("line_no"), "line")
    rows = sections.parse_report(lines).section_rows
    return rows.select("doc_id", *[F.col("row")[f"col_{i}"].alias(c) for i, c in enumerate(("key", "told", "day"))])


def friendly_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, who = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    rows = rows.union(orders.select(F.concat(F.lit("l"), "o_orderkey"), F.col("o_totalprice") * 50))
    rows = rows.union(orders.select(F.concat(F.lit("r"), "o_orderkey"), F.round("o_totalprice", -3)))
    rows = rows.union(who.select(F.concat(F.lit("c"), "c_custkey"), F.col("c_acctbal")))
    return rows.select("id", columns.friendly_amount(F.col("x")).alias("amount"))


def local_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", columns.local_timestamp(F.col("ts")).alias("at"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored responses, their bodies damaged, emptied or turned into messages by key."""
    rule = F.col("event_id") % 7
    key = F.col("event_id").cast("string")
    body = (
        F.when(rule == 0, F.lit(""))
        .when(rule == 1, F.concat(F.lit("<html>"), key))
        .when(rule == 2, F.concat(F.lit('{"message":"no '), key, F.lit('"}')))
        .when(rule == 3, F.lit('{"message":0}'))
        .when(rule == 4, F.lit("null"))
        .when(rule == 5, F.lit('{"message":"0"}'))
        .otherwise(F.col("props"))
    )
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 299).otherwise(200)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.concat(F.lit("Status "), status.cast("string")).alias("status_text"), body.alias("body"))


def json_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns.parse_payload(_responses(spark, sf_dir))
    return rows.select("id", "payload_kind", F.try_variant_get("payload", "$.k", "bigint").alias("k"), "raw")


def split_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = columns.split_responses(_responses(spark, sf_dir))
    return good.select("id", F.lit("payload").alias("branch"), "payload_kind").union(bad.select("id", F.lit("error"), "payload_kind"))


def error_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.split_responses(_responses(spark, sf_dir))[1].select("id", "error_message")


def write_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by status, written a folder each to the shared folder and all read back."""
    path = _new_folder(spark, "sections")
    rows = _status_sections(spark, sf_dir).section_rows
    sections.write_sections(rows.select("doc_id", "section", F.col("row")["col_0"].alias("key")), path)
    return sections.read_sections(spark, path).select("doc_id", "section", "key")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all kinds of rows written at one go, and all five tables as they are read back."""
    rule = F.col("o_orderkey") % 5
    text = (
        F.when(rule == 0, line("Orders", "Data", F.col("key"), F.col("status")))
        .when(rule == 1, line("Orders", "Notes", F.col("key")))
        .when(rule == 2, line(F.col("status"), "Total", F.col("key")))
        .when(rule == 3, line("Orders", "Odd", F.col("key")))
        .otherwise(line("Orders", "SubTotal", F.col("key")))
    )
    path = _new_folder(spark, "report")
    sections.write_report(_customer_report(_orders(spark, sf_dir), text, (0, "Orders,Header,key,status")), path)
    report = sections.read_report(spark, path)
    none = F.lit(None)
    tables = (
        ("index", report.section_index, "section", "first_record_no", F.lit("")),
        ("headers", report.section_headers, "section", none, F.array_join("headers", "|")),
        ("rows", report.section_rows, "section", "record_no", F.concat("kind", F.lit(":"), F.coalesce(F.col("row")["key"], F.col("row")["col_0"]))),
        ("notes", report.section_notes, "section", "record_no", F.col("note")),
        ("unparsed", report.unparsed, none, "record_no", F.array_join("cells", "|")),
    )
    parts = [df.select(F.lit(name).alias("name"), "doc_id", (F.col(section) if isinstance(section, str) else section.cast("string")).alias("section"), (F.col(no) if isinstance(no, str) else no).cast("long").alias("record_no"), text.alias("text")) for name, df, section, no, text in tables]
    return reduce(DataFrame.union, parts)


def written_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of each report came back from every section folder."""
    return write_sections(spark, sf_dir).groupBy("doc_id", "section").agg(F.count("key").alias("n"), F.min("key").alias("least"))


def _new_folder(spark: SparkSession, kind: str) -> str:
    """A folder beside the checkpoints, which executors share; one of our own where that is unset and the session runs in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text files, a folder a status, and read back by file blocks; numbered says whether the
    lines of each file count from 0 without a gap."""
    path = _new_folder(spark, "lines")
    text = line(F.col("key"), F.concat(F.lit('"'), F.col("cents"), F.lit(","), F.col("day"), F.lit('"')))
    _orders(spark, sf_dir).select("status", text.alias("value")).write.partitionBy("status").text(path)
    lines = scan_lines(spark, path)
    whole = lines.groupBy("doc_id").agg(((F.max("line_no") == F.count("*") - 1) & (F.min("line_no") == 0)).alias("numbered"))
    rows = records.parse_records(lines, ",").join(whole, "doc_id")
    status = F.regexp_extract("doc_id", "status=([^/]*)/", 1)
    return rows.select(status.alias("status"), F.col("cells")[0].alias("key"), F.col("cells")[1].alias("told"), "numbered")


def swapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose row type comes first and whose section stands third."""
    text = line("Data", F.col("day"), F.col("status"), F.col("key"), F.col("cents"))
    lines = _customer_report(_orders(spark, sf_dir), text, (0, "Header,-,F,key,cents"))
    rows = sections.parse_report(lines, section_col=2, type_col=0).section_rows
    row = F.col("row")
    return rows.select("doc_id", "section", *[F.coalesce(row[c], row[f"col_{i}"]).alias(c) for i, c in enumerate(("key", "cents"))], F.map_contains_key("row", "key").alias("named"))


EVERY = (
    section_rows,
    header_change,
    section_index,
    section_names,
    has_section,
    get_section,
    totals_subtotals,
    section_notes,
    quarantine,
    ragged_rows,
    duplicate_headers,
    split_documents,
    split_whole_documents,
    split_quoted,
    detect_delimiter,
    one_large_document,
    friendly_amount,
    local_timestamp,
    json_or_raw,
    split_responses,
    error_message,
    write_sections,
    written_sections,
    written_report,
    scan_files,
    swapped_columns,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in EVERY}


_O = """o AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS day,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no
  FROM orders
)"""
_R = """r AS (
  SELECT event_id AS id, event_id % 7 AS rule, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 299 ELSE 200 END AS status, props FROM events
)"""
_TIE = "CASE WHEN (q * 4) % 1 = 0 THEN printf('%.1f', sign(q) * floor(abs(q) * 10 + 0.5) / 10) ELSE printf('%.1f', q) END"
# Marks of split_whole_documents: escaped backslash, quote, line break and delimiter; ends of cells and records.
_B, _Q, _N, _D, _CUT, _END = (f"chr({0xFDD0 + i})" for i in range(6))
_SPACES = " || ".join(f"chr({x})" for x in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))

SQL = {
    "section_rows": f"WITH {_O} SELECT doc_id, key, status, cents, day FROM o",
    "header_change": f"WITH {_O} SELECT doc_id, key, status, cents, 'key|status|cents' AS headers FROM o",
    "section_index": f"WITH {_O} SELECT doc_id, status AS section, min(no) - 1 AS first_record_no FROM o GROUP BY ALL",
    "section_names": f"WITH {_O}, f AS (SELECT doc_id, status, min(no) AS no FROM o GROUP BY ALL) SELECT doc_id, string_agg(status, ',' ORDER BY no) AS names FROM f GROUP BY doc_id",
    "has_section": f"WITH {_O} SELECT doc_id, bool_or(status = 'F') AS has_section FROM o GROUP BY doc_id",
    "get_section": f"WITH {_O} SELECT doc_id, key FROM o WHERE status = 'F'",
    "totals_subtotals": f"""WITH {_O}
SELECT doc_id, 'subtotal' AS kind, status AS label, CAST(sum(CAST(cents AS BIGINT)) AS VARCHAR) AS cents FROM o GROUP BY doc_id, status
UNION ALL SELECT doc_id, 'total', '', CAST(sum(CAST(cents AS BIGINT)) AS VARCHAR) FROM o GROUP BY doc_id""",
    "section_notes": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'Info' AS section, lower(c_mktsegment) || ',' || c_name AS note FROM customer WHERE c_custkey % 5 <> 0",
    "quarantine": f"WITH {_O} SELECT doc_id, CASE o_orderkey % 4 WHEN 1 THEN '|Data|' || key ELSE 'Orders|Odd|' || key END AS cells FROM o WHERE o_orderkey % 4 IN (1, 2)",
    "ragged_rows": f"""WITH {_O}
SELECT doc_id, no AS record_no, 'key' AS name, key AS value FROM o
UNION ALL SELECT doc_id, no, 'status', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE status END FROM o
UNION ALL SELECT doc_id, no, 'col_2', day FROM o WHERE o_orderkey % 3 = 2
UNION ALL SELECT doc_id, no, '_raw', CASE o_orderkey % 3 WHEN 0 THEN '["' || key || '"]' WHEN 1 THEN '["' || key || '","' || status || '"]' ELSE '["' || key || '","' || status || '","' || day || '"]' END FROM o""",
    "duplicate_headers": f"WITH {_O} SELECT doc_id, no AS record_no, 'a' AS name, status AS value FROM o UNION ALL SELECT doc_id, no, 'b', cents FROM o",
    # Pieces between quotes that count: every second one is quoted.
    "split_whole_documents": f"""WITH a AS (
  SELECT row_number() OVER () AS k, CAST(doc_id AS VARCHAR) AS doc_id, text,
         coalesce(nullif(regexp_extract(array_to_string(list_filter(string_split(string_split(text, chr(10))[1], '"'), lambda x, i: i % 2 = 1), ''), '[\\t,|]'), ''), ',') AS delim
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT k, doc_id, delim, string_split(replace(replace(replace(replace(replace(text, '\\\\', {_B}), '\\"', {_Q}), '\\' || chr(10), {_N}), '\\' || delim, {_D}), '\\', ''), '"') AS ps FROM a
), p AS (
  SELECT k, doc_id, delim, unnest(range(len(ps))) AS i, unnest(ps) AS s FROM b
), q AS (
  SELECT *, i % 2 = 1 AS quoted, strpos(s, chr(10)) AS br, right(lag(s) OVER (PARTITION BY k ORDER BY i), 1) IN (chr(10), {_N}) AS opens FROM p
), f AS (
  SELECT *, max(CASE WHEN quoted AND opens THEN i END) OVER (PARTITION BY k ORDER BY i) AS opened,
         max(CASE WHEN quoted AND br > 0 THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS folded FROM q
), t AS (
  SELECT k, doc_id, delim, i, CASE WHEN NOT quoted THEN replace(replace(s, delim, {_CUT}), chr(10), {_END})
         WHEN br > 0 AND opened > coalesce(folded, -1) THEN substr(s, 1, br) || replace(substr(s, br + 1), chr(10), ' ')
         ELSE replace(s, chr(10), ' ') END AS s FROM f
), r AS (
  SELECT doc_id, delim, string_split(string_agg(s, '' ORDER BY i), {_END}) AS rs FROM t GROUP BY k, doc_id, delim
), l AS (
  SELECT doc_id, delim, unnest(range(len(rs))) AS record_no, unnest(rs) AS line FROM r
), c AS (
  SELECT doc_id, record_no, list_transform(string_split(line, {_CUT}), lambda x: trim(replace(replace(replace(replace(x, {_B}, '\\'), {_Q}, '"'), {_N}, chr(10)), {_D}, delim), {_SPACES})) AS cells FROM l
)
SELECT doc_id, record_no, CAST(unnest(range(len(cells))) AS INTEGER) AS cell_no, unnest(cells) AS cell FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0""",
    "split_quoted": """WITH d AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS t, strpos(coalesce(text, ''), chr(10)) AS p FROM documents
), e AS (
  SELECT doc_id, trim(replace(t, chr(10), ' ')) AS folded,
         trim(CASE WHEN p > 0 THEN substr(t, 1, p) || replace(substr(t, p + 1), chr(10), ' ') ELSE t END, ' ' || chr(10)) AS kept FROM d
)
SELECT doc_id, 0 AS record_no, 0 AS cell_no, 'first' AS cell FROM e UNION ALL SELECT doc_id, 0, 1, folded FROM e UNION ALL SELECT doc_id, 0, 2, 'end' FROM e
UNION ALL SELECT doc_id, 1, 0, kept FROM e UNION ALL SELECT doc_id, 1, 1, 'second' FROM e""",
    "detect_delimiter": """WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status FROM orders)
SELECT doc_id, 0 AS cell_no, 'a,b|c' || chr(9) || 'd' AS cell FROM k UNION ALL SELECT doc_id, 1, doc_id FROM k UNION ALL SELECT doc_id, 2, status FROM k""",
    "one_large_document": f"WITH {_O} SELECT 'all' AS doc_id, key, status || ' ' || cents AS told, day FROM o",
    "friendly_amount": f"""WITH x AS (
  SELECT 'o' || o_orderkey AS id, o_totalprice AS x FROM orders UNION ALL SELECT 'l' || o_orderkey, o_totalprice * 50 FROM orders
  UNION ALL SELECT 'r' || o_orderkey, round(o_totalprice, -3) FROM orders UNION ALL SELECT 'c' || c_custkey, c_acctbal FROM customer
), y AS (
  SELECT id, x, CASE WHEN abs(x) >= 1e6 THEN x / 1e6 ELSE x / 1e3 END AS q, CASE WHEN abs(x) >= 1e6 THEN 'm' ELSE 'k' END AS letter FROM x
)
SELECT id, CASE WHEN abs(x) >= 1e3 THEN CASE WHEN q % 1 = 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE {_TIE} END || letter
       ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs(x)) + CASE WHEN abs(x) - floor(abs(x)) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR) END AS amount FROM y""",
    "local_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "json_or_raw": f"""WITH {_R}
SELECT id, CASE rule WHEN 0 THEN 'empty' WHEN 1 THEN 'raw' ELSE 'json' END AS payload_kind,
       CASE WHEN rule = 6 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN rule = 1 THEN '<html>' || id END AS raw FROM r""",
    "split_responses": f"WITH {_R} SELECT id, CASE status WHEN 500 THEN 'error' ELSE 'payload' END AS branch, CASE rule WHEN 0 THEN 'empty' WHEN 1 THEN 'raw' ELSE 'json' END AS payload_kind FROM r",
    "error_message": f"WITH {_R} SELECT id, CASE rule WHEN 2 THEN 'no ' || id WHEN 5 THEN '0' ELSE 'Status 500' END AS error_message FROM r WHERE status = 500",
    "write_sections": f"WITH {_O} SELECT doc_id, status AS section, key FROM o",
    "written_sections": f"WITH {_O} SELECT doc_id, status AS section, count(*) AS n, min(key) AS least FROM o GROUP BY ALL",
    "written_report": f"""WITH {_O}, s AS (SELECT doc_id, status, min(no) AS no FROM o WHERE o_orderkey % 5 = 2 GROUP BY ALL)
SELECT DISTINCT 'index' AS name, doc_id, 'Orders' AS section, CAST(0 AS BIGINT) AS record_no, '' AS text FROM o UNION ALL SELECT 'index', doc_id, status, no, '' FROM s
UNION ALL SELECT DISTINCT 'headers', doc_id, 'Orders', NULL, 'key|status' FROM o UNION ALL SELECT 'headers', doc_id, status, NULL, '' FROM s
UNION ALL SELECT 'rows', doc_id, CASE o_orderkey % 5 WHEN 2 THEN status ELSE 'Orders' END, no, CASE o_orderkey % 5 WHEN 0 THEN 'data:' WHEN 2 THEN 'total:' ELSE 'subtotal:' END || key FROM o WHERE o_orderkey % 5 IN (0, 2, 4)
UNION ALL SELECT 'notes', doc_id, 'Orders', no, key FROM o WHERE o_orderkey % 5 = 1
UNION ALL SELECT 'unparsed', doc_id, NULL, no, 'Orders|Odd|' || key FROM o WHERE o_orderkey % 5 = 3""",
    "scan_files": f"WITH {_O} SELECT status, key, cents || ',' || day AS told, true AS numbered FROM o",
    "swapped_columns": f"WITH {_O} SELECT doc_id, status AS section, key, cents, status = 'F' AS named FROM o",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {"split_documents": SQL["split_whole_documents"]}

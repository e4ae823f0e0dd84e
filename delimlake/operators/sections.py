"""Multi-section reports: records whose cells name a section and a row type.

``route_rows`` gives every record one kind; the tables of a report are filters
over it. A data, total or subtotal row takes its names from the latest header
above it in its section.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delimlake.operators.records import KEYS, block_states, cut_records, parse_records, several_blocks, stitch, stitch_blocks, trim

#: Row types, by their lower-case names; a row of any other type is quarantined.
TYPES = ("header", "data", "total", "subtotal", "notes")
ROWS = ("data", "total", "subtotal")
RAW = "_raw"


@dataclass
class Report:
    """The tables of a set of reports."""

    section_index: DataFrame
    section_headers: DataFrame
    section_rows: DataFrame
    section_notes: DataFrame
    unparsed: DataFrame


def route_rows(records: DataFrame, section_col: int = 0, type_col: int = 1) -> DataFrame:
    """(doc_id, block, blocks, record_no, cells, section, kind, payload); kind is a row type, 'other' or 'unkeyed'.

    Records of fewer than two cells are left out. The columns count from 0; the
    payload is what follows the later of the two.
    """
    if section_col < 0 or type_col < 0:
        raise ValueError("columns count from 0")
    at = max(section_col, type_col) + 2
    rows = records.where(F.size("cells") >= 2)
    rows = rows.withColumns({"section": F.get("cells", F.lit(section_col)), "type": F.get("cells", F.lit(type_col))})
    blank = (F.coalesce("section", F.lit("")) == "") | (F.coalesce("type", F.lit("")) == "")
    # The names of TYPES have no other upper case than that of A-Z.
    name = F.translate("type", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = F.when(blank, "unkeyed").when(name.isin(*TYPES), name).otherwise("other")
    payload = F.slice("cells", F.lit(at), F.greatest(F.size("cells") - at + 1, F.lit(0)))
    return rows.select("doc_id", "block", "blocks", "record_no", "cells", "section", kind.alias("kind"), payload.alias("payload"))


def section_index(routed: DataFrame) -> DataFrame:
    """(doc_id, section, first_record_no): sections in the order in which they are first named."""
    return routed.where("kind <> 'unkeyed'").groupBy("doc_id", "section").agg(F.min("record_no").alias("first_record_no"))


def section_headers(routed: DataFrame) -> DataFrame:
    """(doc_id, section, headers): the first header that is not empty, else an empty list."""
    some = F.when((F.col("kind") == "header") & (F.size("payload") > 0), F.col("record_no"))
    got = routed.where("kind <> 'unkeyed'").groupBy("doc_id", "section").agg(F.min_by("payload", some).alias("headers"))
    return got.withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))


def bind_headers(routed: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """routed with names: for data, total and subtotal rows the payload of the latest header above them (null if none).

    Rows look for it in their block; each block is handed the latest header of
    the blocks before it, a row a section. heads: the routed header rows, where
    they are known more cheaply than from routed.
    """
    heads = (routed if heads is None else heads).where("kind = 'header'")
    last = heads.groupBy("doc_id", "section", "block").agg(F.max_by("payload", "record_no").alias("carried"), F.first("blocks").alias("blocks"))
    until = F.coalesce(F.lead("block").over(Window.partitionBy("doc_id", "section").orderBy("block")), F.col("blocks") - 1)
    last = last.select("doc_id", "section", "carried", F.col("block").alias("since"), until.alias("until")).where("until > since")
    last = last.select("doc_id", "section", "carried", F.explode(F.sequence(F.col("since") + 1, F.col("until"))).alias("block"))
    keys = ["doc_id", "block", "section"]
    named = F.when(F.col("kind") == "header", F.col("payload"))
    above = Window.partitionBy(*keys).orderBy("record_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = routed.withColumn("names", F.last(named, ignorenulls=True).over(above)).join(last, keys, "left")
    return rows.withColumn("names", F.when(F.col("kind").isin(*ROWS), F.coalesce("names", "carried"))).drop("carried")


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def row_map(names: Column, values: Column, raw: bool = False) -> Column:
    """Names to values, to the longer length: col_i for a missing or blank name, '' for a missing
    value; of a repeated name the last value stays. raw adds the values as JSON under _raw."""
    names, values_ = (F.coalesce(c, F.array().cast("array<string>")) for c in (names, values))
    pairs = F.arrays_zip(names.alias("k"), values_.alias("v"))  # as long as the longer one
    named = lambda k, i, v: F.struct(k.alias("k"), i.alias("i"), v.alias("v"))
    cell = lambda p, i: named(F.when(p["k"] != "", p["k"]).otherwise(F.concat(F.lit("col_"), i.cast("string"))), i, F.coalesce(p["v"], F.lit("")))
    cells = F.transform(pairs, cell)
    if raw:
        cells = F.concat(cells, F.array(named(F.lit(RAW), F.size(pairs), F.to_json(values))))
    ks = lambda cs: F.transform(cs, lambda c: c["k"])
    pick = lambda cs: F.map_from_arrays(ks(cs), F.transform(cs, lambda c: c["v"]))
    # Of each name the last place: the cells by name and place, where the next has another name.
    last = lambda cs: F.filter(cs, lambda c, i: F.coalesce(F.get(cs, i + 1)["k"] != c["k"], F.lit(True)))
    unique = lambda cs: _once(_once(F.sort_array(cs), last), pick)
    return _once(cells, lambda cs: F.when(F.size(F.array_distinct(ks(cs))) == F.size(cs), pick(cs)).otherwise(unique(cs)))


def section_rows(bound: DataFrame, raw: bool = False) -> DataFrame:
    """(doc_id, section, record_no, kind, row, raw): data, total and subtotal rows, with names, as maps."""
    rows = bound.where(F.col("kind").isin(*ROWS))
    # A generator: what later steps ask of a row (and the filters Spark adds to theirs) doesn't make its map again.
    row = F.explode(F.array(row_map(F.col("names"), F.col("payload"), raw)))
    return rows.select("doc_id", "section", "record_no", "kind", row.alias("row"), F.to_json("payload").alias("raw"))


def section_notes(routed: DataFrame) -> DataFrame:
    """(doc_id, section, record_no, note); blank notes are left out."""
    notes = routed.where("kind = 'notes'").select("doc_id", "section", "record_no", trim(F.array_join("payload", ",")).alias("note"))
    return notes.where("note <> ''")


def unparsed(routed: DataFrame) -> DataFrame:
    """(doc_id, record_no, cells): records without section or type, or of unknown type."""
    return routed.where(F.col("kind").isin("unkeyed", "other")).select("doc_id", "record_no", "cells")


def _may_be_header(text: Column) -> Column:
    """Whether a record's text can have a cell 'header', before it is cut: quotes and backslashes are not part of cells."""
    return F.contains(F.lower(F.translate(text, '"\\', "")), F.lit("header"))


def bound_records(lines: DataFrame, section_col: int = 0, type_col: int = 1) -> DataFrame:
    """The routed records of comma-delimited reports, with the names of their rows (see route_rows and bind_headers)."""
    routed = route_rows(cut_records(stitch(lines, ",")), section_col, type_col)
    # Headers that other blocks may need: of all blocks but the last, and the parts of records that go on.
    lines = lines.where("doc_id is not null and block is not null")
    lines = lines.join(several_blocks(lines), KEYS, "left_semi")
    earlier = stitch_blocks(lines, block_states(lines, ",").where("no < blocks - 1 or home < no"))
    heads = route_rows(cut_records(earlier.where(_may_be_header(F.col("text")))), section_col, type_col)
    # Both sides of a join come from the same lines: one has columns of its own.
    return bind_headers(routed, heads.select(*[F.col(c).alias(c) for c in heads.columns]))


def tables_of(bound: DataFrame, raw: bool = False) -> Report:
    """The tables of bound records."""
    return Report(section_index(bound), section_headers(bound), section_rows(bound, raw), section_notes(bound), unparsed(bound))


def parse_report(lines: DataFrame, section_col: int = 0, type_col: int = 1, raw: bool = False) -> Report:
    """All tables of comma-delimited reports of any size, lazily. Several of them are written at one go by write_report.

    Tables other than section_rows don't bind headers.
    """
    routed = route_rows(parse_records(lines, ","), section_col, type_col)
    bound = bound_records(lines, section_col, type_col)
    return Report(section_index(routed), section_headers(routed), section_rows(bound, raw), section_notes(routed), unparsed(routed))


def folder_of(section: Column) -> Column:
    """A folder name for a section: its plain characters, and a digest that tells it from all others."""
    plain = F.substring(F.regexp_replace(section, "[^A-Za-z0-9]+", "-"), 1, 40)
    return F.concat(F.lit("s-"), plain, F.lit("-"), F.substring(F.md5(section), 1, 12))


#: What a written report holds; its folders are kind and folder.
WRITTEN = "doc_id string, record_no long, section string, cells array<string>, payload array<string>, names array<string>, kind string, folder string"


def write_report(lines: DataFrame, path: str, section_col: int = 0, type_col: int = 1, mode: str = "error") -> None:
    """Parse comma-delimited reports and write all their tables at one go, as Parquet by kind and section.

    A large section is split over several files and small ones share a task:
    partitions are balanced as they are written. Quarantined records keep all
    their cells, and stand in one folder a kind; the others keep what their
    tables need.
    """
    rows = bound_records(lines, section_col, type_col)
    astray = F.col("kind").isin("unkeyed", "other")
    rows = rows.select(
        "doc_id", "record_no", "section",
        F.when(astray, F.col("cells")).alias("cells"),
        F.when(~astray, F.col("payload")).alias("payload"),
        "names", "kind",
        F.when(astray, F.lit("s-")).otherwise(folder_of(F.col("section"))).alias("folder"),
    )
    rows.hint("rebalance", "kind", "folder").write.mode(mode).partitionBy("kind", "folder").parquet(path)


def read_report(spark: SparkSession, path: str, raw: bool = False) -> Report:
    """The tables that write_report has written; each reads the kinds it needs."""
    return tables_of(spark.read.schema(WRITTEN).parquet(path), raw)


def get_section(table: DataFrame, name: str) -> DataFrame:
    """The rows of one section; none where it is absent."""
    return table.where(F.col("section") == name)


def section_names(index: DataFrame) -> DataFrame:
    """(doc_id, names) in the order in which a document first names them."""
    pairs = F.array_sort(F.collect_list(F.struct("first_record_no", "section")))
    return index.groupBy("doc_id").agg(F.transform(pairs, lambda x: x["section"]).alias("names"))


def has_section(index: DataFrame, name: str) -> DataFrame:
    """(doc_id, has_section) of every document that has any section."""
    return index.groupBy("doc_id").agg(F.bool_or(F.col("section") == name).alias("has_section"))


def write_sections(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write a section table as Parquet, a folder a section (see folder_of); large sections are split, small ones share a task."""
    rows = rows.withColumn("folder", folder_of(F.col("section")))
    rows.hint("rebalance", "folder").write.mode(mode).partitionBy("folder").parquet(path)


def read_sections(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A section table that write_sections has written, or one section of it, of which alone the files are read."""
    rows = spark.read.parquet(path)
    if name is not None:
        rows = rows.where((F.col("folder") == folder_of(F.lit(name))) & (F.col("section") == name))
    return rows.drop("folder")

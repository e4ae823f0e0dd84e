"""Reports: the sample, the edge cases, blocks of any size, and written reports."""

import time

import pytest
from pyspark.sql import functions as F

from delimlake.operators import sections
from delimlake.sources import document_lines

SAMPLE = """Harbour,Header,Quay,Depth,Opened
Harbour,Data,North,11.5,"May 3, 1987"
Harbour,Data,South,7,"June 12, 2004"
Crew,Header,Name,Hours
Crew,Data,Ida,38
Crew,SubTotal,deck,38
Crew,Total,all,61
Crew,Notes,hours, per week
"""


def report(spark, text, lines=10_000, **options):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return sections.parse_report(document_lines(docs, lines=lines), **options)


def rows(r):
    return [(x["kind"], x["row"]) for x in r.section_rows.orderBy("record_no").collect()]


def test_sample(spark):
    r = report(spark, SAMPLE)
    assert sections.section_names(r.section_index).first()["names"] == ["Harbour", "Crew"]
    got = rows(r)
    assert got[0] == ("data", {"Quay": "North", "Depth": "11.5", "Opened": "May 3, 1987"})
    assert got[2:] == [("data", {"Name": "Ida", "Hours": "38"}), ("subtotal", {"Name": "deck", "Hours": "38"}), ("total", {"Name": "all", "Hours": "61"})]
    assert [k for k, _ in got] == ["data", "data", "data", "subtotal", "total"]
    assert [x["note"] for x in r.section_notes.collect()] == ["hours,per week"]
    assert r.unparsed.count() == 0
    assert sections.get_section(r.section_rows, "Harbour").count() == 2
    assert sections.get_section(r.section_rows, "Absent").count() == 0
    assert sections.has_section(r.section_index, "Crew").first()["has_section"]
    assert not sections.has_section(r.section_index, "crew").first()["has_section"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("X,DATA,1", [{"col_0": "1"}]),
        ("X,Data", [{}]),
        ("X,Header,a,b\nX,Data,1", [{"a": "1", "b": ""}]),
        ("X,Header,a\nX,Data,1,2", [{"a": "1", "col_1": "2"}]),
        ("X,Header,a,,c\nX,Data,1,2,3", [{"a": "1", "col_1": "2", "c": "3"}]),
        ("X,Header,a,a\nX,Data,1,2", [{"a": "2"}]),
        ("X,Header,a\nX,Data,1\nX,Header,b\nX,Data,2", [{"a": "1"}, {"b": "2"}]),
    ],
)
def test_row_objects(spark, text, want):
    assert [m for _, m in rows(report(spark, text))] == want
    assert [m for _, m in rows(report(spark, text, lines=1))] == want


def test_routes(spark):
    r = report(spark, "X\nX,\n,Data,1\nY,Foo,1\nx,Data,1\nX,Data,1\nZ,Notes,  \nW,Header\nW,Header,a")
    assert [x["cells"] for x in r.unparsed.orderBy("record_no").collect()] == [["X", ""], ["", "Data", "1"], ["Y", "Foo", "1"]]
    assert sections.section_names(r.section_index).first()["names"] == ["Y", "x", "X", "Z", "W"]
    assert r.section_notes.count() == 0
    heads = {x["section"]: x["headers"] for x in r.section_headers.collect()}
    assert heads["W"] == ["a"] and heads["Y"] == []


def test_raw_and_columns(spark):
    r = report(spark, "X,Header,a\nX,Data,1,b", raw=True)
    assert rows(r)[0][1] == {"a": "1", "col_1": "b", "_raw": '["1","b"]'}
    assert rows(report(spark, "Data,X,7", section_col=1, type_col=0)) == [("data", {"col_0": "7"})]


def test_written_sections(spark, tmp_path):
    r = report(spark, SAMPLE)
    sections.write_sections(r.section_rows, f"file://{tmp_path}/out")
    assert sections.read_sections(spark, f"file://{tmp_path}/out", "Crew").count() == 3
    assert sections.read_sections(spark, f"file://{tmp_path}/out").count() == 5


def all_rows(r):
    return {name: sorted(map(str, getattr(r, name).collect())) for name in ("section_index", "section_headers", "section_rows", "section_notes", "unparsed")}


def test_blocks_do_not_matter(spark):
    """Headers, quotes and records that cross blocks, in blocks of one line up to the whole text."""
    text = 'X\nA,Header,"p\nq",r\nA,Data,1,"2\n\n3"\nB,Data,4\n"A",da"t"a,5\nB,HEAD\\ER,s\nA,Total,6\nB,Data,7\n,Data,8\nA,Header,t\nC,Odd\nB,SubTotal,9\nA,Data,"10\n'
    want = all_rows(report(spark, text))
    assert len(want["section_rows"]) == 7 and "p q" in str(want["section_headers"]) and "'s': '7'" in " ".join(want["section_rows"])
    for lines in (1, 2, 5):
        assert all_rows(report(spark, text, lines=lines)) == want


def test_written_report(spark, tmp_path):
    names = ["007", "a/b", "a b", "A B", "é", "__HIVE_DEFAULT_PARTITION__", "x" * 300, "2024-01-01"]
    text = SAMPLE + "".join(f"{n},Header,h\n{n},Data,{i}\n{n},Notes,of {i}\n" for i, n in enumerate(names)) + "Crew,Odd,1\n,Data,2\nCrew,\n"
    docs = spark.createDataFrame([("d", text), ("e", SAMPLE), ("f", ""), (None, None)], "doc_id string, text string")
    lines = document_lines(docs, lines=3)
    for raw in (False, True):
        path = f"file://{tmp_path}/{raw}"
        sections.write_report(lines, path)
        assert all_rows(sections.read_report(spark, path, raw)) == all_rows(sections.parse_report(lines, raw=raw))
    sections.write_report(document_lines(docs.limit(0)), f"file://{tmp_path}/none")
    assert not any(all_rows(sections.read_report(spark, f"file://{tmp_path}/none")).values())


def test_large_sections_are_split_and_small_ones_share_tasks(spark, tmp_path):
    rows = spark.range(0, 200_000, numPartitions=8).selectExpr("cast(id as string) as doc_id", "if(id % 3 > 0, 'hot', concat('s', id % 40)) as section", "repeat(md5(string(id)), 4) as v")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sections.write_sections(rows, f"file://{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").iterdir() if d.is_dir()}
    hot = next(n for name, n in files.items() if name.startswith("folder=s-hot-"))
    assert len(files) == 41 and hot > 3 and sum(files.values()) - hot < 120  # not one a task and section
    one = sections.read_sections(spark, f"file://{tmp_path}/out", "s7")
    assert one.columns == ["doc_id", "section", "v"] and {r["section"] for r in one.collect()} == {"s7"}
    assert "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().executedPlan().toString()


def test_wide_rows(spark):
    """Thousands of columns, distinct and repeated, in linear time."""
    n = 4000
    for names in ([f"c{i}" for i in range(n)], [f"c{i % 1500}" for i in range(n)]):
        df = spark.createDataFrame([(names, [str(i) for i in range(n + 2)])] * 20, "names array<string>, vals array<string>")
        want = dict(zip(names, map(str, range(n)))) | {f"col_{n}": str(n), f"col_{n + 1}": str(n + 1)}
        start = time.perf_counter()
        got = df.select(sections.row_map(F.col("names"), F.col("vals")).alias("m")).collect()
        assert all(r["m"] == want for r in got) and time.perf_counter() - start < 20


def test_no_documents(spark):
    r = report(spark, "")
    for t in (r.section_index, r.section_headers, r.section_rows, r.section_notes, r.unparsed):
        assert t.count() == 0


def test_written_sections_are_all_read_back(spark, tmp_path):
    from delimlake.plans import queries

    rows = [(1, 10, "F"), (1, 11, "O"), (2, 12, "P"), (2, 13, "F")]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string")
    orders.selectExpr("*", "1.5D as o_totalprice", "timestamp_ntz'2024-01-01' as o_orderdate").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = queries.write_sections(spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in got.select("doc_id", "section", "key").collect()) == sorted((str(c), s, str(k)) for c, k, s in rows)
    assert {(r["doc_id"], r["section"]): r["n"] for r in queries.written_sections(spark, f"file://{tmp_path}").collect()} == {("1", "F"): 1, ("1", "O"): 1, ("2", "P"): 1, ("2", "F"): 1}


def test_documents_of_one_block_are_parsed_where_they_stand(spark):
    """No join is left for them in the plan that ran, and what Spark asks of a row's map doesn't make it again."""
    texts = [("d", "X,Header,a,a,b\nX,Data,1,2,3"), ("e", 'X,Data,"1\n2",3')]
    lines = document_lines(spark.createDataFrame(texts, "doc_id string, text string"))
    found = sections.parse_report(lines).section_rows.select("doc_id", F.explode("row"))
    assert sorted(map(tuple, found.collect())) == [("d", "a", "2"), ("d", "b", "3"), ("e", "col_0", "1 2"), ("e", "col_1", "3")]
    ran = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in ran
    assert sum("map_from_arrays" in x for x in ran.split("\n")) == 1

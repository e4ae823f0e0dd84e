"""Records: the listed edge cases, and random texts in blocks of any size against a character scan."""

import random

import pytest
from pyspark.sql import functions as F

from delimlake.operators import records
from delimlake.sources import document_blocks, document_lines, scan_documents, scan_lines

CASES = [
    ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    ("a,b", [["a", "b"]]),
    ("a,", [["a", ""]]),
    ('"a,b",c\n', [["a,b", "c"]]),
    ("a\\,b,c\n", [["a,b", "c"]]),
    ("a\\nb,c\n", [["anb", "c"]]),
    ("a\\", [["a"]]),
    ("a\\\nb,c\n", [["a\nb", "c"]]),
    ('"x""y",z\n', [["xy", "z"]]),
    ('ab"c,d"e,f\n', [["abc,de", "f"]]),
    ('k,"l1\nl2\nl3"\n', [["k", "l1 l2 l3"]]),
    ('"l1\nl2",z\n', [["l1 l2", "z"]]),
    ('h\n"l1\nl2\nl3",z\n', [["h"], ["l1\nl2 l3", "z"]]),
    ('h\n"p",q\nr,"s\nt\nu"\n', [["h"], ["p", "q"], ["r", "s\nt u"]]),
    ('"a,b\nc', [["a,b c"]]),
    ("a,b\r\n1,2\r\n", [["a", "b"], ["1", "2"]]),
    ('  " x " ,y\n', [["x", "y"]]),
    ("\u00a0a\ufeff,b\n", [["a", "b"]]),
    ("a\n\n , \nb\n", [["a"], ["b"]]),
    ("", []),
    (None, []),
]


def scan(text, delim=","):
    """The records of a text, character by character."""
    space = " \t\n\x0b\f\r\u00a0\ufeff"
    rows, row, cell, quoted, keep = [], [], "", False, False
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            cell += text[i + 1 : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
            keep = keep or (quoted and i > 0 and text[i - 1] == "\n")
        elif c == delim and not quoted:
            row, cell = [*row, cell], ""
        elif c == "\n" and quoted:
            cell, keep = cell + ("\n" if keep else " "), False
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        else:
            cell += c
        i += 1
    rows = [[x.strip(space) for x in r] for r in [*rows, [*row, cell]]]
    return [r for r in rows if any(r)]


def parsed(spark, texts, delim=",", cut=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = document_lines(docs)
    if cut:
        lines = lines.withColumn("block", F.floor(F.col("line_no") / cut))
    got = {i: [] for i in range(len(texts))}
    for r in records.parse_records(lines, delim).orderBy("doc_id", "record_no").collect():
        got[int(r["doc_id"])].append(r["cells"])
    return [got[i] for i in range(len(texts))]


def test_edge_cases(spark):
    assert parsed(spark, [t for t, _ in CASES]) == [want for _, want in CASES]


def test_random_texts_in_any_blocks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab,"\n\\ \r') for _ in range(rng.randrange(1, 24))) for _ in range(1500)]
    want = [scan(t) for t in texts]
    assert parsed(spark, texts) == want
    for cut in (1, 2, 3):
        assert parsed(spark, texts, cut=cut) == want


def test_delimiters(spark):
    lines = ["a\tb,c", "a,b\tc", "a|b", '"a,b"|c', "abc", ""]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(records.detect_delimiter(F.col("t"))).collect()
    assert [r[0] for r in got] == ["\t", ",", "|", "|", ",", ","]
    assert parsed(spark, ["a|b,c\nd|e", "x\ty"], None) == [[["a", "b,c"], ["d", "e"]], [["x", "y"]]]
    assert parsed(spark, ["a|b,c\nd|e", "x\ty"], None, cut=1) == [[["a", "b,c"], ["d", "e"]], [["x", "y"]]]
    assert parsed(spark, ["a;;b"], ";;") == [[["a;;b"]]]
    with pytest.raises(ValueError):
        records.parse_records(None, "\n")


def test_reserved_marks_are_refused(spark):
    with pytest.raises(Exception, match="reserved"):
        parsed(spark, ["a\ufdd0b"])


def test_files(spark, tmp_path):
    text = "".join(f'{i},"v\n{i}"\n' for i in range(500))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("x|y\r\n1|2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lines = scan_lines(spark, f"file://{tmp_path}")
        assert lines.select("block").distinct().count() > 3
        got = records.parse_records(lines).where("doc_id like '%a.csv'").orderBy("record_no").collect()
        assert [r["cells"] for r in got] == [[str(i), f"v {i}"] for i in range(500)]
        other = records.parse_records(lines).where("doc_id like '%b.csv'").orderBy("record_no").collect()
        assert [r["cells"] for r in other] == [["x", "y"], ["1", "2"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert scan_documents(spark, f"file://{tmp_path}").count() == 2


def test_lines_are_numbered_without_an_exchange(spark, tmp_path):
    """Several small files in one task, one large one in many blocks; lines cross the cluster in neither case."""
    texts = {"a.txt": "".join(f"line {i}\n" for i in range(900)), "b.txt": "\n\nx", "c.txt": "", "d.txt": "one line", "e.txt": "1\n2\n3\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted((name, i, x) for name, t in texts.items() for i, x in enumerate(t.removesuffix("\n").split("\n") if t else []))
    for size in ("700b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = scan_lines(spark, f"file://{tmp_path}")
            if size == "128m":
                assert lines.rdd.getNumPartitions() < len(texts)
            got = lines.select(F.regexp_extract("doc_id", "[^/]*$", 0), "line_no", "line")
            assert sorted(tuple(r) for r in got.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        plan = got._jdf.queryExecution().executedPlan().toString()
        exchanged = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert exchanged and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        # Nothing below an exchange reads the text.
        assert all("value" not in x.split("ReadSchema")[-1] for x in plan.splitlines() if "FileScan" in x and "struct<>" in x)


def test_beyond_the_block_limit_lines_are_joined(spark, tmp_path, monkeypatch):
    from delimlake.sources import lines as module

    (tmp_path / "a.txt").write_text("x\ny\nz")
    monkeypatch.setattr(module, "BLOCKS", 0)
    assert sorted((r["line_no"], r["line"]) for r in scan_lines(spark, f"file://{tmp_path}").collect()) == [(0, "x"), (1, "y"), (2, "z")]


def test_split_whole_documents(spark, tmp_path):
    """Every document counts, whatever its quotes: the query and its SQL against the character scan."""
    import duckdb

    from delimlake.plans import queries

    rng = random.Random(5)
    texts = [t for t, _ in CASES if not t or t[:1] != "\u00a0"] + ["".join(rng.choice('ab,"\n\\ \r') for _ in range(rng.randrange(1, 24))) for _ in range(600)]
    texts += ['he said "a, b', 'x,y\n"never\nclosed,z', 'a",b"|c,d\ne|"f|g"']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.split_whole_documents(spark, f"file://{tmp_path}").collect())
    found: dict = {}
    for i, no, _, cell in got:
        found.setdefault(int(i), {}).setdefault(no, []).append(cell)
    delims = {len(texts) - 1: "|"}
    want = {i: scan(t, delims.get(i, ",")) for i, t in enumerate(texts) if t}
    assert {i: list(r.values()) for i, r in found.items()} == {i: r for i, r in want.items() if r}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(queries.oracle_sql()["split_whole_documents"]).fetchall()) == got


def test_whole_documents_are_cut_where_they_stand(spark):
    """Documents of one block need no shuffle of their text; blocks and lines give the same records, null ids included."""
    rng = random.Random(11)
    texts = ["".join(rng.choice('ab",\\\n') for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for lines in (1, 3, 10_000):
        got = {(r["doc_id"], r["record_no"], *r["cells"]) for r in records.parse_records(document_blocks(docs, lines=lines), ",").collect()}
        assert sorted({x[0] for x in got}) == sorted(str(i) for i, t in enumerate(texts) if scan(t))
        for i, t in enumerate(texts):
            assert [list(x[2:]) for x in sorted((x for x in got if x[0] == str(i)), key=lambda x: x[1])] == scan(t)
    none = spark.createDataFrame([(None, "a,b"), (None, "c")], "doc_id string, text string")
    assert sorted(r["cells"] for r in records.parse_records(document_blocks(none), ",").collect()) == [["a", "b"], ["c"]]

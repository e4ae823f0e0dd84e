"""Delimited text to records: lines(doc_id, block, line_no, line), or blocks(doc_id, block, of, text) -> records(doc_id, block, blocks, record_no, cells).

The state that runs across lines is the parity of quotes and a flag about the
next quoted line break, so it is a matter of running sums and maxima:

* a backslash makes the next character literal, also a line break;
* each other double quote turns quoting on or off, and goes;
* a line break inside quotes becomes a space, but stays one where a quote that
  opened at the start of a line has seen none yet (a flag that only a quoted
  line break clears);
* any other line break ends the record.

A document comes in blocks (all of a short one, parts of a long one), and no
task needs more than a block. What a block does to that state is worked out for
both parities with which it may be entered, in one pass; running sums over a row
a block tell how each is entered; a second pass numbers the records, and a record
that crosses from block to block goes to the block in which it starts.

Texts held in rows come as blocks with their lines as one text. They are cut at
their quotes, so that a line break's parity is that of its piece, and no line
travels by itself; a document of one block is cut where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Marks that stand for special characters while a record is cut (noncharacters, refused in input).
QUOTE, DELIM, CUT, ESC = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
# White space that trimming removes.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
DELIMITERS = "\t,|"


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(SPACES))


def detect_delimiter(first_line: Column) -> Column:
    """The first tab, comma or pipe outside quotes; a comma if there is none."""
    plain = F.array_join(F.filter(F.split(first_line, '"'), lambda x, i: i % 2 == 0), "")
    found = F.regexp_extract(plain, f"[{DELIMITERS}]", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(","))


KEYS = ["doc_id", "block"]


def _counted(lines: DataFrame) -> DataFrame:
    """With nq (quotes that count), esc (the line break is escaped) and upto (the block's quotes up to the line)."""
    bare = F.when(F.contains("line", F.lit("\\")), F.regexp_replace("line", r"(?s)\\.", "")).otherwise(F.col("line"))
    rows = lines.select(*KEYS, "line_no", "line").withColumn("bare", bare)
    rows = rows.withColumns({"nq": F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit(""))), "esc": F.endswith("bare", F.lit("\\"))}).drop("bare")
    return rows.withColumn("upto", F.sum("nq").over(_so_far()))


def _block() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("line_no")


def _so_far() -> WindowSpec:
    return _block().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier() -> WindowSpec:
    return _block().rowsBetween(Window.unboundedPreceding, -1)


def _opens(parity: Column) -> Column:
    """A quote opens at the start of this line, not the first of the text; parity: of the quotes before the block."""
    return (F.col("line_no") > 0) & F.startswith(F.col("line"), F.lit('"')) & ((parity + F.col("upto") - F.col("nq")) % 2 == 0)


def _folds(parity: Column) -> Column:
    """The line break after this line, if any, stands in quotes."""
    return ((parity + F.col("upto")) % 2 == 1) & ~F.col("esc")


def block_states(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """A row a block: how it is entered.

    (doc_id, block, no, blocks, delim, parity, opened, folded, ended, home, end):
    its number in the document and how many there are, the parity of the quotes
    before it, the last line before it that opens with a quote and the last whose
    break is quoted, the records ended before it, the number of the block where
    the record starts in which it is entered (its own if a record starts with it),
    and its last line if that is the document's.
    """
    found = []
    for e in (0, 1):  # for either parity
        opens, folds = _opens(F.lit(e)), _folds(F.lit(e))
        ends = ~F.col("esc") & ~folds
        found += [
            F.max(F.when(opens, F.col("line_no"))).alias(f"opened{e}"),
            F.max(F.when(folds, F.col("line_no"))).alias(f"folded{e}"),
            F.count(F.when(ends, True)).alias(f"n{e}"),
            F.max_by(~ends, "line_no").alias(f"open{e}"),
        ]
    head = F.max(F.when(F.col("line_no") == 0, detect_delimiter(F.col("line")))) if not delimiter else F.lit(None).cast("string")
    per = _counted(lines).groupBy(*KEYS).agg(F.sum("nq").alias("quotes"), F.max("line_no").alias("top"), head.alias("head"), *found)
    doc = Window.partitionBy("doc_id").orderBy("block")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "parity": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2,
        "final": F.lead("block").over(doc).isNull(),
        "delim": F.lit(delimiter) if delimiter else F.max("head").over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    per = per.select(*KEYS, "delim", "parity", "final", "top", *[F.when(F.col("parity") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("opened", "folded", "n", "open")])
    per = per.withColumns({"no": (F.row_number().over(doc) - 1).cast("long"), "middle": F.coalesce(F.lag("open").over(doc), F.lit(False))})
    # The record at a block's end starts in it where another ended before, or where the block starts with it.
    started = F.max(F.when((F.col("n") > 0) | ~F.col("middle"), F.col("no"))).over(before)
    return per.select(
        *KEYS, "no", F.count("*").over(Window.partitionBy("doc_id")).alias("blocks"), "delim", "parity",
        F.max("opened").over(before).alias("opened"),
        F.max("folded").over(before).alias("folded"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
        F.when(F.col("middle"), started).otherwise(F.col("no")).alias("home"),
        F.when(F.col("final"), F.col("top")).alias("end"),
    )


def several_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block) of the documents that come in several blocks.

    They are exchanged by themselves: where there are none, adaptive execution
    sees that before it reads lines again, and leaves out what is done for them.
    """
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return lines.select(*KEYS).distinct().withColumn("n", n).where("n > 1").select(*KEYS).repartition(*KEYS)


def _entered(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """Counted lines of documents of one block, with the columns of block_states."""
    every = _block().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.lit(delimiter) if delimiter else F.max(F.when(F.col("line_no") == 0, detect_delimiter(F.col("line")))).over(every)
    number, none = (lambda n: F.lit(n).cast("long")), F.lit(None).cast("long")
    entry = {"no": number(0), "blocks": number(1), "delim": head, "parity": number(0), "opened": none, "folded": none, "ended": number(0), "home": number(0), "end": F.max("line_no").over(every)}
    return _counted(lines).withColumns(entry)


def _numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, home, blocks, line_no, line, delim, record_no, joint) of counted lines with their block's state: joint
    follows the line within its record, null where the record ends; home: the number of the block where it starts."""
    last = F.coalesce(F.col("line_no") == F.col("end"), F.lit(False))
    rows = rows.withColumns({"a": _opens(F.col("parity")), "q": _folds(F.col("parity")) & ~last, "e": F.col("esc") & ~last})
    opened = F.greatest("opened", F.max(F.when(F.col("a"), F.col("line_no"))).over(_so_far()))
    folded = F.greatest("folded", F.max(F.when(F.col("q"), F.col("line_no"))).over(_earlier()))
    joint = F.when(F.col("e"), F.lit("\n")).when(F.col("q"), F.when(opened > F.coalesce(folded, F.lit(-1)), F.lit("\n")).otherwise(F.lit(" ")))
    within = F.coalesce(F.sum((~F.col("e") & ~F.col("q")).cast("long")).over(_earlier()), F.lit(0))
    home = F.when(within == 0, F.col("home")).otherwise(F.col("no"))
    return rows.select("doc_id", home.alias("home"), "blocks", "line_no", "line", "delim", (F.col("ended") + within).alias("record_no"), joint.alias("joint"))


def _stitched(rows: DataFrame) -> DataFrame:
    """The records of counted lines with their block's state (see stitch)."""
    piece = F.struct("line_no", F.concat("line", F.coalesce("joint", F.lit(""))).alias("piece"))
    same = [F.first(c).alias(c) for c in ("blocks", "delim")]
    parts = _numbered(rows).groupBy("doc_id", "home", "record_no").agg(F.sort_array(F.collect_list(piece)).alias("p"), *same)
    return parts.select("doc_id", F.col("home").alias("block"), "blocks", "record_no", "delim", F.concat_ws("", F.col("p.piece")).alias("text"))


def stitch_blocks(lines: DataFrame, states: DataFrame) -> DataFrame:
    """As stitch, of the blocks that have a row of block_states."""
    return _stitched(_counted(lines).join(states, KEYS))


def stitch(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(doc_id, block, blocks, record_no, delim, text): the records of lines, uncut.

    block: the number of the block where the record starts, of so many of its
    document. A document of one block is numbered where it stands.
    """
    if delimiter == "\n":
        raise ValueError("a line break can't be the delimiter")
    lines = lines.where("doc_id is not null and block is not null")
    many = several_blocks(lines)
    rows = lines.join(many, KEYS, "left_semi")
    return _stitched(_entered(lines.join(many, KEYS, "left_anti"), delimiter)).union(stitch_blocks(rows, block_states(rows, delimiter)))


def _marked(text: Column) -> Column:
    """text with line breaks marked: CUT and QUOTE after an even and an odd number of quotes, DELIM and ESC for escaped
    ones (with their backslash)."""
    s = F.regexp_replace(text, r"(?s)\\(.)", f"{ESC}$1")
    s = F.replace(F.replace(s, F.lit(f'{ESC}"'), F.lit(QUOTE)), F.lit(f"{ESC}\n"), F.lit(DELIM))
    s = F.when(F.contains(text, F.lit("\\")), F.replace(s, F.lit(ESC), F.lit("\\"))).otherwise(text)

    def piece(x: Column, i: Column) -> Column:
        x = F.replace(x, F.lit(QUOTE), F.lit('\\"'))
        even = F.replace(x, F.lit("\n"), F.lit(CUT))
        return F.when(i % 2 == 0, even).otherwise(F.replace(F.replace(x, F.lit("\n"), F.lit(QUOTE)), F.lit(DELIM), F.lit(ESC)))

    several = F.array_join(F.transform(F.split(s, '"'), piece), '"')
    refused = F.raise_error(F.lit("the text holds U+FDD0 to U+FDD3, which are reserved")).cast("string")
    marks = F.regexp_like(text, F.lit(f"[{QUOTE}{DELIM}{CUT}{ESC}]"))
    return F.when(marks, refused).when(F.contains(text, F.lit('"')), several).otherwise(F.replace(s, F.lit("\n"), F.lit(CUT)))


def _ends(parity: int) -> tuple[str, str, str, str]:
    """Marks of line breaks where so many quotes come first: those outside quotes, those in them; the same of escaped ones."""
    return (CUT, QUOTE, DELIM, ESC) if parity == 0 else (QUOTE, CUT, ESC, DELIM)


def _joined(m: Column, parity: int, opened: Column) -> Column:
    """A marked block with CUT where records end alone. opened: whether its first quoted line break stays one."""
    end, fold, escaped, within = _ends(parity)
    broken = F.lit("\\\n")
    s = F.replace(m, F.lit(within), broken)
    # From here, within marks a quote that opens at the start of a line. The last one before a quoted break counts.
    for c in (end, escaped):
        s = F.replace(s, F.lit(f'{c}"'), F.lit(f'{c}{within}"'))
    s = F.concat(F.when(opened, F.lit(within)).otherwise(F.lit("")), s)
    s = F.regexp_replace(s, f"{within}([^{within}{fold}]*+){fold}", "$1\n")
    s = F.replace(F.replace(s, F.lit(within), F.lit("")), F.lit(fold), F.lit(" "))
    s = F.when(F.contains(m, F.lit(fold)), s).otherwise(F.replace(m, F.lit(within), broken))
    s = F.replace(s, F.lit(escaped), broken)
    return s if parity == 0 else F.replace(s, F.lit(end), F.lit(CUT))


def _starts_open(parity: Column) -> Column:
    """A quote opens at the start of the block, which is not the first; parity: of the quotes before it."""
    return (F.col("block") > 0) & (parity == 0) & F.startswith("text", F.lit('"'))


def text_states(blocks: DataFrame, delimiter: str | None = None) -> DataFrame:
    """A row a block, of documents with several: how it is entered.

    (id, at, no, blocks, delim, parity, opened, ended, middle, home, final,
    open): document and first line, its number in the document and how many
    there are, the parity of the quotes before it, whether a quote has opened at
    the start of a line since the last quoted line break, the records ended
    before it, whether it is entered within a record, the number of the block
    where that record starts (its own if a record starts with it), whether it is
    the last one, and whether it ends within a record.
    """
    head = detect_delimiter(F.substring_index("text", "\n", 1)) if not delimiter else F.lit(None).cast("string")
    bare = F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))
    per = blocks.where("of > 1")
    per = per.withColumns({"head": F.when(F.col("block") == 0, head), "bare": bare, "m": _marked(F.concat("text", F.lit("\n")))})
    m, found = F.col("m"), []
    for e in (0, 1):  # for either parity
        end, fold, escaped, _ = _ends(e)
        tail, folds = F.substring_index(m, fold, -1), F.contains(m, F.lit(fold))
        sets = F.contains(tail, F.lit(f'{end}"')) | F.contains(tail, F.lit(f'{escaped}"')) | (~folds & _starts_open(F.lit(e)))
        found += [
            (F.length(m) - F.length(F.replace(m, F.lit(end), F.lit("")))).cast("long").alias(f"n{e}"),
            (~F.endswith(m, F.lit(end))).alias(f"open{e}"),
            F.when(folds | sets, sets).alias(f"flag{e}"),
        ]
    quotes = F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))
    per = per.select(*KEYS, "head", quotes.alias("quotes"), *found)
    doc = Window.partitionBy("doc_id").orderBy("block")
    every = Window.partitionBy("doc_id")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "parity": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2,
        "no": (F.row_number().over(doc) - 1).cast("long"),
        "blocks": F.count("*").over(every),
        "delim": F.lit(delimiter) if delimiter else F.max("head").over(every),
    }).where("blocks > 1")
    per = per.select(*KEYS, "delim", "parity", "no", "blocks", *[F.when(F.col("parity") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("n", "open", "flag")])
    per = per.withColumn("middle", F.coalesce(F.lag("open").over(doc), F.lit(False)))
    # The record at a block's end starts in it where another ended before, or where the block starts with it.
    started = F.max(F.when((F.col("n") > 0) | ~F.col("middle"), F.col("no"))).over(before)
    return per.select(
        F.col("doc_id").alias("id"), F.col("block").alias("at"), "no", "blocks", "delim", "parity",
        F.coalesce(F.last("flag", ignorenulls=True).over(before), F.lit(False)).alias("opened"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
        "middle",
        F.when(F.col("middle"), started).otherwise(F.col("no")).alias("home"),
        (F.col("no") == F.col("blocks") - 1).alias("final"),
        "open",
    )


def _pieces(entered: DataFrame) -> DataFrame:
    """(..., record_no, k, j, piece): the parts of records that blocks hold, with j from 0 to k - 1 in a block."""
    rows = entered.withColumn("m", _marked(F.when(F.col("final"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))))
    opened = F.col("opened") | _starts_open(F.col("parity"))
    cut = F.split(F.when(F.col("parity") == 0, _joined(F.col("m"), 0, opened)).otherwise(_joined(F.col("m"), 1, opened)), CUT)
    keep = [c for c in entered.columns if c not in ("text", "of")]
    # A generator, which no later step moves into itself: each block is cut once.
    rows = rows.select(*keep, F.explode(F.array(cut)).alias("ps"))
    rows = rows.select(*keep, F.size("ps").alias("k"), F.posexplode("ps").alias("j", "piece"))
    return rows.withColumn("record_no", F.col("ended") + F.col("j"))


def stitch_texts(blocks: DataFrame, delimiter: str | None = None) -> DataFrame:
    """As stitch, of blocks(doc_id, block, of, text) with their lines as one text, block being the number of the first.

    Documents of one block are cut where they stand; of others, the parts of each record are brought together.
    """
    if delimiter == "\n":
        raise ValueError("a line break can't be the delimiter")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("block") == F.col("at"))
    last = (F.col("j") == F.col("k") - 1) & ~F.col("final")
    # After a record's end at the end of the block, nothing follows.
    parts = _pieces(blocks.where("of > 1").join(text_states(blocks, delimiter), same)).where(~(last & ~F.col("open")))
    first = F.when(F.col("j") == 0, F.col("home")).otherwise(F.col("no"))
    parts = parts.groupBy("doc_id", first.alias("block"), "record_no").agg(F.array_sort(F.collect_list(F.struct("no", "piece"))).alias("p"), *[F.first(c).alias(c) for c in ("blocks", "delim")])
    found = parts.select("doc_id", "block", "blocks", "record_no", "delim", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
    one = blocks.where("of = 1")
    entry = {"no": 0, "blocks": 1, "parity": 0, "opened": False, "ended": 0, "final": True}
    head = F.lit(delimiter) if delimiter else F.when(F.col("block") == 0, detect_delimiter(F.substring_index("text", "\n", 1)))
    one = one.withColumns({c: F.lit(x) if isinstance(x, bool) else F.lit(x).cast("long") for c, x in entry.items()} | {"delim": head})
    return _pieces(one).select("doc_id", F.col("no").alias("block"), "blocks", "record_no", "delim", F.col("piece").alias("text")).union(found)


def split_cells(text: Column, delim: Column, checked: bool = False) -> Column:
    """The trimmed cells of one record's text. checked: reserved characters have been refused before."""
    marks = F.regexp_like(text, F.lit(f"[{QUOTE}{DELIM}{CUT}{ESC}]"))
    refused = F.raise_error(F.lit("the text holds U+FDD0 to U+FDD3, which are reserved")).cast("array<string>")
    s = F.regexp_replace(text, r"(?s)\\(.)", f"{ESC}$1")
    s = F.regexp_replace(s, rf"(?<!{ESC})\\\z", "")
    s = F.replace(s, F.lit(f'{ESC}"'), F.lit(QUOTE))
    s = F.replace(s, F.concat(F.lit(ESC), delim), F.lit(DELIM))
    s = F.when(F.contains(text, F.lit("\\")), F.replace(s, F.lit(ESC), F.lit(""))).otherwise(text)
    # A longer delimiter, and one that is itself a quote or backslash, cuts nothing.
    cuts = (F.length(delim) == 1) & ~delim.isin('"', "\\")
    pieces = F.transform(F.split(s, '"'), lambda x, i: F.when((i % 2 == 0) & cuts, F.replace(x, delim, F.lit(CUT))).otherwise(x))
    plain = F.when(cuts, F.replace(s, delim, F.lit(CUT))).otherwise(s)
    cells = F.split(F.when(F.contains(text, F.lit('"')), F.array_join(pieces, "")).otherwise(plain), CUT)
    cells = F.transform(cells, lambda c: trim(F.replace(F.replace(c, F.lit(QUOTE), F.lit('"')), F.lit(DELIM), delim)))
    return cells if checked else F.when(marks, refused).otherwise(cells)


def cut_records(texts: DataFrame, checked: bool = False) -> DataFrame:
    """records(doc_id, block, blocks, record_no, cells) of stitched texts; records of blank cells alone are left out."""
    # A generator, which filters on the cells don't cross: each record is split once.
    once = F.explode(F.array(split_cells(F.col("text"), F.col("delim"), checked)))
    return texts.select(*KEYS, "blocks", "record_no", once.alias("cells")).where(F.exists("cells", lambda c: c != ""))


def parse_records(rows: DataFrame, delimiter: str | None = None) -> DataFrame:
    """records(doc_id, block, blocks, record_no, cells) in the order of record_no; records of blank cells alone are left out.

    delimiter: one character; None or '' detects it from each document's first
    line. Documents may be of any size: a task holds a block, or one record.
    block and blocks: see stitch.
    """
    if delimiter == "\n":
        raise ValueError("a line break can't be the delimiter")
    whole = "text" in rows.columns
    return cut_records(stitch_texts(rows, delimiter) if whole else stitch(rows, delimiter), checked=whole)

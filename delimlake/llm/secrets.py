"""Secret scans: multipart credentials, in DataFrame operations only.

Base findings stand alone: assignments of secrets, access keys, long hex runs.
Beyond them a text may hold the parts of a credential: identifiers (access keys,
user names, client ids), endpoints (URLs, hosts with ports, IPv4 addresses) and
weak candidates for the secret (short assignments, base64-like runs) that mean
nothing alone. An interval join links them: a weak candidate is reported when an
identifier or an endpoint lies within its scope.

One narrow pass over the texts yields lengths of matches and of what lies
between them; positions are running sums over those, texts go no further. Only
documents that hold both a weak candidate and a complementary part reach the
join, which runs over (document, block of the text) and keeps candidates, never
pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delimlake.llm.common import cut


def any_case(words: str) -> str:
    """A pattern that matches the ASCII letters of words in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


# The base kinds in their order, as (pattern, least length of the value).
VALUE = r"[A-Za-z0-9+/_.=-]+"
GLUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({any_case('password|passwd|secret|token|api_?key')}){GLUE}({VALUE})"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Parts that are reported only together. A weak secret: a short assignment or a run of 40 base64 characters.
WEAK = f"({any_case('pwd|pass|passphrase|auth|credential|private_?key|signature|sig')}){GLUE}({VALUE})"
WEAK_RUN = r"[A-Za-z0-9/+]{40,}={0,2}"
IDENT = f"({any_case('user|username|user_?id|login|account|client_?id|access_?key_?id')}){GLUE}({VALUE})"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\x22'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}"

#: Characters on either side of a weak candidate in which its complement must begin or end.
SCOPE = 300
#: name: (pattern, group whose length counts, least length, part it plays)
KINDS = {
    "assign": (ASSIGN, 2, 6, "base"),
    "access": (ACCESS, 0, 20, "base"),
    "hex": (HEX, 0, 24, "base"),
    "weak": (WEAK, 2, 4, "weak"),
    "run": (WEAK_RUN, 0, 40, "weak"),
    "ident": (IDENT, 2, 2, "anchor"),
    "endpoint": (ENDPOINT, 0, 7, "anchor"),
}
BASE = [k for k, v in KINDS.items() if v[3] == "base"]


def may_hold(kind: str, text: Column) -> Column:
    """What a text with a match of that kind surely holds, told by plain search: spares most texts the patterns."""
    colon = F.contains(text, F.lit(":"))
    if kind in ("assign", "weak", "ident"):
        return colon | F.contains(text, F.lit("="))
    if kind == "endpoint":  # a scheme or a port has a colon, else it is an IPv4 address
        return colon | F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))
    return F.contains(text, F.lit("AKIA")) if kind == "access" else F.lit(True)


def matches(text: Column, pattern: str, group: int, may: Column) -> Column:
    """(gap, size, value) of the leftmost non-overlapping matches of a text: characters since the
    match before, of the match and of its group; failing matches too, since they take up text.
    Empty where no match would count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else F.transform(found, F.char_length)
    rows = F.transform(F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(found, F.char_length).alias("m"), value.alias("v")), lambda x: F.struct(x["g"].alias("gap"), x["m"].alias("size"), x["v"].alias("value")))
    return F.when(may & F.regexp_like(text, F.lit(pattern)), F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<gap:int,size:int,value:int>>)"))


def _pattern(kind: str) -> str:
    pattern, _, least, _ = KINDS[kind]
    # A run shorter than the least length is no match of the longer pattern, and runs don't share characters.
    return {"access": "AKIA[A-Z0-9]{%d,}" % (least - 4), "hex": "[0-9a-f]{%d,}" % least}.get(kind, pattern)


def find_parts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: row, ident), (parts: row, kind, part, start, end in code points, end exclusive).

    row numbers the rows of docs; both tables are written to the shared folder.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("doc_id"), t.alias("__t"))
    rows = rows.select("row", "doc_id", *[matches(F.col("__t"), _pattern(k), v[1], may_hold(k, F.col("__t"))).alias(k) for k, v in KINDS.items()])
    rows = cut(rows)
    def tag(kind):
        return F.transform(F.col(kind), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))

    tagged = [tag(k) for k in KINDS]
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(k) > 0)
    each = rows.where(some).select("row", F.explode(F.concat(*tagged)).alias("m")).select("row", "m.*")
    w = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(w)
    least = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])])
    part = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])])
    each = each.select("row", "kind", part[F.col("kind")].alias("part"), (end - F.col("size")).alias("start"), end.alias("end"), F.col("value") >= least[F.col("kind")])
    each = each.toDF("row", "kind", "part", "start", "end", "counts").where("counts").drop("counts")
    return rows.select("row", "doc_id"), cut(each)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end): weak candidates with an identifier or endpoint in their scope,
    and the identifiers and endpoints with such a candidate in theirs.

    Access keys count as identifiers. Candidates that a base finding covers are
    the base finding's. Both sides are cut into blocks of `scope` characters: an
    interval joins the blocks that it touches, a candidate with its scope added.
    A left semi join keeps each once, however many partners it has.
    """

    def blocks(df, pad):
        first = F.floor(F.greatest(F.col("start") - pad, F.lit(0)) / scope)
        return df.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("end") + pad) / scope))))

    weak = parts.where("part = 'weak'")
    anchor = parts.where("part = 'anchor' or kind = 'access'")
    both = weak.select("row").distinct().join(anchor.select("row").distinct(), "row", "left_semi")
    weak, anchor = weak.join(both, "row", "left_semi"), anchor.join(both, "row", "left_semi")
    base = parts.where("part = 'base'").join(both, "row", "left_semi")

    def semi(left, right, near, pad):
        left, right = blocks(left, pad).alias("l"), blocks(right.selectExpr("row", "start", "end"), 0).alias("r")
        on = (F.col("l.row") == F.col("r.row")) & (F.col("l.block") == F.col("r.block"))
        return left.join(right, on & near, "left_semi").drop("block").distinct()

    cover = (F.col("r.start") < F.col("l.end")) & (F.col("r.end") > F.col("l.start"))
    weak = weak.join(semi(weak, base, cover, 0), ["row", "kind", "start", "end"], "left_anti")
    near = (F.col("r.start") <= F.col("l.end") + scope) & (F.col("r.end") >= F.col("l.start") - scope)
    linked = semi(weak, anchor, near & ~cover, scope)
    partners = semi(anchor.where("part = 'anchor'"), linked, near & ~cover, scope)
    return linked.unionByName(partners).select("row", "kind", "start", "end")


def scan_secrets(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans lists kind:start:end by start, then kind in the order of KINDS: the
    base findings, then linked weak candidates (weak, run) and the identifiers
    and endpoints (ident, endpoint) that complete them. base_sha256 covers the
    base findings alone. Null and empty texts have no finding: counts 0, spans
    ''. Repeated rows and null idents are rows of their own.
    """
    rows, parts = find_parts(docs, ident, text)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    base = parts.where("part = 'base'").select("row", "kind", "start", "end")
    every = base.union(link_parts(parts, scope)).withColumn("no", order[F.col("kind")])
    spans = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind"))).alias("s"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base_only = F.filter("s", lambda x: x["no"] < len(BASE))
    out = rows.join(spans, "row", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<start:bigint,no:int,end:bigint,kind:string>>)")))
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(told(base_only), 256).alias("base_sha256"),
        told(F.col("s")).alias("spans"),
        (F.size("s") - F.size(base_only)).cast("long").alias("n_linked"),
    )

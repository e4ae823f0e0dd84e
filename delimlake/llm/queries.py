"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delimlake.llm import jaccard, langid, licenses, linededup, mixing, negatives, packing, repeats, secrets, spelling, spotsigs, topk, warc

from delimlake.llm.common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, packing.size_of(F.col("text")), packing.text_cluster(F.col("text")))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest, payloads=False)
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.predict(F.col("text"), langid.fit(docs)).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantize(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("words"))
    # Cut: texts are read once, to count their words.
    docs = cut(mixing.with_quality(docs, table(spark, sf_dir, "labels")))
    mixed = mixing.mix(docs, F.col("words"), F.col("__weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), spelling.slip)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), topk.quantize(F.col("embedding"), 256).alias("vector"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan,
        op2_best_fit_packing,
        op3_warc_archives,
        op4_license_scan,
        op5_ngram_jaccard_join,
        op6_language_id,
        op7_exact_top_k,
        op8_source_mixing,
        op9_spotsigs_fingerprints,
        op10_line_dedup,
        op11_suffix_repeats,
        op12_spelling_variants,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def _op1_sql() -> str:
    each = []
    for no, (kind, (_, group, least, part)) in enumerate(secrets.KINDS.items()):
        p = secrets._pattern(kind).replace("'", "''")
        each.append(
            f"SELECT rn, {no} AS no, '{kind}' AS kind, '{part}' AS part, i, "
            f"length(string_split_regex(t, '{p}')[i]) AS gap, length(regexp_extract_all(t, '{p}', 0)[i]) AS size, "
            f"length(regexp_extract_all(t, '{p}', {group})[i]) >= {least} AS counts "
            f"FROM (SELECT rn, t, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i FROM d)"
        )
    scope = secrets.SCOPE
    near = f"r.rn = l.rn AND r.s <= l.e + {scope} AND r.e >= l.s - {scope} AND NOT (r.s < l.e AND r.e > l.s)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
p AS (
  SELECT rn, no, kind, part, e - size AS s, e FROM (
    SELECT *, sum(gap + size) OVER (PARTITION BY rn, kind ORDER BY i) AS e FROM m
  ) WHERE counts
),
w AS (SELECT * FROM p l WHERE part = 'weak' AND NOT EXISTS (SELECT 1 FROM p r WHERE r.part = 'base' AND r.rn = l.rn AND r.s < l.e AND r.e > l.s)),
a AS (SELECT * FROM p WHERE part = 'anchor' OR kind = 'access'),
x AS (SELECT * FROM w l WHERE EXISTS (SELECT 1 FROM a r WHERE {near})),
y AS (SELECT * FROM a l WHERE part = 'anchor' AND EXISTS (SELECT 1 FROM x r WHERE {near})),
f AS (SELECT * FROM p WHERE part = 'base' UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y),
g AS (
  SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, no) FILTER (part = 'base') AS base,
         string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, no) AS spans, count(*) FILTER (part <> 'base') AS n_linked
  FROM f GROUP BY rn
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (rn)
"""


def _op9_sql() -> str:
    anchors = ", ".join(f"'{x}'" for x in spotsigs.ANCHORS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')), coalesce(text, '')) AS rn, doc_id, coalesce(text, '') AS text FROM documents
), e AS (
  SELECT d.*, length(d.text) AS n, coalesce(lead(text) OVER (ORDER BY rn), first_value(text) OVER (ORDER BY rn)) AS next_text FROM d
), t AS (
  SELECT rn, 0 AS edited, text FROM e
  UNION ALL SELECT rn, 1, concat(substr(text, 1, n - n // 2), substr(next_text, 1, n // 2)) FROM e
), w AS (
  SELECT rn, edited, concat(' ', trim(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS words FROM t
), u AS (
  SELECT rn, edited, unnest(string_split(trim(words), ' ')) AS word, unnest(range(len(string_split(trim(words), ' ')))) AS pos FROM w
), c AS (
  SELECT *, word IN ({anchors}) AS anchor, CASE WHEN word IN ({anchors}) THEN NULL ELSE word END AS content FROM u
), l AS (
  SELECT *, lead(content, 1 IGNORE NULLS) OVER o AS c1, lead(content, 2 IGNORE NULLS) OVER o AS c2
  FROM c WINDOW o AS (PARTITION BY rn, edited ORDER BY pos)
), s AS (
  SELECT DISTINCT rn, edited, substr(md5(concat(word, ' ', c1, ' ', c2, ' ')), 1, 16) AS h
  FROM l WHERE anchor AND c2 IS NOT NULL
), g AS (
  SELECT w.rn, w.edited, coalesce(any_value(x.hs), [substr(md5(any_value(w.words)), 1, 16)]) AS hs
  FROM w LEFT JOIN (SELECT rn, edited, list(h ORDER BY h) AS hs FROM s GROUP BY ALL) x USING (rn, edited) GROUP BY w.rn, w.edited
), j AS (
  SELECT e.rn, e.doc_id, e.n, sha256(t.text) AS sha, a.hs AS fa, b.hs AS fb, coalesce(nx.hs, f.hs) AS fn
  FROM e JOIN t ON t.rn = e.rn AND t.edited = 1 JOIN g a ON a.rn = e.rn AND a.edited = 0 JOIN g b ON b.rn = e.rn AND b.edited = 1
  LEFT JOIN g nx ON nx.rn = e.rn + 1 AND nx.edited = 0 JOIN g f ON f.rn = 1 AND f.edited = 0
)
SELECT doc_id, n AS n_chars, sha AS edited_sha256,
       concat(len(fa), ':', array_to_string(fa, ',')) AS fingerprint, concat(len(fb), ':', array_to_string(fb, ',')) AS edited_fingerprint,
       CAST(len(list_intersect(fa, fb)) AS DOUBLE) / (len(fa) + len(fb) - len(list_intersect(fa, fb))) AS near_edited,
       CAST(len(list_intersect(fa, fn)) AS DOUBLE) / (len(fa) + len(fn) - len(list_intersect(fa, fn))) AS near_next
FROM j
"""


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p
), d AS (
  SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: right(bin(CAST(strpos('0123456789abcdef', c) - 1 + 16 AS INTEGER)), 4)), '') AS bits FROM b
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (1 << (4 - CAST(j AS INTEGER))))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM d
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rn, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rn, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT w.rn, doc_id, count(g) AS n FROM w LEFT JOIN s USING (rn) GROUP BY w.rn, doc_id
), p AS (
  SELECT a.rn AS a, b.rn AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rn <> b.rn GROUP BY a.rn, b.rn
), e AS (
  SELECT a, b FROM p JOIN n x ON x.rn = a JOIN n y ON y.rn = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), r(rn, m) AS (
  SELECT rn, rn FROM n UNION SELECT r.rn, e.b FROM r JOIN e ON e.a = r.m
)
SELECT n.doc_id, n.n AS n_shingles, min(o.doc_id) AS component_id
FROM n JOIN r ON r.rn = n.rn JOIN n o ON o.rn = r.m GROUP BY n.rn, n.doc_id, n.n
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

# Bytes as pairs of hexadecimal digits; of equal strings all but the first mark what they cover.
OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), o AS (
  SELECT rn, o, substr(h, CAST(2 * o + 1 AS BIGINT), 598) AS h FROM (SELECT rn, h, unnest(range(0, len(h) // 2 - 99, 200)) AS o FROM d)
), s AS (
  SELECT rn, o + a AS a, md5_number(substr(h, CAST(2 * a + 1 AS BIGINT), 200)) AS s FROM (SELECT rn, o, h, unnest(range(len(h) // 2 - 99)) AS a FROM o)
), m AS (
  SELECT s, min((rn, a)) AS first FROM s GROUP BY s HAVING count(*) > 1
), l AS (
  SELECT rn, a, lag(a) OVER (PARTITION BY rn ORDER BY a) AS p FROM s JOIN m USING (s) WHERE (rn, a) <> first
), g AS (
  SELECT rn, a, sum(CASE WHEN p IS NULL OR a > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY a) AS g FROM l
), r AS (
  SELECT rn, g, min(a) AS b, max(a) + 100 AS e FROM g GROUP BY rn, g
), k AS (
  SELECT rn, e AS b, lead(b) OVER (PARTITION BY rn ORDER BY b) AS e FROM r UNION ALL SELECT rn, 0, min(b) FROM r GROUP BY rn
), t AS (
  SELECT rn, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (coalesce(e, len(h) // 2) - b) AS BIGINT)), '' ORDER BY b) AS kept FROM k JOIN d USING (rn) GROUP BY rn
), n AS (
  SELECT rn, count(*) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed FROM r GROUP BY rn
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (rn) LEFT JOIN t USING (rn)
"""

# The CRC-32 of a word comes byte by byte from its table; near words agree once a character of one of them is masked or left out.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), c AS (
  SELECT head, run, count(*) AS n FROM d GROUP BY ALL
), b AS (
  SELECT run, n, flatten(list_transform(string_split(head || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END)) AS bytes FROM c
), h AS (
  SELECT run, n, xor(list_reduce(bytes, lambda s, x: xor(s // 256, t[CAST(xor(s % 256, x) AS INTEGER) + 1]), 4294967295), 4294967295) AS h FROM b, crc
), s AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), i AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), v AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS masked, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM i
), p AS (
  SELECT DISTINCT v.word, w.word AS other FROM v JOIN w ON w.word = v.shorter
), e AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.masked = b.masked AND a.word <> b.word
  UNION ALL SELECT p.word, other, n FROM p JOIN w ON w.word = other UNION ALL SELECT other, p.word, n FROM p JOIN w ON w.word = p.word
), f AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM e GROUP BY word
), g AS (
  SELECT e.word, min(other) AS form FROM e JOIN f ON f.word = e.word AND e.other_n = f.form_n GROUP BY e.word
), o AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN g.form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN f USING (word) LEFT JOIN g USING (word)
), r(word, root, form) AS (
  SELECT word, word, form FROM o UNION ALL SELECT r.word, o.word, o.form FROM r JOIN o ON o.word = r.form
)
SELECT o.word, o.form, r.root, o.n, o.n_near, o.form_n FROM o JOIN r ON r.word = o.word AND r.form IS NULL
"""

OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rn, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.label <> c.label OR a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS no FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rn, p.no ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rn = p.rn AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.no <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP8_SQL = r"""
WITH q AS (
  SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END) AS weight
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(coalesce(q.weight, 1.0) AS DOUBLE) AS weight
  FROM documents d LEFT JOIN q USING (doc_id)
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || CAST(size AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0) / weight AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), f AS (
  SELECT *, CAST(total - capped AS DOUBLE) / CAST(open AS DOUBLE) AS share FROM c
), g AS (
  SELECT *, share * w <= 3 * source_size AS free FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN free THEN (first_value(share) OVER (ORDER BY NOT free, source_size / w, source NULLS LAST)) * w ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM g
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op9_spotsigs_fingerprints": _op9_sql(), "op3_warc_archives": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op7_exact_top_k": OP7_SQL, "op8_source_mixing": OP8_SQL, "op11_suffix_repeats": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}

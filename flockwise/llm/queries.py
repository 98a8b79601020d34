"""The registered queries of the corpus operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.llm import bpe as _bpe
from flockwise.llm import exact_dedup as _exact
from flockwise.llm import hard_negatives as _negatives
from flockwise.llm import html_mincut as _html
from flockwise.llm import jaccard as _jaccard
from flockwise.llm import line_dedup as _lines
from flockwise.llm import maxscore as _maxscore
from flockwise.llm import mixing as _mixing
from flockwise.llm import packing as _packing
from flockwise.llm import secrets as _secrets
from flockwise.llm import toxicity as _toxicity
from flockwise.llm import trie_codes as _codes
from flockwise.llm import warc as _warc
from flockwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return register


@query(
    "op8_secret_scans",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 18), ('hex', 2, '[0-9a-f]+', 16)) k(kind, rank, pattern, least)),
cut AS (
  SELECT doc_id, kind, rank, least,
    CASE kind WHEN 'assign' THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
              WHEN 'access' THEN string_split_regex(text, 'AKIA[A-Z0-9]+') ELSE string_split_regex(text, '[0-9a-f]+') END AS gaps,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
              WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]+') END AS hits,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
              WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]+') END AS vals
  FROM t CROSS JOIN kinds),
each AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM cut),
one AS (SELECT doc_id, kind, rank, least, i, len(gaps[i]) AS gap, len(hits[i]) AS size, len(vals[i]) AS n FROM each),
placed AS (
  SELECT doc_id, kind, rank, n >= least AS ok, sum(gap + size) OVER w - size AS s, sum(gap + size) OVER w AS e
  FROM one WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
  FROM placed WHERE ok GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN found USING (doc_id)
""",
)
def op8_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    ledger = _secrets.update(docs)
    found = _secrets.findings(docs, ledger)
    base = _secrets.current(F.col("spans"), _secrets.BASE)
    count = lambda i: F.size(F.filter(base, lambda s: s["rank"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_secrets.labelled(base), 256).alias("base_sha256"), _secrets.labelled(F.col("spans")).alias("spans"),
    )


@query(
    "op9_line_dedup",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)),
w AS (SELECT doc_id, line, x[line + 1] AS s, len(regexp_extract_all(x[line + 1], '[^\x20\x09-\x0D]+')) AS words FROM l),
often AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, line, s, words FROM w SEMI JOIN often USING (s)),
isles AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS isle FROM r),
p AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, isle ORDER BY line) AS upto FROM isles),
fore AS (SELECT a.doc_id, a.line AS first, min(b.line) AS last FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.isle = b.isle AND b.line >= a.line
  AND b.upto >= a.upto - a.words + 50 GROUP BY 1, 2),
back AS (SELECT b.doc_id, max(a.line) AS first, b.line AS last FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.isle = b.isle AND b.line >= a.line
  AND b.upto >= a.upto - a.words + 50 GROUP BY b.doc_id, b.line),
wins AS (SELECT * FROM fore UNION SELECT * FROM back),
keyed AS (SELECT v.doc_id, first, last, string_agg(s, chr(10) ORDER BY line) AS k FROM wins v JOIN p ON p.doc_id = v.doc_id AND line BETWEEN first AND last GROUP BY 1, 2, 3),
heads AS (SELECT k, last - first AS n, min(struct_pack(d := doc_id, f := first)) AS head FROM keyed GROUP BY 1, 2),
gone AS (SELECT DISTINCT p.doc_id, p.line FROM keyed q JOIN heads USING (k) JOIN p ON p.doc_id = q.doc_id AND p.line BETWEEN first AND last
  WHERE n = last - first AND struct_pack(d := q.doc_id, f := q.first) > head)
SELECT w.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
  coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY w.line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.line = g.line GROUP BY w.doc_id
""",
)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = _lines.line_dedup(table(spark, sf, "documents"))
    listed = F.array_join(F.flatten(F.transform("dropped_lines", lambda r: F.sequence(r["first"], r["last"]))), ",")
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        listed.alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query(
    "op10_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM t
""",
)
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf, "documents")).drop("recipe")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf, "documents")
    out = _bpe.encode_documents(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_nnls_packing")
def op7_nnls_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return _packing.pack(table(spark, sf, "documents"), tokenizers.path("word_bpe_49k.json")).drop("ids")


@query(
    "op5_ngram_jaccard",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN len(x) >= 3 THEN list_distinct(list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i+2], ' ')))
    WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END AS g FROM w),
sets AS (SELECT g, len(g) AS n, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
reps AS (SELECT s.doc_id, sets.rep, sets.n FROM s JOIN sets ON list_sort(s.g) = sets.g),
grams AS (SELECT rep, n, unnest(g) AS t FROM sets),
common AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i FROM grams a JOIN grams b ON a.t = b.t AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * i >= 90 * (nx + ny - i)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rep, rep FROM sets UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x),
comp AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN reps USING (doc_id) LEFT JOIN comp ON comp.rep = reps.rep
""",
)
def op5_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _jaccard.jaccard_components(table(spark, sf, "documents"), words=3, percent=90)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = _toxicity.fit(docs, table(spark, sf, "labels"))
    slim = docs.select("doc_id", "text")
    out = _toxicity.score(slim, model)
    return out.select("doc_id", _toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


@query(
    "op4_warc",
    r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || h[i // 4 * 5 + 1 : i // 4 * 5 + 5])::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
""",
)
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    index = _warc.write_archives(table(spark, sf, "pages"), _warc.archive_folder(spark), min_revisit_bytes=0)
    return _warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op6_maxscore",
    r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op6_maxscore(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return _maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op3_html_mincut")
def op3_html_mincut(spark: SparkSession, sf: str) -> DataFrame:
    return _html.extract(table(spark, sf, "pages"))


#: Quality weights of the mix: labelled good, labelled bad; all others weigh 1.
GOOD, BAD = 2.0, 0.5


@query(
    "op11_source_mixing",
    r"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5 END) AS weight FROM labels GROUP BY 1),
k AS (
  SELECT t.*, -ln((('0x' || md5(concat_ws(':', '0', doc_id, size))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM t LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY 1),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER o AS place, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
g AS (SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - CAST(used AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM f),
cut AS (SELECT level FROM g WHERE level * weight <= 2.0::DOUBLE * source_size ORDER BY place LIMIT 1),
aims AS (SELECT source, source_size, least((SELECT level FROM cut) * weight, 2.0::DOUBLE * source_size) AS target FROM w),
b AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS budget FROM aims),
p AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.budget, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(budget - epochs * source_size - before, size), 0) AS BIGINT) AS taken FROM p
""",
)
def op11_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD)
    quality = table(spark, sf, "labels").select("doc_id", weight.alias("weight"))
    return _mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, quality=quality).select("doc_id", "size", "source_size", "target", "taken")


def _codes_sql(rounds: int = 2) -> str:
    """The rounds of the codebooks one after the other."""
    head = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, j.range AS part, e[CAST(j.range * (len(e) // 16) AS INTEGER) + 1 : CAST((j.range + 1) * (len(e) // 16) AS INTEGER)] AS x FROM v, range(16) j),
b0 AS (SELECT part, n - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, r) AS n FROM p) WHERE n <= 64)"""
    near = """,
a{i} AS (
  SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, e := entry)) AS m FROM (
    SELECT p.r, part, p.x, entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{i} b USING (part))
  GROUP BY r, part)"""
    move = """,
m{i} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT part, m.e AS entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
b{j} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
    tail = """,
c AS (
  SELECT r, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{i} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM b{i}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""
    steps = [near.format(i=i) + move.replace("{i}", str(i)).replace("{j}", str(i + 1)) for i in range(rounds)]
    return head + "".join(steps) + near.format(i=rounds) + tail.replace("{i}", str(rounds))


@query("op12_trie_codes", _codes_sql())
def op12_trie_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = _codes.encode(table(spark, sf, "embeddings"), parts=16, entries=64, rounds=2)
    return _codes.with_label_error(coded.rows).select("vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


@query(
    "op13_hard_negatives",
    r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
)
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _negatives.prepared(table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label")))
    return _negatives.mine(rows, rows.where("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90, scale=100)

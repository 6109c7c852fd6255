"""Queries of this subpackage, each over its whole table, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), words=5, percent=75)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_spans, repeated_spans

    docs = table(spark, sf_dir, "documents")
    rest = remove_spans(docs, repeated_spans(docs, length=100))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(files, digest=True)


def held_out():
    """Documents never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), held_out())


#: Shares of the sequences that each source gets while it lasts; sources not named here follow when these are used up.
MIXTURE = {"src0": 0.24, **{f"src{i}": 0.04 for i in range(1, 20)}}


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    path = tokenizer_path("byte_bpe_50k.json")
    both = round_trip(table(spark, sf_dir, "documents"), path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op11_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repacking import repack

    pieces = repack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, window=4096)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), min_docs=3)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


#: Base32 of the SHA-1: 32 groups of 5 bits, each within three hexadecimal digits.
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '00' AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      ((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 256
      + (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1) * 16
      + (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 3 AS INTEGER), 1)) - 1)) >> CAST(7 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM m
"""

OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * i >= 75 * (len(sx.sh) + len(sy.sh) - i)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM r JOIN both_ways ON x = node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY 1) ON node = doc_id
"""

#: Bytes as pairs of hexadecimal digits; every string of 100 bytes with its first place.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
parts AS (SELECT doc_id, n, c0, substr(h, 2 * c0 + 1, 1198) AS hc FROM (SELECT *, unnest(range(0, n, 500)) AS c0 FROM d)),
g AS (SELECT doc_id, c0 + j AS i, substr(hc, 2 * j + 1, 200) AS t FROM (SELECT *, unnest(range(least(500, n - 99 - c0))) AS j FROM parts WHERE n - 99 > c0)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, i) > 1 AS again FROM g),
b AS (SELECT doc_id, c0 + j AS i, substr(hc, 2 * j + 1, 2) AS h2 FROM (SELECT *, unnest(range(least(500, n - c0))) AS j FROM parts)),
c AS (SELECT b.doc_id, b.i, b.h2, coalesce(max(CASE WHEN again THEN f.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 100, false) AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(CASE WHEN NOT gone THEN h2 END, '' ORDER BY i) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

#: All pairs; the forest is one leaf up to LEAF distinct vectors, and misses none there.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9
), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT y, root FROM r JOIN l ON x = node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON x = vec_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), o AS (SELECT lang, source, id, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS own FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
w AS (
  SELECT m.lang, m.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (own + v) AS p
  FROM m JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term
), l AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (t + 1) // (everything + v) AS q
  FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS t FROM w GROUP BY ALL) JOIN (SELECT lang, CAST(sum(own) AS HUGEINT) AS everything FROM m GROUP BY 1) USING (lang) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
), words AS (
  SELECT w.lang, w.source, 'term' AS part, w.term AS item, (p - q) * (p - q) // q AS value FROM w JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM every UNION ALL FROM words))
WHERE part = 'pair' OR rank <= 200
"""

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_repeats, op3_token_files, op4_language, op5_packing, op6_vector_dedup, op7_bpe, op8_nearest, op9_token_counts, op10_warc, op11_repacking, op12_divergence, op13_alignment)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op2_repeats": OP2_SQL, "op6_vector_dedup": OP6_SQL, "op10_warc": OP10_SQL, "op12_divergence": OP12_SQL}

"""One query for each operator of this subpackage, with production parameters and whole tables.

``queries()`` and ``oracle_sql()`` have the shapes of the entry module's functions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailis.llm import bpe, decontaminate, htmltext, langid, linededup, neardup, sharding, urls, vafile, warc
from entailis.llm.common import table

SHARDS = 40
PERMUTATION_KEY = 20240229
#: The vocabulary, by its name among the public tokenizers, which are at the same place on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_rows(docs, ["doc_id", "text_crc32", "size"], SHARDS, PERMUTATION_KEY)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = pages.select("page_id", "url", htmltext.main_text(pages).alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.select("doc_id", langid.held_out().alias("held_out"), langid.language(docs, langid.train(langid.training_rows(docs))).alias("x"))
    mixture = F.array_join(F.zip_with("x.langs", "x.shares", lambda k, s: F.concat(k, F.lit(":"), F.round(s, 3).cast("string"))), ",")
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", mixture.alias("mixture"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).alias("x")).select("doc_id", "x", decontaminate.n_hit("x").alias("n_hit"))
    return found.select(
        "doc_id", F.col("x.n_words").alias("n_words"), "n_hit", (F.size("x.items") + F.col("x.unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("x.items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated(F.col("x.n_words"), F.col("n_hit")).alias("contaminated"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text."""
    done = bpe.encode_decode(docs, TOKENIZER)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(spark, warc.archive_pages(table(spark, sf_dir, "pages")))
    return read.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""



def op4_sql(levels: int = urls.LEVELS) -> str:
    """The template tree in SQL, a few expressions a level, with the same rules and thresholds."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    cases = [(fits.format(*(lambda h, _, t: (h, "/" + t))(*r.partition("/"))), r, said) for said, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    near = "({of} >= 20 AND abs({hits} / {of} - {all_hits} / {all_of}) <= 1.96 * sqrt(({all_hits} / {all_of}) * (1 - {all_hits} / {all_of}) / {of}))"
    rate, leaf = near.format(hits="c.bads", of="c.lab", all_hits="p.bads", all_of="p.lab"), near.format(hits="c.leaves", of="c.n", all_hits="p.leaves", all_of="p.n")
    parts = [
        "r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)",
        f"v AS (SELECT *, {case(1)} AS rule, {case(2)} AS said, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM h)",
        "w AS (SELECT *, list_transform(segs, lambda s: CASE WHEN regexp_full_match(regexp_extract(s, '^[^.]*'), '[0-9a-fA-F-]{8,}') AND regexp_matches(regexp_extract(s, '^[^.]*'), '[0-9]') THEN '{hex}' || substring(s, length(regexp_extract(s, '^[^.]*')) + 1)"
        " WHEN regexp_full_match(regexp_extract(s, '^[^.]*'), '[0-9]+') THEN '{num}' || substring(s, length(regexp_extract(s, '^[^.]*')) + 1) ELSE s END) AS typed FROM v)",
        f"x AS (SELECT page_id, host, path, rule, said, CASE WHEN len(typed) > {levels} THEN list_concat(typed[1:{levels}], ['**']) ELSE typed END AS shape FROM w)",
        "t0 AS (SELECT host, shape, count(*) AS n, count(said) AS lab, count(*) FILTER (WHERE said = 'block') AS bads, '' AS prefix FROM x GROUP BY host, shape)",
    ]
    for k in range(levels + 1):
        parts += [
            f"c{k} AS (SELECT host, prefix, shape[{k + 1}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(bads) AS bads, sum(CASE WHEN len(shape) = {k + 1} THEN n ELSE 0 END) AS leaves FROM t{k} WHERE len(shape) > {k} GROUP BY ALL)",
            f"p{k} AS (SELECT host, prefix, count(*) AS children, max(n) AS top, sum(n) AS n, sum(lab) AS lab, sum(bads) AS bads, sum(leaves) AS leaves FROM c{k} GROUP BY ALL)",
            f"s{k} AS (SELECT c.host, c.prefix, c.seg, CASE WHEN children >= 20 AND top < 0.5 * p.n THEN '*' WHEN coalesce(children > 1 AND {rate} AND {leaf}, false) THEN '+' ELSE c.seg END AS token FROM c{k} c JOIN p{k} p USING (host, prefix))",
            f"t{k + 1} AS (SELECT t.host, t.shape, t.n, t.lab, t.bads, CASE WHEN token IS NULL THEN t.prefix ELSE t.prefix || '/' || token END AS prefix FROM t{k} t LEFT JOIN s{k} s ON s.host = t.host AND s.prefix = t.prefix AND s.seg = t.shape[{k + 1}])",
        ]
    last = f"t{levels + 1}"
    parts.append(f"z AS (SELECT host, prefix, (sum(bads) + 1) / (sum(lab) + 2) >= 0.9 AS bad FROM {last} GROUP BY ALL)")
    return "WITH " + ", ".join(parts) + f" SELECT page_id, x.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM x JOIN {last} l ON l.host = x.host AND l.shape = x.shape JOIN z ON z.host = l.host AND z.prefix = l.prefix"


OP5_SQL = """
WITH l AS (
  SELECT doc_id, source, i, s[i] AS line FROM (
    SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))),
b AS (SELECT line FROM l WHERE trim(regexp_replace(line, '\\s+', '', 'g')) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
f AS (SELECT line, min(row(doc_id, i)) AS first FROM l SEMI JOIN b USING (line) GROUP BY line),
k AS (SELECT l.*, f.first IS NOT NULL AND f.first <> row(l.doc_id, l.i) AS gone FROM l LEFT JOIN f USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM k GROUP BY doc_id
"""

OP8_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw), (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)),
hit AS (SELECT doc_id, i, pos.m AS m, item FROM pos JOIN win USING (m, phrase)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS o FROM sym UNION SELECT sym.b, r.o FROM r JOIN sym ON sym.a = r.doc_id),
m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.o, w.doc_id) AS component_id, coalesce(m.o, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": op1_sharding, "op2_htmltext": op2_htmltext, "op3_topk": op3_topk, "op4_urls": op4_urls, "op5_linededup": op5_linededup, "op6_langid": op6_langid, "op7_bpe": op7_bpe, "op8_decontaminate": op8_decontaminate, "op9_neardup": op9_neardup, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op4_urls": op4_sql(), "op5_linededup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_neardup": OP9_SQL, "op10_warc": OP10_SQL}

"""Queries of this package's operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import bm25_topk, conversation_trie, decontaminate, divergence, html_text, licenses, line_dedup, quality_crf, quality_rules, sentencepiece_codec, sharding, simhash, url_filter
from .common import table

URL_RULES = (
    url_filter.host_rule("com", "/en/", "block"),
    url_filter.host_rule("example.com", "/en/7", "allow"),
    url_filter.host_rule("net", "/de/", "allow"),
    url_filter.host_rule("example.net", "/de/8", "block"),
    url_filter.host_rule("org", "/es/", "block"),
)
SHARD_LIMIT = 16 << 20


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_crf.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filtered(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN regexp_matches(host || path, '/adserver/|/popunder/|/banner/ads/|^([^/]*\.)?doubleclick\..*([^A-Za-z0-9_.%-]|$)|^([^/]*\.)?casino.*([^A-Za-z0-9_.%-]|$)|/tracking/pixel([^A-Za-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (rid)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(concat_ws(chr(10), coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes
  FROM documents),
levels AS (SELECT h, n_bytes, unnest(range(0, 61)) AS depth FROM d),
fits AS (SELECT depth, h >> (60 - depth) AS prefix FROM levels GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_LIMIT} OR count(*) = 1),
deep AS (SELECT d.doc_id, d.h, d.n_bytes, min(f.depth) AS depth FROM d JOIN fits f ON f.prefix = d.h >> (60 - f.depth) GROUP BY ALL)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, depth::INTEGER AS depth, 0::BIGINT AS page, n_bytes, n_bytes > {SHARD_LIMIT} AS oversized FROM deep
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentencepiece_codec.broadcast_model(spark)
    return sentencepiece_codec.encoded(docs, model, ids=None, check=True).select("doc_id", "n_tokens", "ids_xxh64", "round_trip")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.by_document(docs, licenses.scanned(docs, licenses.trained(docs)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, no - 1 AS no, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> ''))) AS s, x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text <> '')),
f AS (SELECT s, len(s) AS n, min((doc_id, no)) AS first FROM l WHERE len(s) > 0 GROUP BY s),
k AS (SELECT s, n, first, row_number() OVER (ORDER BY s) AS id FROM f),
w AS (SELECT id, n, unnest(s) AS tok FROM k),
df AS (SELECT tok, count(*) AS c FROM w GROUP BY tok),
r AS (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS pos FROM w JOIN df USING (tok)),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.tok = b.tok AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      WHERE a.pos <= a.n - (4 * a.n + 4) // 5 + 1 AND b.pos <= b.n - (4 * b.n + 4) // 5 + 1),
m AS (SELECT CASE WHEN a.first < b.first THEN b.id ELSE a.id END AS id FROM p JOIN k a ON a.id = p.a JOIN k b ON b.id = p.b
      WHERE 5 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
g AS (SELECT l.doc_id, l.no, l.x, len(l.s) > 0 AND ((l.doc_id, l.no) > k.first OR k.id IN (SELECT id FROM m)) AS gone FROM l LEFT JOIN k ON k.s = l.s),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, FALSE)), '') AS text FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.text, d.text)) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_text.extracted(F.col("html")).alias("main")).select("page_id", "url", "main.text", "main.n_chars")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, list_slice(w, i, i + least(13, len(w)) - 1) AS win FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spots AS (SELECT rid, m, i, list_slice(w, i, i + m - 1) AS win FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) AS t(i)),
hits AS (SELECT rid, i, m, item FROM spots JOIN bw USING (m, win)),
words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, m FROM hits), unnest(range(0, m)) AS t(k) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op10_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25_topk.top_k(docs, asked).select("query_id", "rank", "doc_id", "score")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS dl, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT doc_id AS query_id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM tf JOIN df USING (t), s WHERE doc_id % 100 = 0),
hit AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM q JOIN tf USING (t), s GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM hit)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


#: crc32 of a text of digits, a byte and then eight shifts at a time.
_CRC = "xor(4294967295, list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT))"
OP11_SQL = rf"""
WITH c AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(t ORDER BY pos) AS own FROM c GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 20 AS base, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN l b ON b.conv_id = h.base),
n AS (
  SELECT d AS depth, seq[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d), '') AS ends
  FROM r, unnest(range(0, len(seq) + 1)) AS t(d) GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS tokens
  FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT up AS depth, path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(tokens) AS saved_tokens FROM w, unnest(range(0, depth + 1)) AS t(up) GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s USING (depth, path) LEFT JOIN n p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS n_terms FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * n_terms))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * n_terms))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality_rules.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _op13_sql() -> str:
    """The rules one after the other: their certified cutoffs, and the one that gains most among bad documents that no earlier rule rejects."""
    rules, steps = quality_rules.RULES, quality_rules.STEPS
    levels = ", ".join(f"(({r.part} * {steps} + greatest({r.whole}, 1) - 1) // greatest({r.whole}, 1))::INTEGER AS l{i}" for i, r in enumerate(rules))
    risk, error = quality_rules.RISK / len(rules), quality_rules.ERROR / len(rules)
    tail = f"list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))"
    chosen = ""
    for i, _ in enumerate(rules):
        earlier = "".join(f" LEFT JOIN c{j} ON c{j}.stratum = h.stratum" for j in range(i))
        free = "".join(f" AND (c{j}.k IS NULL OR l{j} <= c{j}.k)" for j in range(i))
        chosen += f"""
h{i} AS (SELECT h.stratum, g.k, count(*) FILTER (label = 1) AS n, count(*) FILTER (label = 1 AND l{i} > g.k) AS x, count(*) FILTER (label = 0 AND l{i} > g.k{free}) AS caught FROM held h{earlier}, (SELECT unnest(range(0, {steps + 1})) AS k) g GROUP BY h.stratum, g.k),
c{i} AS (SELECT stratum, arg_max(k, (caught - x, k)) AS k FROM h{i} WHERE n > 0 AND x < n * {risk} AND {tail} <= {error} / (SELECT count(DISTINCT stratum) FROM held) AND caught > x GROUP BY stratum),"""
    over = " ".join(f"WHEN l{i} > c{i}.k THEN '{r.name}'" for i, r in enumerate(rules))
    joined = " ".join(f"LEFT JOIN c{i} ON c{i}.stratum = b.stratum" for i, _ in enumerate(rules))
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + 2) AS win FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT rid, win FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN twice USING (rid, win), unnest(range(0, 3)) AS t(k) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) y WHERE regexp_matches(x, '{word}') GROUP BY rid),
m AS (
  SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {levels} FROM m),
said AS (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 3 <> 1 GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT b.*, label FROM b JOIN said USING (doc_id) WHERE NOT base_failed),{chosen}
o AS (SELECT b.*, CASE WHEN base_failed THEN 'base' {over} END AS rejected_by FROM b {joined})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by IS NULL AS kept, rejected_by FROM o
"""


OP13_SQL = _op13_sql()


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_crf": op1_quality_crf,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_licenses": op6_licenses,
        "op7_line_dedup": op7_line_dedup,
        "op10_bm25_topk": op10_bm25_topk,
        "op2_url_filter": op2_url_filter,
        "op3_simhash": op3_simhash,
        "op4_sharding": op4_sharding,
        "op8_html_text": op8_html_text,
        "op9_decontaminate": op9_decontaminate,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_source_divergence": op12_source_divergence,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_url_filter": OP2_SQL, "op4_sharding": OP4_SQL, "op7_line_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_bm25_topk": OP10_SQL}
    sql |= {"op11_conversation_trie": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_quality_rules": OP13_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

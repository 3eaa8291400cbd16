"""Queries of the document store, search and intent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import ascii_folded, tokens
from ..operators import docs as D, intent as I, search as X
from ..sources import store
from ..sources.shared import folder
from .base import DOCS, FILES, MESSAGES, query, role
from .scans import LINES

_CREATED = "saved_at - INTERVAL '1' HOUR * (id % 3) - INTERVAL '1' SECOND * (id % 100)"
BASE = f"SELECT *, CAST({_CREATED} AS TIMESTAMP) AS created_at, concat('finding ', lang, ' topic', id % 5) AS f1, concat('shared topic', id % 3) AS f2, concat('http://s/', id % 11) AS u1, concat('http://t/', source) AS u2 FROM ({DOCS}) d"
DUCK = f"docs AS (SELECT *, [lang, source] AS tags, [f1, f2] AS findings, [u1, u2] AS urls FROM ({BASE}) b)"
AS_OF = "TIMESTAMP '2024-04-01 12:00:00'"


def docs(spark, sf):
    d = role(spark, sf, BASE)
    none = F.array().cast("array<string>")
    return d.withColumns(
        {
            "tags": F.array("lang", "source"),
            "findings": F.array(F.struct(F.col("f1").alias("finding"), F.array("u1").alias("sources")), F.struct(F.col("f2").alias("finding"), none.alias("sources"))),
            "sources": F.array(F.struct(F.col("u1").alias("url"), F.lit("one").alias("title"), F.lit(0.5).alias("relevance")), F.struct(F.col("u2").alias("url"), F.lit("two").alias("title"), F.lit(0.9).alias("relevance"))),
        }
    )


def as_of():
    return F.expr(AS_OF)


PLANS = "SELECT o_orderkey AS id, concat('plan ', o_orderkey) AS query, CAST(o_custkey % 5 AS INT) AS depth, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders"

# ---- scalar text

_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-zäöüß0-9]+'), lambda w: length(w) > 1)"


@query("tokenize", f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return role(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("ascii_fold", "SELECT doc_id, regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def _(spark, sf):
    return role(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", ascii_folded(F.col("text")).alias("folded"))


@query("search_text", f"WITH {DUCK} SELECT id, concat_ws(' ', query, summary, f1 || ' ' || f2, 'one ' || u1 || ' two ' || u2) AS text FROM docs")
def _(spark, sf):
    d = docs(spark, sf)
    return d.select("id", X.search_text(d).alias("text"))


# ---- ranking

_TERMS = f"t AS (SELECT id, {_TOKENS.format('summary')} AS w FROM docs), tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t)"
QUERY = "the attion pour the"
_SCORES = (
    f"q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_TOKENS.format(chr(39) + QUERY + chr(39))}) AS term) GROUP BY term), sc AS (SELECT id, sum(qtf * ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) LEFT JOIN df USING (term), st GROUP BY id HAVING score >= 0.01)"
)


def terms(spark, sf):
    return X.term_table(role(spark, sf, BASE), F.col("summary"))


def stats(spark, sf):
    return X.corpus_stats(role(spark, sf, BASE), F.col("summary"))


@query("corpus_stats", f"WITH {DUCK}, {_TERMS} SELECT n::BIGINT AS n, (SELECT count(*) FROM df)::BIGINT AS terms, round(avgdl, 6) AS avgdl, (SELECT sum(df) FROM df)::BIGINT AS postings FROM st")
def _(spark, sf):
    df = X.document_frequency(terms(spark, sf)).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    return stats(spark, sf).drop("terms").crossJoin(F.broadcast(df)).select("n", "terms", F.round("avgdl", 6).alias("avgdl"), "postings")


def scores(spark, sf):
    return X.searched(role(spark, sf, BASE), F.col("summary"), QUERY)


@query("bm25_search", f"WITH {DUCK}, {_TERMS}, {_SCORES} SELECT id, round(score, 3) AS score FROM sc JOIN docs USING (id) ORDER BY sc.score DESC, saved_at DESC, id LIMIT 50")
def _(spark, sf):
    return X.top(docs(spark, sf), scores(spark, sf), 50).select("id", "score")


@query("bm25_indexed", f"WITH {DUCK}, {_TERMS}, {_SCORES} SELECT id, round(score, 3) AS score FROM sc")
def _(spark, sf):
    name = f"corpus_{uuid.uuid4().hex}"
    base = role(spark, sf, BASE)
    X.index_documents(base.where("id % 3 > 0"), F.col("summary"), name)
    X.index_documents(base.where("id % 3 = 0"), F.col("summary"), name)
    return X.index_searched(spark, name, QUERY).select("id", F.round("score", 3).alias("score"))


@query("bm25_faceted", f"WITH {DUCK}, {_TERMS}, {_SCORES} SELECT id, round(score, 3) AS score FROM sc JOIN docs USING (id) WHERE lang IN ('en', 'fr') AND status = 'completed' ORDER BY sc.score DESC, saved_at DESC, id LIMIT 10")
def _(spark, sf):
    return X.top(X.faceted(docs(spark, sf), [" EN ", "fr"], "Completed"), scores(spark, sf), 10).select("id", "score")


@query("facet_filter", f"WITH {DUCK} SELECT id FROM docs WHERE (lang = 'de' OR source = 'src3') AND status = 'partial' AND saved_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-03-01'")
def _(spark, sf):
    return X.faceted(docs(spark, sf), ["de", "SRC3"], "partial", F.expr("TIMESTAMP '2024-01-05'"), F.expr("TIMESTAMP '2024-03-01'")).select("id")


_PLAN_TEXT = "SELECT item_id AS id, text AS summary FROM benchmark WHERE item_id % 2 = 1"


@query(
    "bm25_orphans",
    f"WITH {DUCK}, {_TERMS}, p AS (SELECT id, {_TOKENS.format('summary')} AS w FROM ({_PLAN_TEXT}) x), pt AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM p) GROUP BY id, term), q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_TOKENS.format(chr(39) + QUERY + chr(39))}) AS term) GROUP BY term) SELECT id, round(sum(qtf * ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 3) AS score FROM pt JOIN q USING (term) LEFT JOIN df USING (term), st GROUP BY id",
)
def _(spark, sf):
    plans = D.orphans(role(spark, sf, "SELECT item_id AS id, text AS summary FROM benchmark"), role(spark, sf, "SELECT item_id AS id FROM benchmark WHERE item_id % 2 = 0"))
    return X.searched(role(spark, sf, BASE), F.col("summary"), QUERY, within=plans).select("id", F.round("score", 3).alias("score"))


@query("all_terms_match", f"WITH {DUCK} SELECT id FROM docs WHERE contains(lower(summary), 'the') AND contains(lower(summary), 'attion') ORDER BY saved_at DESC, id LIMIT 5")
def _(spark, sf):
    return X.all_terms(docs(spark, sf), "The a attion", F.col("summary")).select("id")


_INTO = "SELECT doc_id AS id, CAST(floor(doc_id / 13) * 3 + CASE WHEN doc_id % 13 < 5 THEN 0 WHEN doc_id % 13 < 7 THEN 1 ELSE 2 END AS BIGINT) AS target, CAST(doc_id % 13 AS INT) AS pos FROM documents"


@query("relevance_top3", f"""WITH {DUCK}, a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) AS x FROM a),
 w AS (SELECT DISTINCT conv_id, turn, regexp_replace(lower(x), '^[.,!?;:()\\[\\]{{}}''"]+|[.,!?;:()\\[\\]{{}}''"]+$', '', 'g') AS word FROM s WHERE length(x) > 2 AND lower(x) NOT IN ({", ".join(repr(x) for x in X.STOP_WORDS)})),
 u AS (SELECT DISTINCT word FROM w WHERE word <> ''), m AS (SELECT word, id FROM u JOIN docs ON contains(lower(summary), word)),
 h AS (SELECT conv_id, turn, id, count(*) AS matches FROM w JOIN m USING (word) GROUP BY ALL) SELECT conv_id, turn, id, matches::BIGINT AS matches, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY matches DESC, id) AS rank FROM h) WHERE rank <= 3""")
def _(spark, sf):
    asked = role(spark, sf, "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
    return X.relevance(asked, role(spark, sf, "SELECT doc_id AS id, text FROM documents"), ["conv_id", "turn"], F.col("text"))


@query("merge_rejected", f"SELECT target, CASE WHEN count(*) < 2 THEN 'at least 2 documents are needed' ELSE 'at most 5 documents can be merged' END AS reason FROM ({_INTO}) i GROUP BY target HAVING count(*) NOT BETWEEN 2 AND 5")
def _(spark, sf):
    return D.merge_rejected(role(spark, sf, _INTO))


@query("dup_blocks", f"""WITH {LINES}, b AS (SELECT path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS bare FROM lines), r AS (SELECT path, list(bare) OVER w AS run FROM b WHERE bare <> '' WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 g AS (SELECT array_to_string(run, chr(10)) AS block, count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS files, min(path) AS first_path FROM r WHERE len(run) = 3 GROUP BY 1) SELECT * FROM g WHERE n > 1 ORDER BY n DESC, first_path, block LIMIT 50""")
def _(spark, sf):
    from ..operators.scan import lines

    return X.duplicate_blocks(lines(role(spark, sf, FILES)), 3)


@query("near_dup_blocks")
def _(spark, sf):
    from ..operators.scan import lines

    return X.near_duplicate_blocks(lines(role(spark, sf, FILES)), 3, 0.7, n=None)


@query("near_dup_docs", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
 s AS (SELECT doc_id, list_sort(list(g)) AS s FROM g GROUP BY doc_id), k AS (SELECT min(doc_id) AS k, s, len(s) AS n FROM s GROUP BY s),
 e AS (SELECT k, n, unnest(s) AS g FROM k), h AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.k < b.k GROUP BY ALL)
 SELECT a, b, round(i / (na + nb - i), 9) AS similarity FROM h WHERE i / (na + nb - i) >= 0.8""")
def _(spark, sf):
    d = role(spark, sf, "SELECT doc_id AS id, text FROM documents")
    return X.near_duplicates(d, F.col("text")).select("a", "b", F.round("similarity", 9).alias("similarity"))


# ---- the store

_REQ = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'ab' WHEN 2 THEN 'ASDF' WHEN 3 THEN repeat('x', 2001) ELSE concat('query ', event_id) END AS query, CAST(event_id % 9 - 1 AS INT) AS depth, CAST(user_id AS INT) AS max_sources FROM events"


@query("request_validate", f"WITH r AS ({_REQ}) SELECT event_id, CASE WHEN trim(query) = '' THEN 'empty' WHEN length(trim(query)) < 3 THEN 'too short' WHEN lower(trim(query)) IN ('test','abc','foo','bar','asdf','xyz') THEN 'test' WHEN length(trim(query)) > 2000 THEN 'too long' END AS reason, greatest(1, least(5, depth)) AS depth, greatest(1, least(50, max_sources)) AS max_sources FROM r")
def _(spark, sf):
    return D.admitted(role(spark, sf, _REQ)).select("event_id", "reason", "depth", "max_sources")


_RAW = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('["a', doc_id, '","b"]') WHEN 1 THEN concat('[{"finding":"f', lang, '","sources":["s"]},{"finding":"g"}]') WHEN 2 THEN 'not json' ELSE '[]' END AS findings, CASE doc_id % 3 WHEN 0 THEN '["http://u"]' WHEN 1 THEN '[{"url":"v","title":"t","relevance":0.9},{"url":"w"}]' ELSE NULL END AS sources FROM documents"""


@query("normalize_doc_arrays", f"WITH r AS ({_RAW}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('a', doc_id, '|b') WHEN 1 THEN concat((findings::JSON)->0->>'finding', '|g') ELSE '' END AS findings, CASE doc_id % 3 WHEN 0 THEN 'http://u:http://u:0.5' WHEN 1 THEN 'v:t:0.9|w::0.5' ELSE '' END AS sources FROM r")
def _(spark, sf):
    r = role(spark, sf, _RAW)
    s = F.transform(D.source_array(F.col("sources")), lambda x: F.concat(x["url"], F.lit(":"), x["title"], F.lit(":"), x["relevance"].cast("string")))
    return r.select("doc_id", F.array_join(F.transform(D.finding_array(F.col("findings")), lambda x: x["finding"]), "|").alias("findings"), F.array_join(s, "|").alias("sources"))


_PAY = """SELECT o_orderkey AS id, concat('s', o_custkey) AS summary, concat('["f', o_custkey, '"]') AS findings, '["u"]' AS sources, CASE o_orderkey % 4 WHEN 0 THEN 'bad' ELSE 'completed' END AS status FROM orders WHERE o_custkey % 2 = 0"""


@query("doc_save", f"WITH p AS ({PLANS}), y AS ({_PAY}) SELECT id, summary, concat('f', substr(summary, 2)) AS finding, status FROM p JOIN y USING (id) WHERE status <> 'bad' AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def _(spark, sf):
    done = role(spark, sf, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0")
    return D.saved(role(spark, sf, PLANS), role(spark, sf, _PAY), done).select("id", "summary", F.get("findings", F.lit(0))["finding"].alias("finding"), "status")


@query("doc_status", f"WITH {DUCK}, p AS (SELECT id FROM docs WHERE id % 10 = 0), d AS (SELECT * FROM docs WHERE id % 10 > 2), a AS (SELECT id FROM docs), x AS (SELECT a.id, p.id IS NOT NULL AS planned, d.status, CAST(epoch(d.saved_at) - epoch(d.created_at) AS BIGINT) AS s FROM a LEFT JOIN p USING (id) LEFT JOIN d USING (id)) SELECT id, CASE WHEN planned THEN 'planned' ELSE coalesce(status, 'not_found') END AS state, CASE WHEN planned OR s IS NULL THEN NULL WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s // 3600, 'h ', s % 3600 // 60, 'm') END AS duration FROM x")
def _(spark, sf):
    d = docs(spark, sf)
    return D.status_view(d.where("id % 10 = 0").select("id"), d.where("id % 10 > 2"), d.select("id"))


@query("result_list", f"WITH {DUCK} SELECT id, query, status, len(findings)::INTEGER AS findings_count, len(urls)::INTEGER AS sources_count FROM docs")
def _(spark, sf):
    return docs(spark, sf).select("id", "query", "status", F.size("findings").alias("findings_count"), F.size("sources").alias("sources_count"))


@query("orphan_plans", f"WITH p AS ({PLANS}) SELECT id, query FROM p WHERE id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return D.orphans(role(spark, sf, PLANS), docs(spark, sf)).select("id", "query")


@query("retain_newest", f"WITH {DUCK} SELECT id FROM docs ORDER BY saved_at DESC, id LIMIT 100")
def _(spark, sf):
    return D.newest(docs(spark, sf)).select("id")


@query("ttl_cleanup", f"WITH {DUCK}, p AS ({PLANS}) SELECT 'plan' AS kind, id, CASE WHEN id NOT IN (SELECT id FROM docs) AND created_at < {AS_OF} - INTERVAL 3650 DAY THEN 'delete' ELSE 'keep' END AS action FROM p UNION ALL SELECT 'result', id, CASE WHEN saved_at < {AS_OF} - INTERVAL 3650 DAY THEN 'delete' ELSE 'keep' END FROM docs")
def _(spark, sf):
    return D.cleaned(role(spark, sf, PLANS), docs(spark, sf), as_of(), 3650, True)


_EDITS = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'set' WHEN 3 THEN 'clear' ELSE 'odd' END AS action FROM documents WHERE doc_id % 2 = 0"


@query("tag_edit", f"WITH {DUCK}, e AS ({_EDITS}) SELECT id, array_to_string(CASE action WHEN 'add' THEN list_concat(tags, CASE WHEN lang = 'en' THEN ['new-tag'] ELSE ['en', 'new-tag'] END) WHEN 'remove' THEN list_filter(tags, lambda t: t <> 'en') WHEN 'set' THEN ['en', 'new-tag'] WHEN 'clear' THEN [] ELSE tags END, ',') AS tags FROM docs LEFT JOIN e USING (id)")
def _(spark, sf):
    edits = role(spark, sf, _EDITS).withColumn("edit_tags", F.array(F.lit(" EN"), F.lit("New Tag"), F.lit("")))
    return D.tagged(docs(spark, sf), edits).select("id", F.array_join("tags", ",").alias("tags"))


_PATCH = """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat(' s', doc_id, ' ') END AS new_summary, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'bad' END AS new_status, CASE doc_id % 5 WHEN 0 THEN '["x"]' END AS append_findings FROM documents WHERE doc_id % 2 = 1 OR doc_id % 8 = 0"""


@query("doc_update", f"WITH {DUCK}, p AS (SELECT * FROM ({_PATCH}) x WHERE new_status IS NULL OR new_status <> 'bad') SELECT id, md5(coalesce(trim(new_summary), summary)) AS summary, coalesce(new_status, status) AS status, len(findings)::INTEGER + CASE WHEN append_findings IS NULL THEN 0 ELSE 1 END AS n, coalesce(new_summary IS NOT NULL OR new_status IS NOT NULL OR append_findings IS NOT NULL, FALSE) AS updated FROM docs LEFT JOIN p USING (id)")
def _(spark, sf):
    return D.updated(docs(spark, sf), role(spark, sf, _PATCH)).select("id", F.md5("summary").alias("summary"), "status", F.size("findings").alias("n"), "updated")


@query("merge_dedupe", f"WITH {DUCK}, u AS (SELECT id, unnest(urls) AS url, unnest([0, 1]) AS pos FROM docs) SELECT url, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id, pos) AS n FROM u) WHERE n = 1")
def _(spark, sf):
    each = docs(spark, sf).select("id", F.posexplode("sources").alias("pos", "s")).select("id", "pos", F.col("s.url").alias("url"))
    return D.first_seen(each, [], "url", ["id", "pos"]).select("url", "id", "pos")




@query("doc_merge", f"""WITH {DUCK}, i AS ({_INTO}), d AS (SELECT * FROM docs JOIN i USING (id) WHERE target IN (SELECT target FROM i GROUP BY target HAVING count(*) BETWEEN 2 AND 5)),
 f AS (SELECT target, pos, unnest(findings) AS x, unnest([0, 1]) AS k FROM d), f1 AS (SELECT target, string_agg(x, '|' ORDER BY pos, k) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY target, x ORDER BY pos, k) AS n FROM f) WHERE n = 1 GROUP BY target),
 g AS (SELECT target, pos, unnest(tags) AS x, unnest([0, 1]) AS k FROM d), g1 AS (SELECT target, string_agg(x, '|' ORDER BY pos, k) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY target, x ORDER BY pos, k) AS n FROM g) WHERE n = 1 GROUP BY target)
 SELECT target, max(depth)::BIGINT AS depth, md5(string_agg(substr(summary, 1, 300), ' | ' ORDER BY pos)) AS summary, any_value(findings) AS findings, any_value(tags) AS tags FROM (SELECT target, depth, summary, pos FROM d) JOIN f1 USING (target) JOIN g1 USING (target) GROUP BY target""")
def _(spark, sf):
    return D.merged(docs(spark, sf), role(spark, sf, _INTO)).select("target", "depth", F.md5("summary").alias("summary"), F.array_join("findings", "|").alias("findings"), F.array_join("tags", "|").alias("tags"))


@query("doc_delete", f"WITH {DUCK} SELECT id FROM docs WHERE id NOT IN (SELECT item_id FROM benchmark)")
def _(spark, sf):
    return D.deleted(docs(spark, sf).select("id"), role(spark, sf, "SELECT item_id AS id FROM benchmark"))


@query("partial_closeout", f"WITH p AS ({PLANS}), c AS (SELECT event_id AS id, 1 AS k FROM events UNION ALL SELECT user_id, 1 FROM events) SELECT id, query, 'partial' AS status, count(*)::BIGINT AS calls FROM p JOIN c USING (id) WHERE id NOT IN (SELECT doc_id FROM documents) GROUP BY ALL")
def _(spark, sf):
    calls = role(spark, sf, "SELECT event_id AS id FROM events UNION ALL SELECT user_id FROM events")
    return D.partial_closeout(role(spark, sf, PLANS), docs(spark, sf), calls)


_URLS = "SELECT concat('http://s/', s_suppkey) AS url, CAST(100 + s_suppkey * 60 AS INT) AS status FROM supplier"


@query("source_verify", f"WITH {DUCK}, u AS ({_URLS}), e AS (SELECT id, unnest(urls) AS url FROM docs), j AS (SELECT id, coalesce(u.status > 0 AND u.status < 400, FALSE) AS ok FROM e LEFT JOIN u USING (url)) SELECT id, count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS verified, count(*) FILTER (NOT ok)::BIGINT AS failed FROM j GROUP BY id")
def _(spark, sf):
    return D.verified(docs(spark, sf), role(spark, sf, _URLS))


@query("doc_stats", f"WITH {DUCK} SELECT status, count(*)::BIGINT AS n, (2 * count(*))::BIGINT AS sources, (2 * count(*))::BIGINT AS findings FROM docs GROUP BY status")
def _(spark, sf):
    return D.stats(docs(spark, sf))


@query("tag_top", f"WITH {DUCK} SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def _(spark, sf):
    return D.top_tags(docs(spark, sf))


@query("age_histogram", f"WITH {DUCK}, b AS (SELECT CASE WHEN d < 1 THEN 0 WHEN d < 7 THEN 1 WHEN d < 30 THEN 2 ELSE 3 END AS bucket FROM (SELECT floor((epoch({AS_OF}) - epoch(saved_at)) / 86400) AS d FROM docs)) SELECT bucket, days, count(b.bucket)::BIGINT AS n FROM (VALUES (0, '< 1'), (1, '1-7'), (2, '7-30'), (3, '> 30')) AS t(bucket, days) LEFT JOIN b USING (bucket) GROUP BY ALL")
def _(spark, sf):
    return D.age_histogram(docs(spark, sf), as_of())


@query("common_keywords", f"WITH {DUCK}, w AS (SELECT source, unnest(string_split(lower(f1), ' ')) AS word FROM docs UNION ALL SELECT source, unnest(string_split(lower(f2), ' ')) FROM docs), c AS (SELECT source, word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c), k AS (SELECT source, count(*) AS docs FROM docs GROUP BY 1) SELECT source, word, n::BIGINT AS n FROM r JOIN k USING (source) WHERE rank <= 15 AND n >= docs")
def _(spark, sf):
    return D.common_keywords(docs(spark, sf), "source")


@query("doc_compare", f"WITH {DUCK} SELECT source, count(*)::BIGINT AS docs, (2 * count(*))::BIGINT AS findings, (SELECT count(DISTINCT u) FROM (SELECT d.source AS s, unnest(d.urls) AS u FROM docs d) WHERE s = source)::BIGINT AS urls FROM docs GROUP BY source")
def _(spark, sf):
    return D.compared(docs(spark, sf), "source")


_CSV = "SELECT id, query, status, lang || ',' || source AS tags, 2 AS findings_count, 2 AS sources_count, substr(replace(summary, ';', ','), 1, 200) AS summary FROM docs"


@query("export_csv_rows", f"WITH {DUCK} {_CSV}")
def _(spark, sf):
    return D.csv_rows(docs(spark, sf))


@query("export_markdown", f"""WITH {DUCK} SELECT id, md5(concat_ws(chr(10), '# Research: ' || query, '**Status:** ' || status, '## Summary', summary, '## Findings (2)', '### 1. ' || f1 || chr(10) || '   - Source: ' || u1, '### 2. ' || f2, '## Sources (2)', '- [one](' || u1 || ') (relevance: 0.5)', '- [two](' || u2 || ') (relevance: 0.9)')) AS md FROM docs""")
def _(spark, sf):
    d = docs(spark, sf)
    return d.select("id", F.md5(D.markdown(d)).alias("md"))


@query("sink_json_roundtrip", f"WITH {DUCK} SELECT id, status, md5(summary) AS summary, lang FROM docs")
def _(spark, sf):
    path = folder(spark, "json")
    store.write_json(docs(spark, sf).select("id", "status", "summary", "lang"), path, "lang")
    store.write_json(docs(spark, sf).where("lang = 'de'").select("id", "status", "summary", "lang"), path, "lang")
    return spark.read.schema("id long, status string, summary string, lang string").json(path).select("id", "status", F.md5("summary").alias("summary"), "lang")


@query("docs_from_json", f"WITH {DUCK} SELECT id, status FROM docs WHERE id % 3 > 0")
def _(spark, sf):
    path = folder(spark, "texts")
    rows = docs(spark, sf).select(F.when(F.col("id") % 3 == 0, F.lit('{"id": oops')).otherwise(F.to_json(F.struct("id", "status"))).alias("value"))
    rows.write.text(path)
    return store.read_json(spark, path, "id long, status string")


# ---- intent

KEYWORDS = {"bug": ("zzbug", "thion"), "research": ("tionsh",), "db": ("quequ", "ererer"), "web": ("the ",), "code": ("en", "un ")}
PATTERNS = (("architecture", ("th.*tion", "ing")), ("deadcode", ("que", "de la", "een")), ("code", ("sch", "en ", "ver")), ("none", ("zzzz",)))


def messages(spark, sf):
    return role(spark, sf, MESSAGES)


@query("last_user_message", f"WITH m AS ({MESSAGES}) SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM m WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return I.last_user_message(messages(spark, sf))


def _contains(words, c="lower(text)"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("intent_weighted", f"WITH m AS ({MESSAGES}) SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_contains(KEYWORDS[d])} THEN '{d}'" for d in ("bug", "research", "db", "web", "code")) + " END AS domain FROM m")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", I.weighted(F.col("text"), KEYWORDS).alias("domain"))


_FOLD = "regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\x00-\\x7F]', '', 'g')"
_SCORE = ", ".join(f"({' + '.join(f'regexp_matches(t, {p!r})::INT' for p in ps)}) AS s{i}" for i, (_, ps) in enumerate(PATTERNS))


@query("intent_scored", f"WITH m AS (SELECT conv_id * 1000 + turn AS k, {_FOLD} AS t FROM conversations), s AS (SELECT k, {_SCORE} FROM m) SELECT k, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'architecture' WHEN s1 >= s2 THEN 'deadcode' ELSE 'code' END AS intent, greatest(s0, s1, s2) AS score FROM s WHERE greatest(s0, s1, s2) > 0")
def _(spark, sf):
    return I.scored(role(spark, sf, "SELECT conv_id * 1000 + turn AS k, text FROM conversations"), PATTERNS, "k")


@query("intent_gate", f"SELECT conv_id, turn::INTEGER AS turn, regexp_matches({_FOLD}, 'que|tion|prf') AS hit FROM conversations")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", I.gate(F.col("text"), ("que", "tion", "prf")).alias("hit"))


_ARGS = """SELECT page_id, concat('{"url":"', url, repeat('x', CAST(page_id % 90 AS INT)), '","name":"n', page_id, '","query":"', CASE page_id % 2 WHEN 0 THEN 'q' ELSE '' END, '","path":"p"}') AS args FROM pages"""


@query("arg_summary", "WITH a AS (SELECT page_id, url || repeat('x', CAST(page_id % 90 AS INT)) AS u FROM pages), c AS (SELECT page_id, CASE WHEN length(u) > 80 THEN substr(u, 1, 77) || '...' ELSE u END AS u FROM a) SELECT page_id, 'path=p, ' || CASE page_id % 2 WHEN 0 THEN 'query=q, url=' || u ELSE 'url=' || u || ', name=n' || page_id END AS summary FROM c")
def _(spark, sf):
    return role(spark, sf, _ARGS).select("page_id", I.argument_summary(F.col("args")).alias("summary"))


@query("tool_domains", "SELECT CASE WHEN starts_with(event_type, 'p') THEN 'research' WHEN starts_with(event_type, 'e') THEN 'bug' WHEN starts_with(event_type, 'c') THEN 'analysis' ELSE 'other' END AS domain, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(spark, sf):
    d = I.tool_domain(F.col("event_type"), {"p": "research", "e": "bug", "c": "analysis"})
    return role(spark, sf, "SELECT * FROM events").groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n"))

"""Queries of rules, scans and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as O, rules as R, scan as S
from ..sources import files as files_of
from ..sources.shared import folder
from .base import FILES, FINDINGS, RULES, SESSIONS, query, role, values

# The library's own small rule set; words and shapes that occur in ordinary text.
LIBRARY = (
    S.Rule("L001", "licence notice", "P2", "dependency", "grep", r"(?i)licen[sc]e"),
    S.Rule("L002", "address", "P1", "security", "grep", r"\d{1,3}(\.\d{1,3}){3}"),
    S.Rule("L003", "mail address", "P1", "security", "grep", r"[\w.]+@[\w.]+", "**/*.{en,de}"),
    S.Rule("L004", "credential", "P0", "security", "grep", r"(?i)(password|secret|token|api[_-]?key)\s*[:=]"),
    S.Rule("L005", "symbol soup", "P3", "code-quality", "grep", r"[#$%&*]{3} ", "*.fr"),
    S.Rule("L006", "never", "P3", "testing", "grep", r"zzzzqqqq"),
    S.Rule("L007", "by hand", "P2", "other", "code_search", "x"),
    S.Rule("L008", "other", "P2", "other", "version", ""),
)

LINES = f"""files AS ({FILES}), lines AS (SELECT project, path, ext, CAST(no AS INTEGER) AS line_no, line FROM (SELECT project, path, ext, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM files WHERE NOT contains(content, chr(0))))"""
_GREPS = [r for r in LIBRARY if r.scan_type == "grep"]
_GLOB_SQL = {r.id: S.glob_regex(r.scan_file_glob) for r in LIBRARY}
HITS = LINES + ", hits AS (" + " UNION ALL ".join(
    f"SELECT project, '{r.id}' AS pattern_id, '{r.severity}' AS severity, '{r.name}' AS title, '{r.category}' AS category, path AS file, line_no AS line, substr(trim(line), 1, 200) AS evidence FROM lines WHERE regexp_matches(line, '{r.scan_query}')"
    + (f" AND regexp_matches(path, '{_GLOB_SQL[r.id]}')" if r.scan_file_glob else "")
    for r in _GREPS
) + ")"


def files(spark, sf):
    return role(spark, sf, FILES)


def hits(spark, sf):
    return S.batch(S.lines(files(spark, sf)), LIBRARY)


def entry(spark, sf):
    return S.severity_counts(hits(spark, sf))


DIM = values([(s, i) for i, s in enumerate(R.SEVERITIES)], "severity, rank")


@query("corpus_inventory", f"WITH f AS ({FILES}) SELECT project, path, string_split(path, '/')[-1] AS name, ext, strlen(content)::BIGINT AS size FROM f WHERE NOT regexp_matches(path, '(^|/)(src3|src7)/')")
def _(spark, sf):
    return S.inventory(files(spark, sf), ("src3", "src7"))


GLOBS = ("*.en", "src1/*.{de,fr}", "**/1?.en", "src?/*7.*")


@query("glob_select", f"WITH f AS ({FILES}) " + " UNION ALL ".join(f"SELECT project, path, '{g}' AS glob FROM f WHERE regexp_matches(path, '{S.glob_regex(g)}')" for g in GLOBS))
def _(spark, sf):
    return S.selected(files(spark, sf), GLOBS)


@query("line_explode", f"WITH {LINES} SELECT path, line_no, substr(trim(line), 1, 200) AS line FROM lines")
def _(spark, sf):
    return S.lines(files(spark, sf)).select("path", "line_no", S.evidence(F.col("line")).alias("line"))


@query("scan_single", f"WITH {HITS} SELECT * FROM hits WHERE pattern_id = 'L003'")
def _(spark, sf):
    return S.batch(S.lines(files(spark, sf)), [LIBRARY[2]])


query("scan_batch", f"WITH {HITS} SELECT * FROM hits")(hits)


@query("scan_capped", f"WITH {HITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY file, line)::INTEGER AS n FROM hits) WHERE n <= 20")
def _(spark, sf):
    return S.capped(hits(spark, sf))


_RULE_VALUES = values([(r.id, r.scan_type) for r in LIBRARY], "pattern_id, scan_type")


@query("rule_match_count", f"WITH {HITS}, r AS {_RULE_VALUES} SELECT pattern_id, count(DISTINCT project)::BIGINT AS match_count FROM r LEFT JOIN hits USING (pattern_id) GROUP BY pattern_id")
def _(spark, sf):
    return S.match_counts(hits(spark, sf), LIBRARY)


@query("scan_outcome", f"WITH {HITS}, r AS {_RULE_VALUES}, c AS (SELECT pattern_id, count(*) AS n FROM hits GROUP BY 1) SELECT pattern_id, CASE WHEN scan_type = 'grep' THEN CASE WHEN n > 0 THEN 'hits' ELSE 'none' END WHEN scan_type IN ('code_search', 'code_diagnostics') THEN 'manual' ELSE 'unknown' END AS outcome, coalesce(n, 0)::BIGINT AS hits FROM r LEFT JOIN c USING (pattern_id)")
def _(spark, sf):
    return S.outcomes(hits(spark, sf), LIBRARY)


query("scan_summary", f"WITH {HITS}, d AS {DIM} SELECT severity, rank, count(pattern_id)::BIGINT AS n FROM d LEFT JOIN hits USING (severity) GROUP BY ALL")(entry)

PAYLOADS = """SELECT doc_id, concat('{"findings":[{"file":"f', doc_id % 9, '.py","line":', n_chars, ',"description":"d', lang, '","severity":"', CASE doc_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'critical' WHEN 2 THEN 'odd' ELSE 'low' END, '"}],"errors":[{"file":"', source, '","line":', doc_id, ',"match":"m"}]}') AS payload FROM documents"""


@query(
    "payload_to_findings",
    f"""WITH p AS ({PAYLOADS}), j AS (SELECT doc_id, payload::JSON AS j FROM p) SELECT doc_id, 'security' AS kind, j->'findings'->0->>'file' AS file, CAST(j->'findings'->0->>'line' AS INTEGER) AS line, j->'findings'->0->>'description' AS evidence,
 CASE upper(j->'findings'->0->>'severity') WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'MEDIUM' THEN 'P2' WHEN 'LOW' THEN 'P3' WHEN 'INFO' THEN 'INFO' ELSE 'P2' END AS severity FROM j
 UNION ALL SELECT doc_id, 'error', j->'errors'->0->>'file', CAST(j->'errors'->0->>'line' AS INTEGER), j->'errors'->0->>'match', 'P2' FROM j""",
)
def _(spark, sf):
    from ..sources.payloads import payload_findings

    return payload_findings(role(spark, sf, PAYLOADS), "doc_id")


RESPONSES = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('{"content":[{"text":"a', doc_id, '"},{"text":"b', lang, '"}]}') WHEN 1 THEN concat('{"text":"t', source, '"}') WHEN 2 THEN concat('{"result":"r', doc_id, '"}') ELSE '{"other":1}' END AS response FROM documents"""


@query("payload_text", f"""WITH r AS ({RESPONSES}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat((response::JSON)->'content'->0->>'text', chr(10), (response::JSON)->'content'->1->>'text') WHEN 1 THEN (response::JSON)->>'text' WHEN 2 THEN (response::JSON)->>'result' ELSE '' END AS text FROM r""")
def _(spark, sf):
    from ..sources.payloads import response_text

    return role(spark, sf, RESPONSES).select("doc_id", response_text(F.col("response")).alias("text"))


LOGS = """SELECT event_id, ts, CASE event_type WHEN 'error' THEN concat('<Message level=Error> e', event_id, chr(10), 'ok ', user_id) WHEN 'signup' THEN concat('Warning: slow ', user_id) ELSE 'fine' END AS raw FROM events"""
REQUESTS = """SELECT event_id, ts, concat(' reqid=', event_id, ' GET /u/', user_id, ' [', 200 + (event_id * 37) % 400, '] ', chr(10), 'done') AS raw FROM events"""


@query("console_errors", f"WITH l AS ({LOGS}), x AS (SELECT event_id, unnest(string_split(raw, chr(10))) AS line FROM l) SELECT event_id, substr(line, 1, 200) AS evidence, CASE WHEN contains(lower(line), 'error') THEN 'P1' ELSE 'P2' END AS severity FROM x WHERE regexp_matches(lower(line), 'error|warn')")
def _(spark, sf):
    return S.console_errors(role(spark, sf, LOGS)).select("event_id", "evidence", "severity")


@query("network_errors", f"WITH l AS ({REQUESTS}), x AS (SELECT event_id, unnest(string_split(raw, chr(10))) AS line FROM l), s AS (SELECT *, TRY_CAST(regexp_extract(line, '\\[(\\d{{3}})\\]', 1) AS INTEGER) AS status FROM x) SELECT event_id, status, substr(trim(line), 1, 200) AS evidence, CASE WHEN status >= 500 THEN 'P1' ELSE 'P2' END AS severity FROM s WHERE status >= 400")
def _(spark, sf):
    return S.network_errors(role(spark, sf, REQUESTS)).select("event_id", "status", "evidence", "severity")


@query("severity_map", "SELECT event_id, CASE upper(event_type) WHEN 'ERROR' THEN 'P2' ELSE CASE upper(CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'INFO' ELSE event_type END) WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'INFO' THEN 'INFO' ELSE 'P2' END END AS severity FROM events")
def _(spark, sf):
    said = F.expr("CASE WHEN event_type = 'error' THEN 'error' ELSE CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'INFO' ELSE event_type END END")
    return role(spark, sf, "SELECT * FROM events").select("event_id", R.map_severity(said).alias("severity"))


def _secret_sql(regex: str, kind: str, blocking: bool) -> str:
    r = regex.replace("'", "''")
    test = "" if blocking else " AND NOT regexp_matches(path, '/tests/|^tests/|/test_|^test_|/fixtures/|/mock/|/__snapshots__/')"
    found = f"SELECT path, content, regexp_extract_all(content, '{r}') AS m, regexp_split_to_array(content, '{r}') AS p FROM files WHERE regexp_matches(content, '{r}'){test}"
    place = "list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)"
    return f"SELECT path, '{kind}' AS kind, {blocking} AS blocking, replace(substr(content, greatest(place - 19, 1)::BIGINT, (place + size + 20 - greatest(place - 19, 1) + 1)::BIGINT), chr(10), '\\n') AS context FROM (SELECT path, content, length(m[i]) AS size, {place} AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found}) x) y) z"


@query("secret_scan", f"WITH files AS ({FILES}) " + " UNION ALL ".join(_secret_sql(*s) for s in S.SECRETS))
def _(spark, sf):
    return S.secrets(files(spark, sf))


MARKED = "SELECT source AS project, concat(source, '/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.md' END) AS path, CASE doc_id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'md' END AS ext, concat(text, CASE doc_id % 4 WHEN 0 THEN concat(chr(10), ' ======= ', chr(10), '>>>>>>> x', chr(10), 'import pdb; pdb.set_trace()') WHEN 1 THEN concat(chr(10), '# TODO one FIXME two', chr(10), '========', chr(10), 'debugger;') ELSE '' END) AS content FROM documents"


@query("conflict_markers", f"WITH m AS ({MARKED}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM m) SELECT path, min(no)::INTEGER AS line_no FROM l WHERE trim(line) = '=======' OR starts_with(trim(line), '<<<<<<< ') OR starts_with(trim(line), '>>>>>>> ') GROUP BY path")
def _(spark, sf):
    return S.conflicts(S.lines(role(spark, sf, MARKED)))


@query("debug_statements", f"WITH m AS ({MARKED}) SELECT * FROM (SELECT path, CASE WHEN regexp_matches(content, 'breakpoint\\(\\)') THEN 'breakpoint()' WHEN regexp_matches(content, 'pdb\\.set_trace\\(\\)') THEN 'pdb.set_trace()' WHEN regexp_matches(content, 'debugger;?') THEN 'debugger statement' WHEN contains(content, 'import pdb') THEN 'import pdb' END AS statement FROM m WHERE ext IN ('py', 'ts', 'tsx', 'js', 'jsx')) WHERE statement IS NOT NULL")
def _(spark, sf):
    return S.debug_statements(role(spark, sf, MARKED))


@query("todo_markers", f"WITH m AS ({MARKED}) SELECT path, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '({S.TODO})', 1), lambda x: upper(x)))), ',') AS markers FROM m WHERE regexp_matches(content, '{S.TODO}')")
def _(spark, sf):
    return S.todo_markers(role(spark, sf, MARKED))


@query("large_files", f"WITH f AS ({FILES}) SELECT path, strlen(content)::BIGINT AS size, strlen(content) // 1024 AS kb FROM f WHERE strlen(content) > 10000")
def _(spark, sf):
    return S.large_files(files(spark, sf), 10_000)


REFS = "SELECT conv_id, turn, concat('see `src/a', conv_id % 7, '.py` and lib/b', turn, '.ts or ', text) AS text FROM conversations"


@query("file_refs", f"""WITH m AS ({REFS}), a AS (SELECT conv_id, turn, list_concat(regexp_extract_all(text, '[`"'']([\\w./-]+\\.\\w{{1,5}})[`"'']', 1), regexp_extract_all(text, '(?:^|\\s)([\\w./-]+\\.(?:py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|toml))\\b', 1)) AS r FROM m)
 SELECT conv_id, turn, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i)[1:3], ',') AS refs FROM a""")
def _(spark, sf):
    return S.file_refs(role(spark, sf, REFS)).select("conv_id", "turn", F.array_join("refs", ",").alias("refs"))


@query("path_quarantine", f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('a/../', url) WHEN 2 THEN concat('b%2E%2e/', page_id) WHEN 3 THEN concat('c', chr(7)) ELSE url END AS path FROM pages)
 SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN length(path) > 4096 THEN 'too long' WHEN regexp_matches(path, '[\\x00-\\x1f\\x7f]') THEN 'control characters' WHEN regexp_matches(path, '(?i)(?:^|/|\\\\)\\.{{2,}}(?:/|\\\\)|%2e%2e') THEN 'traversal' END AS reason FROM p""")
def _(spark, sf):
    from ..functions.text import path_reason

    p = role(spark, sf, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('a/../', url) WHEN 2 THEN concat('b%2E%2e/', page_id) WHEN 3 THEN concat('c', chr(7)) ELSE url END AS path FROM pages")
    return p.select("page_id", path_reason(F.col("path")).alias("reason"))


# ---- rules


def rules(spark, sf):
    return role(spark, sf, RULES).withColumn("languages", F.array("scan_language", F.lit("any")))


_ERRORS = "concat_ws('; ', CASE WHEN severity NOT IN ('critical','high','medium','low','info') THEN 'bad severity' END, CASE WHEN confidence NOT IN ('low','medium','high') THEN 'bad confidence' END, CASE WHEN cwe <> '' AND NOT regexp_matches(cwe, '^CWE-\\d+$') THEN 'bad cwe' END)"


@query("rule_validate", f"WITH r AS ({RULES}) SELECT id, {_ERRORS} AS errors FROM r")
def _(spark, sf):
    r = rules(spark, sf)
    return r.select("id", R.library_errors(r).alias("errors"))


_TWICE = f"SELECT concat('R', pos % 97) AS id, pos, name, scan_query, severity, confidence, cwe FROM ({RULES}) t"


@query("rule_load", f"WITH r AS ({_TWICE}) SELECT id, name, severity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS n FROM r WHERE {_ERRORS} = '') WHERE n = 1")
def _(spark, sf):
    return R.load(role(spark, sf, _TWICE)).select("id", "name", "severity")


ENTRIES = 10_000  # a file is parsed as a whole


def written(rows, spark, name):
    """Rows as entries of YAML lists, in files of at most `ENTRIES` whose names sort as `pos` does."""
    path = folder(spark, name)
    entry = F.concat(F.lit("- "), F.to_json(F.struct(*[c for c in rows.columns if c != "pos"])))
    rows.repartitionByRange(4, "pos").sortWithinPartitions("pos").select(entry.alias("value")).write.option("maxRecordsPerFile", ENTRIES).text(path)
    return path


@query("rule_files", f"WITH r AS ({_TWICE}) SELECT id, name AS title, severity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS n FROM r WHERE {_ERRORS} = '') WHERE n = 1")
def _(spark, sf):
    path = written(role(spark, sf, _TWICE).withColumnRenamed("name", "title"), spark, "rules")
    return files_of.rules(spark, path, ("txt",)).select("id", "title", "severity")


@query("corpus_walk", f"WITH f AS ({FILES}) SELECT project, sum(strlen(content) + 1)::BIGINT AS size, sum(len(string_split(content, chr(10))))::BIGINT AS lines FROM f WHERE project <> 'src3' GROUP BY project")
def _(spark, sf):
    path = folder(spark, "tree")
    files(spark, sf).select("project", F.col("content").alias("value")).write.partitionBy("project").text(path)
    tree = files_of.walk(spark, path, ignored=("project=src3",), globs=("*.txt",))
    by = F.regexp_extract("path", "project=([^/]+)", 1)
    ends = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return tree.groupBy(by.alias("project")).agg(F.sum("size").alias("size"), F.sum(ends).cast("long").alias("lines"))


@query("rule_filter", f"WITH r AS ({RULES}) SELECT id FROM r WHERE category IN ('security', 'testing') AND scan_language IN ('go', 'python') AND severity IN ('high', 'low', 'critical') AND confidence IN ('medium', 'high')")
def _(spark, sf):
    return R.filtered(rules(spark, sf), ("security", "testing"), ("go", "python"), ("high", "low", "critical"), "medium").select("id")


@query("rule_lookup", f"WITH r AS ({RULES}) SELECT 'category' AS how, id FROM r WHERE category = 'performance' UNION ALL SELECT 'language', id FROM r WHERE scan_language = 'go' UNION ALL SELECT 'id', id FROM r WHERE id IN ('R1', 'R7', 'R500')")
def _(spark, sf):
    r = rules(spark, sf)
    pick = lambda how, c: r.where(c).select(F.lit(how).alias("how"), "id")
    return pick("category", F.col("category") == "performance").union(pick("language", F.array_contains("languages", "go"))).union(pick("id", F.col("id").isin("R1", "R7", "R500")))


@query("rule_by_language", f"WITH r AS ({RULES}) SELECT id FROM r WHERE scan_language = 'typescript' OR scan_file_glob = '**/*.{{ts,tsx}}'")
def _(spark, sf):
    return R.for_language(rules(spark, sf), "typescript").select("id")


@query("rule_by_stack", f"WITH r AS ({RULES}) SELECT id FROM r WHERE pos % 4 = 0 OR pos % 4 = 1 OR concat('fw', pos % 9) IN (SELECT concat('fw', n_nationkey % 3) FROM nation)")
def _(spark, sf):
    each = rules(spark, sf).withColumn("frameworks", F.expr("CASE pos % 4 WHEN 0 THEN array('*', 'x') WHEN 1 THEN NULL ELSE array(concat('fw', pos % 9), 'y') END"))
    return R.for_stack(each, role(spark, sf, "SELECT concat('fw', n_nationkey % 3) AS name FROM nation")).select("id")


@query("rule_by_kind", f"WITH r AS ({RULES}) SELECT id, category AS kind FROM r WHERE category IN ('security', 'testing')")
def _(spark, sf):
    r = rules(spark, sf).withColumn("kinds", F.array("category"))
    return r.where(F.arrays_overlap("kinds", F.array(F.lit("security"), F.lit("testing")))).select("id", F.get("kinds", F.lit(0)).alias("kind"))


@query("rule_categories", f"WITH r AS ({RULES}) SELECT category, count(*)::BIGINT AS n FROM r GROUP BY category")
def _(spark, sf):
    return rules(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


PRESETS = [("quick", ["security", "testing"]), ("speed", ["performance"]), ("all", ["testing", "performance", "security", "testing"])]


@query("preset_resolve", f"WITH r AS ({RULES}), p AS {values(PRESETS, 'preset, categories')}, e AS (SELECT preset, unnest(categories) AS category, unnest(range(0, len(categories))) AS pos FROM p) SELECT preset, id, min(e.pos)::INTEGER AS pos FROM e JOIN r USING (category) GROUP BY ALL")
def _(spark, sf):
    return R.resolve_presets(spark.createDataFrame(PRESETS, "preset string, categories array<string>"), rules(spark, sf))


@query("scan_targets", f"WITH r AS ({RULES}), t AS {values([('R3',), ('security',), ('nope',)], 'target')} SELECT target, id FROM t JOIN r ON target = id UNION ALL SELECT target, id FROM t JOIN r ON target = category WHERE target NOT IN (SELECT id FROM r)")
def _(spark, sf):
    return R.scan_targets(spark.createDataFrame([("R3",), ("security",), ("nope",)], "target string"), rules(spark, sf))


_CUSTOM = "SELECT concat('CUSTOM_', lpad(cast(c_custkey AS string), 3, '0')) AS id, concat('rule ', c_custkey) AS name, concat('q', c_custkey) AS scan_query, 'P2' AS severity, c_custkey AS created_at FROM customer"
_CUSTOM_DUCK = _CUSTOM.replace("lpad(cast(c_custkey AS string), 3, '0')", "CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE substr(c_custkey::VARCHAR, 1, 3) END")
_PATCH = "SELECT concat('rule ', s_suppkey * 3) AS name, concat('q', s_suppkey * 3 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS scan_query, 'P0' AS severity, 1000000 + s_suppkey AS ts FROM supplier"


@query(
    "rule_upsert",
    f"""WITH e AS ({_CUSTOM_DUCK}), p AS ({_PATCH}), n AS (SELECT count(*) AS have FROM e),
 a AS (SELECT p.*, row_number() OVER (ORDER BY ts) AS place FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = p.name AND e.scan_query = p.scan_query))
 SELECT md5(concat(e.name, '::', e.scan_query)) AS key, id, e.name, e.scan_query, coalesce(p.severity, e.severity) AS severity, created_at, CASE WHEN p.name IS NULL THEN 'kept' ELSE 'updated' END AS status FROM e LEFT JOIN p ON e.name = p.name AND e.scan_query = p.scan_query
 UNION ALL SELECT md5(concat(name, '::', scan_query)), NULL, name, scan_query, severity, ts, CASE WHEN have + place <= (SELECT have + 20 FROM n) THEN 'added' ELSE 'rejected' END FROM a, n""",
)
def _(spark, sf):
    existing = role(spark, sf, _CUSTOM)
    have = existing.count()
    return R.upserted(existing, role(spark, sf, _PATCH), limit=have + 20)


@query("repo_upsert", f"WITH e AS ({RULES}), c AS (SELECT concat('R', s_suppkey * 5) AS id, 'new' AS name FROM supplier) SELECT id, name FROM c UNION ALL SELECT id, name FROM e WHERE id NOT IN (SELECT id FROM c)")
def _(spark, sf):
    return R.repo_upserted(rules(spark, sf).select("id", "name"), role(spark, sf, "SELECT concat('R', s_suppkey * 5) AS id, 'new' AS name FROM supplier"))


_MIXED = "SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'CUSTOM_' ELSE 'R' END, p_partkey) AS id, p_name AS name FROM part"


@query("rule_delete", f"WITH e AS ({_MIXED}) SELECT id, name FROM e WHERE NOT (starts_with(id, 'CUSTOM_') AND id IN (SELECT concat('CUSTOM_', s_suppkey) FROM supplier))")
def _(spark, sf):
    return R.deleted(role(spark, sf, _MIXED), role(spark, sf, "SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'CUSTOM_' ELSE 'R' END, s_suppkey) AS id FROM supplier"))


@query("repo_migrate", f"WITH e AS ({_MIXED}), c AS (SELECT concat('CUSTOM_', o_orderkey) AS id, 'old' AS name FROM orders) SELECT id, name FROM e UNION ALL SELECT id, name FROM c WHERE id NOT IN (SELECT id FROM e)")
def _(spark, sf):
    return R.migrated(role(spark, sf, _MIXED), role(spark, sf, "SELECT concat('CUSTOM_', o_orderkey) AS id, 'old' AS name FROM orders"))


@query("rule_id_assign", f"WITH e AS ({_MIXED}), m AS (SELECT max(TRY_CAST(substr(id, 8) AS BIGINT)) AS largest FROM e WHERE starts_with(id, 'CUSTOM_')), s AS (SELECT s_suppkey, largest + row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier, m) SELECT s_suppkey, concat('CUSTOM_', CASE WHEN k < 100000000 THEN lpad(k::VARCHAR, 8, '0') END) AS assigned FROM s")
def _(spark, sf):
    return R.next_ids(role(spark, sf, "SELECT s_suppkey FROM supplier"), role(spark, sf, _MIXED), "s_suppkey", width=8)


# ---- findings


def findings(spark, sf):
    return role(spark, sf, FINDINGS)


_RANK = "CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"


@query("finding_filter", f"WITH f AS ({FINDINGS}) SELECT id, {_RANK} AS rank FROM f WHERE severity = 'P1' AND status = 'open' AND category = 'security' AND contains(lower(file), 'm4')")
def _(spark, sf):
    return O.filtered(findings(spark, sf), "p1", "open", "security", "M4").select("id", "rank")


@query("finding_dedupe", f"WITH f AS ({FINDINGS}), x AS (SELECT id, max(CASE WHEN status NOT IN ('fixed', 'verified', 'false_positive') THEN 1 ELSE 0 END) OVER (PARTITION BY file, pattern_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT * REPLACE (1 AS line) FROM f)) SELECT id FROM x WHERE coalesce(b, 0) = 0")
def _(spark, sf):
    return O.deduped(findings(spark, sf).withColumn("line", F.lit(1)), ["id"], by=()).select("id")


@query("finding_add", f"WITH f AS ({FINDINGS}), n AS (SELECT l_orderkey AS session_id, concat('n', l_orderkey, '-', l_linenumber) AS id, concat('src/m', l_partkey % 50, '.ts') AS file, CAST(l_linenumber AS INT) AS line, concat('S', l_suppkey % 40) AS pattern_id, CASE l_partkey % 9 WHEN 0 THEN ' ' ELSE 't' END AS title, CASE l_partkey % 7 WHEN 0 THEN 'P9' ELSE 'p1' END AS severity, CASE l_partkey % 5 WHEN 0 THEN 'zz' ELSE 'testing' END AS category FROM lineitem), h AS (SELECT DISTINCT session_id, file, line, pattern_id, TRUE AS held FROM f WHERE status NOT IN ('fixed', 'verified', 'false_positive')) SELECT id, CASE WHEN trim(title) = '' THEN 'title' WHEN severity = 'P9' THEN 'severity' WHEN category = 'zz' THEN 'category' WHEN held THEN 'duplicate' ELSE 'added' END AS status_of_add FROM n LEFT JOIN h USING (session_id, file, line, pattern_id)")
def _(spark, sf):
    new = role(spark, sf, "SELECT l_orderkey AS session_id, concat('n', l_orderkey, '-', l_linenumber) AS id, concat('src/m', l_partkey % 50, '.ts') AS file, CAST(l_linenumber AS INT) AS line, concat('S', l_suppkey % 40) AS pattern_id, CASE l_partkey % 9 WHEN 0 THEN ' ' ELSE 't' END AS title, CASE l_partkey % 7 WHEN 0 THEN 'P9' ELSE 'p1' END AS severity, CASE l_partkey % 5 WHEN 0 THEN 'zz' ELSE 'testing' END AS category FROM lineitem")
    return O.added(findings(spark, sf), new).select("id", "status_of_add")


_UPDATES = "SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, CASE l_partkey % 3 WHEN 0 THEN 'p0' WHEN 1 THEN 'bad' END AS severity, CASE l_partkey % 2 WHEN 0 THEN 'triaged' ELSE 'nope' END AS status, concat('n', l_partkey) AS notes FROM lineitem WHERE l_linenumber = 1"


@query("triage_apply", f"WITH f AS ({FINDINGS}), u AS ({_UPDATES}) SELECT f.id, CASE WHEN u.severity = 'p0' THEN 'P0' ELSE f.severity END AS severity, CASE WHEN u.status = 'triaged' THEN 'triaged' ELSE f.status END AS status, coalesce(u.notes, '') AS notes, u.id IS NOT NULL AS updated FROM f LEFT JOIN u USING (id)")
def _(spark, sf):
    return O.triaged(findings(spark, sf), role(spark, sf, _UPDATES)).select("id", "severity", "status", "notes", "updated")


@query("severity_counts", f"WITH f AS ({FINDINGS}), d AS {DIM}, s AS (SELECT DISTINCT category FROM f) SELECT category, severity, rank, count(id)::BIGINT AS n FROM s CROSS JOIN d LEFT JOIN f USING (category, severity) GROUP BY ALL")
def _(spark, sf):
    return S.severity_counts(findings(spark, sf), ["category"])


@query("session_stats", f"WITH f AS ({FINDINGS}) SELECT 'severity' AS kind, severity AS value, count(*)::BIGINT AS n FROM f GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY ALL")
def _(spark, sf):
    return O.stats(findings(spark, sf))


@query("top_files", f"WITH f AS ({FINDINGS}) SELECT file, count(*)::BIGINT AS n FROM f GROUP BY file ORDER BY n DESC, file LIMIT 10")
def _(spark, sf):
    return O.top_files(findings(spark, sf))


@query("report_groups", f"WITH f AS ({FINDINGS}) SELECT id, file AS section, (dense_rank() OVER (PARTITION BY session_id ORDER BY file) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY session_id, file)::BIGINT AS section_n FROM f")
def _(spark, sf):
    return O.grouped(findings(spark, sf), "file").select("id", "section", "place", "section_n")


@query("report_markdown", f"""WITH f AS ({FINDINGS}), m AS (SELECT session_id, {_RANK} AS r, id, concat('### `[', severity, ']` ', title, chr(10), '- **Pattern:** `', pattern_id, '`', chr(10), '- **Location:** `', file, ':', line, '`', chr(10), '- **Evidence:** `', evidence, '`') AS md FROM f)
 SELECT session_id, count(*)::BIGINT AS n, concat('# Report ', session_id, chr(10), string_agg(md, chr(10) ORDER BY r, id)) AS report FROM m GROUP BY session_id""")
def _(spark, sf):
    return O.report(findings(spark, sf))


@query("export_findings_json", f"""WITH f AS ({FINDINGS}) SELECT id, concat('{{"id":"', id, '","severity":"', severity, '","file":"', file, '","line":', line, '}}') AS json FROM f""")
def _(spark, sf):
    return findings(spark, sf).select("id", F.to_json(F.struct("id", "severity", "file", "line")).alias("json"))


@query("session_list", f"WITH s AS ({SESSIONS}), c AS (SELECT l_orderkey AS session_id, count(*) AS findings FROM lineitem GROUP BY 1) SELECT session_id, project, coalesce(findings, 0)::INTEGER AS findings FROM s LEFT JOIN c USING (session_id) ORDER BY started_at DESC, session_id LIMIT 50")
def _(spark, sf):
    nested = findings(spark, sf).groupBy("session_id").agg(F.collect_list(F.struct("id", "severity")).alias("findings"))
    listed = role(spark, sf, SESSIONS).join(nested, "session_id", "left")
    return listed.orderBy(F.desc("started_at"), "session_id").limit(50).select("session_id", "project", F.coalesce(F.size("findings"), F.lit(0)).alias("findings"))


@query("history_filter", f"WITH s AS ({SESSIONS}) SELECT session_id, project FROM s WHERE contains(lower(project), 'project-1') ORDER BY started_at DESC, session_id LIMIT 50")
def _(spark, sf):
    return O.history(role(spark, sf, SESSIONS), "PROJECT-1", 500).select("session_id", "project")


@query("session_close", f"WITH s AS ({SESSIONS}) SELECT session_id, CASE WHEN session_id % 3 = 0 AND status = 'open' THEN 'closed' ELSE status END AS status, CASE WHEN session_id % 3 = 0 AND status = 'open' THEN 'done' END AS summary FROM s")
def _(spark, sf):
    asked = role(spark, sf, "SELECT o_orderkey AS session_id, o_orderdate AS at, 'done' AS summary FROM orders WHERE o_orderkey % 3 = 0")
    return O.closed(role(spark, sf, SESSIONS), asked).select("session_id", "status", "summary")


@query("retain_sessions", f"WITH s AS ({SESSIONS}) SELECT session_id FROM s WHERE started_at >= (SELECT max(started_at) FROM s) - INTERVAL 300 DAY ORDER BY started_at DESC, session_id LIMIT 100")
def _(spark, sf):
    s = role(spark, sf, SESSIONS)
    last = F.lit(s.agg(F.max("started_at")).first()[0])
    return O.retained(s, last, 300).select("session_id")


@query("finding_enrich", f"WITH f AS ({FINDINGS}) SELECT id, p_name AS rule_name FROM f LEFT JOIN part ON concat('S', p_partkey * 2) = pattern_id")
def _(spark, sf):
    known = role(spark, sf, "SELECT concat('S', p_partkey * 2) AS id, p_name AS name, p_brand AS scan_query FROM part")
    return O.enriched(findings(spark, sf), known).select("id", "rule_name")


@query("finding_verify", f"WITH {HITS}, l AS (SELECT path, line_no, line FROM lines) SELECT file, h.line, pattern_id, regexp_matches(l.line, '(?i)licen[sc]e') AS still FROM hits h JOIN l ON l.path = h.file AND l.line_no = h.line")
def _(spark, sf):
    source = S.lines(files(spark, sf)).select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("line").alias("now"))
    return hits(spark, sf).join(source, ["file", "line"]).select("file", "line", "pattern_id", F.col("now").rlike("(?i)licen[sc]e").alias("still"))


@query("auto_findings", f"WITH f AS ({FINDINGS}), c AS (SELECT l_orderkey AS session_id, concat('finding ', l_partkey % 9) AS title FROM lineitem), n AS (SELECT DISTINCT session_id, title FROM c WHERE (session_id, title) NOT IN (SELECT session_id, title FROM f)) SELECT session_id, title FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY title) AS n FROM n) WHERE n <= 2")
def _(spark, sf):
    c = role(spark, sf, "SELECT l_orderkey AS session_id, concat('finding ', l_partkey % 9) AS title FROM lineitem")
    return O.new_titles(c, findings(spark, sf), limit=2)

"""Queries of manifests, stacks, routes and deduced rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deduce as U, deps as V, routes as R, stack as S
from ..operators.scan import lines
from ..sources import files as files_of
from .base import FILES, FINDINGS, query, role
from .scans import LINES, written

_V = "concat(p_size, '.', p_partkey % 10, '.0')"
_P = "concat('p', p_partkey) AS project"
NPM = f"""SELECT {_P}, 'package.json' AS path, concat('{{"dependencies":{{"', p_brand, '":"^', {_V}, '","left":">= 1.', p_size, '.0 || 2"}},"devDependencies":{{"dev":"', p_size, '.*"}},"name":"x"}}') AS content FROM part"""
PYPI = f"SELECT {_P}, 'requirements.txt' AS path, concat('# c', chr(10), 'Django==', p_size, '.', p_partkey % 10, chr(10), 'Flask >= 1.*  # x', chr(10), '-r x', chr(10), 'bare') AS content FROM part"
GO = f"SELECT {_P}, 'go.mod' AS path, concat('module m', chr(10), 'require golang.org/x/net v0.', p_size, '.0', chr(10), 'require (', chr(10), '  a.b/c v1.', p_partkey % 7, '.0 // indirect', chr(10), ' d/e v0.0.0-2023-abc', chr(10), ' f/g v2.1.0+incompatible', chr(10), ')', chr(10), 'exclude x v1') AS content FROM part"
CARGO = f"""SELECT {_P}, 'Cargo.toml' AS path, concat('[package]', chr(10), 'version = "9"', chr(10), '[dependencies]', chr(10), 'serde = "', p_size, '.0"', chr(10), 'tokio = {{ version = "~1.', p_partkey % 9, '", features = ["full"] }}', chr(10), '# no', chr(10), '[features]', chr(10), 'a = "1"', chr(10), '[dev-dependencies]', chr(10), 'rand = "0.*"') AS content FROM part"""


@query("manifest_npm", f"SELECT {_P}, p_brand AS package, {_V} AS version FROM part UNION ALL SELECT {_P}, 'left', concat('1.', p_size, '.0') FROM part UNION ALL SELECT {_P}, 'dev', concat(p_size, '.0') FROM part")
def _(spark, sf):
    return V.npm(role(spark, sf, NPM))


@query("manifest_pypi", f"SELECT {_P}, 'django' AS package, concat(p_size, '.', p_partkey % 10) AS version FROM part UNION ALL SELECT {_P}, 'flask', '1.0' FROM part")
def _(spark, sf):
    return V.pypi(role(spark, sf, PYPI))


@query("manifest_go", f"SELECT {_P}, 'golang.org/x/net' AS package, concat('0.', p_size, '.0') AS version FROM part UNION ALL SELECT {_P}, 'a.b/c', concat('1.', p_partkey % 7, '.0') FROM part UNION ALL SELECT {_P}, 'd/e', '0.0.0' FROM part UNION ALL SELECT {_P}, 'f/g', '2.1.0' FROM part")
def _(spark, sf):
    return V.go(role(spark, sf, GO))


@query("manifest_cargo", f"SELECT {_P}, 'serde' AS package, concat(p_size, '.0') AS version FROM part UNION ALL SELECT {_P}, 'tokio', concat('1.', p_partkey % 9) FROM part UNION ALL SELECT {_P}, 'rand', '0.0' FROM part")
def _(spark, sf):
    return V.cargo(role(spark, sf, CARGO))


_RAW = "SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN '^' WHEN 1 THEN '~ ' WHEN 2 THEN '>=' WHEN 3 THEN 'v' WHEN 4 THEN ' <= ' ELSE '' END, p_size, '.', p_partkey % 10, CASE p_partkey % 4 WHEN 0 THEN '.*' WHEN 1 THEN ' || 3' WHEN 2 THEN '-1-2' ELSE '+incompatible' END) AS raw FROM part"


@query(
    "version_clean",
    f"WITH r AS ({_RAW}), b AS (SELECT p_partkey, raw, trim(regexp_replace(trim(raw), '^[\\^~<>=! ]+', '')) AS bare, regexp_replace(raw, '^v+', '') AS g FROM r) SELECT p_partkey, replace(string_split(trim(string_split(bare, '||')[1]), ' ')[1], '*', '0') AS semver, string_split(CASE WHEN len(string_split(g, '-')) > 2 THEN string_split(g, '-')[1] ELSE g END, '+')[1] AS go, regexp_extract(raw, '(\\d+(?:\\.\\d+)*)', 1) AS digits FROM b",
)
def _(spark, sf):
    return role(spark, sf, _RAW).select("p_partkey", V.clean_semver(F.col("raw")).alias("semver"), V.clean_go(F.col("raw")).alias("go"), V.digits(F.col("raw")).alias("digits"))


DEPS = f"SELECT {_P}, p_brand AS package, 'npm' AS ecosystem, CASE WHEN p_partkey % 11 = 0 THEN concat({_V}, '-beta') ELSE {_V} END AS version FROM part"
_ADV = "SELECT DISTINCT p_brand AS package, 'npm' AS ecosystem, '>=10.2, <20' AS r1, '==5.1.0' AS r2, CASE WHEN length(p_brand) % 2 = 0 THEN 'critical' ELSE 'low' END AS severity, concat('adv ', p_brand) AS title FROM part"
_OWN = "SELECT DISTINCT p_brand AS package, 'npm' AS ecosystem, '>45,!=47.3' AS r1, '' AS r2, 'high' AS severity, 'own' AS title FROM part"


def vulns(spark, sf):
    read = lambda sql: role(spark, sf, sql).withColumn("ranges", F.array("r1", "r2")).drop("r1", "r2")
    return V.vulnerable(role(spark, sf, DEPS), read(_ADV), read(_OWN))


_K = "p_size * 100 + p_partkey % 10"
_VULNS = f"d AS (SELECT *, {_K} AS k, p_partkey % 11 = 0 AS pre FROM part), v AS (SELECT {_P}, p_brand AS package, {_V} AS version, CASE WHEN length(p_brand) % 2 = 0 THEN 'critical' ELSE 'low' END AS severity, concat('adv ', p_brand) AS title FROM d WHERE NOT pre AND ((k >= 1002 AND k < 2000) OR k = 501) UNION ALL SELECT {_P}, p_brand, {_V}, 'high', 'own' FROM d WHERE NOT pre AND k > 4500 AND k <> 4703)"


@query("dep_vulns", f"WITH {_VULNS} SELECT project, package, version, severity, title FROM v")
def _(spark, sf):
    return vulns(spark, sf).select("project", "package", "version", "severity", "title")


@query("dep_vulns_profile", f"WITH {_VULNS} SELECT project, 'vulnerability' AS category, concat(package, '@', version) AS name, CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS confidence FROM v")
def _(spark, sf):
    return V.as_profile(vulns(spark, sf))


# ---- stacks

_RULES = "SELECT concat('t', s_suppkey % 60) AS tech, CASE s_suppkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'infra' WHEN 2 THEN 'nope' ELSE 'frontend' END AS category, concat('*.', s_suppkey % 5) AS glob, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE 'x' END AS search FROM supplier"


def marker_rules(spark, sf):
    item = F.struct("glob", "search", F.lit(None).cast("string").alias("confidence"))
    return role(spark, sf, _RULES).select("tech", "category", F.array(item, F.struct(F.lit("").alias("glob"), F.lit("y").alias("search"), F.lit("low").alias("confidence"))).alias("markers"))


@query("marker_load", f"SELECT tech, category, r.\"glob\", coalesce(search, '') AS search, 'medium' AS confidence FROM ({_RULES}) r WHERE category <> 'nope'")
def _(spark, sf):
    return S.load_markers(marker_rules(spark, sf))


@query("marker_files", f"SELECT tech, category, r.\"glob\", coalesce(search, '') AS search, 'medium' AS confidence FROM ({_RULES}) r WHERE category <> 'nope'")
def _(spark, sf):
    path = written(marker_rules(spark, sf).withColumn("pos", F.col("tech")), spark, "markers")
    return S.load_markers(files_of.marker_files(spark, path, ("txt",)))


_ADVISORIES = "SELECT p_partkey AS pos, concat('pkg', p_partkey) AS package, 'npm' AS ecosystem, concat('<', p_size, '.0') AS r1, concat('>=', p_size + 1, '.0,<', p_size + 2) AS r2, 'high' AS severity FROM part"


@query("advisory_files", f"WITH a AS ({_ADVISORIES}) SELECT package, ecosystem, r1 AS range, severity FROM a UNION ALL SELECT package, ecosystem, r2, severity FROM a")
def _(spark, sf):
    rows = role(spark, sf, _ADVISORIES).select("pos", "package", "ecosystem", F.array("r1", "r2").alias("vulnerable_versions"), "severity")
    return files_of.advisory_files(spark, written(rows, spark, "advisories"), ("txt",)).select("package", "ecosystem", "range", "severity")


@query("marker_override", f"WITH r AS (SELECT tech, category, \"glob\", coalesce(search, '') AS search, 'medium' AS confidence FROM ({_RULES}) r WHERE category <> 'nope'), b AS (SELECT concat('t', n_nationkey) AS tech, 'build' AS category, 'x' AS glob, '' AS search, 'high' AS confidence FROM nation) SELECT * FROM r UNION ALL SELECT * FROM b WHERE tech NOT IN (SELECT tech FROM r)")
def _(spark, sf):
    built_in = role(spark, sf, "SELECT concat('t', n_nationkey) AS tech, 'build' AS category, 'x' AS glob, '' AS search, 'high' AS confidence FROM nation")
    return S.overridden(built_in, S.load_markers(marker_rules(spark, sf)))


MARKERS = (("english", "language", "*.en", "", "high"), ("soup", "frontend", "*.{fr,de}", "%%%", "low"), ("soup", "frontend", "*.de", "und", "medium"), ("licence", "infra", "**/*", "License", "medium"), ("ghost", "other", "*.zz", "", "high"))


def _detect_sql(markers):
    from ..operators.scan import glob_regex

    parts = [f"SELECT project, path, '{m[0]}' AS name, '{m[1]}' AS category, {list(S.CONFIDENCE).index(m[4])} AS c FROM files WHERE regexp_matches(path, '{glob_regex(m[2])}')" + (f" AND contains(content, '{m[3]}')" if m[3] else "") for m in markers]
    return f"WITH files AS ({FILES}), e AS ({' UNION ALL '.join(parts)}) SELECT project, category, name, CASE min(c) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, count(*)::BIGINT AS n_evidence, min(path) AS first_evidence FROM e GROUP BY project, category, name"


def stack(spark, sf):
    return S.detected(role(spark, sf, FILES), MARKERS)


query("stack_detect", _detect_sql(MARKERS))(stack)


@query("stack_detect_fast", _detect_sql([m for m in MARKERS if m[0] in ("english", "ghost")]))
def _(spark, sf):
    return S.detected(role(spark, sf, FILES), S.fast(MARKERS))


_ENV = "SELECT concat('c', c_custkey) AS project, CASE c_custkey % 2 WHEN 0 THEN '.env' ELSE '.env.example' END AS path, concat('# x=1', chr(10), 'DATABASE_URL=a=b', chr(10), CASE c_custkey % 3 WHEN 0 THEN 'AWS_KEY=1' WHEN 1 THEN ' SLACK_HOOK = x' ELSE 'DATABASE_HOST=h' END, chr(10), 'noise', chr(10), 'ZZ', c_custkey, '=', chr(10), '=x') AS content FROM customer"
_ENV_KEYS = "k AS (SELECT concat('c', c_custkey) AS project, 1 AS no, 'DATABASE_URL' AS key, c_custkey FROM customer UNION ALL SELECT concat('c', c_custkey), 2, CASE c_custkey % 3 WHEN 0 THEN 'AWS_KEY' WHEN 1 THEN 'SLACK_HOOK' ELSE 'DATABASE_HOST' END, c_custkey FROM customer UNION ALL SELECT concat('c', c_custkey), 4, concat('ZZ', c_custkey), c_custkey FROM customer)"


@query("dotenv_keys", f"WITH {_ENV_KEYS} SELECT project, CASE c_custkey % 2 WHEN 0 THEN '.env' ELSE '.env.example' END AS path, no, key FROM k")
def _(spark, sf):
    return S.dotenv_keys(role(spark, sf, _ENV))


@query("dotenv_services", f"WITH {_ENV_KEYS} SELECT project, 'database' AS category, 'postgresql' AS name, 'DATABASE_URL' AS evidence FROM k WHERE no = 1 UNION ALL SELECT project, CASE key WHEN 'AWS_KEY' THEN 'infra' ELSE 'saas' END, CASE key WHEN 'AWS_KEY' THEN 'aws' ELSE 'slack' END, key FROM k WHERE no = 2 AND key <> 'DATABASE_HOST'")
def _(spark, sf):
    return S.dotenv_services(S.dotenv_keys(role(spark, sf, _ENV)))


_DOCKER = """SELECT concat('c', c_custkey) AS project, 'compose.yaml' AS path, concat('services:', chr(10), ' db:', chr(10), '  image: "reg.io/x/Postgres:', c_custkey % 17, '"', chr(10), 'FROM node:20 AS build', chr(10), 'from unknown', c_custkey) AS content FROM customer"""


@query("docker_images", "SELECT concat('c', c_custkey) AS project, concat('reg.io/x/Postgres:', c_custkey % 17) AS image, 'postgres' AS base, (c_custkey % 17)::VARCHAR AS tag FROM customer UNION ALL SELECT concat('c', c_custkey), 'node:20', 'node', '20' FROM customer UNION ALL SELECT concat('c', c_custkey), concat('unknown', c_custkey), concat('unknown', c_custkey), NULL FROM customer")
def _(spark, sf):
    return S.docker_images(role(spark, sf, _DOCKER)).drop("path")


def docker(spark, sf):
    known = spark.createDataFrame(S.IMAGES, "base string, category string, name string")
    return S.docker_services(S.docker_images(role(spark, sf, _DOCKER)), known)


query("docker_services", "SELECT concat('c', c_custkey) AS project, 'database' AS category, 'postgresql' AS name, (c_custkey % 17)::VARCHAR AS version FROM customer UNION ALL SELECT concat('c', c_custkey), 'language', 'node', '20' FROM customer")(docker)


@query("dep_category", f"SELECT {_P}, p_brand AS package, CASE WHEN p_brand IN (SELECT concat('Brand#', n_nationkey) FROM nation) THEN 'backend' WHEN starts_with(p_brand, 'Brand#4') THEN 'infra' WHEN starts_with(p_brand, 'Brand#') AND FALSE THEN 'x' ELSE 'other' END AS category, CASE WHEN p_brand IN (SELECT concat('Brand#', n_nationkey) FROM nation) THEN 'high' WHEN starts_with(p_brand, 'Brand#4') THEN 'medium' ELSE 'low' END AS confidence FROM part")
def _(spark, sf):
    exact = role(spark, sf, "SELECT concat('Brand#', n_nationkey) AS package, 'backend' AS category FROM nation")
    return S.dependency_category(role(spark, sf, f"SELECT {_P}, p_brand AS package FROM part"), exact, (("Brand#4", "infra"),))


def union(spark, sf):
    env = S.dotenv_services(S.dotenv_keys(role(spark, sf, _ENV))).withColumn("confidence", F.lit("medium"))
    return S.union(docker(spark, sf).withColumn("confidence", F.lit("high")), env)


_UNION = "u AS (SELECT concat('c', c_custkey) AS project, 'database' AS category, 'postgresql' AS name, 'high' AS confidence, 0 AS layer FROM customer UNION ALL SELECT concat('c', c_custkey), 'language', 'node', 'high', 0 FROM customer UNION ALL SELECT concat('c', c_custkey), CASE c_custkey % 3 WHEN 0 THEN 'infra' ELSE 'saas' END, CASE c_custkey % 3 WHEN 0 THEN 'aws' ELSE 'slack' END, 'medium', 1 FROM customer WHERE c_custkey % 3 < 2)"
query("stack_union", f"WITH {_UNION} SELECT * FROM u")(union)


@query("stack_confidence", f"WITH {_UNION} SELECT project, round(avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END), 2) AS overall_confidence FROM u GROUP BY project")
def _(spark, sf):
    return S.confidence(union(spark, sf))


# ---- routes

_GOFILES = """SELECT source AS project, concat('h', doc_id, '.go') AS path, concat('r.GET("/api/v', doc_id % 5, '/{id}/x/{name}", f)', chr(10), 'mux.HandleFunc(`/raw/', doc_id, '`, g)', chr(10), '// Route: /note/', lang, ' ok', chr(10), 'r.Route("/sub", func', chr(10), 'r.GET("/api/v', doc_id % 5, '/{id}/x/{name}", f)') AS content FROM documents"""


@query("routes_go", "SELECT source AS project, concat('h', doc_id, '.go') AS source_file, concat('/api/v', doc_id % 5, '/{id}/x/{name}') AS path, 'id,name' AS params FROM documents UNION ALL SELECT source, concat('h', doc_id, '.go'), concat('/raw/', doc_id), '' FROM documents UNION ALL SELECT source, concat('h', doc_id, '.go'), concat('/note/', lang), '' FROM documents UNION ALL SELECT source, concat('h', doc_id, '.go'), '/sub', '' FROM documents")
def _(spark, sf):
    return R.go_routes(role(spark, sf, _GOFILES)).withColumn("params", F.array_join("params", ","))


_PAGES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('[locale]/(protected)/orders', doc_id, '/page.tsx') WHEN 1 THEN concat('(store)/products/[handle', doc_id, ']/page.tsx') WHEN 2 THEN concat('[locale]/(guest)/(x)/a/', lang, '/page.tsx') ELSE 'page.tsx' END AS source_file FROM documents"


@query("routes_pages", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('[locale]/orders', doc_id) WHEN 1 THEN concat('/products/[handle', doc_id, ']') WHEN 2 THEN concat('[locale]/a/', lang) ELSE '' END AS path, CASE doc_id % 4 WHEN 0 THEN 'locale' WHEN 1 THEN concat('handle', doc_id) WHEN 2 THEN 'locale' ELSE '' END AS params, CASE doc_id % 4 WHEN 0 THEN 'protected' WHEN 1 THEN 'store' WHEN 2 THEN 'guest,x' ELSE '' END AS groups, CASE doc_id % 4 WHEN 0 THEN 'protected' WHEN 2 THEN 'guest' ELSE 'public' END AS auth_status, CASE doc_id % 4 WHEN 1 THEN 'detail' ELSE 'page' END AS route_type FROM documents")
def _(spark, sf):
    p = role(spark, sf, _PAGES)
    c = R.page_route(F.col("source_file"))
    return p.select("doc_id", c["path"].alias("path"), F.array_join(c["params"], ",").alias("params"), F.array_join(c["groups"], ",").alias("groups"), c["auth_status"].alias("auth_status"), c["route_type"].alias("route_type"))


_APIS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('store/p', doc_id, '/route.ts') WHEN 1 THEN concat('admin/[id]/', lang, '/route.js') ELSE concat('routes/seo/[x]/', lang, '/page.tsx') END AS source_file FROM documents"


@query("routes_admin_api", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('/store/p', doc_id) WHEN 1 THEN concat('/admin/[id]/', lang) ELSE concat('/routes/seo/[x]/', lang) END AS path, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'id' ELSE 'x' END AS params, CASE doc_id % 3 WHEN 2 THEN 'detail' ELSE 'api' END AS route_type FROM documents")
def _(spark, sf):
    c = R.api_route(F.col("source_file"))
    return role(spark, sf, _APIS).select("doc_id", c["path"].alias("path"), F.array_join(c["params"], ",").alias("params"), c["route_type"].alias("route_type"))


_TREE = "SELECT concat('c', c_custkey) AS project, CASE c_custkey % 5 WHEN 0 THEN 'apps/shop/src/app/x/page.tsx' WHEN 1 THEN 'src/admin/routes/a/page.tsx' WHEN 2 THEN 'packages/api/src/api/store/route.ts' WHEN 3 THEN 'go.mod' ELSE 'web/src/main.tsx' END AS path FROM customer UNION ALL SELECT concat('c', c_custkey), concat('src/modules/m', c_custkey % 40, '/index.ts') FROM customer UNION ALL SELECT concat('c', c_custkey), concat('svc/internal/core/u', c_custkey % 7, '/a/b.go') FROM customer"


@query("ui_layers", "SELECT concat('c', c_custkey) AS project, CASE c_custkey % 5 WHEN 0 THEN 'apps/shop' WHEN 2 THEN 'packages/api' WHEN 4 THEN 'web' ELSE '' END AS app_dir, CASE c_custkey % 5 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'medusa-admin' WHEN 2 THEN 'medusa-api' WHEN 3 THEN 'go-api' ELSE 'react' END AS ui_type FROM customer")
def _(spark, sf):
    return R.ui_layers(role(spark, sf, _TREE))


@query("modules", "SELECT concat('c', c_custkey) AS project, concat('m', c_custkey % 40) AS module FROM customer UNION SELECT concat('c', c_custkey), concat('u', c_custkey % 7) FROM customer")
def _(spark, sf):
    return R.modules(role(spark, sf, _TREE))


_MODULES = "SELECT DISTINCT concat('p', o_custkey) AS project, CASE o_orderkey % 6 WHEN 0 THEN 'product' WHEN 1 THEN 'box' WHEN 2 THEN 'hero-banner' WHEN 3 THEN 'orders' WHEN 4 THEN concat('mod', o_orderkey % 30) ELSE 'agent' END AS module FROM orders"
_ROUTES = "SELECT DISTINCT concat('p', o_custkey) AS project, CASE o_orderkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'storefront' ELSE 'api' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN '/products' WHEN 1 THEN '/boxes/[id]' WHEN 2 THEN '/hero_banner' WHEN 3 THEN '/order/x' WHEN 4 THEN concat('/mod', o_orderkey % 30, 's') WHEN 5 THEN '/agent-channels' ELSE '/store/auth/me' END AS path, CASE o_orderkey % 7 WHEN 1 THEN 'detail' ELSE 'page' END AS route_type FROM orders"
_MATCH = f"m AS ({_MODULES}), r AS ({_ROUTES}), seg AS (SELECT *, unnest(string_split(trim(path, '/'), '/')) AS s FROM r), b AS (SELECT project, module, unnest(CASE WHEN regexp_matches(module, '(ch|sh|s|x|z)$') THEN [module, replace(module, '-', '_'), module || 's', module || 'es'] ELSE [module, replace(module, '-', '_'), module || 's'] END) AS v FROM m), x AS (SELECT DISTINCT r.project, kind, path, route_type, module FROM seg r JOIN b ON r.project = b.project AND (r.s = b.v OR r.s = b.v || 's' OR b.v = r.s || 's'))"


def matched(spark, sf):
    return R.matches(role(spark, sf, _ROUTES), role(spark, sf, _MODULES))


query("route_module_match", f"WITH {_MATCH} SELECT * FROM x")(matched)


def cover(spark, sf):
    return R.coverage(role(spark, sf, _MODULES), matched(spark, sf))


_COVER = f"{_MATCH}, c AS (SELECT m.project, m.module, coalesce(bool_or(kind = 'admin'), FALSE) AS has_admin, coalesce(bool_or(kind = 'storefront'), FALSE) AS has_storefront, coalesce(bool_or(kind = 'api'), FALSE) AS has_api, coalesce(bool_or(kind = 'admin' AND (route_type = 'detail' OR contains(path, '[id]') OR len(string_split(trim(path, '/'), '/')) >= 2)), FALSE) AS has_detail_admin, coalesce(bool_or(kind = 'storefront' AND (route_type = 'detail' OR contains(path, '[id]'))), FALSE) AS has_detail_storefront, count(path)::BIGINT AS n_routes FROM m LEFT JOIN x ON m.project = x.project AND m.module = x.module GROUP BY m.project, m.module)"
query("coverage_matrix", f"WITH {_COVER} SELECT * FROM c")(cover)
_GAPS = f"{_COVER}, g AS (SELECT project, 'critical' AS type, module FROM c WHERE NOT has_admin UNION ALL SELECT project, 'warning', module FROM c WHERE NOT has_storefront UNION ALL SELECT project, 'missing_detail', module FROM c WHERE has_admin AND NOT has_detail_admin)"


@query("coverage_gaps", f"WITH {_GAPS} SELECT * FROM g")
def _(spark, sf):
    return R.gaps(cover(spark, sf))


@query("route_orphans", f"WITH {_MATCH}, l AS (SELECT * FROM r WHERE (project, kind, path) NOT IN (SELECT project, kind, path FROM x)) SELECT project, 'orphan' AS type, string_split(ltrim(path, '/'), '/')[1] AS module, path FROM l WHERE kind = 'admin' UNION ALL SELECT project, 'info', string_split(path, '/')[-1], path FROM l WHERE kind = 'api' AND NOT regexp_matches(lower(path), '/admin/|/auth/')")
def _(spark, sf):
    return R.orphans(role(spark, sf, _ROUTES), matched(spark, sf))


@query("gap_dedupe", f"WITH {_MATCH}, l AS (SELECT project, kind AS type, string_split(ltrim(path, '/'), '/')[1] AS module, path FROM r) SELECT project, type, module, min(path) AS path FROM l GROUP BY ALL")
def _(spark, sf):
    rows = role(spark, sf, _ROUTES).select("project", F.col("kind").alias("type"), F.get(F.split(F.ltrim("path", F.lit("/")), "/"), F.lit(0)).alias("module"), "path")
    return R.dedupe_gaps(rows, "path")


@query("coverage_summary", f"WITH {_COVER} SELECT project, count(*)::BIGINT AS total_modules, count(*) FILTER (has_admin)::BIGINT AS with_admin, count(*) FILTER (has_storefront)::BIGINT AS with_storefront, count(*) FILTER (has_api)::BIGINT AS with_api, round(count(*) FILTER (has_admin) * 100 / count(*), 1) AS admin_pct, round(count(*) FILTER (has_storefront) * 100 / count(*), 1) AS storefront_pct FROM c GROUP BY project")
def _(spark, sf):
    return R.coverage_summary(cover(spark, sf))


@query("ui_summary", f"WITH r AS ({_ROUTES}) SELECT coalesce(kind, 'total') AS kind, count(*)::BIGINT AS routes, count(DISTINCT project)::BIGINT AS projects FROM r GROUP BY ROLLUP (kind)")
def _(spark, sf):
    return R.ui_summary(role(spark, sf, _ROUTES))


# ---- deduced rules

_EVIDENCE = "CASE l_partkey % 7 WHEN 0 THEN 'try: x except: pass' WHEN 1 THEN ' console.log (1)' WHEN 2 THEN 'y = eval (z)' WHEN 3 THEN concat('foo_', l_partkey, '(1)') WHEN 4 THEN '123 456' WHEN 5 THEN 'setTimeout(f)' ELSE '' END"
_FOUND = f"SELECT * FROM (SELECT id, file, severity, category, title, pattern_id, created_at, {_EVIDENCE.replace('l_partkey', 'part')} AS evidence, part FROM (SELECT f.*, CAST(substr(evidence, 6) AS INT) AS part FROM ({FINDINGS}) f) g) h"
_CASES = "CASE part % 7 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' WHEN 3 THEN {3} WHEN 4 THEN '{4}' WHEN 5 THEN '{5}' ELSE '' END"
_QUERY = _CASES.format(U.CONTEXTS[1][1], U.CONTEXTS[2][1], U.CONTEXTS[7][1], "concat('foo_', part, '\\(')", "123\\ 456", U.CONTEXTS[5][1])
_NAME = _CASES.format("Bare Except", "Console Log", "eval Call", "concat('foo_', part)", "123 456", "setTimeout")


@query("rule_deduce", f"WITH f AS ({_FOUND}) SELECT id, {_QUERY} AS query, {_NAME} AS name FROM f")
def _(spark, sf):
    d = U.deduced(F.col("evidence"))
    return role(spark, sf, _FOUND).select("id", d.alias("d")).select("id", "d.query", "d.name")


_NAMED = "SELECT doc_id, concat('a/b.', CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'tsx' WHEN 2 THEN 'js' WHEN 3 THEN 'go' WHEN 4 THEN 'zz' ELSE 'php' END) AS file FROM documents"


@query("language_deduce", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'go' WHEN 4 THEN '' ELSE 'php' END AS language, CASE doc_id % 6 WHEN 0 THEN '**/*.py' WHEN 1 THEN '**/*.{ts,tsx}' WHEN 2 THEN '**/*.{js,jsx}' WHEN 3 THEN '**/*.go' WHEN 4 THEN '' ELSE '**/*.php' END AS glob FROM documents")
def _(spark, sf):
    return role(spark, sf, _NAMED).select("doc_id", U.language(F.col("file")).alias("l")).select("doc_id", "l.language", "l.glob")


@query("rule_deduce_bulk", f"WITH f AS ({_FOUND}) SELECT id, title AS name, CASE severity WHEN 'P0' THEN 'P1' ELSE severity END AS severity, category, {_QUERY} AS scan_query, 'typescript' AS scan_language, '**/*.{{ts,tsx}}' AS scan_file_glob FROM f WHERE part % 7 < 6")
def _(spark, sf):
    return U.bulk(role(spark, sf, _FOUND))


@query("rule_from_finding", f"WITH f AS ({_FOUND}) SELECT id, title AS name, severity, CASE part % 7 WHEN 0 THEN 'try:' WHEN 1 THEN 'console.log (' WHEN 2 THEN 'eval (' WHEN 3 THEN concat('foo_', part, '(') WHEN 4 THEN '123' WHEN 5 THEN 'setTimeout(' END AS scan_query, CASE WHEN part % 7 < 6 THEN '**/*.ts' END AS scan_file_glob FROM f")
def _(spark, sf):
    return U.from_finding(role(spark, sf, _FOUND))


@query("rule_import", f"WITH f AS ({FINDINGS}) SELECT title AS name, pattern_id AS scan_query, arg_max(severity, (created_at, id)) AS severity, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def _(spark, sf):
    return U.imported(role(spark, sf, FINDINGS))


CANDIDATES = (("licence", "(?i)licen[sc]e", "names a licence", ""), ("known", "the ", "", ""), ("soup", "%%%", "", "clean"), ("never", "zzzzqq", "x", "y"), ("pour", " pour ", "", ""))


@query("rule_discovery", f"WITH {LINES}, h AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS name, '{c[1]}' AS query, {0.1 * (c[2] != '') + 0.1 * (c[3] != '')} AS bonus FROM lines WHERE regexp_matches(line, '{c[1]}')" for c in CANDIDATES if c[0] != "known") + "), g AS (SELECT name, query, bonus, count(*)::BIGINT AS frequency FROM h GROUP BY ALL) SELECT name, query, frequency, round(least(1.0, 0.5 + CASE WHEN frequency > 10 THEN 0.3 WHEN frequency > 5 THEN 0.15 ELSE 0 END + bonus), 2)::DOUBLE AS confidence FROM g WHERE frequency >= 2")
def _(spark, sf):
    return U.discovered(lines(role(spark, sf, FILES)), CANDIDATES, ["the "])

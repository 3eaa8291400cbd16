"""Routes and modules: extraction, matching, coverage and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How handlers are registered in Go.
GO_ROUTES = (
    r'(?:router|mux|r)\.(?:HandleFunc|Handle)\s*\(\s*"([^"]+)"',
    r"(?:router|mux|r)\.(?:HandleFunc|Handle)\s*\(\s*`([^`]+)`",
    r'(?:router|mux|r)\.(?:GET|POST|PUT|DELETE|PATCH|HEAD)\s*\(\s*"([^"]+)"',
    r"(?:router|mux|r)\.(?:GET|POST|PUT|DELETE|PATCH|HEAD)\s*\(\s*`([^`]+)`",
    r"//\s*Route:\s*(/\S+)",
    r'r\.Route\s*\(\s*"([^"]+)"',
    r"r\.Route\s*\(\s*`([^`]+)`",
)


def go_routes(files: DataFrame) -> DataFrame:
    """(project, source_file, path, params) of handlers in Go texts, each path once a file."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in GO_ROUTES]))
    each = files.select("project", F.col("path").alias("source_file"), F.explode(found).alias("path"))
    return each.withColumn("params", F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), 1))


def page_route(source: Column) -> dict[str, Column]:
    """Route columns of a page's file path: groups in parentheses don't count, parameters are in brackets."""
    route = F.regexp_replace(F.regexp_replace(source, r"page\.tsx$", ""), "/+$", "")
    clean = F.regexp_replace(route, r"(^|/)\([^)]+\)", "")
    params = F.regexp_extract_all(clean, F.lit(r"\[([^\]]+)\]"), 1)
    detail = F.size(F.filter(params, lambda p: p != "locale")) > 0
    return {
        "path": clean,
        "params": params,
        "groups": F.regexp_extract_all(route, F.lit(r"\(([^)]+)\)"), 1),
        "auth_status": F.when(F.contains(route, F.lit("(protected)")), "protected").when(F.contains(route, F.lit("(guest)")), "guest").otherwise("public"),
        "route_type": F.when(detail, "detail").otherwise("page"),
    }


def api_route(source: Column) -> dict[str, Column]:
    """Route columns of an API or admin file path."""
    route = F.concat(F.lit("/"), F.regexp_replace(source, r"/(route|page)\.(ts|js|tsx)$", ""))
    params = F.regexp_extract_all(route, F.lit(r"\[([^\]]+)\]"), 1)
    return {"path": route, "params": params, "route_type": F.when(source.rlike(r"route\.(ts|js)$"), "api").when(F.size(params) > 0, "detail").otherwise("page")}


def ui_layers(files: DataFrame) -> DataFrame:
    """(project, app_dir, ui_type): one of five kinds for each directory that holds an application."""
    app = F.regexp_extract("path", r"^((?:apps|packages)/[^/]+|admin|storefront|frontend|web)/", 1)
    flag = lambda p: F.bool_or(F.col("rest").rlike(p))
    rows = files.withColumn("app_dir", app).withColumn("rest", F.expr("substring(path, length(app_dir) + CASE WHEN app_dir = '' THEN 1 ELSE 2 END)"))
    flags = rows.groupBy("project", "app_dir").agg(flag(r"^src/admin/").alias("admin"), flag(r"^src/api/").alias("api"), flag(r"^(src/)?app/.*page\.tsx$").alias("next"), flag(r"^src/.*\.tsx$").alias("react"), flag(r"^go\.mod$").alias("go"))
    kind = F.when(F.col("admin"), "medusa-admin").when(F.col("api"), "medusa-api").when(F.col("next"), "nextjs").when(F.col("go"), "go-api").when(F.col("react"), "react")
    return flags.select("project", "app_dir", kind.alias("ui_type")).where("ui_type is not null")


def modules(files: DataFrame) -> DataFrame:
    """(project, module): directory names under src/modules and internal/core."""
    return files.select("project", F.regexp_extract("path", r"(?:^|/)(?:src/modules|internal/core)/([^/]+)/", 1).alias("module")).where("module <> ''").distinct()


def variants(modules: DataFrame) -> DataFrame:
    """(project, module, segment): the path segments that stand for a module: itself, its plurals, with underscores, and without a final s."""
    m = F.lower("module")
    base = F.array(m, F.replace(m, F.lit("-"), F.lit("_")), F.when(m.rlike("(ch|sh|s|x|z)$"), F.concat(m, F.lit("es"))), F.concat(m, F.lit("s")))
    alike = F.flatten(F.transform(F.filter(base, lambda s: s.isNotNull()), lambda s: F.array(s, F.concat(s, F.lit("s")), F.regexp_replace(s, "s$", ""))))
    return modules.select("project", "module", F.explode(F.array_distinct(alike)).alias("segment"))


def matches(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """Routes with each module that one of their segments stands for: an equality join on segments."""
    segments = routes.withColumn("segment", F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("path", "^/+|/+$", "")), "/"), lambda s: s != ""))))
    return segments.join(variants(modules), ["project", "segment"]).drop("segment").distinct()


def coverage(modules: DataFrame, matched: DataFrame) -> DataFrame:
    """For each module whether it has admin, storefront and API routes, detail views, and how many routes of each."""
    kind = F.col("kind")
    deep = F.size(F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")) >= 2
    detail = (F.col("route_type") == "detail") | F.contains("path", F.lit("[id]"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = modules.join(matched.withColumnRenamed("module", "m").withColumnRenamed("project", "p"), (F.col("module") == F.col("m")) & (F.col("project") == F.col("p")), "left")
    return out.groupBy("project", "module").agg(
        some(kind == "admin").alias("has_admin"),
        some(kind == "storefront").alias("has_storefront"),
        some(kind == "api").alias("has_api"),
        some((kind == "admin") & (detail | deep)).alias("has_detail_admin"),
        some((kind == "storefront") & detail).alias("has_detail_storefront"),
        F.count("path").alias("n_routes"),
    )


def gaps(cover: DataFrame) -> DataFrame:
    """(project, type, module) of what a module lacks."""
    kinds = F.array(F.when(~F.col("has_admin"), F.lit("critical")), F.when(~F.col("has_storefront"), F.lit("warning")), F.when(F.col("has_admin") & ~F.col("has_detail_admin"), F.lit("missing_detail")))
    return cover.select("project", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("type"), "module")


def orphans(routes: DataFrame, matched: DataFrame) -> DataFrame:
    """(project, type, module, path) of admin pages without a module, and of API routes outside /admin/ and /auth/ without one."""
    lone = routes.join(matched.select("project", "kind", "path").distinct(), ["project", "kind", "path"], "left_anti")
    admin = lone.where("kind = 'admin'").select("project", F.lit("orphan").alias("type"), F.get(F.split(F.regexp_replace("path", "^/+", ""), "/"), F.lit(0)).alias("module"), "path")
    api = lone.where((F.col("kind") == "api") & ~F.lower("path").rlike("/admin/|/auth/")).select("project", F.lit("info").alias("type"), F.element_at(F.split("path", "/"), -1).alias("module"), "path")
    return admin.union(api)


def dedupe_gaps(gaps: DataFrame, order: str) -> DataFrame:
    """The first gap of each type and module."""
    return gaps.withColumn("__n", F.row_number().over(Window.partitionBy("project", "type", "module").orderBy(order))).where("__n = 1").drop("__n")


def coverage_summary(cover: DataFrame) -> DataFrame:
    pct = lambda c: F.round(F.try_divide(F.count_if(c) * 100, F.count(F.lit(1))), 1)
    return cover.groupBy("project").agg(F.count(F.lit(1)).alias("total_modules"), F.count_if("has_admin").alias("with_admin"), F.count_if("has_storefront").alias("with_storefront"), F.count_if("has_api").alias("with_api"), pct(F.col("has_admin")).alias("admin_pct"), pct(F.col("has_storefront")).alias("storefront_pct"))


def ui_summary(routes: DataFrame) -> DataFrame:
    """Routes and files by kind, and in total."""
    return routes.rollup("kind").agg(F.count(F.lit(1)).alias("routes"), F.countDistinct("project").alias("projects")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "routes", "projects")

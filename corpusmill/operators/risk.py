"""Scores, hotspots, timelines, trends and roll-ups over rows that other operators give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BRANCHES = r"\b(if|for|while|case|catch|except|elif|and|or)\b|&&|\|\||\?"
SUBJECT = 80


def level(score: Column) -> Column:
    return F.when(score < 3, "low").when(score < 6, "medium").otherwise("high")


def component(kind: Column, value: Column) -> Column:
    """A component's value on a scale of 0 to 10: complexity a twentieth, findings and hotspots doubled, others as they are."""
    scaled = F.when(kind == "complexity", value / 20).when(kind.isin("security", "hotspots"), value * 2).otherwise(value)
    return F.least(scaled.cast("double"), F.lit(10.0))


def risk(components: DataFrame, by: str = "project", kinds: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """(by, score, level, n): the mean of the components (kind, value); null values don't count.

    The score is rounded as tenths in double arithmetic, so that means like 7.15 go up although the nearest double is below them.
    A sum of doubles depends on their order, and so does a mean between two tenths: with columns `order`, a project's components are added one
    after the other in that order, however the rows are dealt out. They are then sorted, and a project's are added by one task, which holds none but the last.
    """
    some = components.where(F.col("kind").isin(*kinds)) if kinds else components
    known, value = some.where(F.col("value").isNotNull()), component(F.col("kind"), F.col("value"))
    if order:
        w = Window.partitionBy(by).orderBy(*order)
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = known.select(by, F.avg(value).over(so_far).alias("mean"), F.row_number().over(w).cast("long").alias("n"), F.lead(F.lit(1)).over(w).alias("next"))
        scored = added.where(F.col("next").isNull())
    else:
        scored = known.groupBy(by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return scored.select(by, (F.round(F.col("mean") * 10) / 10).alias("score"), level(F.col("mean")).alias("level"), "n")


def file_metrics(files: DataFrame) -> DataFrame:
    """(path, lines, bytes, complexity): complexity is one and the number of words that branch."""
    return files.select("path", F.size(F.split("content", "\n")).alias("lines"), F.octet_length("content").alias("bytes"), (F.regexp_count("content", F.lit(BRANCHES)) + 1).alias("complexity"))


def grade(complexity: Column) -> Column:
    return F.when(complexity <= 5, "A").when(complexity <= 10, "B").when(complexity <= 20, "C").when(complexity <= 30, "D").otherwise("E")


def hotspots(metrics: DataFrame, least: int = 15) -> DataFrame:
    return metrics.withColumn("rank", grade(F.col("complexity"))).where(F.col("rank").isin("D", "E") | (F.col("complexity") > least))


def rolled_up(rows: Mapping[str, DataFrame], by: str) -> DataFrame:
    """(by, kind, n) for the rows of several sources."""
    parts = [df.select(by, F.lit(kind).alias("kind")) for kind, df in rows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n"))


def tool_findings(results: DataFrame, by: str = "session_id", result: str = "result") -> DataFrame:
    """For each session what its tools found: cycles, unused names, hotspots and errors, of the lists in their JSON results."""
    j = F.from_json(result, "cycles array<string>, unused array<string>, hotspots array<string>, errors array<string>, affected array<string>")
    n = lambda c: F.sum(F.coalesce(F.size(j[c]), F.lit(0))).alias(c)
    return results.groupBy(by).agg(*[n(c) for c in ("cycles", "unused", "hotspots", "errors", "affected")])


def session_summary(events: DataFrame, by: str = "session_id") -> DataFrame:
    """Tools, distinct files and total duration of each session."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("tools"), F.countDistinct("path").alias("files"), F.round(F.sum("duration"), 4).alias("duration"), F.max("ts").alias("last"))


def diff_overview(numstat: DataFrame, by: str) -> DataFrame:
    """Changed files, insertions, deletions, and the file that changed most."""
    return numstat.groupBy(by).agg(F.countDistinct("path").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.max_by("path", F.struct(F.col("insertions") + F.col("deletions"), "path")).alias("top_path"))


def trend(events: DataFrame, as_of: Column, days: int = 30, scope: str = "scope", ts: str = "ts") -> DataFrame:
    """(scope, day, n) of the last `days` days, a year at most."""
    since = as_of - F.make_dt_interval(F.lit(max(1, min(365, days))))
    return events.where((F.col(ts) >= since) & (F.col(ts) <= as_of)).groupBy(scope, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def timeline(commits: DataFrame, n: int = 10, by: str = "symbol") -> DataFrame:
    """The newest commits of each symbol, 50 at most, subjects cut."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), "id")
    return commits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(50, n))).withColumn("subject", F.substring("subject", 1, SUBJECT))


def layered(metrics: DataFrame, depth: int, by: str = "project") -> DataFrame:
    """(by, layer, metrics, total) of metric rows (layer, value) down to a depth."""
    return metrics.where(F.col("layer") <= depth).groupBy(by, "layer").agg(F.count(F.lit(1)).alias("metrics"), F.sum("value").alias("total"))


def rewrites(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, changed, hits) of a dry run of regular-expression rewrites, one after the other."""
    new, hits = F.col("content"), F.lit(0)
    for look, put in rules:
        hits = hits + F.regexp_count(new, F.lit(look))
        new = F.regexp_replace(new, look, put)
    return files.select("path", (new != F.col("content")).alias("changed"), hits.alias("hits"))


def report_counts(reports: DataFrame, report: str = "report") -> DataFrame:
    """`reports` with the number of findings (keys) and recommendations (entries) of a JSON report."""
    j = F.from_json(report, "findings map<string,string>, recommendations array<string>")
    return reports.withColumns({"n_findings": F.coalesce(F.size(F.map_keys(j["findings"])), F.lit(0)), "n_recommendations": F.coalesce(F.size(j["recommendations"]), F.lit(0))})

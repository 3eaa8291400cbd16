"""The life of findings: filters, dedupe, triage, counts, reports and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rules import CATEGORIES, SEVERITIES, STATUSES, rank

TITLE_CUT = 80


def severity_rank(c: Column) -> Column:
    return F.coalesce(rank(F.coalesce(c, F.lit("P3")), SEVERITIES), F.lit(5))


def filtered(findings: DataFrame, severity: str | None = None, status: str | None = None, category: str | None = None, file: str | None = None) -> DataFrame:
    """Findings that meet all criteria, with their severity's rank to order by."""
    out = findings.withColumn("rank", severity_rank(F.col("severity")))
    if severity:
        out = out.where(F.upper("severity") == severity.upper())
    if status:
        out = out.where(F.col("status") == status)
    if category:
        out = out.where(F.col("category") == category)
    if file:
        out = out.where(F.contains(F.lower("file"), F.lit(file.lower())))
    return out


def deduped(findings: DataFrame, order: Sequence[str], by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Findings that were new when they came: one with the same file, line and pattern that is neither fixed nor verified nor a false
    positive keeps later ones out. Findings with neither file nor pattern are always new."""
    named = (F.coalesce("file", F.lit("")) != "") | (F.coalesce("pattern_id", F.lit("")) != "")
    earlier = Window.partitionBy(*by, "file", "line", "pattern_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocking = F.max((~F.coalesce(F.col("status").isin("fixed", "verified", "false_positive"), F.lit(False))).cast("int"))
    return findings.withColumn("__b", blocking.over(earlier)).where(~named | (F.coalesce("__b", F.lit(0)) == 0)).drop("__b")


def added(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`new` with `status_of_add`: the reason of a rejection, duplicate, or added."""
    keys = ["session_id", "file", "line", "pattern_id"]
    held = existing.where(~F.col("status").isin("fixed", "verified", "false_positive")).select(*keys).distinct().withColumn("held", F.lit(True))
    out = new.join(held, keys, "left")
    what = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title").when(~F.upper("severity").isin(*SEVERITIES), "severity").when(~F.col("category").isin(*CATEGORIES), "category").when(F.col("held"), "duplicate").otherwise("added")
    return out.withColumn("status_of_add", what).drop("held")


def triaged(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Findings with the severity, status and notes of `updates` (id, severity, status, notes) where these are set and allowed."""
    u = updates.select("id", F.col("severity").alias("u_severity"), F.col("status").alias("u_status"), F.col("notes").alias("u_notes"), F.lit(True).alias("u"))
    severity = F.when(F.upper("u_severity").isin(*SEVERITIES), F.upper("u_severity"))
    status = F.when(F.col("u_status").isin(*STATUSES), F.col("u_status"))
    out = findings.join(u, "id", "left")
    return out.withColumns({"severity": F.coalesce(severity, "severity"), "status": F.coalesce(status, "status"), "notes": F.coalesce("u_notes", F.lit("")), "updated": F.coalesce("u", F.lit(False))}).drop("u", "u_severity", "u_status", "u_notes")


def stats(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category and by status in one pass."""
    sets = findings.groupingSets([["severity"], ["category"], ["status"]], "severity", "category", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").otherwise("status")
    return sets.select(kind.alias("kind"), F.coalesce("severity", "category", "status").alias("value"), "n")


def top_files(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(n)


def grouped(findings: DataFrame, by: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Each finding with its section (a severity, category or file), the section's place and its size."""
    place = severity_rank(F.col(by)) if by == "severity" else rank(F.col(by), CATEGORIES, len(CATEGORIES)) if by == "category" else F.dense_rank().over(Window.partitionBy(*keys).orderBy(by)) - 1
    return findings.withColumns({"section": F.col(by), "place": place.cast("int"), "section_n": F.count(F.lit(1)).over(Window.partitionBy(*keys, by))})


def markdown(f: DataFrame) -> Column:
    """A finding as markdown lines; long evidence is cut at 200 characters."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    has = set(f.columns)
    parts = [F.concat(F.lit("### `["), F.coalesce("severity", F.lit("P3")), F.lit("]` "), F.coalesce("title", F.lit("unknown")))]
    parts.append(F.concat(F.lit("- **Pattern:** `"), text("pattern_id"), F.lit("`")))
    parts.append(F.concat(F.lit("- **Location:** `"), text("file"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line"))).otherwise(F.lit("")), F.lit("`")))
    if "description" in has:
        parts.append(F.concat(F.lit("- **Description:** "), text("description")))
    if "evidence" in has:
        cut = F.when(F.length("evidence") > 200, F.concat(F.substring("evidence", 1, 200), F.lit("..."))).otherwise(text("evidence"))
        parts.append(F.concat(F.lit("- **Evidence:** `"), cut, F.lit("`")))
    if "suggested_fix" in has:
        parts.append(F.concat(F.lit("- **Fix:** "), text("suggested_fix")))
    return F.concat_ws("\n", *parts)


def report(findings: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """(session_id, report): findings by severity, one document per session."""
    each = findings.select("session_id", F.struct(severity_rank(F.col("severity")).alias("r"), *order, markdown(findings).alias("md")).alias("s"))
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["md"]), "\n")
    return each.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("# Report "), F.first("session_id").cast("string"), F.lit("\n"), all_of).alias("report"))


def retained(sessions: DataFrame, as_of: Column, max_days: int = 30, newest: int = 100, ts: str = "started_at", key: str = "session_id") -> DataFrame:
    """Sessions of the last `max_days` days, of these the newest."""
    young = sessions.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(max_days)))
    return young.orderBy(F.desc(ts), key).limit(newest)


def history(sessions: DataFrame, project: str | None = None, limit: int = 10, ts: str = "started_at", key: str = "session_id") -> DataFrame:
    """The newest sessions, of projects whose name has `project` in it; at most 50."""
    out = sessions.where(F.contains(F.lower("project"), F.lit(project.lower()))) if project else sessions
    return out.orderBy(F.desc(ts), key).limit(max(1, min(50, limit)))


def closed(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions with status closed, closed_at and summary where a request (session_id, at, summary) asks for it and they are open."""
    r = requests.select("session_id", F.col("at").alias("r_at"), F.col("summary").alias("r_summary"))
    out = sessions.join(r, "session_id", "left")
    close = F.col("r_at").isNotNull() & (F.col("status") == "open")
    return out.withColumns({"status": F.when(close, "closed").otherwise(F.col("status")), "closed_at": F.when(close, F.col("r_at")), "summary": F.when(close, F.col("r_summary"))}).drop("r_at", "r_summary")


def enriched(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rule's name and query, null where there is none."""
    return findings.join(rules.select(F.col("id").alias("pattern_id"), F.col("name").alias("rule_name"), "scan_query"), "pattern_id", "left")


def new_titles(candidates: DataFrame, existing: DataFrame, limit: int = 20, by: str = "session_id", order: Sequence[str] = ("title",)) -> DataFrame:
    """Candidates whose (cut) title the session doesn't have, each title once, at most `limit` a session."""
    cut = candidates.withColumn("title", F.substring("title", 1, TITLE_CUT))
    # titles that exist aren't made distinct first: the join doesn't need it, and a task would hold all of its part in a hash table
    fresh = cut.join(existing.select(by, F.substring("title", 1, TITLE_CUT).alias("title")), [by, "title"], "left_anti")
    once = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(by, "title").orderBy(*order))).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")

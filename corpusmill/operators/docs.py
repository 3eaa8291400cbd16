"""The document store: admission, saving, tags, updates, merging, comparison, exports and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normal_tag

TEST_QUERIES = ("test", "abc", "foo", "bar", "asdf", "xyz")
STATUSES = ("completed", "partial", "failed")
_FINDING = "array<struct<finding string, sources array<string>>>"
_SOURCE = "array<struct<url string, title string, relevance double>>"


def admitted(requests: DataFrame) -> DataFrame:
    """Requests (query, depth, max_sources) with the reason of a rejection, null if none, and both numbers clamped."""
    q = F.trim(F.coalesce("query", F.lit("")))
    reason = F.when(q == "", "empty").when(F.length(q) < 3, "too short").when(F.lower(q).isin(*TEST_QUERIES), "test").when(F.length(q) > 2000, "too long")
    clamp = lambda c, default, most: F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(c, F.lit(default))))
    return requests.withColumns({"reason": reason, "depth": clamp("depth", 3, 5).cast("int"), "max_sources": clamp("max_sources", 10, 50).cast("int")})


def finding_array(raw: Column) -> Column:
    """Findings given as a JSON array of strings or of objects, as structs. Anything else is no findings."""
    objects = F.from_json(raw, _FINDING)
    strings = F.transform(F.from_json(raw, "array<string>"), lambda s: F.struct(s.alias("finding"), F.array().cast("array<string>").alias("sources")))
    plain = F.transform(objects, lambda o: F.struct(F.coalesce(o["finding"], F.lit("")).alias("finding"), F.coalesce(o["sources"], F.array().cast("array<string>")).alias("sources")))
    return F.coalesce(F.when(F.ltrim(raw).rlike(r"^\[\s*\{"), plain).otherwise(strings), F.array().cast(_FINDING))


def source_array(raw: Column) -> Column:
    """Sources given as a JSON array of urls or of objects, as structs; relevance is 0.5 unless given."""
    objects = F.from_json(raw, _SOURCE)
    half = F.lit(0.5)
    strings = F.transform(F.from_json(raw, "array<string>"), lambda s: F.struct(s.alias("url"), s.alias("title"), half.alias("relevance")))
    plain = F.transform(objects, lambda o: F.struct(F.coalesce(o["url"], F.lit("")).alias("url"), F.coalesce(o["title"], F.lit("")).alias("title"), F.coalesce(o["relevance"], half).alias("relevance")))
    return F.coalesce(F.when(F.ltrim(raw).rlike(r"^\[\s*\{"), plain).otherwise(strings), F.array().cast(_SOURCE))


def saved(plans: DataFrame, payloads: DataFrame, existing: DataFrame) -> DataFrame:
    """New documents from plans and what was found for them; a plan is saved once."""
    good = payloads.where(F.col("status").isin(*STATUSES))
    out = plans.select("id", "query", "depth", "created_at").join(good, "id").join(existing.select("id"), "id", "left_anti")
    return out.withColumns({"findings": finding_array(F.col("findings")), "sources": source_array(F.col("sources"))})


def status_view(plans: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, state, duration) for each id asked: planned, the document's status, or not_found; durations as 5s, 2m 3s or 1h 4m."""
    p = plans.select("id", F.lit(True).alias("planned"))
    d = docs.select("id", "status", "created_at", "saved_at")
    secs = F.unix_timestamp("saved_at") - F.unix_timestamp("created_at")
    text = F.when(secs < 60, F.concat(secs, F.lit("s"))).when(secs < 3600, F.concat(F.floor(secs / 60), F.lit("m "), secs % 60, F.lit("s"))).otherwise(F.concat(F.floor(secs / 3600), F.lit("h "), F.floor(secs % 3600 / 60), F.lit("m")))
    return asked.join(p, "id", "left").join(d, "id", "left").select("id", F.when(F.col("planned"), "planned").otherwise(F.coalesce("status", F.lit("not_found"))).alias("state"), F.when(F.col("planned").isNull(), text).alias("duration"))


def orphans(plans: DataFrame, docs: DataFrame) -> DataFrame:
    """Plans without a document."""
    return plans.join(docs.select("id"), "id", "left_anti")


def newest(docs: DataFrame, n: int = 100, ts: str = "saved_at", key: str = "id") -> DataFrame:
    return docs.orderBy(F.desc(ts), key).limit(n)


def cleaned(plans: DataFrame, docs: DataFrame, as_of: Column, days: int = 30, results_too: bool = False) -> DataFrame:
    """(kind, id, action) of every plan and document: orphan plans, and documents if asked, go when they are older than `days`."""
    cutoff = as_of - F.make_dt_interval(F.lit(max(1, days)))
    has = docs.select("id").distinct().withColumn("has", F.lit(True))
    p = plans.join(has, "id", "left").select(F.lit("plan").alias("kind"), "id", F.when(F.col("has").isNull() & (F.col("created_at") < cutoff), "delete").otherwise("keep").alias("action"))
    d = docs.select(F.lit("result").alias("kind"), "id", F.when((F.col("saved_at") < cutoff) & F.lit(results_too), "delete").otherwise("keep").alias("action"))
    return p.union(d)


def tagged(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents after tag edits (id, action, edit_tags): add, remove, set or clear; tags are trimmed, lower-cased and hyphenated."""
    tags = F.transform(F.filter("edit_tags", lambda t: F.coalesce(t, F.lit("")) != ""), normal_tag)
    out = docs.join(edits, "id", "left")
    a = F.col("action")
    new = F.when(a == "add", F.array_distinct(F.concat("tags", tags))).when(a == "remove", F.filter("tags", lambda t: ~F.array_contains(tags, t))).when(a == "set", tags).when(a == "clear", F.array().cast("array<string>")).otherwise(F.col("tags"))
    return out.withColumn("tags", new).drop("action", "edit_tags")


def updated(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Documents after patches (id, new_summary, new_status, append_findings as JSON): a bad status rejects the patch."""
    p = patches.where(F.col("new_status").isNull() | F.col("new_status").isin(*STATUSES))
    out = docs.join(p, "id", "left")
    more = F.when(F.col("append_findings").isNotNull(), F.concat("findings", finding_array(F.col("append_findings")))).otherwise(F.col("findings"))
    changed = F.col("new_summary").isNotNull() | F.col("new_status").isNotNull() | F.col("append_findings").isNotNull()
    return out.withColumns({"summary": F.coalesce(F.trim("new_summary"), "summary"), "status": F.coalesce("new_status", "status"), "findings": more, "updated": F.coalesce(changed, F.lit(False))}).drop("new_summary", "new_status", "append_findings")


def first_seen(rows: DataFrame, by: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key, in `order`."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).where("__n = 1").drop("__n")


MERGED = 5  #: documents that may be merged into one


def _group_sizes(into: DataFrame) -> DataFrame:
    return into.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def merge_rejected(into: DataFrame) -> DataFrame:
    """(target, reason) of the groups that can't be merged."""
    n = F.col("n")
    return _group_sizes(into).where(~n.between(2, MERGED)).select("target", F.when(n < 2, "at least 2 documents are needed").otherwise(f"at most {MERGED} documents can be merged").alias("reason"))


def merged(docs: DataFrame, into: DataFrame) -> DataFrame:
    """One document for each group of `into` (id, target, pos): findings and tags first seen, the largest depth, the earliest date, and the
    first 300 characters of each summary. Groups of one document or of more than five aren't merged (see `merge_rejected`)."""
    d = docs.join(into.join(_group_sizes(into).where(F.col("n").between(2, MERGED)).select("target"), "target", "left_semi"), "id")
    found = d.select("target", "pos", F.posexplode("findings").alias("at", "f")).select("target", "pos", "at", F.col("f.finding").alias("finding"))
    once = first_seen(found, ["target"], "finding", ["pos", "at"]).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "finding"))).alias("f"))
    tags = d.select("target", "pos", F.posexplode("tags").alias("at", "tag"))
    tag_once = first_seen(tags, ["target"], "tag", ["pos", "at"]).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "tag"))).alias("t"))
    head = d.groupBy("target").agg(F.max("depth").alias("depth"), F.min("created_at").alias("created_at"), F.array_sort(F.collect_list(F.struct("pos", "id", F.substring("summary", 1, 300).alias("s")))).alias("m"))
    out = head.join(once, "target", "left").join(tag_once, "target", "left")
    some = F.filter(F.transform("m", lambda x: x["s"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return out.select("target", "depth", "created_at", F.array_join(some, " | ").alias("summary"), F.col("f.finding").alias("findings"), F.col("t.tag").alias("tags"), F.col("m.id").alias("merged_from"))


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def partial_closeout(plans: DataFrame, docs: DataFrame, calls: DataFrame) -> DataFrame:
    """A partial document for each plan that calls (id) were tracked for but none was saved."""
    n = calls.groupBy("id").agg(F.count(F.lit(1)).alias("calls"))
    return orphans(plans, docs).join(n, "id").select("id", "query", F.lit("partial").alias("status"), "calls")


def verified(docs: DataFrame, url_status: DataFrame) -> DataFrame:
    """For each document its sources, and how many of them answer (status under 400)."""
    each = docs.select("id", F.explode("sources").alias("s")).select("id", F.col("s.url").alias("url")).join(url_status, "url", "left")
    ok = F.coalesce((F.col("status") > 0) & (F.col("status") < 400), F.lit(False))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("failed"))


def stats(docs: DataFrame) -> DataFrame:
    """By status: documents, and totals of sources and findings."""
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sources")).alias("sources"), F.sum(F.size("findings")).alias("findings"))


def top_tags(docs: DataFrame, n: int = 10) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def age_histogram(docs: DataFrame, as_of: Column, ts: str = "saved_at") -> DataFrame:
    """How many documents are under 1, 1 to 7, 7 to 30 and over 30 days old; all four classes are returned."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400)
    bucket = F.when(days < 1, 0).when(days < 7, 1).when(days < 30, 2).otherwise(3)
    counts = docs.where(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    dim = docs.sparkSession.createDataFrame([(0, "< 1"), (1, "1-7"), (2, "7-30"), (3, "> 30")], "bucket int, days string")
    return dim.join(counts, "bucket", "left").select("bucket", "days", F.coalesce("n", F.lit(0)).alias("n"))


def common_keywords(docs: DataFrame, by: str, top: int = 15) -> DataFrame:
    """For each group of documents the words over three characters that its findings use most, if at least as often as it has documents."""
    sizes = docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs"))
    words = docs.select(by, F.explode("findings").alias("f")).select(by, F.explode(F.split(F.lower("f.finding"), r"\s+")).alias("word")).where(F.length("word") > 3)
    counts = words.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)
    return best.join(sizes, by).where(F.col("n") >= F.col("docs")).select(by, "word", "n")


def compared(docs: DataFrame, by: str) -> DataFrame:
    """For each group: documents, findings, and distinct source urls."""
    heads = docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("findings")).alias("findings"))
    urls = docs.select(by, F.explode("sources").alias("s")).where("s.url <> ''").groupBy(by).agg(F.countDistinct("s.url").alias("urls"))
    return heads.join(urls, by, "left").withColumn("urls", F.coalesce("urls", F.lit(0)))


def csv_rows(docs: DataFrame) -> DataFrame:
    """The columns of the bulk export: tags joined by commas, summaries without semicolons, cut at 200. Write them with sep=";"."""
    summary = F.substring(F.replace(F.coalesce("summary", F.lit("")), F.lit(";"), F.lit(",")), 1, 200)
    return docs.select("id", "query", "status", F.array_join("tags", ",").alias("tags"), F.size("findings").alias("findings_count"), F.size("sources").alias("sources_count"), summary.alias("summary"))


def markdown(docs: DataFrame) -> Column:
    """A document as markdown: head, summary, numbered findings with their sources, and source lines."""
    found = F.array_join(F.transform("findings", lambda f, i: F.concat(F.lit("### "), i + 1, F.lit(". "), f["finding"], F.array_join(F.transform(f["sources"], lambda s: F.concat(F.lit("\n   - Source: "), s)), ""))), "\n")
    listed = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- ["), s["title"], F.lit("]("), s["url"], F.lit(") (relevance: "), F.format_number(s["relevance"], 1), F.lit(")"))), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Research: "), F.col("query")),
        F.concat(F.lit("**Status:** "), F.col("status")),
        F.lit("## Summary"),
        F.coalesce("summary", F.lit("")),
        F.concat(F.lit("## Findings ("), F.size("findings"), F.lit(")")),
        found,
        F.concat(F.lit("## Sources ("), F.size("sources"), F.lit(")")),
        listed,
    )

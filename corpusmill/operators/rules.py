"""The rule library: loading, validation, filters, presets, upserts and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import kept

# Enumerations of the data model.
SEVERITIES = ("P0", "P1", "P2", "P3", "INFO")
LIBRARY_SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("low", "medium", "high")
CATEGORIES = ("security", "code-quality", "typescript", "react-next", "admin-ui", "performance", "testing", "dependency", "database", "other")
STATUSES = ("open", "triaged", "in_progress", "fixed", "verified", "false_positive", "wont_fix")
LANGUAGE_EXTENSIONS = {"python": ("py",), "typescript": ("ts", "tsx", "js", "jsx"), "go": ("go",), "rust": ("rs",)}
SEVERITY_MAP = {"CRITICAL": "P0", "HIGH": "P1", "MEDIUM": "P2", "LOW": "P3", "INFO": "INFO"}
CUSTOM_PREFIX = "CUSTOM_"
MAX_CUSTOM = 500


def rank(c: Column, order: Sequence[str], other: int | None = None) -> Column:
    """Place of the value in `order`, from 0."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c) - 1
    return F.when(at >= 0, at).otherwise(F.lit(other)).cast("int")


def map_severity(c: Column) -> Column:
    """CRITICAL, HIGH, ... (any case) as P0, P1, ...; anything else P2."""
    pairs = F.create_map(*[F.lit(x) for kv in SEVERITY_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.upper(c)), F.lit("P2"))


def library_errors(rules: DataFrame) -> Column:
    """What is wrong with a library rule, joined by "; "; empty if nothing."""
    return F.concat_ws(
        "; ",
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "id missing"),
        F.when(F.coalesce(F.col("scan_query"), F.lit("")) == "", "scan_query missing"),
        F.when(~F.coalesce(F.col("severity").isin(*LIBRARY_SEVERITIES), F.lit(False)), "bad severity"),
        F.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "bad confidence"),
        F.when((F.coalesce(F.col("cwe"), F.lit("")) != "") & ~F.col("cwe").rlike(r"^CWE-\d+$"), "bad cwe"),
    )


def load(rules: DataFrame, order: str = "pos") -> DataFrame:
    """Valid rules; of rules with one id the last stays."""
    good = rules.where(library_errors(rules) == "")
    return good.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def custom_reject(rules: DataFrame) -> Column:
    """The first reason to reject a custom rule; null if it is fine."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    severity = F.upper(F.coalesce(F.col("severity"), F.lit("P2")))
    return (
        F.when(text("name") == "", "name")
        .when(~F.coalesce(F.col("scan_type"), F.lit("")).isin("grep", "code_search", "code_diagnostics"), "scan_type")
        .when(F.col("scan_type").isin("grep", "code_search") & (text("scan_query") == ""), "scan_query")
        .when(~severity.isin(*SEVERITIES), "severity")
        .when((text("category") != "") & ~F.col("category").isin(*CATEGORIES, "custom"), "category")
    )


def filtered(rules: DataFrame, categories: Sequence[str] = (), languages: Sequence[str] = (), severities: Sequence[str] = (), min_confidence: str = "low") -> DataFrame:
    """Rules that meet all criteria given."""
    out = rules
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if languages:
        out = out.where(F.arrays_overlap("languages", F.array(*[F.lit(x) for x in languages])))
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    least = CONFIDENCES.index(min_confidence) if min_confidence in CONFIDENCES else 0
    return out.where(rank(F.col("confidence"), CONFIDENCES, 0) >= least)


def for_language(rules: DataFrame, language: str) -> DataFrame:
    """Rules of the language, or whose glob names one of its extensions."""
    extensions = LANGUAGE_EXTENSIONS.get(language, ())
    named = F.coalesce(F.col("scan_file_glob"), F.lit("")).rlike(r"\.(\{[^}]*\b)?(" + "|".join(extensions) + r")\b") if extensions else F.lit(False)
    return rules.where((F.col("scan_language") == language) | named)


def for_stack(rules: DataFrame, stack: DataFrame) -> DataFrame:
    """Rules without frameworks, with "*", or for a framework in `stack` (name)."""
    each = rules.withColumn("__r", F.monotonically_increasing_id()) if "id" not in rules.columns else rules
    key = "__r" if "id" not in rules.columns else "id"
    wanted = each.select(key, F.explode("frameworks").alias("name")).join(stack.select("name").distinct(), "name", "left_semi").select(key).distinct()
    any_stack = each.where(F.col("frameworks").isNull() | (F.size("frameworks") == 0) | F.array_contains("frameworks", "*"))
    return any_stack.unionByName(each.join(any_stack.select(key), key, "left_anti").join(wanted, key, "left_semi")).drop("__r")


def resolve_presets(presets: DataFrame, rules: DataFrame) -> DataFrame:
    """(preset, id) in the order of the preset's categories, each rule once."""
    named = presets.select("preset", F.posexplode("categories").alias("pos", "category"))
    return named.join(rules.select("id", "category"), "category").groupBy("preset", "id").agg(F.min("pos").alias("pos"))


def scan_targets(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, id): the rule of that id, else the rules of that category."""
    by_id = targets.join(rules.select("id"), F.col("target") == F.col("id")).select("target", "id")
    rest = targets.join(by_id.select("target"), "target", "left_anti")
    by_category = rest.join(rules.select("id", "category"), F.col("target") == F.col("category")).select("target", "id")
    return by_id.union(by_category)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`rows` numbered from 1 by the columns `order`, without one task that sees them all: sorted into ranges, numbered within each, and moved on by the
    counts of the ranges before."""
    parted = kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.join(F.broadcast(before), "__part").withColumn(name, place + F.col("__before")).drop("__part", "__before")


def next_ids(new: DataFrame, existing: DataFrame, order: str, prefix: str = CUSTOM_PREFIX, width: int = 3) -> DataFrame:
    """`new` with an `assigned` id: the largest number in use plus 1, 2, ... by `order`. Numbers wider than `width` keep all their digits."""
    largest = existing.where(F.col("id").startswith(prefix)).agg(F.coalesce(F.max(F.expr(f"try_cast(substring(id, {len(prefix) + 1}) as bigint)")), F.lit(0)).alias("largest"))
    number = (F.col("__place") + F.col("largest")).cast("string")
    out = numbered(new, [order], "__place").crossJoin(F.broadcast(largest))
    return out.withColumn("assigned", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0")))).drop("largest", "__place")


def upserted(existing: DataFrame, patches: DataFrame, limit: int = MAX_CUSTOM) -> DataFrame:
    """Custom rules after `patches` (name, scan_query, severity, ts): a rule with the same name and query is updated and keeps its id and
    created_at, others are added while there is room for `limit` rules. status says updated, added, kept or rejected. Only new rules are numbered."""
    key = lambda p: F.md5(F.concat_ws("::", F.trim(F.col(f"{p}name")), F.trim(F.col(f"{p}scan_query"))))
    new = patches.select(*[F.col(c).alias(f"p_{c}") for c in patches.columns]).withColumn("key", key("p_")).withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("p_ts")))).where("__n = 1").drop("__n")
    have = existing.withColumn("key", key(""))
    old = have.join(new, "key", "left").withColumn("status", F.when(F.col("p_name").isNotNull(), "updated").otherwise("kept"))
    room = existing.agg(F.count(F.lit(1)).alias("have"))
    added = numbered(new.join(have.select("key"), "key", "left_anti"), ["p_ts", "key"], "place").crossJoin(F.broadcast(room)).withColumn("status", F.when(F.col("have") + F.col("place") <= limit, "added").otherwise("rejected"))
    out = old.unionByName(added.drop("have", "place"), allowMissingColumns=True)
    return out.select("key", "id", F.coalesce("name", "p_name").alias("name"), F.coalesce("scan_query", "p_scan_query").alias("scan_query"), F.coalesce("p_severity", "severity").alias("severity"), F.coalesce("created_at", "p_ts").alias("created_at"), "status")


def repo_upserted(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `changes` replace rows with their key."""
    return existing.join(changes.select(key), key, "left_anti").unionByName(changes)


def deleted(rules: DataFrame, ids: DataFrame, prefix: str = CUSTOM_PREFIX) -> DataFrame:
    """Rules without those in `ids`; only ids with the custom prefix may go."""
    return rules.join(ids.where(F.col("id").startswith(prefix)).select("id").distinct(), "id", "left_anti")


def migrated(repo: DataFrame, custom: DataFrame) -> DataFrame:
    """The repository with the custom rules whose id it doesn't have."""
    return repo.unionByName(custom.join(repo.select("id"), "id", "left_anti"))

"""Differences between reports and between page snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import kept

SHOWN = ("tool", "path", "depth", "symbol")  #: reported even if unchanged
GROUPS = {"summary": ("summary",), "findings": ("findings", "sections"), "layers": ("layers",)}  #: compared key by key, missing ones as empty
_MAP = "map<string, variant>"


def _map(c: Column) -> Column:
    """An object's entries; null for other values."""
    return F.try_variant_get(c, "$", _MAP)


def _same(a: Column, b: Column) -> Column:
    """Equal values, given as JSON: numbers by value, others by their text, in which keys are sorted."""
    number = lambda c: F.when(c.rlike("^-?[0-9]"), c.try_cast("double"))
    return F.coalesce(number(a) == number(b), F.lit(False)) | a.eqNullSafe(b)


def _entries(prefix: Column) -> Column:
    """For maps `o` and `n`: a struct for each key of either, named after the prefix."""
    name = lambda k: F.when(prefix == "", k).otherwise(F.concat(prefix, F.lit("."), k))
    each = lambda k: F.struct(name(k).alias("key"), F.col("o")[k].alias("old"), F.col("n")[k].alias("new"), F.map_contains_key("o", k).alias("had"), F.map_contains_key("n", k).alias("has"), F.lit(False).alias("shown"))
    return F.transform(F.array_union(F.map_keys("o"), F.map_keys("n")), each)


def _rows(entries: Column) -> Column:
    """A row for each entry, and an empty one for none: a plain `inline` has its array worked out twice, for a filter on its size, too."""
    return F.inline_outer(entries)


def nested_diff(old: DataFrame, new: DataFrame, by: str = "report_id", report: str = "report") -> DataFrame:
    """(by, key, status, old, new) of reports that are JSON objects of any depth; keys are dotted, values JSON.

    Where both sides have an object under a key, it is compared key by key; else a key is added, removed or changed as a whole, and what is
    below it isn't listed again. The keys in SHOWN are listed unchanged, too, and never as added or removed; those in GROUPS start from an empty object where they are missing or empty.
    Reports are joined once; each level below is an explode of the objects of the level before, so work follows the size of the objects.
    A report that one side lacks, or that isn't a JSON object, is an empty one; of ids that repeat, every pair is compared; null ids have no partner.
    """
    read = lambda df, to: df.select(by, F.col(report).alias(to))
    nothing = F.create_map().cast(_MAP)
    parsed = lambda c: F.coalesce(_map(F.try_parse_json(c)), nothing).alias(c)
    both = read(old, "o").join(read(new, "n"), by, "full_outer").select(by, parsed("o"), parsed("n"))  # texts are joined, being smaller than what they are parsed to

    def of_group(side: str, names: tuple[str, ...]) -> Column:
        some = F.filter(F.array(*[F.col(side)[k] for k in names]), lambda x: F.size(_map(x)) > 0)
        return F.coalesce(F.get(some, F.lit(0)), F.parse_json(F.lit("{}")))

    some = lambda side, k: F.when(~F.is_variant_null(F.col(side)[k]), F.col(side)[k])  # noqa: E731  # null is like a missing one
    known = [*SHOWN, *(k for names in GROUPS.values() for k in names)]
    shown = [F.struct(F.lit(k).alias("key"), some("o", k).alias("old"), some("n", k).alias("new"), F.lit(True).alias("had"), F.lit(True).alias("has"), (F.map_contains_key("o", k) | F.map_contains_key("n", k)).alias("shown")) for k in map(F.lit, SHOWN)]
    groups = [F.struct(F.lit(g).alias("key"), of_group("o", names).alias("old"), of_group("n", names).alias("new"), F.lit(True).alias("had"), F.lit(True).alias("has"), F.lit(False).alias("shown")) for g, names in GROUPS.items()]
    other = F.filter(_entries(F.lit("")), lambda e: ~e["key"].isin(*known))
    rows = both.select(by, _rows(F.concat(F.filter(F.array(*shown), lambda e: e["shown"]), F.array(*groups), other))).where("key is not null")
    out = None
    while True:
        # a level is saved with the JSON of its values, worked out once a value that is compared; only objects to go down into are kept as variants
        rows = rows.withColumn("both", ~F.col("shown") & _map(F.col("old")).isNotNull() & _map(F.col("new")).isNotNull())
        json = lambda c: F.when(~F.col("both"), F.to_json(c)).alias(f"{c}_json")
        rows = kept(rows.select(by, "key", "had", "has", "shown", "both", json("old"), json("new"), *[F.when(F.col("both"), F.col(c)).alias(c) for c in ("old", "new")]), "reports")
        status = F.when(~F.col("had"), "added").when(~F.col("has"), "removed").when(_same(F.col("old_json"), F.col("new_json")), "unchanged").otherwise("changed")
        found = rows.where("not both").select(by, "key", status.alias("status"), F.col("old_json").alias("old"), F.col("new_json").alias("new"), "shown").where("shown or status <> 'unchanged'").drop("shown")
        out = found if out is None else out.union(found)
        deeper = rows.where("both")
        if deeper.isEmpty():
            return out
        rows = deeper.select(by, "key", _map(F.col("old")).alias("o"), _map(F.col("new")).alias("n")).select(by, _rows(_entries(F.col("key")))).where("key is not null")


def report_diff(old: DataFrame, new: DataFrame, by: str = "report_id") -> DataFrame:
    """(by, key, status, old, new) of flattened reports (by, key, value): added, removed and changed keys, and unchanged ones of a few names."""
    both = old.select(by, "key", F.col("value").alias("old"), F.lit(1).alias("o")).join(new.select(by, "key", F.col("value").alias("new"), F.lit(1).alias("n")), [by, "key"], "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    return both.select(by, "key", status.alias("status"), "old", "new").where((F.col("status") != "unchanged") | F.col("key").isin(*SHOWN))


def summary(diff: DataFrame, by: str = "report_id") -> DataFrame:
    return diff.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))


def page_key(url: Column) -> Column:
    """The name a page's baseline is kept under."""
    return F.substring(F.md5(url), 1, 16)


def baseline_diff(baseline: DataFrame, now: DataFrame, fields: tuple[str, str, str] = ("title", "elements", "text"), by: Sequence[str] = ()) -> DataFrame:
    """(key, page_id, state, *_changed) of snapshots (url, fields) against their baseline; pages without one are new.

    `by`: columns that tell snapshots with one url apart; a snapshot meets the baseline that has the same.
    """
    old = baseline.select(page_key(F.col("url")).alias("key"), *by, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("known"))
    out = now.withColumn("key", page_key(F.col("url"))).join(old, ["key", *by], "left")
    flags = [(F.col("known") & ~F.col(f).eqNullSafe(F.col(f"old_{f}"))).alias(f"{f}_changed") for f in fields]
    any_flag = flags[0] | flags[1] | flags[2]
    return out.select("key", "page_id", F.when(F.col("known").isNull(), "new").when(any_flag, "changed").otherwise("same").alias("state"), *[F.coalesce(f, F.lit(False)).alias(f"{n}_changed") for f, n in zip(flags, fields, strict=True)])

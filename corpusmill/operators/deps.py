"""Versions, dependency manifests and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 4
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
CARGO_SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")


def _set(c: Column) -> Column:
    return F.when(c != "", c)


def clean_semver(v: Column) -> Column:
    """Without range signs and wildcards; of alternatives the first; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(v), r"^[\^~<>=! ]+", ""))
    first = F.get(F.split(F.trim(F.get(F.split(bare, r"\|\|"), F.lit(0))), r"\s+"), F.lit(0))
    return _set(F.replace(first, F.lit("*"), F.lit("0")))


def clean_go(v: Column) -> Column:
    """Without v, build suffix, and the date and hash of pseudo-versions."""
    bare = F.regexp_replace(v, r"^v+", "")
    pseudo = F.size(F.split(bare, "-")) > 2
    return _set(F.get(F.split(F.when(pseudo, F.get(F.split(bare, "-"), F.lit(0))).otherwise(bare), r"\+"), F.lit(0)))


def digits(v: Column) -> Column:
    """The leading numbers of a version."""
    return F.regexp_extract(v, r"(\d+(?:\.\d+)*)", 1)


def version_key(v: Column) -> Column:
    """Four numbers that order versions; null for pre-releases and what isn't a version."""
    ok = v.rlike(r"^\d+(\.\d+){0,3}$")
    parts = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    return F.when(ok, F.slice(F.concat(parts, F.array_repeat(F.lit(0), PARTS)), 1, PARTS))


def in_range(key: Column, text: Column) -> Column:
    """Whether a version key is in a range: comparisons parted by commas, all of which must hold."""
    tests = F.filter(F.split(text, ","), lambda t: F.trim(t) != "")

    def holds(t: Column) -> Column:
        op = F.regexp_extract(t, r"^\s*([<>=!]=?)", 1)
        other = version_key(F.trim(F.regexp_replace(t, r"^\s*[<>=!]+", "")))
        return F.coalesce(F.when(op == "<", key < other).when(op == "<=", key <= other).when(op == ">", key > other).when(op == ">=", key >= other).when(op == "!=", key != other).otherwise(key == other), F.lit(False))

    return F.coalesce((F.size(tests) > 0) & F.forall(tests, holds), F.lit(False))


def npm(files: DataFrame) -> DataFrame:
    """(project, package, version) of package.json texts; versions that aren't strings are skipped."""
    j = F.from_json("content", ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    parts = [files.select("project", F.explode(j[s]).alias("package", "spec")) for s in SECTIONS]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("project", "package", clean_semver(F.col("spec")).alias("version")).where("version is not null")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("project", "path", F.posexplode(F.split("content", r"\r?\n")).alias("no", "raw")).withColumn("raw", F.trim("raw"))


def pypi(files: DataFrame) -> DataFrame:
    """(project, package, version) of requirements texts."""
    line = F.trim(F.get(F.split("raw", " #"), F.lit(0)))
    rows = _lines(files).where(~F.col("raw").rlike(r"^(#|-|$)")).withColumn("raw", line)
    found = r"^([a-zA-Z0-9_.-]+)\s*(?:===?|>=?|<=?|!=|~=)\s*([a-zA-Z0-9_.*-]+)"
    out = rows.select("project", F.lower(F.regexp_extract("raw", found, 1)).alias("package"), F.replace(F.regexp_extract("raw", found, 2), F.lit("*"), F.lit("0")).alias("version"))
    return out.where("package <> '' and version <> ''")


def go(files: DataFrame) -> DataFrame:
    """(project, package, version) of go.mod texts: single requires and blocks. Blocks are a running sum over a file's lines."""
    opens = F.when(F.col("raw").rlike(r"^require\s*\("), 1).when(F.col("raw") == ")", -1).otherwise(0)
    depth = F.sum(opens).over(Window.partitionBy("project", "path").orderBy("no"))
    rows = _lines(files).withColumn("depth", depth).where((F.col("depth") > 0) | F.col("raw").rlike(r"^require\s+[^(]"))
    words = F.split(F.regexp_replace("raw", r"^require\s+", ""), r"\s+")
    out = rows.where(~F.col("raw").rlike(r"^require\s*\(|^//|^$")).select("project", F.get(words, F.lit(0)).alias("package"), clean_go(F.get(words, F.lit(1))).alias("version"))
    return out.where("version is not null")


def cargo(files: DataFrame) -> DataFrame:
    """(project, package, version) of Cargo.toml texts: plain and inline tables. A line's section is the last header before it."""
    header = F.when(F.col("raw").startswith("["), F.trim(F.regexp_replace("raw", r"^\[|\]+$", "")))
    section = F.last(header, ignorenulls=True).over(Window.partitionBy("project", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    rows = _lines(files).withColumn("section", section).where(F.col("section").isin(*CARGO_SECTIONS) & ~F.col("raw").rlike(r"^(\[|#|$)"))
    spec = F.coalesce(_set(F.regexp_extract("raw", r'^[a-zA-Z0-9_-]+\s*=\s*"([^"]+)"', 1)), _set(F.regexp_extract("raw", r'^[a-zA-Z0-9_-]+\s*=\s*\{.*version\s*=\s*"([^"]+)".*\}', 1)))
    return rows.select("project", F.regexp_extract("raw", r"^([a-zA-Z0-9_-]+)", 1).alias("package"), clean_semver(spec).alias("version")).where("version is not null")


def vulnerable(deps: DataFrame, advisories: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """Dependencies with the advisories (package, ecosystem, ranges, severity, title) one of whose ranges holds their version."""
    known = advisories.unionByName(user) if user is not None else advisories
    each = deps.withColumn("__key", version_key(F.col("version"))).join(known, ["package", "ecosystem"])
    return each.where(F.exists("ranges", lambda r: in_range(F.col("__key"), r))).drop("__key", "ranges")


def as_profile(vulns: DataFrame) -> DataFrame:
    """Vulnerabilities as rows of a stack profile."""
    return vulns.select("project", F.lit("vulnerability").alias("category"), F.concat_ws("@", "package", "version").alias("name"), F.when(F.col("severity").isin("critical", "high"), "high").otherwise("medium").alias("confidence"))

"""Rules deduced from findings, and candidate rules found in a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .literals import matched

# What evidence looks like, the query for it, and its name; the first that fits counts.
CONTEXTS = (
    (r"except\s+\w*\s*:\s*pass", r"except.*?:\s*pass", "Silent Catch"),
    (r"except\s*:", r"except\s*:", "Bare Except"),
    (r"console\.\s*(log|warn|error)\s*\(", r"console\.(log|warn|error)\(", "Console Log"),
    (r"execSync\s*\(", r"execSync\(", "execSync Call"),
    (r"\bexec\s*\(", r"\bexec\s*\(", "exec Call"),
    (r"setTimeout\s*\(", r"setTimeout\(", "setTimeout"),
    (r"setInterval\s*\(", r"setInterval\(", "setInterval"),
    (r"\beval\s*\(", r"\beval\s*\(", "eval Call"),
    (r"(spawn|fork|execFile)\s*\(", r"(spawn|fork|execFile)\(", "Child Process"),
    (r"SELECT\s+.*FROM.*\+", r"SELECT.*FROM.*\+", "SQL Concatenation"),
    (r"print\s*\(.*['\"]debug", r"print\(.*['\"]debug", "Debug Print"),
    (r"print\s*\(.*[a-z]", r"print\(.*[a-z]", "print() Debug"),
)
LANGUAGES = (
    ("py", "python", "**/*.py"),
    ("ts", "typescript", "**/*.{ts,tsx}"),
    ("tsx", "typescript", "**/*.{ts,tsx}"),
    ("js", "javascript", "**/*.{js,jsx}"),
    ("jsx", "javascript", "**/*.{js,jsx}"),
    ("go", "go", "**/*.go"),
    ("rs", "rust", "**/*.rs"),
    ("java", "java", "**/*.java"),
    ("rb", "ruby", "**/*.rb"),
    ("php", "php", "**/*.php"),
)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def deduced(evidence: Column) -> Column:
    """Struct of query and name: by the first context that fits, else the first identifier as a call. Empty evidence: both empty."""

    def first(ev: Column) -> Column:
        out = F.struct(F.concat(F.regexp_extract(ev, r"([a-zA-Z_]\w*)", 1), F.lit(r"\(")).alias("query"), F.regexp_extract(ev, r"([a-zA-Z_]\w*)", 1).alias("name"))
        out = F.when(~ev.rlike("[a-zA-Z_]"), F.struct(F.regexp_replace(_stripped(F.substring(ev, 1, 50)), r"([^\p{L}\p{N}_])", r"\\$1").alias("query"), F.substring(ev, 1, 30).alias("name"))).otherwise(out)
        for look, query, name in reversed(CONTEXTS):
            out = F.when(ev.rlike("(?i)" + look), F.struct(F.lit(query).alias("query"), F.lit(name).alias("name"))).otherwise(out)
        return out

    return _once(_stripped(F.coalesce(evidence, F.lit(""))), first)


def language(path: Column) -> Column:
    """Struct of language and glob by the path's extension; both empty if it isn't known."""

    def known(ext: Column) -> Column:
        out = F.struct(F.lit("").alias("language"), F.lit("").alias("glob"))
        for e, lang, glob in LANGUAGES:
            out = F.when(ext == e, F.struct(F.lit(lang).alias("language"), F.lit(glob).alias("glob"))).otherwise(out)
        return out

    return _once(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1), known)


def bulk(findings: DataFrame) -> DataFrame:
    """A rule for each finding with a title or evidence and a query: severity P1 at most, category by severity if none is given."""
    some = findings.where((F.coalesce("title", F.lit("")) != "") | (F.coalesce("evidence", F.lit("")) != ""))
    # exploded, so that what is deduced is worked out once and not again for each of its uses and for the filter
    d = some.select("*", F.explode(F.array(F.struct(deduced(F.col("evidence")).alias("d"), language(F.col("file")).alias("l")))).alias("x")).select("*", "x.d", "x.l").where("x.d.query <> ''")
    kind = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).when(F.col("severity") == "P0", "security").when(F.col("severity").isin("P1", "P2", "P3"), "code-quality").otherwise("other")
    return d.select("id", F.coalesce(F.nullif("title", F.lit("")), "d.name").alias("name"), F.when(F.col("severity") == "P0", "P1").otherwise(F.col("severity")).alias("severity"), kind.alias("category"), F.col("d.query").alias("scan_query"), F.col("l.language").alias("scan_language"), F.col("l.glob").alias("scan_file_glob"))


def from_finding(findings: DataFrame) -> DataFrame:
    """A rule for each finding: the call in its evidence, else its first word; no query outside code files."""
    code = F.col("file").rlike(r"\.(py|ts|tsx|js|go|rs)$") & (F.coalesce("evidence", F.lit("")) != "")
    call = F.trim(F.regexp_extract("evidence", r"(\w+(?:\.\w+)*\s*\()", 1))
    word = F.get(F.split(F.trim("evidence"), r"\s+"), F.lit(0))
    query = F.when(code, F.when(call != "", call).otherwise(word))
    return findings.select("id", F.col("title").alias("name"), "severity", query.alias("scan_query"), F.when(code, F.concat(F.lit("**/*."), F.regexp_extract("file", r"\.([^.]+)$", 1))).alias("scan_file_glob"))


def imported(findings: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """(name, scan_query, severity, ts, n) for bulk import: one row per name and query, the newest severity wins."""
    some = findings.where(F.col("pattern_id") == pattern_id) if pattern_id else findings
    query = F.substring(F.coalesce(F.nullif("pattern_id", F.lit("")), "title"), 1, 100)
    return some.groupBy(F.col("title").alias("name"), query.alias("scan_query")).agg(F.max_by("severity", F.struct("created_at", "id")).alias("severity"), F.count(F.lit(1)).alias("n"))


def discovered(lines: DataFrame, candidates: Sequence[tuple[str, str, str, str]], library: Sequence[str], least: int = 2, n: int = 10) -> DataFrame:
    """Candidate rules (name, query, description, fix) whose query isn't in the library and that hit at least `least` lines: the most frequent,
    with a confidence that grows with frequency, description and fix."""
    new = [c for c in candidates if c[1] not in library]
    counts = matched(lines.select("line"), [c[1] for c in new], name="i").groupBy("i").agg(F.count(F.lit(1)).alias("frequency"))
    table = lines.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(new)], "i int, name string, query string, description string, fix string")
    f = F.col("frequency")
    confidence = 0.5 + F.when(f > 10, 0.3).when(f > 5, 0.15).otherwise(0.0) + F.when(F.col("description") != "", 0.1).otherwise(0.0) + F.when(F.col("fix") != "", 0.1).otherwise(0.0)
    return table.join(counts, "i").where(f >= least).select("name", "query", "frequency", F.round(F.least(F.lit(1.0), confidence), 2).alias("confidence")).orderBy(F.desc("frequency"), "name").limit(n)

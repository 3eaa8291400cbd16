"""Rule scans over the lines of a corpus, and detectors of secrets, conflicts, debug statements and markers.

All rules are tried in one pass: an automaton finds the literals that rules can't match without, and a line is tried with
those rules only; a library may hold any number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .literals import holds, matched, needed
from .rules import SEVERITIES

EVIDENCE = 200


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    scan_type: str
    scan_query: str
    scan_file_glob: str = ""
    kinds: tuple[str, ...] = ()


# The secret patterns, what they are, and whether a hit blocks.
SECRETS = (
    (r"-----BEGIN\s+(?:RSA|EC|DSA|OPENSSH)\s+PRIVATE KEY-----", "Private/SSH Key", True),
    (r"-----BEGIN\s+CERTIFICATE-----", "Certificate", True),
    (r"sk-[a-zA-Z0-9]{20,}", "OpenAI API Key (sk-...)", False),
    (r"(?i)(?:gh[ps]_|github_pat_)[a-zA-Z0-9]{36,}", "GitHub Token", False),
    (r"AKIA[0-9A-Z]{16}", "AWS Access Key ID", False),
    (r"(?i)(?:postgres|mysql|redis|mongodb|sqlite)://\w+:\w+@", "DB connection string with credentials", False),
    (r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", "JWT Token", False),
    (r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*[\"'][A-Za-z0-9_@#$%^&+=!]{12,}", "Credential assignment", False),
)
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "pdf", "zip", "tar", "gz", "lock")
DEBUG = ((r"breakpoint\(\)", "breakpoint()"), (r"pdb\.set_trace\(\)", "pdb.set_trace()"), (r"debugger;?", "debugger statement"), (r"import pdb", "import pdb"))
CODE = ("py", "ts", "tsx", "js", "jsx")
TODO = r"TODO|FIXME|HACK|XXX|WORKAROUND|KNOWN.?BUG"
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "venv", "coverage", ".cache", "vendor")
LARGE = 1_000_000


def inventory(files: DataFrame, ignored: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """Files outside ignored directories, with name, extension and size."""
    inside = "(^|/)(" + "|".join(re.escape(d) for d in ignored) + ")/"
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.col("path").rlike(inside)).select("project", "path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"), F.octet_length("content").cast("long").alias("size"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over paths: `**/` is any directories, `*` and `?` stay within a name, {a,b} are choices.
    A glob without a slash fits the name at any depth."""
    if not glob:
        return ""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = "[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", c)
        out, i = out + c, i + 1
    return ("^" if "/" in glob else "(^|/)") + out + "$"


def selected(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    """(path, glob) for each glob that fits a file."""
    fits = F.array(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in globs])
    return files.select("project", "path", F.explode(F.filter(fits, lambda g: g.isNotNull())).alias("glob"))


def lines(files: DataFrame) -> DataFrame:
    """Numbered lines; files with a NUL are binary and have none."""
    text = files.where(~F.contains("content", F.lit("\x00")))
    return text.select("project", "path", "ext", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("project", "path", "ext", (F.col("pos") + 1).alias("line_no"), "line")


def evidence(line: Column) -> Column:
    return F.substring(F.trim(line), 1, EVIDENCE)


def batch(source: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All grep rules against all lines: one row per rule and line. Works on a stream too, as it keeps no state."""
    greps = [r for r in rules if r.scan_type == "grep" and r.scan_query]
    which = F.col("__rule") + 1
    of_rule = lambda field: F.element_at(F.lit([getattr(r, field) for r in greps] or [""]), which)
    hits = matched(source.select("project", "path", "line_no", "line"), [r.scan_query for r in greps], name="__rule")
    globs = F.element_at(F.lit([glob_regex(r.scan_file_glob) for r in greps] or [""]), which)
    hits = hits.where((globs == "") | F.rlike("path", globs))
    return hits.select("project", of_rule("id").alias("pattern_id"), of_rule("severity").alias("severity"), of_rule("name").alias("title"), of_rule("category").alias("category"), F.col("path").alias("file"), F.col("line_no").alias("line"), evidence(F.col("line")).alias("evidence"))


def capped(findings: DataFrame, limit: int = 20) -> DataFrame:
    """The first hits of each rule, by file and line."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("pattern_id").orderBy("file", "line"))).where(F.col("n") <= limit)


def match_counts(findings: DataFrame, rules: Sequence[Rule], scan: str = "project") -> DataFrame:
    """For each rule the number of scans in which it hit."""
    table = findings.sparkSession.createDataFrame([(r.id,) for r in rules], "pattern_id string")
    counts = findings.groupBy("pattern_id").agg(F.countDistinct(scan).alias("n"))
    return table.join(counts, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0)).alias("match_count"))


def outcomes(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What came of each rule: hits, none, manual or unknown."""
    table = findings.sparkSession.createDataFrame([(r.id, r.scan_type) for r in rules], "pattern_id string, scan_type string")
    counts = findings.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    what = F.when(F.col("scan_type") == "grep", F.when(F.col("n") > 0, "hits").otherwise("none")).when(F.col("scan_type").isin("code_search", "code_diagnostics"), "manual").otherwise("unknown")
    return table.join(counts, "pattern_id", "left").select("pattern_id", what.alias("outcome"), F.coalesce("n", F.lit(0)).alias("hits"))


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A count for every severity, zeros included."""
    dim = findings.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    if by:
        dim = findings.select(*by).distinct().crossJoin(F.broadcast(dim))
    counts = findings.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, [*by, "severity"], "left").select(*by, "severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def _contexts(regex: str) -> Column:
    """Each match in the content with the 20 characters before and after it, which may hold other matches."""
    found = F.regexp_extract_all("content", F.lit(regex), 0)
    pieces = F.split("content", regex, -1)  # what stands before, between and after the matches
    nothing = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    places = F.aggregate(
        F.arrays_zip(pieces.alias("piece"), found.alias("match")),
        nothing,
        lambda so, x: F.struct(
            (so["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), so["out"]).otherwise(F.concat(so["out"], F.array(_around(so["at"] + F.length(x["piece"]), F.length(x["match"]))))).alias("out"),
        ),
        lambda so: so["out"],
    )
    return F.when(F.col("content").rlike(regex), places)


def _around(at: Column, size: Column, reach: int = 20) -> Column:
    start = F.greatest(at - reach, F.lit(1))
    return F.substring(F.col("content"), start, at + size + reach - start)


def secrets(files: DataFrame) -> DataFrame:
    """(path, kind, blocking, context) for each secret, with 20 characters around it. Test files only count for blocking kinds. One pass over the files."""
    test = F.col("path").rlike(r"/tests/|^tests/|/test_|^test_|/fixtures/|/mock/|/__snapshots__/")
    low = files.where(~F.lower("ext").isin(*BINARY)).select("path", "content", F.explode(F.array(F.lower("content"))).alias("low"))  # once for all literals: filters aren't moved below an explode
    look = {regex: holds(F.col("low"), literals) if (literals := needed(regex)) else F.lit(True) for regex, _, _ in SECRETS}  # cheap, before any regular expression
    wanted = {regex: look[regex] if blocking else look[regex] & ~test for regex, _, blocking in SECRETS}
    text = low.where(reduce(or_, wanted.values()))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(blocking).alias("blocking"), F.when(wanted[regex], _contexts(regex)).alias("contexts")) for regex, kind, blocking in SECRETS])
    each = text.select("path", F.explode(kinds).alias("k")).where("k.contexts is not null")
    return each.select("path", "k.kind", "k.blocking", F.explode("k.contexts").alias("context")).withColumn("context", F.replace("context", F.lit("\n"), F.lit("\\n")))


def conflicts(source: DataFrame) -> DataFrame:
    """(path, line_no) of each file's first merge conflict marker."""
    bare = F.trim("line")
    mark = (bare == "=======") | bare.startswith("<<<<<<< ") | bare.startswith(">>>>>>> ")
    return source.where(mark).groupBy("path").agg(F.min("line_no").alias("line_no"))


def debug_statements(files: DataFrame, extensions: Sequence[str] = CODE) -> DataFrame:
    """(path, statement): the first kind in the list that a code file has."""
    first = F.coalesce(*[F.when(F.col("content").rlike(r), F.lit(d)) for r, d in DEBUG])
    return files.where(F.col("ext").isin(*extensions)).select("path", first.alias("statement")).where("statement is not null")


def todo_markers(files: DataFrame, pattern: str = TODO) -> DataFrame:
    """(path, markers): the distinct markers of each file, upper-cased, sorted, joined by commas."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), 1), F.upper)))
    return files.where(F.col("content").rlike(pattern)).select("path", F.array_join(found, ",").alias("markers"))


def large_files(files: DataFrame, limit: int = LARGE) -> DataFrame:
    size = F.octet_length("content")
    return files.where(size > limit).select("path", size.cast("long").alias("size"), F.floor(size / 1024).alias("kb"))


def file_refs(messages: DataFrame, text: str = "text") -> DataFrame:
    """`messages` with the first three file names found in the text: quoted ones, then bare ones."""
    quoted = F.regexp_extract_all(text, F.lit(r"[`\"']([\w./-]+\.\w{1,5})[`\"']"), 1)
    bare = F.regexp_extract_all(text, F.lit(r"(?:^|\s)([\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|toml))\b"), 1)
    return messages.withColumn("refs", F.slice(F.array_distinct(F.concat(quoted, bare)), 1, 3))


def console_errors(logs: DataFrame, text: str = "raw") -> DataFrame:
    """A finding for each log line that speaks of an error (P1) or a warning (P2)."""
    each = logs.withColumn("line", F.explode(F.split(text, "\n", -1))).where(F.lower("line").rlike("error|warn"))
    return each.withColumns({"severity": F.when(F.contains(F.lower("line"), F.lit("error")), "P1").otherwise("P2"), "evidence": F.substring("line", 1, EVIDENCE)})


def network_errors(logs: DataFrame, text: str = "raw") -> DataFrame:
    """A finding for each line with a status in brackets of 400 and more (P2) or 500 and more (P1)."""
    each = logs.withColumn("line", F.explode(F.split(text, "\n", -1))).withColumn("status", F.regexp_extract("line", r"\[(\d{3})\]", 1).try_cast("int")).where("status >= 400")
    return each.withColumns({"severity": F.when(F.col("status") >= 500, "P1").otherwise("P2"), "evidence": F.substring(F.trim("line"), 1, EVIDENCE)})

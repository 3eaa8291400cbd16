"""Files: source trees as rows of text, and lists of rules, markers and advisories kept as YAML or JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.rules import library_errors
from ..operators.scan import IGNORED_DIRS, glob_regex

RULE = "id string, cwe string, category string, severity string, languages array<string>, title string, scan_query string, scan_file_glob string, fix_description string, confidence string, frameworks array<string>"
MARKER = "tech string, category string, markers array<struct<glob string, search string, confidence string>>"
ADVISORY = "package string, ecosystem string, vulnerable_versions array<string>, patched_versions array<string>, severity string, title string, cwe string, ghsa_id string"

SUFFIXES = ("yaml", "yml", "json")


def roots(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED_DIRS) -> tuple[str, list[str], list[str]]:
    """(root, what to read, empty files) of a tree without folders of ignored names: whole folders where nothing below is ignored, else the single
    files and the whole folders in them. The file system is listed once, by the driver, as Spark lists paths."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    empty, skip = [], set(ignored)

    def visit(folder) -> tuple[bool, list[str]]:
        whole, own, below = True, [], []
        for s in system.listStatus(folder):
            path = s.getPath()
            if s.isFile():
                (own if s.getLen() else empty).append(path.toString())
            elif path.getName() in skip:
                whole = False
            else:
                clean, parts = visit(path)
                whole &= clean
                below += [path.toString()] if clean else parts
        return whole, [] if whole else own + below

    start = system.getFileStatus(top).getPath()
    clean, parts = visit(start)
    return start.toString(), [start.toString()] if clean else parts, empty


def walk(spark: SparkSession, root: str, *, ignored: Sequence[str] = IGNORED_DIRS, globs: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(project, path, ext, size, content) of the files of a tree, ignored folders pruned before anything is read.

    project is the root's name, path is relative to the root, ext as in the path. With `globs`, files that fit one of them; with `most`, files of at most so many bytes: Spark drops
    the others before it opens them. Bytes that aren't UTF-8 become U+FFFD; a tree without files gives no rows.
    """
    top, inside, empty = roots(spark, root, ignored)
    names = sorted({g.rsplit("/", 1)[-1] for g in globs})
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if len(names) == 1:
        read = read.option("pathGlobFilter", names[0])
    files = read.load(inside or [top]).select("path", "length", "content").where(F.lit(bool(inside)))
    if empty:  # Spark doesn't open empty files
        files = files.union(spark.createDataFrame([(p,) for p in empty], "path string").select("path", F.lit(0).cast("long"), F.lit(b"")))
    if most is not None:
        files = files.where(F.col("length") <= most)
    path = F.expr("substring(path, " + str(len(top.rstrip("/")) + 2) + ")")
    out = files.select(F.lit(top.rstrip("/").rsplit("/", 1)[-1]).alias("project"), path.alias("path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    if globs:
        out = out.where(F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    return out.select("project", "path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"), "size", "content")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        from yaml import YAMLError, safe_load
    except ImportError:  # JSON is YAML, too
        safe_load, YAMLError = json.loads, ValueError  # noqa: N806
    for path, text in ((p, t) for batch in batches for p, t in zip(batch["path"], batch["content"], strict=True)):
        rows = []
        try:
            found = safe_load(text)
        except (YAMLError, ValueError, RecursionError) as e:
            rows.append((path, None, None, f"not readable: {str(e).splitlines()[0][:200]}"))
            found = None
        if isinstance(found, dict):
            found = next((v for v in found.values() if isinstance(v, list)), [found])  # a list under one key
        if found is not None and not isinstance(found, list):
            rows.append((path, None, None, "not a list"))
            found = None
        for pos, entry in enumerate(found or []):
            ok = isinstance(entry, dict)
            rows.append((path, pos, json.dumps(entry, default=str) if ok else None, None if ok else "not a mapping"))
        yield pd.DataFrame(rows, columns=["file", "pos", "entry", "reason"]).astype({"pos": "Int32"})


def listed(spark: SparkSession, root: str, schema: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(file, pos, fields of `schema`, reason): a row for each entry of the lists in a tree's files; a file that can't be read costs one row with a reason.

    Each file is one row of work. Entries that aren't mappings, and values of another type than the schema's, have a reason; scalars are read as text where text is wanted.
    """
    files = walk(spark, root, ignored=(), globs=[f"*.{s}" for s in suffixes])
    rows = files.select("path", "content").mapInPandas(_entries, "file string, pos int, entry string, reason string")
    read = rows.withColumn("e", F.from_json("entry", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    reason = F.coalesce("reason", F.when(F.col("e._corrupt_record").isNotNull(), "a value of the wrong type"))
    return read.select("file", "pos", "e.*", reason.alias("reason")).drop("_corrupt_record")


def rule_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """All rules in a tree's files, with a reason for those that can't be used."""
    rows = listed(spark, root, RULE, suffixes)
    filled = rows.withColumns({"cwe": F.coalesce("cwe", F.lit("")), "confidence": F.coalesce("confidence", F.lit("medium")), "languages": F.coalesce("languages", F.array().cast("array<string>"))})
    return filled.withColumn("reason", F.coalesce("reason", F.nullif(library_errors(filled), F.lit(""))))


def rules(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """The usable rules of a tree's files; of those with one id the last stays: files go by name, *.yaml before others, entries in order."""
    good = rule_files(spark, root, suffixes).where("reason is null")
    place = F.struct((~F.col("file").endswith(".yaml")).alias("other"), "file", "pos")
    return good.withColumn("last", F.row_number().over(Window.partitionBy("id").orderBy(place.desc()))).where("last = 1").drop("last", "reason")


def marker_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """The entries of marker files that can be read, for `stack.load_markers`."""
    return listed(spark, root, MARKER, suffixes).where("reason is null").select("tech", "category", "markers")


def advisory_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Advisories, a row for each vulnerable range."""
    good = listed(spark, root, ADVISORY, suffixes).where("reason is null and package is not null")
    return good.select("package", "ecosystem", F.explode("vulnerable_versions").alias("range"), "patched_versions", "severity", "title", "cwe", "ghsa_id")

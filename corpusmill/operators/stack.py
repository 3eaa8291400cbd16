"""Technology stacks of projects: markers, dependencies, environment keys and container images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import glob_regex

CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}
MARKER_CATEGORIES = ("language", "frontend", "backend", "database", "infra", "saas", "testing", "build", "other")

# Environment prefixes and images with the category and name that they stand for.
DOTENV = (
    ("SENTRY_", "infra", "sentry"),
    ("STRIPE_", "saas", "stripe"),
    ("OTEL_", "infra", "opentelemetry"),
    ("GOOGLE_", "infra", "gcp"),
    ("AWS_", "infra", "aws"),
    ("DATABASE_URL", "database", "postgresql"),
    ("REDIS_URL", "database", "redis"),
    ("NEXT_PUBLIC_", "frontend", "nextjs"),
    ("MEDUSA_", "backend", "medusa"),
    ("NODE_ENV", "language", "node"),
    ("OPENAI_API_KEY", "saas", "openai"),
    ("ANTHROPIC_API_KEY", "saas", "anthropic"),
    ("SLACK_", "saas", "slack"),
    ("TWILIO_", "saas", "twilio"),
    ("SENDGRID_", "saas", "sendgrid"),
    ("DATABASE_HOST", "database", "postgresql"),
    ("DATABASE_NAME", "database", "postgresql"),
    ("DATABASE_USER", "database", "postgresql"),
    ("DATABASE_PASSWORD", "database", "postgresql"),
)
IMAGES = (
    ("postgres", "database", "postgresql"),
    ("redis", "database", "redis"),
    ("nginx", "infra", "nginx"),
    ("node", "language", "node"),
    ("python", "language", "python"),
    ("golang", "language", "go"),
    ("rust", "language", "rust"),
    ("mariadb", "database", "mariadb"),
    ("mysql", "database", "mysql"),
    ("mongo", "database", "mongodb"),
    ("elasticsearch", "database", "elasticsearch"),
    ("rabbitmq", "backend", "rabbitmq"),
    ("traefik", "infra", "traefik"),
    ("caddy", "infra", "caddy"),
    ("prom", "infra", "prometheus"),
    ("grafana", "infra", "grafana"),
    ("alpine", "other", "alpine"),
    ("ubuntu", "other", "ubuntu"),
)

Marker = tuple[str, str, str, str, str]  #: tech, category, glob, search ("" for: the file exists), confidence


def load_markers(rules: DataFrame) -> DataFrame:
    """(tech, category, glob, search, confidence) of marker rules with a known category, one row per marker."""
    good = rules.where(F.col("category").isin(*MARKER_CATEGORIES) & (F.coalesce("tech", F.lit("")) != ""))
    each = good.select("tech", "category", F.explode("markers").alias("m")).select("tech", "category", "m.glob", F.coalesce("m.search", F.lit("")).alias("search"), F.coalesce("m.confidence", F.lit("medium")).alias("confidence"))
    return each.where(F.coalesce("glob", F.lit("")) != "")


def overridden(builtin: DataFrame, rules: DataFrame) -> DataFrame:
    """Marker rows, those of `rules` in place of built-in ones for the same technology."""
    return builtin.join(rules.select("tech").distinct(), "tech", "left_anti").unionByName(rules)


def _filed(glob: str) -> list[str]:
    """Under what names of files a glob is looked up: `n:` an exact name, `e:` the extensions of its last part, or "" for any file."""
    name = glob.rsplit("/", 1)[-1]
    if name and not set(name) & set("*?{["):
        return [f"n:{name}"]
    tail = name.rsplit(".", 1)[-1] if "." in name else ""
    choices = tail[1:-1].split(",") if tail[:1] == "{" and tail[-1:] == "}" else [tail]
    return [f"e:{c}" for c in choices] if all(c and not set(c) & set("*?{}[],") for c in choices) and not set(name.rsplit(".", 1)[0]) & set("{}") else [""]


def detected(files: DataFrame, markers: Sequence[Marker]) -> DataFrame:
    """(project, category, name, confidence, n_evidence, first_evidence) of the technologies whose markers fit a project's files.

    Markers are filed by exact name or extension; a file looks up its own, and only these are tried, so a catalogue may be long. One pass, no join.
    """
    index: dict[str, list[int]] = {}
    for i, m in enumerate(markers):
        for key in _filed(m[2]):
            index.setdefault(key, []).append(i)
    if not markers:
        index = {"": []}
    filed = F.map_from_arrays(F.lit(list(index)), F.array(*[F.lit(v) if v else F.array().cast("array<int>") for v in index.values()]))
    name = F.element_at(F.split("path", "/"), -1)
    mine = lambda key: F.coalesce(F.try_element_at(filed, key), F.array().cast("array<int>"))
    candidates = F.concat(mine(F.concat(F.lit("n:"), name)), mine(F.concat(F.lit("e:"), F.element_at(F.split(name, r"\."), -1))), mine(F.lit("")))
    pick = lambda values, i: F.element_at(F.lit(list(values) or [""]), i + 1)
    fits = lambda i: F.rlike(F.col("path"), pick((glob_regex(m[2]) for m in markers), i)) & F.contains(F.coalesce("content", F.lit("")), pick((m[3] for m in markers), i))
    found = files.select("project", "path", F.explode(F.filter(candidates, fits)).alias("i"))
    c = F.element_at(F.lit([list(CONFIDENCE).index(m[4]) for m in markers] or [0]), F.col("i") + 1)
    each = found.select("project", "path", pick((m[0] for m in markers), F.col("i")).alias("name"), pick((m[1] for m in markers), F.col("i")).alias("category"), c.alias("c"))
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    out = each.groupBy("project", "category", "name").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_evidence"), F.min("path").alias("first_evidence"))
    return out.select("project", "category", "name", F.get(names, F.col("c")).alias("confidence"), "n_evidence", "first_evidence")


def fast(markers: Sequence[Marker]) -> list[Marker]:
    """The markers of technologies that have one of high confidence."""
    high = {m[0] for m in markers if m[4] == "high"}
    return [m for m in markers if m[0] in high]


def dotenv_keys(files: DataFrame) -> DataFrame:
    """(project, path, no, key) of environment files."""
    rows = files.select("project", "path", F.posexplode(F.split("content", r"\r?\n")).alias("no", "raw")).withColumn("raw", F.trim("raw"))
    key = F.trim(F.get(F.split("raw", "=", 2), F.lit(0)))
    return rows.where(~F.col("raw").startswith("#") & F.contains("raw", F.lit("="))).select("project", "path", "no", key.alias("key")).where("key <> ''")


def dotenv_services(keys: DataFrame, prefixes: Sequence[tuple[str, str, str]] = DOTENV) -> DataFrame:
    """(project, category, name, evidence): each key's longest known prefix, each service once."""
    longest = sorted(prefixes, key=lambda p: -len(p[0]))
    service = F.coalesce(*[F.when(F.col("key").startswith(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"))) for p, c, n in longest])
    known = keys.withColumn("s", service).where("s is not null")
    return known.groupBy("project", "s.category", "s.name").agg(F.min(F.struct("path", "no", "key")).alias("e")).select("project", "category", "name", F.col("e.key").alias("evidence"))


def docker_images(files: DataFrame) -> DataFrame:
    """(project, path, image, base, tag) of image: and FROM lines."""
    rows = files.select("project", "path", F.explode(F.split("content", r"\r?\n")).alias("raw")).withColumn("raw", F.trim("raw"))
    image = F.coalesce(F.nullif(F.regexp_extract("raw", r"""^image:\s*["']?([^"'\s]+)""", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"(?i)^FROM\s+(\S+)", 1), F.lit("")))
    name = F.element_at(F.split("image", "/"), -1)
    return rows.select("project", "path", image.alias("image")).where("image is not null").select("project", "path", "image", F.lower(F.get(F.split(name, ":"), F.lit(0))).alias("base"), F.get(F.split(name, ":"), F.lit(1)).alias("tag"))


def docker_services(images: DataFrame, known: DataFrame) -> DataFrame:
    """(project, category, name, version) of images in `known` (base, category, name), each base image once."""
    return images.join(known, "base").groupBy("project", "category", "name").agg(F.min(F.struct("path", "image", "tag")).alias("i")).select("project", "category", "name", F.col("i.tag").alias("version"))


def dependency_category(deps: DataFrame, exact: DataFrame, prefixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Dependencies with category and confidence: by exact name high, by prefix medium, else other and low."""
    by_prefix = F.coalesce(*[F.when(F.col("package").startswith(p), F.lit(c)) for p, c in sorted(prefixes, key=lambda x: -len(x[0]))])
    out = deps.join(exact.select("package", F.col("category").alias("__exact")), "package", "left").withColumn("__prefix", by_prefix)
    return out.withColumns({"category": F.coalesce("__exact", "__prefix", F.lit("other")), "confidence": F.when(F.col("__exact").isNotNull(), "high").when(F.col("__prefix").isNotNull(), "medium").otherwise("low")}).drop("__exact", "__prefix")


def union(*layers: DataFrame) -> DataFrame:
    """Profile rows (project, category, name, confidence) of several layers; of one name the first layer's row stays."""
    rows = [x.select("project", "category", "name", "confidence").withColumn("layer", F.lit(i)) for i, x in enumerate(layers)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("n", F.row_number().over(Window.partitionBy("project", "name").orderBy("layer", "category", "confidence"))).where("n = 1").drop("n")


def weight(confidence: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), confidence), F.lit(0.3))


def confidence(stack: DataFrame) -> DataFrame:
    """(project, overall_confidence): the mean weight of what was found."""
    return stack.groupBy("project").agg(F.round(F.avg(weight(F.col("confidence"))), 2).alias("overall_confidence"))

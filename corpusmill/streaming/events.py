"""Event tracking in batch and as streams: TTL dedupe, sessions, progress, close-out, error rates and continuous scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.rules import SEVERITIES
from ..operators.scan import Rule, batch, lines
from ..sources.shared import folder

TTL = 300
WATERMARK = "10 minutes"


def ttl_dedupe(events: DataFrame, keys: Sequence[str], ts: str = "ts", ttl: int = TTL, order: str = "event_id") -> DataFrame:
    """Events that are `ttl` seconds or more after the last accepted event of their key.

    An event that comes `ttl` after any event before it is accepted whatever came before, so a key's events fall into runs and only
    within a run the events are folded one after the other, over sorted partitions with the last accepted time as the only state.
    """
    w = Window.partitionBy(*keys).orderBy("__t", order)
    timed = events.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    starts = timed.withColumn("__start", F.coalesce(F.col("__t") - F.lag("__t").over(w) >= ttl * 1_000_000, F.lit(True)))
    fold = starts.select(*keys, order, F.sum(F.col("__start").cast("int")).over(w).alias("__run"), "__t", "__start")
    types = dict(events.dtypes)
    out = ", ".join(f"`{c}` {types[c]}" for c in [*keys, order])
    sorted_runs = fold.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "__t", order)
    accepted = sorted_runs.mapInArrow(_folder(len(keys) + 1, ttl * 1_000_000), out)
    return events.join(accepted, [*keys, order], "left_semi")


def _folder(width: int, ttl: int):
    """Of runs that come sorted: the first `width` columns of the accepted events; time and start of a run come last."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            taken = []
            for t, start in zip(*(batch.column(i).to_pylist() for i in range(width + 1, width + 3)), strict=True):
                ok = start or last is None or (t is not None and t - last >= ttl)
                last = t if ok else last
                taken.append(ok)
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]).filter(pa.array(taken, pa.bool_()))

    return fold


def sessions(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """(by, start, end, tools, paths, last) of runs of activity."""
    out = events.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("tools"), F.countDistinct("path").alias("paths"), F.max(ts).alias("last"))
    return out.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "tools", "paths", "last")


def progress(events: DataFrame, by: str = "user_id", ts: str = "ts", order: str = "event_id", start: str = "signup") -> DataFrame:
    """Each event with the number of calls since its job began, and percent: 20 a call, 95 at most; 5 before the first."""
    w = Window.partitionBy(by).orderBy(ts, order)
    jobs = events.withColumn("job", F.sum((F.col("event_type") == start).cast("int")).over(w)).where("job > 0")
    calls = F.sum((F.col("event_type") != start).cast("int")).over(Window.partitionBy(by, "job").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0))
    return jobs.withColumn("calls", calls).withColumn("percent", F.when(F.col("calls") == 0, 5).otherwise(F.least(F.col("calls") * 20, F.lit(95))))


SEVERITY_OF = {"error": "P1", "signup": "P2", "view": "INFO"}  #: what an event of a type counts as in a session's summary; others don't


def severity_of(kind: Column, severities: dict[str, str] = SEVERITY_OF) -> Column:
    out = F.lit(None).cast("string")
    for k, s in severities.items():
        out = F.when(kind == k, F.lit(s)).otherwise(out)
    return out


def summary(counts: Sequence[Column]) -> Column:
    """Counts per severity that aren't zero, as "P0=1, P2=3"; "no findings" if all are."""
    said = F.concat_ws(", ", *[F.when(n > 0, F.concat(F.lit(f"{s}="), n.cast("string"))) for s, n in zip(SEVERITIES, counts, strict=True)])
    return F.when(said == "", "no findings").otherwise(said)


def closed_out(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", ts: str = "ts", saved: str = "purchase") -> DataFrame:
    """Sessions that ended: (by, start, end, calls, errors, state, summary). state: "partial" if nothing was saved, else "closed"; `summary` counts severities."""
    kind = severity_of(F.col("event_type"))
    counts = [F.count_if(kind == s).alias(f"n{i}") for i, s in enumerate(SEVERITIES)]
    out = events.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.col("event_type") == saved).alias("saved"), *counts)
    return _ended(out.withColumns({"start": F.col("s.start"), "end": F.col("s.end")}), by)


def _ended(out: DataFrame, by: str) -> DataFrame:
    return out.select(by, "start", "end", "calls", "errors", F.when(F.col("saved"), "closed").otherwise("partial").alias("state"), summary([F.col(f"n{i}") for i in range(len(SEVERITIES))]).alias("summary"))


def relevant(events: DataFrame, prefixes: Sequence[str], tool: str = "event_type", result: str = "props") -> DataFrame:
    """Events of tools with one of the prefixes whose result doesn't speak of an error in its first 200 characters."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col(tool).startswith(p)
    return events.where(named & ~F.contains(F.lower(F.substring(F.coalesce(result, F.lit("")), 1, 200)), F.lit("error")))


def error_rate(errors: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """(start, severity, n) of log findings in tumbling windows."""
    return errors.groupBy(F.window(ts, width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "severity", "n")


def stream(spark: SparkSession, folder_path: str, schema, name_glob: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit a glob."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder_path)


def drained(out: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, into Parquet files, and reads these. `at`: a folder that keeps rows and state; a later run with it goes on where this one ended."""
    spark = out.sparkSession
    at = at or folder(spark, name)
    started = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def _stateful(spark: SparkSession) -> None:
    """State is kept in RocksDB, out of the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _taken(width: int, ttl: int):
    """Of rows that come sorted by key, a key's head (kind 0) and its last time (1) before its events (2): the first `width` columns of the accepted events. Kind and time come last."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fresh = None, True
        for batch in batches:
            taken = []
            for kind, t in zip(*(batch.column(i).to_pylist() for i in (width, width + 1)), strict=True):
                if kind < 2:
                    last, fresh = t, kind == 0
                ok = kind == 2 and (fresh or (t is not None and last is not None and t - last >= ttl))
                last, fresh = (t, False) if ok else (last, fresh)
                taken.append(ok)
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]).filter(pa.array(taken, pa.bool_()))

    return fold


def ttl_dedupe_stream(events: DataFrame, keys: Sequence[str], name: str = "ttl", ts: str = "ts", ttl: int = TTL, order: str = "event_id", at: str | None = None) -> DataFrame:
    """The events that a stream accepts of what is there now: those `ttl` seconds or more after the last accepted one of their key; within a batch in order of time, without a time last.

    Each batch is sorted by Spark and folded row after row with one time as state, so no task holds a key's rows. A key's last time goes from batch to batch in
    files beside the rows, until the watermark of `events` on `ts`, if it has one, has passed it by `ttl`; rows that are later than the watermark are left out, as
    Spark's own states do. A batch that is run again replaces its own rows and times. `at`: a folder that keeps rows and state, see `drained`.
    """
    spark = events.sparkSession
    at = at or folder(spark, name)
    micros, late = ttl * 1_000_000, events.schema[ts].metadata.get("spark.watermarkDelayMs")
    plain = {c: f"c{i}" for i, c in enumerate(events.columns)}
    by, width = [plain[k] for k in keys], len(plain)
    kind = ", ".join(f"{plain[f.name]} {f.dataType.simpleString()}" for f in events.schema.fields)
    known = ", ".join([*(f"{plain[k]} {events.schema[k].dataType.simpleString()}" for k in keys), "at_micros long, seen long"])
    time = lambda df: df.withColumn("at_micros", F.unix_micros(F.col(plain[ts]).cast("timestamp")))

    def one(df: DataFrame, number: int) -> None:
        read = lambda schema, path: df.sparkSession.read.schema(schema).parquet(f"{at}/{path}")
        before, rows = read(known, f"last/{(number + 1) % 2}"), time(df.toDF(*plain.values()))
        passed = before.agg(F.max("seen")).first()[0]  # one number
        if passed is not None and late is not None:
            rows = rows.where(F.col("at_micros").isNull() | (F.col("at_micros") > (passed // 1000 - late) * 1000))
        heads = rows.groupBy(*by).agg(F.max("at_micros").alias("seen"))
        kinds = [heads.select(*by, F.lit(0).alias("kind")), before.select(*by, "at_micros", F.lit(1).alias("kind")), rows.withColumn("kind", F.lit(2))]
        each = kinds[2].unionByName(kinds[0], allowMissingColumns=True).unionByName(kinds[1], allowMissingColumns=True)
        each = each.select(*plain.values(), "kind", "at_micros").repartition(*by).sortWithinPartitions(*by, "kind", F.asc_nulls_last("at_micros"), plain[order])
        each.mapInArrow(_taken(width, micros), kind).write.mode("overwrite").parquet(f"{at}/rows/{number}")
        accepted = time(read(kind, f"rows/{number}")).select(*by, "at_micros", F.lit(None).cast("long").alias("seen"))
        now = accepted.unionByName(before).unionByName(heads, allowMissingColumns=True).groupBy(*by).agg(F.max("at_micros").alias("at_micros"), F.max("seen").alias("seen"))
        seen = now.agg(F.max("seen")).first()[0]
        now = now.withColumn("seen", F.lit(seen).cast("long"))
        if seen is not None and late is not None:
            now = now.where(F.col("at_micros").isNull() | (F.col("at_micros") + micros > (seen // 1000 - late) * 1000))
        now.write.mode("overwrite").parquet(f"{at}/last/{number % 2}")

    for schema, path in ((known, "last/1"), (kind, "rows/none")):  # what the first batch finds, if the folder is new
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/{path}")
    events.writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{at}/rows").toDF(*events.columns)


def sessions_ended(events: DataFrame, by: str = "user_id", gap_s: int = 1800, ts: str = "ts", saved: str = "purchase") -> DataFrame:
    """The stream of sessions (by, start, end, last, calls, errors, saved, n0.., paths) that the watermark has passed by the gap: with exact numbers of distinct paths and counts per severity.

    Spark's session windows keep open sessions in the stream's checkpoint and merge them when an event between two of them comes late; the distinct paths of
    an open session are held as a set. `events` must have a watermark on `ts`, and a column `path`.
    """
    _stateful(events.sparkSession)
    kind = F.col("event_type")
    counts = [F.count_if(severity_of(kind) == s).alias(f"n{i}") for i, s in enumerate(SEVERITIES)]
    figures = [F.count(F.lit(1)).alias("calls"), F.count_if(kind == "error").alias("errors"), F.max(F.coalesce(kind == saved, F.lit(False))).alias("saved"), *counts, F.size(F.collect_set("path")).cast("long").alias("paths")]
    out = events.groupBy(by, F.session_window(ts, f"{gap_s} seconds").alias("s")).agg(F.max(ts).alias("last"), *figures)
    return out.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "last", "calls", "errors", "saved", *[f"n{i}" for i in range(len(SEVERITIES))], "paths")


def session_stream(events: DataFrame, by: str = "user_id", gap_s: int = 1800) -> DataFrame:
    """The columns of `sessions`, from a stream, distinct paths exactly."""
    return sessions_ended(events, by, gap_s).select(by, "start", "end", F.col("calls").alias("tools"), "paths", "last")


def closeout_stream(events: DataFrame, by: str = "user_id", gap_s: int = 1800) -> DataFrame:
    """The columns of `closed_out`, from a stream."""
    return _ended(sessions_ended(events, by, gap_s), by)


def scan_stream(files: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stateless scan finds in arriving files."""
    return drained(scan(files), "scan")


def scan_changing(files: DataFrame, rules: Callable[[], Sequence[Rule]], name: str = "scans", at: str | None = None) -> DataFrame:
    """What the rules find in arriving files, with the number of the batch: `rules` is read anew before each batch, so a rule counts from the batch after it was added.

    A batch that is run again replaces its own rows. `at`: a folder that keeps rows and state, see `drained`.
    """
    spark = files.sparkSession
    at = at or folder(spark, name)

    def one(df: DataFrame, number: int) -> None:
        batch(lines(df), rules()).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    files.writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    schema = batch(lines(spark.createDataFrame([], files.schema)), []).schema
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(f"{at}/rows")

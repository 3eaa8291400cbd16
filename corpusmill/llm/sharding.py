"""Sharding by extendible hashing, with DataFrame functions only.

Rows hash to 60 bits. The directory starts with one bucket; a bucket that is over the byte limit and holds more than
one row splits on its next bit, and only such buckets do. As splitting only depends on the bytes below a prefix, the
levels of one directory (`STEP` bits) come from one aggregation over its cells: a row's shard is the shortest prefix
whose bucket fits. Buckets still too large after a directory's bits get a directory of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

BITS = 60
STEP = 12


def hashed(docs: DataFrame, key: list[str], text: str, carry: Sequence[str] = ()) -> DataFrame:
    """The key columns, those in `carry`, `h` (first 60 bits of an MD5 over key and text) and `bytes` of each row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*key, text]]
    h = F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 15), 16, 10).cast("long")
    return docs.select(*key, *carry, h.alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def _directory(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """(cell, depth) for the cells of `STEP` more bits below depth `start`; depth null if the cell's bucket is still too large."""
    end = start + STEP
    cells = rows.groupBy(F.shiftright("h", BITS - end).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    levels = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, cast({end} - depth as int))")
    totals = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where((F.col("bytes") <= limit) | (F.col("n") == 1))
    fits = levels.withColumn("prefix", prefix).select("cell", "depth", "prefix").join(totals.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(fits, "cell", "left")


def sharded(docs: DataFrame, *, key: list[str] | None = None, text: str = "text", limit: int = 16 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """The key columns and those in `carry` with `shard`, `depth`, `page`, `n_bytes` and `oversized`, one row per row of `docs`.

    shard is the hash prefix as a string of bits ("" while one bucket holds all), depth its length, n_bytes the UTF-8
    length of the text (null: 0). Rows that agree in key and text can't be told apart by any bit; where such copies
    exceed the limit, they are dealt over numbered pages of the shard, each within the limit; else page is 0. A row
    that is larger than the limit is alone in its shard and page, with oversized true. An empty table gives an empty one.
    """
    key = key or ["doc_id"]
    todo, done = saved(hashed(docs, key, text, carry), "sizes"), []
    for start in range(0, BITS, STEP):
        cell = F.shiftright("h", BITS - start - STEP)
        dealt = todo.withColumn("cell", cell).join(_directory(todo, start, limit), "cell", "left").drop("cell")
        done.append(dealt.where("depth is not null"))
        left = dealt.where("depth is null").drop("depth")
        if start + STEP < BITS:
            left = saved(left, "sizes")
            if left.isEmpty():
                break
        todo = left
    else:
        done.append(_paged(todo, limit))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    if "page" not in out.columns:
        out = out.withColumn("page", F.lit(0).cast("long"))
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
    return out.select(*key, *carry, F.substring(bits, F.lit(1), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"), F.coalesce("page", F.lit(0)).cast("long").alias("page"), F.col("bytes").alias("n_bytes"), (F.col("bytes") > limit).alias("oversized"))


def _paged(copies: DataFrame, limit: int) -> DataFrame:
    """Rows that share all bits, dealt over pages within the limit. They are numbered within partitions of a saved table, and
    each partition's numbers start after the counts of those before it, so no task holds all copies of a row."""
    fixed = saved(copies.withColumn("part", F.spark_partition_id()), "copies")
    counts = fixed.groupBy("h", "bytes", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("h", "bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = fixed.withColumn("i", F.row_number().over(Window.partitionBy("h", "bytes", "part").orderBy("h")))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    page = F.floor((F.col("first") + F.col("i") - 1) / room)
    return numbered.join(before.drop("n"), ["h", "bytes", "part"]).select(*copies.columns, F.lit(BITS).alias("depth"), page.cast("long").alias("page"))


def write_shards(docs: DataFrame, path: str, *, key: list[str] | None = None, text: str = "text", limit: int = 16 << 20) -> None:
    """Writes every row of `docs` as Parquet, one folder per shard and page. Keys may be null or repeat; columns that `sharded` adds must not be in `docs`."""
    key = key or ["doc_id"]
    out = sharded(docs, key=key, text=text, limit=limit, carry=[c for c in docs.columns if c not in key])
    name = F.concat_ws("-", F.concat(F.lit("s"), "shard"), F.when(F.col("page") > 0, F.col("page").cast("string")))
    out.select(*docs.columns, name.alias("shard_file")).repartition("shard_file").write.partitionBy("shard_file").parquet(path)

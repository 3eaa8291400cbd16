"""What several operators of this package share: tables in the shared folder, and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`. Where that is unset, a temporary one on a single machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _FOLDERS:
        _FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="corpusmill-")
    return _FOLDERS[spark.sparkContext.applicationId]


_FOLDERS: dict[str, str] = {}


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: later steps start from the files, and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes the files of a table that `saved` gave; nothing may read it later."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidied() -> None:
    """Gives back to the system what a Python worker has freed; workers live on after a task and would keep it from the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: list[str]) -> list[Column]:
    """Columns of just these names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: For bytes.translate: A-Z to a-z, other ASCII but digits and letters to a space; bytes of non-ASCII characters stay.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text after lower-casing A-Z, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []

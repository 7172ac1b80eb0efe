"""What the operators of this subpackage share: where to cut lineage, vocabulary files, text batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in pieces of about this many bytes, so that a task's memory doesn't follow its partition.
CHUNK_BYTES = 4 << 20

_LOADED: dict = {}
_TABLES: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOADED.setdefault("local checkpoint folder", tempfile.mkdtemp(prefix="spark-shared-"))
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: it is computed once, and a lost executor loses no part of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[path] = None
    out.shared_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.shared_path)


def clear(spark: SparkSession) -> None:
    """Removes all tables that the operators of this session have left in the shared folder.

    Results are lazy and read them, so this comes after results have been written or are no longer needed.
    """
    for path in list(_TABLES):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _TABLES.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """rows joined with the one row of the table for their key; `count` says how many rows have it.

    Keys with more than `most` rows are broadcast, so that no task gets all rows of one key. The
    caller picks `most` as a share of all rows, which bounds how many such keys there are.
    """
    hot = F.broadcast(table.where(F.col(count) > most).drop(count))
    usual = rows.join(F.broadcast(table.where(F.col(count) > most).select(key)), key, "left_anti").join(table.where(F.col(count) <= most).drop(count), key)
    return usual.unionByName(rows.join(hot, key))


def shipped(spark: SparkSession, path: str):
    """(key, broadcast of the bytes) of a vocabulary file that the driver can read; its size is fixed."""
    with open(path, "rb") as f:
        data = f.read()
    return f"{path}:{len(data)}", spark.sparkContext.broadcast(data)


def loaded(key: str, build):
    """build() once for each Python worker."""
    if key not in _LOADED:
        _LOADED[key] = build()
    return _LOADED[key]


def carried(id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[list[str], list[int]]:
    """Columns to hand to a task (id, text, what else is kept, none twice) and where the kept ones stand among them."""
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    return columns, [columns.index(c) for c in keep]


def crc_of_id(id_col: str):
    """crc32 of the id as text, by which documents are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def chunks(batches, text: int = 1, most: int = CHUNK_BYTES):
    """Record batches cut into runs of rows of about `most` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end

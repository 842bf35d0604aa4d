"""Continuous indexing: a stream of files or rows is upserted into a stored collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.collections import Collection
from ..sources.files import file_text


def documents(files: DataFrame) -> DataFrame:
    """``path, mtime, text`` of streamed or scanned files."""
    return files.select("path", "mtime", file_text(F.col("content")).alias("text"))


def first_version(into: Collection, checkpoint: str) -> int:
    """The version below a query's first one: the collection's newest when the query first began, kept beside its checkpoint."""
    spark, path = into.spark, f"{checkpoint.rstrip('/')}-first-version"
    _, fs = into.store._path(path)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        newest = into._versions().agg(F.max("_version")).first()[0] or 0
        spark.createDataFrame([(int(newest),)], "v long").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()[0]


def ingest(stream: DataFrame, into: Collection, checkpoint: str, order: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True):
    """Start a query that upserts each micro-batch; its newest row of an id, by ``order``, counts.

    checkpoint: a shared folder. A batch that is run again after a failure is written under the same version, so that
    what readers see does not change; a new checkpoint's versions follow all that the collection has. The collection
    must be written by this query alone while it runs. The file source reads a path once for each checkpoint; changed
    files are found by scanning again (``workflow.index_library``) or under a new checkpoint.
    """
    key, before = into.properties["key"], first_version(into, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        rest = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
        into.upsert(newest, before + number + 1)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

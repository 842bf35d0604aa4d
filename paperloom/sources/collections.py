"""Stored collections: append-only versions of rows in Parquet, a fail-soft mirror, and a failure log.

An upsert appends rows under a newer version, so that its cost is that of the new rows; readers keep the newest version
of each id, and ``compact`` writes those alone to another collection.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_WS


class Store:
    """The collections below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        path, fs = self._path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def get_or_create(self, name: str, schema: str, key: str, **properties: str) -> Collection:
        """The collection, made with these columns and properties where there is none; existing properties stay."""
        found = Collection(self, name)
        if name not in self.names():
            self.spark.createDataFrame([], schema + ", _version long").write.parquet(found.data)
            text = json.dumps({"key": key, **properties}, sort_keys=True)
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(found.folder + "/properties")
        return found

    def drop(self, name: str) -> bool:
        """Delete a collection; False where there is none."""
        path, fs = self._path(f"{self.root}/{name}")
        return fs.delete(path, True)


class Collection:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark = store, name, store.spark
        self.folder = f"{store.root}/{name}"
        self.data = self.folder + "/rows"

    @property
    def properties(self) -> dict[str, str]:
        return json.loads(self.spark.read.text(self.folder + "/properties").first()[0])

    def _versions(self) -> DataFrame:
        return self.spark.read.parquet(self.data)

    def read(self) -> DataFrame:
        """The newest version of each row. One id's versions meet in one task; a struct's maximum combines map-side."""
        rows, key = self._versions(), self.properties["key"]
        rest = [c for c in rows.columns if c not in (key, "_version")]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_version").alias("_r"))
        return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def searchable(self, text_col: str = "text") -> DataFrame:
        return self.read().where(F.col(text_col).rlike(NOT_WS))

    def lookup(self, value) -> DataFrame:
        """The row of one id; the filter reaches the Parquet scan."""
        key = self.properties["key"]
        return self._versions().where(F.col(key) == value).orderBy(F.desc("_version")).limit(1).drop("_version")

    def sample(self, n: int = 5) -> DataFrame:
        return self.read().orderBy(self.properties["key"]).limit(n)

    def upsert(self, rows: DataFrame, version: int | None = None) -> None:
        """Append rows, one for each id, as their newest version; writing again under one version changes nothing read."""
        order = self.spark.read.parquet(self.data).drop("_version").columns
        rows.select(*order, F.lit(time.time_ns() if version is None else version).cast("long").alias("_version")).write.mode("append").parquet(self.data)

    def add_missing(self, rows: DataFrame) -> None:
        """Append only rows whose id is not there."""
        key = self.properties["key"]
        self.upsert(rows.join(self._versions().select(key).distinct(), key, "left_anti"))

    def stats(self) -> dict:
        key = self.properties["key"]
        return {"name": self.name, "count": self._versions().select(key).distinct().count(), **self.properties}

    def compact(self, name: str) -> Collection:
        """The newest rows alone, in a new collection."""
        rows = self.read()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        made = self.store.get_or_create(name, schema, **self.properties)
        made.upsert(rows)
        return made

    def backup(self, path: str) -> None:
        self.read().write.parquet(path)


FAILURES = "id string, chunk_ids array<string>, error string, ts long, solved boolean"


class Mirror:
    """Writes to a local collection and, fail-soft, to a second one; failures are recorded and can be tried again."""

    def __init__(self, local: Collection, cloud: Collection | None):
        self.local, self.cloud = local, cloud
        self.failures = local.store.get_or_create(f"{local.name}_failures", FAILURES, "id")

    def _log(self, row: tuple) -> None:
        self.failures.upsert(self.failures.spark.createDataFrame([row], FAILURES))

    def add(self, rows: DataFrame) -> bool:
        """True if the mirror took the rows. The log keeps a batch's ids, so callers write batches of bounded size."""
        version = time.time_ns()
        self.local.upsert(rows, version)
        if self.cloud is None:
            return False
        try:
            self.cloud.upsert(rows, version)
        except Exception as e:  # whatever the second store raises must not lose the first one's rows
            key = self.local.properties["key"]
            ids = [str(r[0]) for r in rows.select(key).collect()]
            self._log((str(version), ids, str(e)[:500], version, False))
            return False
        return True

    def open_failures(self) -> DataFrame:
        return self.failures.read().where(~F.col("solved"))

    def retry(self) -> int:
        """Copy rows of failed batches to the mirror; the number of rows copied."""
        key = self.local.properties["key"]
        asked = self.open_failures().select(F.explode("chunk_ids").alias("_id")).distinct()
        rows = self.local.read().join(asked, F.col(key).cast("string") == F.col("_id"), "left_semi")
        n = rows.count()
        self.cloud.upsert(rows)
        self.clear()
        return n

    def clear(self) -> None:
        self.failures.upsert(self.open_failures().withColumn("solved", F.lit(True)))

    def stats(self) -> dict:
        return self.open_failures().agg(F.count("*").alias("failures"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("failed_chunks"), F.max_by("error", "ts").alias("last_error")).first().asDict()

    def source(self, name: str) -> Collection:
        """Where a query reads: local, cloud where there is one; anything else is local."""
        return self.cloud if name == "cloud" and self.cloud is not None else self.local

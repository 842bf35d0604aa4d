"""Deduplication of records, incremental state, sync bookkeeping, statistics and context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import truncate


def exact_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that occur more than once, with their smallest id and how many ids they have."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")


def best_version(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key: the first by the given order. A row's rank needs its key's rows only."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def to_index(scan: DataFrame, state: DataFrame, path: str = "path", time: str = "mtime") -> DataFrame:
    """Rows of the scan that are new, or newer than the state has recorded."""
    s = state.select(F.col(path).alias("_p"), F.col(time).alias("_t"))
    return scan.join(s, (F.col(path) == F.col("_p")) & (F.col(time) <= F.col("_t")), "left_anti")


def classify(scan: DataFrame, state: DataFrame, path: str = "path") -> DataFrame:
    s = state.select(F.col(path).alias("_p")).distinct()
    return scan.join(s, F.col(path) == F.col("_p"), "left").withColumn("change", F.when(F.col("_p").isNull(), "added").otherwise("updated")).drop("_p")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pack_context(hits: DataFrame, budget: int, limit: int, text_col: str = "text") -> DataFrame:
    """Passages in rank order until their lengths reach the budget; the one that reaches it is kept. Hits are a top-k."""
    cut = hits.withColumn("passage", truncate(F.col(text_col), limit)).where("passage <> ''")
    before = F.sum(F.length("passage")).over(W.partitionBy().orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    kept = cut.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < budget)
    return kept.withColumn("label", F.row_number().over(W.partitionBy().orderBy("rank"))).drop("_b")

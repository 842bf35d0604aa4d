"""Embedding and scoring models as plug-ins, routing between them, and an inverted-file index of vectors.

A model is any object with ``encode(texts) -> matrix``; it is sent to the workers, so it loads what it needs lazily.
The offline models hash terms and count overlaps; they stand in where no model is at hand.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BATCH = 32


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class GroupEmbedder(Protocol):
    def encode_groups(self, groups: list[list[str]]) -> list[np.ndarray]:
        """One matrix for each document, a row for each of its chunks, which see each other."""


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """How well each text (second) answers its query (first)."""


class HashEmbedder:
    """Term counts by hashed bucket, scaled to unit length: equal texts get equal vectors, without a model."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for term in text.lower().split():
                row[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dims] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode_groups(self, groups: list[list[str]]) -> list[np.ndarray]:
        """A chunk's vector leans towards its document's mean."""
        found = [self.encode(g) for g in groups]
        mixed = [0.8 * m + 0.2 * m.mean(axis=0) for m in found]
        return [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in mixed]


class OverlapScorer:
    """Share of a query's distinct terms that the text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            asked = set(query.lower().split())
            out.append(len(asked & set(text.lower().split())) / len(asked) if asked else 0.0)
        return out


def with_retries(fn: Callable, *args, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    """Call a remote model; after a failure wait 1, 2, 4 ... seconds, and give the last failure on."""
    for k in range(attempts):
        try:
            return fn(*args)
        except Exception:  # whatever a remote client raises
            if k + 1 == attempts:
                raise
            sleep(2.0**k)


def choose(makers: dict[str, tuple[str | None, Callable[[], Embedder]]], wanted: str | None = None) -> Embedder:
    """The wanted model, or the first whose key (an environment variable, or None for a local one) is set."""
    if wanted is not None:
        key, make = makers[wanted]
        if key and not os.environ.get(key):
            raise ValueError(f"{wanted} needs {key}")
        return make()
    for key, make in makers.values():
        if not key or os.environ.get(key):
            return make()
    raise ValueError("no model has its key set")


def collection_name(base: str, provider: str) -> str:
    """Vectors of different models never share a collection."""
    return f"{base}_{provider}"


def query_vector(model: Embedder, query: str) -> list[float]:
    """A query's vector; empty where the model fails, so that a search can go on with its keywords."""
    try:
        return with_retries(model.encode, [query], attempts=1)[0].tolist()
    except Exception:
        return []


def _in_batches(model: Embedder, texts: list[str], attempts: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for at in range(0, len(texts), BATCH):
        out += list(with_retries(model.encode, texts[at : at + BATCH], attempts=attempts))
    return out


def embed(text: Column, model: Embedder, attempts: int = 3) -> Column:
    """A column of vectors; a null text has none."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            here = s.notna().to_numpy()
            vectors = iter(_in_batches(model, s[here].tolist(), attempts))
            yield pd.Series([next(vectors).astype(np.float32) if x else None for x in here], index=s.index, dtype=object)

    return run(text)



def routed(text: Column, is_multimodal: Column, text_model: Embedder, other_model: Embedder, attempts: int = 3) -> Column:
    """A column of vectors, each row's by the model of its kind; rows keep their order."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, kind in parts:
            out: list = [None] * len(s)
            for model, flag in ((text_model, False), (other_model, True)):
                at = [i for i, (t, k) in enumerate(zip(s, kind)) if t is not None and bool(k) == flag]
                for i, v in zip(at, _in_batches(model, [s.iloc[i] for i in at], attempts)):
                    out[i] = v.astype(np.float32)
            yield pd.Series(out, index=s.index, dtype=object)

    return run(text, is_multimodal)


def embed_groups(chunks: DataFrame, model: GroupEmbedder, id_col: str = "doc_id", order_col: str = "chunk_index", text_col: str = "text") -> DataFrame:
    """``id_col, order_col, vector``: each document's chunks are embedded together, in order."""
    kinds = dict(chunks.dtypes)

    def run(rows):
        rows = rows.sort_values(order_col)
        (matrix,) = with_retries(model.encode_groups, [rows[text_col].fillna("").tolist()])
        return pd.DataFrame({id_col: rows[id_col], order_col: rows[order_col], "vector": [v.astype(np.float32) for v in matrix]})

    return chunks.select(id_col, order_col, text_col).groupBy(id_col).applyInPandas(run, f"{id_col} {kinds[id_col]}, {order_col} {kinds[order_col]}, vector array<float>")


def rerank(candidates: DataFrame, model: Scorer, k: int = 10) -> DataFrame:
    """The best k of each query's candidates (``query_id, query, doc_id, score, text``) by the model.

    Candidates of a batch on which the model fails keep their order by their own score, behind those that were scored.
    """

    @F.pandas_udf("double")
    def run(query, text):
        try:
            return pd.Series(model.score([(q or "", t or "") for q, t in zip(query, text)]), dtype=float)
        except Exception:
            return pd.Series([None] * len(query), dtype=float)

    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), "doc_id")
    scored = candidates.withColumn("rerank_score", F.nanvl(run("query", "text"), F.lit(None).cast("double")))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("query", "text")


class VectorIndex:
    """Vectors in lists around centres; a search reads the lists nearest to its queries only.

    The centres are fitted on a bounded sample of rows (``sample``, by hash of the id); every vector is in a list.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in rows])

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int = 32, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
        some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()], dtype=float)
        unit = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-12) if len(some) else np.zeros((1, 1))
        centres = unit[np.linspace(0, len(unit) - 1, min(lists, len(unit))).astype(int)]
        for _ in range(12):
            own = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, unit)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)

        @F.pandas_udf("struct<list int, unit array<float>>")
        def place(s):
            m = np.array(s.tolist(), dtype=float)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            return pd.DataFrame({"list": (m @ centres.T).argmax(axis=1).astype(np.int32), "unit": list(m.astype(np.float32))})

        placed = rows.select("doc_id", place("v").alias("p")).select("doc_id", F.col("p.unit").alias("unit"), F.col("p.list").alias("list"))
        # a crowded list is dealt over several files
        placed.repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("list").parquet(f"{folder}/vectors")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        return cls(spark, folder)

    def search(self, queries: list[tuple[int, list[float]]], k: int = 10, probes: int = 12) -> DataFrame:
        """``query_id, doc_id, score, rank`` for a stated, small set of queries, from the ``probes`` nearest lists of each."""
        ids = np.array([i for i, _ in queries])
        m = np.array([v for _, v in queries], dtype=float).reshape(len(queries), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        near = np.argsort(-(m @ self.centres.T), axis=1, kind="stable")[:, :probes] if len(queries) else np.empty((0, 1), int)
        ddl = "query_id long, doc_id long, score double"

        def best(batches):
            for rows in batches:
                lists, unit = rows["list"].to_numpy(), np.array(rows["unit"].tolist(), dtype=float).reshape(len(rows), -1)
                for q in range(len(ids)):
                    own = np.flatnonzero(np.isin(lists, near[q]))
                    if len(own):
                        # a batch's own best k are enough; the rest of the batch can't be among the query's
                        score = np.round((1 + unit[own] @ m[q]) / 2, 6)
                        docs = rows["doc_id"].to_numpy()[own]
                        first = np.lexsort((docs, -score))[:k]
                        yield pd.DataFrame({"query_id": ids[q], "doc_id": docs[first], "score": score[first]})

        stored = self.spark.read.parquet(f"{self.folder}/vectors").where(F.col("list").isin([int(x) for x in np.unique(near)]))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return stored.select("doc_id", "unit", "list").mapInPandas(best, ddl).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

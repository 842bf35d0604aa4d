"""BM25 and dense scoring, rank fusion, blending, metadata boost and reranking over batches of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """``doc_id, score``: BM25-Okapi of every document, zero scores included; ``keep`` filters after corpus statistics.

    Only query terms are ever counted in documents; the corpus's document frequencies, needed for the floor of
    negative weights, are aggregated to one row. A blank query finds nothing. This reads the whole collection; many
    queries over one are served by ``index.KeywordIndex``.
    """
    if not query.strip():
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    words = tokens(F.lit(query))
    base = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"), *([keep.alias("_keep")] if keep is not None else []))
    corpus = base.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = base.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(corpus)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    asked = docs.sparkSession.range(1).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    weight = idf.join(F.broadcast(asked), "term").join(F.broadcast(mean)).select("term", "times", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    kept = base if keep is None else base.where("_keep")
    hits = kept.select("doc_id", F.size("tokens").alias("dl"), F.explode(F.filter("tokens", lambda x: F.array_contains(words, x))).alias("term"))
    tf = hits.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("f"))
    part = F.col("times") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(F.broadcast(weight), "term").join(F.broadcast(corpus)).groupBy("doc_id").agg(F.sum(part).alias("s"))
    return kept.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, doc_id, score``, (1 + cosine) / 2; queries (``query_id, vector``) are a stated, small set."""
    if queries.count() > 10_000:
        raise ValueError("dense scoring takes at most 10000 queries at a time")
    return vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("_v")).join(F.broadcast(queries)).select("query_id", "doc_id", F.round((1 + cosine(F.col("_v"), F.col("vector"))) / 2, 6).alias("score"))


def dense_best(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, doc_id, score, rank``: the best k of each query, by an exact scan.

    A batch of vectors meets all queries in one matrix product and gives on only its own best k of each, so neither a
    row for each pair nor more than k rows of a batch and query are ever shuffled. Null vectors and zero ones have none.
    """
    asked = queries.select("query_id", "vector").limit(10_001).collect()
    if len(asked) > 10_000:
        raise ValueError("dense scoring takes at most 10000 queries at a time")
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[id_col]
    ids = [r["query_id"] for r in asked]
    m = np.array([r["vector"] for r in asked], dtype=float)

    def best(batches):
        import pandas as pd

        # one query's scores at a time: a batch's matrix with all queries could be large
        unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m
        for rows in batches:
            if not len(rows) or not len(unit):
                continue
            v, docs = np.array(rows["v"].tolist(), dtype=float), rows["doc_id"].to_numpy()
            norms = np.linalg.norm(v, axis=1)
            v, docs = v[norms > 0] / norms[norms > 0, None], docs[norms > 0]
            for query, u in zip(ids, unit):
                score = (1 + v @ u) / 2
                first = np.lexsort((docs, -np.round(score, 6)))[:k]
                yield pd.DataFrame({"query_id": query, "doc_id": docs[first], "score": score[first]})

    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & F.col("doc_id").isNotNull())
    found = rows.mapInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double").withColumn("score", F.round("score", 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(df: DataFrame, k: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(F.desc(score), id_col).limit(k)


def ranked(df: DataFrame, k: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """The best k with their ranks: a top-k first, so the window sees k rows only."""
    return top(df, k, score, id_col).withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), id_col)))


def rrf(systems: dict[str, DataFrame], k: int = 10, weights: dict[str, float] | None = None, k_parameter: int = 60, normalize: bool = False) -> DataFrame:
    """Weighted sums of reciprocal ranks over ``doc_id, rank`` frames; a system without a weight has 1."""
    weights = weights or {}
    parts = [df.select("doc_id", (F.lit(float(weights.get(name, 1.0))) / (k_parameter + F.col("rank"))).alias("part")) for name, df in systems.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("doc_id").agg(F.round(F.sum("part"), 9).alias("rrf"))
    if normalize:
        fused = fused.withColumn("rrf", F.round(F.col("rrf") / F.max("rrf").over(W.partitionBy()), 6))
    return top(fused, k, "rrf")


def blend(dense_hits: DataFrame, sparse_hits: DataFrame, alpha: float, k: int = 10) -> DataFrame:
    """alpha * similarity + (1 - alpha) * min-max scaled keyword score, over fetched hits (``doc_id, score``)."""
    w = W.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = sparse_hits.select("doc_id", ((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0) * (1 - alpha)).alias("part"))
    both = dense_hits.select("doc_id", (F.col("score") * alpha).alias("part")).unionByName(scaled)
    return top(both.groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def metadata_boost(hits: DataFrame, query: str, title: str = "title", abstract: str = "abstract", title_boost: float = 2.0, abstract_boost: float = 1.5) -> DataFrame:
    """Scores times the boosts of fields that contain any query term."""
    words = tokens(F.lit(query))
    found = lambda c: F.exists(words, lambda t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t))
    boost = F.when(found(title), title_boost).otherwise(1.0) * F.when(found(abstract), abstract_boost).otherwise(1.0)
    return hits.withColumn("score", F.round(F.col("score") * boost, 6))


def overlap_score(text: Column, query: str) -> Column:
    """Share of the query's distinct terms that a text has: the offline stand-in for a reranking model."""
    words = F.array_distinct(tokens(F.lit(query)))
    return F.round(F.size(F.array_intersect(words, tokens(text))) / F.size(words), 6)


def hash_embedding(docs: DataFrame, dims: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Term counts by hashed bucket, scaled to unit length; ``doc_id, bucket, value``, the offline embedder."""
    bucket = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % dims
    counts = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("c") / norm, 6).alias("value"))

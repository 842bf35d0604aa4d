"""The search API: options with their bounds, hybrid search over batches of queries, reranking and pages of results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOT_WS, tokens
from . import filters, search
from .index import KeywordIndex

MOST_ROWS = 200


@dataclass(frozen=True)
class Options:
    """How to search; ``filters`` and ``text_filter`` are trees or their JSON."""

    top_k: int = 10
    alpha: float = 0.5
    use_rrf: bool = True
    k_parameter: int = 60
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    mode: str = "hybrid"
    text_filter: dict | str | None = None
    filters: dict | str | None = None

    def __post_init__(self):
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")
        for name in ("text_filter", "filters"):
            if isinstance(getattr(self, name), str):
                object.__setattr__(self, name, parsed(getattr(self, name)))


def parsed(text: str) -> dict | None:
    """A filter tree from JSON; blank text is none."""
    if not text.strip():
        return None
    try:
        tree = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"filter is no JSON: {e}") from e
    if not isinstance(tree, dict):
        raise ValueError("a filter is a JSON object")
    return tree


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of rows in order, and ``total_results, offset, limit, returned, has_more``; bounds are enforced."""
    limit, offset = max(1, min(MOST_ROWS, limit)), max(0, offset)
    total = df.count()
    returned = max(0, min(limit, total - offset))
    return df.orderBy(*order).offset(offset).limit(limit), {"total_results": total, "offset": offset, "limit": limit, "returned": returned, "has_more": offset + returned < total}


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class SearchEngine:
    """Documents, their vectors (``vec_id, embedding``) and their keyword index, searched together."""

    def __init__(self, docs: DataFrame, vectors: DataFrame, index: KeywordIndex, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs if id_col == "doc_id" else docs.withColumnRenamed(id_col, "doc_id")
        self.vectors, self.index, self.text_col = vectors, index, text_col

    def _among(self, options: Options) -> DataFrame | None:
        kept: list[Column] = []
        if options.text_filter:
            kept.append(filters.text_filter(options.text_filter, F.col(self.text_col)))
        if options.filters:
            kept.append(filters.metadata_filter(options.filters))
        if not kept:
            return None
        docs = self.docs
        for k in kept:
            docs = docs.where(k)
        return docs.select("doc_id")

    def search(self, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
        """``query_id, doc_id, rank, score`` for queries with ``query_id, query, vector``.

        A blank query finds nothing. Filters hold for both legs, each of which fetches twice as many rows as asked for.
        """
        asked = queries.where(F.col("query").rlike(NOT_WS))
        among, fetch = self._among(options), 2 * options.top_k
        dense = sparse = None
        if options.mode != "sparse":
            vectors = self.vectors if among is None else self.vectors.join(among, F.col("vec_id") == F.col("doc_id"), "left_semi")
            dense = search.dense_best(vectors, asked, fetch)
        if options.mode == "sparse" or options.mode == "hybrid":
            sparse = _ranked(self.index.scores(asked.select("query_id", "query"), among), fetch)
        if sparse is None or dense is None:
            return _ranked((dense if sparse is None else sparse).drop("rank"), options.top_k).select("query_id", "doc_id", "rank", "score")
        if options.use_rrf:
            part = lambda df, w: df.select("query_id", "doc_id", (F.lit(float(w)) / (options.k_parameter + F.col("rank"))).alias("part"))
            both = part(dense, options.dense_weight).unionByName(part(sparse, options.sparse_weight))
        else:
            w = W.partitionBy("query_id")
            low, high = F.min("score").over(w), F.max("score").over(w)
            scaled = sparse.select("query_id", "doc_id", ((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0) * (1 - options.alpha)).alias("part"))
            both = dense.select("query_id", "doc_id", (F.col("score") * options.alpha).alias("part")).unionByName(scaled)
        fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
        return _ranked(fused, options.top_k).select("query_id", "doc_id", "rank", "score")

    def search_reranked(self, queries: DataFrame, options: Options = Options(), score=None, boost: bool = False, title: str = "title", abstract: str = "abstract") -> DataFrame:  # noqa: B008
        """Search wider, score each candidate's text against its query, and keep the best.

        score: (text column, terms column) to a column, the share of terms found where not given; candidates without a
        document score 0. boost: multiply by the boosts of titles and abstracts that contain a query term.
        """
        wide = Options(**{**options.__dict__, "top_k": max(50, 2 * options.top_k)})
        hits = self.search(queries, wide).join(queries.select("query_id", tokens(F.col("query")).alias("_terms")), "query_id")
        docs = self.docs.select("doc_id", F.col(self.text_col).alias("_text"), *([F.col(title).alias("_title"), F.col(abstract).alias("_abstract")] if boost else []))
        rows = docs.join(F.broadcast(hits.drop("score")), "doc_id", "right")
        found = (score or overlap)(F.col("_text"), F.col("_terms"))
        if boost:
            holds = lambda c: F.exists("_terms", lambda t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t))
            found = found * F.when(holds("_title"), 2.0).otherwise(1.0) * F.when(holds("_abstract"), 1.5).otherwise(1.0)
        scored = rows.select("query_id", "doc_id", F.round(F.coalesce(found, F.lit(0.0)), 6).alias("score"))
        return _ranked(scored, options.top_k).select("query_id", "doc_id", "rank", "score")

    def results(self, hits: DataFrame, columns: list[str], excerpt: int = 300) -> DataFrame:
        """Hits with columns of their documents and an excerpt; a hit without a document keeps its row."""
        text = F.col(self.text_col)
        cut = F.when(F.length(text) > excerpt, F.concat(F.substring(text, 1, excerpt), F.lit("..."))).otherwise(text)
        return self.docs.select("doc_id", *columns, cut.alias("excerpt")).join(F.broadcast(hits), "doc_id", "right").select("query_id", "rank", "doc_id", "score", *columns, "excerpt")


def overlap(text: Column, terms: Column) -> Column:
    """Share of distinct query terms that a text has: the offline stand-in for a scoring model."""
    distinct = F.array_distinct(terms)
    return F.size(F.array_intersect(distinct, tokens(text))) / F.size(distinct)


def passage_limit(context: int, k: int) -> int:
    """Characters for each passage of a prompt: a share of the context, from 256 to 1500; 1500 without a context limit."""
    return 1500 if context <= 0 else max(256, min(1500, context // max(1, k)))

"""Indexing a library: scan, extract, keep what is new, leave out duplicates, cut into chunks, embed, store, remember.

The state is a stored collection of file paths; a run that finds nothing new reads the scan and the state only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import NOT_WS, citation_key, item_key, tags
from ..sources.collections import Collection, Store
from . import catalog, chunking, dedup
from .embedding import Embedder, embed

STATE = "path string, mtime timestamp, item_key string, doi string, indexed_at timestamp"
DUPLICATES = "path string, winner string, reason string"
CHUNKS = "chunk_id string, item_key string, chunk_index int, total_chunks int, has_overlap boolean, title string, authors string, year string, doi string, publication string, tags string, path string, text string, vector array<float>"


class State:
    """Which files are indexed, by path and time of change."""

    def __init__(self, store: Store, name: str):
        self.files = store.get_or_create(f"{name}_state", STATE + ", gone boolean", "path")

    def read(self) -> DataFrame:
        return self.files.read().where(~F.coalesce("gone", F.lit(False))).drop("gone")

    def mark(self, rows: DataFrame) -> None:
        self.files.upsert(rows.withColumn("gone", F.lit(False)))

    def remove(self, paths: DataFrame) -> None:
        """Forget files (``path``), so that the next run indexes them again."""
        self.files.upsert(self.read().join(paths.select("path").distinct(), "path", "left_semi").withColumn("gone", F.lit(True)))

    def clear(self) -> None:
        self.files.upsert(self.read().withColumn("gone", F.lit(True)))

    def stats(self) -> dict:
        return self.read().agg(F.count("*").alias("indexed"), F.max("indexed_at").alias("last")).first().asDict()


@dataclass
class Statistics:
    seen: int = 0
    skipped: int = 0
    duplicates: int = 0
    indexed: int = 0
    chunks: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)


def extracted(files: DataFrame, tag_words: dict[str, list[str]] | None = None, native: dict[str, Column] | None = None) -> DataFrame:
    """Records of files (``path, mtime, text``): markdown by its labels, other kinds by their pages' lines."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    md = F.lower(path).endswith(".md")
    by_label, by_line = extract.markdown_fields(text, path), extract.page_fields(text, path, native)
    fields = [F.when(md, by_label[k]).otherwise(by_line[k]).alias(k) for k in by_label]
    rows = files.select("path", "mtime", text.alias("text"), *fields, tags(text, tag_words or {}).cast("array<string>").alias("tags"))
    return rows.withColumns({"item_key": item_key(path), "citation_key": citation_key(F.col("authors"), F.col("year")), "has_fulltext": F.col("text").rlike(NOT_WS)})


def index_library(store: Store, name: str, files: DataFrame, model: Embedder | None = None, *, force: bool = False, limit: int = 512, overlap: int = 100, tag_words: dict[str, list[str]] | None = None, threshold: float = 0.9) -> Statistics:
    """Index files (``path, mtime, text``) that are new or changed into the collection ``name``; what was done.

    A file without text counts as failed and is tried again by the next run. Duplicates among the new files, and copies
    of indexed DOIs, are recorded beside the winner and not indexed. force: take all files as new.
    """
    state, stats = State(store, name), Statistics(seen=files.count())
    chunks = store.get_or_create(name, CHUNKS, "chunk_id")
    fresh = files if force else catalog.to_index(files, state.read())
    records = dedup.saved(extracted(fresh, tag_words))
    stats.skipped = stats.seen - records.count()
    empty = records.where(~F.col("has_fulltext"))
    stats.failed, stats.errors = empty.count(), [r["path"] for r in empty.orderBy("path").limit(10).collect()]
    full = records.where("has_fulltext")
    unique, lost = dedup.deduplicate(full, threshold, "path")
    known = state.read().where("doi IS NOT NULL").select("doi", F.col("path").alias("winner"))
    again = unique.join(known, "doi").where("path <> winner").groupBy("path").agg(F.min("winner").alias("winner")).withColumn("reason", F.lit("doi"))
    again = again if not force else again.limit(0)
    others = dedup.saved(lost.withColumnRenamed("id", "path").select("path", "winner", "reason").unionByName(again.select("path", "winner", "reason")))
    stats.duplicates = others.count()
    if stats.duplicates:
        store.get_or_create(f"{name}_duplicates", DUPLICATES, "path").upsert(others)
    new = dedup.saved(unique.join(again.select("path"), "path", "left_anti"))
    stats.indexed = new.count()
    if stats.indexed:
        columns = {c: F.col(c) for c in ("title", "authors", "abstract", "publication", "year", "keywords", "tags")}
        composed = new.withColumn("content", extract.embedding_text(columns, F.col("text"))).drop("text")
        parts = chunking.document_chunks(composed, ["title", "authors", "year", "doi", "publication", "tags", "path"], limit, overlap, "item_key", "content").withColumnRenamed("doc_id", "item_key")
        vector = embed(F.col("text"), model) if model is not None else F.lit(None).cast("array<float>")
        rows = dedup.saved(parts.withColumns({"authors": F.array_join("authors", ", "), "tags": F.array_join("tags", ", "), "year": F.col("year").cast("string"), "vector": vector}))
        stats.chunks = rows.count()
        chunks.upsert(rows)
    done = new.select("path", "mtime", "item_key", "doi").unionByName(records.join(others, "path", "left_semi").select("path", "mtime", "item_key", F.lit(None).cast("string").alias("doi")))
    # the state comes last: a run that stops before is done again, and writes the same rows
    state.mark(done.withColumn("indexed_at", F.current_timestamp()))
    return stats


def chunk_collection(store: Store, name: str) -> Collection:
    return store.get_or_create(name, CHUNKS, "chunk_id")

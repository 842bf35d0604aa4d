"""Splitting of documents: word windows, paragraphs, sections, markdown headers and greedy packing."""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, nonempty, strip, tokens

SECTIONS = "(?i)abstract|introduction|method|results|discussion|conclusion|references"


def word_windows(docs: DataFrame, size: int = 100, overlap: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_id, chunk_index, has_overlap, text``: windows of words that share ``overlap`` words."""
    words = F.filter(F.split(F.col(text_col), WS + "+"), lambda x: x != "")
    base = docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = base.select("doc_id", "w", F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select("doc_id", F.format_string("%d_%03d", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", (F.col("chunk_index") > 0).alias("has_overlap"), F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """Paragraphs with the last section header before them; headers themselves go, blank ones are skipped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), separator)).alias("pos", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    header = (F.length("text") < 100) & ~F.contains("text", F.lit("\n")) & F.col("text").rlike(SECTIONS)
    carried = rows.withColumn("is_header", header).withColumn("section", F.coalesce(F.last(F.when(header, F.col("text")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos")), F.lit("Introduction")))
    return carried.where(~F.col("is_header")).select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).alias("chunk_num"), "section", "text")


def markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts that begin at headers of levels 1 to 3, with the nearest header as their section."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), r"(?m)(?=^#{1,3} )")).alias("pos", "text")).where(strip(F.col("text")) != "")
    section = F.coalesce(nonempty(F.regexp_extract("text", r"^#{1,3} +([^\n]+)", 1)), F.lit("unknown"))
    return parts.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).alias("chunk_num"), section.alias("section"), strip(F.col("text")).alias("text"))


def count_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def count_words(text: str) -> int:
    return len(text.split())


def tokens_of(words: int) -> int:
    """The token count of so many words; sums of words are exact where sums of token counts would round."""
    return int(words * 1.3)


def pack(parts: list[str], limit: int, joint: str) -> list[str]:
    """Join parts greedily while they fit; a part over the limit stays alone. Joints are white space, so words add up."""
    out: list[str] = []
    held: list[str] = []
    words = 0
    for p in parts:
        n = count_words(p)
        if held and tokens_of(words + n) > limit:
            out.append(joint.join(held))
            held, words = [], 0
        held.append(p)
        words += n
    return out + ([joint.join(held)] if held else [])


def split_recursively(text: str, limit: int, overlap: int = 0, separators=("\n\n", "\n", ". ", " ")) -> list[str]:
    """Split at the coarsest separator that helps, pack what fits, and repeat with finer ones for what doesn't."""
    text = text.strip()
    if not text:
        return []
    if count_tokens(text) <= limit or not separators:
        return [text]
    sep, *finer = separators
    pieces = [y for x in re.split(f"(?<={re.escape(sep)})", text) for y in (split_recursively(x, limit, overlap, finer) if count_tokens(x) > limit else [x.strip()]) if y]
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    words = 0
    joint = sep if sep != ". " else " "
    for p in pieces:
        n = count_words(p)
        if held and tokens_of(words + n) > limit:
            out.append(joint.join(x for x, _ in held))
            # the end of the last chunk, up to the overlap, begins the next one
            while held and (tokens_of(words) > overlap or tokens_of(words + n) > limit):
                words -= held.popleft()[1]
        held.append((p, n))
        words += n
    return out + ([joint.join(x for x, _ in held)] if held else [])


def split_sentences(text: str, limit: int) -> list[str]:
    """Sentences packed greedily; words are packed where a sentence is longer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return pack([y for x in parts for y in (pack(x.split(), limit, " ") if count_tokens(x) > limit else [x])], limit, " ")


def split_paragraphs(text: str, limit: int) -> list[str]:
    """Paragraphs packed greedily with an empty line between; one over the limit is split into sentences."""
    out: list[str] = []
    held: list[str] = []
    for p in (x.strip() for x in text.split("\n\n")):
        if p and count_tokens(p) > limit:
            out += pack(held, limit, "\n\n") + split_sentences(p, limit)
            held = []
        elif p:
            held.append(p)
    return out + pack(held, limit, "\n\n")


def recursive(docs: DataFrame, limit: int = 512, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of at most ``limit`` tokens by the recursive splitter, numbered in their document."""
    return _split_rows(docs, lambda t: split_recursively(t, limit, overlap), id_col, text_col)


def _split_rows(docs: DataFrame, fn, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def split(s):
        return s.map(lambda t: fn(t or ""))

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split(F.col(text_col))).alias("chunk_index", "text"))


def sentences(docs: DataFrame, limit: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences packed greedily to at most ``limit`` tokens; words are packed where a sentence is longer."""
    return _split_rows(docs, lambda t: split_sentences(t, limit), id_col, text_col)


def paragraphs(docs: DataFrame, limit: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs packed greedily to at most ``limit`` tokens, longer ones by sentences."""
    return _split_rows(docs, lambda t: split_paragraphs(t, limit), id_col, text_col)


def sized(chunks: DataFrame, limit: int = 1000) -> DataFrame:
    """Chunks (``doc_id, chunk_num, section, text``) with those over the limit split by paragraphs, numbered anew."""

    @F.pandas_udf("array<string>")
    def split(s):
        return s.map(lambda t: split_paragraphs(t, limit) if count_tokens(t) > limit else [t])

    # only long chunks go through Python
    long = F.size(tokens(F.col("text"))) * 1.3 >= limit + 1
    parts = chunks.where(long).select("doc_id", "chunk_num", "section", F.posexplode(split("text")).alias("part", "text"))
    rows = parts.unionByName(chunks.where(~long).select("doc_id", "chunk_num", "section", F.lit(0).alias("part"), "text"))
    order = W.partitionBy("doc_id").orderBy("chunk_num", "part")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_num"), "section", "text")


def document_chunks(docs: DataFrame, columns: list[str], limit: int = 512, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of each document's text with its columns, ids of three digits or more, and how many chunks it has."""

    @F.pandas_udf("array<string>")
    def split(s):
        return s.map(lambda t: split_recursively(t or "", limit, overlap))

    rows = docs.select(F.col(id_col).alias("doc_id"), *columns, split(F.col(text_col)).alias("_parts"))
    parts = rows.select("doc_id", *columns, F.size("_parts").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "text"))
    return parts.select("doc_id", F.format_string("%s_%03d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks", (F.col("chunk_index") > 0).alias("has_overlap"), *columns, "text")


def image_chunks(docs: DataFrame, columns: list[str], per_document: int = 3, id_col: str = "doc_id", text_col: str = "text", images_col: str = "images") -> DataFrame:
    """The first images (structs of ``page`` from 0, ``uri``) of each document as chunks with the document's short text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *columns, F.col(text_col).alias("text"), F.posexplode(F.slice(images_col, 1, per_document)).alias("chunk_index", "_image"))
    return rows.select("doc_id", F.format_string("%s_mm_%d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", *columns, "text", (F.col("_image.page") + 1).alias("image_page"), F.col("_image.uri").alias("image"), F.lit(True).alias("is_multimodal"))


def all_chunks(text_chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Text and image chunks together; columns that one kind lacks are null."""
    return text_chunks.withColumn("is_multimodal", F.lit(False)).unionByName(images, allowMissingColumns=True)

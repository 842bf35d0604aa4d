"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

A document longer than a sequence is cut into full pieces and one remainder. Pieces fall into length classes (their
length in units of ``GRANULE`` tokens, rounded up). A linear program over patterns (how many pieces of each class one
sequence holds) is solved by column generation: a knapsack dynamic program prices new patterns under the current dual
values. Patterns are rounded down, the few pieces left are placed first-fit by decreasing class, and pieces take the
pattern slots of their class in rank order. Only the class histogram, whose size does not depend on the corpus, and
the plan made from it pass through the driver.

Ranks are made without one task per class: rows are numbered within (class, bucket), and the counts of the buckets
before are added. Nulls: a null text is empty (a document of the end token alone), a null id is kept. Repeated rows
are packed once each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import piece_tokenizer
from .common import arrow_schema, saved, texts, trimmed

LENGTH = 4096
END = 2
GRANULE = 8
#: Rows for each rank bucket, about; a class's window then stays small whatever share of the pieces it has.
BUCKET_ROWS = 20_000
#: Column generation stops when the solution is proven to be within this share of the optimum.
GAP = 2e-3

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Pattern:
    """``copies`` sequences that each hold ``count`` pieces of each class of ``classes``."""

    copies: int
    classes: np.ndarray
    counts: np.ndarray


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (sizes ascending) within the capacity, by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(sizes, c, "right")
        if k:
            v = best[c - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], i
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns) and their real-valued use in a near-optimal solution of the covering linear program."""
    m = len(sizes)
    fit = capacity // sizes
    columns = np.diag(fit.astype(float))
    costs, inverse, use = np.ones(m), np.diag(1 / fit), demand / fit
    for _ in range(40 * m + 100):
        dual = costs @ inverse
        low = int(dual.argmin())
        if dual[low] < -1e-9:  # a surplus column: covering a class more often than asked
            new, cost = np.zeros(m), 0.0
            new[low] = -1
        else:
            value, new = knapsack(sizes, dual, capacity)
            cost = 1.0
            if value <= 1 + gap:  # the optimum is at least the current value / value
                break
        step = inverse @ new
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        take = ratios[out]
        use = use - take * step
        use[out] = take
        np.maximum(use, 0, out=use)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out], costs[out] = new, cost
    real = costs > 0
    return columns[:, real], use[real]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns, with whole numbers of copies, whose slots cover the demand for every class (in units)."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    columns, use = column_generation(sizes, left.astype(float), capacity)
    found: list[Pattern] = []

    def add(counts: np.ndarray, copies: int) -> None:
        at = np.flatnonzero(counts)[::-1]
        found.append(Pattern(copies, sizes[at], counts[at].astype(np.int64)))

    for k in np.argsort(-use, kind="stable"):
        counts = columns[:, k].astype(np.int64)
        held = counts > 0
        copies = min(int(use[k] + 1e-7), int((left[held] // counts[held]).min())) if held.any() else 0
        if copies > 0:
            add(counts, copies)
            left = left - copies * counts
    # what rounding left: one pattern after the other, filled first-fit by decreasing class, repeated while it can be
    while left.any():
        room, counts = capacity, np.zeros(len(sizes), dtype=np.int64)
        for i in np.flatnonzero(left)[::-1]:
            n = min(room // sizes[i], left[i])
            counts[i], room = n, room - n * sizes[i]
        held = counts > 0
        copies = int((left[held] // counts[held]).min())
        add(counts, copies)
        left = left - copies * counts
    return found


@dataclass
class Slots:
    """For a class: rank ranges, and where the pieces of each range go."""

    starts: np.ndarray
    per_copy: np.ndarray
    first_sequence: np.ndarray
    order: np.ndarray


def slots(patterns: list[Pattern]) -> dict[int, Slots]:
    """The plan seen from each class: its ranks fill its slots, pattern by pattern and copy by copy."""
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        for at, (c, n) in enumerate(zip(p.classes.tolist(), p.counts.tolist())):
            parts.setdefault(c, []).append((filled.get(c, 0), n, sequence, at))
            filled[c] = filled.get(c, 0) + n * p.copies
        sequence += p.copies
    return {c: Slots(*(np.array(x, dtype=np.int64) for x in zip(*rows))) for c, rows in parts.items()}


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Tokenise each whole text, append the end token and cut: ``doc_id, start, length, ids_crc32, doc_tokens`` (``, ids``)."""
    ddl = PIECES + ", ids binary" * keep_ids
    last = end.to_bytes(4, "little")

    def run(batches):
        tokenizer, schema = piece_tokenizer(vocabulary), arrow_schema(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += last
                    for k in range(0, len(ids), 4 * length):
                        piece = ids[k : k + 4 * length]
                        rows.append((doc, k // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4) + ((piece,) if keep_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), ddl)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, granule: int = GRANULE, keep_ids: bool = False) -> DataFrame:
    """Pack every document: one row per piece with ``sequence_id`` and ``offset``, gapless from 0 in its sequence.

    vocabulary: path of a tokenizers-library file, present on every node; length: tokens of a sequence;
    granule: tokens of a length class; keep_ids: carry each piece's ids (little-endian unsigned 32-bit) along.
    """
    cut = saved(pieces(docs, vocabulary, id_col=id_col, text_col=text_col, length=length, end=end, keep_ids=keep_ids))
    units = F.ceil(F.col("length") / granule).cast("int")
    histogram = {r["class"]: r["n"] for r in cut.groupBy(units.alias("class")).agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, -(-length // granule)))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    numbered = cut.select("*", units.alias("class"), key.alias("bucket"))
    before = numbered.groupBy("class", "bucket").agg(F.count("*").alias("n")).select(
        "class", "bucket", (F.sum("n").over(W.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before")
    )
    # pieces of one order are alike in all that is returned, so that a task run again gives the same rows
    ranked = numbered.join(before, ["class", "bucket"]).withColumn(
        "rank", F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "start", "length", "ids_crc32")) + F.col("before") - 1
    ).drop("before", "bucket")
    names = ranked.columns
    placed_ddl = ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in ranked.dtypes) + ", sequence_id long, slot long"

    def place(batches):
        schema = arrow_schema(placed_ddl)
        for batch in batches:
            classes, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("class", "rank"))
            sequence, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for c in np.unique(classes):
                own, s = classes == c, table[int(c)]
                r = rank[own]
                k = np.searchsorted(s.starts, r, "right") - 1
                r = r - s.starts[k]
                sequence[own] = s.first_sequence[k] + r // s.per_copy[k]
                slot[own] = s.order[k] * length + r % s.per_copy[k]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, schema)), pa.array(sequence), pa.array(slot)], schema=schema)

    order = W.partitionBy("sequence_id").orderBy("slot")
    return (
        ranked.mapInArrow(trimmed(place), placed_ddl)
        .withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
    )

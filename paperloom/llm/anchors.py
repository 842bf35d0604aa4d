"""Substring deduplication by difference-cover anchors.

A word is removed if a window of ``WINDOW`` consecutive words that covers it also starts anywhere else in the corpus.
Hashing every window would shuffle a row for each word. Instead, runs of ``ANCHOR`` words are hashed only at positions
that, modulo ``PERIOD``, lie in a difference cover: for any two positions i and j some shift below the period puts both
on the cover, so two equal windows share an anchor at the same place in both. Anchors that occur once rule out the
windows around them. The rest is extended: only windows that hold a repeated anchor get a full hash, of 96 bits, and
those that occur twice or more are removed.

Both rounds deal out (hash, document, position) in blobs, one for each batch and hash range, so no row stands for a
word. Hashes that repeat within a batch are settled there and sent on once, so a passage in a third of all documents
does not load one task with a third of the rows. Hash ranges are sorted within a partition and handled one by one.

Nulls: a null text has no words; rows with a null id keep their words and are not compared. Texts shorter than a window
keep all words. A repeated row (same id, same text) counts as elsewhere, like any copy; texts under one id lose what
repeats in any of them. Words are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, dropped, IdFilter, map_whole, partitions, saved, texts, trimmed, unused, window_hashes, word_hashes

WINDOW = 35
#: A perfect difference set: every residue modulo 21 is a difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: An anchor lies wholly in any window that starts up to PERIOD - 1 words before it.
ANCHOR = WINDOW - PERIOD + 1
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Hashes gathered in a worker before they are dealt out.
BATCH = 1 << 19
#: Hash ranges for each partition of the shuffle; memory is needed for one range at a time.
RANGES = 4

DEALT = "route int, settled boolean, hashes binary, docs binary, places binary"
PLACES = "doc_id long, places binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Dealer:
    """Gathers hashes with their places and deals them out by hash range; what repeats within is settled at once."""

    def __init__(self, ranges: int, wide: bool):
        self.ranges, self.wide, self.schema = ranges, wide, arrow_schema(DEALT)
        self.clear()

    def clear(self) -> None:
        self.h: list[np.ndarray] = []
        self.d: list[np.ndarray] = []
        self.p: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> None:
        self.h.append(hashes)
        self.d.append(docs)
        self.p.append(places.astype(np.int32))
        self.n += len(places)

    def deal(self):
        if not self.n:
            return
        h, d, p = np.concatenate(self.h), np.concatenate(self.d), np.concatenate(self.p)
        self.clear()
        order = np.lexsort((h["b"], h["a"])) if self.wide else np.argsort(h)
        h, d, p = h[order], d[order], p[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(first), len(h)))
        many = np.repeat(sizes > 1, sizes)
        rows = []
        # one of each hash goes to its range: alone with its place, or only as a repeated hash, at place -1;
        # in the texts' order, in which documents and places compress well
        back = np.argsort(order[first])
        fh, fd, fp = h[first][back], d[first][back], np.where(many[first], -1, p[first]).astype(np.int32)[back]
        route = (((fh["a"] if self.wide else fh) >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(route, kind="stable")
        fh, fd, fp, cuts = fh[by], fd[by], fp[by], np.searchsorted(route[by], np.arange(self.ranges + 1))
        for r in range(self.ranges):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                rows.append((r, False, fh[a:b].tobytes(), fd[a:b].tobytes(), fp[a:b].tobytes()))
        # the places of repeated hashes are settled; they go on spread by document
        d, p = d[many], p[many]
        if len(d):
            r = (d * 0x9E3779B1 & 0x7FFFFFFF) % self.ranges
            order = np.argsort(r, kind="stable")
            d, p, cuts = d[order], p[order], np.searchsorted(r[order], np.arange(self.ranges + 1))
            rows += [(k, True, b"", d[a:b].tobytes(), p[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


#: 96 bits of a window.
WIDE = np.dtype([("a", np.uint64), ("b", np.uint32)])


BUCKETS = "bucket int, docs binary, places binary"


def repeated_places(dealt: DataFrame, n_parts: int, wide: bool) -> DataFrame:
    """``doc_id, places``: for each document, the places whose hash occurs twice or more, as one int32 blob."""
    kind = WIDE if wide else np.dtype(np.uint64)

    def settle(hashes: list[bytes], docs: list[bytes], places: list[bytes]):
        h, d, p = np.frombuffer(b"".join(hashes), kind), np.frombuffer(b"".join(docs), np.int64), np.frombuffer(b"".join(places), np.int32)
        order = np.lexsort((h["b"], h["a"])) if wide else np.argsort(h)
        h, d, p = h[order], d[order], p[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        # a hash that a batch has settled counts as repeated by itself
        known = np.add.reduceat((p < 0).astype(np.int64), starts) > 0
        keep = np.repeat((sizes > 1) | known, sizes) & (p >= 0)
        return d[keep], p[keep]

    def run(batches):
        at, held, out, n, schema = None, ([], [], []), [], 0, arrow_schema(BUCKETS)

        def flush():
            d, p = (np.concatenate(x) for x in zip(*out))
            bucket = (d * 0x9E3779B1 & 0x7FFFFFFF) % n_parts
            order = np.argsort(bucket, kind="stable")
            d, p, cuts = d[order], p[order], np.searchsorted(bucket[order], np.arange(n_parts + 1))
            rows = [(k, d[a:b].tobytes(), p[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        for batch in batches:
            for route, settled, h, d, p in zip(*(c.to_pylist() for c in batch.columns)):
                if settled:
                    out.append((np.frombuffer(d, np.int64), np.frombuffer(p, np.int32)))
                else:
                    if route != at and held[0]:
                        out.append(settle(*held))
                        held = ([], [], [])
                    at = route
                    for x, y in zip(held, (h, d, p)):
                        x.append(y)
                n += len(p) // 4
                if n > 8 * BATCH and out:
                    yield flush()
                    out, n = [], 0
        if held[0]:
            out.append(settle(*held))
        if out:
            yield flush()

    def gather(batches):
        at, held, schema = None, [], arrow_schema(PLACES)

        def of_bucket():
            d, p = (np.concatenate([np.frombuffer(x, t) for x in col]) for col, t in zip(zip(*held), (np.int64, np.int32)))
            order = np.lexsort((p, d))
            d, p = d[order], p[order]
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array([p[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(d)))], pa.binary())], schema=schema)

        for batch in batches:
            for bucket, d, p in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and held:
                    yield of_bucket()
                    held = []
                at = bucket
                held.append((d, p))
        if held:
            yield of_bucket()

    found = dealt.repartition(n_parts, "route").sortWithinPartitions("route").mapInArrow(trimmed(run), BUCKETS)
    return found.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(gather), PLACES)


def _covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def candidate_windows(n_words: int, anchors: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor; anchors beyond the text are another text's of the same id."""
    anchors = anchors[anchors <= n_words - anchor]
    edge = np.zeros(n_words + 2, np.int64)
    np.add.at(edge, np.maximum(anchors + anchor - window, 0), 1)
    np.add.at(edge, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n_words - window + 1)] > 0)


def repeated_windows(docs: DataFrame, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """``doc_id, places``: starts (int32 blobs, one row for each document) of windows that also start elsewhere.

    docs: ``doc_id, text``. The anchors' length follows from the window's.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    n_parts = partitions(docs)
    ranges = ranges or RANGES * n_parts
    anchor = window - PERIOD + 1

    def first_round(batches):
        dealer, on_cover = Dealer(ranges, False), np.isin(np.arange(PERIOD), COVER)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                h, begins = word_hashes([(t or "").encode() for t in part.column(1).to_pylist()])
                if len(h) < window:
                    continue
                ids = part.column(0).fill_null(0).to_numpy()
                n = np.diff(begins)
                n = np.where(part.column(0).is_valid().to_numpy(zero_copy_only=False), n, 0)[np.repeat(np.arange(len(n)), n)]
                doc = np.repeat(np.arange(len(ids)), np.diff(begins))
                place = np.arange(len(h)) - begins[doc]
                ok = np.flatnonzero(on_cover[place % PERIOD] & (place + anchor <= n) & (n >= window))
                if len(ok):
                    dealer.add(ids[doc[ok]], window_hashes(h, anchor, BASES[0])[ok], place[ok])
                if dealer.n >= BATCH:
                    yield from dealer.deal()
        yield from dealer.deal()

    def second_round(batches):
        dealer = Dealer(ranges, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                h, begins = word_hashes([(t or "").encode() for t in part.column(1).to_pylist()])
                both = np.empty(max(0, len(h) - window + 1), WIDE)
                both["a"], both["b"] = window_hashes(h, window, BASES[0]), window_hashes(h, window, BASES[1]) >> np.uint64(32)
                for i, (doc, blobs) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    starts = candidate_windows(int(begins[i + 1] - begins[i]), np.unique(np.frombuffer(blobs, np.int32)), window, anchor)
                    if len(starts):
                        dealer.add(np.full(len(starts), doc, np.int64), both[begins[i] + starts], starts)
                if dealer.n >= BATCH:
                    yield from dealer.deal()
        yield from dealer.deal()

    anchors = saved(repeated_places(docs.mapInArrow(trimmed(first_round), DEALT), n_parts, False))
    held = IdFilter(anchors).part(docs, "doc_id", True)
    extended = held.join(anchors, "doc_id").select("doc_id", "text", "places").mapInArrow(trimmed(second_round), DEALT)
    found = saved(repeated_places(extended, n_parts, True))
    dropped(anchors)
    return found


def kept_words(text: str | None, blobs: bytes | None, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """The number of a text's words, and those outside the windows that start at the given places."""
    words = words_of(text)
    if not blobs:
        return len(words), words
    places = np.unique(np.frombuffer(blobs, np.int32))
    # another text of the same id may be longer
    covered = _covered(len(words), places[places <= len(words) - window], window)
    return len(words), [w for w, c in zip(words, covered.tolist()) if not c]


def with_places(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", name: str = "_places") -> DataFrame:
    """``docs`` and, in column ``name``, their repeated windows; only rows that may have any take part in the join."""
    some = IdFilter(places)
    (at,) = unused([*docs.columns, name], "_at")
    key = docs.withColumn(at, F.col(id_col).cast("long"))
    hit = some.part(key, at, True).join(places.select(F.col("doc_id").alias(at), F.col("places").alias(name)), at, "left")
    return hit.unionByName(some.part(key, at, False).withColumn(name, F.lit(None).cast("binary"))).drop(at)


def strip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text; a text that loses nothing stays as it is.

    Null texts stay null, rows with a null id stay as they are, an empty table gives one; other columns, whatever
    their names, pass unchanged. Rows that repeat an id are all cut by what was found in any of them.
    """
    (name,) = unused(docs.columns, "_places")
    marked = with_places(docs, repeated_windows(texts(docs, id_col, text_col), window), id_col, name)
    names, at, text = [f"c{i}" for i in range(len(docs.columns))], marked.columns.index(name), marked.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                columns = list(part.columns)
                if columns[at].null_count < part.num_rows:
                    found = zip(columns[text].to_pylist(), columns[at].to_pylist())
                    columns[text] = pa.array([t if t is None or b is None else b" ".join(kept_words(t, b, window)[1]).decode() for t, b in found], columns[text].type)
                del columns[at]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_whole(marked, run, docs)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, ranges: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (``, kept``: the kept words joined by one space) for each row."""
    ddl = RESULT + ", kept string" * with_text
    rows = texts(docs, id_col, text_col)
    marked = with_places(rows, repeated_windows(rows, window, ranges)).select("doc_id", "text", "_places")

    def clean(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                for doc, text, blobs in zip(*(c.to_pylist() for c in part.columns)):
                    n, kept = kept_words(text, blobs, window)
                    joined = b" ".join(kept)
                    out.append((doc, n, n - len(kept), hashlib.sha256(joined).hexdigest()) + ((joined.decode(),) if with_text else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return marked.mapInArrow(trimmed(clean), ddl)

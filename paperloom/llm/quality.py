"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the diagonal of the pooled one. A document's score is the
logistic of the difference of the two Gaussian log densities (Mahalanobis form, by cached Cholesky factors) plus the
log prior. Statistics are rounded to 2^-12 so that sums over labelled rows do not depend on their order. Moments are
summed on the executors; the driver gets one number for each class and pair of statistics.

Nulls: a null text counts as empty; a null id is scored but never labelled. Rows without a label, or with a null one,
are not learnt from. If a label is given twice the larger counts. With no labelled row of a class, all scores are 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, held_out_col, IdFilter, map_rows, saved, texts, trimmed, unused

STEP = 4096.0
SHRINKAGE = 0.1
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
STOPS = b".,;:"
DIGITS = b"0123456789"
#: Names of the statistics, in order.
NAMES = ("log_bytes", "log_word_bytes", "distinct_words", "distinct_pairs", "adjacent_repeats", "top_word", "upper", "symbols", "marks", "stops", "digits", "lines", "duplicate_lines", "compression")


def statistics(text: str | None, compress) -> list[float]:
    """Transformed statistics of one whole text; log and square-root scales bring the classes near to normal."""
    b = (text or "").encode()
    n, words, lines = len(b) + 1, b.split(), b.split(b"\n")
    k = len(words) + 1
    share = lambda chars: math.sqrt((n - 1 - len(b.translate(None, chars))) / n)
    x = (
        math.log(n) / 4,
        math.log(n / k),
        math.log((len(set(words)) + 1) / k),
        math.log((len(set(zip(words, words[1:]))) + 1) / k),
        math.sqrt(sum(map(eq, words, words[1:])) / k),
        math.log((max(Counter(words).values(), default=0) + 1) / k),
        share(UPPER),
        share(SYMBOLS),
        share(MARKS),
        share(STOPS),
        share(DIGITS),
        math.log(len(lines) / k),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log(len(compress(b)) / n),
    )
    return [round(v * STEP) / STEP for v in x]


def compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a hash of the text and the statistics as packed doubles, one row for each row of ``docs``."""
    ddl = "doc_id long, hash long, x binary"

    def rows(ids, found, hashes):
        compress = compressor()
        return {"doc_id": ids, "hash": hashes, "x": [np.array(statistics(t, compress)).tobytes() for t in found]}

    return map_rows(texts(docs, id_col, text_col).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")))), rows, ddl)


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log determinant; and the log prior odds."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 0.5)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -60, 60)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's count, sums and sums of products."""
    if len(moments) < 2:
        return Discriminant([], [], [], 0.0)
    means, covariances, counts = [], [], []
    for c in (0, 1):
        n, s, p = moments[c]
        means.append(s / n)
        covariances.append(p / n - np.outer(s / n, s / n))
        counts.append(n)
    pooled = sum(n * s for n, s in zip(counts, covariances)) / sum(counts)
    target = np.diag(np.diag(pooled) + 1e-4)
    factors, dets = [], []
    for s in covariances:
        low = np.linalg.cholesky((1 - shrinkage) * s + shrinkage * target)
        factors.append(np.linalg.inv(low))
        dets.append(float(np.log(np.diag(low)).sum()))
    return Discriminant(means, factors, dets, math.log(counts[1] / counts[0]))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on the labelled rows outside the held-out fold, with moments summed on the executors."""
    given = (
        labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_col("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    d = len(NAMES)
    ddl = "y int, k int, v double"

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, d), np.asarray(batch.column(1))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        width = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(2), width), pa.int32()), pa.array(np.tile(np.arange(width), 2), pa.int32()), pa.array(total.ravel())], schema=arrow_schema(ddl))

    rows = stats.join(given, "doc_id").select("x", "y").mapInArrow(trimmed(sums), ddl).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["y"], r["k"]] = r["v"]
    return discriminant({c: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for c, t in enumerate(total) if t[0] >= 2}, shrinkage)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, learnt from ``labels``."""
    stats = saved(with_statistics(docs, id_col, text_col))
    model = fit(stats, labels, label_col, shrinkage=shrinkage)

    def rows(ids, packed):
        s = model.scores(np.frombuffer(b"".join(packed)).reshape(-1, len(NAMES)))
        return {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_rows(stats.select("doc_id", "x"), rows, "doc_id long, score double, predicted int").select("doc_id", held_out_col("doc_id").alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least the threshold.

    Statistics are computed once for each text; the rejected texts, by id and digest, are few, and only rows that may
    be among them take part in a join. A null text is judged as an empty one. Rows with a null id are judged in place.
    An empty table gives one; other columns, whatever their names, pass unchanged.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    stats = saved(with_statistics(docs, id_col, text_col))
    model = fit(stats, labels, label_col)

    def rows(ids, hashes, packed):
        low = model.scores(np.frombuffer(b"".join(packed)).reshape(-1, len(NAMES))) < threshold
        return {"doc_id": [i for i, x in zip(ids, low) if x], "hash": [h for h, x in zip(hashes, low) if x]}

    bad = saved(map_rows(stats.where("doc_id is not null").select("doc_id", "hash", "x"), rows, "doc_id long, hash long").distinct())
    some, (at, h) = IdFilter(bad), unused(docs.columns, "_at", "_hash")
    key = docs.withColumn(at, F.col(id_col).cast("long")).withColumn(h, digest)
    judged = some.part(key, at, True).join(bad.select(F.col("doc_id").alias(at), F.col("hash").alias(h)), [at, h], "left_anti")
    clear = some.part(key, at, False)

    @F.pandas_udf("boolean")
    def good(s):
        import pandas as pd

        compress = compressor()
        x = np.array([statistics(t, compress) for t in s]).reshape(-1, len(NAMES))
        return pd.Series(model.scores(x) >= threshold)

    nameless = docs.where(F.col(id_col).isNull()).where(good(F.col(text_col).cast("string")))
    return judged.unionByName(clear.where(F.col(at).isNotNull())).drop(at, h).unionByName(nameless)

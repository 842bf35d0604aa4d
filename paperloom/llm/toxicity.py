"""Toxicity by compression distance: two zstandard dictionaries and the lengths to which they compress a text's windows.

Windows are overlapping runs of ``WINDOW`` consecutive lower-cased words. The ordinary dictionary is trained on the
windows of ordinary texts; its most recurring content stands once more at its end, where references are cheapest. The
toxic dictionary holds the same and, between the two, content trained on windows of toxic texts. A window's saving is
how many bytes shorter the toxic dictionary makes it; windows without a run of bytes that only the toxic content has
are not compressed and save nothing. Toxic texts consist mostly of ordinary words, so the toxic
content is purified: it is trained again, ``ROUNDS`` times, on those windows of the other half of the toxic texts that
the last content saves most on. What recurs in toxic text and not in ordinary text is then what remains.

A document's largest savings, mean saving, numbers and shares of large savings and length go through a logistic fit,
made on labelled documents that the dictionaries were not trained on. The threshold is calibrated on the ordinary ones
among them: a score of 0.5 is what ``FALSE_ALARMS`` of them reach. The fit uses a bounded sample: ``SAMPLE`` documents a class, the first by hash of their ids, of those at
most ``SAMPLE_BYTES`` long. Every document is scored by its whole text.

Nulls: a null text counts as empty; a null id is scored but never labelled. If a label is given twice the larger
counts; if an id has several texts the first in order is learnt from. Without labelled rows of both classes all scores
are 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_col, map_rows, texts

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STEP = 6, 3
SAMPLE = 2000
SAMPLE_BYTES = 1 << 17
# matches of six bytes and more: shorter ones are syllables that all texts share
STRATEGY = "STRATEGY_BTLAZY2"
SEARCH = {"window_log": 21, "hash_log": 19, "chain_log": 20, "search_log": 4, "min_match": 6, "target_length": 48}
#: Bytes of the ordinary dictionary, of its repeated end, and of the toxic content of each half of the toxic texts.
BASE_BYTES, NEAR_BYTES, GUARD_BYTES, TOXIC_BYTES = 1 << 19, 8192, 32768, 4096
ROUNDS = 8
#: Share of the toxic windows, those with the largest savings, that the next round is trained on.
SHARE = 0.08
#: Length of the pieces that training on toxic windows chooses.
PIECES = {"k": 24, "d": 6}
#: Share of ordinary texts that the calibrated threshold, a score of 0.5, lets through.
FALSE_ALARMS = 0.003
#: Bytes from which a saving counts.
LARGE = (3, 4, 5)
#: Windows beyond which a text's counts grow no more, as the logistic fit knows few texts so long.
MOST = 4096
#: Bytes of text looked through at once.
STRETCH = 1 << 21
#: Windows compressed in one call.
CALL = 1 << 16
#: Stands after each window and ends both dictionaries, so that every block is a compressed one and has paid its fixed
#: cost; else a window with a single match would be stored as it is and save nothing.
CARRIER = b" == window of words ==\n"
THRESHOLD = 0.5
#: What ends a zstandard dictionary's header: the three default repeat offsets, 1, 4 and 8.
HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def laid_out(text: str | None, step: int | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words with single spaces before, between and after, and where its windows begin and end, spaces included.

    The last window may have fewer words; a text without words has none.
    """
    words = words_of(text)
    if not words:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    first = np.arange(0, max(1, len(words) - WINDOW + (step or STEP)), step or STEP)
    return b" " + b" ".join(words) + b" ", begins[first], begins[np.minimum(first + WINDOW, len(words))] + 1


def windows(text: str | None, step: int | None = None) -> list[bytes]:
    """A text's windows, each with a space at either end."""
    data, starts, ends = laid_out(text, step)
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def runs(data: bytes) -> np.ndarray:
    """Each run of ``SEARCH["min_match"]`` bytes as a number."""
    n = SEARCH["min_match"]
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for k in range(n):
        out |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
    return out


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content that zstandard's dictionary training chooses; the samples' own end where they are too few."""
    import zstandard

    try:
        found = zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]
    return found[found.index(HEADER_END) + len(HEADER_END) :]


def compressor(*contents: bytes):
    import zstandard

    # the same search for both; by level alone it would depend on the dictionary's size
    how = zstandard.ZstdCompressionParameters(strategy=getattr(zstandard, STRATEGY), write_content_size=False, write_dict_id=False, write_checksum=False, **SEARCH)
    d = zstandard.ZstdCompressionDict(b"".join(contents) + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=d)


def lengths(c, found: list[bytes]) -> np.ndarray:
    """Compressed length of each window, its carrier included."""
    out = []
    for at in range(0, len(found), CALL):
        packed = c.multi_compress_to_buffer([w + CARRIER for w in found[at : at + CALL]])
        out += [len(packed[i]) for i in range(len(packed))]
    return np.array(out, np.int64)


class Pair:
    """The two dictionaries' compressors, and what the toxic one saves.

    Only windows with a run of bytes that the toxic content has and the ordinary dictionary lacks are compressed; the
    dictionaries have the same to offer to the others, whose saving is 0.
    """

    def __init__(self, base: bytes, toxic: bytes, near: bytes):
        self.both = compressor(base, near), compressor(base, toxic, near)
        self.telling = np.setdiff1d(runs(toxic), runs(base + near + CARRIER))
        self.slots = np.zeros(1 << 16, bool)
        self.slots[self._slot(self.telling)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)

    def savings(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes saved on each window ``data[start:end]``."""
        n, before = SEARCH["min_match"], np.zeros(len(data) + 2, np.int32)
        for at in range(0, len(data), STRETCH):
            keys = runs(data[at : at + STRETCH + n - 1])
            hits = np.flatnonzero(self.slots[self._slot(keys)])
            if len(hits):
                place = np.minimum(np.searchsorted(self.telling, keys[hits]), len(self.telling) - 1)
                before[at + 1 + hits[self.telling[place] == keys[hits]]] = 1
        np.cumsum(before, out=before)
        out = np.zeros(len(starts), np.int64)
        some = np.flatnonzero((ends - starts >= n) & (before[np.maximum(ends - n + 1, 0)] > before[starts]))
        for at in range(0, len(some), CALL):
            part = some[at : at + CALL]
            found = [data[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            plain, toxic = (lengths(c, found) for c in self.both)
            out[part] = plain - toxic
        return out

    def of_list(self, found: list[bytes]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, found)])
        return self.savings(b"".join(found), ends[:-1], ends[1:])


def features(savings: np.ndarray) -> list[float]:
    """A document's features from its windows' savings; of a very long text counts are scaled to ``MOST`` windows."""
    n = len(savings)
    if not n:
        return [0.0] * 8
    best, scale = np.sort(savings)[::-1][:3], min(1.0, MOST / n)
    many = [int((savings >= x).sum()) * scale for x in LARGE]
    saved, n = savings.sum() * scale, n * scale
    return [best[0] / 4, best.sum() / 12, 4 * saved / (n + 8), 8 * many[0] / (n + 8), 8 * many[2] / (n + 8), math.log(n) / 4, math.sqrt(many[1]) / 2, math.sqrt(many[2]) / 2]


@dataclass
class Model:
    base: bytes
    toxic: bytes
    near: bytes
    weights: np.ndarray

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.base, self.toxic, self.near, self.weights

    def __setstate__(self, state):
        self.base, self.toxic, self.near, self.weights = state
        self._pair = None

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of a text."""
        if self._pair is None:
            self._pair = Pair(self.base, self.toxic, self.near)
        return self._pair.savings(*laid_out(text))

    def all_features(self, found: Iterable[str | None]) -> np.ndarray:
        return np.array([features(self.savings(t)) for t in found]).reshape(-1, 8)

    def scores(self, found: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(found), 0.5)
        z = self.weights[0] + self.all_features(found) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression with an intercept, by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([0.0] + [ridge * len(x) / 100] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def distinct_windows(group: list[str]) -> list[bytes]:
    """Windows side by side, each once, so that copies of a text count once."""
    return list(dict.fromkeys(w for t in group for w in windows(t, WINDOW)))


def contents(common: list[bytes], halves: list[list[bytes]]) -> tuple[bytes, bytes, bytes]:
    """The ordinary dictionary's base, the toxic content, purified round by round, and the ordinary dictionary's end.

    A round first trains the base also on the ordinary windows that still save by the toxic content, so that what both
    classes share saves no more, then the toxic content anew on the windows of one half that it saves most on.
    """
    base, near = trained(common, BASE_BYTES), trained(common, NEAR_BYTES)
    content = before = trained(halves[0], 4 * TOXIC_BYTES, **PIECES)
    guards: dict[bytes, None] = {}
    guard = b""
    for r in range(1, ROUNDS + 1):
        saved = Pair(base + guard, content, near).of_list(common)
        guards.update((common[i], None) for i in np.flatnonzero(saved >= LARGE[0]))
        if guards:
            guard = trained(list(guards), GUARD_BYTES)
        pool = halves[r % 2]
        saved = Pair(base + guard, content, near).of_list(pool)
        top = np.sort(np.argsort(-saved, kind="stable")[: max(200, int(SHARE * len(pool)))])
        chosen = [pool[i] for i in top if saved[i] >= LARGE[0]]
        if not chosen:
            break
        before, content = content, trained(chosen, TOXIC_BYTES, **PIECES)
    return base + guard, content if before is content else before[-TOXIC_BYTES:] + content, near


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """Train the dictionaries on every other text of each class and the logistic fit on the rest."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", b"", np.array([]))
    model = Model(*contents(distinct_windows(ordinary[::2]), [distinct_windows(toxic[k::4]) for k in (0, 2)]), np.array([]))
    rest = [model.all_features(g) for g in (ordinary[1::2], toxic[1::2])]
    weights = logistic(np.vstack(rest), np.repeat([0.0, 1.0], [len(g) for g in rest]))
    # the threshold is calibrated on ordinary texts, whatever the sample's share of toxic ones
    weights[0] = -np.quantile(rest[0] @ weights[1:], 1 - FALSE_ALARMS)
    model.weights = weights
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents a class, of at most ``sample_bytes`` each, outside the held-out fold."""
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_col("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64(F.lit(7), "doc_id")
    chosen = {r["doc_id"]: r["y"] for c in (0, 1) for r in given.where(F.col("y") == c).orderBy(order, "doc_id").limit(sample).collect()}
    if len(set(chosen.values())) < 2:
        return Model(b"", b"", b"", np.array([]))
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, y int")
    short = texts(docs, id_col, text_col).where(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids), "doc_id")
    rows = sorted((r["doc_id"], r["text"]) for r in short.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    return fit_texts([t for i, t in rows if chosen[i]], [t for i, t in rows if not chosen[i]])


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, learnt from ``labels``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)

    def rows(ids, found):
        s = model.scores(found)
        return {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_rows(texts(docs, id_col, text_col), rows, "doc_id long, score double, predicted int").select("doc_id", held_out_col("doc_id").alias("held_out"), "score", "predicted")

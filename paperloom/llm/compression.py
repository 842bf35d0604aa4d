"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks, with limits by length.

A text that compresses far better than prose of its length is repetitive; one that hardly compresses is noise. Limits
depend on the length because short inputs carry fixed costs. A text is kept if the base rules pass, its whole ratio is
within the band of its length, and few of its chunks are outside the chunk band: at most ``MAX_BAD_CHUNKS`` of them and
never more than ``MAX_BAD_BYTES`` together. Chunks of ``CHUNK`` bytes cover a text; where its length is no multiple of
that, the last chunk ends with the text and overlaps the one before, and a text shorter than a chunk is one chunk,
which its whole band judges. Under 128 bytes stored noise and dense prose compress alike, so bands there have no upper
limit; texts under 16 bytes, too short for ten words, have no band.

Nulls: a null text has no words (and so fails the base rules); a null id is kept. Repeated rows give repeated rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts

#: (from bytes, lowest, highest ratio of compressed to plain bytes), measured on prose in four languages with a margin.
BANDS = ((16, 0.80, math.inf), (32, 0.70, math.inf), (64, 0.50, math.inf), (128, 0.40, 1.05), (256, 0.40, 0.92), (512, 0.40, 0.82), (1024, 0.38, 0.74), (2048, 0.38, 0.68), (4096, 0.36, 0.64), (8192, 0.35, 0.60), (16384, 0.32, 0.58), (65536, 0.28, 0.56))
CHUNK = 2048
CHUNK_BAND = (0.38, 0.68)
MAX_BAD_CHUNKS = 0.2
MAX_BAD_BYTES = 32768
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
LEVEL = 3


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    # windows get exact numbers by pairing: 2 words, then 4, then 5
    width = len(index)
    pair, two = ids[:-1] * width + ids[1:], None
    if width**5 < 2**62:
        key = ids[:n].copy()
        for k in range(1, size):
            key = key * width + ids[k : n + k]
    else:
        two = np.unique(pair, return_inverse=True)[1]
        four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
        key = four[:n] * width + ids[4:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    t = text or ""
    b = t.encode()
    words = b.split()
    joined = b"".join(words)
    chars = len(joined) if len(b) == len(t) else len(joined.decode())
    symbols = sum(map(t.count, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def chunks(b: bytes) -> list[bytes]:
    """The chunks that cover a text: full ones, and a last one that ends with it; the whole text if it is shorter."""
    if len(b) <= CHUNK:
        return [b] if b else []
    found = [b[i : i + CHUNK] for i in range(0, len(b) - CHUNK + 1, CHUNK)]
    return found + [b[-CHUNK:]] * (len(b) % CHUNK > 0)


def band(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio for a length."""
    at = bisect.bisect_right([x[0] for x in BANDS], n_bytes) - 1
    return BANDS[at][1:] if at >= 0 else (0.0, math.inf)


def ratios(b: bytes, compress) -> tuple[float, int, int]:
    """Whole ratio (0 for no bytes), chunks, and chunks outside the band of a chunk's length."""
    if not b:
        return 0.0, 0, 0
    whole, found = len(compress(b)) / len(b), chunks(b)
    low, high = CHUNK_BAND if len(b) >= CHUNK else band(len(b))
    return whole, len(found), sum(not low <= len(compress(x)) / len(x) <= high for x in found) if len(b) > CHUNK else int(not low <= whole <= high)


def in_band(n_bytes: int, whole: float, n_chunks: int, bad: int) -> bool:
    low, high = band(n_bytes)
    return low <= whole <= high and (n_chunks < 2 or bad <= MAX_BAD_CHUNKS * n_chunks and bad * CHUNK <= MAX_BAD_BYTES)


DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, compression figures and verdict for each whole text."""

    def rows(ids, found):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        out = []
        for i, t in zip(ids, found):
            counts = base_counts(t)
            b = (t or "").encode()
            whole, full, bad = ratios(b, compress)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            out.append((i, *counts, failed, not failed and in_band(len(b), whole, full, bad), whole, full, bad))
        return dict(zip((c.split()[0] for c in DDL.split(", ")), zip(*out)))

    return map_rows(texts(docs, id_col, text_col), rows, DDL)

"""Byte-pair encoding with a contiguous rank array, decoding, and a cached tokenizer for packing.

``encode_decode`` gives, per document, the ids and the decoded text of a byte-level BPE vocabulary file. A short
word keeps its part ids and the ranks of adjacent pairs in contiguous arrays: the minimum rank is found by a scan,
one boundary is deleted and the two neighbouring ranks are refreshed. Words over ``LONG`` bytes use a heap over a
linked list, which gives the same merges in n log n.

Nulls: a null text counts as empty; a null id stays null. Empty texts give no ids. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, texts, trimmed

#: Unicode White_Space, as the tokenizers library's pattern engine has it; plain str.split() knows four more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_FOUND = 1 << 40
LONG = 48
#: Entries after which a worker's cache of encoded pieces starts afresh.
CACHE = 400_000
#: The same for the rank array's words and chunks together, about 200 bytes each.
WORD_CACHE = 600_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


#: Settings of a file's model that change no merge.
PLAIN_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def plain_file(spec: dict) -> bool:
    """Whether a file's model is plain BPE and its added tokens are matched as they are, in the text as it is."""
    kept = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")) for t in spec["added_tokens"])
    return kept and spec["model"].get("type") == "BPE" and all(spec["model"].get(k) in (v, False, "") for k, v in PLAIN_MODEL.items())


class RankArrayBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file; files of another kind are refused."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        cut = spec.get("pre_tokenizer") or {}
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not (byte_level and plain_file(spec) and not spec.get("normalizer") and not model.get("end_of_word_suffix")):
            raise ValueError(f"{path} is no plain byte-level vocabulary without a normaliser")
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        byte_of = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode()
            for t, i in {**vocab, **special}.items()
        }
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        s = SPACE
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+").findall
        self.odd_space = regex.compile(rf"[{s}][{s}]|^[{s}]|[{s}]$").search
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        """Contiguous arrays of part ids and of the ranks of adjacent parts; the leftmost minimum merges first."""
        ranks, none = self.ranks, (NOT_FOUND, 0)
        found = [ranks.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best[0] == NOT_FOUND:
                break
            i = found.index(best)
            ids[i] = best[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], none)
            if i < len(found):
                found[i] = ranks.get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for long words: a heap of (rank, position) over a linked list."""
        n, ranks = len(ids), self.ranks
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (r := ranks.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (r[0], i, ids[i], ids[j], r[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word as little-endian unsigned 32-bit integers."""
        found = self.words.get(word)
        if found is None:
            ids = list(map(self.byte_ids.__getitem__, word.encode()))
            ids = self.merge_short(ids) if len(ids) <= LONG else self.merge_long(ids)
            found = np.array(ids, "<u4").tobytes()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            found = b"".join(map(self.word, self.pieces(chunk)))
            if len(chunk) <= 64:
                self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Splitting at single spaces first never cuts a piece in two unless spaces meet or stand at an end."""
        if not text:
            return b""
        if self.odd_space(text):
            return b"".join(map(self.word, self.pieces(text)))
        first, *rest = text.split(" ")
        get, get_slow = self.chunks.get, self._chunk
        return self._chunk(first) + b"".join([get(c) or get_slow(c) for c in [" " + x for x in rest]])

    def encode(self, text: str) -> bytes:
        if len(self.chunks) + len(self.words) > WORD_CACHE:
            self.chunks.clear()
            if len(self.words) > WORD_CACHE // 2:
                self.words.clear()
        if self.split_special and any(x in text for x in self.special):
            return b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.split_special(text))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def rank_array_bpe(path: str) -> RankArrayBPE:
    """One encoder per Python worker and vocabulary."""
    return RankArrayBPE(path)


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    vocabulary: path of a byte-level BPE file, present on every node. Returns ``doc_id, n_tokens, ids`` (little-endian
    unsigned 32-bit) ``, decoded``; with ``digests`` the SHA-256 of ids and of the decoded UTF-8 text instead, so that
    neither leaves the Python worker.
    """
    import hashlib

    ddl = DIGESTS if digests else ENCODED

    def run(batches):
        bpe, schema = rank_array_bpe(vocabulary), arrow_schema(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                decoded = map(bpe.decode, ids)
                if digests:
                    last = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]
                else:
                    last = [ids, list(decoded)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, f.type) for x, f in zip(last, list(schema)[2:]))], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), ddl)


#: Ends a word in ``WordMerges``; no UTF-8 text holds this byte.
WORD_END = b"\xff"


class WordMerges(dict):
    """Chunk -> ids, found once each, by a word-end BPE vocabulary's merges in tiktoken's engine.

    The engine merges by the rank of the joined bytes, the file by the rank of a pair. The two agree where every
    token's merge comes after those of its two parts and every token, encoded alone, gives itself: pairs that cover a
    token's bytes and are not its own merge then never meet. ``of`` checks both and gives None for other files.
    Values are ranks as native unsigned 32-bit integers; ``ids`` maps ranks to the file's ids.
    """

    def __init__(self, ranks: dict[bytes, int], ids: np.ndarray, cut):
        import tiktoken

        super().__init__()
        self.merge = tiktoken.Encoding("words", pat_str="\\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ids, self.cut = ids, cut

    @classmethod
    def of(cls, model: dict, cut) -> WordMerges | None:
        letters, vocab, suffix = byte_letters(), model["vocab"], model.get("end_of_word_suffix")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ends = [c + suffix for c in letters] if suffix else []
        made = {a + b: k for k, (a, b) in enumerate(pairs)}
        # 0xf8 to 0xff never stand in UTF-8 and so need no ids
        if not suffix or len(made) < len(pairs) or not all(x in vocab for x in [*letters[:248], *ends[:248], *made]):
            return None
        if any(max(made.get(a, -1), made.get(b, -1)) >= k for k, (a, b) in enumerate(pairs)):
            return None
        order = {p: k for k, p in enumerate(pairs)}
        for token in made:
            word = token.removesuffix(suffix)
            parts = [*word[:-1], word[-1] + token[len(word) :]]
            while len(parts) > 1:
                k, i = min((order.get(p, NOT_FOUND), i) for i, p in enumerate(zip(parts, parts[1:])))
                if k == NOT_FOUND:
                    return None
                parts[i : i + 2] = ["".join(pairs[k])]
        byte_of = {c: b for b, c in enumerate(letters)}
        ranks, ids = {}, []
        for token in [*letters, *ends[:255], *made]:
            word = token.removesuffix(suffix)
            ranks[bytes(map(byte_of.__getitem__, word)) + WORD_END * (word != token)] = len(ids)
            ids.append(vocab.get(token, 0))
        return cls(ranks, np.array(ids, "<u4"), cut)

    def __missing__(self, chunk: str) -> bytes:
        parts = [chunk] if chunk.isalpha() else self.cut(chunk)
        if len(parts) > 1:
            found = b"".join(map(self.__getitem__, parts))
        else:
            found = array("I", self.merge(chunk.encode() + WORD_END)).tobytes()
        if len(chunk) <= 64:
            self[chunk] = found
        return found


#: The normaliser and the cutting of the files that ``PieceTokenizer`` cuts itself: lower-cased NFC, then contractions,
#: letters, single digits and other characters that are no white space, as bytes.
PIECE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECE_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class PieceTokenizer:
    """Ids of a tokenizers-library file whose pieces never span white space, by cached pieces.

    Chunks between white space are cut into the file's own pre-tokens, lower-cased as its normaliser does; each new
    one is merged once. Texts in which that could differ (control characters that only Python calls white space, or
    characters whose normal form differs) or that hold an added token go to the library whole, and so do all texts where
    the file's normaliser, cutting or model is any other than the one whose results are proven equal.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        by_piece = spec["normalizer"] == PIECE_NORMALIZER and spec["pre_tokenizer"] == PIECE_CUT and plain_file(spec)
        by_piece = by_piece and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the letters below lower-case one by one and are their own normal forms
        self.plain = re.compile("[\\t-\\r -~\\xa1-\\xff]*").fullmatch
        cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+").findall
        self.words = WordMerges.of(spec["model"], cut) if by_piece else None

    def _library(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def encode(self, items: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = self.words
        if words is not None and len(words) > CACHE:
            words.clear()
        out: list[bytes | None] = [None] * len(items)
        whole: list[int] = []
        for i, t in enumerate(items):
            if words is not None and self.plain(t) and not any(x in t for x in self.special):
                ranks = b"".join(map(words.__getitem__, t.lower().split()))
                out[i] = words.ids[np.frombuffer(ranks, np.uint32)].tobytes()
            else:
                whole.append(i)
        if whole:
            for i, x in zip(whole, self._library([items[i] for i in whole])):
                out[i] = x
        return out


@functools.lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)

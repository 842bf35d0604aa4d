"""Deduplication of records: edges by DOI and by title similarity, their components, and the best version of each.

Pairs of similar titles are found block by block: titles of similar length meet, each pair of blocks is one task's work,
and only pairs that the lengths and the common runs of characters allow are compared in full. All bounds are lossless.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalized_title
from ..session import shared_folder

#: Titles of one block, the most slots for the runs of ``RUN`` characters of a title, bits of a block's slots, characters
#: and groups of them that are counted, titles of one side that are compared at once, and the most tasks.
BLOCK, SLOTS, RUN, CELLS, LETTERS, ROWS, TASKS = 32768, 16384, 3, 1 << 26, 32, 512, 2000


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in a shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoint"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: for each id with an edge (``a, b``) the smallest id that it is connected to.

    Each round takes the smallest label among neighbours, then the label's own label, so long chains shorten fast.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        above = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = saved(lower.join(above, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        labels = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def characters(texts: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all titles, and which title each is of."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(texts), dtype=np.int32), n)


def histograms(codes: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each title has each of the most common characters, and those of a few groups that share the others.

    Two titles have at most as many characters in common as the smaller counts sum up to.
    """
    seen = np.bincount(codes)
    place = np.zeros(len(seen), np.int64)
    ranked = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    rank = np.arange(len(ranked))
    own = LETTERS * 3 // 4
    place[ranked] = np.where(rank < own, rank, own + rank % (LETTERS - own))
    return np.bincount(of.astype(np.int64) * LETTERS + place[codes], minlength=len(n) * LETTERS).reshape(-1, LETTERS)


def profiles(codes: np.ndarray, of: np.ndarray, n: np.ndarray, run: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th time that a title has a run of ``run`` characters takes a slot: the slots as bits, and how many slots' worth
    of runs share a slot with another of their title.

    Two titles have at most as many runs in common as slots, and the smaller of what shares a slot.
    """
    bits, ends = np.zeros((len(n), slots // 64), np.uint64), np.concatenate(([0], np.cumsum(n)))
    step = max(1, (1 << 24) // slots)
    for lo in range(0, len(n), step):
        hi = min(len(n), lo + step)
        part, title = codes[ends[lo] : ends[hi]].astype(np.uint64), of[ends[lo] : ends[hi]]
        size = max(0, len(part) - run + 1)
        whole = title[:size] == title[run - 1 :]
        runs = np.zeros(size, np.uint64)
        for k in range(run):
            runs = runs * np.uint64(0x100000001B3) + part[k : size + k]
        # a title and a hash in one number; runs of one hash count as one, which loosens the bound only
        keys = ((title[:size][whole] - lo).astype(np.uint64) << np.uint64(40)) | ((runs[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24))
        if not len(keys):
            continue
        keys.sort()
        place = np.arange(len(keys))
        first = np.where(np.concatenate(([True], keys[1:] != keys[:-1])), place, 0)
        mixed = ((keys & np.uint64((1 << 40) - 1)) * np.uint64(31) + (place - np.maximum.accumulate(first)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        taken = np.zeros((hi - lo) * slots, bool)
        taken[(keys >> np.uint64(40)).astype(np.int64) * slots + (mixed >> np.uint64(40)).astype(np.int64) % slots] = True
        bits[lo:hi] = np.packbits(taken.reshape(hi - lo, slots), axis=1).view(np.uint64)
    return bits, (np.maximum(0, n - run + 1) - np.bitwise_count(bits).sum(axis=1, dtype=np.int32)).astype(np.int32)


def most_blocks(codes: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many matching blocks difflib can find in each title as a second text.

    From 200 characters on it starts blocks only at characters that aren't frequent; the one more is a common beginning.
    """
    most, long = n.astype(np.int32), n[of] >= 200
    if not long.any():
        return most
    keys = (of[long].astype(np.int64) << 21) | codes[long]
    keys.sort()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    title, times = keys[starts] >> 21, np.diff(starts, append=len(keys))
    times[times > n[title] // 100 + 1] = 0
    rare = 1 + np.bincount(title, weights=times, minlength=len(n)).astype(np.int32)
    return np.where(n >= 200, rare, most)


def matched(matcher, least: int) -> int:
    """How many characters difflib matches, or 0 as soon as fewer than ``least`` are certain."""
    parts = [(0, len(matcher.a), 0, len(matcher.b))]
    most = min(len(matcher.a), len(matcher.b))
    while parts and most >= least:
        alo, ahi, blo, bhi = parts.pop()
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        left, right = (min(i - alo, j - blo), min(ahi - i - k, bhi - j - k)) if k else (0, 0)
        most += left + k + right - min(ahi - alo, bhi - blo)
        if left:
            parts.append((alo, i, blo, j))
        if right:
            parts.append((i + k, ahi, j + k, bhi))
    return most if most >= least else 0


def places(title: str) -> dict[str, int]:
    """Where each character of a title is, as bits."""
    found: dict[str, int] = {}
    for k, c in enumerate(title):
        found[c] = found.get(c, 0) | 1 << k
    return found


def in_order(title: str, where: dict[str, int], length: int) -> int:
    """The length of the longest common subsequence with the title of ``places``; difflib never matches more."""
    free = all_of = (1 << length) - 1
    for c in title:
        if at := free & where.get(c, 0):
            free = (free + at) | (free - at)
    return length - (free & all_of).bit_count()


def compared(rows, two: bool, threshold: float, spanning: bool):
    """``a, b, ratio`` of one block's titles, or of two blocks' (``side`` tells which) with one another.

    Lossless bounds come before difflib. The smaller counts of characters bound the M matched ones. Of these, in n blocks,
    at least M - (RUN - 1) n runs are common; n is at most one more than the unmatched characters, and at most
    ``most_blocks``. Slots bound the common runs. At last a longest common subsequence bounds M.
    """
    import difflib

    import pandas as pd

    rows = rows.sort_values("id", ignore_index=True)
    rows["rank"] = np.arange(len(rows))
    rows["n"] = [len(t) for t in rows["t"]]
    rows = rows.sort_values("n", kind="stable", ignore_index=True)
    texts, ids, rank, n = rows["t"].tolist(), rows["id"].to_numpy(), rows["rank"].to_numpy(np.int32), rows["n"].to_numpy(np.int32)
    total = np.arange(2 * n[-1] + 1)
    least = np.ceil(threshold * total / 2).astype(np.int32)
    # as the ratio itself is rounded
    least -= (least > 0) & (2.0 * (least - 1) >= threshold * total - 1e-9)
    codes, of = characters(texts, n)
    # no sum of smaller counts passes a title's length
    kind = np.uint8 if n[-1] < 256 else np.uint16 if n[-1] < 65536 else np.uint32
    counts = histograms(codes, of, n).astype(kind)
    needed = least.astype(kind)
    bits, spare = profiles(codes, of, n, RUN, fold(n[-1]))
    blocks = most_blocks(codes, of, n)
    del codes, of
    side = rows["side"].to_numpy()
    firsts, others = (np.flatnonzero(~side), np.flatnonzero(side)) if two else (np.arange(len(texts)),) * 2
    across, lengths_of = np.ascontiguousarray(counts[others].T), n[others]
    root = np.arange(len(texts))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def common(i, j):
        step = max(1, 500_000 // bits.shape[1])
        parts = [np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int32) for k in range(0, len(i), step)]
        return np.concatenate([*parts, np.empty(0, np.int32)]) + np.minimum(spare[i], spare[j])

    def allowed(own, lo, hi):
        """Pairs of ``own`` and ``others[lo:hi]`` whose smaller counts reach what the ratio needs."""
        smaller, counted = np.zeros((2, len(own), hi - lo), kind)
        for k in range(LETTERS):
            each = counts[own, k]
            np.take(np.minimum(np.arange(each.max() + 1, dtype=kind)[:, None], across[k, lo:hi]), each, axis=0, out=counted, mode="clip")
            smaller += counted
        lengths, at = np.unique(n[own], return_inverse=True)
        np.take(needed[lengths[:, None] + lengths_of[lo:hi]], at, axis=0, out=counted, mode="clip")
        x, y = np.divmod(np.flatnonzero(smaller >= counted), hi - lo)
        return own[x], others[lo:hi][y]

    found, matcher, second, where, prepared = [], difflib.SequenceMatcher(None), None, {}, False
    share = threshold / (2 - threshold) * 0.999999
    for lo in range(0, len(firsts), ROWS):
        own = firsts[lo : lo + ROWS]
        start, end = np.searchsorted(lengths_of, share * n[own[0]], "left"), np.searchsorted(lengths_of, n[own[-1]] / share, "right")
        for at in range(start if two else lo, end, ROWS):
            i, j = allowed(own, at, min(end, at + ROWS))
            if not two:
                i, j = i[kept := i < j], j[kept]
            if spanning and len(i):
                while (root != root[root]).any():
                    root = root[root]
                i, j = i[kept := root[i] != root[j]], j[kept]
            sums = n[i] + n[j]
            need = least[sums]
            runs = need - (RUN - 1) * np.minimum(sums - 2 * need + 1, np.where(rank[i] < rank[j], blocks[j], blocks[i]))
            kept = common(i, j) >= runs
            i, j, need = i[kept], j[kept], need[kept]
            a, b = np.where(rank[i] < rank[j], (i, j), (j, i))
            order = np.argsort(b, kind="stable")
            for a, b, m in zip(a[order].tolist(), b[order].tolist(), need[order].tolist()):
                if spanning and top(a) == top(b):
                    continue
                if second != b:
                    second, where, prepared = b, places(texts[b]), False
                if in_order(texts[a], where, len(texts[b])) < m:
                    continue
                if not prepared:
                    prepared = True
                    matcher.set_seq2(texts[b])
                matcher.set_seq1(texts[a])
                if (ratio := 2.0 * matched(matcher, m) / (len(texts[a]) + len(texts[b]))) >= threshold:
                    found.append((ids[a], ids[b], round(ratio, 6)))
                    if spanning:
                        root[top(a)] = top(b)
    return pd.DataFrame(found, columns=["a", "b", "ratio"])


def fold(length: int) -> int:
    """Slots for titles up to a length; fewer for long ones, as difflib's rule leaves these few blocks and so a wide bound."""
    return min(SLOTS, max(256, 1 << ((16 if length < 256 else 4) * int(length) - 1).bit_length()))


def fuzzy_pairs(titles: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", title_col: str = "title", block: int = BLOCK, spanning: bool = False) -> DataFrame:
    """``a, b, ratio``: pairs of distinct titles at a matching-blocks ratio of at least the threshold.

    The ratio is difflib's with its rule for frequent characters of titles of 200 and more. Equal titles are collapsed
    to their smallest id. With ``spanning`` only as many pairs as connect what all of them connect.
    """
    import math

    one = titles.where(F.length(title_col) > 0).groupBy(F.col(title_col).alias("t")).agg(F.min(id_col).alias("id"))
    kind = dict(one.dtypes)["id"]
    # a ratio r needs lengths within r / (2 - r) of each other; bands of that width meet their neighbours only
    width = -math.log(threshold / (2 - threshold)) * (1 + 1e-9)
    banded = saved(one.select("id", "t", F.floor(F.log(F.length("t").cast("double")) / width).cast("int").alias("band")))
    # blocks of a band are fewer titles where these are long, and four at least where it has many titles
    counts = {r["band"]: (r["n"], r["longest"]) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max(F.length("t")).alias("longest")).collect()}
    dealt = {band: -(-n // max(1, min(block, CELLS // fold(longest), max(4096, n // 4)))) for band, (n, longest) in counts.items()}
    sizes = banded.sparkSession.createDataFrame(sorted(dealt.items()), "band int, blocks int")
    tasks = sum(b * (b + 1) // 2 + b * dealt.get(band + 1, 0) for band, b in dealt.items())
    rows = banded.join(F.broadcast(sizes), "band").withColumn("own", F.pmod(F.xxhash64("t"), "blocks").cast("int"))
    upper = sizes.select((F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    # within a band each pair of blocks meets once, and each block meets each of the next band
    parts = lambda n: F.sequence(F.lit(0), n - 1)
    within = rows.select("band", "id", "t", F.lit(False).alias("high"), F.explode(F.transform(parts(F.col("blocks")), lambda x: F.struct(F.least("own", x).alias("p"), F.greatest("own", x).alias("q")))).alias("at"), "own")
    lower = rows.join(F.broadcast(upper), "band").select("band", "id", "t", F.lit(False).alias("high"), F.explode(F.transform(parts(F.col("above")), lambda x: F.struct(F.col("own").alias("p"), (-1 - x).alias("q")))).alias("at"), "own")
    below = sizes.select((F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    higher = rows.join(F.broadcast(below), "band").select((F.col("band") - 1).alias("band"), "id", "t", F.lit(True).alias("high"), F.explode(F.transform(parts(F.col("under")), lambda x: F.struct(x.alias("p"), (-1 - F.col("own")).alias("q")))).alias("at"), "own")
    meeting = within.unionByName(lower).unionByName(higher)
    flat = meeting.select("band", F.col("at.p").alias("p"), F.col("at.q").alias("q"), "id", "t", F.when(F.col("at.q") < 0, F.col("high")).otherwise(F.col("own") == F.col("at.q")).alias("side"))

    def compare(rows):
        return compared(rows, rows["q"].iloc[0] != rows["p"].iloc[0], threshold, spanning)

    # a count of its own, as tasks are long for their bytes
    return flat.repartition(max(1, min(tasks, TASKS)), "band", "p", "q").groupBy("band", "p", "q").applyInPandas(compare, f"a {kind}, b {kind}, ratio double")


def doi_groups(docs: DataFrame, id_col: str = "doc_id", doi_col: str = "doi") -> DataFrame:
    """``doi, ids, n``: DOIs of more than one document; the ids are in order."""
    given = docs.where(F.col(doi_col).isNotNull() & (F.col(doi_col) != ""))
    return given.groupBy(F.col(doi_col).alias("doi")).agg(F.sort_array(F.collect_list(id_col)).alias("ids"), F.count("*").alias("n")).where("n > 1")


def edges(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", title_col: str = "title", doi_col: str = "doi") -> DataFrame:
    """``a, b, reason``: each document of a DOI or of a title linked to the smallest id with it, and similar
    titles, as many as connect all of them."""
    # read three times below
    rows = saved(docs.select(F.col(id_col).alias("id"), normalized_title(F.coalesce(F.col(title_col), F.lit(""))).alias("title"), F.nullif(F.col(doi_col), F.lit("")).alias("doi")))

    def star(key: str, reason: str) -> DataFrame:
        own = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        first = own.groupBy(key).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
        return own.join(first, key).where("a <> id").select("a", F.col("id").alias("b"), F.lit(reason).alias("reason"))

    similar = fuzzy_pairs(rows, threshold, "id", "title", spanning=True).select("a", "b", F.lit("title").alias("reason"))
    return star("doi", "doi").unionByName(star("title", "title")).unionByName(similar)


def priority(columns: list[str]) -> list:
    """The six criteria, best first, of the columns that are there: published, with a DOI, with full text, newest, longest
    abstract, last changed."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    order = {
        "publication": lambda: F.desc(has("publication")), "doi": lambda: F.desc(has("doi")), "has_fulltext": lambda: F.desc(F.coalesce(F.col("has_fulltext").cast("boolean"), F.lit(False))),
        "year": lambda: F.desc(F.coalesce(F.col("year"), F.lit(0))), "abstract": lambda: F.desc(F.length(F.coalesce("abstract", F.lit("")))), "mtime": lambda: F.desc_nulls_last("mtime"),
    }
    return [make() for c, make in order.items() if c in columns]


def deduplicate(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", title_col: str = "title", doi_col: str = "doi") -> tuple[DataFrame, DataFrame]:
    """The best version of each group of duplicates, documents without any among them; and the others, as
    ``id, winner, reason`` (doi or title: what links it to any other).

    Groups are the components of all links, so they don't depend on the order of rows. The winner is the first by the
    six criteria, then by id. Ids are unique; a null id is no duplicate.
    """
    links = saved(edges(docs, threshold, id_col, title_col, doi_col))
    comp = components(links)
    marked = docs.join(comp.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left").drop("_id")
    order = [*priority(docs.columns), F.asc(id_col)]
    # only the first of each group, which Spark takes in each partition before rows of a group meet
    first = marked.where("comp IS NOT NULL").withColumn("_rn", F.row_number().over(W.partitionBy("comp").orderBy(*order))).where("_rn = 1")
    winners = saved(first.select("comp", F.col(id_col).alias("winner")))
    why = links.select(F.col("a").alias("id"), "reason").unionByName(links.select(F.col("b").alias("id"), "reason")).groupBy("id").agg(F.min("reason").alias("reason"))
    lost = comp.join(winners, "comp").where("id <> winner").join(why, "id").select("id", "winner", "reason")
    unique = docs.join(lost.select(F.col("id").alias("_id")), F.col(id_col) == F.col("_id"), "left_anti")
    return unique, lost


def title_groups(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """``first_id, ids, n``: components of equal or similar normalised titles with more than one document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(title_col).alias("title"), F.lit(None).cast("string").alias("doi"))
    comp = components(edges(rows, threshold))
    return comp.groupBy(F.col("comp").alias("first_id")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))

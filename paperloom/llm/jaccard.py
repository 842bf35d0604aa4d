"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form a class; the join runs over classes. Shingles have one global order, rare ones
first, from a counting sketch of fixed size over all documents. A document puts out the prefix of its ordered set that
any linked document must share a shingle with. Where the sketch promises many candidates, the prefix is longer by
l - 1 shingles, and a pair must then share l of them (the smaller l of the two) before it is verified.

Links are verified exactly, on the texts. A group of n copies is not expanded into n^2 pairs, yet no component misses
a link: first, each group around a shared shingle is split among a few leaders by a 512-bit parity bitmap, and members
are verified against their leader; then, only pairs of different components that share enough prefix shingles, and
whose bitmaps and sizes allow a link, are verified. Groups over ``BLOCK`` members are handled as pairs of blocks.

Nulls: a null or wordless text has an empty set and is linked with nothing; a row with a null id has a null component.
Rows with one id are one document. Ties of the order are broken by the hash; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, dropped, IdFilter, partitions, saved, texts, trimmed, unused, window_hashes, word_hashes

SHINGLE = 4
PERCENT = 85
#: Counters of the sketch: 1 MB, whatever the corpus.
SLOTS, CHUNKS = 1 << 18, 16
#: Sketches that one task adds up.
FAN = 256
BITS = 512
#: Numbers of matches that a document may ask for.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Cost of verifying a candidate, in list entries: at least, and for each shingle.
VERIFY, VERIFY_EACH = 8.0, 0.02
#: Groups that a class looks for leaders in: those of its shared shingles with the smallest hashes.
LEADER_GROUPS = 4
#: Leaders that a member is compared with. This only saves work: the second round looks at all pairs left apart.
LEADERS = 64
#: Longest bitmap for the longest texts, and the sizes of sets from which each doubling twice is used.
LONG = ((800, 2048), (3000, 8192), (16000, 32768))
#: Members of one group that one task compares at a time; members verified against one copy of a leader's text.
BLOCK, STAR = 4096, 256
FLUSH = 1 << 19
RANGES = 4
BASE = 0xC2B2AE3D27D4EB4F
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(found: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of its whole sequence if it is shorter than one."""
    h, begins = word_hashes([(t or "").encode().translate(UPPER) for t in found])
    whole, out = window_hashes(h, size, BASE + 2 * size), []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        n = b - a
        s = np.sort(whole[a : b - size + 1] if n >= size else window_hashes(h[a:b], max(n, 1), BASE + 2 * n))
        if len(s) > 1:
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        out.append(s)
    return out


def bitmap(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """Parity of the number of shingles at each position: two bitmaps differ in at most as many bits as the sets do."""
    return np.packbits((np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def long_bitmap(shingles: np.ndarray) -> bytes | None:
    """A bitmap in proportion to a large set; small sets have none besides the short one."""
    bits = max((b for n, b in LONG if len(shingles) > n), default=0)
    return bitmap(shingles, bits) if bits else None


def folded(data: bytes, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: positions modulo a divisor are the exclusive or of the parts."""
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint64).reshape(-1, size // 8), axis=0)


def long_link(n_a: int, a: bytes, n_b: int, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two sizes and bitmaps of any lengths allow a link."""
    size = min(len(a), len(b))
    return bool(may_link(np.array(n_a), folded(a, size), n_b, folded(b, size), percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(n: np.ndarray, maps: np.ndarray, n0, map0, percent: int = PERCENT) -> np.ndarray:
    """Whether sizes and bitmaps allow a link; never false for linked sets."""
    differ = np.bitwise_count(maps ^ map0).sum(axis=-1).astype(np.int64)
    total = n + n0
    return (100 * np.minimum(n, n0) >= percent * np.maximum(n, n0)) & (100 * (total - differ) >= percent * (total + differ))


SIGNATURES = "chunk int, doc_id long, d1 long, d2 long, n int, data binary, long binary"


def signatures(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each document its set's digest, size and bitmap; and each task's counting sketch, by task in ``doc_id`` (rows with a ``chunk``)."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        schema, counts = arrow_schema(SIGNATURES), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                sets = shingle_sets(part.column(1).to_pylist(), size)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                for doc, s in zip(part.column(0).to_pylist(), sets):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    out.append((None, doc, *d, len(s), bitmap(s), long_bitmap(s)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if counts.any():
            out = [(k, task, None, None, None, part.tobytes(), None) for k, part in enumerate(np.split(counts, CHUNKS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(trimmed(run), SIGNATURES)


def sketch(signed: DataFrame, fan: int = FAN) -> np.ndarray:
    """Sum the tasks' sketches, chunk by chunk and in a tree of ``fan`` at a time; the driver gets ``SLOTS`` counters."""
    ddl, width = "chunk int, task long, data binary", SLOTS // CHUNKS

    def total(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, task, data in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(data, np.uint32 if len(data) == 4 * width else np.uint64).astype(np.uint64)
                sums[k, task] = sums.get((k, task), 0) + counts
        columns = ([k for k, _ in sums], [t for _, t in sums], [x.tobytes() for x in sums.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(ddl))], schema=arrow_schema(ddl))

    rows, groups = signed.where("chunk is not null").select("chunk", F.col("doc_id").alias("task"), "data"), signed.rdd.getNumPartitions()
    while True:
        groups = max(1, -(-groups // fan))
        rows = rows.withColumn("task", F.pmod("task", F.lit(groups))).repartition(CHUNKS * groups, "chunk", "task").mapInArrow(trimmed(total), ddl)
        if groups == 1:
            break
    out = np.zeros((CHUNKS, width), np.uint64)
    for r in rows.collect():
        out[r["chunk"]] = np.frombuffer(r["data"], np.uint64)
    return out.ravel()


class Order:
    """The global order of shingles, rare ones first, and the cost of matching each, from the summed sketch."""

    def __init__(self, counts: np.ndarray):
        used = counts[counts > 0]
        self.rank = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint64) << np.uint64(57)
        self.cost = np.maximum(counts - (float(np.median(used)) if len(used) else 0.0), 0) + 1

    def prefix(self, s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of a set's adaptive prefix and, for each, the least number of matches whose prefix has it."""
        n = len(s)
        slot = (s >> np.uint64(46)).astype(np.int64)
        order = np.argsort(self.rank[slot] | (s & np.uint64((1 << 57) - 1)))
        need = -(-percent * n // 100)
        first = n - need + 1
        most = min(MATCHES[-1], need)
        sums = np.cumsum(self.cost[slot[order[: first + most - 1]]])
        verify = max(VERIFY, VERIFY_EACH * n)
        best = min((m for m in MATCHES if m <= most), key=lambda m: sums[first + m - 2] * (1 + verify / m**2))
        level = np.ones(first + best - 1, np.uint8)
        level[first:] = np.arange(2, best + 1)
        return s[order[: first + best - 1]], level


DEALT = "route int, tokens binary, docs binary, levels binary, needs binary"
ENTRIES = "token long, rep long, level int, matches int, k int"


def entries(rows: DataFrame, counts: np.ndarray, size: int, percent: int, n_parts: int) -> DataFrame:
    """Prefix entries of shingles that two or more documents put out, and how many do; equal sets within a batch count once."""
    ranges = RANGES * n_parts
    order_of = Order(counts)

    def deal(tokens, docs, levels, needs, schema):
        t, d, v, m = (np.concatenate(x) for x in (tokens, docs, levels, needs))
        route = (((t * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(route, kind="stable")
        t, d, v, m = t[order], d[order], v[order], m[order]
        cuts = np.searchsorted(route[order], np.arange(ranges + 1))
        out = [(k, t[a:b].tobytes(), d[a:b].tobytes(), v[a:b].tobytes(), m[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def put_out(batches):
        schema = arrow_schema(DEALT)
        tokens, docs, levels, needs, n, seen = [], [], [], [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), size)):
                    if doc is None or not len(s):
                        continue
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key in seen:
                        continue
                    seen.add(key)
                    t, level = order_of.prefix(s, percent)
                    tokens.append(t)
                    docs.append(np.full(len(t), doc, np.int64))
                    levels.append(level)
                    needs.append(np.full(len(t), level[-1], np.uint8))
                    n += len(t)
                    if n >= FLUSH:
                        yield deal(tokens, docs, levels, needs, schema)
                        tokens, docs, levels, needs, n, seen = [], [], [], [], 0, set()
        if n:
            yield deal(tokens, docs, levels, needs, schema)

    def shared(t, d, v, m, schema):
        t, d, v, m = (np.frombuffer(b"".join(x), k) for x, k in zip((t, d, v, m), (np.uint64, np.int64, np.uint8, np.uint8)))
        order = np.argsort(t, kind="stable")
        t, d, v, m = t[order], d[order], v[order], m[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.append(starts, len(t)))
        keep = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(d[keep]), pa.array(v[keep].astype(np.int32)), pa.array(m[keep].astype(np.int32)), pa.array(np.repeat(sizes, sizes)[keep].astype(np.int32))], schema=schema)

    def meet(batches):
        at, held, schema = None, ([], [], [], []), arrow_schema(ENTRIES)
        for batch in batches:
            for route, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if route != at and held[0]:
                    yield shared(*held, schema)
                    held = ([], [], [], [])
                at = route
                for x, y in zip(held, blobs):
                    x.append(y)
        if held[0]:
            yield shared(*held, schema)

    return rows.mapInArrow(trimmed(put_out), DEALT).repartition(n_parts, "route").sortWithinPartitions("route").mapInArrow(trimmed(meet), ENTRIES)


PAIRS = "a long, b long"
HITS = "a long, b long, needed int, hit int"


def _groups(batches, keys: int):
    """Runs of equal leading columns, as lists of numpy columns; rows come sorted by them."""
    held, at = [], None
    for batch in batches:
        cols = [np.asarray(c) if not pa.types.is_binary(c.type) else np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows)):
            key = tuple(c[s] for c in cols[:keys])
            if key != at and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            at = key
            held.append([c[s:e] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def leader_pairs(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (leader, member) that may link, in each block of a group; rows are token, own, rep, n, data, sorted."""

    def run(batches):
        schema, seen, at, leads = arrow_schema(PAIRS), set(), None, []
        for batch in batches:
            for token, own, rep, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, own) != at:
                    at, leads = (token, own), []
                # each member goes to the first leader that it may link with, or leads itself
                for lead, n0, data0 in leads[:LEADERS]:
                    if long_link(n, data, n0, data0, percent):
                        seen.add((lead, rep))
                        break
                else:
                    leads.append((rep, n, data))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], schema=schema)
                seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], schema=schema)

    return grouped.mapInArrow(trimmed(run), PAIRS).distinct()


def crossing_pairs(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may link and share enough prefix shingles."""

    def run(batches):
        schema, held, size = arrow_schema(HITS), [], 0

        def total():
            a, b, needed, hit = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((b, a))
            a, b, needed, hit = a[order], b[order], needed[order], hit[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return a[at], b[at], needed[at], np.add.reduceat(hit, at)

        def batch_of(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for _, low, high, own, rep, n, level, matches, comp, maps in _groups(batches, 3):
            if (comp == comp[0]).all():
                continue
            n = n.astype(np.int64)
            order = np.argsort(comp, kind="stable")
            own, rep, n, level, matches, comp, maps = (x[order] for x in (own, rep, n, level, matches, comp, maps))
            ends = np.searchsorted(comp, comp, "right")
            for i in range(int(np.searchsorted(comp, comp[-1]))):  # all but the last component
                rest = slice(ends[i], len(rep))
                ok = may_link(n[rest], maps[rest], n[i], maps[i], percent)
                if low[0] != high[0]:
                    ok &= own[rest] != own[i]
                at = np.flatnonzero(ok) + ends[i]
                needed = np.minimum(matches[at], matches[i])
                at, needed = at[np.maximum(level[at], level[i]) <= needed], needed[np.maximum(level[at], level[i]) <= needed]
                if len(at):
                    held.append((np.minimum(rep[at], rep[i]), np.maximum(rep[at], rep[i]), needed.astype(np.int32), np.ones(len(at), np.int32)))
                    size += len(at)
            if size > FLUSH:
                held = [total()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield batch_of(held[0])
                    held, size = [], 0
        if held:
            yield batch_of(total())

    found = grouped.mapInArrow(trimmed(run), HITS)
    return found.groupBy("a", "b").agg(F.max("needed").alias("needed"), F.sum("hit").alias("hits")).where("hits >= needed").select("a", "b")


def long_filter(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs that bitmaps in proportion to the sets allow."""

    def run(batches):
        schema = arrow_schema(PAIRS)
        for batch in batches:
            out = [(a, b) for a, b, n, data, m, other in zip(*(c.to_pylist() for c in batch.columns)) if long_link(n, data, m, other, percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    side = lambda x: maps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("data").alias(f"data{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "dataa", "nb", "datab").mapInArrow(trimmed(run), PAIRS)


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int, n_parts: int) -> DataFrame:
    """The pairs (a, b) that are linked. Each a's text goes once to every ``STAR`` of its partners, theirs follow."""
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    rows = IdFilter(ids).part(rows, "doc_id", True).join(ids, "doc_id").dropDuplicates(["doc_id"])
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = dealt.join(rows.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    leads = dealt.select("a", "part").distinct().join(rows.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        schema, at, lead = arrow_schema(PAIRS), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                *keys, found = (c.to_pylist() for c in batch.slice(start, 64).columns)
                for a, part, b, s in zip(*keys, shingle_sets(found, size)):
                    if b is None:
                        at, lead = (a, part), s
                    elif (a, part) == at and linked(lead, s, percent):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    stars = leads.unionByName(members).repartition(n_parts, "a", "part")
    return stars.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(trimmed(run), PAIRS)


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id reachable, for each id with an edge, by label propagation with pointer jumping."""
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    last = labels
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = saved(step.join(up, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        done = new.where("old <> comp").isEmpty()
        dropped(last)
        if done:
            dropped(both)
            return new.select("id", "comp")
        labels, last = new.select("id", "comp"), new


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; two documents link at ``percent`` of Jaccard similarity or more."""
    rows = texts(docs, id_col, text_col)
    n_parts = partitions(docs)
    signed = saved(signatures(rows, size))
    counts = sketch(signed)
    own = signed.where("chunk is null").select("doc_id", "d1", "d2", "n", "data", "long")
    filled = own.where("n > 0 and doc_id is not null")
    classes = saved(filled.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "data", "long")).alias("x")).select("d1", "d2", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.data").alias("data"), F.col("x.long").alias("long")))
    class_of = saved(filled.select("doc_id", "d1", "d2").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep"))
    # copies of a class mostly stay out; what those that the filter lets through put out is their class's, once
    own_set = IdFilter(classes.select(F.col("rep").alias("doc_id")))
    shared = saved(entries(own_set.part(rows, "doc_id", True), counts, size, percent, n_parts))
    slipped = saved(own_set.part(class_of, "doc_id", True).groupBy("doc_id").agg(F.max("rep").alias("of")).where("of < doc_id"))
    if not slipped.isEmpty():
        named = shared.join(slipped, F.col("rep") == F.col("doc_id"), "left").withColumn("rep", F.coalesce("of", "rep"))
        shared = saved(named.select("token", "rep", "level", "matches", "k").dropDuplicates(["token", "rep"]))
    reps = classes.select("rep", "n", "data", "long").dropDuplicates(["rep"])
    blocks = F.ceil(F.col("k") / block)
    split = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))

    best = F.coalesce("long", "data").alias("data")
    few = split.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("token", "own"))), 1, LEADER_GROUPS).alias("x")).select("rep", F.inline("x"))
    near = leader_pairs(few.join(reps.select("rep", "n", best), "rep").select("token", "own", "rep", "n", "data").repartition(n_parts, "token", "own").sortWithinPartitions("token", "own", "rep"), percent)
    links = saved(verified(saved(near), rows, size, percent, n_parts))
    first = components(links)

    labelled = reps.select("rep", "n", "data").join(first, F.col("rep") == F.col("id"), "left").select("rep", "n", "data", F.coalesce("comp", "rep").alias("comp"))
    comp = split.join(labelled, "rep")
    # a group of several blocks is only replicated if it has more than one component
    large = comp.where("blocks > 1")
    mixed = large.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "n", "level", "matches", "comp", "data")
    paired = comp.where("blocks = 1").withColumn("other", F.lit(0).cast("long")).select(*columns)
    if not large.isEmpty():
        paired = paired.unionByName(large.join(mixed, "token", "left_semi").withColumn("other", other).select(*columns))
    crossing = crossing_pairs(paired.repartition(n_parts, "token", "low", "high").sortWithinPartitions("token", "low", "high"), percent)
    crossing = saved(long_filter(saved(crossing), reps.select("rep", "n", best), percent))
    final = first
    more = saved(verified(crossing, rows, size, percent, n_parts))
    if not more.isEmpty():
        label = lambda side: first.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
        bridges = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        second = components(bridges).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        merged = first.join(second, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
        alone = second.select(F.col("comp").alias("id"), F.col("top").alias("comp")).join(first.select("id"), "id", "left_anti")
        final = saved(merged.unionByName(alone))
    # a class has its smallest id's label
    member = class_of.join(final, class_of["rep"] == final["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("component_id"))
    return own.join(member, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, once each; rows with a null id stay.

    Of rows that repeat such an id, the one with the smallest text stays, and of equal texts the one whose row is first
    as JSON. Null and wordless texts are linked with nothing and stay; an empty table gives one; other columns, whatever
    their names, pass unchanged.
    """
    found = saved(join_components(docs, id_col=id_col, text_col=text_col, size=size, percent=percent))
    stay = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    (name, row) = unused(docs.columns, "_stay", "_row")
    key, ids = F.col(id_col).cast("long"), stay.select(F.col("doc_id").alias(name), "copies")

    def kept(some: DataFrame) -> DataFrame:
        return docs.join(some.select(name), key == F.col(name), "left_semi")

    out = kept(ids.where("copies = 1")).unionByName(docs.where(key.isNull()))
    many = ids.where("copies > 1")
    if not many.isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        first = kept(many).groupBy(key.alias(name)).agg(F.min_by(whole, F.struct(F.col(text_col).cast("string"), F.to_json(whole))).alias(row))
        out = out.unionByName(first.select(f"{row}.*"))
    return out

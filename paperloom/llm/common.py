"""Shared pieces of the text operators: Arrow mapping, hashing and scratch space."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}
#: Texts handled at once in Python; bounds what one batch holds beside the Arrow data itself.
SLICE = 512


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name type, ...`` with the types of ``ARROW``."""
    return pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def trimmed(run):
    """A mapper that gives freed memory back when its task ends; workers live on, and would else keep their peak."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


#: Rows of a batch between Spark and Python, at most. Rows hold whole texts, so Spark's 10,000 would be tens of MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_whole(df: DataFrame, run, like: DataFrame) -> DataFrame:
    """``df`` mapped by Arrow batches to the columns of ``like``; names, which may hold dots, play no part in between."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(like.schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(trimmed(run), plain).toDF(*like.columns)


def with_text(df: DataFrame, text_col: str, fn: Callable[[list], list]) -> DataFrame:
    """``df`` with its string column changed by ``fn`` over slices of it; the other columns pass as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                columns = list(part.columns)
                columns[at] = pa.array(fn(columns[at].to_pylist()), columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    small_batches(df.sparkSession)
    return map_whole(df, run, df)


def map_rows(df: DataFrame, fn: Callable[..., dict | None], ddl: str) -> DataFrame:
    """Map slices of rows: ``fn(*columns as lists)`` gives output columns as a dict of lists or arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = fn(*(c.to_pylist() for c in part.columns))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(trimmed(run), ddl)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``doc_id`` and ``text`` of any table; other columns, whatever their names, play no part."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_scratch(spark: SparkSession) -> None:
    """checkpoint() needs a shared folder: the session's spark.checkpoint.dir; a temporary one only on a local master."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))


_SCOPES: list[list[DataFrame]] = []


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives lost executors."""
    shared_scratch(df.sparkSession)
    made = df.checkpoint()
    for scope in _SCOPES:
        scope.append(made)
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared scratch space."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Delete checkpoints that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


@contextlib.contextmanager
def scratch():
    """A scope whose checkpoints are deleted at its end, when what was made of them has been written."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        dropped(*made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared scratch space."""
    import uuid

    shared_scratch(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Bytes of input, as stored, for each partition of an operator's own shuffle, at most.
PARTITION_BYTES = 128 << 20


def partitions(df: DataFrame) -> int:
    """Partitions for an operator's shuffles of what it makes of ``df``: the session's, or more where the input is large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a leaf of no known size, such as a local table's, says so with the largest number
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x for x in sizes if x < 1 << 60) // PARTITION_BYTES)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def is_held_out(doc_id: int | None) -> bool:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text."""
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def held_out_col(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(0)) % 5 == 0


_MASK = 0xFFFFFFFFFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), with wrapping arithmetic."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = mix64(np.arange(1, 8 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's words begin in them (one more entry at the end).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A byte's contribution is drawn from a table by its value
    and place modulo 8, times a power for each 8 bytes before it; lengths are mixed in.
    """
    b = np.frombuffer(b"\n".join([*found, b""]), np.uint8)
    inside = np.flatnonzero(~_SPACE[b])
    if not len(inside):
        return np.empty(0, np.uint64), np.zeros(len(found) + 1, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(inside)))
    at = np.arange(len(inside)) - np.repeat(starts, lengths)
    powers = np.full((int(lengths.max()) >> 3) + 1, 0xD1342543DE82EF95, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    with np.errstate(over="ignore"):
        value = _TABLE[(at & 7) << 8 | b[inside]]
        if len(powers) > 1:
            value = value * powers[at >> 3]
        h = mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    ends = np.cumsum([0] + [len(t) + 1 for t in found])
    return h, np.searchsorted(inside[starts], ends)


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """64-bit polynomial hash of each run of ``size`` consecutive values of ``h`` (wrapping, odd ``base``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        if size <= 8:
            for k in range(size):
                out = out * b + h[k : k + n]
        else:
            inverse = np.uint64(pow(base | 1, -1, 1 << 64))
            power = np.full(len(h), b, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * power)])
            back = np.full(n, inverse, np.uint64)
            back[0] = 1
            out = (sums[size:] - sums[:n]) * np.multiply.accumulate(back)
        return mix64(out)


#: Bits of an id filter, at most: a million words of 64 bits. Beyond that it lets more through, and a join does the rest.
FILTER_BITS = 67_108_859


def _prime(n: int) -> int:
    """The first prime from n on, n being over 2."""
    n |= 1
    while any(n % q == 0 for q in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


class IdFilter:
    """A bit for each id modulo a prime: says which rows can be left out of a join.

    Its words are a table of at most ``FILTER_BITS`` / 64 rows, whatever the number of ids, and so can be broadcast;
    tests are native expressions, so that no text passes through Python for them.
    """

    def __init__(self, ids: DataFrame, column: str = "doc_id"):
        self.bits = min(FILTER_BITS, _prime(max(1009, 8 * ids.count())))
        place = F.pmod(F.col(column), F.lit(self.bits))
        words = ids.where(F.col(column).isNotNull()).select((place / 64).cast("long").alias("_w"), place.alias("p")).groupBy("_w")
        self.words = saved(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("_v")))

    def part(self, df: DataFrame, column: str, inside: bool) -> DataFrame:
        """The rows whose id may be in the set, or the others, null ids among them."""
        p, w, v = unused(df.columns, "_p", "_w", "_v")
        words = self.words.select(F.col("_w").alias(w), F.col("_v").alias(v))
        place = F.pmod(F.col(column).cast("long"), F.lit(self.bits))
        marked = df.withColumn(p, place).join(F.broadcast(words), (F.col(p) / 64).cast("long") == F.col(w), "left")
        hit = F.coalesce(F.expr(f"shiftright({v}, cast(pmod({p}, 64) as int)) & 1"), F.lit(0)) == 1
        return marked.where(hit if inside else ~hit).drop(p, w, v)

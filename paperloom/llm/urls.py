"""URL filters: longest-match rules, then exact list membership by a cascade of Bloom filters, in native expressions.

Level 1 of the cascade encodes the listed keys; level 2 the keys of the corpus's complete universe that level 1 holds
falsely; level 3 the listed keys that level 2 holds falsely, and so on until a level has no false positive. A key of
the universe is listed exactly if the first level that lacks it is an even one (or it passes all of an odd number).
Look-ups are expressions over binary literals: no join, no Python. Filters are built by aggregating bits; the driver
gets filter words only. A list whose levels would need more than about ``MAX_BITS`` bits is dealt by hash into shards
of that size, each with its own cascade; the pages then pass one shard after the other, so that the driver and a plan
hold one shard's bits at a time, whatever the list's length.

Nulls: a null url, or one without "://", has an empty host and path; an empty host has no key and is allowed. A null
page id is kept. Repeated rows give repeated rows; an empty list or table blocks nothing.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits of all levels of a shard together, about: 8 MB of literals in a plan.
MAX_BITS = 64 << 20
#: Filter words that meet in one binary value on their way to the driver.
BLOCK = 4096
#: Levels of a cascade at most; each holds a quarter of the one before, so more means that something is wrong.
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain, its path as a prefix) and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def host_keys(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number (the hashes' seed), bits, hashes and bytes."""

    seed: int
    bits: int
    hashes: int
    data: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(j), key), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        data = F.lit(self.data)

        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(p, F.lit(8)))), F.lit(2)) == 1

        found = F.lit(True)
        for p in self.positions(key):
            found = found & bit(p)
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def member(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for x in reversed(self.levels):
            out = F.when(~x.holds(key), F.lit(x.seed % 2 == 0)).otherwise(out)
        return out


def filter_of(keys: DataFrame, seed: int, bits: int, hashes: int) -> Level:
    """A filter of the column ``key``: bits are or-ed on the executors, the driver gets 64-bit words in binary blocks."""
    empty = Level(seed, bits, hashes, b"")
    bit = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    words = bit.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
    hexed = F.collect_list(F.concat(F.lpad(F.hex("w"), 16, "0"), F.lpad(F.hex("v"), 16, "0")))
    blocks = words.groupBy((F.col("w") / BLOCK).cast("long").alias("b")).agg(F.unhex(F.array_join(hexed, "")).alias("words"))
    data = bytearray(8 * -(-bits // 64))
    for r in blocks.select("words").collect():
        for w, v in struct.iter_unpack(">QQ", r["words"]):
            data[8 * w : 8 * w + 8] = v.to_bytes(8, "little")
    return Level(seed, bits, hashes, bytes(data))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def cascade(universe: DataFrame, inside: DataFrame, n: int, hashes: int, max_levels: int = MAX_LEVELS) -> Cascade:
    """The cascade for the ``n`` distinct ``key`` values of ``inside`` within those of ``universe``.

    hashes: of the first level, which lets in about as many keys as are listed; the others let in a quarter each.
    """
    if not n:
        return Cascade(())
    levels: list[Level] = []
    encoded, other, count, spent = inside, None, n, []
    for seed in range(1, max_levels + 1):
        level = filter_of(encoded, seed, max(64, math.ceil(count * hashes / math.log(2))), hashes)
        levels.append(level)
        if seed == 1:
            # of the universe, only what passes level 1 is ever gathered; the list's own keys leave by a join when building
            false = universe.select("key").where(F.col("key").isNotNull() & level.holds(F.col("key"))).distinct().join(inside, "key", "left_anti")
        else:
            false = other.where(level.holds(F.col("key")))
        false = saved(false)
        spent.append(false)
        count = false.count()
        if not count:
            dropped(*spent)
            return Cascade(tuple(levels))
        encoded, other, hashes = false, encoded, 2
    raise RuntimeError(f"{count} keys are still held falsely after {max_levels} levels")


def cascades(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS):
    """The cascades of a list's shards, one after the other, as (shard, number of shards, cascade); none for an empty list."""
    inside = saved(listed.select("key").where(F.col("key").isNotNull()).distinct())
    n = inside.count()
    if n:
        size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        hashes = max(2, min(24, math.ceil(math.log2(max(4, size / n)))))
        # level 1, level 2 with two hashes for about as many keys, and a quarter for each further level
        shards = max(1, math.ceil(n * (hashes + 3) / math.log(2) / max_bits))
        for k in range(shards):
            of_shard = lambda df: df if shards == 1 else df.where(shard_of(F.col("key"), shards) == k)  # noqa: B023, E731
            own = of_shard(inside)
            yield k, shards, cascade(of_shard(universe), own, n if shards == 1 else own.count(), hashes)
    dropped(inside)


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for each row; ``listed`` has hosts or domains in ``key``.

    The verdict is the rule's; without a fitting rule, block if the host or a parent domain is listed, else allow.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = rows.select(F.explode(host_keys(F.col("host"))).alias("key"))
    out, before = rows.withColumn("listed", F.lit(False)), None
    for k, shards, built in cascades(universe, listed, max_bits):
        if shards == 1:
            out = rows.withColumn("listed", F.exists(host_keys(F.col("host")), built.member))
        elif built.levels:
            found = F.exists(host_keys(F.col("host")), lambda key: (shard_of(key, shards) == k) & built.member(key))  # noqa: B023
            out = saved(out.withColumn("listed", F.col("listed") | found))
            if before is not None:
                dropped(before)
            before = out
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")

"""URL filters by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys. Over the complete universe of keys that can be asked for - every host suffix
with every path prefix of a rule's length, of every url in the corpus - the false positives are encoded in level 1, the
listed keys that level 1 takes for false in level 2, and so on until nothing is mistaken. Asking the levels in turn then
gives exact membership for every key of the universe, without joining the corpus with the list. A second cascade over
the listed keys tells blocked from allowed ones.

Each level is OR-ed together in Spark and broadcast; its size follows the list and is checked. Null urls and urls without
'://' have empty host and path and fit no rule. Repeated rows are judged each; extra columns are ignored. An empty table
gives an empty result; an empty list allows everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import materialize

#: Bits for a key, hashes for a key, levels at most, bytes of a level at most.
BITS, HASHES, LEVELS, MOST = 12, 4, 24, 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first '://': up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys host suffix + path prefix that a rule fitting the url could have, longest first; ties: the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.when(F.length(host) > 0, suffixes).otherwise(F.array().cast("array<string>"))
    prefixes = F.filter(F.transform(F.array(*(F.lit(n) for n in lengths)), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("n"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def _level(keys: DataFrame, number: int) -> np.ndarray:
    """A Bloom filter of keys (h long): its words, OR-ed in Spark."""
    n = keys.count()
    bits = 64 * max(1, -(-n * BITS // 64))
    if bits // 8 > MOST:
        raise ValueError(f"level {number} of the cascade needs {bits // 8} bytes; at most {MOST} may be broadcast")
    exploded = keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))))
    place = F.pmod(F.xxhash64("h", "i", F.lit(number)), F.lit(bits))
    words = exploded.select(place.alias("b")).groupBy(F.expr("cast(b div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_level(places: Column, held) -> Column:
    """True where all of the key's bits are set; places: the hashes of a key for this level."""

    @F.arrow_udf("boolean")
    def hit(rows: pa.Array) -> pa.Array:
        words = held.value
        b = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) % (len(words) * 64)
        return pa.array(((words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1))

    return hit(places)


def _places(h: str, number: int) -> Column:
    return F.array(*(F.xxhash64(h, F.lit(i), F.lit(number)) for i in range(HASHES)))


class Cascade:
    """Exact membership of the listed keys among all keys of the universe; both have a column h, a key's 64-bit hash."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.spark = listed.sparkSession
        self.levels: list = []
        inside = materialize(listed.select("h").distinct(), "listed")
        outside = None
        while len(self.levels) < LEVELS:
            number = len(self.levels)
            if not inside.count():
                return
            words = _level(inside, number)
            self.levels.append(self.spark.sparkContext.broadcast(words))
            if outside is None:
                # false positives of level 0 over everything else; few, so that only they are kept
                passed = universe.filter(_in_level(_places("h", 0), self.levels[0])).select("h").distinct()
                outside = materialize(passed.join(inside, "h", "left_anti"), "false")
            else:
                outside = materialize(outside.filter(_in_level(_places("h", number), self.levels[number])), "false")
            inside, outside = outside, inside
        raise RuntimeError("the cascade did not end: two keys share a hash")

    def first(self, hashes: Column) -> Column:
        """Place (from 1) of the first listed key in an array of key hashes; null without one."""
        levels = self.levels

        @F.arrow_udf("int")
        def place(rows: pa.Array) -> pa.Array:
            sizes = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
            out = np.zeros(len(rows), np.int64)
            # each key comes with its hashes for every level
            flat = rows.flatten().flatten().to_numpy(zero_copy_only=False)
            if len(flat) and levels:
                flat = flat.reshape(-1, len(levels), HASHES)
                member = np.zeros(len(flat), bool)
                live = np.arange(len(flat))
                for number, held in enumerate(levels):
                    words = held.value
                    b = flat[live, number] % (len(words) * 64)
                    hit = ((words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1)
                    # a key that a level doesn't hold belongs to the other side; one that all hold, to the last one's
                    member[live] = number % 2 == 0
                    member[live[~hit]] = number % 2 == 1
                    live = live[hit]
                row = np.repeat(np.arange(len(rows)), sizes)
                begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                found = np.flatnonzero(member)
                which, first = np.unique(row[found], return_index=True)
                out[which] = found[first] - begin[which] + 1
            return pa.array(out, pa.int32(), mask=out == 0)

        numbers = range(len(levels))
        return place(F.transform(hashes, lambda h: F.array(*(F.xxhash64(h, F.lit(i), F.lit(n)) for n in numbers for i in range(HASHES)))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict): the longest rule (host, path, verdict) that fits, else the default."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("host", host).withColumn("path", path)
    if not lengths:
        return rows.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    listed = rules.groupBy(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("key")).agg(F.max("verdict").alias("verdict"))  # block wins over allow
    listed = listed.withColumn("h", F.xxhash64("key"))
    universe = rows.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h"))
    membership = Cascade(listed, universe)
    blocked = Cascade(listed.filter("verdict = 'block'"), listed)
    hashed = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    hashed = hashed.withColumn("at", membership.first(F.col("hashes"))).withColumn("rule", F.when(F.col("at").isNotNull(), F.element_at("keys", F.col("at"))))
    own = F.when(F.col("at").isNotNull(), F.array(F.element_at("hashes", F.col("at")))).otherwise(F.array().cast("array<bigint>"))
    verdict = F.when(F.col("rule").isNull(), default).when(blocked.first(own).isNotNull(), "block").otherwise("allow")
    return hashed.withColumn("verdict", verdict).select("page_id", "url", "host", "path", "rule", "verdict")

"""URL filters: longest-rule match, then exact list membership from a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Host labels that put a host on the list of the registered query.
LISTED_LABELS = r"(^|\.)[^.]*(spam|casino|phish|malware|warez)[^.]*(\.|$)"
MAX_BITS = 1 << 26  # of one filter level and shard: 8 MB


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    plain = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^(?s)([^/?#]*)([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(plain, upper, lower), F.regexp_extract(F.coalesce(rest, F.lit("")), r"^(?s)([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null. Ties in length: the later in text order."""
    def fits(rule):
        h, _, p = rule.partition("/")
        return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        out = F.when(fits(rule), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _bits(key: Column, level: int, n_hashes: int, n_bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)])


def bloom(keys: DataFrame, level: int, n_hashes: int, n_bits: int) -> DataFrame:
    """One row: a Bloom filter of column ``key`` as an array of 64-bit words. Words meet in partial aggregates first."""
    word = (keys.select(F.explode(_bits(F.col("key"), level, n_hashes, n_bits)).alias("bit"))
            .groupBy(F.floor(F.col("bit") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")))
    filled = word.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return filled.select(F.transform(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)),
                                     lambda w: F.coalesce(F.try_element_at(F.col("m"), w), F.lit(0).cast("long"))).alias("words"))


def _within(key: Column, words: Column, level: int, n_hashes: int, n_bits: int) -> Column:
    """Whether every bit of the key is set; ``words`` is a scalar subquery, which Spark evaluates once."""
    out = F.lit(True)
    for i in range(n_hashes):
        bit = F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits))
        out = out & (F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1)
    return out


@dataclass
class Cascade:
    """Filter levels per shard of the key space; a key's shard is a hash of the key."""
    shards: int
    levels: list = field(default_factory=list)  # per shard: [(one-row DataFrame, level, hashes, bits)]

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("int")

    def member(self, key: Column, shard: int) -> Column:
        """Exact for keys of the universe: the first level that misses decides, by its parity."""
        out = F.lit(len(self.levels[shard]) % 2 == 1)
        for k, (frame, level, hashes, bits) in reversed(list(enumerate(self.levels[shard]))):
            out = F.when(_within(key, frame.scalar(), level, hashes, bits), out).otherwise(F.lit(k % 2 == 1))
        return F.coalesce(out, F.lit(False))


def build_cascade(universe: DataFrame, bits_per_key: int = 10, n_hashes: int = 4, max_bits: int = MAX_BITS) -> Cascade:
    """Cascade over ``universe`` (key, listed): exact for each of its keys, null keys left out.

    Level 0 encodes the listed keys; every next level encodes the keys that the one before wrongly
    holds, until none is left. Only filters, never keys, leave the cluster, each at most ``max_bits``
    long: where the list, or what a filter of it is expected to hold wrongly of the rest, is longer, keys are split into
    shards by hash, each with a cascade of its own.
    """
    keys = materialise(universe.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    sizes = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("rest")).first()
    n_listed, wrongly = sizes["listed"], (1 - math.exp(-n_hashes / bits_per_key)) ** n_hashes * sizes["rest"]
    out = Cascade(max(1, math.ceil(max(n_listed, wrongly if n_listed else 0) * bits_per_key / max_bits)))
    for shard in range(out.shards):
        mine = keys if out.shards == 1 else keys.where(out.shard_of(F.col("key")) == shard)
        inside, outside = mine.where("listed"), mine.where("NOT listed")
        levels, n = [], n_listed if out.shards == 1 else inside.count()
        while n:
            size = min(max(64, 1 << math.ceil(math.log2(n * bits_per_key))), max_bits)
            frame = materialise(bloom(inside.select("key"), len(levels), n_hashes, size), "bloom")
            levels.append((frame, len(levels), n_hashes, size))
            wrong = materialise(outside.where(_within(F.col("key"), frame.scalar(), *levels[-1][1:])), "wrong")
            inside, outside, n = wrong, inside, wrong.count()
        out.levels.append(levels)
    return out


def judge(pages: DataFrame, cascade: Cascade, rules=RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict. Rules first, then the cascade: listed hosts are blocked, others allowed.

    One pass per shard of the cascade (one, unless the list is longer than its bound); no join.
    """
    host, path = host_path(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    parts = []
    for shard in range(cascade.shards):
        mine = named if cascade.shards == 1 else named.where(cascade.shard_of(F.col("host")) == shard)
        own = F.when(cascade.member(F.col("host"), shard), F.lit("block")).otherwise(F.lit("allow"))
        rule = rule_of(F.col("host"), F.col("path"), rules)
        parts.append(mine.withColumns({"rule": rule["rule"], "verdict": F.coalesce(rule["verdict"], own)}))
    return reduce(DataFrame.unionByName, parts)


def filter_urls(pages: DataFrame, listed: DataFrame | Column | str = LISTED_LABELS, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``listed``: a table whose first column are the listed hosts, a
    pattern on hosts, or a Column over ``key``. A table is joined to the distinct hosts once, to build the cascade; pages
    never meet it. Its nulls and repeats do not matter, hosts are compared in lower-case A-Z.

    Null urls and urls without ``://`` have an empty host, which no rule or list holds: allowed.
    Repeated rows are judged alike, an empty table gives an empty result.
    """
    pages = pages.select("page_id", "url")
    key = F.col("key")
    universe = pages.select(host_path(F.col("url"))[0].alias("key")).distinct()
    if isinstance(listed, DataFrame):
        lower = F.translate(F.col(listed.columns[0]).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        hosts = listed.select(lower.alias("key")).where("key <> ''").distinct().withColumn("listed", F.lit(True))
        universe = universe.join(hosts, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        universe = universe.select("key", (key.rlike(listed) if isinstance(listed, str) else listed).alias("listed"))
    return judge(pages, build_cascade(universe), rules).select("page_id", "host", "path", "rule", "verdict")

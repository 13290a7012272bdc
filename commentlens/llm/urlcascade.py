"""URL filter: path rules first, then exact list membership by a Bloom filter cascade.

The first level holds the listed keys. Level two holds its false positives among all other keys of
the corpus, level three those listed keys that level two holds wrongly, and so on until a level has
no false positives. As the levels see every key of the corpus, membership is exact for each of them,
and a lookup reads bits only: each level reaches the scan as a scalar, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.contain import LOWER, UPPER
from commentlens.session import written_table

#: Bits of all levels together; a longer cascade is not sent out, and a join answers instead.
MAX_BITS = 1 << 27


class Rule(NamedTuple):
    host: str
    path: str
    blocks: bool


#: Fixed values of the contract.
RULES = (
    Rule("com", "/", False),
    Rule("example.com", "/en/", True),
    Rule("www.example.com", "/en/", False),
    Rule("net", "/es/", True),
    Rule("net", "/fr/", True),
)
#: Sites that are blocked wherever no rule decides; a host is listed if one of its labels is a site.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _first_rule(host: Column, path: Column, rules: Iterable[Rule], value) -> Column:
    """``value`` of the longest rule that fits; null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


class Level(NamedTuple):
    words: DataFrame
    size: int
    hashes: int


def _position(key: Column, level: int, k: int, size: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(size))


def _built(keys: DataFrame, count: int, false_share: float, level: int) -> Level:
    """The bits of a Bloom filter as one row, an array of 64-bit words."""
    hashes = max(1, round(-math.log2(min(0.5, false_share))))
    size = 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))
    spots = keys.select(F.explode(F.array(*(_position(F.col("key"), level, k, size) for k in range(hashes)))).alias("at"))
    bits = spots.select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    return Level(written_table(row, "cascade-level"), size, hashes)


def _has(level: Level, number: int, key: Column) -> Column:
    words = level.words.scalar()
    tests = []
    for k in range(level.hashes):
        at = _position(key, number, k, level.size)
        word = F.get(words, F.floor(at / 64).cast("int"))
        tests.append(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def cascade(listed: DataFrame, others: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels that tell ``listed(key)`` from ``others(key)``, both distinct; None if they need over ``max_bits``."""
    levels: list[Level] = []
    inside, outside = written_table(listed.select("key"), "cascade-keys"), written_table(others.select("key"), "cascade-keys")
    bits = 0
    while True:
        n_in, n_out = inside.count(), outside.count()
        share = 0.5 if levels else min(0.5, math.sqrt(0.5) * n_in / max(1, n_out)) or 0.5
        bits += 64 + n_in * max(1, round(-math.log2(share))) / math.log(2)
        if bits > max_bits:
            return None
        level = _built(inside, n_in, share, len(levels))
        levels.append(level)
        wrong = written_table(outside.where(_has(level, len(levels) - 1, F.col("key"))), "cascade-keys")
        if wrong.isEmpty():
            return levels
        inside, outside = wrong, inside


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for every key that the cascade was built over: the first level without the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        out = F.when(~_has(levels[number], number, key), F.lit(number % 2 == 1)).otherwise(out)
    return out


def url_verdicts(pages: DataFrame, rules: Iterable[Rule] = RULES, sites: Iterable[str] = SITES, max_bits: int = MAX_BITS,
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    The longest rule whose host and path prefix fit decides; of equally long ones, the first by name.
    Without a rule, a host of which a label is one of ``sites`` is blocked; the cascade over all hosts
    of the table says which are. A null url or one without :// has an empty host and path and is
    allowed. Ids may be null or repeat. An empty table gives an empty result; other columns are ignored.
    """
    rules = tuple(rules)
    split = pages.select(pages[id_col].alias("__id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    keys = written_table(split.select(F.col("host").alias("key")).distinct(), "cascade-universe")
    on_list = F.arrays_overlap(F.split("key", r"\."), F.array(*(F.lit(s) for s in sites)).cast("array<string>"))
    levels = cascade(keys.where(on_list), keys.where(~on_list), max_bits)
    if levels is None:
        marked = keys.where(on_list).select(F.col("key").alias("host"), F.lit(True).alias("listed"))
        out = split.join(marked, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        out = split.withColumn("listed", is_listed(levels, F.col("host")))
    host, path = F.col("host"), F.col("path")
    ruled = _first_rule(host, path, rules, lambda r: "block" if r.blocks else "allow")
    return out.select(
        F.col("__id").alias(id_col), "host", "path", _first_rule(host, path, rules, lambda r: r.host + r.path).alias("rule"),
        F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )

"""URL verdicts by a cascade of Bloom filters, with DataFrame functions alone.

Listed keys (rules and listed hosts) are encoded in level 1; the corpus's unlisted keys that pass
it in level 2; the listed ones that pass level 2 in level 3; and so on until a level has no false
positive. Over the corpus's keys (its complete universe) the level at which a key first fails then
tells exactly whether it is listed, without a join.

A level's bits are one array literal. Level 1 is sized so that its false positives are about as
many as the listed keys, so all levels together take some 1.44 * log2(keys / listed) + 8 bits a
listed key, however large the corpus is. A list that needs more than `MAX_BITS` is refused.

Keys of a url: every suffix of its host at a label border, with every prefix of its path that has
the length of some rule's path. A rule fits its host and all subdomains if the path starts with
the rule's; of those that fit, the longest (host and path) wins. Without a rule, a url is blocked
if its host or a parent domain is a listed host, else allowed.

Defined results: a null url and one without `://` have empty host and path, no rule, and are
allowed; repeated rows are judged each for itself; an empty list allows everything; empty tables
give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, written

#: Bits of one level's array literal (16 MB).
MAX_BITS = 1 << 27
LEVELS = 40
#: False positives from level 2 on.
LATER_RATE = 1 / 32

#: The contract's rules (fixed values): (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts blocked where no rule fits, with their subdomains.
LISTED_HOSTS = ("free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
                "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
                "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without `://`."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, F.lit("://")) + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))


def rule_keys(host: Column, path: Column, lengths: Iterable[int]) -> Column:
    """Candidate rule keys (host suffix and path prefix), longest first."""
    hosts = suffixes(host)
    per = [F.when(F.length(path) >= n, F.transform(hosts, _with(path, n))).otherwise(F.array().cast("array<string>"))
           for n in sorted(set(lengths))]
    keys = F.flatten(F.array(*per)) if per else F.array().cast("array<string>")
    return F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False)["k"]


def _with(path: Column, n: int):
    return lambda host: F.concat(host, F.substring(path, 1, n))


def _seeds(n_hash: int, level: int) -> list[int]:
    return [1000 * level + j for j in range(n_hash)]


class Level:
    """One filter: its number of bits and hashes, and its words as a constant-folded array literal."""

    def __init__(self, number: int, bits: int, hashes: int, words: str):
        self.number, self.bits, self.hashes = number, bits, hashes
        self.words = F.split(F.lit(words), ",").cast("array<bigint>")

    @staticmethod
    def places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(s)), F.lit(bits)) for s in _seeds(hashes, number)]

    def passes(self, key: Column) -> Column:
        ok = F.lit(True)
        for p in self.places(key, self.number, self.bits, self.hashes):
            word = self.words[F.floor(p / 64).cast("int")]
            ok = ok & (F.getbit(word, (p % 64).cast("int")) == 1)
        return ok

    @classmethod
    def build(cls, keys: DataFrame, number: int, count: int, rate: float) -> Level:
        """Filter of the column `k`; the driver gets its words, of a size fixed beforehand."""
        bits = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2) / 64) * 64)
        hashes = max(1, round(math.log2(1 / rate)))
        if bits > MAX_BITS:
            raise ValueError("too many listed keys for a literal")
        places = keys.select(F.explode(F.array(*cls.places(F.col("k"), number, bits, hashes))).alias("p"))
        words = (places.groupBy(F.floor(F.col("p") / 64).cast("bigint").alias("w"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")))
        full = [0] * (bits // 64)
        for r in words.collect():
            full[r["w"]] = r["b"]
        return cls(number, bits, hashes, ",".join(map(str, full)))


class Cascade:
    """Exact membership of listed keys among the keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """Both have a string column `k`; the universe may repeat keys and may be large."""
        listed = written(listed.filter("k IS NOT NULL").distinct(), "listed-keys")
        n_listed = listed.count()
        self.levels: list[Level] = []
        if not n_listed:
            return
        total = max(1, universe.count())
        rate = min(0.5, n_listed / (math.sqrt(2) * total))
        self.levels.append(Level.build(listed, 1, n_listed, max(rate, 2.0 ** -40)))
        inside = listed
        # the one pass over the corpus; what it finds is about as small as the list
        outside = written(universe.filter(self.levels[0].passes(F.col("k"))).distinct()
                          .join(small_side(listed), "k", "left_anti"), "false-keys")
        for number in range(2, LEVELS):
            count = outside.count()
            if not count:
                return
            level = Level.build(outside, number, count, LATER_RATE)
            self.levels.append(level)
            inside, outside = outside, written(inside.filter(level.passes(F.col("k"))), "false-keys")
        raise RuntimeError("the cascade does not end")

    def contains(self, key: Column) -> Column:
        """Walk the levels: the first that a key fails tells the answer."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def judge(pages: DataFrame, rules=RULES, listed_hosts: Iterable[str] = LISTED_HOSTS, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """Per row: host, path, the rule that wins (null without one) and the verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    lengths = {len(p) for _, _, p in rules}
    parts = pages.select(F.col(page_id), host.alias("host"), path.alias("path"))
    # a rule's verdict is part of its key, so one cascade tells both
    keys = parts.withColumn("rules", F.flatten(F.transform(
        rule_keys(F.col("host"), F.col("path"), lengths),
        lambda k: F.array(F.concat(F.lit("block:"), k), F.concat(F.lit("allow:"), k))))) \
        .withColumn("hosts", F.transform(suffixes(F.col("host")), lambda h: F.concat(F.lit("host:"), h)))
    listed = key_table(spark, [f"{v}:{h}{p}" for v, h, p in rules] + [f"host:{h}" for h in listed_hosts])
    cascade = Cascade(listed, keys.select(F.explode(F.concat("rules", "hosts")).alias("k")))
    judged = keys.withColumn("hit", F.get(F.filter("rules", cascade.contains), F.lit(0))) \
        .withColumn("listed", F.exists("hosts", cascade.contains))
    verdict = F.when(F.col("hit").isNotNull(), F.split_part("hit", F.lit(":"), F.lit(1))) \
        .when(F.col("listed"), "block").otherwise("allow")
    return judged.select(page_id, "host", "path", F.substring("hit", 7, 1 << 30).alias("rule"), verdict.alias("verdict"))


def key_table(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """A table of keys `k` from a list kept in code or configuration."""
    one = spark.range(1)
    return one.select(F.explode(F.array(*[F.lit(k) for k in keys]).cast("array<string>")).alias("k"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages)


_H = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(x, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(x, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
f AS (SELECT *, host = 'net' OR ends_with(host, '.net') AS net, host = 'org' OR ends_with(host, '.org') AS org,
    host = 'example.net' OR ends_with(host, '.example.net') AS enet, host = 'example.com' OR ends_with(host, '.example.com') AS ecom,
    len(list_filter([{_H}], lambda h: host = h OR ends_with(host, '.' || h))) > 0 AS listed FROM p),
r AS (SELECT *, CASE WHEN enet AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ecom AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

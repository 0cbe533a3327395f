"""URL filtering: path rules, and exact membership of listed hosts by a Bloom filter cascade."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import Scratch, ascii_lower, unused

#: (verdict, rule): a host and its subdomains, and the start of the path.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
WORD = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is tried first
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """A host and its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )


@dataclass
class Level:
    """A Bloom filter as the set words of its bit array."""

    bits: int
    hashes: int
    seed: int
    words: dict[int, int]

    def has(self, key: Column) -> Column:
        """Whether all bits of ``key`` are set. The filter is one literal, which the optimizer parses once."""
        if not self.words:
            return F.lit(False)
        words = ",".join(str(self.words.get(i, 0)) for i in range(-(-self.bits // WORD)))
        table = F.split(F.lit(words), ",").cast("array<bigint>")
        places = F.array(*(F.pmod(F.xxhash64(key, F.lit(self.seed * 131 + k)), F.lit(self.bits)) for k in range(self.hashes)))
        return F.forall(places, lambda at: F.element_at(table, (F.floor(at / WORD) + 1).cast("int")).bitwiseAND(_one_bit(at)) != 0)


def _one_bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD)).cast("int"))


@dataclass
class Cascade:
    """Alternating Bloom filters: level 1 holds the listed keys, level 2 the unlisted keys that level 1
    lets through, level 3 the listed keys that level 2 lets through, and so on until none is left.

    Over the universe of keys it was built with, membership is exact.
    """

    levels: list[Level]

    def has(self, key: Column) -> Column:
        # key is listed if the first level that does not hold it is even
        out = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), F.lit(n % 2 == 1)).otherwise(out)
        return out


def size_of(n: int, rate: float) -> int:
    """Bits of a filter of ``n`` keys with false-positive rate ``rate``."""
    return max(WORD, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of ``n`` distinct keys: bits are set on the executors and folded to words before they are sent."""
    bits = size_of(n, rate)
    hashes = max(1, round(bits / n * math.log(2)))
    at = F.explode(F.array(*(F.pmod(F.xxhash64("key", F.lit(seed * 131 + k)), F.lit(bits)) for k in range(hashes))))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / WORD).cast("int").alias("w"))
        .agg(F.bit_or(_one_bit(F.col("at"))).alias("b"))
    )
    return Level(bits, hashes, seed, {r["w"]: r["b"] for r in words.collect()})


def build_cascade(universe: DataFrame, listed: DataFrame, most_bits: int = 1 << 22) -> Cascade | None:
    """A cascade exact over every key of ``universe`` (a column ``key``); None where a level would pass ``most_bits``.

    ``listed`` has the listed keys; those outside the universe need no place in it. The first level's
    false-positive rate follows the ratio of listed to unlisted keys, later levels use one half, so the
    total size is about listed * log(unlisted / listed) bits. Null and repeated keys count once or not at all.
    """
    with Scratch(universe.sparkSession) as scratch:
        marked = universe.select("key").distinct().join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left")
        marked = scratch.table(marked.where("key is not null").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        counts = {r["listed"]: r["n"] for r in marked.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        inside, outside = counts.get(True, 0), counts.get(False, 0)
        levels: list[Level] = []
        own, other, n = marked.where("listed"), marked.where("not listed"), inside
        while n:
            rate = max(0.5 if levels else min(0.5, (inside / max(1, outside)) / 2**0.5), 1e-9)
            if size_of(n, rate) > most_bits:
                return None
            level = build_level(own, n, rate, len(levels) + 1)
            levels.append(level)
            passed = other.where(level.has(F.col("key")))
            own, other, n = passed, own, passed.count()
        return Cascade(levels)


def drawn_list(pages: DataFrame, url_col: str = "url", digits: str = "01") -> DataFrame:
    """A list (column ``key``) to filter with where none is given: registered domains, which are here the last three
    labels of a host, whose MD5 starts with one of the hexadecimal ``digits``."""
    domain = F.regexp_extract(host_of(F.col(f"`{url_col}`").cast("string")), r"[^.]+\.[^.]+\.[^.]+$", 0)
    return pages.select(domain.alias("key")).distinct().where((F.col("key") != "") & F.substring(F.md5("key"), 1, 1).isin(*digits))


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: list[tuple[str, str]] = RULES,
    listed: list[str] | DataFrame = (),
    most_bits: int = 1 << 22,
) -> DataFrame:
    """``pages`` with its host, path, the rule that fits (else null) and a verdict, allow or block.

    The verdict is the longest fitting rule's; where no rule fits, a url whose host or a parent domain is
    ``listed`` is blocked. Membership is tested by a Bloom filter cascade built over all hosts and parent
    domains of the table, hence exact, and without a join; a list whose filter would pass ``most_bits``, too much
    to send to every task, is joined by host instead, with the same result. A url that is null or has no ``://`` has an
    empty host and path, fits no rule and is allowed. All columns of ``pages`` are kept; columns of its
    own with the names host, path, rule or verdict are replaced. Repeated rows each get their verdict. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`").cast("string")
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in listed], "key string")
    hosts = pages.select(host_of(url).alias("host")).distinct()
    keys = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    cascade = build_cascade(keys, listed, most_bits)
    taken = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.select(*(F.col(f"`{c}`") for c in taken), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if cascade:
        on_list = F.exists(suffixes(F.col("host")), cascade.has)
    else:
        (hit,) = unused(base, "hit")
        found = keys.join(listed.select("key").distinct(), "key", "left_semi").select("host", F.lit(True).alias(hit)).distinct()
        base, on_list = base.join(found, "host", "left"), F.coalesce(F.col(hit), F.lit(False))
    columns = [F.col(f"`{c}`") for c in taken]
    return base.select(*columns, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(on_list, "block").otherwise("allow")).alias("verdict"))

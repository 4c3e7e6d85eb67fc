"""URL rules by exact membership in Bloom filter cascades, without joins on the pages.

The first filter of a cascade holds the listed keys. Keys of the universe that it
takes for listed go into a second filter, listed keys which that one takes for such
go into a third, and so on until no key is wrong. Over the universe it was built for
a cascade answers exactly. The universe is all keys that any page of the corpus can
ask for: its host and parent domains, each with the beginnings of its path.

Filters are built from built-in functions and are kept as constants of the query
plan. Their size follows the list, not the corpus: about ``BITS_PER_KEY`` bits per listed key and
a fraction of that for the further levels. ``MOST_BITS`` bounds it; a larger list is refused.

A url that is null or has no ``://`` has an empty host and path; no rule fits it.
Rows are judged one by one, repeated rows alike. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ascii_lower, cut

BITS_PER_KEY = 8
HASHES = 4
MOST_BITS = 1 << 28


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass
class Cascade:
    """Levels of ``(words of 64 bits, number of bits)``, the first for the listed keys."""

    levels: list[tuple[str, int]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(self._passes(key, i), answer).otherwise(F.lit(i % 2 == 0))
        return answer

    def _passes(self, key: Column, level: int) -> Column:
        words, bits = self.levels[level - 1]
        # one constant after Spark has folded it
        filled = F.from_json(F.lit(words), "array<bigint>")
        test = F.lit(True)
        for p in slots(key, level, bits):
            word = F.get(filled, F.shiftright(p, 6).cast("int"))
            test = test & (F.shiftright(word, 0).bitwiseAND(_bit(p)) != 0)
        return test


def slots(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key in a level, by double hashing with seeds of that level."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    # halves of the hashes: no sum leaves 64 bits
    a, b = F.shiftrightunsigned(a, 24), F.shiftrightunsigned(b, 24)
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(HASHES)]


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade over ``universe`` (key) for ``listed`` (key); null keys are left out."""
    inside = cut(listed.select("key").filter("key is not null").distinct())
    outside = cut(universe.select("key").filter("key is not null").distinct().join(inside, "key", "left_anti"))
    cascade = Cascade()
    coded, tested = inside, outside
    while True:
        n = coded.count()
        bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
        if bits > MOST_BITS:
            raise ValueError(f"{n} keys need a filter of more than {MOST_BITS} bits")
        level = len(cascade.levels) + 1
        filled = (
            coded.select(F.explode(F.array(*slots(F.col("key"), level, bits))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(_bit(F.col("p"))).alias("bits"))
            .collect()
        )  # bits / 64 rows at most
        words = [0] * (bits // 64)
        for w, value in filled:
            words[w] = value
        cascade.levels.append((json.dumps(words, separators=(",", ":")), bits))
        wrong = cut(tested.filter(cascade._passes(F.col("key"), level)))
        if wrong.isEmpty():
            return cascade
        coded, tested = wrong, coded


def domains(host_column: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host_column, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def keys(host_column: Column, path_column: Column, lengths: list[int]) -> Column:
    """What rules may be written for a page: ``key, host_length`` by domain and beginning of the path."""
    starts = F.filter(
        F.array(*[F.when(F.length(path_column) >= k, F.substring(path_column, 1, k)) for k in lengths]), lambda x: x.isNotNull()
    )
    return F.flatten(
        F.transform(
            domains(host_column),
            lambda d: F.transform(starts, lambda p: F.struct(F.concat(d, p).alias("key"), F.length(d).alias("host_length"))),
        )
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed_hosts, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; own columns of these names give way.

    ``rules``: ``(allow or block, host and path)``; the longest that fits decides. Else the
    page is blocked if ``listed_hosts(hosts)``, a DataFrame of keys from the hosts of the
    corpus (host), lists its host.
    """
    spark = pages.sparkSession
    made = ("host", "path", "rule", "verdict")
    lengths = sorted({len(r) - len(r.split("/")[0]) for _, r in rules})
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in made], host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    asked = rows.select("host", "path").select("host", F.explode(keys(F.col("host"), F.col("path"), lengths)["key"]).alias("key"))
    universe = cut(asked.select("key").distinct())
    hosts = cut(rows.select("host").distinct())
    table = spark.createDataFrame(rules, "verdict string, key string")
    any_rule = build(table, universe)
    blocking = build(table.filter("verdict = 'block'"), universe)
    bad_host = build(listed_hosts(hosts), hosts.select(F.col("host").alias("key")))
    fitting = F.filter(keys(F.col("host"), F.col("path"), lengths), lambda k: any_rule.contains(k["key"]))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k["key"]), k["host_length"], k["key"].alias("key"))))["key"]
    by_rule = F.when(blocking.contains(F.col("rule")), "block").otherwise("allow")
    by_list = F.when(bad_host.contains(F.col("host")), "block").otherwise("allow")
    return rows.withColumn("rule", longest).withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_list))

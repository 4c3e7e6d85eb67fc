"""Secrets: fixed patterns, and strings that pass a battery of randomness tests.

All with built-in functions. Long runs of key characters are candidates. For each
the encoding is inferred and three tests are made on the positions of its characters
in that alphabet: chi-squared of uniformity, runs above and below the middle, and
correlation of neighbours. The null hypothesis of a discovery is ordinary text, whose
chi-squared is far larger: the lower tail under that noncentral distribution is the
candidate's p value. Benjamini-Hochberg bounds the share of false discoveries within
each encoding and length band, over all candidates of the corpus, counted on a grid of
p values. A discovery must also agree with randomness in all three tests.

Texts are read once; spans and candidates without their text are written to the
shared folder, where the thresholds are counted. Null and empty texts have no spans.
Each row gives one row; repeated or null ids change nothing; columns of the input with
names of the output give way. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut, let

# The base patterns. Hex and access runs are maximal, so the least length can be asked for
# in the pattern; for assignments it cannot, since a match that fails still uses up its characters.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order they are tried: name, its characters and those of which one must occur,
#: alphabet, and the chance that two characters of ordinary text in it are equal.
ENCODINGS = (
    ("hex", "0-9a-f", "a-f", DIGITS + "abcdef", 0.11),
    ("HEX", "0-9A-F", "A-F", DIGITS + "ABCDEF", 0.11),
    ("base32", "A-Z2-7", "A-Z", LOWER.upper() + "234567", 0.075),
    ("base36", "0-9a-z", "a-z", DIGITS + LOWER, 0.07),
    ("base64", "A-Za-z0-9+/", "A-Za-z", LOWER.upper() + LOWER + DIGITS + "+/", 0.065),
    ("base64url", "A-Za-z0-9_-", "A-Za-z", LOWER.upper() + LOWER + DIGITS + "-_", 0.065),
)


@dataclass(frozen=True)
class Settings:
    """``shortest``: characters of a candidate; ``false_share``: bound on false discoveries; ``agree``: largest |z|."""

    shortest: int = 20
    false_share: float = 0.01
    agree: float = 3.5
    steps: int = 400  # of the grid, ten to a power of ten


def running(lengths: Column, block: int = 64) -> Column:
    """Sums of all earlier entries. Block by block, so that time grows nearly with the length."""
    size = F.size(lengths)
    cut_up = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda i: F.slice(lengths, i * block + 1, F.lit(block))
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    before = lambda parts: F.aggregate(
        parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + total(p)))
    )
    inside = lambda p, at: F.slice(
        F.aggregate(p, F.array(at), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(p)
    )
    spread = let(cut_up, lambda parts: let(before(parts), lambda b: F.flatten(F.transform(parts, lambda p, i: inside(p, F.get(b, i))))))
    return F.when(size > 0, spread).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, value`` of the leftmost matches that do not overlap, in code points; value: the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sized = lambda f, g: F.zip_with(f, F.slice(g, F.lit(1), F.size(f)), lambda m, x: F.struct(F.length(x).alias("gap"), F.length(m).alias("len")))
    all_of_it = let(
        sized(found, gaps),
        lambda z: F.arrays_zip(
            z.alias("z"), running(F.transform(z, lambda s: s["gap"] + s["len"])).alias("before"), values.alias("value")
        ),
    )
    spans = F.transform(
        all_of_it,
        lambda s: F.struct(
            (s["before"] + s["z"]["gap"]).cast("long").alias("start"),
            (s["before"] + s["z"]["gap"] + s["z"]["len"]).cast("long").alias("end"),
            s["value"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def _span(kind: int, keep=None):
    def of(spans: Column) -> Column:
        kept = F.filter(spans, keep) if keep else spans
        return F.transform(
            kept, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("k"), s["end"].alias("end"))
        )

    return of


def _lower_tail(z: Column) -> Column:
    """P(Z <= z) of the normal distribution; below 0 from a tight upper bound."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * 4 / (3 * x + F.sqrt(x * x + 8))
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(body: Column, s: Settings) -> Column:
    """``stratum, step, agrees`` of a string, null if no encoding fits."""
    name, alphabet, same = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for label, all_of, one_of, letters, ic in reversed(ENCODINGS):
        fits = body.rlike(f"^[{all_of}]+$") & body.rlike(f"[{one_of}]")
        name = F.when(fits, label).otherwise(name)
        alphabet = F.when(fits, letters).otherwise(alphabet)
        same = F.when(fits, ic).otherwise(same)

    def tests(a: Column, positions: Column) -> Column:
        n, k = F.size(positions).cast("double"), F.length(a["letters"]).cast("double")
        squares = F.aggregate(
            F.sequence(F.lit(1), F.length(a["letters"])),
            F.lit(0.0),
            lambda acc, j: acc + F.pow(n - F.length(F.replace(body, F.substring(a["letters"], j, F.lit(1)), F.lit(""))), F.lit(2)),
        )
        chi = squares * k / n - n
        uniform = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        shift = n * (k * a["same"] - 1)
        ordinary = (chi - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift)
        high = F.transform(positions, lambda x: (x * 2 >= k).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda acc, x: acc + x).cast("double")
        pairs = F.zip_with(F.slice(positions, 1, F.size(positions) - 1), F.slice(positions, 2, F.size(positions) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        turns = F.size(F.filter(pairs, lambda p: (p["x"] * 2 >= k) != (p["y"] * 2 >= k))) + 1
        mean_runs = 2 * n1 * (n - n1) / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        runs = F.when(var_runs > 0, (turns - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0))
        middle = (k - 1) / 2
        both = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - middle) * (p["y"] - middle))
        own = F.aggregate(positions, F.lit(0.0), lambda acc, x: acc + (x - middle) * (x - middle))
        serial = F.when(own > 0, both / own * F.sqrt(n)).otherwise(F.lit(99.0))
        step = F.least(F.lit(s.steps), F.floor(-10 * F.log10(F.greatest(_lower_tail(ordinary), F.lit(1e-300))))).cast("int")
        agrees = (F.abs(uniform) <= s.agree) & (F.abs(runs) <= s.agree) & (F.abs(serial) <= s.agree)
        band = F.floor(F.log2(n)).cast("string")
        return F.struct(F.concat_ws(":", a["name"], band).alias("stratum"), step.alias("step"), agrees.alias("agrees"))

    inferred = F.struct(name.alias("name"), alphabet.alias("letters"), same.alias("same"))
    return let(
        inferred,
        lambda a: F.when(
            a["name"].isNotNull(),
            let(
                F.transform(F.split(body, ""), lambda c: F.instr(a["letters"], c) - 1),
                lambda positions: tests(a, positions),
            ),
        ),
    )


def scan(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` spans and ``tried`` candidates; written to the shared folder."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    candidates = matches(t, "[A-Za-z0-9+/_-]{%d,}" % s.shortest)
    tried = F.filter(
        F.transform(
            candidates,
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["value"], s).alias("b")),
        ),
        lambda c: c["b"].isNotNull(),
    )
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "base", "tried", "spans")]
    base = F.concat(
        _span(0, lambda m: F.length(m["value"]) >= 6)(matches(t, ASSIGN, 2)),
        _span(1)(matches(t, ACCESS)),
        _span(2)(matches(t, HEX)),
    )
    return cut(docs.select(*keep, base.alias("base"), tried.alias("tried")))


def thresholds(scanned: DataFrame, s: Settings = Settings()) -> dict[str, int]:
    """The grid step from which a candidate of a stratum is a discovery: Benjamini-Hochberg.

    A stratum is an encoding and a power of two of the length, so there are few.
    """
    grid = (
        scanned.select(F.explode("tried").alias("c"))
        .groupBy("c.b.stratum", "c.b.step")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    by: dict[str, dict[int, int]] = {}
    for stratum, step, n in grid:
        by.setdefault(stratum, {})[step] = n
    out = {}
    for stratum, counts in by.items():
        m = at_least = sum(counts.values())
        for step in sorted(counts):
            if 10 ** (-step / 10) * m <= s.false_share * at_least:
                out[stratum] = step
                break
            at_least -= counts[step]
    return out


def find(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``spans``: start, k (index in :data:`KINDS`), end, in order.

    Random strings that overlap a base span are left to it.
    """
    scanned = scan(docs, s, text)
    limit = thresholds(scanned, s)
    bound = lambda stratum: reduce(lambda acc, kv: F.when(stratum == kv[0], kv[1]).otherwise(acc), limit.items(), F.lit(None).cast("int"))
    found = F.filter(
        "tried",
        lambda c: c["b"]["agrees"]
        & (c["b"]["step"] >= bound(c["b"]["stratum"]))
        & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    new = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("k"), c["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", new))).drop("tried", "base")


def kind(spans: Column, k: int) -> Column:
    return F.filter(spans, lambda s: s["k"] == k)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")

"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Entities of the fixed patterns are the seeds. The two words before an entity are a
lexical pattern; the same pattern before another identifier-like word proposes that
word. Spark scores the graph of patterns and proposed words in rounds: a pattern is
as good as the words it extracts, a word as good as the patterns that extract it.
Words behind patterns of high confidence are added as spans of kind ``id``.

Texts are read once; what a text proposes is written to the shared folder and only
those short rows are shuffled. Null and empty texts have no spans. Each input row
gives one output row, also if ids repeat or are null; columns named like an output
give way. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, texts

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. Two forms are rewritten so that a failed match costs
# no second look at the same characters: an address is sought from its @, a number from its first digit.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a word with a digit, in which a letter or sign may stand, is identifier-like
_ident = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+@:-]*[A-Za-z0-9]")
_word = re.compile(r"[^\x20\x09-\x0D]+")
_digit = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Settings:
    """``least_seeds``: distinct seeds a pattern needs; ``confidence``: share of good words among its own."""

    rounds: int = 3
    least_seeds: int = 3
    confidence: float = 0.8
    shrink: float = 1.0
    shortest: int = 6
    salts: int = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _domain.finditer(text):
        at = begin = m.start()
        while begin > end and text[begin - 1] in _local:
            begin -= 1
        if begin < at:
            end = m.end()
            yield begin, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _phone.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if _digit.search(text):
        if "." in text:
            out += [("ip", *s) for s in ips(text)]
        out += [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], shortest: int) -> list[tuple[int, int, str, str, bool]]:
    """``(start, end, pattern, word, seed)`` of entities and identifier-like words.

    The pattern is the pair of lower-cased words before, without digits.
    """
    if not _digit.search(text) and not spans:
        return []
    taken = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in taken]
    latest, top = [], 0
    for _, e in taken:
        top = max(top, e)
        latest.append(top)
    out = []
    before = ["", ""]
    for m in _word.finditer(text):
        s, e = m.span()
        w = m.group()
        i = bisect.bisect_left(starts, e) - 1
        hit = i >= 0 and latest[i] > s
        if hit:
            j = bisect.bisect_left(starts, s)
            if j < len(starts) and starts[j] < e and before[1]:
                a, b = taken[j]
                out.append((a, b, " ".join(before), text[a:b], True))
        elif before[1] and len(w) >= shortest and _digit.search(w):
            x = _ident.search(w)
            if x and x.end() - x.start() >= shortest and _digit.search(x.group()):
                out.append((s + x.start(), s + x.end(), " ".join(before), x.group(), False))
        before = [before[1], "#" if hit or _digit.search(w) else w.lower()]
    return out


def annotate(docs: DataFrame, settings: Settings = Settings(), text: str = "text", carry: bool = True) -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end), written to the shared folder.

    Without ``carry`` the text itself is left out of the result.
    """
    made = ("spans", "found", "row_no")
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    out_names = [c for c in keep if carry or c != text]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seen = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("word", pa.string()), ("seed", pa.bool_())]
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, found = [], []
            for t in texts(b.column(text)):
                got = base_spans(t)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in got])
                found.append([dict(zip(("start", "end", "pattern", "word", "seed"), c)) for c in contexts(t, got, settings.shortest)])
            cols = [b.column(b.schema.get_field_index(c)) for c in out_names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, span), pa.array(found, seen)], [*out_names, "spans", "found"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [
            *(f"`{c}` {types[c]}" for c in out_names),
            "spans array<struct<kind:string,start:bigint,end:bigint>>",
            "found array<struct<start:bigint,end:bigint,pattern:string,word:string,seed:boolean>>",
        ]
    )
    # numbered before it is written, so the numbers hold for every later read
    return cut(arrow_map(rows, work, schema).withColumn("row_no", F.monotonically_increasing_id()))


def _with_score(edges: DataFrame, scores: DataFrame, key: str, salts: int) -> DataFrame:
    """Join a score onto edges; edges of a key that holds many of them meet it in ``salts`` places."""
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    other = "word" if key == "pattern" else "pattern"
    return edges.withColumn("salt", F.pmod(F.hash(other), F.lit(salts))).join(salted, [key, "salt"]).drop("salt")


def good_patterns(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pattern, confidence`` of the patterns that may extract; ``found``: pattern, word, seed."""
    edges = cut(
        found.groupBy("pattern", F.xxhash64("word").alias("word")).agg(F.max("seed").alias("seed"))
    )  # one edge per pattern and word, whatever the number of places
    words = edges.groupBy("word").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for k in range(settings.rounds):
        scored = _with_score(edges, words, "word", settings.salts)
        patterns = (
            scored.groupBy("pattern")
            .agg(
                F.sum("belief").alias("good"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("seed").cast("long")).alias("seeds"),
            )
            .filter(F.col("seeds") >= settings.least_seeds)
            .select("pattern", (F.col("good") / (F.col("n") + settings.shrink)).alias("confidence"))
        )
        patterns = cut(patterns)
        if k < settings.rounds - 1:
            # a word is wrong only if all patterns that extract it are
            sure = F.least(F.col("confidence"), F.lit(0.999999))
            words = (
                _with_score(edges, patterns, "pattern", settings.salts)
                .groupBy("word")
                .agg(
                    F.max(F.col("seed").cast("double")).alias("seeded"),
                    (1 - F.exp(F.sum(F.log(1 - sure)))).alias("by_patterns"),
                )
                .select("word", F.greatest("seeded", "by_patterns").alias("belief"))
            )
    return patterns.filter(F.col("confidence") >= settings.confidence)


def extract(annotated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Replace ``found`` by spans of kind ``id`` among ``spans`` (kinds as listed, then start)."""
    places = annotated.select("row_no", F.explode("found").alias("f")).select("row_no", "f.*")
    patterns = good_patterns(places.select("pattern", "word", "seed"), settings)
    new = (
        _with_score(places.filter(~F.col("seed")), patterns, "pattern", settings.salts)
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("more"))
    )  # the places of one row
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return (
        annotated.join(new, "row_no", "left")
        .withColumn("spans", F.concat("spans", F.coalesce("more", none)))
        .drop("found", "more", "row_no")
    )


def find(docs: DataFrame, settings: Settings = Settings(), text: str = "text", carry: bool = True) -> DataFrame:
    """``docs`` with all ``spans``: fixed patterns and bootstrapped ones."""
    return extract(annotate(docs, settings, text, carry), settings)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans count as the first."""
    marks = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        plain = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(plain, mark)).alias("parts")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    done = F.aggregate(
        marks,
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)

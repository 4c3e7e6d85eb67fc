"""Text expressions: word tokens, token ranges, Python-style strip and split.

Offsets are half-open code-point positions, 0-based, as in the data model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import dealt

# Fixed pattern: the word characters of Python's Unicode ``\w``.
WORD = r"[\p{L}\p{N}_]+"
# Fixed pattern: what Python's str.strip() and str.split() treat as space.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Fixed pattern: what Python's str.splitlines() breaks on.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Texts are counted in blocks so one position lookup reads one block, not the
# whole prefix of the text.
BLOCK = 128


def strip(col: Column) -> Column:
    """Trim every kind of space, not only U+0020 as ``trim`` does."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def words(col: Column) -> Column:
    """Space-separated words of a text; an empty text has none."""
    return F.filter(F.split(col, f"{SPACE}+"), lambda w: w != "")


def lines(col: Column) -> Column:
    """Lines as ``splitlines`` gives them: no extra line after a final break."""
    body = F.regexp_replace(col, f"({LINE_BREAK})$", "")
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def piece(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def blocks(text: Column) -> Column:
    """A text as an array of :data:`BLOCK` characters each, for :func:`piece_of`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece_of(parts: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` of a text in :func:`blocks`: only the blocks it lies in are read.

    Every substring of a text counts the whole text first.
    """
    first, last = (F.floor(at / BLOCK).cast("int") for at in (start, end - 1))
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    plain = (start >= 0) & (end > start)
    return F.when(plain, piece(near, start - first * BLOCK, end - first * BLOCK)).otherwise(
        piece(F.array_join(parts, ""), start, end)
    )


def _runs(part: Column) -> Column:
    return F.regexp_count(part, F.lit(WORD)).cast("bigint")


def _joined(pair: Column) -> Column:
    """1 where both characters of a two-character string belong to a word."""
    return pair.rlike(r"^[\p{L}\p{N}_]{2}$").cast("bigint")


def earlier_totals(numbers: Column, group: int = 128) -> Column:
    """For each number the sum of those before it.

    Groups of numbers are summed first, so a long array costs little more than one pass.
    """
    big = F.lit(0).cast("bigint")

    def walk(parts: Column) -> Column:
        return F.aggregate(
            parts, F.array(big), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )

    def spread(groups: Column, heads: Column) -> Column:
        return F.flatten(
            F.transform(
                groups,
                lambda g, i: F.transform(F.slice(walk(g), F.lit(1), F.size(g)), lambda x: x + F.get(heads, i)),
            )
        )

    last = F.floor((F.size(numbers) - 1) / group).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(numbers, i * group + 1, F.lit(group)))
    sums = lambda gs: F.transform(gs, lambda g: F.aggregate(g, big, lambda t, x: t + x))
    # the one-element arrays keep groups and heads from being computed again for every group
    found = F.transform(
        F.array(groups), lambda gs: F.transform(F.array(walk(sums(gs))), lambda heads: spread(gs, heads))[0]
    )[0]
    return F.when(F.size(numbers) > 0, found).otherwise(F.array().cast("array<bigint>"))


def text_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A text as rows of :data:`BLOCK` characters: (doc_id, block, body, cont, before).

    ``before`` words start ahead of the block; ``cont`` is 1 where its first word runs on
    from the block before. An empty block closes every text.
    """
    cut_up = F.concat(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), F.array(F.lit("")))

    def described(body: Column, i: Column) -> Column:
        ahead = F.get("parts", i - 1)
        cont = F.when(i > 0, _joined(F.concat(F.substring(ahead, -1, 1), F.substring(body, 1, 1)))).otherwise(_zero())
        return F.struct(body.alias("body"), cont.alias("cont"), (_runs(body) - cont).alias("starts"))

    # one step at a time, so that the text is cut once and not once per block
    parts = docs.select("doc_id", cut_up.alias("parts")).select("doc_id", F.transform("parts", described).alias("parts"))
    counted = parts.select("doc_id", "parts", earlier_totals(F.col("parts.starts")).alias("before"))
    rows = counted.select("doc_id", F.posexplode(F.arrays_zip("parts", "before")).alias("block", "p"))
    return rows.select("doc_id", F.col("block").cast("bigint").alias("block"), "p.parts.body", "p.parts.cont", "p.before")


def with_token_indexes(
    spans: DataFrame, docs: DataFrame, wanted: dict[str, tuple[str, str]], rows: int | None = None
) -> DataFrame:
    """Add token indexes to spans: ``wanted`` maps a new column to (position column, ``lo`` or ``hi``).

    ``lo`` is the index of the first token not wholly before a position, ``hi`` one past
    the last token starting before it. Spans, text lengths and text blocks travel once, by
    document; inside a document a span meets the one block its position is in, so no row
    holds a whole text. Spans of unknown documents drop out. The rows come out dealt by
    document, so later steps that group by it and more need no exchange. ``rows``: how many
    spans there are, where known.
    """
    size, block, span = 0, 1, 2
    found = F.struct("__body", "__cont", "__before")
    sizes = docs.select("doc_id", F.length("text").cast("bigint").alias("__n"), F.lit(size).alias("__kind"))
    blocks = text_blocks(docs).select(
        "doc_id", F.col("block").alias("__block"), F.col("body").alias("__body"), F.col("cont").alias("__cont"),
        F.col("before").alias("__before"), F.lit(block).alias("__kind"),
    )
    out = (
        spans.withColumn("__kind", F.lit(span))
        .unionByName(sizes, allowMissingColumns=True)
        .unionByName(blocks, allowMissingColumns=True)
        .filter(F.col("doc_id").isNotNull())
    )
    out = dealt(out, rows, "doc_id")
    kind, is_span = F.col("__kind"), F.col("__kind") == span

    def ahead(*keys: str):
        return W.partitionBy(*keys).orderBy("__kind").rowsBetween(W.unboundedPreceding, W.currentRow)

    lengths = F.collect_list(F.when(kind == size, F.struct("__n"))).over(ahead("doc_id"))
    out = out.withColumn("__sizes", lengths).filter(kind != size)
    out = out.withColumn("__size", F.explode(F.when(is_span, F.col("__sizes")).otherwise(F.array(F.struct("__n")))))
    out = out.withColumn("__n", F.col("__size.__n")).drop("__sizes", "__size")
    for name, (position, side) in wanted.items():
        at = F.greatest(_zero(), F.least(F.col(position), F.col("__n")))
        # least and greatest skip nulls; a span without a position has no index
        out = out.withColumn("__at", F.when(is_span & F.col(position).isNotNull(), at))
        out = out.withColumn("__in", F.when(is_span, F.floor(F.col("__at") / BLOCK)).otherwise(F.col("__block")))
        held = F.collect_list(F.when(kind == block, found)).over(ahead("doc_id", "__in"))
        out = out.withColumn("__held", held).withColumn("__held", F.explode_outer(F.when(is_span, F.col("__held"))))
        body, cont = F.col("__held.__body"), F.col("__held.__cont")
        offset = (F.col("__at") - F.col("__in") * BLOCK).cast("int")
        inside = F.when(offset > 0, _runs(F.substring(body, F.lit(1), offset)) - cont).otherwise(_zero())
        index = F.col("__held.__before") + inside
        if side == "lo":
            over = F.when(offset == 0, cont).otherwise(_joined(F.substring(body, offset, F.lit(2))))
            index = index - F.coalesce(over, _zero())
        out = out.withColumn(name, index).drop("__held", "__in", "__at")
    others = [c for c in spans.columns if c != "doc_id"]
    return out.filter(is_span).select("doc_id", *others, *wanted)


def word_points(spark: SparkSession):
    """Broadcast of which code points :data:`WORD` takes, as Spark's own pattern sees them; asked once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_words", None) is None:
        points = spark.range(0x110000).filter("id < 55296 or id > 57343")
        char = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
        table = np.zeros(0x110000, bool)
        table[points.filter(char.rlike(f"^{WORD}$")).toArrow().column("id").to_numpy()] = True
        sc._marginalia_words = sc.broadcast(table)
    return sc._marginalia_words


class Texts:
    """Several texts, one after the other, ready to give token indexes of positions."""

    def __init__(self, texts: list[str], words: np.ndarray):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = words[points]
        # whether a word runs on over the place ahead of a character
        self.over = np.zeros(len(points) + 1, bool)
        self.over[1:-1] = inside[1:] & inside[:-1]
        self.over[self.starts] = self.over[self.ends] = False
        self.before = np.r_[0, np.cumsum(inside & ~self.over[:-1])]

    def tokens(self, text: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
        """Index of the first token not wholly before ``at`` (``lo``), or one past the last that starts before (``hi``)."""
        place = np.clip(self.starts[text] + at, self.starts[text], self.ends[text])
        index = self.before[place] - self.before[self.starts[text]]
        return index - self.over[place] if side == "lo" else index


def token_offsets(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per word token: (doc_id, token, start_off, end_off).

    Tokens are read piece by piece. A piece holds whole words: it takes
    :data:`BLOCK` characters and the rest of the word it stops in.
    """
    cut = f"(?s).{{0,{BLOCK}}}[\\p{{L}}\\p{{N}}_]*"
    parts = F.filter(F.regexp_extract_all(F.col(text), F.lit(cut), F.lit(0)), lambda p: p != "")
    pieces = docs.select("doc_id", parts.alias("parts")).select(
        "doc_id",
        "parts",
        F.arrays_zip(
            earlier_totals(F.transform("parts", lambda p: F.length(p).cast("bigint"))).alias("chars"),
            earlier_totals(F.transform("parts", _runs)).alias("words"),
        ).alias("before"),
    )
    rows = pieces.select("doc_id", F.posexplode("parts").alias("k", "part"), "before").select(
        "doc_id", "part", F.get("before", F.col("k")).alias("before")
    )
    found = rows.select(
        "doc_id",
        "before",
        F.regexp_extract_all("part", F.lit(WORD), F.lit(0)).alias("tokens"),
        F.split("part", WORD, -1).alias("gaps"),
    )
    sized = found.select(
        "doc_id",
        "before",
        F.arrays_zip(
            F.transform("tokens", lambda t: F.length(t)).alias("w"),
            F.transform(F.slice("gaps", F.lit(1), F.size("tokens")), lambda g: F.length(g)).alias("g"),
        ).alias("sizes"),
    )
    ends = F.aggregate(
        "sizes",
        F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    (F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], _zero()) + x["g"]).alias("s"),
                    (F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], _zero()) + x["g"] + x["w"]).alias("e"),
                )
            ),
        ),
    )
    return sized.select("doc_id", "before", F.posexplode(ends).alias("i", "at")).select(
        "doc_id",
        (F.col("before.words") + F.col("i")).alias("token"),
        (F.col("before.chars") + F.col("at.s")).alias("start_off"),
        (F.col("before.chars") + F.col("at.e")).alias("end_off"),
    )


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def overlap_ratio(
    g_lo: Column, g_hi: Column, p_lo: Column, p_hi: Column, mode: str = "jaccard"
) -> Column:
    """Shared tokens of two index ranges over their union (or over the gold range)."""
    shared = F.greatest(F.lit(0), F.least(g_hi, p_hi) - F.greatest(g_lo, p_lo))
    gold, pred = g_hi - g_lo, p_hi - p_lo
    base = gold if mode == "gold_recall" else gold + pred - shared
    return (
        F.when((gold == 0) & (pred == 0), F.lit(1.0))
        .when(shared == 0, F.lit(0.0))
        .otherwise(shared.cast("double") / base.cast("double"))
    )


# ---- the six perturbations -------------------------------------------------
def _of_words(text: Column, made) -> Column:
    """``made`` of a text's words, which are taken once however often they are used."""
    return F.transform(F.array(words(text)), made)[0]


def _trimmed(text: Column) -> Column:
    def made(w: Column) -> Column:
        inner = F.array_join(F.slice(w, F.lit(2), F.size(w) - 2), " ")
        return F.when(F.size(w) > 2, inner).otherwise(text)

    return _of_words(text, made)


def _truncated(text: Column) -> Column:
    def made(w: Column) -> Column:
        keep = F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(0.8).cast("double")).cast("int"))
        return F.array_join(F.slice(w, F.lit(1), keep), " ")

    return _of_words(text, made)


def _reworded(text: Column) -> Column:
    def made(w: Column) -> Column:
        kept = F.filter(w, lambda x, i: (i == 0) | (i == F.size(w) - 1) | (i % 7 != 0))
        return F.when(F.size(w) < 8, text).otherwise(F.array_join(kept, " "))

    return _of_words(text, made)


PERTURBATIONS = {
    "verbatim": lambda c: c,
    "whitespace_collapsed": lambda c: strip(F.regexp_replace(c, f"{SPACE}+", " ")),
    "lowercased": lambda c: F.lower(c),
    "trimmed": _trimmed,
    "truncated_80pct": _truncated,
    "reworded": _reworded,
}
# Conditions under which the gold span is still the right answer.
SPAN_KEEPING = ("verbatim", "whitespace_collapsed", "lowercased", "reworded")


def first_difference(a: Column, b: Column) -> Column:
    """0-based position where two texts part; the shorter length if one is a prefix.

    Both texts are cut into blocks once; the first pair of blocks that differ is compared
    character by character, where one that ends earlier differs at its end.
    """
    n = F.least(F.length(a), F.length(b)).cast("bigint")

    def cut_up(c: Column, most: int) -> Column:
        return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))

    def parting(x: Column, y: Column) -> Column:
        """1-based place of the first entries that differ, 0 if none do."""
        return F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))

    def inside(pair: Column, hit: Column) -> Column:
        x, y = (cut_up(F.coalesce(F.get(pair[s], (hit - 1).cast("int")), F.lit("")), 1) for s in ("x", "y"))
        return (hit - 1) * BLOCK + parting(x, y) - 1

    def placed(pair: Column) -> Column:
        return F.transform(F.array(parting(pair["x"], pair["y"])), lambda hit: F.when(hit > 0, inside(pair, hit)))[0]

    # one-element arrays, so that blocks and their first difference are computed once
    both = F.struct(cut_up(a, BLOCK).alias("x"), cut_up(b, BLOCK).alias("y"))
    return F.coalesce(F.transform(F.array(both), placed)[0], n)

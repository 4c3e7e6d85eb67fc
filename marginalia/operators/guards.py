"""Leak guards: nothing published may carry protected text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.jsontext import is_array, is_object
from marginalia.functions.text import words
from marginalia.session import cut

# Protected shingles that every task may hold (16 bytes each), and bits of a filter over more.
HELD_SHINGLES = 1_000_000
FILTER_BITS = 1 << 30

# ---- fixed values ------------------------------------------------------------
SHINGLE = 8
MAX_FREE_TEXT_WORDS = 8
NORMAL_WORD = "[a-z0-9']+"
DESCRIPTION_KEYS = (
    "description",
    "driver",
    "error",
    "note",
    "notes",
    "parse_signature",
    "sampler",
    "selection_scalar",
    "served",
    "traceback",
)
# ------------------------------------------------------------------------------


def shingles(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, hash, check) of every 8 consecutive normalised words, as often as they occur.

    Two independent 64-bit hashes stand for the words, so no text moves.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(NORMAL_WORD), F.lit(0))
    rows = df.select(key, tokens.alias("tokens")).filter(F.size("tokens") >= SHINGLE)
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("tokens") - SHINGLE + 1),
        lambda i: F.array_join(F.slice("tokens", i, F.lit(SHINGLE)), " "),
    )
    words = rows.select(key, F.explode(hashed).alias("w"))
    return words.select(key, F.xxhash64("w").alias("hash"), F.xxhash64(F.lit("check"), "w").alias("check"))


def contamination(texts: DataFrame, key: str, protected: DataFrame) -> DataFrame:
    """How many distinct shingles of each text also occur in the protected set. Counts only.

    The protected side is reduced to its distinct shingles and counted. Up to ``HELD_SHINGLES``
    of them go to every task, so that only shingles found there are shuffled; beyond that
    their hashes fill a bitmap that is sent instead, which lets through few others, and what
    passes meets the protected shingles in a shuffled join.
    """
    guarded = cut(protected.select("hash", "check").distinct())
    n = guarded.count()
    if n <= HELD_SHINGLES:
        found = texts.join(F.broadcast(guarded), ["hash", "check"], "left_semi")
    else:
        found = _likely(texts, guarded, n).join(guarded, ["hash", "check"], "left_semi")
    return found.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("shared"))


def _likely(texts: DataFrame, guarded: DataFrame, n: int) -> DataFrame:
    """Shingles whose bit is set in a bitmap of the protected hashes, of 8 to 16 bits a hash.

    The bitmap lies in rows of 4 KB. It is broadcast up to ``FILTER_BITS`` bits; a larger set is
    left to the join alone.
    """
    bits = 1 << max(15, (8 * n - 1).bit_length())
    if bits > FILTER_BITS:
        return texts
    place = F.pmod(F.col("hash"), F.lit(bits)).cast("bigint") + 1
    bitmap = guarded.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )
    at = F.bitmap_bit_position(F.col("place"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place"))
    held = met.join(F.broadcast(bitmap), "bucket")
    return held.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*texts.columns)


def nesting(body: Column) -> Column:
    """How deep the brackets of a JSON text go; 0 for what is no JSON."""
    plain = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(now, acc["most"]).alias("most"))

    depth = F.aggregate(marks, start, step, lambda acc: acc["most"])
    return F.when(F.try_parse_json(body).isNotNull(), depth).otherwise(0)


def long_strings(df: DataFrame, key: str, body: str) -> DataFrame:
    """Strings of more than 8 words anywhere in a JSON column: (key, field, words).

    List items go under their list's field. Described fields may hold prose. What is
    no JSON has no strings. The depth is measured first; then one plan opens all levels over
    one reading of the input, strings waiting at their level. Nothing is shuffled or
    written, so no text leaves the place it is read in.
    """
    depth = df.agg(F.max(nesting(F.col(body))).alias("n")).first().n or 0
    rows = df.select(
        F.col(key).alias("id"), F.lit(None).cast("string").alias("field"),
        F.try_parse_json(body).alias("node"),
    )
    inner = F.when(
        is_object(F.col("node")),
        F.transform(
            F.map_entries(F.try_variant_get("node", "$", "map<string,variant>")),
            lambda e: F.struct(e["key"].alias("field"), e["value"].alias("node")),
        ),
    )
    listed = F.transform(
        F.try_variant_get("node", "$", "array<variant>"), lambda v: F.struct(F.col("field").alias("field"), v.alias("node"))
    )
    opened = inner.when(is_array(F.col("node")), listed).otherwise(F.array(F.struct("field", "node")))
    for _ in range(depth):
        rows = rows.select("id", F.inline(opened))
    strings = rows.filter(F.schema_of_variant("node") == "STRING").select(
        "id", "field", F.size(words(F.try_variant_get("node", "$", "string"))).cast("bigint").alias("words")
    )
    allowed = F.coalesce(F.col("field").isin(*DESCRIPTION_KEYS), F.lit(False))
    return strings.filter(~allowed & (F.col("words") > MAX_FREE_TEXT_WORDS)).select(
        F.col("id").alias(key), F.coalesce("field", F.lit("<root>")).alias("field"), "words"
    )


def forbidden_paths(
    df: DataFrame, path: str, suffixes: tuple[str, ...], parts: tuple[str, ...], prefixes: tuple[str, ...]
) -> DataFrame:
    """Paths that must never be published, by ending, part or beginning."""
    low = F.lower(F.col(path))

    def any_of(test, values) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | test(low, F.lit(v))
        return out

    return df.filter(
        any_of(F.endswith, suffixes) | any_of(F.contains, parts) | any_of(F.startswith, prefixes)
    )

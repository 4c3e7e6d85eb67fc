"""Content keys and the lookup that reuses answers by them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# control characters whose escape holds a hex digit above 9
_LETTERED = [c for c in range(32) if c % 16 > 9 and c not in (10, 12, 13)]


def json_string(text: Column) -> Column:
    """A text as a JSON string: non-ASCII characters kept, escapes with small hex digits."""
    quoted = F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    # rare texts: pieces between the characters in question are quoted one by one
    plain = lambda t: F.substring(F.to_json(F.array(t)), F.lit(3), F.length(F.to_json(F.array(t))) - 4)
    inside = "[" + "".join(f"\\x{c:02x}" for c in _LETTERED) + "]"
    marks = F.transform(
        F.regexp_extract_all(text, F.lit(inside), F.lit(0)),
        lambda c: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0"))),
    )
    pieces = F.transform(F.split(text, inside, -1), plain)
    joined = F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(inside), F.concat(F.lit('"'), joined, F.lit('"'))).otherwise(quoted)


def cache_key(model: str, prompt_version: str, text: Column, params: dict | None = None) -> Column:
    """SHA-256 of the sorted-key JSON of everything that can change an answer."""
    head = json.dumps(model, ensure_ascii=False)
    tail = json.dumps(params or {}, sort_keys=True, ensure_ascii=False)
    version = json.dumps(prompt_version, ensure_ascii=False)
    body = F.concat(
        F.lit('{"document": '),
        json_string(text),
        F.lit(f', "model": {head}, "params": {tail}, "prompt_version": {version}}}'),
    )
    return F.sha2(body, 256)


def result_key(route: Column, model: Column, text: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(route, nul, F.coalesce(model, F.lit("")), nul, text), 256)


def fingerprint(version: str, rendered: Column) -> Column:
    """``version-<16 hex digits>`` of a rendered prompt configuration."""
    return F.concat(F.lit(f"{version}-"), F.substring(F.sha2(rendered, 256), 1, 16))


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached payload of their key; an unreadable payload is a miss.

    Requests with ``cached`` false are the ones still to be answered. The cache
    is reduced to one readable payload per key before the join.
    """
    readable = (
        cache.filter(F.try_parse_json("payload").isNotNull())
        .groupBy("key")
        .agg(F.min("payload").alias("payload"))
    )
    return requests.join(readable, "key", "left").withColumn("cached", F.col("payload").isNotNull())

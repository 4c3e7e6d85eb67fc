"""What several operators of this subpackage share: rows to tasks, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut, scratch_path, ship

__all__ = ["cut", "scratch_path", "ship", "arrow_map", "ascii_lower", "fold", "let", "mix", "texts", "word_bytes"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def word_bytes(text: str, lower: bool = True) -> list[bytes]:
    """Words between white space (space, \\t to \\r) as UTF-8; A-Z lowered if asked for."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def arrow_map(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)

"""Ranked lexical search of a set of items in all documents, by presence masks.

Terms are runs of letters, digits and everything beyond ASCII; A-Z is lowered. A first
pass counts, per document, its terms and those that some item asks for; corpus figures are
sums over that table. A second pass takes blocks of documents. Per item, one bitmap row per
term says which documents of the block hold it; read the other way round they give every
document's mask of matched terms. Documents are grouped by mask, a mask's highest possible
score follows from the terms in it alone, and masks are evaluated from the highest bound
down until the bound falls below the score of the last place. A task keeps ``top`` places
per item, Spark merges the tasks' places. Every document is considered; no result is lost.

Items are searched in blocks of about ``block_terms`` terms, so that what is sent to tasks
is bounded; each block of items is one pass over the documents.

Null and empty texts have no terms: such documents are not counted and never found, such
items find nothing. Texts of any length are read slice by slice. Repeated document rows
count and are found as often as they occur; rows that share an ``item_id`` are one item
with the terms of all. Equal scores go by document id, null last. Extra columns are ignored.
An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, ascii_lower, cut

#: A term, as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII = "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128))).encode()
_BYTES = _ASCII + bytes(range(128, 256))
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
#: Cells (terms x documents) a task lays out at a time.
CELLS = 1 << 24
#: Documents scored between two looks at the last place.
STEP = 256
#: Groups in which places are merged before the last merge.
SLOTS = 64


@dataclass(frozen=True)
class Settings:
    """``top``: places per item. ``block_terms``: terms of items searched in one pass."""

    top: int = 50
    block_terms: int = 50_000


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: every term of every item once."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(found)).alias("term")).distinct()


def term_counts(text: str) -> Counter:
    """Occurrences of each term (UTF-8), read a slice at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    if len(raw) <= SLICE:
        return Counter(raw.split())
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end + 1
    return counts


def _tally(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term; only asked-for terms are listed."""
    known = {t.encode(): i for i, t in enumerate(terms)}
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, where, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                hits = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                rows.append(i)
                n.append(counts.total())
                where.append([t for t, _ in hits])
                tfs.append([c for _, c in hits])
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            arrays = [pa.array(v, f.type) for v, f in zip((n, where, tfs), schema)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *schema.names])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return arrow_map(keyed, work, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Places:
    """The best documents of one item so far, and how it searches a block of documents."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, top: int):
        self.terms, self.w, self.top = terms, weights[terms], top
        self.best: list[tuple[int, bool, object]] = []

    @property
    def last(self) -> int:
        """The score that a document must reach to take a place."""
        return -self.best[-1][0] if len(self.best) == self.top else 1

    def search(self, tf: np.ndarray, m: np.ndarray, ids: list) -> None:
        """``tf``: terms x documents of a block, ``m``: its documents' length terms."""
        mine = tf[self.terms]
        caps = self.w * _shares(mine.max(axis=1).astype(np.int64), m.min())
        if caps.sum() < self.last:
            return
        # a bit per term, whole documents side by side
        bits = np.packbits(mine > 0, axis=0)
        wide = np.zeros((mine.shape[1], -(-len(bits) // 8) * 8), np.uint8)
        wide[:, : len(bits)] = bits.T
        words = wide.view(np.uint64)
        if words.shape[1] == 1:
            masks, group = np.unique(words[:, 0], return_inverse=True)
            masks = masks[:, None]
        else:
            masks, group = np.unique(words, axis=0, return_inverse=True)
        held = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1)[:, : len(self.terms)]
        bound = held.astype(np.int64) @ caps
        # documents by group, groups by falling bound
        members = np.argsort(group.ravel(), kind="stable")
        sizes = np.bincount(group.ravel(), minlength=len(masks))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-bound, kind="stable")
        at = 0
        while at < len(order) and bound[order[at]] >= self.last:
            taken, n = [], 0
            while at < len(order) and n < STEP and bound[order[at]] >= self.last:
                g = order[at]
                taken.append(members[starts[g] : starts[g] + sizes[g]])
                n += sizes[g]
                at += 1
            docs = np.concatenate(taken)
            score = (self.w[:, None] * _shares(mine[:, docs].astype(np.int64), m[docs])).sum(axis=0)
            ahead = np.flatnonzero(score >= self.last)
            if len(ahead):
                new = [(-int(score[i]), ids[docs[i]] is None, ids[docs[i]]) for i in ahead]
                self.best = sorted(self.best + new, key=lambda x: x if x[2] is not None else (*x[:2], 0))[: self.top]


def _rank(tallied: DataFrame, asked: list, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents per item."""
    rows = max(64, CELLS // max(1, len(weights)))

    def length_term(n: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(n, return_inverse=True)
        return np.array([50 + (50 * int(x) * n_docs) // n_terms for x in distinct], np.int64)[where]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [Places(np.asarray(terms), weights, top) for terms in asked]
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                terms, tfs = part.column("terms"), part.column("tfs")
                doc = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                tf = np.zeros((len(weights), part.num_rows), np.int32)
                tf[terms.flatten().to_numpy(), doc] = tfs.flatten().to_numpy()
                m = length_term(part.column("n").to_numpy())
                ids = part.column("doc_id").to_pylist()
                for p in places:
                    p.search(tf, m, ids)
        out = [(i, b[2], -b[0]) for i, p in enumerate(places) for b in p.best]
        if out:
            item, ids, score = zip(*out)
            arrays = [pa.array(item, pa.int32()), pa.array(ids, kind), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score"])

    kind = tallied.schema["doc_id"].dataType.simpleString()
    return arrow_map(tallied, work, f"item int, doc_id {kind}, score bigint")


def _merge(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows per item, first within slots of it so that no task sorts all tasks' places."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]

    def best(df: DataFrame, *keys: str | Column) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)

    slotted = found.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    return best(best(slotted, "item", "slot").drop("rank", "slot"), "item")


def search(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item.

    ``documents`` has ``doc_id, text`` and ``items`` has ``item_id, text``.
    """
    spark = documents.sparkSession
    wanted = cut(item_terms(items))
    n_blocks = max(1, -(-wanted.count() // settings.block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    results = []
    for b in range(n_blocks):
        mine = [(r.item_id, r.term) for r in wanted.filter(block == b).toLocalIterator()]
        terms = sorted({t for _, t in mine})
        place = {t: i for i, t in enumerate(terms)}
        by_item: dict = {}
        for item, term in mine:
            by_item.setdefault(item, []).append(place[term])
        tallied = cut(_tally(documents, terms))
        n_docs, n_terms = tallied.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for t, c in tallied.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[t] = c
        weights = np.array([weight(n_docs, int(c)) for c in df], np.int64)
        names, asked = list(by_item), [sorted(v) for v in by_item.values()]
        places = _merge(_rank(tallied, asked, weights, n_docs, n_terms, settings.top), settings.top)
        ids = spark.createDataFrame(list(enumerate(names)), wanted.select(F.lit(0).alias("item"), "item_id").schema)
        results.append(places.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found

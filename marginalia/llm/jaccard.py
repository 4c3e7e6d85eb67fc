"""Links and components of documents whose shingle sets have a large Jaccard similarity.

Exact copies share a class; only classes are compared. Similar sets differ in few
shingles, at most H for sets of a range of sizes. So the shingles are dealt by hash into
H + l parts: similar sets agree on at least l parts as a whole. Each class indexes its
H + 1 largest parts; parts that agree have the same place in the order of both sets, so
one of them is among these on both sides. A part is met only by sets that hold all its
shingles and no other of that part, which two sets with common shingles hardly are, however
frequent the shingles; an index entry is therefore one of near copies. Ranges of sizes overlap:
the larger of two similar sets is also indexed in the range of the smaller.

A set also has a mark of ``mark_bits`` bits, each the parity of the shingles that fall on it:
two marks differ in no more bits than the sets in shingles, which rules out pairs that met by
chance before their sets move. Pairs left are verified on whole sets.

Groups of near copies would propose all their pairs. So no pair becomes a row: tasks follow
the marks inside an index entry and name one way from each member to the others, and what hangs
together makes a cluster. The whole sets of a cluster travel once to one task, which compares
members that no link connects yet, the most central ones first. A cluster of more than ``block``
shingles is cut into blocks: each is compared in itself and with the first, then the blocks are made
anew, component by component, and those that hold different components are compared.

Texts that are null or hold no word have an empty set and no links. Repeated rows
are copies of one another. An id that is null has no component. Extra columns are
not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.groups import spread, whole_groups
from marginalia.llm.common import arrow_map, cut, mix, texts
from marginalia.llm.components import components


@dataclass(frozen=True)
class Settings:
    """Link where ``den * intersection >= num * union`` over ``words``-word shingles.

    ``widest``: ratio of the largest to the smallest size in a range. ``block``: shingles of a
    cluster held together by a task, which compares two such blocks at most.
    """

    words: int = 3
    num: int = 90
    den: int = 100
    widest: float = 1.25
    filter_bits: int = 24
    mark_bits: int = 256
    block: int = 500_000

    @property
    def marks(self) -> list[str]:
        """The columns of a mark, 64 bits each."""
        return [f"m{i}" for i in range(self.mark_bits // 64)]


class WordHashes:
    """64-bit hashes of all words of a text at once: polynomials over its bytes.

    A byte stands for a random number; sums over prefixes give any stretch between two
    positions, times an inverse power that takes it back to position 0.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        self.value = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
        self.base = (int(rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 3) % 2**64
        self.space = np.zeros(256, np.uint8)
        self.space[[9, 10, 11, 12, 13, 32]] = 1
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        up = np.full(n, self.base, np.uint64)
        down = np.full(n, pow(self.base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def of(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        n = len(raw)
        if n > len(self.up):
            self._powers(2 * n)
        edges = np.ones(n + 2, np.uint8)
        edges[1:-1] = self.space[raw]
        at = np.flatnonzero(edges[1:] != edges[:-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[:n], out=sums[1:])
        return mix((sums[at[1::2]] - sums[at[::2]]) * self.down[at[::2]])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows over word hashes; all words as one where there are fewer."""
    n, k = max(1, len(h) - k + 1), min(k, len(h))
    out = np.full(n, k, np.uint64)
    for j in range(k):  # word hashes are random, an odd factor keeps their order apart
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct windows."""
    if not len(h):
        return h
    out = np.sort(windows(h, k))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(s: np.ndarray) -> int:
    """64 bits that stand for a set; sets are taken as equal where they agree."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def mark(x: np.ndarray, bits: int) -> np.ndarray:
    """The parity of how many of the distinct hashes ``x`` fall on each bit, as longs."""
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def ranges(n: int, s: Settings) -> list[tuple[int, int]]:
    """The ranges of sizes that sets of ``n`` are indexed in: least size, and H.

    A range holds the sizes of the smaller of two sets, and what sizes similar larger sets have.
    """
    out, low = [], 1
    while low <= n:
        high = max(low, int(low * s.widest) - 1)
        if n * s.num <= high * s.den:
            both = high + high * s.den // s.num
            out.append((low, both * (s.den - s.num) // (s.den + s.num)))
        low = high + 1
    return out


def parts(x: np.ndarray, low: int, most: int) -> np.ndarray:
    """Hashes of the ``most + 1`` largest parts of the sorted distinct hashes ``x``, of which similar sets differ in ``most``.

    Parts of one size are ordered by hash, so equal parts of two sets stand in the same order.
    """
    k = most + 1 + most // 7  # l is an eighth of the parts: those of few shingles are left out
    edges = np.arange(1, k, dtype=np.uint64) * np.uint64(2**64 // k)
    at = np.r_[0, np.searchsorted(x, edges), len(x)]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x * np.uint64(0xD6E8FEB86659FD93)), out=sums[1:])
    names = mix(np.arange(k, dtype=np.uint64) + np.uint64(low << 32))
    found = mix((sums[at[1:]] - sums[at[:-1]]) ^ names)
    return found[np.lexsort((found, np.diff(at)))[k - most - 1 :]]


def _hash_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, text_hash, cid, n`` and the mark of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            cid, n, marks = [], [], np.empty((b.num_rows, len(s.marks)), np.int64)
            for i, t in enumerate(texts(b.column("text"))):
                x = shingles(hashes.of(t), s.words)
                cid.append(signature(x))
                n.append(len(x))
                marks[i] = mark(x, s.mark_bits)
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(cid, pa.int64()), pa.array(n, pa.int64())]
            cols += [pa.array(m) for m in marks.T]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "cid", "n", *s.marks])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return cut(arrow_map(rows, work, "doc_id long, text_hash long, cid long, n long" + "".join(f", {m} long" for m in s.marks)))


def _index(docs: DataFrame, s: Settings) -> DataFrame:
    """Entries ``token, cid``: parts that several classes have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, known = WordHashes(), set(), {}
        cids, tokens, held = [], [], 0

        def flush() -> pa.RecordBatch:
            cid = np.repeat(np.array(cids, np.int64), [len(t) for t in tokens])
            token = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(token)], ["cid", "token"])

        for b in batches:
            for t in texts(b.column("text")):
                x = shingles(hashes.of(t), s.words)
                n = len(x)
                cid = signature(x)
                if cid in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(cid)
                if n not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[n] = ranges(n, s)
                for low, most in known[n]:
                    if most:  # where no shingle may differ, similar sets are equal
                        cids.append(cid)
                        tokens.append(parts(x, low, most))
                        held += len(tokens[-1])
                if held > 100_000:
                    yield flush()
                    cids, tokens, held = [], [], 0
        yield flush()

    entries = arrow_map(docs.select("text"), work, "cid long, token long")
    same = Window.partitionBy("token")
    # copies of a class in other tasks do not make a token a shared one
    entries = entries.withColumn("least", F.min("cid").over(same)).withColumn("most", F.max("cid").over(same))
    return cut(entries.filter("least < most").select("token", "cid").dropDuplicates(["token", "cid"]))


def _needed_sets(docs: DataFrame, cids: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """``cid, items`` of the classes in ``cids``, each read from one of its texts.

    A bit table of fixed size over hashes of these texts lets tasks skip most others;
    the join on the class is exact.
    """
    slot = F.col("text_hash").bitwiseAND(F.lit((1 << s.filter_bits) - 1).cast("long"))
    found = (
        rows.join(cids, "cid", "left_semi")
        .groupBy("cid")
        .agg(F.min("text_hash").alias("text_hash"))
        .select(slot.alias("h"))
        .groupBy(F.shiftright("h", 5).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits"))
        .toArrow()
    )  # 2^filter_bits / 32 rows at most
    table = np.zeros(1 << (s.filter_bits - 5), np.uint32)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits, seen = WordHashes(), sent.value, set()
        for b in batches:
            h = b.column("text_hash").to_numpy() & ((1 << s.filter_bits) - 1)
            hit = np.flatnonzero(bits[h >> 5] >> (h & 31).astype(np.uint32) & np.uint32(1))
            cid, items = [], []
            for t in texts(b.column("text").take(pa.array(hit))):
                x = shingles(hashes.of(t), s.words)
                c = signature(x)
                if len(x) and c not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    cid.append(c)
                    items.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["cid", "items"])

    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    sets = arrow_map(hashed, work, "cid long, items array<long>")
    return cut(sets.join(cids, "cid", "left_semi").groupBy("cid").agg(F.first("items").alias("items")))


def _marks_allow(s: Settings) -> Column:
    """Whether sets whose marks differ as these do can be similar: they differ in as many shingles at least."""
    both = F.col("a_n") + F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in s.marks), F.lit(0))
    return (s.den + s.num) * (both - apart) >= 2 * s.num * both


def _likely(met: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a, b`` whose sizes and marks allow a link."""
    met = met.filter(s.den * F.least("a_n", "b_n") >= s.num * F.greatest("a_n", "b_n"))
    return met.filter(_marks_allow(s)).select("a", "b")


def _followed(entries: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a, b`` that connect what marks and sizes allow to be connected inside each token of ``entries``."""

    def allowed(n: np.ndarray, m: np.ndarray, p, q) -> np.ndarray:
        both = n[p] + n[q]
        apart = np.bitwise_count(m[p] ^ m[q]).sum(axis=-1, dtype=np.int64)
        near = s.den * np.minimum(n[p], n[q]) >= s.num * np.maximum(n[p], n[q])
        return near & ((s.den + s.num) * (both - apart) >= 2 * s.num * both)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["token"]):
            cid, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
            m = np.stack([t.column(c).to_numpy() for c in s.marks], axis=1).view(np.uint64)
            sizes = np.diff(np.r_[at, len(cid)])
            first = np.repeat(at, sizes)
            near = allowed(n, m, first, np.arange(len(cid)))
            done = np.repeat(np.logical_and.reduceat(near, at), sizes)
            a, b = [cid[first[done]]], [cid[done]]
            for i, k in zip(at, sizes):
                if done[i]:
                    continue
                left = np.arange(i, i + k)
                while len(left):
                    ahead, left = [left[0]], left[1:]
                    while ahead and len(left):
                        p = ahead.pop()
                        hit = allowed(n, m, p, left)
                        ahead.extend(left[hit])
                        a.append(np.full(hit.sum(), cid[p]))
                        b.append(cid[left[hit]])
                        left = left[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return arrow_map(entries.repartition("token").sortWithinPartitions("token"), work, "a long, b long")


def _clusters(index: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """``cid, cluster`` of the classes that marks, sizes and common parts connect to others."""
    tokens = cut(index.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("a"), F.max("cid").alias("b")))
    sides = [known.toDF(side, *(f"{side}_{c}" for c in known.columns[1:])) for side in ("a", "b")]
    # most parts have two classes, which share others too
    pairs = _likely(tokens.filter("k = 2").select("a", "b").distinct().join(sides[0], "a").join(sides[1], "b"), s)
    many = index.join(tokens.filter("k > 2").select("token"), "token", "left_semi").join(known, "cid")
    return components(pairs.unionByName(_followed(many, s))).toDF("cid", "cluster")


def links_among(cid: np.ndarray, items: np.ndarray, n: np.ndarray, side: np.ndarray, label: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Links that connect similar sets: ``n`` distinct ``items`` each, one set after the other.

    Sets of one label are connected already. Where there are two sides only sets of different sides are compared.
    """
    at = np.r_[0, np.cumsum(n)]
    values, ids = np.unique(items, return_inverse=True)
    central = np.add.reduceat(np.bincount(ids)[ids], at[:-1]) / n
    holds, open_ = np.zeros(len(values), bool), np.ones(len(n), bool)
    across, label, found = side.min() != side.max(), label.copy(), []
    for p in np.argsort(-central, kind="stable"):
        open_[p] = False
        rest = open_ & (label != label[p]) & (s.den * np.minimum(n, n[p]) >= s.num * np.maximum(n, n[p]))
        if across:
            rest &= side != side[p]
        rest = np.flatnonzero(rest)
        if not len(rest):
            continue
        their = ids[spread(at[rest], n[rest])]
        mine = ids[at[p] : at[p + 1]]
        holds[mine] = True
        inter = np.add.reduceat(holds[their], np.cumsum(n[rest]) - n[rest], dtype=np.int64)
        holds[mine] = False
        hit = rest[(s.den + s.num) * inter >= s.num * (n[p] + n[rest])]
        if len(hit):
            found += [(int(cid[p]), int(cid[q])) for q in hit]
            label[np.isin(label, label[hit])] = label[p]
    return found


GROUP = ["cluster", "i", "j"]


def _compared(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links ``a, b`` among the ``members`` (cid, cluster, i, j, side, label) of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, GROUP):
            cid, side, label = (t.column(c).to_numpy() for c in ("cid", "side", "label"))
            found = []
            for i, j in zip(at, [*at[1:], t.num_rows]):
                some = t.column("items").slice(i, j - i).combine_chunks()
                n = some.value_lengths().to_numpy().astype(np.int64)
                found += links_among(cid[i:j], some.flatten().to_numpy(), n, side[i:j], label[i:j], s)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.join(sets, "cid").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return cut(arrow_map(dealt.select("cid", *GROUP, "side", "label", "items"), work, "a long, b long"))


def _blocks(members: DataFrame, s: Settings, *order: Column | str) -> DataFrame:
    """``members`` with their block and the last one of their cluster, in this order."""
    before = Window.partitionBy("cluster").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / s.block).cast("int")
    placed = members.withColumn("block", block)
    return cut(placed.withColumn("top", F.max("block").over(Window.partitionBy("cluster"))))


def class_components(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Rows ``doc_id, text_hash, cid, n``, and ``cid, component`` of classes with links to others."""
    rows = _hash_sets(docs, s)
    index = _index(docs, s)
    # sizes and marks of the classes that share a part
    known = rows.select("cid", "n", *s.marks).join(index.select("cid").distinct(), "cid", "left_semi")
    known = cut(known.dropDuplicates(["cid"]))
    clusters = cut(_clusters(index, known, s))
    if clusters.isEmpty():
        return rows, None
    sets = _needed_sets(docs, clusters.select("cid"), rows, s)
    members = _blocks(clusters.join(known.select("cid", "n"), "cid"), s, "cid")

    def group(i: Column, j: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), (F.col("block") != i).cast("int").alias("side"))

    own, zero = F.col("block"), F.lit(0)
    groups = F.when(own == 0, F.transform(F.sequence(zero, F.col("top")), lambda j: group(zero, j)))
    groups = groups.otherwise(F.array(group(zero, own), group(own, own)))
    first = members.select("cid", "cluster", F.explode(groups).alias("g"), F.col("cid").alias("label"))
    links = _compared(first.select("cid", "cluster", "g.*", "label"), sets, s)
    if not members.filter("top > 0").isEmpty():
        named = components(links).toDF("cid", "label")
        large = members.filter("top > 0").join(named, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        many = F.count(F.lit(1)).over(Window.partitionBy("cluster", "label"))
        large = _blocks(large.drop("block", "top").withColumn("many", many), s, F.desc("many"), "label", "cid")
        held = cut(large.groupBy("cluster", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
        x, y = held.toDF("cluster", "i", "lo", "hi"), held.toDF("cluster", "j", "y_lo", "y_hi")
        apart = "i <= j and not (lo = hi and y_lo = y_hi and lo = y_lo)"
        pairs = x.join(y, "cluster").filter(apart).select(*GROUP)
        sided = large.join(pairs, "cluster").filter("block = i or block = j")
        sided = sided.select("cid", *GROUP, (own != F.col("i")).cast("int").alias("side"), "label")
        links = links.unionByName(_compared(sided, sets, s))
    if links.isEmpty():
        return rows, None
    return rows, components(links)


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, cid, n_shingles, component_id, component, text_hash`` of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id in a component, and may be that of two if rows repeat an id;
    ``component`` names one only.
    """
    rows, label = class_components(docs, settings)
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"))
    if label is None:
        named = classes.withColumnRenamed("first", "component_id").withColumn("component", F.col("cid"))
    else:
        known = classes.join(label.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        top = known.groupBy("component").agg(F.min("first").alias("component_id"))
        named = known.join(top, "component").select("cid", "component_id", "component")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "cid", "left").select(
        "doc_id", "cid", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        "component", "text_hash",
    )

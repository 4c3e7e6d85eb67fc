"""Align the tokens of two tokenizers over the same bytes, and count linked id pairs.

Tokenizer A is byte-level BPE over a space and the text, tokenizer B a piece model over the
text, which adds that space itself. Byte offsets where tokens of both end cut them into
groups; every A-B pair of occurrences in a group is a link.

Both tokenizers always end a token before a single space or line feed that stands between
two characters that are not white space: no pattern of A reaches across, no piece of B
holds such a place (checked when the model is loaded). Between two such safe points bytes
can be aligned on their own. So a range of bytes is a :class:`Fragment`: an open prefix up
to its first safe point, closed groups, and an open suffix from its last one. Putting two
fragments side by side closes what lies between the outer safe points; the operation is
associative, its identity is the empty fragment. Texts of more than ``chunk`` bytes are cut
into ranges of that size that any task may take; open ends travel up a tree of Spark
groups of ``FAN`` neighbours, and closed groups stay where they were found.

A first pass aligns and writes, per document, its figures and its linked id pairs. Pairs are
counted by documents over that table. The most frequent pairs, at most ``hot`` of them, go
to every task of the second pass; all other pairs are joined by a shuffle.

Null and empty texts, and texts that B changes, have no tokens: zeros and ''. Repeated rows
are documents of their own. Texts of any length are taken; one without any safe point
is aligned whole in one task. Ties for the highest count are all highest. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, texts
from marginalia.llm.pretok import PATTERN

#: Stretches between safe points a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 400_000
#: Neighbouring fragments composed by one call.
FAN = 16
#: Code points of texts handled at a time.
SLICE = 1_000_000
#: Groups of more links than this are counted by id instead of link by link.
FEW_LINKS = 64
#: Steps a factor of two of the count is divided into to find the most frequent pairs.
GRADES = 16

_unit = re.compile(r"\s+\S+|\s+\Z")
_odd = re.compile(r"\s\s|[^\S \n]|\s\Z")
_safe = re.compile(r"(?<=\S)(?=[ \n]\S)")


@dataclass(frozen=True)
class Settings:
    """``chunk``: bytes of a range of a long text. ``hot``: pairs that every task may hold."""

    chunk: int = 1 << 16
    hot: int = 1 << 20


class Fragment(NamedTuple):
    """A range of bytes of one text as far as its own safe points show.

    Without a safe point (``cut`` false) all of it is open and stands in ``left``. ``closed``
    holds what lies between the first and the last safe point.
    """

    cut: bool
    left: str
    closed: str
    right: str


def fragment(text: str) -> Fragment:
    first = _safe.search(text)
    if first is None:
        return Fragment(False, text, "", "")
    a, b = first.start(), len(text)
    # the last safe point: look at ever longer tails
    tail = 64
    while True:
        at = max(a, b - tail)
        # a point is recognised by the character before it
        found = [m.start() for m in _safe.finditer(text, max(0, at - 1))]
        if found:
            z = found[-1]
            break
        tail *= 8
    return Fragment(True, text[:a], text[a:z], text[z:])


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, str]:
    """``x`` and ``y`` side by side, and the text that their meeting closed.

    The result's own ``closed`` is empty: closed parts stay with their finder.
    """
    middle = (x.right if x.cut else x.left) + y.left
    if x.cut and y.cut:
        return Fragment(True, x.left, "", y.right), middle
    seam = fragment(middle)
    if x.cut:
        if not seam.cut:
            return Fragment(True, x.left, "", middle), ""
        return Fragment(True, x.left, "", seam.right), seam.left + seam.closed
    if y.cut:
        if not seam.cut:
            return Fragment(True, middle, "", y.right), ""
        return Fragment(True, seam.left, "", y.right), seam.closed + seam.right
    return Fragment(seam.cut, seam.left, "", seam.right), seam.closed


def units(text: str) -> list[str]:
    """The stretches of ``text`` between its safe points; ``text`` starts at one."""
    found = _unit.findall(text)
    if not _odd.search(text):
        return found
    out: list[list[str]] = []
    for u in found:
        if out and (u[0] not in " \n" or len(u) < 2 or u[1].isspace()):
            out[-1].append(u)
        else:
            out.append([u])
    return ["".join(u) for u in out]


class Grown:
    """A growing array of longs."""

    def __init__(self):
        self.n, self.data = 0, np.zeros(1 << 16, np.int64)

    def extend(self, values: list[int] | np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Figures(NamedTuple):
    """What a list of texts holds, row by row; pairs lie between ``offsets``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    bad: np.ndarray
    groups: list[str]
    offsets: np.ndarray
    codes: np.ndarray
    mults: np.ndarray


class Aligner:
    """Both tokenizers, and the stretches aligned so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        from marginalia.llm.bpe import encoder

        table = encoder(a_path)
        ranks = {b: i for i, b in table.bytes_of.items() if i not in table.special.values()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        n = max(ranks.values()) + 1
        self.a_len = np.zeros(n, np.int64)
        self.a_len[list(ranks.values())] = [len(b) for b in ranks]
        # an id as it is written inside a group's list, and at the list's end
        self.a_word = np.array([[f"{i},", f"{i}|"] for i in range(n)], object)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece of the model reaches across a safe point")
        as_byte = re.compile(r"<0x([0-9A-F]{2})>\Z")
        self.b_bytes = [
            bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := as_byte.match(p)) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.b_size = len(pieces)
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int64)
        self.b_word = np.array([[f"{i},", f"{i};"] for i in range(len(pieces))], object)
        self.codes = n * self.b_size
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.counts = Grown()  # a, b, groups, links, bad of each stretch
        self.starts = Grown()
        self.pair, self.mult = Grown(), Grown()

    def _good(self, new: list[str], theirs: list[list[int]]) -> np.ndarray:
        """Which stretches the model leaves as they are."""
        spelled = self.b_bytes
        if b"".join([spelled[t] for t in chain.from_iterable(theirs)]) == "".join(new).encode("utf-8", "surrogatepass"):
            return np.ones(len(new), bool)
        return np.array([
            b"".join([spelled[t] for t in b]) == u.encode("utf-8", "surrogatepass") for u, b in zip(new, theirs)
        ], bool)

    def learn(self, new: list[str]) -> None:
        """Align stretches not met before, all of them as one run of bytes."""
        # between these A ends its tokens anyway, so it may read them in one go
        plain = [u for u in new if len(u) > 1 and not u[1].isspace() and not u[-1].isspace()]
        odd = [u for u in new if len(u) < 2 or u[1].isspace() or u[-1].isspace()]
        new = plain + odd
        # the model puts a space in front: it stands for the stretch's own, or is dropped
        theirs = self.b.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1)
        theirs = [b if u[0] == " " else b[1:] for u, b in zip(new, theirs)]
        good = self._good(new, theirs)
        for u in (u for u, g in zip(new, good) if not g):
            self.index[u] = len(self.strings)
            self.strings.append("")
            self.starts.extend([self.pair.n])
            self.counts.extend([0, 0, 0, 0, 1])
        if not good.all():
            plain, odd = ([u for u in part if u not in self.index] for part in (plain, odd))
            new, theirs = plain + odd, [b for b, g in zip(theirs, good) if g]
        if not new:
            return
        ids = self.a.encode_ordinary("".join(plain))
        for u in odd:
            ids += self.a.encode_ordinary(u)
        a, b = np.array(ids, np.int64), np.fromiter(chain.from_iterable(theirs), np.int64)
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        end = np.cumsum([len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in new])
        at = np.zeros(end[-1] + 1, bool)
        at[end_a] = True
        both = at[end_b]
        cuts = end_b[both]
        at[:] = False
        at[cuts] = True
        if not at[end].all():
            raise ValueError("a token reaches across a safe point")
        # groups end with these tokens; their first tokens and sizes
        stop_a, stop_b = np.searchsorted(end_a, cuts) + 1, np.flatnonzero(both) + 1
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        last = np.searchsorted(cuts, end) + 1  # groups up to the end of each stretch
        links = n_a * n_b
        per_group = np.stack([n_a, n_b, np.ones_like(n_a), links, np.zeros_like(n_a)], axis=1)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(per_group, axis=0)])
        counts = np.diff(sums[last], axis=0, prepend=0)
        codes, mults, size = self._pairs_of(a, b, stop_a - n_a, stop_b - n_b, n_a, n_b, links)
        ends = np.concatenate([[0], np.cumsum(size)])[last]
        base = self.pair.n
        self.starts.extend(base + np.concatenate([[0], ends[:-1]]))
        self.pair.extend(codes)
        self.mult.extend(mults)
        self.counts.extend(counts.ravel())
        first = len(self.strings)
        self.strings += self._written(a, b, stop_a, stop_b, n_a, n_b, last)
        self.index.update(zip(new, range(first, first + len(new))))

    def _pairs_of(self, a, b, start_a, start_b, n_a, n_b, links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked id pairs with their numbers, group by group, and how many entries a group has."""
        many = {}
        size = links.copy()
        for g in np.flatnonzero(links > FEW_LINKS).tolist():
            xs, k = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
            ys, m = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
            many[g] = (np.add.outer(xs * self.b_size, ys).ravel(), np.multiply.outer(k, m).ravel())
            size[g] = len(xs) * len(ys)
        begin = np.cumsum(size) - size
        few = np.where(links > FEW_LINKS, 0, links)
        group = np.repeat(np.arange(len(few)), few)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(few) - few, few)
        x, y = start_a[group] + nth // n_b[group], start_b[group] + nth % n_b[group]
        codes, mults = np.empty(size.sum(), np.int64), np.ones(size.sum(), np.int64)
        codes[begin[group] + nth] = a[x] * self.b_size + b[y]
        for g, (c, m) in many.items():
            codes[begin[g] : begin[g] + size[g]], mults[begin[g] : begin[g] + size[g]] = c, m
        return codes, mults, size

    def _written(self, a, b, stop_a, stop_b, n_a, n_b, last) -> list[str]:
        """The groups of each stretch as text."""
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[stop_a - 1] = ends_b[stop_b - 1] = 1
        # in the order of the text: a group's A ids, then its B ids
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.repeat(stop_b - n_b, n_a)] = self.a_word[a, ends_a]
        words[np.arange(len(b)) + np.repeat(stop_a, n_b)] = self.b_word[b, ends_b]
        words = words.tolist()
        stops = (stop_a + stop_b)[last - 1].tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip([0, *stops], stops)]

    def figures(self, pieces: list[str]) -> Figures:
        """Of texts that start and end at safe points or at the ends of a document."""
        split = [units(p) for p in pieces]
        every = list(chain.from_iterable(split))
        found = list(map(self.index.get, every))
        new = {u for u, i in zip(every, found) if i is None}
        if new:
            if len(self.index) + len(new) > REMEMBERED:
                self.forget()
                new = set(every)
            self.learn(list(new))
            found = list(map(self.index.__getitem__, every))
        lengths = np.array([len(s) for s in split], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.array(found, np.int64)
        counts = self.counts.data[: self.counts.n].reshape(-1, 5)[flat]
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(counts, axis=0)])
        n_a, n_b, n_groups, n_links, bad = (sums[ends[1:]] - sums[ends[:-1]]).T
        strings = self.strings
        groups = [";".join([strings[i] for i in flat[s:e].tolist()]) for s, e in zip(ends, ends[1:])]
        # stretches of a row, each once with its number; then their pairs, each once with its sum
        row = np.repeat(np.arange(len(pieces)), lengths)
        n = len(strings)
        key, times = np.unique(row * n + flat, return_counts=True)
        row, stretch = np.divmod(key, n) if n else (key, key)
        start = self.starts.data[: self.starts.n]
        stop = np.append(start[1:], self.pair.n)
        size = (stop - start)[stretch]
        shift = np.cumsum(size) - size
        where = np.repeat(start[stretch] - shift, size) + np.arange(size.sum())
        key = np.repeat(row, size) * self.codes + self.pair.data[where]
        mult = self.mult.data[where] * np.repeat(times, size)
        order = np.argsort(key, kind="stable")
        key, mult = key[order], mult[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        mult = np.add.reduceat(mult, first) if len(key) else mult
        row, codes = np.divmod(key[first], self.codes)
        offsets = np.searchsorted(row, np.arange(len(pieces) + 1))
        return Figures(n_a, n_b, n_groups, n_links, bad > 0, groups, offsets, codes, mult)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _slices(rows: list[str]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(rows):
        total += len(t)
        if total >= SLICE:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(rows):
        yield first, len(rows)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PAIRS = "codes array<bigint>, mults array<bigint>"


def _lists(found: Figures) -> tuple[pa.Array, pa.Array]:
    at = pa.array(found.offsets, pa.int32())
    return tuple(pa.ListArray.from_arrays(at, pa.array(v, pa.int64())) for v in (found.codes, found.mults))


def _whole(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents of at most one range, aligned in the task that reads them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id", *COUNTS, "groups_sha256", "codes", "mults"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = [" " + t if t else "" for t in texts(batch.column("text"))]
            for i, j in _slices(rows):
                found = tool.figures(rows[i:j])
                good = ~found.bad & (found.n_a > 0)
                counts = [pa.array(np.where(good, c, 0)) for c in found[:4]]
                digest = [hashlib.sha256(g.encode()).hexdigest() if k else "" for g, k in zip(found.groups, good)]
                if found.bad.any():
                    keep = np.repeat(good, np.diff(found.offsets))
                    ends = np.concatenate([[0], np.cumsum(np.where(good, np.diff(found.offsets), 0))])
                    found = found._replace(codes=found.codes[keep], mults=found.mults[keep], offsets=ends)
                key = pa.array(np.arange(done, done + j - i), pa.int64())
                done += j - i
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays([key, ids, *counts, pa.array(digest, pa.string()), *_lists(found)], names)

    ddl = f"key bigint, doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + f", groups_sha256 string, {PAIRS}"
    return arrow_map(docs, work, ddl)


# ---- long documents ----------------------------------------------------------
def _ranges(docs: DataFrame, chunk: int) -> DataFrame:
    """``key, doc_id, seq, text``: a space and the text of each document in ranges of ``chunk`` bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, text in enumerate(texts(batch.column("text"))):
                raw = (" " + text).encode("utf-8", "surrogatepass")
                start = seq = 0
                while start < len(raw):
                    end = min(len(raw), start + chunk)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end += 1
                    piece = raw[start:end].decode("utf-8", "surrogatepass")
                    arrays = [pa.array([n], pa.int64()), batch.column("doc_id").slice(i, 1)]
                    arrays += [pa.array([seq], pa.int64()), pa.array([piece], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "seq", "text"])
                    start, seq = end, seq + 1
                n += 1

    return arrow_map(docs, work, f"key bigint, doc_id {kind}, seq bigint, text string")


CLOSED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, bad boolean, groups string, " + PAIRS
OPEN = "cut boolean, `left` string, `right` string"


def _closed(found: Figures) -> list[pa.Array]:
    counts = [pa.array(c, pa.int64()) for c in found[:4]]
    return [*counts, pa.array(found.bad, pa.bool_()), pa.array(found.groups, pa.string()), *_lists(found)]


def _leaves(ranges: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The fragment of each range, with its closed groups aligned."""
    kind = ranges.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id", "pos", "seq", "cut", "left", "right"]
    names += [*COUNTS, "bad", "groups", "codes", "mults"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                f = fragment(row.column("text")[0].as_py())
                seq = row.column("seq")[0].as_py()
                ends = [pa.array([f.cut]), pa.array([f.left]), pa.array([f.right])]
                arrays = [row.column("key"), row.column("doc_id"), pa.array([2 * seq + 1]), row.column("seq"), *ends]
                yield pa.RecordBatch.from_arrays(arrays + _closed(tool.figures([f.closed])), names)

    return arrow_map(ranges, work, f"key bigint, doc_id {kind}, pos bigint, seq bigint, {OPEN}, {CLOSED}")


def _compose_round(ends: DataFrame, paths: tuple[str, str], end: int | None) -> DataFrame:
    """``FAN`` neighbours become one fragment; what their meeting closes is aligned.

    In the last round whole documents come out, whose two ends close what is still open;
    ``end`` is a position after all others then.
    """
    kind = ends.schema["doc_id"].dataType.simpleString()
    schema = f"key bigint, doc_id {kind}, pos bigint, seq bigint, {OPEN}, {CLOSED}"
    columns = ["key", "doc_id", "pos", "seq", "cut", "left", "right", *COUNTS, "bad", "groups", "codes", "mults"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        head, whole, found = next(rows.itertuples()), None, []
        doc_id = None if pd.isna(head.doc_id) else head.doc_id
        for r in rows.itertuples():
            mine = Fragment(bool(r.cut), r.left, "", r.right)
            if whole is None:
                whole = mine
                continue
            whole, text = compose(whole, mine)
            found.append((2 * r.first, text))
        if end is not None:
            found += [(-1, whole.left), (end, whole.right)]
        found = [(p, t) for p, t in found if t]
        out = []
        if end is None:
            out.append((head.key, doc_id, None, head.group, whole.cut, whole.left, whole.right, *[None] * 8))
        if found:
            f = aligner(*paths).figures([t for _, t in found])
            for i, (pos, _) in enumerate(found):
                s, e = f.offsets[i], f.offsets[i + 1]
                figures = [int(c[i]) for c in f[:4]] + [bool(f.bad[i]), f.groups[i], f.codes[s:e].tolist(), f.mults[s:e].tolist()]
                out.append((head.key, doc_id, pos, None, None, None, None, *figures))
        return pd.DataFrame(out, columns=columns, dtype=object)

    placed = ends.withColumn("group", F.floor(F.col("seq") / FAN).cast("bigint"))
    return placed.groupBy("key", "group").applyInPandas(work, schema)


def _long(docs: DataFrame, paths: tuple[str, str], chunk: int) -> DataFrame | None:
    """``key, doc_id, pos`` and the closed groups of long documents, as written tables."""
    ranges = cut(_ranges(docs, chunk))
    deepest = ranges.agg(F.max("seq")).first()[0]
    if deepest is None:
        return None
    leaves = cut(_leaves(ranges.repartition("key", "seq"), paths))
    closed_columns = ["key", "doc_id", "pos", *COUNTS, "bad", "groups", "codes", "mults"]
    closed = leaves.filter("groups <> '' or bad").select(*closed_columns)
    ends = leaves.select("key", "doc_id", "seq", F.col("seq").alias("first"), "cut", "left", "right")
    width = deepest + 1
    step = 1
    while True:
        last = width <= FAN
        rows = cut(_compose_round(ends, paths, 2 * deepest + 3 if last else None))
        closed = closed.unionByName(rows.filter("pos is not null").select(*closed_columns))
        if last:
            break
        step *= FAN
        open_ends = rows.filter("pos is null")
        ends = open_ends.select(
            "key", "doc_id", "seq", (F.col("seq") * step).alias("first"), "cut", "left", "right"
        )
        width = -(-width // FAN)
    return closed


def _pairs(short: DataFrame, closed: DataFrame | None) -> DataFrame:
    """``code, docs, best``: how many documents hold a pair, and whether none of its A id's pairs is held by more."""
    held = short.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("docs"))
    if closed is not None:
        more = closed.select("key", F.explode("codes").alias("code")).distinct()
        held = held.unionByName(more.groupBy("code").agg(F.count(F.lit(1)).alias("docs")))
        held = held.groupBy("code").agg(F.sum("docs").alias("docs"))
    return held


def _grade(docs: str = "docs"):
    return F.floor(F.log2(docs) * GRADES).cast("int")


def _hot(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """At most ``most`` pairs, the most frequent ones by grades of the count, and the others if any."""
    grades = sorted(pairs.groupBy(_grade().alias("g")).count().collect(), key=lambda r: -r["g"])
    total, least = 0, None
    for r in grades:
        total += r["count"]
        if total > most:
            return pairs.filter(_grade() > r["g"]), pairs.filter(_grade() <= r["g"])
        least = r["g"]
    return pairs, None


def _scored(rows: DataFrame, hot: pa.Table, cold: DataFrame | None) -> DataFrame:
    """``rows`` with ``n_best, count_sum`` instead of their pairs."""
    spark = rows.sparkSession
    code = hot.column("code").to_numpy()
    order = np.argsort(code)
    sent = spark.sparkContext.broadcast(
        (code[order], hot.column("docs").to_numpy()[order], hot.column("best").to_numpy(zero_copy_only=False)[order])
    )
    kept = [c for c in rows.columns if c not in ("codes", "mults")]
    rest = cold is not None
    names = [*kept, "n_best", "count_sum"] + (["codes", "mults"] if rest else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            lists = batch.column("codes")
            codes, mults = lists.flatten().to_numpy(), batch.column("mults").flatten().to_numpy()
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes
                n_best, total = np.where(hit & best[at], mults, 0), np.where(hit, mults * docs[at], 0)
            else:
                hit, n_best, total = np.zeros(len(codes), bool), np.zeros_like(mults), np.zeros_like(mults)

            def by_row(v: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(v)])
                return sums[ends[1:]] - sums[ends[:-1]]

            arrays = [batch.column(c) for c in kept] + [pa.array(by_row(v), pa.int64()) for v in (n_best, total)]
            if rest:
                at = pa.array(by_row(~hit).cumsum(), pa.int32())
                at = pa.concat_arrays([pa.array([0], pa.int32()), at])
                arrays += [pa.ListArray.from_arrays(at, pa.array(v[~hit], pa.int64())) for v in (codes, mults)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_best bigint, count_sum bigint"
    found = arrow_map(rows, work, ddl + (f", {PAIRS}" if rest else ""))
    if cold is None:
        return found
    found = cut(found.withColumn("row", F.struct(*(["key", "pos"] if "pos" in kept else ["key"]))))
    left = found.select("row", F.explode(F.arrays_zip("codes", "mults")).alias("p"))
    left = left.select("row", F.col("p.codes").alias("code"), F.col("p.mults").alias("mult"))
    sums = left.join(cold, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("mult")).otherwise(0)).alias("more_best"),
        F.sum(F.col("mult") * F.col("docs")).alias("more_sum"),
    )
    return found.join(sums, "row", "left").select(
        *kept,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


RESULT = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]


def align(documents: DataFrame, a_path: str, b_path: str, settings: Settings = Settings()) -> DataFrame:
    """One row per document: tokens, groups, links, links with the best count, sum of counts, digest of the groups."""
    paths = (a_path, b_path)
    docs = documents.select("doc_id", "text")
    is_long = F.octet_length(F.coalesce("text", F.lit(""))) > settings.chunk
    short = cut(_whole(docs.filter(~is_long), paths))
    closed = _long(docs.filter(is_long), paths, settings.chunk)
    if closed is not None:
        bad = closed.filter("bad").select("key").distinct()
        good = closed.join(bad, "key", "left_anti")
    counted = cut(_pairs(short, good if closed is not None else None))
    a_id = F.floor(F.col("code") / F.lit(piece_count(b_path)))
    # an A id has at most as many pairs as the model has pieces
    top = F.max("docs").over(W.partitionBy(a_id))
    pairs = cut(counted.withColumn("best", F.col("docs") == top))
    hot, cold = _hot(pairs, settings.hot)
    sent = hot.toArrow()
    out = _scored(short, sent, cold).select(*RESULT)
    if closed is None:
        return out
    parts = _scored(good, sent, cold)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "groups")))
    whole = parts.groupBy("key", "doc_id").agg(
        *(F.sum(c).alias(c) for c in [*COUNTS, "n_best", "count_sum"]),
        F.sha2(F.array_join(F.transform(ordered, lambda g: g["groups"]), ";"), 256).alias("groups_sha256"),
    )
    none = closed.join(bad, "key", "left_semi").select("key", "doc_id").distinct().select(
        "doc_id", *(F.lit(0).cast("bigint").alias(c) for c in [*COUNTS, "n_best", "count_sum"]), F.lit("").alias("groups_sha256")
    )
    return out.unionByName(whole.select(*RESULT)).unionByName(none.select(*RESULT))


def piece_count(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()

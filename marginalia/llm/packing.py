"""Pack token pieces into sequences by a dot-product heuristic over several limits.

Every example has a vector: tokens, one segment, loss-bearing tokens. A task keeps
a pool of examples and one open sequence; the example whose vector has the largest
dot product with what is left of the sequence's limits is placed next. If none
fits, the best one is cut so that it fills the sequence exactly and its rest goes
back to the pool. Tokens, segments and loss-bearing tokens never exceed a limit.

What a task has left at its end is shorter than a sequence; it is split at powers
of two, which need no padding. Pool and open sequence are bounded, so memory does
not grow with the input, and no example moves between tasks.

Null texts are empty: they have only their end id. Repeated rows are packed as
often as they occur; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, texts
from marginalia.llm.pretok import PATTERN, chunks

#: Chunks a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``pool``: examples a task chooses from."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    pool: int = 256


class Packer:
    """Places examples ``(key, tokens, first_loss)``; yields ``(key, start, length, sequence, offset)``.

    Tokens of an example from its ``first_loss``-th on bear loss; a prompt before
    them does not.
    """

    def __init__(self, limits: Limits):
        self.lim = limits
        n = limits.pool
        self.keys: list[object] = [None] * n
        self.start = np.zeros(n, np.int64)  # first token not yet placed
        self.left = np.zeros(n, np.int64)
        self.quiet = np.zeros(n, np.int64)  # tokens before the first loss-bearing one
        self.free = list(range(n))
        self.sequence = 0
        self._open()

    def _open(self) -> None:
        self.room, self.slots, self.loss, self.used = self.lim.tokens, self.lim.segments, self.lim.loss_tokens, 0

    def add(self, key: object, tokens: int, first_loss: int) -> Iterator[tuple]:
        at = 0
        while tokens - at >= self.lim.tokens and self.lim.loss_tokens >= self.lim.tokens:
            # a whole sequence of its own, beside the open one
            yield key, at, self.lim.tokens, ("full", key, at), 0
            at += self.lim.tokens
        if tokens - at > 0:
            i = self.free.pop()
            self.keys[i], self.start[i], self.left[i], self.quiet[i] = key, at, tokens - at, max(0, first_loss - at)
            if not self.free:
                yield from self._fill(one=True)

    def finish(self) -> Iterator[tuple]:
        while len(self.free) < self.lim.pool:
            yield from self._fill(one=False)

    def _fill(self, one: bool) -> Iterator[tuple]:
        """Place examples until a place in the pool is free (``one``) or a sequence is closed."""
        lim = self.lim
        while len(self.free) < lim.pool:
            loss = np.maximum(0, self.left - self.quiet)
            fits = (self.left > 0) & (self.left <= self.room) & (loss <= self.loss)
            gain = (self.left / lim.tokens) * (self.room / lim.tokens) + (1 / lim.segments) * (self.slots / lim.segments)
            gain = gain + (loss / lim.loss_tokens) * (self.loss / lim.loss_tokens)
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, -1.0)))
                n = int(self.left[i])
            else:
                i = int(np.argmax(np.where(self.left > 0, gain, -1.0)))
                n = int(min(self.left[i], self.room, self.quiet[i] + self.loss))
            yield self.keys[i], int(self.start[i]), n, self.sequence, self.used
            self.loss -= max(0, n - int(self.quiet[i]))
            self.quiet[i] = max(0, int(self.quiet[i]) - n)
            self.start[i] += n
            self.left[i] -= n
            self.room -= n
            self.used += n
            self.slots -= 1
            if self.room == 0 or self.slots == 0 or self.loss == 0:
                self.sequence += 1
                self._open()
                closed = True
            else:
                closed = False
            if self.left[i] == 0:
                self.keys[i] = None
                self.free.append(i)
                if one:
                    return
            if closed and not one:
                return


def placed(pieces_in: Iterable[tuple], limits: Limits, tail: bool = True) -> Iterator[tuple]:
    """Pieces with sequences numbered from 0; ``tail`` splits short sequences at powers of two."""
    nxt = 0
    current: list[tuple] = []

    def short(group: list[tuple]) -> Iterator[tuple]:
        nonlocal nxt
        total = sum(p[2] for p in group)
        if not tail or total == limits.tokens:
            for key, start, n, _, off in group:
                yield key, start, n, nxt, off
            nxt += 1
            return
        rest = total
        size = 1 << (rest.bit_length() - 1)
        room, off = size, 0
        for key, start, n, _, _ in group:
            while n > 0:
                take = min(n, room)
                yield key, start, take, nxt, off
                start, n, room, off, rest = start + take, n - take, room - take, off + take, rest - take
                if room == 0:
                    nxt += 1
                    if rest:
                        size = 1 << (rest.bit_length() - 1)
                    room, off = size, 0

    for p in pieces_in:
        if isinstance(p[3], tuple):
            yield p[0], p[1], p[2], nxt, 0
            nxt += 1
            continue
        if current and current[-1][3] != p[3]:
            yield from short(current)
            current = []
        current.append(p)
    if current:
        yield from short(current)


def pack(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack rows ``(key, tokens, first_loss)``: ``key, start, length, sequence_id, offset`` per piece.

    Rows with null or no tokens have no piece; a null ``first_loss`` counts as 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer = Packer(limits)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, tokens, first in zip(*(b.column(c).to_pylist() for c in ("key", "tokens", "first_loss"))):
                    yield from packer.add(key, tokens or 0, first or 0)
            yield from packer.finish()

        for chunk in chunked(placed(rows(), limits)):
            key, start, n, seq, off = zip(*chunk)
            cols = [pa.array(key, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, n, [base + s for s in seq], off))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "start", "length", "sequence_id", "offset"])

    rows = examples.select(F.col("key").cast("long"), F.col("tokens").cast("long"), F.col("first_loss").cast("long"))
    return arrow_map(rows, work, "key long, start long, length long, sequence_id long, offset long")


def chunked(rows: Iterable[tuple], size: int = 8192) -> Iterator[list[tuple]]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


class CachedTokenizer:
    """Ids of a byte-level vocabulary file in the format of the tokenizers library.

    Chunks of text are looked up; new ones are encoded by tiktoken's engine, filled from the
    same file, which gives the same ids about ten times as fast (tests compare both).
    """

    def __init__(self, path: str):
        import tiktoken

        from marginalia.llm.bpe import encoder

        table = encoder(path)
        ranks = {b: i for i, b in table.bytes_of.items() if i not in table.special.values()}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special, self.marks = table.special, table.marks
        self.chunk_ids: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        encode = self.engine.encode_ordinary
        for c in new:
            self.chunk_ids[c] = array("I", encode(c)).tobytes()

    def ids(self, batch: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for text in batch:
            at = [t for t in self.special if t in text]
            if at:
                yield self._with_special(text)
            else:
                yield self._plain(text)

    def _plain(self, text: str) -> bytes:
        parts = chunks(text)
        seen = self.chunk_ids
        new = set(parts).difference(seen)
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = set(parts)
            self._learn(new)
        return b"".join(map(seen.__getitem__, parts))

    def _with_special(self, text: str) -> bytes:
        mark = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        return b"".join(mark[p] if i % 2 else self._plain(p) for i, p in enumerate(self.marks.split(text)))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def pack_documents(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), digest: bool = True) -> DataFrame:
    """Tokenize, close each document with ``end_id`` and pack; one row per piece.

    A document's first token has nothing before it to be predicted from and bears
    no loss, all others do. ``digest`` adds the CRC of a piece's ids, else the ids
    themselves are returned.
    """
    last = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        tok, packer = tokenizer(path), Packer(limits)

        def rows() -> Iterator[tuple]:
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                for doc, raw in zip(ids, tok.ids(texts(b.column("text")))):
                    raw += last
                    yield from packer.add((doc, raw), len(raw) // 4, 1)
            yield from packer.finish()

        for chunk in chunked(placed(rows(), limits)):
            doc, start, n, seq, off, total, crc = [], [], [], [], [], [], []
            for (d, raw), s, k, q, o in chunk:
                piece = raw[4 * s : 4 * (s + k)]
                doc.append(d)
                start.append(s)
                n.append(k)
                seq.append(base + q)
                off.append(o)
                total.append(len(raw) // 4)
                crc.append(zlib.crc32(piece) if digest else np.frombuffer(piece, "<u4").astype(np.int64))
            what = pa.array(crc, pa.int64() if digest else pa.list_(pa.int64()))
            ints = [pa.array(x, pa.int64()) for x in (doc, start, n)]
            more = [pa.array(x, pa.int64()) for x in (total, seq, off)]
            names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*ints, what, *more], names)

    kind = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)

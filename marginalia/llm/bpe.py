"""Byte-level BPE by a pair occurrence index, and its inverse.

A task collects the distinct pieces of its texts that it has not met yet and lays
their symbols out one behind another, with the rank of every adjacent pair. The pair
of lowest rank of each piece is merged at all its positions, the neighbours' ranks
are updated, and the next rank follows; all pieces of a round move together. Pieces
of more than ``LONG`` bytes, which would need many rounds, are linked lists instead:
an index maps every adjacent pair to the positions where it stands.

Null texts count as empty and have no ids. Rows are handled one by one: repeated
ids, ties and extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, texts
from marginalia.llm.pretok import chunks, pieces

#: Pieces and chunks a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 400_000
#: Bytes of a piece that is still merged in rounds with others.
LONG = 64
#: Above every rank: two symbols that are never merged.
NEVER = 2**31 - 1


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexEncoder:
    """Encoder and decoder for one vocabulary file with merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.start = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pair_of = {rank: pair for pair, (rank, _) in self.ranks.items()}
        # the same as arrays, for many pairs at once: sorted pairs, and a table of the pairs of bytes
        order = sorted(self.ranks)
        self.pair_keys = np.array([a << 32 | b for a, b in order] + [2**63 - 1], np.int64)
        self.pair_ranks = np.array([self.ranks[p][0] for p in order] + [NEVER], np.int32)
        self.made = np.zeros(len(spec["model"]["merges"]), np.int32)
        self.made[self.pair_ranks[:-1]] = [self.ranks[p][1] for p in order]
        self.byte_ids = np.array(self.start, np.int32)
        self.byte_ranks = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # the longest of those that begin at one place
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunk_ids = self._no_chunks()

    def _no_chunks(self) -> dict[str | int, tuple[int, ...]]:
        """The ids of chunks before any is learned: special tokens stand for themselves."""
        return {i: (i,) for i in self.special.values()}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NEVER))

    def merge_pieces(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [i for i, r in enumerate(raw) if len(r) > LONG]
        out = self._merge_rounds([r for r in raw if len(r) <= LONG] if long else raw)
        if long:
            rest, behind = iter(out), set(long)
            merged = iter(self._merge_index([raw[i] for i in long]))
            out = [next(merged if i in behind else rest) for i in range(len(raw))]
        return out

    def _merge_rounds(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; a round merges the best pair of every piece."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = np.frombuffer(b"".join(raw), np.uint8)
        piece = np.repeat(np.arange(len(raw)), sizes)
        sym = self.byte_ids[joined]
        rank = np.full(len(sym), NEVER, np.int32)
        inside = np.flatnonzero(piece[1:] == piece[:-1])  # a piece's last symbol begins no pair
        rank[inside] = self.byte_ranks[joined[inside].astype(np.int32) * 256 + joined[inside + 1]]
        done_sym, done_piece = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            live = best != NEVER
            done_sym.append(sym[~live])
            done_piece.append(piece[~live])
            sym, piece, rank = sym[live], piece[live], rank[live]
            hit = rank == best[live]
            at = np.flatnonzero(hit)
            if (near := at[1:] == at[:-1] + 1).any():  # of a run a a a a, every other pair
                run = np.r_[True, ~near]
                begin = np.maximum.accumulate(np.where(run, at, 0))
                at = at[(at - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, piece = sym[keep], piece[keep]
            rank = rank[keep]
            touched = np.concatenate((new, new[new > 0] - 1))
            touched = touched[touched < len(sym) - 1]
            rank[new] = NEVER
            touched = touched[piece[touched] == piece[touched + 1]]
            rank[touched] = self._rank(sym[touched], sym[touched + 1])
        ids, of = np.concatenate([*done_sym, sym]), np.concatenate([*done_piece, piece])
        ids = ids[np.argsort(of, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(of, minlength=len(raw))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def _merge_index(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, by one index over all of them."""
        ranks, pair_of = self.ranks, self.pair_of
        sym: list[int] = []
        heads = []
        for r in raw:
            heads.append(len(sym))
            sym += [self.start[b] for b in r]
            sym.append(-1)  # no pair crosses the end of a piece
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        where: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:])):
            if (hit := ranks.get(pair)) is not None:
                where.setdefault(hit[0], []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b = pair_of[rank]
            new = ranks[a, b][1]
            for i in sorted(where.pop(rank)):
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                k = after[j]
                sym[i], sym[j] = new, -2
                after[i], before[k] = k, i
                h = before[i]
                if h >= 0 and (hit := ranks.get((sym[h], new))) is not None:
                    if hit[0] not in where:
                        where[hit[0]] = []
                        heapq.heappush(active, hit[0])
                    where[hit[0]].append(h)
                if (hit := ranks.get((new, sym[k]))) is not None:
                    if hit[0] not in where:
                        where[hit[0]] = []
                        heapq.heappush(active, hit[0])
                    where[hit[0]].append(i)
        out = []
        for i in heads:
            ids = []
            while sym[i] != -1:
                ids.append(sym[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def _learn(self, new: list[str]) -> None:
        """Put chunks into the look-up table."""
        if len(self.chunk_ids) + len(new) > REMEMBERED:
            self.chunk_ids = self._no_chunks()
        split = [pieces(c) for c in new]
        unseen = list(dict.fromkeys(p for ps in split for p in ps if p not in self.known))
        if len(self.known) + len(unseen) > REMEMBERED:
            self.known = {}
            unseen = list(dict.fromkeys(p for ps in split for p in ps))
        self.known.update(zip(unseen, self.merge_pieces(unseen)))
        for c, ps in zip(new, split):
            self.chunk_ids[c] = self.known[ps[0]] if len(ps) == 1 else sum((self.known[p] for p in ps), ())

    def _parts(self, text: str) -> list[str | int]:
        """Chunks of ordinary text, and the ids of special tokens between them."""
        if not any(t in text for t in self.special):
            return chunks(text)
        out: list[str | int] = []
        for i, part in enumerate(self.marks.split(text)):
            out += [self.special[part]] if i % 2 else chunks(part)
        return out

    def encode(self, batch: list[str]) -> Iterator[list[int]]:
        """The ids of each text; pieces are merged for a group of texts at a time."""
        group: list[list[str | int]] = []
        size = 0
        for text in batch:
            group.append(self._parts(text))
            size += len(group[-1])
            if size >= 200_000:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str | int]]) -> Iterator[list[int]]:
        used = set(chain.from_iterable(group))
        new = used.difference(self.chunk_ids)
        if len(new) + len(self.chunk_ids) > REMEMBERED:  # the table starts anew with all that this group needs
            new = used.difference(self._no_chunks())
        if new:
            self._learn(list(new))
        seen = self.chunk_ids.__getitem__
        for parts in group:
            yield [*chain.from_iterable(map(seen, parts))]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    """One encoder per worker and file."""
    return PairIndexEncoder(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids``."""
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = pa.array(list(bpe.encode(texts(b.column(text)))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return arrow_map(docs, work, f"{names}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``; null ids give the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            out = pa.array([bpe.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, work, f"{names}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode what was encoded, and give both as digests; one pass over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for ids in bpe.encode(texts(b.column("text"))):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return arrow_map(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Quality rules on repetition inside a text, read off a suffix array over its words.

Texts of a batch share one suffix array; a word of one text never equals a word
of another, so no repeat crosses texts and one sort serves thousands of them.
Neighbours in the array with a common prefix bound the intervals of repeated word
sequences; a repeat that its left neighbour does not extend is maximal. The union
of maximal repeats gives the covered fraction, the longest common prefix the
longest repeat.

Null and empty texts have no words and fail the minimum length. Rows are judged
one by one: repeated rows and ids get the same verdict, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, texts, word_bytes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """A text is kept within these limits. ``min_repeat``: words of a repeat that counts."""

    min_words: int = 10
    repeat_percent: int = 20
    min_repeat: int = 8
    covered: float = 0.3
    longest: int = 150


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``words`` and each one's common prefix with the one before.

    Prefix doubling; after each round only suffixes whose rank is still shared are sorted.
    ``words`` are ids from 0; ends of texts must have ids of their own.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    key = words[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        # suffixes in groups of more than one
        single = head & np.r_[head[1:], True]
        open_at = np.flatnonzero(~single)
        if not len(open_at):
            break
        some = order[open_at]
        ahead = some + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[some]
        by = np.lexsort((second, group))
        some, second, group = some[by], second[by], group[by]
        order[open_at] = some
        fresh = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        head[open_at] = fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        step *= 2
        if step >= 2 * n:
            break
    return order, _common(words, order)


def _common(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of neighbours in ``order``, by doubling over equal blocks."""
    n = len(words)
    lcp = np.zeros(n, np.int64)
    # names of blocks of 1, 2, 4 .. words; pairs that agree move on to the next size
    levels = [words]
    left, right, at = order[:-1], order[1:], np.arange(1, n)
    while True:
        names, size = levels[-1], 1 << (len(levels) - 1)
        ok = (left + size <= n) & (right + size <= n)
        same = np.zeros(len(left), bool)
        same[ok] = names[left[ok]] == names[right[ok]]
        if not same.any() or 2 * size > n:
            break
        left, right, at = left[same], right[same], at[same]
        last = len(names) - size  # blocks of twice the size begin before it
        pair = names[:last].astype(np.int64) * (int(names.max()) + 1) + names[size:]
        levels.append(np.unique(pair, return_inverse=True)[1])
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        names, size = levels[k], 1 << k
        while True:
            ok = np.flatnonzero((a + size <= n) & (b + size <= n))
            ok = ok[names[a[ok]] == names[b[ok]]]
            if not len(ok):
                break
            a[ok] += size
            b[ok] += size
            lcp[ok + 1] += size
            if k < len(levels) - 1:
                break
    return lcp


def repeats(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For every word of every text the length of the longest repeat that begins there.

    Second: where each text begins in that array; texts are closed by one extra entry.
    """
    starts = np.zeros(len(lists) + 1, np.int64)
    ids: list[int] = []
    for i, words in enumerate(lists):
        own: dict[bytes, int] = {}
        base = len(ids)
        ids += [own.setdefault(w, base + j) for j, w in enumerate(words)]
        ids.append(len(ids))
        starts[i + 1] = len(ids)
    order, lcp = suffix_array(np.array(ids, np.int64))
    best = np.zeros(len(ids), np.int64)
    if len(ids):
        best[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return best, starts


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Mark the words inside a repeat of at least ``least`` words."""
    mark = np.zeros(len(best) + 1, np.int64)
    at = np.flatnonzero(best >= least)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + best[at], -1)
    return np.cumsum(mark[:-1]) > 0


def _window_words(best: np.ndarray) -> np.ndarray:
    """Mark the words inside a window of ``WINDOW`` words that occurs twice."""
    mark = np.zeros(len(best) + WINDOW + 1, np.int64)
    at = np.flatnonzero(best >= WINDOW)
    mark[at] += 1
    mark[at + WINDOW] -= 1
    return np.cumsum(mark)[: len(best)] > 0


def maximal_spans(words: list[bytes], least: int) -> list[tuple[int, int]]:
    """Word spans ``(begin, end)`` of maximal repeats of at least ``least`` words."""
    best, _ = repeats([words])
    best = best[: len(words)]
    return [(i, i + int(k)) for i, k in enumerate(best) if k >= least and (i == 0 or best[i - 1] <= k)]


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(batch: list[str], rules: Rules) -> dict[str, np.ndarray]:
    """The figures and verdicts of a group of texts."""
    lists = [word_bytes(t, lower=False) for t in batch]
    best, starts = repeats(lists)
    n_words = np.array([len(w) for w in lists], np.int64)
    sums = lambda mark: np.diff(np.r_[0, np.cumsum(mark)][starts]) if len(lists) else np.zeros(0, np.int64)
    repeat_words = sums(_window_words(best))
    inside = sums(covered(best, rules.min_repeat))
    longest = np.maximum.reduceat(best, starts[:-1]) if len(lists) else np.zeros(0, np.int64)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in batch], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in batch], np.int64)
    failed = (n_words < rules.min_words) | (100 * repeat_words > rules.repeat_percent * n_words)
    fraction = inside / np.maximum(1, n_words)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.array([duplicate_lines(t) for t in batch], np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "covered_fraction": fraction,
        "longest_repeat": longest,
        "kept": ~failed & (fraction <= rules.covered) & (longest <= rules.longest),
    }


COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "covered_fraction": "double",
    "longest_repeat": "long",
    "kept": "boolean",
}


def groups(batch: list[str], chars: int = 4_000_000) -> Iterator[list[int]]:
    """Positions of texts that share one suffix array: about ``chars`` characters, one text at least."""
    out, size = [], 0
    for i, t in enumerate(batch):
        out.append(i)
        size += len(t)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with the columns of :data:`COLUMNS`; columns of ``docs`` with these names give way."""
    keep = [c for c in docs.columns if c not in COLUMNS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = texts(b.column(text))
            for at in groups(all_texts):
                found = measure([all_texts[i] for i in at], rules)
                part = b.slice(at[0], len(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found.values())], [*keep, *found])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return arrow_map(rows, work, ", ".join([*names, *(f"{c} {t}" for c, t in COLUMNS.items())]))

"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

Latent states emit word classes, and a class emits its words by their smoothed
counts, so that the part whose size grows with the vocabulary never has to fit
into one task: P(word | state) = P(class | state) * P(word | class). A class is a
short word itself or the end of a longer one, hashed to a fixed number of classes.

Texts are cut into words once and stored in blocks of word numbers with their own
small vocabulary. Every round of Baum-Welch runs over all blocks; expected counts
are added up inside a task, then by Spark. Word counts are a grouped sum over the
block vocabularies, joined back to them and given to their block.

For training, texts are cut into stretches of ``stretch`` tokens that begin with
the stationary start distribution; every token is in one stretch. Scoring runs the
scaled forward recursion over the whole text, whatever its length.

Null and empty texts are one end token. Each input row gives one output row; rows
that repeat count as often as they occur. Without training rows all counts are 0
and the model is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, ship, texts, word_bytes

END = b""


@dataclass(frozen=True)
class Settings:
    states: int = 4
    classes: int = 4096
    rounds: int = 4
    stretch: int = 64
    block_tokens: int = 1_500_000
    smoothing: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def class_of(word: bytes, classes: int) -> int:
    """Ends of text have the last class; words of up to 4 bytes and longer ones share the rest."""
    if word == END:
        return classes - 1
    half = classes // 2
    if len(word) <= 4:
        return zlib.crc32(word) % half
    return half + zlib.crc32(word[-3:]) % (classes - half - 1)


def blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """The corpus as word numbers. ``docs``: doc_id, text, held_out.

    One row per block (``word`` null) with its rows' ids, lengths and numbers, and one
    row per block and distinct word with its count in training rows.
    """
    names = ["block", "doc_ids", "held", "lengths", "numbers", "kinds", "word", "number", "kind", "count"]
    types = (
        pa.int64(),
        pa.list_(pa.int64()),
        pa.list_(pa.bool_()),
        pa.list_(pa.int64()),
        pa.binary(),
        pa.binary(),
        pa.binary(),
        pa.int32(),
        pa.int32(),
        pa.int64(),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, int] = {}
        ids, held, lengths, numbers, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            block = secrets.randbits(63)
            words = list(own)
            kinds = np.fromiter((class_of(w, s.classes) for w in words), np.int32, len(words))
            flat = np.concatenate(numbers)
            trained = np.repeat(~np.array(held, bool), lengths)
            count = np.bincount(flat[trained], minlength=len(words))
            packed = zlib.compress(flat.astype("<i4").tobytes(), 1)
            m = len(words)
            cols = [
                [block] * (m + 1),
                [ids, *[None] * m],
                [held, *[None] * m],
                [lengths, *[None] * m],
                [packed, *[None] * m],
                [kinds.astype("<i4").tobytes(), *[None] * m],
                [None, *words],
                [None, *range(m)],
                [None, *kinds.tolist()],
                [None, *count.tolist()],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            columns = (b.column("doc_id").to_pylist(), texts(b.column("text")), b.column("held_out").to_pylist())
            for doc, text, out in zip(*columns):
                words = word_bytes(text)
                words.append(END)
                at = [own.setdefault(w, len(own)) for w in words]
                numbers.append(np.array(at, np.int32))
                ids.append(doc)
                held.append(bool(out))
                lengths.append(len(at))
                size += len(at)
                if size >= s.block_tokens:
                    yield flush()
                    own, ids, held, lengths, numbers, size = {}, [], [], [], [], 0
        if ids:
            yield flush()

    schema = (
        "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, numbers binary, kinds binary, "
        "word binary, number int, kind int, count long"
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text", "held_out")
    return cut(arrow_map(rows, work, schema))


def _sequences(kinds: bytes, numbers: bytes) -> np.ndarray:
    return np.frombuffer(kinds, "<i4")[np.frombuffer(zlib.decompress(numbers), "<i4")]


def _ordered(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, and how many are longer than each position."""
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths.max(initial=0))
    longer = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), side="right")
    return order, starts[order], lengths[order], longer


def log_likelihoods(model: Model, seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of the class sequence of each text: scaled forward recursion."""
    order, first, _, longer = _ordered(starts, lengths)
    total = np.zeros(len(lengths))
    alpha = np.zeros((len(lengths), len(model.start)))
    for t, n in enumerate(longer):
        e = model.emit[seq[first[:n] + t]]
        a = (alpha[:n] @ model.move) * e if t else model.start * e
        scale = a.sum(1)
        np.divide(a, scale[:, None], out=alpha[:n])
        total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected_counts(model: Model, seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Start, move and emission counts and the log likelihood, flat: forward and backward, scaled."""
    k = len(model.start)
    order, first, lens, longer = _ordered(starts, lengths)
    n, top = len(lens), len(longer)
    alpha = np.zeros((top, n, k))
    scale = np.ones((top, n))
    emit = np.zeros((top, n, k))
    for t, m in enumerate(longer):
        emit[t, :m] = model.emit[seq[first[:m] + t]]
        a = (alpha[t - 1, :m] @ model.move) * emit[t, :m] if t else model.start * emit[t, :m]
        scale[t, :m] = a.sum(1)
        alpha[t, :m] = a / scale[t, :m, None]
    beta = np.ones((n, k))
    move, heads = np.zeros((k, k)), np.zeros(k)
    spent = np.zeros((len(model.emit), k))
    for t in range(top - 1, -1, -1):
        m = longer[t]
        gamma = alpha[t, :m] * beta[:m]
        what = seq[first[:m] + t]
        for j in range(k):
            spent[:, j] += np.bincount(what, weights=gamma[:, j], minlength=len(spent))
        if t == 0:
            heads += gamma.sum(0)
            break
        ahead = emit[t, :m] * beta[:m] / scale[t, :m, None]
        move += alpha[t - 1, :m].T @ ahead
        beta[:m] = ahead @ model.move.T
    return np.r_[heads, (move * model.move).ravel(), spent.ravel(), np.log(scale).sum()]


def _stretches(held: list[bool], lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches of the rows to learn from."""
    n = np.array(lengths, np.int64)
    begin = np.r_[0, np.cumsum(n)[:-1]]
    use = ~np.array(held, bool)
    n, begin = n[use], begin[use]
    parts = -(-n // size)
    which = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return begin[which] + k * size, np.minimum(size, n[which] - k * size)


def train(stored: DataFrame, by_class: np.ndarray, s: Settings) -> Model:
    """Baum-Welch over all blocks. ``by_class``: training tokens of each class, to begin with."""
    rng = np.random.default_rng(s.seed)
    share = (by_class + 1.0) / (by_class + 1.0).sum()
    emit = share[:, None] * rng.lognormal(0, 1, (s.classes, s.states))
    emit /= emit.sum(0)
    stay = 0.8 if s.states > 1 else 1.0
    move = np.full((s.states, s.states), (1 - stay) / max(1, s.states - 1))
    np.fill_diagonal(move, stay)
    model = Model(np.full(s.states, 1 / s.states), move, emit)
    rows = stored.filter("word is null").select("held", "lengths", "numbers", "kinds")
    for _ in range(s.rounds if by_class.sum() else 0):
        counts = _round(rows, model, s)
        k = s.states
        heads, moves = counts[:k] + s.smoothing, counts[k : k + k * k].reshape(k, k) + s.smoothing
        # every class keeps a chance in every state, in proportion to its share
        spent = counts[k + k * k : -1].reshape(s.classes, k) + s.smoothing * share[:, None] * s.classes
        model = Model(heads / heads.sum(), moves / moves.sum(1, keepdims=True), spent / spent.sum(0))
    return model


def _round(rows: DataFrame, model: Model, s: Settings) -> np.ndarray:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)  # states x classes numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros(s.states + s.states**2 + s.states * s.classes + 1)
        for b in batches:
            for held, lengths, numbers, kinds in zip(*(c.to_pylist() for c in b.columns)):
                begin, n = _stretches(held, lengths, s.stretch)
                seq = _sequences(kinds, numbers)
                for i in range(0, len(n), 8192):
                    total += expected_counts(m, seq, begin[i : i + 8192], n[i : i + 8192])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "value"])

    found = arrow_map(rows, work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(s.states + s.states**2 + s.states * s.classes + 1)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    sent.unpersist()
    return out


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Score rows ``doc_id, text, held_out``; rows that are held out teach nothing.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    ship(spark)
    stored = blocks(docs, s)
    vocabulary = stored.filter("word is not null").select("block", "word", "number", "kind", "count")
    counts = cut(vocabulary.groupBy("word", "kind").agg(F.sum("count").alias("c")).filter("c > 0"))
    per_class = counts.groupBy("kind").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).toPandas()
    tokens, types = np.zeros(s.classes), np.zeros(s.classes)
    tokens[per_class["kind"]], types[per_class["kind"]] = per_class["tokens"], per_class["types"]
    model = train(stored, tokens, s)
    n_all, v_all = int(tokens.sum()), int(types.sum())
    # one place per class is kept for all words never seen
    sent = spark.sparkContext.broadcast((model, np.log10(tokens + types + 1)))
    known = vocabulary.join(counts.select("word", "c"), "word").select("block", "number", "c")
    texts_of = stored.filter("word is null").select(F.col("block").alias("home"), "doc_ids", "held", "lengths", "numbers", "kinds")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, mass = sent.value
        row = left.iloc[0]
        kinds = np.frombuffer(row["kinds"], "<i4")
        numbers = np.frombuffer(zlib.decompress(row["numbers"]), "<i4")
        c = np.zeros(len(kinds))
        c[right["number"].to_numpy()] = right["c"].to_numpy()
        lengths = np.asarray(row["lengths"], np.int64)
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        seq = kinds[numbers]
        words = np.log10(c + 1)[numbers]
        of_words = np.add.reduceat(words, begin)
        of_classes = log_likelihoods(m, seq, begin, lengths) / np.log(10)
        n = len(lengths)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], "Int64"),
                "held_out": np.asarray(row["held"], bool),
                "n_tokens": lengths,
                "n_known": np.add.reduceat((c > 0).astype(np.int64)[numbers], begin),
                "train_tokens": np.full(n, n_all),
                "base_score": of_words - lengths * np.log10(n_all + v_all + 1),
                "score": of_classes + of_words - np.add.reduceat(mass[seq], begin),
            }
        )

    return (
        texts_of.groupBy("home")
        .cogroup(known.groupBy("block"))
        .applyInPandas(
            finish,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )

"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

Features are hashed character n-grams of the lower-cased text, present or not. Their naive Bayes log-count ratios come from every labelled row, summed over
the cluster; they scale the features of a logistic regression, which is fitted on a
bounded sample, in one task: at most ``per_class`` rows of each label, those with the smallest
hash of their content. Both labels weigh the same in it, so 0.5 lies between them however
rare one is. ``smoothing`` keeps n-grams that few texts hold from explaining the sample.

Null and empty texts have no features and get the score of the intercept. Rows are
scored one by one, so repeated rows score alike. Labels that are null or neither 0
nor 1 teach nothing; without labels of both kinds every score is the share of toxic
labels, or 0. Texts are read whole at any length: a text is at most ``2 ** bits``
features. Equal labelled rows are one row of the sample with their number as weight,
so ties leave the sample definite. Other columns pass through the scoring untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, texts

# Texts whose features are multiplied at a time.
BLOCK = 100


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the distinct rows of a label that the regression sees; every feature takes part."""

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    per_class: int = 800
    smoothing: float = 20.0
    ridge: float = 1.0
    rounds: int = 60


class Features:
    """Hashed n-grams of texts. ``mark`` is all false between two texts."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.mark = np.zeros(1 << settings.bits, bool)

    def of_text(self, text: str) -> np.ndarray:
        """Sorted distinct features."""
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(code) <= 2:
            return np.zeros(0, np.int32)
        odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - self.settings.bits)
        h = code
        for n in range(2, min(max(self.settings.orders), len(code)) + 1):
            h = h[:-1] * odd + code[n - 1 :]
            if n in self.settings.orders:  # the upper bits of one more product, other ones for each length
                self.mark[h * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) >> shift] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: np.ndarray
    intercept: float

    def score(self, feats: np.ndarray) -> float:
        z = float(self.weights[feats].sum()) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label, by ``doc_id``.

    Joined by sorting at every size: the labels grow with the corpus, so no size at which
    they would still fit into every task is taken as given.
    """
    return docs.join(labels.hint("merge"), "doc_id")


def log_count_ratios(train: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each feature's share among toxic and other rows, and the rows of each label.

    ``train``: text, label. Every partition counts for itself; Spark sums by feature.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(settings)
        size = 1 << settings.bits
        counts = np.zeros((2, size), np.int64)
        for b in batches:
            for text, label in zip(texts(b.column("text")), b.column("label").to_pylist()):
                counts[label][feats.of_text(text)] += 1
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["feature", "other", "toxic"]
        )

    # by numbers of rows a driver can hold at any size: two labels here, one row per task below
    rows = np.zeros(2)
    for label, n in train.groupBy("label").count().collect():
        rows[label] = n
    # pseudo counts in proportion to the labels: a feature never met has ratio 0
    extra = 2 * settings.smoothing * rows / max(1, rows.sum())

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = [], []
        for b in batches:
            p = (b.column("toxic").to_numpy() + extra[1]) / max(1, rows[1])
            q = (b.column("other").to_numpy() + extra[0]) / max(1, rows[0])
            with np.errstate(divide="ignore", invalid="ignore"):
                found.append(np.where((p > 0) & (q > 0), np.log(p / q), 0.0))
            at.append(b.column("feature").to_numpy())
        if at:
            yield _blocks(np.concatenate(at), np.concatenate(found))

    counts = arrow_map(train, work, "feature int, other long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    return _dense(arrow_map(counts, ratios, "at array<int>, value array<double>"), 1 << settings.bits), rows


def _blocks(at: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Numbers and their places, some ten thousand in a row."""
    cuts = range(0, max(1, len(at)), 1 << 15)
    places = pa.array([at[i : i + (1 << 15)].astype(np.int32) for i in cuts], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [places, pa.array([value[i : i + (1 << 15)] for i in cuts], pa.list_(pa.float64()))], ["at", "value"]
    )


def _dense(blocks: DataFrame, size: int) -> np.ndarray:
    """``size`` numbers from rows of :func:`_blocks`; what no row names is 0."""
    out = np.zeros(size)
    for b in blocks.select("at", "value").toArrow().to_batches():
        out[b.column("at").flatten().to_numpy()] = b.column("value").flatten().to_numpy()
    return out


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows ``(doc_id, text, label)``; each row counts, also if it is repeated."""
    # written once: ratios and sample both read it, and the join behind it moves texts
    train = cut(
        rows.filter(F.col("label").isin(0, 1)).select(
            F.col("doc_id").cast("long"), "text", F.col("label").cast("int")
        )
    )
    ratio, totals = log_count_ratios(train.select("text", "label"), settings)
    size = 1 << settings.bits
    if totals.min() == 0:
        share = totals[1] / max(1.0, totals.sum())
        return Model(settings, np.zeros(size), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    salt = F.xxhash64(F.lit("sample"), "doc_id", "label", "text")
    kinds = train.select("label", salt.alias("h")).groupBy("label", "h").agg(F.count(F.lit(1)).alias("n"))
    of_label = lambda x: kinds.filter(F.col("label") == x).orderBy("h").limit(settings.per_class)
    chosen = {(r.label, r.h): r.n for r in of_label(1).unionByName(of_label(0)).collect()}
    inside = F.lit(False)
    for label in (0, 1):
        top = max(h for x, h in chosen if x == label)
        inside = inside | ((F.col("label") == label) & (F.col("h") <= F.lit(top)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(settings)
        for b in batches:
            got = [feats.of_text(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("h"), pa.array(got, pa.list_(pa.int32()))], ["label", "h", "feats"]
            )

    rows = train.select("label", salt.alias("h"), "text").filter(inside).dropDuplicates(["label", "h"])
    sample = arrow_map(rows, work, "label int, h long, feats array<int>")
    known = train.sparkSession.sparkContext.broadcast(ratio)  # 2^bits ratios, whatever the input

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task, since the sample is bounded by ``per_class``; the driver keeps only weights."""
        y, times, indices, lengths = [], [], [], []
        for b in batches:
            y += b.column("label").to_pylist()
            times += [chosen[k] for k in zip(b.column("label").to_pylist(), b.column("h").to_pylist())]
            indices.append(b.column("feats").flatten().to_numpy())
            lengths.append(pc.list_value_length(b.column("feats")).to_numpy())
        entries, indices = np.concatenate(indices), None
        model = _regression(
            np.array(y, float), np.array(times, float), entries, np.concatenate(lengths), known.value, settings
        )
        at = np.flatnonzero(model.weights)
        yield _blocks(np.r_[at, size], np.r_[model.weights[at], model.intercept])

    ordered = sample.repartition(1).sortWithinPartitions("label", "h")
    found = _dense(arrow_map(ordered, regress, "at array<int>, value array<double>"), size + 1)
    known.unpersist()
    return Model(settings, found[:-1].copy(), float(found[-1]))


def _regression(y, times, indices, lengths, ratio, s: Settings) -> Model:
    """Logistic regression on scaled features, rows weighted by ``times`` and both labels alike;
    conjugate gradient inside Newton steps."""
    n, size = len(y), len(ratio)
    # places by a table of all features: sorting millions of entries takes several copies of them
    mark = np.zeros(size, bool)
    mark[indices] = True
    used = np.flatnonzero(mark)
    place = np.cumsum(mark, dtype=np.int32) - np.int32(1)
    col, scale = place[indices], ratio[used]
    weight = times / np.where(y == 1, times[y == 1].sum(), times[y == 0].sum())
    weight = weight / weight.mean()
    theta = np.zeros(len(used) + 1)
    ends = np.r_[0, np.cumsum(lengths)]

    def blocks() -> Iterator[tuple[int, int, np.ndarray]]:
        """A block of texts at a time; their entries lie together, and only they are held in full."""
        for first in range(0, n, BLOCK):
            last = min(first + BLOCK, n)
            yield first, last, col[ends[first] : ends[last]].astype(np.intp)

    def forward(t: np.ndarray) -> np.ndarray:
        z = np.zeros(n)
        for first, last, at in blocks():
            part = t[:-1][at]
            part *= scale[at]
            row = np.repeat(np.arange(last - first), lengths[first:last])
            z[first:last] = np.bincount(row, weights=part, minlength=last - first)
        return z + t[-1]

    def backward(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for first, last, at in blocks():
            part = np.repeat(g[first:last], lengths[first:last])
            part *= scale[at]
            np.add.at(out, at, part)
        return np.r_[out, g.sum()]

    ridge = np.r_[np.full(len(used), s.ridge), 0.0]
    for _ in range(6):
        p = 1 / (1 + np.exp(-np.clip(forward(theta), -30, 30)))
        grad = backward(weight * (p - y)) + ridge * theta
        curve = weight * np.maximum(p * (1 - p), 1e-4)
        apply = lambda d: backward(curve * forward(d)) + ridge * d  # noqa: E731, B023
        step, rest = np.zeros_like(theta), -grad
        d, rr = rest.copy(), rest @ rest
        for _ in range(max(1, s.rounds // 6)):
            if rr < 1e-10:
                break
            ad = apply(d)
            a = rr / max(d @ ad, 1e-30)
            step += a * d
            rest = rest - a * ad
            new = rest @ rest
            d, rr = rest + (new / rr) * d, new
        theta = theta + step
    weights = np.zeros(size)
    weights[used] = theta[:-1] * ratio[used]
    return Model(s, weights, float(theta[-1]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; an own column of that name gives way."""
    keep = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2^bits weights, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        feats = Features(m.settings)
        for b in batches:
            got = [m.score(feats.of_text(t)) for t in texts(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*keep, "score"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return arrow_map(rows, work, ", ".join([*names, "score double"]))


def predicted(score_column: Column) -> Column:
    return F.when(score_column >= 0.5, 1).otherwise(0)

"""Document-level bootstrap intervals, for one system and for paired differences.

A unit is one combination of the key columns (system, criterion, kind, ...) with
one count vector ``(tp, fp, fn)`` per document, or two for a paired difference.

Documents with equal count vectors cannot be told apart, so a resample is a multinomial draw
over the distinct vectors: the cost does not grow with the number of documents. Vectors lie
in buckets; every task draws the bucket totals for itself and then only its own bucket. Two
ways to draw, with the same distribution. The caller names the way; it never depends on the
size of the data:

* ``splits`` (the default): a binary tree over the vectors in order. At each node the draws that
  reached it are split between its halves by a binomial draw, whose uniform number is a hash
  of (seed, iteration, height, node). Results repeat on any engine that can add and hash.
* ``multinomial``: numpy's own generator.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.stats import f1
from marginalia.session import tasks

ITERATIONS = 10_000
SEED = 0
CONFIDENCE = 0.95
# Distinct vectors per bucket aimed at.
BUCKET_VECTORS = 2_000
# Iterations a task holds in memory at once.
CHUNK = 250
# Height of the subtree that is one bucket of ``splits``: 2,048 vectors.
BUCKET_HEIGHT = 11
# Largest variance of a binomial draw that is taken by inversion of the exact distribution.
# Beyond it the normal quantile with a correction for skewness is exact to a few thousandths.
# No ratio of small integers, so that rounding decides nothing.
EXACT_VARIANCE = 25.00001

ONE = ("tp", "fp", "fn")
TWO = ("a_tp", "a_fp", "a_fn", "b_tp", "b_fp", "b_fn")


def _statistic(cols: Sequence[str]) -> Column:
    first = f1(*[F.col(c) for c in cols[:3]])
    return first if len(cols) == 3 else first - f1(*[F.col(c) for c in cols[3:]])


def _sums(cols: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 32-bit numbers held in longs; no product passes 2**59."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B & 0xFFFFFFFF
    return (x >> 16) ^ x


def uniform(seed: int, stream: int, iteration: np.ndarray, height: int, node: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that depend on all arguments; iterations x nodes."""
    return uniform_at(seed, stream, iteration[:, None], height, node[None, :])


def uniform_at(seed: int, stream: int, iteration: np.ndarray, height: int, node: np.ndarray) -> np.ndarray:
    """The same for single pairs of an iteration and a node."""
    x = _mixed((iteration * 4 + stream) ^ _mixed(np.int64(seed & 0xFFFFFFFF)))
    x = _mixed(x ^ _mixed((node * 64 + height) & 0xFFFFFFFF))
    return (x + 0.5) / 4294967296.0


def binomial(n: np.ndarray, part: np.ndarray, whole: np.ndarray, u: np.ndarray, v) -> np.ndarray:
    """How many of ``n`` draws, iterations x nodes, fall on ``part`` of ``whole`` of each node.

    ``u`` holds uniform numbers; ``v(i, j)`` gives a second one for iterations ``i`` and nodes
    ``j`` and is asked only for draws with a large variance.
    """
    swap = 2 * part > whole
    p = np.where(swap, whole - part, part) / whole
    q = 1.0 - p
    spread = n * p * q
    small = spread <= EXACT_VARIANCE
    x = np.zeros(n.shape, np.int64)
    i, j = np.nonzero(~small)
    if len(i):
        m, z = n[i, j], np.sqrt(-2.0 * np.log(u[i, j])) * np.cos(2.0 * np.pi * v(i, j))
        y = np.floor(m * p[j] + np.sqrt(spread[i, j]) * z + (q - p)[j] * (z * z - 1.0) / 6.0 + 0.5)
        x[i, j] = np.clip(y, 0, m).astype(np.int64)
    # inversion: count the values whose distribution function lies below u
    i, j = np.nonzero(small & (n > 0))
    m, u, odds = n[i, j], u[i, j], (p / (1.0 - p))[j]
    mass = np.exp(m * np.log1p(-p)[j])
    below, k, exact = mass.copy(), 0, np.zeros(len(m), np.int64)
    live = np.flatnonzero(below < u)
    while len(live):
        k += 1
        exact[live] = k
        mass[live] *= (m[live] - k + 1) / k * odds[live]
        below[live] += mass[live]
        live = live[(below[live] < u[live]) & (k < m[live])]
    x[i, j] = exact
    return np.where(swap, n - x, x)


def split(sizes: np.ndarray, n: np.ndarray, first: int, low: int, iterations: np.ndarray, seed: int) -> np.ndarray:
    """Multinomial draws, iterations x leaves, by binomial splits from the root down.

    ``n``: draws of each iteration. The leaves stand at height ``low`` from node ``first`` on,
    which a subtree starts at.
    """
    height = max(0, int(len(sizes) - 1).bit_length())
    tree = [np.concatenate([sizes, np.zeros((1 << height) - len(sizes), np.int64)])]
    while len(tree[-1]) > 1:
        tree.append(tree[-1][::2] + tree[-1][1::2])
    drawn = n[:, None]
    for h in range(height, 0, -1):
        whole, left = tree[h], tree[h - 1][::2]
        node = (first >> h) + np.arange(len(whole))
        taken = np.where(left == whole, drawn, 0)
        open_ = np.flatnonzero((left > 0) & (left < whole))
        if len(open_):
            mine = drawn[:, open_]
            u = uniform(seed, 0, iterations, h + low, node[open_])

            def second(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return uniform_at(seed, 1, iterations[i], h + low, node[open_][j])

            taken[:, open_] = binomial(mine, left[open_], whole[open_], u, second)
        drawn = np.stack([taken, drawn - taken], axis=2).reshape(len(n), -1)
    return drawn[:, : len(sizes)]


def _splits(counts: DataFrame, keys: list[str], cols, iterations: int, seed: int) -> DataFrame:
    classes = counts.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("size"))
    # places of distinct vectors, not of documents
    place = (F.row_number().over(W.partitionBy(*keys).orderBy(*cols)) - 1).cast("bigint")
    placed = classes.withColumn("place", place).withColumn("bucket", F.shiftright("place", BUCKET_HEIGHT))
    totals = (
        placed.groupBy(*keys, "bucket")
        .agg(F.sum("size").alias("size"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "size"))).alias("b"))
        .select(*keys, F.col("b.size").alias("bucket_sizes"))
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // CHUNK))).alias("part")
    # a few small rows a group are much work, which Spark would put into few tasks for their size
    work = placed.join(totals, keys).select("*", parts).repartition(tasks(counts.sparkSession), *keys, "bucket", "part")
    cols = list(cols)

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        rows = rows.sort_values("place")
        buckets = np.asarray(head["bucket_sizes"], np.int64)
        first = int(head["part"]) * CHUNK
        iters = np.arange(first, min(first + CHUNK, iterations), dtype=np.int64)
        bucket = int(head["bucket"])
        n = np.full(len(iters), buckets.sum(), np.int64)
        mine = split(buckets, n, 0, BUCKET_HEIGHT, iters, seed)[:, bucket]
        drawn = split(rows["size"].to_numpy(np.int64), mine, bucket << BUCKET_HEIGHT, 0, iters, seed)
        out = pd.DataFrame(drawn @ rows[cols].to_numpy(np.int64), columns=cols)
        out.insert(0, "iter", iters.astype(np.int32))
        for k in reversed(keys):
            out.insert(0, k, head[k])
        return out

    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["iter int"] + [f"{c} bigint" for c in cols])
    drawn = work.groupBy(*keys, "bucket", "part").applyInPandas(resample, schema)
    return drawn.groupBy(*keys, "iter").agg(*_sums(cols))


def _multinomial(counts: DataFrame, keys: list[str], cols, iterations: int, seed: int) -> DataFrame:
    classes = counts.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("size"))
    per_unit = classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    buckets = F.ceil(F.col("k") / BUCKET_VECTORS)
    placed = classes.join(per_unit, keys).withColumn(
        "bucket", F.pmod(F.xxhash64(*cols), buckets).cast("int")
    )
    totals = (
        placed.groupBy(*keys, "bucket")
        .agg(F.sum("size").alias("size"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "size"))).alias("b"))
        .select(*keys, F.col("b.bucket").alias("bucket_ids"), F.col("b.size").alias("bucket_sizes"))
    )
    cols = list(cols)

    def resample(batches: pd.DataFrame) -> pd.DataFrame:
        head = batches.iloc[0]
        # same row order whatever order the shuffle delivered
        rows = batches.sort_values(cols)
        vectors = rows[cols].to_numpy(np.int64)
        share = rows["size"].to_numpy(np.float64)
        ids, sizes = list(head["bucket_ids"]), np.asarray(head["bucket_sizes"], np.float64)
        bucket = int(head["bucket"])
        outer = np.random.default_rng([seed, len(ids)])
        mine = np.random.default_rng([seed, len(ids), bucket])
        n, where = int(sizes.sum()), ids.index(bucket)
        out = []
        for first in range(0, iterations, CHUNK):
            m = min(CHUNK, iterations - first)
            taken = outer.multinomial(n, sizes / sizes.sum(), size=m)[:, where]
            sums = mine.multinomial(taken, share / share.sum()) @ vectors
            part = pd.DataFrame(sums, columns=cols)
            part.insert(0, "iter", np.arange(first, first + m, dtype=np.int32))
            out.append(part)
        result = pd.concat(out, ignore_index=True)
        for k in reversed(keys):
            result.insert(0, k, head[k])
        return result

    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["iter int"] + [f"{c} bigint" for c in cols])
    drawn = placed.join(totals, keys).groupBy(*keys, "bucket").applyInPandas(resample, schema)
    return drawn.groupBy(*keys, "iter").agg(*_sums(cols))


def intervals(
    counts: DataFrame,
    keys: Sequence[str],
    paired: bool = False,
    iterations: int = ITERATIONS,
    seed: int = SEED,
    confidence: float = CONFIDENCE,
    method: str = "splits",
) -> DataFrame:
    """Point estimate and percentile interval of micro-F1 (or its difference) per unit.

    ``counts`` holds one row per unit and document. Units with fewer than two
    documents get a degenerate interval.
    """
    keys, cols = list(keys), TWO if paired else ONE
    point = (
        counts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), *_sums(cols))
        .select(*keys, "n", _statistic(cols).alias("point"))
    )
    sample = {"splits": _splits, "multinomial": _multinomial}[method]
    tail = round((1.0 - confidence) / 2.0, 12)
    bounds = (
        sample(counts, keys, cols, iterations, seed)
        .withColumn("value", _statistic(cols))
        .groupBy(*keys)
        .agg(F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
    )
    low = F.when(F.col("n") < 2, F.col("point")).otherwise(F.col("q")[0])
    high = F.when(F.col("n") < 2, F.col("point")).otherwise(F.col("q")[1])
    return (
        point.join(bounds, keys, "left")
        .withColumn("ci_low", low)
        .withColumn("ci_high", high)
        .withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
        .select(*keys, "n", "point", "ci_low", "ci_high", "excludes_zero")
    )


def side_by_side(
    scores: DataFrame, a, b, keys: Sequence[str] = ("criterion", "kind")
) -> DataFrame:
    """The counts of two systems on the same documents, one row per document.

    Fails where a document was scored for one of the two only.
    """
    on = [*keys, "doc_id"]

    def one(system, name: str) -> DataFrame:
        mine = scores.filter(F.col("system_id") == system)
        return mine.select(*on, *[F.col(c).alias(f"{name}_{c}") for c in ONE])

    joined = one(a, "a").join(one(b, "b"), on, "full_outer")
    uneven = F.raise_error(F.concat(F.lit("scored for one system only: "), F.col("doc_id")))

    def checked(col: str) -> Column:
        return F.when(F.col(col).isNull(), uneven).otherwise(F.col(col)).cast("bigint").alias(col)

    return joined.select(*on, *[checked(c) for c in TWO])


def comparison(scores: DataFrame, a, b, **options) -> DataFrame:
    """Both systems' intervals and the paired difference per criterion and kind."""
    keys = ["criterion", "kind"]
    each = intervals(scores.filter(F.col("system_id").isin(a, b)), ["system_id", *keys], **options)

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *keys, *[F.col(c).alias(f"{name}_{c}") for c in ("point", "ci_low", "ci_high")]
        )

    delta = intervals(side_by_side(scores, a, b), keys, paired=True, **options)
    return (
        named(each.filter(F.col("system_id") == a), "a")
        .join(named(each.filter(F.col("system_id") == b), "b"), keys)
        .join(
            named(delta, "delta").join(
                delta.select(*keys, F.col("excludes_zero").alias("significant")), keys
            ),
            keys,
        )
    )

"""Approximate nearest neighbours by largest inner product: forests of random-projection trees.

Vectors are dealt into bands by length, so that one very long vector moves no split of
others, and each band has a forest of its own over directions alone. Every tree splits
by one random direction per level at the median of a bounded sample, as deep as the
number of vectors asks for. In every band a query walks all trees through one priority
queue ordered by how far it is from the splits it crossed, takes the leaves that come
first, and the vectors of these leaves are ranked exactly, in double precision. The ``first`` leaves
of each band give a query a score that its last place reaches at least; others name only what reaches it too.

How much of a band is read, and by how many trees, is measured before the search: for
some of the queries the true nearest of the sample are known, and the share is what
holds ``aim`` of those that lie in the band. Up to ``sample`` vectors these are the true
nearest; beyond, as many of the sample's nearest count as lie as near as the real ones do.

Equal vectors are one entry with as many of their smallest ids as a result can
hold, so a vector that a third of all rows share fills no leaf. Leaves are cut into
parts of bounded size; a query goes to every part.

Vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do rows without id; rows that repeat an id and a vector count once.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, cut, ship


@dataclass(frozen=True)
class Settings:
    """``sample``: vectors that set the splits; ``part``: most entries of a leaf in one task.

    ``aim``: share of the nearest that the measured reading holds, for ``probes`` queries.
    """

    nearest: int = 20
    trees: int = 8
    leaf: int = 128
    deepest: int = 16
    sample: int = 20_000
    share: float = 0.06
    least_candidates: int = 4_000
    part: int = 2_000
    bands: int = 7
    probes: int = 200
    aim: float = 0.95
    first: int = 3
    seed: int = 11


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # trees x depth x dims
    splits: np.ndarray  # trees x nodes, in heap order from 1
    depth: int
    share: float = 1.0  # entries to read, as a multiple of the band's

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: vectors x trees."""
        z = directed(x)
        out = np.empty((len(x), len(self.splits)), np.int64)
        for t, splits in enumerate(self.splits):
            at = np.ones(len(x), np.int64)
            for d in range(self.depth):
                at = 2 * at + (z @ self.directions[t, d] > splits[at])
            out[:, t] = at - (1 << self.depth)
        return out

    def search(self, q: np.ndarray, enough: float, sizes: np.ndarray) -> list[tuple[int, int]]:
        """Leaves ``(tree, leaf)`` for one query, nearest first, until they hold ``enough`` entries or a whole tree."""
        project = self.directions @ directed(q[None])[0]  # trees x depth
        queue = [(0.0, t, 1, 0) for t in range(len(self.splits))]
        heapq.heapify(queue)
        left = sizes.sum(1)
        found, held = [], 0
        while queue and held < enough and left.min() > 0:
            far, t, node, d = heapq.heappop(queue)
            while d < self.depth:
                margin = project[t, d] - self.splits[t, node]
                right = margin > 0
                heapq.heappush(queue, (max(far, abs(margin)), t, 2 * node + (not right), d + 1))
                node, d = 2 * node + int(right), d + 1
            leaf = node - (1 << self.depth)
            if sizes[t, leaf]:
                found.append((t, leaf))
                held += int(sizes[t, leaf])
                left[t] -= sizes[t, leaf]
        return found

    def first(self, trees: int) -> Forest:
        return replace(self, directions=self.directions[:trees], splits=self.splits[:trees])

    def counts(self, leaves: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(leaf, minlength=1 << self.depth) for leaf in leaves.T])


@dataclass(frozen=True)
class Banded:
    cuts: np.ndarray  # lengths from which a band begins, ascending, without the first
    forests: list[Forest]
    length: float  # of the longest vector

    def band(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, np.linalg.norm(x, axis=1), side="right")


def directed(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def plant(x: np.ndarray, n: float, rng: np.random.Generator, s: Settings) -> Forest:
    """Trees over ``n`` vectors with splits from the sample ``x``."""
    depth = int(np.clip(np.ceil(np.log2(max(1, n / s.leaf))), 0, s.deepest))
    trees = s.trees if depth else 1
    directions = rng.normal(size=(trees, max(1, depth), x.shape[1]))
    forest = Forest(directions, np.zeros((trees, 1 << max(1, depth))), depth)
    z = directed(x)
    for t in range(trees):
        at = np.ones(len(z), np.int64)
        for d in range(depth):
            p = z @ directions[t, d]
            order = np.lexsort((p, at))
            nodes, first, count = np.unique(at[order], return_index=True, return_counts=True)
            forest.splits[t, nodes] = (p[order][first + (count - 1) // 2] + p[order][first + count // 2]) / 2
            at = 2 * at + (p > forest.splits[t, at])
    return forest


def measured(forest: Forest, x: np.ndarray, queries: np.ndarray, wanted: list[np.ndarray], s: Settings) -> Forest:
    """The forest with the number of trees and the share that hold ``aim`` of the rows ``wanted`` of ``x`` for least reading."""
    all_leaves = forest.leaves(x)
    options = []
    for trees in sorted({1, 2, 4, len(forest.splits)} & set(range(1, len(forest.splits) + 1))):
        some, leaves = forest.first(trees), all_leaves[:, :trees]
        sizes, at = some.counts(leaves), []
        for q, rows in zip(queries, wanted):
            if len(rows):
                order = np.full(sizes.shape, np.inf)
                visited = some.search(q, np.inf, sizes)
                order[tuple(np.array(visited).T)] = np.cumsum([sizes[v] for v in visited])
                at.append(order[np.arange(trees), leaves[rows]].min(1))
        # the last tree, which is whole, holds every row
        options.append((float(np.quantile(np.concatenate(at), s.aim, method="higher")) / len(x) if at else 0.0, trees))
    share, trees = min(options) if any(len(r) for r in wanted) else (0.0, len(forest.splits))
    return replace(forest.first(trees), share=share)


def grow(entries: DataFrame, asked: DataFrame, n: int, s: Settings) -> Banded:
    """Splits from the ``sample`` entries with the smallest hash, shares from as many queries as ``probes``."""
    length = entries.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]

    def some(df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select("entry", "vector").withColumn("h", F.xxhash64("vector")).orderBy("h").limit(most).toArrow()
        return rows.column("entry").to_numpy(), np.array(rows.column("vector").to_pylist(), np.float64)

    names, x = some(entries, s.sample)
    asked_names, q = some(asked, s.probes)
    norms = np.linalg.norm(x, axis=1)
    cuts, low = [], norms.min()
    for k in range(1, s.bands):  # the longer half, quarter, eighth...
        at = np.quantile(norms, 1 - 0.5**k)
        if at > 1.05 * low:
            cuts.append(at)
            low = at
    made = Banded(np.array(cuts), [], float(length))
    band, rng = made.band(x), np.random.default_rng(s.seed)
    wide = int(np.ceil(s.nearest * len(x) / n))  # of the sample lie as near as ``nearest`` of all
    nearest = []
    for name, v in zip(asked_names, q):
        score = np.where(names == name, -np.inf, x @ v)
        nearest.append(np.argsort(-score, kind="stable")[: min(wide, len(x) - int((names == name).any()))])
    for k in range(len(cuts) + 1):
        rows = np.flatnonzero(band == k)
        place = np.full(len(x), -1)
        place[rows] = np.arange(len(rows))
        wanted = [place[t][place[t] >= 0] for t in nearest]
        made.forests.append(measured(plant(x[rows], n * len(rows) / len(x), rng, s), x[rows], q, wanted, s))
    return made


def leaders(dots: np.ndarray, slack: np.ndarray, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and entry of all products that reach the last of ``most`` places, so that ties are settled by id later, and the floor."""
    top = min(dots.shape[1], most)
    least = np.partition(dots, dots.shape[1] - top, axis=1)[:, dots.shape[1] - top]
    return np.nonzero(dots >= np.maximum(least - slack, floor)[:, None])


def search(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """The ``nearest`` found of every query among all other rows of ``vectors`` (vec_id, vector).

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), is_query.alias("is_query"))
    rows = cut(rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("entry", F.xxhash64("vector")))
    # the smallest ids of equal vectors; Spark keeps no more of them before it shuffles
    same = Window.partitionBy("vector", "entry").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "entry"]).select(
        "vec_id", "vector", "entry", F.row_number().over(same).alias("k")
    ).filter(F.col("k") <= s.nearest + 1)
    entries = cut(
        kept.groupBy("entry", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )  # at most nearest + 1 ids
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    asked = cut(rows.filter("is_query").select("entry", "vector").dropDuplicates(["entry"]))
    forest = spark.sparkContext.broadcast(grow(entries, asked, n, s))  # bounded by bands, trees and depth

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("vector").to_pylist(), np.float64).reshape(b.num_rows, -1)
            band = forest.value.band(x)
            for k, part in enumerate(forest.value.forests):
                mine = np.flatnonzero(band == k)
                found = part.leaves(x[mine])
                m = found.shape[1]
                cols = [pa.array(np.tile(np.arange(m) + k * s.trees, len(mine)), pa.int32()), pa.array(found.ravel())]
                entry = b.column("entry").take(pa.array(np.repeat(mine, m)))
                yield pa.RecordBatch.from_arrays([*cols, entry], ["tree", "leaf", "entry"])

    routed = cut(arrow_map(entries.select("entry", "vector"), route, "tree int, leaf long, entry long"))
    sizes = [np.zeros((len(f.splits), 1 << f.depth), np.int64) for f in forest.value.forests]
    for t, leaf, k in routed.groupBy("tree", "leaf").count().collect():  # at most bands x trees x leaves
        sizes[t // s.trees][t % s.trees, leaf] = k
    held = spark.sparkContext.broadcast(sizes)
    least = max(s.least_candidates / n, s.share) / 4  # of the entries of every tree

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], [], []]
            for entry, vector in zip(b.column("entry").to_pylist(), b.column("vector").to_pylist()):
                for k, (part, size) in enumerate(zip(forest.value.forests, held.value)):
                    enough = max(least * size.sum(), part.share * size[0].sum())
                    for turn, (t, leaf) in enumerate(part.search(np.array(vector), enough, size)):
                        for p in range(-(-int(size[t, leaf]) // s.part)):
                            for c, v in zip(out, (t + k * s.trees, leaf, p, entry, turn)):
                                c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["tree", "leaf", "part", "query", "turn"])

    visits = cut(arrow_map(asked, walk, "tree int, leaf long, part int, query long, turn int"))
    in_leaf = Window.partitionBy("tree", "leaf").orderBy("entry")
    parts = routed.withColumn("part", F.floor((F.row_number().over(in_leaf) - 1) / s.part).cast("int"))
    members = parts.join(entries.select("entry", "vector"), "entry").select("tree", "leaf", "part", "entry", "vector")
    asking = asked.select(F.col("entry").alias("query"), F.col("vector").alias("q"))

    length = forest.value.length

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("query", "entry", "score", "slack")}).astype({"query": "int64", "entry": "int64"})
        x, ids = np.stack(left["vector"].to_numpy()), left["entry"].to_numpy()
        out = []
        for i in range(0, len(right), 256):
            q = right.iloc[i : i + 256]
            z = np.stack(q["q"].to_numpy())
            dots = z @ x.T
            slack = 1e-12 * length * np.linalg.norm(z, axis=1)  # more than the products are rounded by
            a, b = leaders(dots, slack, q["floor"].to_numpy(), s.nearest + 1)
            out.append(pd.DataFrame({"query": q["query"].to_numpy()[a], "entry": ids[b], "score": dots[a, b], "slack": slack[a]}))
        return pd.concat(out)

    leaf = ["tree", "leaf", "part"]
    found = "query long, entry long, score double, slack double"

    def seen(some: DataFrame, asking: DataFrame) -> DataFrame:
        visitors = some.drop("turn").join(asking, "query")
        return members.groupBy(*leaf).cogroup(visitors.groupBy(*leaf)).applyInPandas(rank, found)

    def merged(near: DataFrame) -> DataFrame:
        return near.groupBy("query", "entry").agg(F.max("score").alias("about"), F.max("slack").alias("slack"))

    none = F.lit(float("-inf"))
    early = cut(merged(seen(visits.filter(F.col("turn") < s.first), asking.withColumn("floor", none))))
    placed = early.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"))))
    # the last place among some is no better than among all; four roundings are more than what is kept below it in the end
    floors = placed.filter(F.col("r") == s.nearest + 1).select("query", (F.col("about") - 4 * F.col("slack")).alias("floor"))
    asking = asking.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", none))
    late = seen(visits.filter(F.col("turn") >= s.first), asking)
    near = merged(early.withColumnRenamed("about", "score").unionByName(late))
    best = Window.partitionBy("query").orderBy(F.desc("about"))
    # rounding of the block products may swap near ties: all within it of the last place stay, the exact score decides
    last_place = F.min(F.when(F.col("r") <= s.nearest + 1, F.col("about"))).over(Window.partitionBy("query"))
    near = near.withColumn("r", F.row_number().over(best)).withColumn("least", last_place)
    near = near.filter(F.col("about") >= F.col("least") - 2 * F.col("slack")).select("query", "entry")
    dot = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    exact = (
        near.join(entries, "entry")
        .join(asked.select(F.col("entry").alias("query"), F.col("vector").alias("q")), "query")
        .select("query", F.explode("ids").alias("vec_id"), dot.alias("score"))
    )
    few = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    exact = cut(exact.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= s.nearest + 1).drop("r"))
    queries = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).distinct()
    last = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(exact, "query")
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= s.nearest)
        .select("query_id", "rank", "vec_id", "score")
    )

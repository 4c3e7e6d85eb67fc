"""One-to-one matching of predicted spans to gold spans.

Inputs
  docs  (doc_id, text)
  gold  (doc_id, idx, comp_id, ctype, start_off, end_off)
  pred  (system_id, doc_id, idx, comp_id, ctype, start_off, end_off)

Output of :func:`match`
  pairs (criterion, system_id, doc_id, g_idx, p_idx, g_id, p_id, g_type, p_type, ratio)

How it stays exact without pairing everything with everything:

1. Spans with the same key (offsets for the exact criteria, token range for the
   overlap criteria, plus the type where typed) are paired k-th with k-th. Under the overlap criteria these are the pairs of ratio 1, which
   the greedy order takes first.
2. What is left meets on shared cells of a token grid, so only neighbours are
   compared, and only pairs at or over the threshold go on.
3. The greedy one-to-one choice folds over the sorted candidates of a document.

Spans and text travel once, dealt and sorted by document; a task takes some thousand rows of whole
documents at a time and makes the three steps in arrays. Documents with too many spans for one
group take another way: their spans are written after step 1 and dealt by cell, and where too many are
left over, rounds of mutually best choices over distinct ranges give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as tx
from marginalia.functions.groups import ranks, spread, whole_groups
from marginalia.schemas import STANDARD_CRITERIA, Criterion
from marginalia.session import cut, dealt, scratch_path, ship

# Tokens per grid cell.
CELL = 16
# Largest (gold leftovers x prediction leftovers) of a document folded in one group.
FOLD_LIMIT = 4_000_000
# Rows a task takes at a time, as far as documents end there, and pairs it looks at together.
PIECE, PAIRS = 50_000, 1_000_000

UNIT = ["criterion", "system_id", "doc_id"]
# (output name, span column) of the fields carried for each side
SIDE_FIELDS = (
    ("idx", "idx"), ("id", "comp_id"), ("type", "ctype"), ("lo", "lo"), ("hi", "hi"),
)
PAIR = [*UNIT, "g_idx", "p_idx", "g_id", "p_id", "g_type", "p_type", "ratio"]


def token_ranges(docs: DataFrame, gold: DataFrame, pred: DataFrame, rows: int | None = None) -> DataFrame:
    """Both sides' spans with their token range ``[lo, hi)``; unknown documents drop out.

    ``side`` is ``g`` or ``p``; gold rows have no system. ``rows``: how many spans, where known.
    """
    cols = ["side", "system_id", "doc_id", "idx", "comp_id", "ctype", "start_off", "end_off"]
    sys_type = pred.schema["system_id"].dataType
    both = (
        gold.withColumn("side", F.lit("g"))
        .withColumn("system_id", F.lit(None).cast(sys_type))
        .select(cols)
        .unionByName(pred.withColumn("side", F.lit("p")).select(cols))
    )
    found = tx.with_token_indexes(both, docs, {"lo": ("start_off", "lo"), "hi": ("end_off", "hi")}, rows)
    return found.select(*cols, "lo", "hi")


def _per_criterion(
    ranges: DataFrame, systems: Sequence, criteria: Sequence[Criterion]
) -> DataFrame:
    """One row per span, criterion and system, with the key of step 1.

    Until the pairs are done a criterion is its position in the list: short keys
    hash and sort faster than labels.
    """
    options = F.array(
        *[
            F.struct(
                F.lit(code).alias("criterion"),
                F.lit(c.typed).alias("typed"),
                F.lit(c.span == "exact").alias("exact"),
            )
            for code, c in enumerate(criteria)
        ]
    )
    sys_type = ranges.schema["system_id"].dataType
    every = F.array(*[F.lit(s).cast(sys_type) for s in systems])
    empty = F.col("hi") <= F.col("lo")
    exact = F.col("c.exact")
    return (
        ranges.withColumn("c", F.explode(options))
        .withColumn(
            "system_id",
            F.explode(F.when(F.col("side") == "g", every).otherwise(F.array("system_id"))),
        )
        .select(
            F.col("c.criterion").alias("criterion"),
            exact.alias("exact"),
            "system_id",
            "doc_id",
            "side",
            "idx",
            "comp_id",
            "ctype",
            "lo",
            "hi",
            # '' stands for an absent type, so absent agrees with absent
            F.when(F.col("c.typed"), F.coalesce("ctype", F.lit(""))).otherwise("*").alias("tkey"),
            # ranges covering no token all agree with one another
            F.when(exact, F.col("start_off")).when(empty, -1).otherwise(F.col("lo")).alias("k1"),
            F.when(exact, F.col("end_off")).when(empty, -1).otherwise(F.col("hi")).alias("k2"),
        )
    )


def _same_key(spans: DataFrame) -> DataFrame:
    """Step 1: k-th gold with k-th prediction of each key; unmatched sides stay null.

    The first window numbers each side, the second puts equal numbers next to each other,
    gold first. Spans that are dealt by document stay where they are.
    """
    key = ["__key", *UNIT, "exact", "tkey", "k1", "k2"]
    # a hash in front settles most comparisons of the sorts
    numbered = spans.withColumn("__key", F.xxhash64(*key[1:])).withColumn(
        "nth", F.row_number().over(W.partitionBy(*key, "side").orderBy("idx"))
    )
    order = W.partitionBy(*key).orderBy("nth", "side")
    span = F.struct("nth", "side", "idx", "comp_id", "ctype", "lo", "hi")
    mine, after = F.col("me"), F.col("after")
    placed = (
        numbered.withColumn("me", span)
        .withColumn("after", F.lead("me").over(order))
        .withColumn("prior_nth", F.lag("nth").over(order))
    )
    is_gold = F.col("side") == "g"
    met = F.coalesce(after["nth"] == F.col("nth"), F.lit(False))
    other = F.when(is_gold & met, after)
    out = [F.col(c) for c in (*UNIT, "exact", "tkey")]
    for name, at in (
        ("g", F.when(is_gold, mine)),
        ("p", F.when(is_gold, other).otherwise(mine)),
    ):
        for new, old in SIDE_FIELDS:
            out.append(at[old].alias(f"{name}_{new}"))
    # a prediction right behind its gold partner is already on that row
    spoken_for = ~is_gold & F.coalesce(F.col("prior_nth") == F.col("nth"), F.lit(False))
    return placed.filter(~spoken_for).select(out)


def _cells(df: DataFrame, lo: str, hi: str) -> DataFrame:
    first, last = F.floor(F.col(lo) / CELL), F.floor((F.col(hi) - 1) / CELL)
    return df.withColumn("cell", F.explode(F.sequence(first, last)))


def _near(golds: DataFrame, preds: DataFrame, on: list[str], criterion: Criterion) -> DataFrame:
    """Step 2: ranges sharing a grid cell whose ratio reaches the threshold.

    A pair is kept only in the cell where its shared part begins, so it appears once.
    """
    shared_from = F.floor(F.greatest("g_lo", "p_lo") / CELL)
    ratio = tx.overlap_ratio(*[F.col(c) for c in ("g_lo", "g_hi", "p_lo", "p_hi")],
                             criterion.overlap_mode)
    return (
        _cells(golds, "g_lo", "g_hi")
        .join(_cells(preds, "p_lo", "p_hi"), [*on, "cell"])
        .filter(shared_from == F.col("cell"))
        .withColumn("ratio", ratio)
        .filter(F.col("ratio") >= F.lit(float(criterion.threshold)))
        .drop("cell")
    )


def candidates(
    docs: DataFrame, gold: DataFrame, pred: DataFrame, criterion: Criterion
) -> DataFrame:
    """All gold/prediction pairs of a document reaching the criterion's threshold."""
    ranges = token_ranges(docs, gold, pred)
    tkey = F.coalesce("ctype", F.lit("")) if criterion.typed else F.lit("*")
    ranges = ranges.withColumn("tkey", tkey)

    def side(name: str) -> DataFrame:
        keep = ["doc_id", "tkey"] + (["system_id"] if name == "p" else [])
        return ranges.filter(F.col("side") == name).select(
            *keep,
            F.col("idx").alias(f"{name}_idx"),
            F.col("lo").alias(f"{name}_lo"),
            F.col("hi").alias(f"{name}_hi"),
        )

    def empty(name: str) -> Column:
        return F.col(f"{name}_hi") <= F.col(f"{name}_lo")

    on = ["doc_id", "tkey"]
    out = ["system_id", "doc_id", "g_idx", "p_idx", "ratio"]
    near = _near(side("g").filter(~empty("g")), side("p").filter(~empty("p")), on, criterion)
    # two ranges without tokens agree fully
    bare = (
        side("g").filter(empty("g")).join(side("p").filter(empty("p")), on)
        .withColumn("ratio", F.lit(1.0))
    )
    return near.select(out).unionByName(bare.select(out))


ITEM = ("g_idx", "p_idx", "g_id", "p_id", "g_type", "p_type")


def _taken(items: Column) -> Column:
    """The greedy choice among sorted candidates: one that shares a span with an earlier choice is passed over."""
    return F.aggregate(
        items,
        F.slice(items, 1, 0),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["g_idx"] == x["g_idx"]) | (y["p_idx"] == x["p_idx"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )


def _shown(grouped: DataFrame, items: Column) -> DataFrame:
    return (
        grouped.select(*UNIT, F.explode(items).alias("x"))
        .select(*UNIT, "x.*")
        .withColumn("ratio", -F.col("order"))
        .select(PAIR)
    )


def _fold(cands: DataFrame) -> DataFrame:
    """Greedy choice inside each document: best ratio first, then gold, then prediction order."""
    item = F.struct((-F.col("ratio")).alias("order"), *ITEM)
    grouped = cands.groupBy(*UNIT).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return _shown(grouped, _taken(F.col("items")))


def _ranged(t: pa.Table, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """``doc, row, lo, hi, lo_known, hi_known`` of the spans of a piece; an end is known where its position and the text are there.

    As in :func:`tx.with_token_indexes` a span counts once for each length a repeated document has,
    and each end once for each of its texts that reaches there.
    """
    is_text = pc.equal(t.column("side"), "t").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(at)), np.diff(np.r_[at, t.num_rows]))
    there = np.flatnonzero(is_text)
    body = t.column("text").take(pa.array(there)).to_pylist()
    texts = tx.Texts([b or "" for b in body], words)
    size = texts.ends - texts.starts
    valid = np.array([b is not None for b in body], bool)
    n = np.bincount(doc[there], minlength=len(at))
    first = np.zeros(len(at), np.int64)
    first[doc[there][::-1]] = np.arange(len(there))[::-1]

    def of(name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = t.column(name).take(pa.array(rows))
        return pc.fill_null(c, 0).to_numpy(), c.is_valid().to_numpy()

    # a document has its texts one after the other among the texts of the piece
    spans = np.flatnonzero(~is_text)
    row = np.repeat(spans, n[doc[spans]])
    text = spread(first[doc[spans]], n[doc[spans]])
    ends = []
    for name, side in (("start_off", "lo"), ("end_off", "hi")):
        position, ok = of(name, row)
        place = np.maximum(np.where(valid[text], np.minimum(position, size[text]), position), 0)
        ends.append((place, ok, side))
    odd = (n[doc[row]] > 1) | ~valid[text]
    plain = np.flatnonzero(~odd)
    (x, x_ok, x_side), (y, y_ok, y_side) = ends
    lo, hi = texts.tokens(text[plain], x[plain], x_side), texts.tokens(text[plain], y[plain], y_side)
    out = [doc[row[plain]], row[plain], lo, hi, x_ok[plain], y_ok[plain]]
    if len(plain) < len(row):
        picked = []
        for k in np.flatnonzero(odd):
            d, found = doc[row[k]], []
            for place, ok, side in ends:
                hits = [
                    u for u in range(first[d], first[d] + n[d])
                    if ok[k] and valid[u] and place[k] // tx.BLOCK <= -(-size[u] // tx.BLOCK)
                ]
                found.append([(int(texts.tokens(np.array([u]), place[k : k + 1], side)[0]), True) for u in hits] or [(0, False)])
            picked += [(d, row[k], lo, hi, p, q) for lo, p in found[0] for hi, q in found[1]]
        out = [np.r_[o, z] for o, z in zip(out, np.array(picked, np.int64).T)]
    return *out[:4], out[4].astype(bool), out[5].astype(bool)


def _matched(t: pa.Table, at: np.ndarray, words: np.ndarray, systems: list[int], system: np.ndarray, criteria) -> tuple[np.ndarray, ...]:
    """``criterion, g_row, p_row, ratio`` of the pairs of a piece.

    ``system`` numbers the systems of the rows, -1 where nobody asked for one; ``systems`` are those asked for.
    """
    doc, row, lo, hi, lo_known, hi_known = _ranged(t, at, words)
    gold = pc.equal(t.column("side"), "g").to_numpy(zero_copy_only=False)[row]
    mine, theirs = np.flatnonzero(gold), np.flatnonzero(~gold & (system[row] >= 0))
    # all from here on by span and system
    span = np.r_[np.repeat(mine, len(systems)), theirs]
    unit = doc[span] * (max(systems, default=0) + 1) + np.r_[np.tile(np.array(systems, np.int64), len(mine)), system[row[theirs]]]
    side, row, lo, hi = (~gold[span]).astype(np.int64), row[span], lo[span], hi[span]
    lo_known, hi_known = lo_known[span], hi_known[span]
    known = lo_known & hi_known
    ctype = pc.fill_null(t.column("ctype"), "").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)[row]
    idx = t.column("idx")
    order, named = ranks(idx)[row], idx.is_valid().to_numpy()[row]
    start, end = (ranks(t.column(c))[row] for c in ("start_off", "end_off"))
    empty, some = known & (hi <= lo), known & (hi > lo)
    ties = None
    out = []
    for code, c in enumerate(criteria):
        exact = c.span == "exact"
        tkey = ctype if c.typed else np.zeros(len(row), np.int64)
        # ranges covering no token all agree with one another, and so do unknown ends
        k1 = start if exact else np.where(empty, -1, np.where(lo_known, lo, -2))
        k2 = end if exact else np.where(empty, -1, np.where(hi_known, hi, -2))
        # step 1
        by = np.lexsort((order, side, k2, k1, tkey, unit))
        u, ty, a, b = unit[by], tkey[by], k1[by], k2[by]
        new = np.flatnonzero((u[1:] != u[:-1]) | (ty[1:] != ty[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        if not len(by):
            continue
        begin = np.r_[0, new]
        size = np.diff(np.r_[begin, len(by)])
        preds = np.add.reduceat(side[by], begin)
        golds = size - preds
        both = np.minimum(golds, preds)
        g, p = by[spread(begin, both)], by[spread(begin + golds, both)]
        sound = named[g] & named[p]
        out.append((code, row[g[sound]], row[p[sound]], np.ones(sound.sum())))
        if exact:
            continue
        # step 2
        open_ = named & some
        left = np.ones(len(row), bool)
        left[g], left[p] = False, False
        broken = ~sound  # one of the two has no index and is no leftover; the other one is
        left[g[broken & open_[g]]] = True
        left[p[broken & ~open_[g]]] = True
        left &= open_
        g, p = np.flatnonzero(left & (side == 0)), np.flatnonzero(left & (side == 1))
        if not len(g) or not len(p):
            continue
        group = np.unique(np.c_[unit, tkey][np.r_[g, p]], axis=0, return_inverse=True)[1].ravel()
        cells = int(hi[np.r_[g, p]].max()) // CELL + 1

        def placed(x: np.ndarray, its: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = (hi[x] - 1) // CELL - lo[x] // CELL + 1
            return np.repeat(x, n), np.repeat(its * cells, n) + spread(lo[x] // CELL, n)

        (g, g_cell), (p, p_cell) = placed(g, group[: len(g)]), placed(p, group[len(g) :])
        sort = np.argsort(g_cell, kind="stable")
        g, g_cell = g[sort], g_cell[sort]
        low, high = np.searchsorted(g_cell, p_cell, "left"), np.searchsorted(g_cell, p_cell, "right")
        met, base = high - low, 0
        total = np.cumsum(met)
        near = []
        while base < len(p):
            stop = max(base + 1, int(np.searchsorted(total, (total[base - 1] if base else 0) + PAIRS, "right")))
            x, y = g[spread(low[base:stop], met[base:stop])], np.repeat(p[base:stop], met[base:stop])
            cell = np.repeat(p_cell[base:stop] % cells, met[base:stop])
            shared = np.minimum(hi[x], hi[y]) - np.maximum(lo[x], lo[y])
            ratio = np.maximum(shared, 0) / (hi[x] - lo[x] + hi[y] - lo[y] - np.maximum(shared, 0))
            # a pair stands in the cell where its shared part begins
            hit = (ratio >= float(c.threshold)) & (np.maximum(lo[x], lo[y]) // CELL == cell)
            near.append((x[hit], y[hit], ratio[hit]))
            base = stop
        x, y, ratio = (np.concatenate(parts) for parts in zip(*near))
        # step 3
        keys = [order[y], order[x], -ratio, unit[x]]
        sort = np.lexsort(keys)
        same = np.logical_and.reduce([k[sort][1:] == k[sort][:-1] for k in keys])
        if same.any():
            if ties is None:
                ties = [ranks(t.column(name)) for name in ("ctype", "comp_id")]
            sort = np.lexsort([f[row[z]] for f in ties for z in (y, x)] + keys)
        x, y, ratio = x[sort], y[sort], ratio[sort]
        # spans that share an index stand for one another here
        most = int(order.max()) + 1
        used_g, used_p, taken = set(), set(), []
        for k, (i, j) in enumerate(zip((unit[x] * most + order[x]).tolist(), (unit[x] * most + order[y]).tolist())):
            if i not in used_g and j not in used_p:
                used_g.add(i)
                used_p.add(j)
                taken.append(k)
        out.append((code, row[x[taken]], row[y[taken]], ratio[taken]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0)
    codes = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
    return codes, *(np.concatenate([o[i] for o in out]) for i in (1, 2, 3))


def _at_once(docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: Sequence, criteria: Sequence[Criterion], rows: int | None) -> DataFrame:
    """All three steps where no document is crowded: spans and text are dealt and sorted by document once."""
    spark = docs.sparkSession
    ship(spark)
    words = tx.word_points(spark)
    cols = ["system_id", "doc_id", "idx", "comp_id", "ctype", "start_off", "end_off"]
    spans = (
        pred.select(*cols, F.lit("p").alias("side"))
        .unionByName(gold.select(*cols[1:], F.lit("g").alias("side")), allowMissingColumns=True)
        .withColumn("start_off", F.col("start_off").cast("bigint"))
        .withColumn("end_off", F.col("end_off").cast("bigint"))
    )
    texts = docs.select("doc_id", "text", F.lit("t").alias("side"))
    every = spans.unionByName(texts, allowMissingColumns=True).filter(F.col("doc_id").isNotNull())
    sorted_ = dealt(every, rows, "doc_id").sortWithinPartitions("doc_id")
    kinds = {f.name: f.dataType for f in every.schema}
    fields = {"criterion": T.IntegerType(), "ratio": T.DoubleType()}
    fields |= {f"{s}_{new}": kinds[old] for s in "gp" for new, old in SIDE_FIELDS[:3]}
    schema = T.StructType([T.StructField(c, fields.get(c) or kinds[c]) for c in PAIR])
    asked = list(dict.fromkeys(systems))
    numbers = [asked.index(s) for s in systems]
    criteria = list(criteria)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["doc_id"], PIECE):
            kind = t.schema.field("system_id").type
            known = pa.array(asked).cast(kind) if asked else pa.array([], kind)
            system = pc.fill_null(pc.index_in(t.column("system_id"), known, skip_nulls=True), -1).to_numpy().astype(np.int64)
            code, g, p, ratio = _matched(t, at, words.value, numbers, system, criteria)
            made = {"criterion": pa.array(code, pa.int32()), "ratio": pa.array(ratio, pa.float64())}
            g, p = pa.array(g), pa.array(p)
            made |= {c: t.column(c).take(p) for c in ("system_id", "doc_id")}
            made |= {f"{s}_{new}": t.column(old).take(x) for s, x in (("g", g), ("p", p)) for new, old in SIDE_FIELDS[:3]}
            yield from pa.table({c: made[c] for c in PAIR}).to_batches(max_chunksize=PIECE)

    return sorted_.mapInArrow(work, schema)


def _rounds(left_g: DataFrame, left_p: DataFrame, criterion: Criterion) -> DataFrame:
    """The greedy choice without gathering a document in one place.

    Spans with the same range and type key form a class and are used up in index
    order, so the choice is made between classes by their lowest unused member.
    A pair of classes that prefer each other is right under the greedy order, and
    so are their next members for as long as no equally good class comes first.
    """
    key = [*UNIT, "tkey"]
    gk, pk = [*key, "g_lo", "g_hi"], [*key, "p_lo", "p_hi"]
    left_g, left_p = cut(left_g), cut(left_p)
    edges = cut(_near(left_g.select(gk).distinct(), left_p.select(pk).distinct(), key, criterion))
    found: list[DataFrame] = []
    while True:
        g_head = left_g.groupBy(*gk).agg(F.min("g_idx").alias("g_head"))
        p_head = left_p.groupBy(*pk).agg(F.min("p_idx").alias("p_head"))
        live = edges.join(g_head, gk).join(p_head, pk)
        order = F.struct((-F.col("ratio")).alias("o"), "g_head", "p_head")
        live = cut(live.withColumn("order", order))
        best_g = live.groupBy(*gk).agg(F.min("order").alias("order"))
        best_p = live.groupBy(*pk).agg(F.min("order").alias("order"))
        chosen = live.join(best_g, [*gk, "order"]).join(best_p, [*pk, "order"])

        def rival(side: list[str], head: str, name: str, other: str) -> DataFrame:
            """Lowest member of another class that this side likes just as well."""
            mine = chosen.select(*side, "ratio", F.col(other).alias("__other"))
            return (
                live.join(mine, [*side, "ratio"])
                .filter(F.col(other) != F.col("__other"))
                .groupBy(*side)
                .agg(F.min(head).alias(name))
            )

        chosen = cut(
            chosen.join(rival(pk, "g_head", "g_stop", "g_head"), pk, "left")
            .join(rival(gk, "p_head", "p_stop", "p_head"), gk, "left")
            .select(*key, "g_lo", "g_hi", "p_lo", "p_hi", "ratio", "g_stop", "p_stop")
        )
        if chosen.isEmpty():
            break

        def take(left: DataFrame, side: list[str], idx: str, stop: str) -> DataFrame:
            nth = F.row_number().over(W.partitionBy(*side).orderBy(idx))
            return (
                left.join(chosen.select(*side, stop), side)
                .filter(F.col(stop).isNull() | (F.col(idx) < F.col(stop)))
                .withColumn("nth", nth)
                .drop(stop)
            )

        pairs = cut(
            take(left_g, gk, "g_idx", "g_stop")
            .join(chosen.drop("g_stop", "p_stop"), gk)
            .join(take(left_p, pk, "p_idx", "p_stop"), [*pk, "nth"])
            .select(PAIR)
        )
        found.append(pairs)
        left_g = cut(left_g.join(pairs, [*UNIT, "g_idx"], "left_anti"))
        left_p = cut(left_p.join(pairs, [*UNIT, "p_idx"], "left_anti"))
    if not found:
        return chosen.sparkSession.createDataFrame([], left_pairs_schema(left_g, left_p))
    return reduce(DataFrame.unionByName, found)


def left_pairs_schema(left_g: DataFrame, left_p: DataFrame):
    """The schema of an empty pair table for these leftovers."""
    g = {f.name: f for f in left_g.schema}
    p = {f.name: f for f in left_p.schema}
    ratio = {"ratio": T.StructField("ratio", T.DoubleType())}
    return T.StructType([{**ratio, **p, **g}[c] for c in PAIR])


def match(
    docs: DataFrame,
    gold: DataFrame,
    pred: DataFrame,
    systems: Sequence,
    criteria: Sequence[Criterion] = STANDARD_CRITERIA,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Greedy one-to-one pairs under every criterion."""
    if any(c.threshold <= 0 for c in criteria):
        raise ValueError("a threshold must be above zero")
    def labelled(pairs: DataFrame, group: Sequence[Criterion]) -> DataFrame:
        names = F.array(*[F.lit(c.label) for c in group])
        return pairs.withColumn("criterion", F.element_at(names, F.col("criterion") + 1))

    rows, big = _crowded(gold, pred, fold_limit)
    if all(c.span == "exact" for c in criteria):
        return labelled(_at_once(docs, gold, pred, systems, criteria, rows), criteria)

    ranges = token_ranges(docs, gold, pred, rows)
    plain = [c for c in criteria if c.span == "exact" or c.overlap_mode == "jaccard"]
    recall = [c for c in criteria if c not in plain]
    parts: list[DataFrame] = []
    if plain:
        light = [t if big is None else t.join(big, "doc_id", "left_anti") for t in (docs, gold, pred)]
        parts.append(labelled(_at_once(*light, systems, plain, rows), plain))
    for group in filter(None, (plain if big is not None else None, recall)):
        if group is plain:
            heavy = ranges.join(big, "doc_id", "left_semi")
            first = cut(_same_key(_per_criterion(heavy, systems, group)))
            alone = F.col("g_idx").isNull() | F.col("p_idx").isNull()
            rest = first.filter(~F.col("exact") & alone)
            found = [_paired(first)]
        else:
            # a gold span inside a longer prediction also has ratio 1: step 1 does not apply
            rest, found = cut(_one_sided(_per_criterion(ranges, systems, group))), []
        overlaps = [c for c in group if c.span == "overlap"]
        for threshold in sorted({c.threshold for c in overlaps}):
            same = [c for c in overlaps if c.threshold == threshold]
            codes = [group.index(c) for c in same]
            part = rest.filter(F.col("criterion").isin(codes))
            found += _leftovers(part, same[0], fold_limit, big is not None)
        parts += [labelled(p, group) for p in found]
    return reduce(DataFrame.unionByName, parts)


def _paired(first: DataFrame) -> DataFrame:
    both = F.col("g_idx").isNotNull() & F.col("p_idx").isNotNull()
    return first.filter(both).withColumn("ratio", F.lit(1.0)).select(PAIR)


def _one_sided(spans: DataFrame) -> DataFrame:
    """Every span as a leftover of its own side, in the shape :func:`_same_key` gives."""
    out = [F.col(c) for c in (*UNIT, "exact", "tkey")]
    for name in ("g", "p"):
        mine = F.col("side") == name
        for new, old in SIDE_FIELDS:
            out.append(F.when(mine, F.col(old)).alias(f"{name}_{new}"))
    return spans.select(out)


def _leftovers(
    rest: DataFrame, criterion: Criterion, fold_limit: int, crowded: bool
) -> list[DataFrame]:
    """Steps 2 and 3 on the spans step 1 left over."""
    if crowded:
        sizes = rest.groupBy(*UNIT).agg(
            (F.count("g_idx").cast("double") * F.count("p_idx")).alias("size")
        )
        heavy = cut(sizes.filter(F.col("size") > fold_limit).select(UNIT))
        crowded = not heavy.isEmpty()

    def side(name: str, part: DataFrame) -> DataFrame:
        keep = [c for c in part.columns if c.startswith(f"{name}_")]
        some = F.col(f"{name}_hi") > F.col(f"{name}_lo")
        return part.filter(F.col(f"{name}_idx").isNotNull() & some).select(*UNIT, "tkey", *keep)

    light = rest.join(heavy, UNIT, "left_anti") if crowded else rest
    near = _near(side("g", light), side("p", light), [*UNIT, "tkey"], criterion)
    parts = [_fold(near)]
    if criterion.overlap_mode == "gold_recall":
        parts.append(_bare_pairs(rest))
    if crowded:
        part = rest.join(heavy, UNIT, "left_semi")
        parts.append(_rounds(side("g", part), side("p", part), criterion))
    return parts


def _crowded(gold: DataFrame, pred: DataFrame, fold_limit: int) -> tuple[int, DataFrame | None]:
    """How many spans there are, and the documents that could hold more leftovers than one fold takes, if any.

    Counts spans only: the gold spans of a document times the most predictions a system
    made there.
    """
    system = pred.schema["system_id"].dataType
    ids = gold.select(F.lit("g").alias("side"), F.lit(None).cast(system).alias("system_id"), "doc_id")
    ids = ids.unionByName(pred.select(F.lit("p").alias("side"), "system_id", "doc_id"))
    sizes = ids.groupBy("side", "system_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))

    def top(side: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).cast("double")

    per_doc = sizes.groupBy("doc_id").agg(F.sum("n").alias("n"), (top("g") * top("p")).alias("size"))
    known = F.col("doc_id").isNotNull()
    rows, most = per_doc.agg(F.sum("n"), F.max(F.when(known, F.col("size")))).first()
    if (most or 0) <= fold_limit:
        return rows or 0, None
    return rows, cut(per_doc.filter(known & (F.col("size") > fold_limit)).select("doc_id"))


def _bare_pairs(rest: DataFrame) -> DataFrame:
    """Ranges without tokens pair k-th with k-th (ratio 1)."""
    key = [*UNIT, "tkey"]

    def side(name: str) -> DataFrame:
        keep = [f"{name}_{c}" for c in ("idx", "id", "type")]
        none = F.col(f"{name}_hi") <= F.col(f"{name}_lo")
        nth = F.row_number().over(W.partitionBy(*key).orderBy(f"{name}_idx"))
        return (
            rest.filter(F.col(f"{name}_idx").isNotNull() & none)
            .select(*key, *keep)
            .withColumn("nth", nth)
        )

    return (
        side("g").join(side("p"), [*key, "nth"]).withColumn("ratio", F.lit(1.0)).select(PAIR)
    )


def agreement(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """First-fit pairing of two systems by character overlap over union.

    Left components are taken in order, each with the first free right component
    that reaches the threshold. Only spans meeting on a character grid are compared.

    A pair that is the first of both its sides is right whatever comes later. Rounds take
    all such pairs and drop the others of the spans they used; no document is gathered.
    There are as many rounds as pairs wait for one another in the longest chain.
    """
    key = ["doc_id"]
    size = 64

    def side(df: DataFrame, name: str) -> DataFrame:
        spans = df.select(
            *key,
            F.col("idx").alias(f"{name}_idx"),
            F.col("comp_id").alias(f"{name}_id"),
            F.col("start_off").alias(f"{name}_lo"),
            F.col("end_off").alias(f"{name}_hi"),
        )
        first, last = F.floor(F.col(f"{name}_lo") / size), F.floor((F.col(f"{name}_hi") - 1) / size)
        return spans.withColumn("cell", F.explode(F.sequence(first, last)))

    shared = F.least("l_hi", "r_hi") - F.greatest("l_lo", "r_lo")
    union = F.greatest("l_hi", "r_hi") - F.least("l_lo", "r_lo")
    near = (
        side(left, "l")
        .join(side(right, "r"), [*key, "cell"])
        .filter(F.floor(F.greatest("l_lo", "r_lo") / size) == F.col("cell"))
        .filter((shared > 0) & (shared.cast("double") / union >= threshold))
    )
    # a pair of places that occurs twice counts by its first ids
    ids = F.struct("l_id", "r_id")
    left_over = cut(near.groupBy(*key, "l_idx", "r_idx").agg(F.min(ids).alias("ids")))
    path, done = scratch_path(left.sparkSession, "agreed"), 0
    while True:
        first_r = left_over.groupBy(*key, "l_idx").agg(F.min("r_idx").alias("r_idx"))
        first_l = left_over.groupBy(*key, "r_idx").agg(F.min("l_idx").alias("l_idx"))
        sure = left_over.join(first_r.join(first_l, [*key, "l_idx", "r_idx"]), [*key, "l_idx", "r_idx"], "left_semi")
        sure.write.parquet(f"{path}/round={done}")
        taken = left.sparkSession.read.schema(left_over.schema).parquet(f"{path}/round={done}")
        if done and taken.isEmpty():
            break
        rest = left_over.join(taken.select(*key, "l_idx"), [*key, "l_idx"], "left_anti")
        left_over = cut(rest.join(taken.select(*key, "r_idx"), [*key, "r_idx"], "left_anti"))
        done += 1
    found = left.sparkSession.read.schema(left_over.schema).parquet(*[f"{path}/round={i}" for i in range(done)])
    return found.select(*key, "l_idx", "r_idx", "ids.*")


def agreement_rate(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document the components of both systems, the pairs, and the share of components in a pair."""
    sides = (
        left.select("doc_id", F.lit(1).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("p"))
        .unionByName(right.select("doc_id", F.lit(0).alias("l"), F.lit(1).alias("r"), F.lit(0).alias("p")))
        .unionByName(pairs.select("doc_id", F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(1).alias("p")))
    )
    counts = sides.groupBy("doc_id").agg(*[F.sum(c).alias(n) for c, n in (("l", "n_left"), ("r", "n_right"), ("p", "n_paired"))])
    return counts.withColumn("rate", 2 * F.col("n_paired") / (F.col("n_left") + F.col("n_right")))

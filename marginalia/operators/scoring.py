"""Per-document counts and corpus scores for components and relations.

All counts come from one additive table: a gold item adds a miss, a predicted
item adds a false alarm, and every matched pair takes one of each away again and
adds a hit. One grouped sum then gives overall and by-type counts together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.functions.groups import codes, dense, ranks, whole_groups
from marginalia.functions.stats import prf_columns
from marginalia.operators.matching import PIECE, UNIT, match
from marginalia.schemas import STANDARD_CRITERIA, Criterion
from marginalia.session import cut, dealt, ship

SCORE = ["system_id", "criterion", "doc_id", "kind", "label", "tp", "fp", "fn"]


def _type_label(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("untyped"))


def edge_matches(
    pairs: DataFrame,
    gold_rel: DataFrame,
    pred_rel: DataFrame,
    criteria: Sequence[Criterion] = STANDARD_CRITERIA,
) -> DataFrame:
    """Matched edges per key: (criterion, system_id, doc_id, src, tgt, rkey, hits).

    Predicted endpoints are renamed to the gold components they were paired with.
    A repeated edge counts as often as both sides hold it.
    """
    name, link, wish = 0, 1, 2
    typed = [c.label for c in criteria if c.typed]
    # everything travels once, dealt and sorted by document
    rows = (
        pairs.select(*UNIT, F.col("p_id").alias("end"), "g_id", "g_idx", F.lit(name).alias("kind"))
        .filter(F.col("end").isNotNull())
        .unionByName(
            pred_rel.select("system_id", "doc_id", "src", "tgt", "rtype", F.lit(link).alias("kind")),
            allowMissingColumns=True,
        )
        .unionByName(
            gold_rel.select("doc_id", "src", "tgt", "rtype", F.lit(wish).alias("kind")), allowMissingColumns=True
        )
        .filter(F.col("doc_id").isNotNull())
    )
    rows = dealt(rows, pairs.count() + pred_rel.count(), "doc_id")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*(T.StructField(c, kinds[c]) for c in (*UNIT, "src", "tgt")), T.StructField("rkey", T.StringType()), T.StructField("hits", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["doc_id"], PIECE):
            yield from _edges(t, at, (name, link, wish), typed).cast(to_arrow_schema(out)).to_batches(max_chunksize=PIECE)

    ship(rows.sparkSession)
    return rows.sortWithinPartitions("doc_id").mapInArrow(work, out)


def _edges(t: pa.Table, at: np.ndarray, kinds: tuple[int, int, int], typed: list[str]) -> pa.Table:
    """The matched edges of a piece of whole documents."""
    name, link, wish = (np.flatnonzero(t.column("kind").to_numpy() == k) for k in kinds)
    doc = np.repeat(np.arange(len(at)), np.diff(np.r_[at, t.num_rows]))
    (system,), _ = codes(t.column("system_id"))
    (criterion,), labels = codes(t.column("criterion"))
    (end, src, tgt, g_id), ids = codes(*(t.column(c) for c in ("end", "src", "tgt", "g_id")))
    (rtype, star), types = codes(t.column("rtype"), pa.array(["*"]))
    # an endpoint is the gold component its prediction was paired with, one for each criterion: the last one
    name = name[np.argsort(ranks(t.column("g_idx"))[name], kind="stable")]
    ends = dense(*(np.r_[c[name], c[link], c[link]] for c in (doc, system)), np.r_[end[name], src[link], tgt[link]])
    paired = np.full((int(ends.max(initial=-1)) + 1, len(labels)), -1)
    paired[ends[: len(name)], criterion[name]] = name
    at_src, at_tgt = paired[ends[len(name) : len(name) + len(link)]], paired[ends[len(name) + len(link) :]]
    k, c = np.nonzero((at_src >= 0) & (at_tgt >= 0))
    by_type = np.array([x in typed for x in labels.to_pylist()], bool)
    mine = link[k], c, g_id[at_src[k, c]], g_id[at_tgt[k, c]], np.where(by_type[c], rtype[link[k]], star[0])
    known = (mine[2] >= 0) & (mine[3] >= 0) & (mine[4] >= 0)
    row, c, a, b, r = (x[known] for x in mine)
    theirs = np.r_[wish, wish], np.r_[src[wish], src[wish]], np.r_[tgt[wish], tgt[wish]], np.r_[rtype[wish], np.full(len(wish), star[0])]
    known = (theirs[1] >= 0) & (theirs[2] >= 0) & (theirs[3] >= 0)
    g_row, g_a, g_b, g_r = (x[known] for x in theirs)
    edge = dense(np.r_[doc[row], doc[g_row]], np.r_[a, g_a], np.r_[b, g_b], np.r_[r, g_r])
    n_gold = np.bincount(edge[len(row) :], minlength=int(edge.max(initial=-1)) + 1)
    _, first, n = np.unique(dense(edge[: len(row)], system[row], c), return_index=True, return_counts=True)
    hits = np.minimum(n, n_gold[edge[first]])
    first, hits = first[hits > 0], hits[hits > 0]
    made = {"criterion": labels.take(pa.array(c[first]))}
    made |= {x: t.column(x).take(pa.array(row[first])) for x in ("system_id", "doc_id")}
    made |= {x: ids.take(pa.array(y[first])) for x, y in (("src", a), ("tgt", b))}
    return pa.table(made | {"rkey": types.take(pa.array(r[first])), "hits": pa.array(hits)})


def document_scores(
    docs: DataFrame,
    gold: DataFrame,
    pred: DataFrame,
    gold_rel: DataFrame,
    pred_rel: DataFrame,
    systems: Sequence,
    criteria: Sequence[Criterion] = STANDARD_CRITERIA,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Counts per (system, criterion, document, kind, label); label ``*`` is overall.

    Every document appears for every system: without a prediction all gold items
    are misses. Predictions for documents outside ``docs`` are ignored. Relation
    types are told apart only under the typed criteria.
    """
    sys_type = pred.schema["system_id"].dataType
    ids = docs.select("doc_id")
    if pairs is None:
        pairs = cut(match(docs, gold, pred, systems, criteria))
    base, in_gold, in_pred, paired, gold_link, pred_link, met = range(7)
    none, n, part = F.lit(0).cast("bigint"), F.col("n"), F.col("part")

    # items are counted per document and label; all counts travel once, dealt by document,
    # before they are spread over systems, criteria and labels
    def items(df: DataFrame, code: int, label: Column, *keys: str) -> DataFrame:
        tally = df.groupBy("doc_id", *keys, label.alias("a")).agg(F.count(F.lit(1)).alias("n"))
        return tally.withColumn("part", F.lit(code))

    edges = edge_matches(pairs, gold_rel, pred_rel, criteria)
    counted = [
        items(gold, in_gold, _type_label("ctype")),
        items(pred, in_pred, _type_label("ctype"), "system_id"),
        pairs.select(
            *UNIT, _type_label("g_type").alias("a"), _type_label("p_type").alias("b"),
            F.lit(1).cast("bigint").alias("n"), F.lit(paired).alias("part"),
        ),
        items(gold_rel, gold_link, F.col("rtype")),
        items(pred_rel, pred_link, F.col("rtype"), "system_id"),
        edges.select(*UNIT, F.col("rkey").alias("a"), F.col("hits").alias("n"), F.lit(met).alias("part")),
    ]
    table = ids.withColumn("part", F.lit(base))
    for some in counted:
        table = table.unionByName(some, allowMissingColumns=True)
    every = F.array(*[F.lit(s).cast(sys_type) for s in systems])
    labels = F.array(*[F.lit(c.label) for c in criteria])
    typed = F.col("criterion").isin([c.label for c in criteria if c.typed])
    table = (
        dealt(table.filter(F.col("doc_id").isNotNull()), pairs.count(), "doc_id")
        .withColumn("system_id", F.explode(F.when(part.isin(base, in_gold, gold_link), every).otherwise(F.array("system_id"))))
        .withColumn("criterion", F.explode(F.when(part.isin(paired, met), F.array("criterion")).otherwise(labels)))
    )

    def row(kind: str, label: Column | str, tp: Column, fp: Column, fn: Column) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(
            F.lit(kind).alias("kind"), label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    def two(kind: str, label: Column, tp: Column, fp: Column, fn: Column) -> Column:
        return F.array(row(kind, "*", tp, fp, fn), row(kind, label, tp, fp, fn))

    def one(kind: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.array(row(kind, "*", tp, fp, fn))

    a, c, r = F.col("a"), "components", "relations"
    counts = (
        F.when(part == base, F.array(row(c, "*", none, none, none), row(r, "*", none, none, none)))
        .when(part == in_gold, two(c, a, none, none, n))
        .when(part == in_pred, two(c, a, none, n, none))
        .when(
            part == paired,
            F.array(row(c, "*", n, -n, -n), row(c, a, n, none, -n), row(c, F.col("b"), none, -n, none)),
        )
        .when((part == gold_link) & typed, two(r, a, none, none, n))
        .when(part == gold_link, one(r, none, none, n))
        .when((part == pred_link) & typed, two(r, a, none, n, none))
        .when(part == pred_link, one(r, none, n, none))
        .when(a == "*", one(r, n, -n, -n))
        .otherwise(two(r, a, n, -n, -n))
    )
    return (
        table.select("system_id", "criterion", "doc_id", F.explode(counts).alias("x"))
        .select("system_id", "criterion", "doc_id", "x.*")
        .groupBy("system_id", "criterion", "doc_id", "kind", "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .filter((F.col("label") == "*") | (F.col("tp") + F.col("fp") + F.col("fn") > 0))
        .join(ids, "doc_id", "left_semi")
        .select(SCORE)
    )


def corpus_scores(scores: DataFrame, by: Sequence[str] = ("system_id", "criterion", "kind", "label")):
    """Summed counts with support, precision, recall and micro-F1."""
    total = scores.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select(*by, "tp", "fp", "fn", *prf_columns(tp, fp, fn))


def gate_typed(report: DataFrame, gold: DataFrame) -> DataFrame:
    """Mark typed rows not applicable where the corpus has no component types."""
    typed = gold.agg(F.coalesce(F.bool_or(F.col("ctype").isNotNull()), F.lit(False)).alias("t"))
    gone = F.col("criterion").endswith("/typed") & ~typed.scalar()
    return report.withColumn("status", F.when(gone, "not_applicable").otherwise("scored"))

"""Token ranges, matching, edge scoring and corpus scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixtures as fx
from marginalia.fixtures import CTE
from marginalia.functions import text as tx
from marginalia.operators import matching as m
from marginalia.operators import scoring as s
from marginalia.plans.registry import query
from marginalia.schemas import STANDARD_CRITERIA, Criterion
from marginalia.session import cut

OVERLAP_TYPED = Criterion("overlap", True)
EXACT = [c for c in STANDARD_CRITERIA if c.span == "exact"]

CTE["fx_tok"] = (
    (),
    r"""SELECT doc_id, i - 1 AS t, e - length(w) AS s, e FROM (
  SELECT doc_id, i, w, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
    SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g FROM (
      SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws,
             regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS gs FROM documents)))""",
)
CTE["fx_span"] = (
    ("fx_gold", "fx_pred", "fx_tok"),
    """SELECT sp.*, coalesce(b.t + 1, 0) AS hi FROM (
  SELECT s.*, coalesce(a.t + 1, 0) AS lo FROM (
    SELECT 'g' AS side, -1::BIGINT AS system_id, doc_id, idx, comp_id, ctype, start_off, end_off FROM fx_gold
    UNION ALL
    SELECT 'p', system_id, doc_id, idx, comp_id, ctype, start_off, end_off FROM fx_pred) s
  ASOF LEFT JOIN fx_tok a ON s.doc_id = a.doc_id AND s.start_off >= a.e) sp
ASOF LEFT JOIN fx_tok b ON sp.doc_id = b.doc_id AND sp.end_off > b.s""",
)
CTE["fx_crit"] = (
    (),
    """SELECT * FROM (VALUES ('exact/typed', true, true), ('exact/untyped', false, true),
  ('overlap>=0.5/typed', true, false), ('overlap>=0.5/untyped', false, false)) v(criterion, typed, exact)""",
)
CTE["fx_sys"] = ((), "SELECT * FROM (VALUES (0::BIGINT), (1)) v(system_id)")
CTE["fx_cand"] = (
    ("fx_span", "fx_crit"),
    """SELECT c.criterion, x.* EXCLUDE (jaccard), CASE WHEN c.exact THEN 1.0::DOUBLE ELSE jaccard END AS ratio
FROM (SELECT p.system_id, g.doc_id, g.idx AS g_idx, p.idx AS p_idx, g.comp_id AS g_id, p.comp_id AS p_id,
    g.ctype AS g_type, p.ctype AS p_type, g.start_off = p.start_off AND g.end_off = p.end_off AS same,
    CASE WHEN g.hi = g.lo AND p.hi = p.lo THEN 1.0::DOUBLE
         WHEN least(g.hi, p.hi) <= greatest(g.lo, p.lo) THEN 0.0::DOUBLE
         ELSE (least(g.hi, p.hi) - greatest(g.lo, p.lo))::DOUBLE
            / (greatest(g.hi, p.hi) - least(g.lo, p.lo))::DOUBLE END AS jaccard
  FROM (SELECT * FROM fx_span WHERE side = 'g') g JOIN (SELECT * FROM fx_span WHERE side = 'p') p
    ON g.doc_id = p.doc_id AND g.start_off < p.end_off + 200 AND p.start_off < g.end_off + 200) x
JOIN fx_crit c ON (NOT c.typed OR x.g_type IS NOT DISTINCT FROM x.p_type)
  AND CASE WHEN c.exact THEN x.same ELSE x.jaccard >= 0.5 END""",
)
CTE["fx_pairs"] = (
    ("fx_cand",),
    """SELECT criterion, system_id, doc_id, p.* FROM (
  SELECT criterion, system_id, doc_id, unnest(list_reduce(
    list([{'g_idx': g_idx, 'p_idx': p_idx, 'g_id': g_id, 'p_id': p_id, 'g_type': g_type, 'p_type': p_type}]
         ORDER BY ratio DESC, g_idx, p_idx),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.g_idx = x[1].g_idx OR y.p_idx = x[1].p_idx)) > 0
                        THEN acc ELSE acc || x END, [])) AS p
  FROM fx_cand GROUP BY criterion, system_id, doc_id)""",
)
CTE["fx_comp_scores"] = (
    ("fx_pairs", "fx_crit", "fx_sys", "fx_docs"),
    """SELECT system_id, criterion, doc_id, 'components' AS kind, label, sum(tp)::BIGINT AS tp,
  sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT y.system_id, c.criterion, g.doc_id, unnest(['*', coalesce(g.ctype, 'untyped')]) AS label,
    (p.g_idx IS NOT NULL)::INT AS tp, 0 AS fp, (p.g_idx IS NULL)::INT AS fn
  FROM fx_gold g CROSS JOIN fx_crit c CROSS JOIN fx_sys y
  LEFT JOIN fx_pairs p ON p.criterion = c.criterion AND p.system_id = y.system_id
    AND p.doc_id = g.doc_id AND p.g_idx = g.idx
  UNION ALL
  SELECT q.system_id, c.criterion, q.doc_id, unnest(['*', coalesce(q.ctype, 'untyped')]), 0, 1, 0
  FROM fx_pred q CROSS JOIN fx_crit c ANTI JOIN fx_pairs p ON p.criterion = c.criterion
    AND p.system_id = q.system_id AND p.doc_id = q.doc_id AND p.p_idx = q.idx
  UNION ALL
  SELECT system_id, criterion, doc_id, '*', 0, 0, 0 FROM fx_docs, fx_crit, fx_sys)
GROUP BY ALL""",
)
CTE["fx_edges"] = (
    ("fx_pairs", "fx_gold_rel", "fx_pred_rel", "fx_crit", "fx_sys"),
    """SELECT criterion, system_id, doc_id, src, tgt, rkey, sum(ng)::BIGINT AS ng, sum(np)::BIGINT AS np FROM (
  SELECT c.criterion, y.system_id, doc_id, src, tgt, CASE WHEN c.typed THEN rtype ELSE '*' END AS rkey, 1 AS ng, 0 AS np
  FROM fx_gold_rel CROSS JOIN fx_crit c CROSS JOIN fx_sys y
  UNION ALL
  SELECT c.criterion, r.system_id, r.doc_id, a.g_id, b.g_id, CASE WHEN c.typed THEN rtype ELSE '*' END, 0, 1
  FROM fx_pred_rel r CROSS JOIN fx_crit c
  JOIN fx_pairs a ON a.criterion = c.criterion AND a.system_id = r.system_id AND a.doc_id = r.doc_id AND a.p_id = r.src
  JOIN fx_pairs b ON b.criterion = c.criterion AND b.system_id = r.system_id AND b.doc_id = r.doc_id AND b.p_id = r.tgt)
GROUP BY ALL""",
)
CTE["fx_rel_scores"] = (
    ("fx_edges", "fx_docs"),
    """SELECT system_id, criterion, doc_id, 'relations' AS kind, label, tp, npred - tp AS fp, ngold - tp AS fn FROM (
  SELECT system_id, criterion, doc_id, label, sum(tp)::BIGINT AS tp, sum(ngold)::BIGINT AS ngold, sum(npred)::BIGINT AS npred FROM (
    SELECT system_id, criterion, doc_id, unnest(CASE WHEN rkey = '*' THEN ['*'] ELSE ['*', rkey] END) AS label,
      least(ng, np) AS tp, 0 AS ngold, 0 AS npred FROM fx_edges
    UNION ALL
    SELECT y.system_id, c.criterion, doc_id, unnest(CASE WHEN typed THEN ['*', rtype] ELSE ['*'] END), 0, 1, 0
    FROM fx_gold_rel, fx_crit c, fx_sys y
    UNION ALL
    SELECT system_id, c.criterion, doc_id, unnest(CASE WHEN typed THEN ['*', rtype] ELSE ['*'] END), 0, 0, 1
    FROM fx_pred_rel, fx_crit c
    UNION ALL
    SELECT system_id, criterion, doc_id, '*', 0, 0, 0 FROM fx_docs, fx_crit, fx_sys)
  GROUP BY ALL)""",
)
CTE["fx_scores"] = (
    ("fx_comp_scores", "fx_rel_scores"),
    "SELECT * FROM fx_comp_scores UNION ALL SELECT * FROM fx_rel_scores",
)
CTE["fx_overall"] = (
    ("fx_scores",),
    """SELECT system_id, criterion, kind, doc_id, tp, fp, fn FROM fx_scores WHERE label = '*'""",
)
PRF = """tp + fn AS support,
  CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN 2*tp + fp + fn > 0 THEN (2*tp)::DOUBLE / (2*tp + fp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS f1"""
CTE["fx_report"] = (
    ("fx_scores",),
    f"""SELECT system_id, criterion, kind, label, tp, fp, fn, {PRF} FROM (
  SELECT system_id, criterion, kind, label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
  FROM fx_scores GROUP BY ALL)""",
)


def spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.docs(spark, sf), fx.gold(spark, sf), fx.pred(spark, sf)


def scores(spark: SparkSession, sf: str, criteria=STANDARD_CRITERIA, splits: Sequence[str] = ()) -> DataFrame:
    """Counts of every document, or of the documents of ``splits`` only: nothing else is matched for them."""
    tables = [*spans(spark, sf), fx.gold_rel(spark, sf), fx.pred_rel(spark, sf)]
    if splits:
        tables[0] = tables[0].filter(F.col("split").isin(*splits))
        tables[1:] = [t.join(tables[0].select("doc_id"), "doc_id", "left_semi") for t in tables[1:]]
    return s.document_scores(*tables, fx.SYSTEMS, criteria)


PAIR_OUT = ["criterion", "system_id", "doc_id", "g_idx", "p_idx"]


@query(
    "e4_token_offsets",
    "SELECT doc_id, t AS token, s AS start_off, e AS end_off FROM fx_tok",
    ("fx_tok",),
)
def e4_token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return tx.token_offsets(fx.docs(spark, sf).select("doc_id", "text"))


@query(
    "c1_token_ranges",
    "SELECT side, system_id, doc_id, idx, lo, hi FROM fx_span",
    ("fx_span",),
)
def c1_token_ranges(spark: SparkSession, sf: str) -> DataFrame:
    ranges = m.token_ranges(*spans(spark, sf))
    system = F.coalesce("system_id", F.lit(-1).cast("bigint")).alias("system_id")
    return ranges.select("side", system, "doc_id", "idx", "lo", "hi")


@query(
    "c2_exact_match",
    "SELECT criterion, system_id, doc_id, g_idx, p_idx FROM fx_pairs WHERE criterion LIKE 'exact%'",
    ("fx_pairs",),
)
def c2_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return m.match(*spans(spark, sf), fx.SYSTEMS, EXACT).select(PAIR_OUT)


@query(
    "c3_overlap_candidates",
    """SELECT system_id, doc_id, g_idx, p_idx, ratio FROM fx_cand WHERE criterion = 'overlap>=0.5/typed'""",
    ("fx_cand",),
)
def c3_overlap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return m.candidates(*spans(spark, sf), OVERLAP_TYPED)


@query(
    "c4_greedy_match",
    "SELECT criterion, system_id, doc_id, g_idx, p_idx FROM fx_pairs WHERE criterion LIKE 'overlap%'",
    ("fx_pairs",),
)
def c4_greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    overlap = [c for c in STANDARD_CRITERIA if c.span == "overlap"]
    return m.match(*spans(spark, sf), fx.SYSTEMS, overlap).select(PAIR_OUT)


CTE["fx_missing"] = (
    ("fx_overall",),
    """SELECT system_id, criterion, kind, doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE tp END AS tp,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE fp END AS fp, CASE WHEN doc_id % 3 = 0 THEN tp + fn ELSE fn END AS fn
FROM fx_overall""",
)


@query("c5_missing_predictions", "SELECT * FROM fx_missing", ("fx_missing",))
def c5_missing_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document is answered by nobody, and some answers name no document."""
    docs, gold, pred = spans(spark, sf)
    keep = F.col("doc_id") % 3 != 0
    stray = pred.filter(~keep).withColumn("doc_id", -1 - F.col("doc_id"))
    got = s.document_scores(
        docs, gold, pred.filter(keep).unionByName(stray),
        fx.gold_rel(spark, sf), fx.pred_rel(spark, sf).filter(keep), fx.SYSTEMS,
    )
    return got.filter(F.col("label") == "*").drop("label")


@query(
    "c6_edge_match",
    """SELECT criterion, system_id, doc_id, src, tgt, rkey, least(ng, np) AS hits FROM fx_edges
WHERE least(ng, np) > 0""",
    ("fx_edges",),
)
def c6_edge_match(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cut(m.match(*spans(spark, sf), fx.SYSTEMS))
    return s.edge_matches(pairs, fx.gold_rel(spark, sf), fx.pred_rel(spark, sf))


@query(
    "c7_edge_counts_by_type",
    "SELECT * FROM fx_rel_scores WHERE label <> '*'",
    ("fx_rel_scores",),
)
def c7_edge_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    return rows.filter((F.col("kind") == "relations") & (F.col("label") != "*"))


@query("d1_micro_f1", "SELECT * EXCLUDE (label) FROM fx_report WHERE label = '*'", ("fx_report",))
def d1_micro_f1(spark: SparkSession, sf: str) -> DataFrame:
    by = ("system_id", "criterion", "kind")
    return s.corpus_scores(scores(spark, sf).filter(F.col("label") == "*"), by)


@query("d2_component_counts", "SELECT * FROM fx_comp_scores", ("fx_comp_scores",))
def d2_component_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).filter(F.col("kind") == "components")


@query(
    "d3_score_report",
    "SELECT *, 'scored' AS status FROM fx_report",
    ("fx_report",),
)
def d3_score_report(spark: SparkSession, sf: str) -> DataFrame:
    return s.gate_typed(s.corpus_scores(scores(spark, sf)), fx.gold(spark, sf))


@query(
    "b4_untyped_corpus_gate",
    """SELECT system_id, criterion, kind, label, CASE WHEN criterion LIKE '%/typed' THEN 'not_applicable'
  ELSE 'scored' END AS status FROM fx_report WHERE label = '*'""",
    ("fx_report",),
)
def b4_untyped_corpus_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The same corpus with its component types removed: typed rows do not apply."""
    docs, gold, pred = spans(spark, sf)
    bare = F.lit(None).cast("string")
    gold = gold.withColumn("ctype", bare)
    got = s.document_scores(
        docs, gold, pred, fx.gold_rel(spark, sf), fx.pred_rel(spark, sf), fx.SYSTEMS
    )
    total = s.corpus_scores(got.filter(F.col("label") == "*"))
    return s.gate_typed(total, gold).select("system_id", "criterion", "kind", "label", "status")


@query(
    "h1_overlap_ratio",
    """SELECT system_id, doc_id, g_idx, p_idx, ratio, recall FROM (
  SELECT p.system_id, g.doc_id, g.idx AS g_idx, p.idx AS p_idx,
    CASE WHEN g.hi = g.lo AND p.hi = p.lo THEN 1.0::DOUBLE WHEN least(g.hi, p.hi) <= greatest(g.lo, p.lo) THEN 0.0::DOUBLE
      ELSE (least(g.hi, p.hi) - greatest(g.lo, p.lo))::DOUBLE / (greatest(g.hi, p.hi) - least(g.lo, p.lo))::DOUBLE END AS ratio,
    CASE WHEN g.hi = g.lo AND p.hi = p.lo THEN 1.0::DOUBLE WHEN least(g.hi, p.hi) <= greatest(g.lo, p.lo) THEN 0.0::DOUBLE
      ELSE (least(g.hi, p.hi) - greatest(g.lo, p.lo))::DOUBLE / (g.hi - g.lo)::DOUBLE END AS recall
  FROM (SELECT * FROM fx_span WHERE side = 'g') g JOIN (SELECT *, idx // 2 AS made_from FROM fx_span WHERE side = 'p') p
    ON g.doc_id = p.doc_id AND g.idx = p.made_from)""",
    ("fx_span",),
)
def h1_overlap_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Both overlap measures of every prediction against the gold span it was made from."""
    ranges = m.token_ranges(*spans(spark, sf))
    g = ranges.filter("side = 'g'").select(
        "doc_id", F.col("idx").alias("g_idx"), F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi")
    )
    p = ranges.filter("side = 'p'").select(
        "system_id", "doc_id", F.col("idx").alias("p_idx"), F.floor(F.col("idx") / 2).alias("g_idx"),
        F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
    )
    cols = [F.col(c) for c in ("g_lo", "g_hi", "p_lo", "p_hi")]
    return p.join(g, ["doc_id", "g_idx"]).select(
        "system_id", "doc_id", "g_idx", "p_idx",
        tx.overlap_ratio(*cols).alias("ratio"),
        tx.overlap_ratio(*cols, mode="gold_recall").alias("recall"),
    )


AGREED_SQL = """SELECT doc_id, x.l_idx, x.r_idx, x.l_id, x.r_id FROM (
  SELECT l.doc_id, unnest(list_reduce(list([{'l_idx': l.idx, 'r_idx': r.idx, 'l_id': l.comp_id, 'r_id': r.comp_id}]
      ORDER BY l.idx, r.idx),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.l_idx = x[1].l_idx OR y.r_idx = x[1].r_idx)) > 0
                        THEN acc ELSE acc || x END, [])) AS x
  FROM (SELECT * FROM fx_pred WHERE system_id = 0) l JOIN (SELECT * FROM fx_pred WHERE system_id = 1) r
    ON l.doc_id = r.doc_id AND least(l.end_off, r.end_off) > greatest(l.start_off, r.start_off)
   AND (least(l.end_off, r.end_off) - greatest(l.start_off, r.start_off))::DOUBLE
     / (greatest(l.end_off, r.end_off) - least(l.start_off, r.start_off))::DOUBLE >= 0.5
  GROUP BY l.doc_id)"""


@query(
    "c17_system_agreement",
    AGREED_SQL,
    ("fx_pred",),
)
def c17_system_agreement(spark: SparkSession, sf: str) -> DataFrame:
    pred = fx.pred(spark, sf)
    return m.agreement(pred.filter("system_id = 0"), pred.filter("system_id = 1"))


@query(
    "c17_agreement_rate",
    f"""SELECT doc_id, n_left, n_right, n_paired, 2 * n_paired / (n_left + n_right)::DOUBLE AS rate FROM (
  SELECT doc_id, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, sum(p)::BIGINT AS n_paired FROM (
    SELECT doc_id, (system_id = 0)::INT AS l, (system_id = 1)::INT AS r, 0 AS p FROM fx_pred WHERE system_id IN (0, 1)
    UNION ALL SELECT doc_id, 0, 0, 1 FROM ({AGREED_SQL})) GROUP BY doc_id)""",
    ("fx_pred",),
)
def c17_agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    pred = fx.pred(spark, sf)
    sides = pred.filter("system_id = 0"), pred.filter("system_id = 1")
    return m.agreement_rate(m.agreement(*sides), *sides)


@query(
    "h9_criterion_label",
    """SELECT DISTINCT criterion, sum(tp)::BIGINT AS tp FROM fx_comp_scores WHERE label = '*' GROUP BY criterion""",
    ("fx_comp_scores",),
)
def h9_criterion_label(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are rendered from the criterion's own fields and carried by the pairs."""
    pairs = m.match(*spans(spark, sf), fx.SYSTEMS)
    return pairs.groupBy("criterion").agg(F.count(F.lit(1)).alias("tp"))

"""Bootstrap intervals, system comparison and the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixtures as fx
from marginalia.fixtures import CTE
from marginalia.functions.stats import f1
from marginalia.operators import cascade as cs
from marginalia.operators import cost
from marginalia.operators import resample as rs
from marginalia.operators import scoring as s
from marginalia.operators.answers import unparseable
from marginalia.plans.registry import query
from marginalia.plans.scoring_queries import OVERLAP_TYPED, scores
from marginalia.session import cut

LOCAL_DOCS_PER_SECOND = 1.487
API_MODEL = "claude-haiku-4-5"
LABEL = OVERLAP_TYPED.label


def _f1(p: str = "") -> str:
    return (
        f"CASE WHEN 2*{p}tp + {p}fp + {p}fn > 0 THEN (2*{p}tp)::DOUBLE / (2*{p}tp + {p}fp + {p}fn)::DOUBLE "
        "ELSE 0.0::DOUBLE END"
    )


def _mixed_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


# Height of the trees in SQL: room for 4,096 distinct vectors, more than the checked tables have documents.
LEVELS = 12

# Hashes of the iterations, for the two uniform numbers of a draw; the seed is 0.
CTE["bs_iter"] = (
    (),
    f"""SELECT i AS iter, {_mixed_sql('(i * 4)')} AS hu, {_mixed_sql('(i * 4 + 1)')} AS hv
FROM (SELECT unnest(range(0, {rs.ITERATIONS})) AS i)""",
)


def _draw_ctes(name: str, source: str, keys: str, cols: tuple[str, ...]) -> str:
    """Per-iteration sums of the columns of one CTE with (keys, doc_id, cols).

    A tree over the distinct vectors: draws go down from the root, split by binomial draws.
    Levels are written out, as a recursive query would keep the rows of all of them.
    """
    vec = ", ".join(cols)
    CTE[f"{name}_pos"] = ((source,), f"SELECT {keys}, doc_id, {vec} FROM {source}")
    CTE[f"{name}_unit"] = (
        (f"{name}_pos",),
        f"SELECT row_number() OVER (ORDER BY {keys}) AS unit, * FROM (SELECT DISTINCT {keys} FROM {name}_pos)",
    )
    CTE[f"{name}_class"] = (
        (f"{name}_pos", f"{name}_unit"),
        f"""SELECT unit, {vec}, size, row_number() OVER (PARTITION BY unit ORDER BY {vec}) - 1 AS place
FROM (SELECT {keys}, {vec}, count(*) AS size FROM {name}_pos GROUP BY {keys}, {vec}) JOIN {name}_unit USING ({keys})""",
    )
    CTE[f"{name}_mass"] = (
        (f"{name}_class",),
        f"""SELECT unit, h, place >> h AS node, sum(size)::BIGINT AS mass
FROM {name}_class, (SELECT unnest(range(0, {LEVELS + 1})) AS h) GROUP BY unit, h, place >> h""",
    )
    CTE[f"{name}_node"] = (
        (f"{name}_mass",),
        f"""SELECT *, least(part, mass - part) AS low, {_mixed_sql('((node * 64 + h) & 4294967295)')} AS hn
FROM (SELECT a.unit, a.h, a.node, a.mass, coalesce(b.mass, 0) AS part
  FROM {name}_mass a LEFT JOIN {name}_mass b ON b.unit = a.unit AND b.h = a.h - 1 AND b.node = 2 * a.node WHERE a.h > 0)""",
    )
    # distribution functions of all binomial draws that are taken by inversion
    CTE[f"{name}_odds"] = (
        (f"{name}_node",),
        f"""SELECT low, mass, low::DOUBLE / mass AS p, unnest(range(1, least(n, floor({rs.EXACT_VARIANCE}::DOUBLE
  / ((low::DOUBLE / mass) * (1.0::DOUBLE - low::DOUBLE / mass)))::BIGINT) + 1)) AS n
FROM (SELECT DISTINCT low, mass FROM {name}_node WHERE low > 0), (SELECT max(mass) AS n FROM {name}_node)""",
    )
    CTE[f"{name}_fact"] = (
        (f"{name}_node",),
        f"""SELECT k, coalesce(sum(CASE WHEN k > 0 THEN ln(k) END) OVER (ORDER BY k), 0.0::DOUBLE) AS lf
FROM (SELECT unnest(range(0, n + 1)) AS k FROM (SELECT max(mass) AS n FROM {name}_node))""",
    )
    CTE[f"{name}_cdf"] = (
        (f"{name}_odds", f"{name}_fact"),
        f"""SELECT low, mass, n, list(below ORDER BY k) AS cdf FROM (
  SELECT low, mass, o.n, o.k, sum(exp(a.lf - b.lf - c.lf + o.k * ln(p) + (o.n - o.k) * ln(1.0::DOUBLE - p)))
    OVER (PARTITION BY low, mass, o.n ORDER BY o.k) AS below
  FROM (SELECT *, unnest(range(0, least(n, ceil(n * p + 8 * sqrt(n * p * (1 - p)) + 9)::BIGINT))) AS k FROM {name}_odds) o
  JOIN {name}_fact a ON a.k = o.n JOIN {name}_fact b ON b.k = o.k JOIN {name}_fact c ON c.k = o.n - o.k)
GROUP BY low, mass, n""",
    )
    u, v = (f"({_mixed_sql(f'xor({h}, hn)')}::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE" for h in ("hu", "hv"))
    z = f"(sqrt(-2.0::DOUBLE * ln(u)) * cos(2.0::DOUBLE * pi() * ({v})))"
    draw = (
        "CASE WHEN low = 0 THEN 0 WHEN n = 1 THEN (u > q)::BIGINT WHEN n = 2 THEN (u > q * q)::BIGINT + (u > 1.0::DOUBLE - p * p)::BIGINT "
        "WHEN n = 3 THEN (u > q * q * q)::BIGINT + (u > q * q * (q + 3 * p))::BIGINT + (u > 1.0::DOUBLE - p * p * p)::BIGINT "
        "WHEN n = 4 THEN (u > q * q * q * q)::BIGINT + (u > q * q * q * (q + 4 * p))::BIGINT "
        "+ (u > 1.0::DOUBLE - p * p * p * (p + 4 * q))::BIGINT + (u > 1.0::DOUBLE - p * p * p * p)::BIGINT "
        "WHEN cdf IS NOT NULL THEN len(list_filter(cdf, lambda c: c < u)) "
        f"ELSE least(n, greatest(0, floor(n * p + sqrt(n * p * q) * {z} + (q - p) * ({z} * {z} - 1.0::DOUBLE) / 6.0::DOUBLE + 0.5::DOUBLE))) END::BIGINT"
    )
    rows = f"SELECT unit, iter, hu, hv, 0::BIGINT AS node, mass AS n FROM {name}_mass, bs_iter WHERE h = {LEVELS}"
    for h in range(LEVELS, 0, -1):
        rows = f"""SELECT unit, iter, hu, hv, 2 * node + side AS node, CASE side WHEN 0 THEN x ELSE n - x END AS n FROM (
SELECT unit, iter, hu, hv, node, n, CASE WHEN 2 * part > mass THEN n - x ELSE x END AS x FROM (
SELECT *, {draw} AS x FROM (
SELECT d.*, t.part, t.mass, t.low, t.hn, f.cdf, t.low::DOUBLE / t.mass AS p, 1.0::DOUBLE - t.low::DOUBLE / t.mass AS q, {u} AS u
FROM ({rows}) d JOIN (SELECT * FROM {name}_node WHERE h = {h}) t ON t.unit = d.unit AND t.node = d.node
LEFT JOIN (SELECT * FROM {name}_cdf WHERE n > 4) f ON f.low = t.low AND f.mass = t.mass AND f.n = d.n))), (VALUES (0), (1)) s(side)
WHERE CASE side WHEN 0 THEN x ELSE n - x END > 0"""
    sums = ", ".join(f"sum({c} * n)::BIGINT AS {c}" for c in cols)
    CTE[f"{name}_iter"] = (
        (f"{name}_unit", f"{name}_class", f"{name}_node", f"{name}_cdf", "bs_iter"),
        f"""SELECT {keys}, iter, {vec} FROM (SELECT unit, iter, {sums} FROM (SELECT unit, iter, node AS place, n FROM ({rows}))
  JOIN (SELECT unit, place, {vec} FROM {name}_class) USING (unit, place) GROUP BY unit, iter) JOIN {name}_unit USING (unit)""",
    )
    return f"{name}_iter"


def _interval(name: str, keys: str, value: str, cte: str) -> None:
    CTE[cte] = (
        (f"{name}_iter", f"{name}_pos"),
        f"""SELECT a.*, CASE WHEN n < 2 THEN point ELSE lo END AS ci_low, CASE WHEN n < 2 THEN point ELSE hi END AS ci_high,
  coalesce(CASE WHEN n < 2 THEN point ELSE lo END > 0 OR CASE WHEN n < 2 THEN point ELSE hi END < 0, false) AS excludes_zero
FROM (SELECT {keys}, n, {value} AS point FROM (SELECT {keys}, count(*) AS n, {{sums}} FROM {name}_pos GROUP BY {keys})) a
JOIN (SELECT {keys}, quantile_cont({value}, 0.025::DOUBLE) AS lo, quantile_cont({value}, 0.975::DOUBLE) AS hi
      FROM {name}_iter GROUP BY {keys}) b USING ({keys})""",
    )


def _with_sums(cte: str, cols: tuple[str, ...]) -> None:
    deps, body = CTE[cte]
    CTE[cte] = (deps, body.replace("{sums}", ", ".join(f"sum({c})::BIGINT AS {c}" for c in cols)))


ONE, TWO = rs.ONE, rs.TWO
DELTA = f"{_f1('a_')} - {_f1('b_')}"

CTE["fx_unit"] = (("fx_overall",), "SELECT system_id, criterion, kind, doc_id, tp, fp, fn FROM fx_overall")
_draw_ctes("fx_m", "fx_unit", "system_id, criterion, kind", ONE)
_interval("fx_m", "system_id, criterion, kind", _f1(), "fx_marginal")
_with_sums("fx_marginal", ONE)

CTE["fx_two"] = (
    ("fx_overall",),
    """SELECT a.criterion, a.kind, a.doc_id, a.tp AS a_tp, a.fp AS a_fp, a.fn AS a_fn,
  b.tp AS b_tp, b.fp AS b_fp, b.fn AS b_fn
FROM fx_overall a JOIN fx_overall b USING (criterion, kind, doc_id) WHERE a.system_id = 0 AND b.system_id = 1""",
)
_draw_ctes("fx_p", "fx_two", "criterion, kind", TWO)
_interval("fx_p", "criterion, kind", DELTA, "fx_paired")
_with_sums("fx_paired", TWO)

CTE["fx_label"] = (
    ("fx_scores",),
    f"""SELECT system_id, kind, label, doc_id, tp, fp, fn FROM fx_scores
WHERE label <> '*' AND criterion = '{LABEL}'""",
)
_draw_ctes("fx_l", "fx_label", "system_id, kind, label", ONE)
_interval("fx_l", "system_id, kind, label", _f1(), "fx_labelled")
_with_sums("fx_labelled", ONE)


CTE["fx_every"] = (("fx_scores",), "SELECT system_id, criterion, kind, label, doc_id, tp, fp, fn FROM fx_scores")
_draw_ctes("fx_e", "fx_every", "system_id, criterion, kind, label", ONE)
_interval("fx_e", "system_id, criterion, kind, label", _f1(), "fx_every_interval")
_with_sums("fx_every_interval", ONE)


@query(
    "d3_report_with_intervals",
    """SELECT r.*, i.n AS documents, i.ci_low, i.ci_high FROM fx_report r JOIN fx_every_interval i USING (system_id, criterion, kind, label)""",
    ("fx_report", "fx_every_interval"),
)
def d3_report_with_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Every criterion and kind, overall and by type, with its counts and its interval."""
    keys = ["system_id", "criterion", "kind", "label"]
    rows = cut(scores(spark, sf))
    bounds = rs.intervals(rows, keys).select(*keys, F.col("n").alias("documents"), "ci_low", "ci_high")
    return s.corpus_scores(rows).join(bounds, keys)


def overall(spark: SparkSession, sf: str, criteria=None) -> DataFrame:
    rows = scores(spark, sf) if criteria is None else scores(spark, sf, criteria)
    return rows.filter(F.col("label") == "*")


@query("d8_bootstrap_f1", "SELECT * FROM fx_marginal", ("fx_marginal",))
def d8_bootstrap_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(overall(spark, sf))
    return rs.intervals(rows, ["system_id", "criterion", "kind"])


@query("d8_bootstrap_f1_multinomial")
def d8_bootstrap_f1_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    """The same intervals from 10,000 iterations, drawn over distinct count vectors."""
    rows = cut(overall(spark, sf))
    return rs.intervals(rows, ["system_id", "criterion", "kind"], method="multinomial")


@query("d9_paired_bootstrap_delta", "SELECT * FROM fx_paired", ("fx_paired",))
def d9_paired_bootstrap_delta(spark: SparkSession, sf: str) -> DataFrame:
    both = cut(rs.side_by_side(overall(spark, sf), 0, 1))
    return rs.intervals(both, ["criterion", "kind"], paired=True)


@query("d10_bootstrap_by_type", "SELECT * FROM fx_labelled", ("fx_labelled",))
def d10_bootstrap_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """A label's interval rests on the documents where it occurs."""
    rows = scores(spark, sf, [OVERLAP_TYPED]).filter(F.col("label") != "*")
    return rs.intervals(cut(rows), ["system_id", "kind", "label"])


@query(
    "d11_system_comparison",
    """SELECT criterion, kind, a.point AS a_point, a.ci_low AS a_ci_low, a.ci_high AS a_ci_high,
  b.point AS b_point, b.ci_low AS b_ci_low, b.ci_high AS b_ci_high,
  p.point AS delta_point, p.ci_low AS delta_ci_low, p.ci_high AS delta_ci_high, p.excludes_zero AS significant
FROM (SELECT * FROM fx_marginal WHERE system_id = 0) a JOIN (SELECT * FROM fx_marginal WHERE system_id = 1) b
  USING (criterion, kind) JOIN fx_paired p USING (criterion, kind)""",
    ("fx_marginal", "fx_paired"),
)
def d11_system_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rs.comparison(cut(overall(spark, sf)), 0, 1)


@query(
    "c11_pair_systems",
    f"SELECT * EXCLUDE (criterion) FROM fx_two WHERE criterion = '{LABEL}'",
    ("fx_two",),
)
def c11_pair_systems(spark: SparkSession, sf: str) -> DataFrame:
    return rs.side_by_side(overall(spark, sf, [OVERLAP_TYPED]), 0, 1, ["kind"])


CTE["fx_failed"] = (
    ("fx_gen",),
    """SELECT model = 'purchase' AS second, doc_id FROM fx_gen
WHERE NOT json_valid(answer) OR json_type(CASE WHEN json_valid(answer) THEN answer END) <> 'OBJECT'""",
)


@query(
    "c12_both_parsed",
    f"""SELECT x.scope, o.system_id, o.kind, sum(o.tp)::BIGINT AS tp, sum(o.fp)::BIGINT AS fp, sum(o.fn)::BIGINT AS fn,
  count(*) AS documents
FROM fx_overall o JOIN (SELECT 'all' AS scope, doc_id FROM documents UNION ALL
  SELECT 'both_parsed', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fx_failed)) x USING (doc_id)
WHERE o.criterion = '{LABEL}' GROUP BY x.scope, o.system_id, o.kind""",
    ("fx_overall", "fx_failed"),
)
def c12_both_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Scores on all documents and on those no run failed to answer."""
    rows = cut(overall(spark, sf, [OVERLAP_TYPED]))
    gen = fx.gen(spark, sf)
    is_second = F.col("model") == "purchase"
    failed = (
        unparseable(gen.filter(is_second)).union(unparseable(gen.filter(~is_second))).distinct()
    )
    kept = rows.join(failed, "doc_id", "left_anti")
    tagged = rows.withColumn("scope", F.lit("all")).unionByName(
        kept.withColumn("scope", F.lit("both_parsed"))
    )
    return tagged.groupBy("scope", "system_id", "kind").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.count(F.lit(1)).alias("documents"),
    )


# ---- cascade ----------------------------------------------------------------
CTE["fx_leg"] = (
    ("fx_overall", "fx_conf", "fx_docs"),
    "SELECT d.split, c.mean_logprob AS conf, x.* FROM (SELECT doc_id, "
    + ", ".join(
        f"sum(CASE WHEN system_id = {sid} AND kind = '{kind}' THEN {c} END)::BIGINT AS {leg}_{kind}_{c}"
        for leg, sid in (("a", 0), ("b", 1))
        for kind in cs.KINDS
        for c in cs.COUNTS
    )
    + f" FROM fx_overall WHERE criterion = '{LABEL}' GROUP BY doc_id) x "
    "JOIN fx_conf c USING (doc_id) JOIN fx_docs d USING (doc_id)",
)
CTE["fx_val"] = (
    ("fx_conf", "fx_docs"),
    """SELECT mean_logprob AS v, row_number() OVER (ORDER BY mean_logprob) - 1 AS r FROM fx_conf JOIN fx_docs USING (doc_id)
WHERE split = 'val' AND mean_logprob IS NOT NULL""",
)
CTE["fx_thr"] = (
    ("fx_val",),
    """SELECT row_number() OVER (ORDER BY threshold) - 1 AS step, threshold FROM (
  SELECT DISTINCT threshold FROM (
    SELECT min(v) - 1e-9::DOUBLE AS threshold FROM fx_val UNION ALL SELECT max(v) + 1e-9::DOUBLE FROM fx_val
    UNION ALL
    SELECT v FROM fx_val JOIN (SELECT least(n - 1, floor((i::DOUBLE / 21::DOUBLE) * n::DOUBLE)::BIGINT) AS k
      FROM (SELECT count(*) AS n FROM fx_val), (SELECT unnest(range(1, 21)) AS i)) ON r = k))""",
)
CTE["fx_api"] = (
    ("fx_ledger", "fx_docs"),
    f"""SELECT split, sum(dollars::DECIMAL(38,12))::DOUBLE / count(*) AS api_cost FROM fx_ledger l JOIN fx_docs d USING (doc_id)
WHERE model = '{API_MODEL}' AND NOT cached GROUP BY split""",
)
LOCAL_COST = f"(1.1::DOUBLE / ({LOCAL_DOCS_PER_SECOND}::DOUBLE * 3600.0::DOUBLE))"


def _blend_sql(kind: str, threshold: str = "threshold") -> str:
    return ", ".join(
        f"CASE WHEN conf IS NULL OR conf < {threshold} THEN b_{kind}_{c} ELSE a_{kind}_{c} END AS {kind}_{c}"
        for c in cs.COUNTS
    )


CTE["fx_sweep"] = (
    ("fx_leg", "fx_thr", "fx_api"),
    f"""SELECT step, threshold, escalated, documents, escalated::DOUBLE / documents::DOUBLE AS escalation_rate,
  {_f1('components_')} AS component_f1, {_f1('relations_')} AS relation_f1,
  (documents * {LOCAL_COST} + escalated * (SELECT api_cost FROM fx_api WHERE split = 'val')) / documents * 1000 AS usd_per_1k
FROM (SELECT step, threshold, count(*) AS documents, sum((conf IS NULL OR conf < threshold)::INT)::BIGINT AS escalated, """
    + ", ".join(f"sum({k}_{c})::BIGINT AS {k}_{c}" for k in cs.KINDS for c in cs.COUNTS)
    + f""" FROM (SELECT step, threshold, conf, {_blend_sql('components')}, {_blend_sql('relations')}
  FROM fx_leg, fx_thr WHERE split = 'val') GROUP BY step, threshold)""",
)


def val_conf(spark: SparkSession, sf: str, split: str = "val") -> DataFrame:
    ids = fx.docs(spark, sf).filter(F.col("split") == split).select("doc_id")
    return fx.conf(spark, sf).join(ids, "doc_id", "left_semi")


def legs(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return cut(cs.legs(scores(spark, sf, [OVERLAP_TYPED], [split]), val_conf(spark, sf, split), LABEL))


def api_cost(spark: SparkSession, sf: str, split: str):
    """Mean dollars of the API model on this split's own documents."""
    scope = (
        fx.docs(spark, sf)
        .filter(F.col("split") == split)
        .select(F.lit("essays").alias("corpus"), "split", "doc_id")
    )
    ledger = fx.ledger(spark, sf).filter(F.col("model") == API_MODEL)
    return cost.scoped_cost(ledger, scope).select("mean").scalar()


def sweep(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    local = cost.local_usd_per_doc(F.lit(LOCAL_DOCS_PER_SECOND))
    points = cs.thresholds(val_conf(spark, sf))
    return cs.curve(docs, points, local, api_cost(spark, sf, "val"))


@query("e8_threshold_grid", "SELECT * FROM fx_thr", ("fx_thr",))
def e8_threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    return cs.thresholds(val_conf(spark, sf)).withColumn("step", F.col("step").cast("bigint"))


@query(
    "c8_cascade_blend",
    f"""SELECT doc_id, conf IS NULL OR conf < -0.01 AS escalated, {_blend_sql('components', '-0.01')} FROM fx_leg WHERE split = 'val'""",
    ("fx_leg",),
)
def c8_cascade_blend(spark: SparkSession, sf: str) -> DataFrame:
    docs, at = legs(spark, sf, "val"), F.lit(-0.01)
    counts = cs.blend(docs, at, "components")
    named = [c.alias(f"components_{n}") for c, n in zip(counts, cs.COUNTS)]
    return docs.select("doc_id", cs.escalates(F.col("conf"), at).alias("escalated"), *named)


ROUNDED = "step, threshold, escalated, documents, escalation_rate, component_f1, relation_f1, round_even(usd_per_1k, 6) AS usd_per_1k"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("usd_per_1k", F.bround("usd_per_1k", 6)).withColumn(
        "step", F.col("step").cast("bigint")
    )


@query("e10_cascade_curve", f"SELECT {ROUNDED} FROM fx_sweep", ("fx_sweep",))
def e10_cascade_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sweep(spark, sf, legs(spark, sf, "val")))


@query(
    "f2_best_sweep_point",
    f"SELECT {ROUNDED} FROM fx_sweep ORDER BY component_f1 DESC, threshold LIMIT 1",
    ("fx_sweep",),
)
def f2_best_sweep_point(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cs.best_point(sweep(spark, sf, legs(spark, sf, "val"))))


CTE["fx_at"] = (
    ("fx_leg", "fx_sweep"),
    "SELECT threshold, doc_id, "
    + ", ".join(
        f"CASE WHEN conf IS NULL OR conf < {t} THEN b_components_{c} ELSE a_components_{c} END AS {side}_{c}"
        for side, t in (("a", "threshold"), ("b", "best"))
        for c in cs.COUNTS
    )
    + """ FROM fx_leg, fx_thr, (SELECT threshold AS best FROM fx_sweep ORDER BY component_f1 DESC, threshold LIMIT 1)
WHERE split = 'val'""",
)
_draw_ctes("fx_t", "fx_at", "threshold", TWO)
_interval("fx_t", "threshold", DELTA, "fx_versus_best")
_with_sums("fx_versus_best", TWO)
CTE["fx_chosen"] = (
    ("fx_sweep", "fx_versus_best"),
    """SELECT s.* FROM fx_sweep s JOIN fx_versus_best v USING (threshold) WHERE NOT v.excludes_zero
ORDER BY usd_per_1k, threshold LIMIT 1""",
)


@query("f3_cheapest_sound_point", f"SELECT {ROUNDED} FROM fx_chosen", ("fx_chosen",))
def f3_cheapest_sound_point(spark: SparkSession, sf: str) -> DataFrame:
    docs = legs(spark, sf, "val")
    return _rounded(cs.cheapest_sound_point(docs, cut(sweep(spark, sf, docs))))


CTE["fx_final"] = (
    ("fx_leg", "fx_chosen"),
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{name}' AS against, doc_id, "
        + ", ".join(
            f"CASE WHEN conf IS NULL OR conf < threshold THEN b_{kind}_{c} ELSE a_{kind}_{c} END AS a_{c}"
            for c in cs.COUNTS
        )
        + ", "
        + ", ".join(f"{leg}_{kind}_{c} AS b_{c}" for c in cs.COUNTS)
        + " FROM fx_leg, (SELECT threshold FROM fx_chosen) WHERE split = 'test'"
        for kind in cs.KINDS
        for leg, name in (("b", "second_only"), ("a", "first_only"))
    ),
)
_draw_ctes("fx_f", "fx_final", "kind, against", TWO)
_interval("fx_f", "kind, against", DELTA, "fx_final_delta")
_with_sums("fx_final_delta", TWO)
CTE["fx_final_own"] = (
    ("fx_final",),
    "SELECT kind, doc_id, a_tp AS tp, a_fp AS fp, a_fn AS fn FROM fx_final WHERE against = 'first_only'",
)
_draw_ctes("fx_o", "fx_final_own", "kind", ONE)
_interval("fx_o", "kind", _f1(), "fx_final_point")
_with_sums("fx_final_point", ONE)


@query(
    "f5_cascade_report",
    """SELECT kind, 'none' AS against, n, point, ci_low, ci_high, excludes_zero FROM fx_final_point
UNION ALL SELECT kind, against, n, point, ci_low, ci_high, excludes_zero FROM fx_final_delta""",
    ("fx_final_point", "fx_final_delta"),
)
def f5_cascade_report(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold chosen on one split, reported once on another against both legs."""
    rows = cut(scores(spark, sf, [OVERLAP_TYPED], ["val", "test"]))

    def part(split: str) -> DataFrame:
        conf = val_conf(spark, sf, split)
        return cut(cs.legs(rows.join(conf.select("doc_id"), "doc_id", "left_semi"), conf, LABEL))

    val = part("val")
    chosen = cut(cs.cheapest_sound_point(val, cut(sweep(spark, sf, val))))
    return cs.report(part("test"), chosen.select("threshold").scalar())


CTE["fx_points"] = (
    ("fx_leg", "fx_chosen", "fx_api"),
    f"""SELECT point, threshold, escalated, documents, escalated::DOUBLE / documents::DOUBLE AS escalation_rate,
  {_f1('components_')} AS component_f1, {_f1('relations_')} AS relation_f1,
  (documents * {LOCAL_COST} + escalated * (SELECT api_cost FROM fx_api WHERE split = 'test')) / documents * 1000 AS usd_per_1k
FROM (SELECT point, threshold, count(*) AS documents, sum((conf IS NULL OR conf < threshold)::INT)::BIGINT AS escalated, """
    + ", ".join(f"sum({k}_{c})::BIGINT AS {k}_{c}" for k in cs.KINDS for c in cs.COUNTS)
    + f""" FROM (SELECT point, threshold, conf, {_blend_sql('components')}, {_blend_sql('relations')}
  FROM fx_leg, (SELECT 'first_only' AS point, '-inf'::DOUBLE AS threshold UNION ALL SELECT 'second_only', 'inf'::DOUBLE
    UNION ALL SELECT 'cascade', threshold FROM fx_chosen) WHERE split = 'test') GROUP BY point, threshold)""",
)


@query(
    "f5_operating_points",
    f"""SELECT point, CASE WHEN point = 'cascade' THEN threshold END AS threshold, escalated, documents, escalation_rate, component_f1, relation_f1,
  round_even(usd_per_1k, 6) AS usd_per_1k, '{LABEL}' AS criterion FROM fx_points""",
    ("fx_points",),
)
def f5_operating_points(spark: SparkSession, sf: str) -> DataFrame:
    """What the report split costs and gains at the chosen threshold and with either leg alone, at its own prices."""
    rows = cut(scores(spark, sf, [OVERLAP_TYPED], ["val", "test"]))

    def part(split: str) -> DataFrame:
        conf = val_conf(spark, sf, split)
        return cut(cs.legs(rows.join(conf.select("doc_id"), "doc_id", "left_semi"), conf, LABEL))

    val = part("val")
    chosen = cut(cs.cheapest_sound_point(val, cut(sweep(spark, sf, val))))
    local = cost.local_usd_per_doc(F.lit(LOCAL_DOCS_PER_SECOND))
    points = cs.operating_points(part("test"), chosen.select("threshold").scalar(), local, api_cost(spark, sf, "test"))
    label = cs.criterion_for(fx.gold(spark, sf), LABEL, LABEL.replace("/typed", "/untyped"))
    return points.withColumn("usd_per_1k", F.bround("usd_per_1k", 6)).withColumn("criterion", label)


# ---- variance across runs and checkpoint choice --------------------------------
def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Six checkpoints made of the documents of one language and system each."""
    lang = fx.docs(spark, sf).select("doc_id", "lang")
    by = ("criterion", "kind", "system_id", "lang")
    rows = overall(spark, sf).join(lang, "doc_id")
    path = F.concat(F.lit("runs/seed"), F.col("system_id"), F.lit("/epoch"),
                    F.when(F.col("lang") == "en", 10).otherwise(F.length("lang")), F.lit("/"), F.col("lang"))
    return s.corpus_scores(rows, by).withColumn("adapter", path)


CTE["fx_runs"] = (
    ("fx_overall", "fx_docs"),
    f"""SELECT criterion, kind, system_id, lang, {_f1()} AS f1,
  concat('runs/seed', system_id, '/epoch', CASE WHEN lang = 'en' THEN 10 ELSE length(lang) END, '/', lang) AS adapter
FROM (SELECT criterion, kind, system_id, lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
  FROM fx_overall JOIN fx_docs USING (doc_id) GROUP BY criterion, kind, system_id, lang)""",
)


@query(
    "d15_seed_variance",
    """SELECT criterion, kind, count(*) AS n_seeds, round_even(avg(f1), 6) AS mean,
  CASE WHEN count(*) > 1 THEN round_even(stddev_samp(f1), 6) ELSE 0.0::DOUBLE END AS std,
  round_even(min(f1), 6) AS min, round_even(max(f1), 6) AS max,
  round_even(max(CASE WHEN adapter = 'runs/seed0/epoch10/en' THEN f1 END), 6) AS selected,
  string_agg(concat(adapter, '=', floor(f1 * 1000000)::BIGINT), ',' ORDER BY adapter) AS by_model
FROM fx_runs GROUP BY criterion, kind""",
    ("fx_runs",),
)
def d15_seed_variance(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.selection import seed_variance

    table = seed_variance(_runs(spark, sf), "adapter", "f1", selected="runs/seed0/epoch10/en")
    pairs = F.transform(
        F.array_sort(F.map_entries("by_model")),
        lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1000000)),
    )
    return table.withColumn("by_model", F.array_join(pairs, ","))


CTE["fx_ranked"] = (
    ("fx_runs",),
    f"""SELECT adapter, regexp_extract(adapter, '(?:^|/)seed([^/]*)', 1) AS seed, regexp_extract(adapter, '(?:^|/)epoch([^/]*)', 1) AS epoch,
  round_even((sum(CASE WHEN kind = 'components' THEN f1 END) + sum(CASE WHEN kind = 'relations' THEN f1 END)) / 2, 6) AS selection_score
FROM fx_runs WHERE criterion = '{LABEL}' GROUP BY adapter""",
)


@query(
    "f1_checkpoint_ranking",
    "SELECT *, row_number() OVER (ORDER BY selection_score DESC, adapter) AS place FROM fx_ranked",
    ("fx_ranked",),
)
def f1_checkpoint_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.selection import rank_checkpoints

    ranked = rank_checkpoints(_runs(spark, sf).filter(F.col("criterion") == LABEL), "adapter")
    return ranked.withColumn("place", F.col("place").cast("bigint"))


@query(
    "d16_score_by_epoch",
    """SELECT epoch, count(*) AS seeds,
  round_even(sum(round(selection_score * 1000000)::BIGINT)::DOUBLE / count(*), 0) / 1000000::DOUBLE AS mean,
  CASE WHEN count(*) > 1 THEN round_even(stddev_samp(selection_score), 6) ELSE 0.0::DOUBLE END AS std
FROM fx_ranked GROUP BY epoch""",
    ("fx_ranked",),
)
def d16_score_by_epoch(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.selection import rank_checkpoints, score_by_epoch

    return score_by_epoch(
        rank_checkpoints(_runs(spark, sf).filter(F.col("criterion") == LABEL), "adapter")
    )

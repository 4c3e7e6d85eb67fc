"""Raw answers, alignment, assembly and leak guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixtures as fx
from marginalia.fixtures import CTE
from marginalia.functions import jsontext as js
from marginalia.functions import text as tx
from marginalia.operators import answers as an
from marginalia.operators import assemble as asm
from marginalia.operators import guards, legacy
from marginalia.operators.align import align
from marginalia.plans.registry import query
from marginalia.session import cut

OBJECT = "CASE WHEN json_valid(answer) THEN json_type(answer) = 'OBJECT' ELSE false END"
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    "b6_parse_or_null",
    f"SELECT event_id, {OBJECT} AS is_object FROM fx_gen",
    ("fx_gen",),
)
def b6_parse_or_null(spark: SparkSession, sf: str) -> DataFrame:
    parsed = js.parse_object(F.col("answer")).isNotNull().alias("is_object")
    return fx.gen(spark, sf).select("event_id", parsed)


@query(
    "b7_salvage_answer",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'braces'
  WHEN 3 THEN 'closed ]}' WHEN 4 THEN 'none' ELSE 'none' END AS stage FROM events""",
)
def b7_salvage_answer(spark: SparkSession, sf: str) -> DataFrame:
    e, p = F.col("event_id"), F.col("props")
    text = (
        F.when(e % 6 == 0, p)
        .when(e % 6 == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```")))
        .when(e % 6 == 2, F.concat(F.lit("The answer is "), p, F.lit(" as asked.")))
        .when(e % 6 == 3, F.concat(F.lit('{"claims": ['), p, F.lit(', {"cut')))
        .when(e % 6 == 4, F.concat(F.lit('{"a": [{"b": [{"c": ['), p, F.lit(', {"cut')))
        .otherwise("nothing here")
    )
    rows = fx.table(spark, sf, "events").select("event_id", text.alias("answer"))
    stage = F.coalesce(js.salvage(F.col("answer"))["stage"], F.lit("none"))
    return rows.select("event_id", stage.alias("stage"))


@query(
    "b9_answer_shape",
    f"""SELECT event_id, length(answer) AS chars, 1 AS lines, substr(sha256(answer), 1, 16) AS sha256_16,
  starts_with(answer, '{{') AS starts_with_brace, 0 AS heading_lines, 0 AS bullet_lines, json_valid(answer) AS parses,
  CASE WHEN {OBJECT} THEN array_to_string(list_sort(json_keys(answer)), ',') END AS top_level_keys,
  CASE WHEN {OBJECT} AND json_type(answer, '$.components') = 'ARRAY' THEN json_array_length(answer, '$.components')::BIGINT ELSE -1 END AS n_components,
  CASE WHEN {OBJECT} AND json_type(answer, '$.relations') = 'ARRAY' THEN json_array_length(answer, '$.relations')::BIGINT ELSE -1 END AS n_relations FROM fx_gen""",
    ("fx_gen",),
)
def b9_answer_shape(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.gen(spark, sf).select("event_id", js.shape(F.col("answer")).alias("s"))
    # -1 for what is no list, so that the column holds whole numbers everywhere
    return rows.select("event_id", "s.*").fillna(-1, ["n_components", "n_relations"])


@query(
    "b9_document_shape",
    f"""SELECT doc_id, length(t) AS chars, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '{tx.LINE_BREAK}')) END AS lines,
  substr(sha256(t), 1, 16) AS sha256_16, starts_with(t, '{{') AS starts_with_brace,
  len(list_filter(string_split_regex(t, '{tx.LINE_BREAK}'), lambda r: starts_with(regexp_replace(r, '^\\s+', ''), '#'))) AS heading_lines,
  len(list_filter(string_split_regex(t, '{tx.LINE_BREAK}'), lambda r: regexp_replace(r, '^\\s+', '')[1:2] IN ('- ', '* '))) AS bullet_lines
FROM (SELECT doc_id, regexp_replace(text, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS t FROM documents)""",
)
def b9_document_shape(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.docs(spark, sf).select("doc_id", js.shape(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.*").drop("n_components", "n_relations", "parses", "top_level_keys")


@query(
    "d12_output_health",
    f"""SELECT model, count(*) AS documents, count(*) FILTER (NOT {OBJECT}) AS invalid_json,
  round_even((count(*) FILTER (NOT {OBJECT}))::DOUBLE / count(*), 4) AS invalid_rate,
  count(*) FILTER (finish_reason = 'length') AS truncated,
  round_even((count(*) FILTER (finish_reason = 'length'))::DOUBLE / count(*), 4) AS truncation_rate,
  round_even(sum(output_tokens)::DOUBLE / count(*), 1) AS mean_output_tokens FROM fx_gen GROUP BY model""",
    ("fx_gen",),
)
def d12_output_health(spark: SparkSession, sf: str) -> DataFrame:
    return an.health(fx.gen(spark, sf), ["model"])


@query(
    "d13_token_confidence",
    """SELECT event_id, round_even((a + b + c) / 3, 9) AS mean_logprob, least(a, b, c) AS min_logprob FROM (
  SELECT event_id, greatest(-value, -value * 2) AS a, greatest(-value / 4, -value) AS b, -value / 8 AS c FROM events
  WHERE event_id % 10 <> 0) UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 10 = 0""",
)
def d13_token_confidence(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    tokens = F.array(F.array(-v, -v * 2), F.array(-v / 4, -v), F.array(-v / 8))
    none = F.array().cast("array<array<double>>")
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, none).otherwise(tokens).alias("logprobs")
    )
    out = an.token_confidence(rows).withColumn("mean_logprob", F.bround("mean_logprob", 9))
    return out.select("event_id", "mean_logprob", "min_logprob")


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.gen(spark, sf).select(
        F.col("model").alias("which"), F.floor(F.col("event_id") / 5).alias("doc_id"), js.shape(F.col("answer")).alias("s")
    )
    return rows.select("which", "doc_id", "s.sha256_16", "s.parses", "s.starts_with_brace")


@query(
    "c20_output_identity",
    """SELECT count(*) AS documents, count(*) FILTER (a.h = b.h) AS identical, coalesce(sum(a.p), 0)::BIGINT AS first_parses,
  coalesce(sum(b.p), 0)::BIGINT AS second_parses,
  CASE WHEN count(*) FILTER (a.h = b.h) = count(*) THEN 'no effect' WHEN coalesce(sum(b.p), 0) <= coalesce(sum(a.p), 0) THEN 'format not learned' ELSE 'ok' END AS verdict
FROM (SELECT event_id // 5 AS d, max(substr(sha256(answer), 1, 16)) AS h, max(json_valid(answer)::INT) AS p FROM fx_gen WHERE model = 'click' GROUP BY 1) a
FULL JOIN (SELECT event_id // 5 AS d, max(substr(sha256(answer), 1, 16)) AS h, max(json_valid(answer)::INT) AS p FROM fx_gen WHERE model = 'view' GROUP BY 1) b USING (d)""",
    ("fx_gen",),
)
def c20_output_identity(spark: SparkSession, sf: str) -> DataFrame:
    return an.same_output(_shapes(spark, sf), "click", "view")


@query(
    "d21_format_tally",
    """SELECT model AS which, count(*) AS n, count(*) FILTER (json_valid(answer)) AS json,
  count(*) FILTER (starts_with(answer, '{')) AS brace FROM fx_gen GROUP BY model""",
    ("fx_gen",),
)
def d21_format_tally(spark: SparkSession, sf: str) -> DataFrame:
    return _shapes(spark, sf).groupBy("which").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("parses").alias("json"),
        F.count_if("starts_with_brace").alias("brace"),
    )


@query(
    "b15_flag_warnings",
    """SELECT event_id, role, constrained FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'constrained' ELSE 'unconstrained' END AS role,
  event_id % 3 = 0 AS constrained FROM events) WHERE constrained <> (role = 'constrained')""",
)
def b15_flag_warnings(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return an.flag_warnings(
        fx.table(spark, sf, "events").select(
            "event_id", F.when(e % 2 == 0, "constrained").otherwise("unconstrained").alias("role"),
            (e % 3 == 0).alias("constrained"),
        )
    )


# ---- guards -----------------------------------------------------------------------
@query(
    "b10_long_strings",
    f"""SELECT doc_id, field, words FROM (
  SELECT doc_id, unnest(['text', 'heads', 'deep']) AS field, n AS words
  FROM (SELECT doc_id, len(regexp_extract_all(text, '[^{SPACE_SQL[1:-1]}]+')) AS n FROM documents))
WHERE words > 8""",
)
def b10_long_strings(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    body = F.to_json(
        F.struct(
            text.alias("text"), text.alias("note"), F.array(text, F.lit("short")).alias("heads"),
            F.struct(F.array(F.struct(text.alias("deep"))).alias("items")).alias("runs"), F.col("lang"),
        )
    )
    rows = fx.docs(spark, sf).select("doc_id", body.alias("body"))
    return guards.long_strings(rows, "doc_id", "body")


@query(
    "b11_forbidden_paths",
    r"""SELECT url FROM pages WHERE lower(url) LIKE '%feed' OR lower(url) LIKE '%/en/%' OR lower(url) LIKE 'https://m.%'""",
)
def b11_forbidden_paths(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select("url")
    return guards.forbidden_paths(pages, "url", ("feed",), ("/en/",), ("https://m.",))


SHINGLE_SQL = """SELECT DISTINCT {key}, array_to_string(w[i:i+7], ' ') AS s FROM (
  SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (
    SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {table}))"""


@query(
    "c19_shingle_contamination",
    f"""SELECT doc_id, count(*) AS shared FROM ({SHINGLE_SQL.format(key='doc_id', table='documents')})
WHERE s IN (SELECT s FROM ({SHINGLE_SQL.format(key='item_id', table='benchmark')})) GROUP BY doc_id""",
)
def c19_shingle_contamination(spark: SparkSession, sf: str) -> DataFrame:
    texts = guards.shingles(fx.docs(spark, sf), "doc_id")
    protected = guards.shingles(fx.table(spark, sf, "benchmark"), "item_id")
    return guards.contamination(texts, "doc_id", protected)


# ---- alignment --------------------------------------------------------------------
def _gold_text(spark: SparkSession, sf: str) -> DataFrame:
    # met by sorting, so that every text is cut into blocks once
    texts = fx.dealt_texts(spark, sf).select("doc_id", tx.blocks(F.col("text")).alias("text")).hint("merge")
    text = tx.piece_of(F.col("text"), F.col("start_off"), F.col("end_off"))
    return fx.gold(spark, sf).join(texts, "doc_id").withColumn("text", text)


GOLD_TEXT = "substr(text, start_off + 1, end_off - start_off)"
CTE["fx_needle"] = (
    ("fx_gold",),
    f"SELECT doc_id, idx, comp_id, ctype, start_off, end_off, {GOLD_TEXT} AS needle, text FROM fx_gold JOIN documents USING (doc_id)",
)


def _w(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{SPACE_SQL[1:-1]}]+')"


@query(
    "b14_perturbations",
    f"""SELECT doc_id, idx, needle AS verbatim,
  regexp_replace(regexp_replace(needle, '{SPACE_SQL}+', ' ', 'g'), '^ +| +$', '', 'g') AS whitespace_collapsed,
  lower(needle) AS lowercased,
  CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') ELSE needle END AS trimmed,
  array_to_string(w[1:greatest(1, floor(len(w) * 0.8::DOUBLE)::BIGINT)], ' ') AS truncated_80pct,
  CASE WHEN len(w) < 8 THEN needle ELSE array_to_string(list_filter(w, lambda x, i: i = 1 OR i = len(w) OR (i - 1) % 7 <> 0), ' ') END AS reworded
FROM (SELECT *, {_w('needle')} AS w FROM fx_needle)""",
    ("fx_needle",),
)
def b14_perturbations(spark: SparkSession, sf: str) -> DataFrame:
    made = [fn(F.col("text")).alias(name) for name, fn in tx.PERTURBATIONS.items()]
    return _gold_text(spark, sf).select("doc_id", "idx", *made)


@query(
    "i1_exact_locate",
    """SELECT doc_id, idx, instr(text, needle) - 1 AS start_off, instr(text, needle) - 1 + length(needle) AS end_off FROM fx_needle""",
    ("fx_needle",),
)
def i1_exact_locate(spark: SparkSession, sf: str) -> DataFrame:
    needles = _gold_text(spark, sf).select("doc_id", "idx", F.col("text").alias("needle"))
    return align(needles, fx.docs(spark, sf)).select("doc_id", "idx", "start_off", "end_off")


def _sweep(spark: SparkSession, sf: str, conditions, refine: bool) -> DataFrame:
    """Perturb every gold component, align it, and compare with where it came from."""
    made = F.array(
        *[F.struct(F.lit(c).alias("condition"), tx.PERTURBATIONS[c](F.col("text")).alias("needle")) for c in conditions]
    )
    rows = _gold_text(spark, sf).select(
        "doc_id", "idx", F.col("start_off").alias("gold_start"), F.col("end_off").alias("gold_end"), F.inline(made)
    )
    docs = fx.docs(spark, sf)
    spots = cut(align(rows, docs, refine))
    wanted = {
        "g_lo": ("gold_start", "lo"), "g_hi": ("gold_end", "hi"), "p_lo": ("start_off", "lo"), "p_hi": ("end_off", "hi"),
    }
    ranged = tx.with_token_indexes(spots, docs, wanted)
    shared = tx.overlap_ratio(*map(F.col, wanted))
    jaccard = F.when(F.col("start_off").isNull(), 0.0).otherwise(shared)
    return ranged.withColumn("jaccard", jaccard).drop(*wanted)


@query(
    "d14_alignment_error",
    """SELECT 'verbatim' AS condition, count(*) AS components,
  (count(*) FILTER (s = start_off))::DOUBLE / count(*) AS exact_span_rate, 1.0::DOUBLE AS located_rate, 0.0::DOUBLE AS failure_rate,
  median(abs(s - start_off)) AS start_error_median, median(abs(s - start_off)) AS end_error_median
FROM (SELECT *, instr(text, needle) - 1 AS s FROM fx_needle)""",
    ("fx_needle",),
)
def d14_alignment_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sweep(spark, sf, ["verbatim"], refine=True)
    return asm.alignment_error(rows, ["condition"]).select(
        "condition", "components", "exact_span_rate", "located_rate", "failure_rate",
        "start_error_median", "end_error_median",
    )


@query("i1_fuzzy_align")
def i1_fuzzy_align(spark: SparkSession, sf: str) -> DataFrame:
    """Every gold component, reworded and located again by the coarse search."""
    return _sweep(spark, sf, ["reworded"], refine=False).select(
        "doc_id", "idx", "start_off", "end_off", "ratio", "exact", "jaccard"
    )


@query("i4_alignment_sweep")
def i4_alignment_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All six conditions, coarse and refined."""
    keys = ["condition"]
    both = [
        asm.alignment_error(_sweep(spark, sf, list(tx.PERTURBATIONS), refine), keys).withColumn(
            "refined", F.lit(refine)
        )
        for refine in (False, True)
    ]
    meaningful = F.col("condition").isin(*tx.SPAN_KEEPING)
    return both[0].unionByName(both[1]).withColumn("exact_span_meaningful", meaningful)


# ---- assembly ---------------------------------------------------------------------
def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers quoting gold components, with repeated ids, odd types and dead ends."""
    k = F.col("idx")
    comp = F.struct(
        F.when(k % 5 == 4, F.lit(None)).otherwise(F.concat(F.lit("c"), k % 40 + 1)).alias("id"),
        F.when(k % 7 == 6, "Theory").otherwise(F.col("ctype")).alias("type"),
        F.when(k % 11 == 10, "  ").otherwise(F.col("text")).alias("text"),
    )
    rel = F.struct(
        F.concat(F.lit("c"), k % 40 + 1).alias("src"), F.concat(F.lit("c"), (k * 3) % 45 + 1).alias("tgt"),
        F.when(k % 6 == 0, "attacks").when(k % 6 == 1, "helps").otherwise("supports").alias("type"),
    )
    rows = _gold_text(spark, sf).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", comp.alias("c"), rel.alias("r")))).alias("x")
    )
    graph = F.to_json(F.struct(F.col("x.c").alias("components"), F.col("x.r").alias("relations")))
    return rows.select("doc_id", graph.alias("answer"))


CTE["fx_said"] = (
    ("fx_needle",),
    f"""SELECT doc_id, idx, CASE WHEN idx % 5 = 4 THEN concat('c', idx + 1) ELSE concat('c', idx % 40 + 1) END AS stated,
  CASE WHEN idx % 7 = 6 THEN NULL ELSE ctype END AS ctype,
  regexp_replace(needle, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS needle, text
FROM fx_needle WHERE idx % 11 <> 10 AND regexp_replace(needle, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') <> ''""",
)
CTE["fx_named"] = (
    ("fx_said",),
    """SELECT doc_id, idx, ctype, stated, instr(text, needle) - 1 AS start_off, instr(text, needle) - 1 + length(needle) AS end_off,
  row_number() OVER (PARTITION BY doc_id, stated ORDER BY idx) AS nth,
  CASE WHEN row_number() OVER (PARTITION BY doc_id, stated ORDER BY idx) = 1 THEN stated ELSE concat(stated, '#', idx + 1) END AS comp_id
FROM fx_said""",
)


@query(
    "i2_assembled_components",
    "SELECT doc_id, idx, comp_id, ctype, start_off, end_off FROM fx_named",
    ("fx_named",),
)
def i2_assembled_components(spark: SparkSession, sf: str) -> DataFrame:
    components, _, _ = asm.assemble(_answers(spark, sf), fx.docs(spark, sf))
    return components.drop("text")


@query(
    "i2_assembled_relations",
    """SELECT r.doc_id, r.idx, concat('r', r.idx + 1) AS rel_id, r.src, r.tgt, r.rtype FROM (
  SELECT doc_id, idx, concat('c', idx % 40 + 1) AS src, concat('c', (idx * 3) % 45 + 1) AS tgt,
    CASE WHEN idx % 6 = 0 THEN 'attacks' ELSE 'supports' END AS rtype FROM fx_gold) r
JOIN fx_named a ON a.doc_id = r.doc_id AND a.comp_id = r.src JOIN fx_named b ON b.doc_id = r.doc_id AND b.comp_id = r.tgt
WHERE r.src <> r.tgt""",
    ("fx_named", "fx_gold"),
)
def i2_assembled_relations(spark: SparkSession, sf: str) -> DataFrame:
    return asm.assemble(_answers(spark, sf), fx.docs(spark, sf))[1]


CTE["fx_stated"] = (
    ("fx_gold",),
    """SELECT doc_id, idx, CASE idx % 4 WHEN 2 THEN concat('c', idx // 4, '#', idx) WHEN 3 THEN concat('c', idx // 4, '#', idx - 1, '#', idx)
    ELSE concat('c', idx // 4) END AS s FROM fx_gold""",
)
CTE["fx_folded"] = (
    ("fx_stated",),
    """SELECT doc_id, list(idx ORDER BY idx) AS k, list_reduce(list_prepend([]::VARCHAR[], list([s, concat(s, '#', idx + 1)] ORDER BY idx)),
    lambda used, x: list_append(used, CASE WHEN list_contains(used, x[1]) THEN x[2] ELSE x[1] END)) AS c FROM fx_stated GROUP BY doc_id""",
)


@query(
    "e2_minted_ids",
    """SELECT doc_id, idx, comp_id, comp_id <> s AS repeat
FROM (SELECT doc_id, unnest(k) AS idx, unnest(c) AS comp_id FROM fx_folded) JOIN fx_stated USING (doc_id, idx)""",
    ("fx_stated", "fx_folded"),
)
def e2_minted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Stated ids of which some equal ids minted before them, and those minted from these."""
    k = F.col("idx")
    name = F.concat(F.lit("c"), F.floor(k / 4))
    stated = (
        F.when(k % 4 == 2, F.concat(name, F.lit("#"), k))
        .when(k % 4 == 3, F.concat(name, F.lit("#"), k - 1, F.lit("#"), k))
        .otherwise(name)
    )
    minted = asm.mint_ids(fx.gold(spark, sf).select("doc_id", "idx", stated.alias("stated")))
    return minted.select("doc_id", "idx", "comp_id", "repeat")


def first_sentences(doc_id, text: str) -> str:
    """A rule in place of a model: sentences are components, each supports the first."""
    import json

    if doc_id % 50 == 7:
        raise ValueError("refused")
    parts = [p.strip() for p in text.split(".") if p.strip()]
    comps = [{"id": f"c{i + 1}", "type": "Claim" if i == 0 else "Premise", "text": p} for i, p in enumerate(parts)]
    rels = [{"src": c["id"], "tgt": "c1", "type": "supports"} for c in comps[1:]]
    return json.dumps({"components": comps, "relations": rels})


@query("i3_batch_extraction")
def i3_batch_extraction(spark: SparkSession, sf: str) -> DataFrame:
    schema = "doc_id bigint, answer string, latency_s double, error string"
    got = asm.run_extractor(fx.docs(spark, sf), first_sentences, schema)
    return got.select("doc_id", F.sha2("answer", 256).alias("answer_sha256"), "error")


@query(
    "b8_legacy_normalisation",
    """SELECT event_id, CASE WHEN event_type IN ('premise', 'conclusion', 'objection', 'assumption', 'weakness', 'hidden_assumption') THEN event_type ELSE 'premise' END AS type,
  CASE WHEN event_id % 7 < 3 THEN 0.5::DOUBLE WHEN event_id % 7 = 3 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) END AS confidence,
  greatest(0, least(event_id % 90, 39)) AS source_start,
  greatest(greatest(0, least(event_id % 90, 39)) + 1, least(event_id % 90 + 30, 40)) AS source_end FROM events""",
)
def b8_legacy_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose confidence is absent, a word, a number in quotes, a truth value or a number."""
    e = F.col("event_id")
    said = (
        F.when(e % 7 == 0, "null").when(e % 7 == 1, '"high"').when(e % 7 == 2, '"0.9"').when(e % 7 == 3, "true")
        .otherwise(F.to_json(F.struct((F.col("value") / 100).alias("v"))))
    )
    parsed = F.parse_json(said)
    number = F.when(e % 7 > 3, F.try_variant_get(parsed, "$.v", "variant")).otherwise(parsed)
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("type"), number.alias("confidence"),
        (e % 90).alias("source_start"), (e % 90 + 30).alias("source_end"), F.lit(40).cast("bigint").alias("n"),
    )
    return legacy.claims(rows, "n").drop("n")


@query(
    "b8_located_claims",
    f"""SELECT doc_id, idx, 'premise' AS type, 0.5::DOUBLE AS confidence,
  CASE WHEN hit THEN position(claim IN text) - 1 ELSE greatest(0, least(s, length(text) - 1)) END AS source_start,
  CASE WHEN hit THEN position(claim IN text) - 1 + length(claim)
       ELSE greatest(greatest(0, least(s, length(text) - 1)) + 1, least(s + 30, length(text))) END AS source_end
FROM (SELECT doc_id, idx, text, idx * 400 AS s, CASE WHEN idx % 3 = 1 THEN '' ELSE needle END AS claim,
  idx % 3 <> 1 AND length(needle) > 0 AS hit FROM fx_needle)""",
    ("fx_needle",),
)
def b8_located_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims are looked for in their text; those without words keep what they state, clamped."""
    said = F.when(F.col("idx") % 3 == 1, "").otherwise(F.col("text"))
    rows = _gold_text(spark, sf).select(
        "doc_id", "idx", said.alias("claim"), F.lit("guess").alias("type"), F.lit(None).cast("double").alias("confidence"),
        (F.col("idx") * 400).alias("source_start"), (F.col("idx") * 400 + 30).alias("source_end"),
    )
    return legacy.located_claims(rows, fx.docs(spark, sf).select("doc_id", "text")).drop("claim")


@query(
    "b8_legacy_relationships",
    """SELECT event_id, CASE WHEN event_type IN ('supports', 'opposes', 'refines', 'depends_on') THEN event_type ELSE 'supports' END AS type,
  CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50)) END AS strength,
  'deductive' AS reasoning_type, user_id AS source, event_id AS target FROM events
WHERE user_id % 3 <> 0 AND event_id % 2 = 0 AND user_id IN (SELECT doc_id FROM documents)""",
)
def b8_legacy_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose ends are not both known claims go."""
    e, u = F.col("event_id"), F.col("user_id")
    events = fx.table(spark, sf, "events")
    rows = events.select(
        "event_id", F.lit("all").alias("doc_id"), F.col("event_type").alias("type"),
        F.when(e % 5 != 0, F.col("value") / 50).alias("strength"), F.lit("guess").alias("reasoning_type"),
        u.cast("bigint").alias("source"), (-1 - e).alias("target"),
    )
    sources = fx.docs(spark, sf).filter(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("claim_id"))
    targets = events.filter(e % 2 == 0).select((-1 - e).alias("claim_id"))
    known = sources.unionByName(targets).select(F.lit("all").alias("doc_id"), "claim_id")
    return legacy.relationships(rows, known).select(
        "event_id", "type", "strength", "reasoning_type", "source", (-1 - F.col("target")).alias("target")
    )


@query(
    "b8_legacy_bias",
    """SELECT doc_id, CASE WHEN lang IN ('neutral', 'loaded', 'one_sided', 'balanced') THEN lang ELSE 'neutral' END AS framing,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS dominant_perspective,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat_ws(',', source, lang, source) END AS underrepresented_perspectives FROM documents""",
)
def b8_legacy_bias(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = fx.docs(spark, sf).select(
        "doc_id", F.col("lang").alias("framing"), F.when(d % 4 != 0, F.col("source")).alias("dominant_perspective"),
        F.when(d % 5 != 0, F.array("source", "lang", "source", "lang")).alias("underrepresented_perspectives"),
    )
    listed = F.array_join("underrepresented_perspectives", ",")
    return legacy.bias(rows).withColumn("underrepresented_perspectives", listed)

"""Splits, validation, graphs, chat records and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixtures as fx
from marginalia.fixtures import CTE
from marginalia.functions import hashing
from marginalia.functions import text as tx
from marginalia.operators import selection as sel
from marginalia.operators import shaping as sh
from marginalia.operators import validate as va
from marginalia.plans.answer_queries import SPACE_SQL, _gold_text
from marginalia.plans.registry import query
from marginalia.session import scratch_path
from marginalia.sources import files

SYSTEM = "Annotate the argument structure of the text."


@query("b1_split_filter", "SELECT doc_id, split FROM fx_docs WHERE split = 'val'", ("fx_docs",))
def b1_split_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fx.docs(spark, sf).filter(F.col("split") == "val").select("doc_id", "split")


@query(
    "b1_partitioned_split",
    "SELECT doc_id, lang AS corpus, split FROM fx_docs WHERE split = 'val' AND lang = (SELECT min(lang) FROM documents)",
    ("fx_docs",),
)
def b1_partitioned_split(spark: SparkSession, sf: str) -> DataFrame:
    """One split of one corpus, read from its own folder of a written corpus."""
    docs = fx.docs(spark, sf)
    path = scratch_path(spark, "corpora")
    files.write_corpora(docs.withColumn("corpus", F.col("lang")), path)
    corpus = docs.agg(F.min("lang")).first()[0]
    return files.read_split(spark, path, "val", corpus).select("doc_id", "corpus", "split")


@query("b2_first_documents", "SELECT doc_id, lang FROM fx_docs ORDER BY doc_id LIMIT 25", ("fx_docs",))
def b2_first_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.docs(spark, sf).select("doc_id", "lang").orderBy("doc_id").limit(25)


CTE["fx_claimed"] = (
    ("fx_pred", "fx_gold"),
    """SELECT p.system_id, p.doc_id, CASE WHEN p.idx % 8 = 6 THEN 'P1' ELSE p.comp_id END AS comp_id, CASE WHEN p.idx % 10 = 4 THEN p.end_off ELSE p.start_off END AS start_off,
  p.end_off, substr(d.text, g.start_off + 1, g.end_off - g.start_off) AS text
FROM fx_pred p JOIN fx_gold g ON g.doc_id = p.doc_id AND g.idx = p.idx // 2 JOIN documents d ON d.doc_id = p.doc_id""",
)
CTE["fx_linked"] = (
    ("fx_pred_rel",),
    "SELECT system_id, doc_id, CASE WHEN idx % 14 = 0 THEN 'Q2' ELSE rel_id END AS rel_id, src, tgt FROM fx_pred_rel",
)


@query(
    "b3_violations",
    """SELECT DISTINCT system_id, doc_id, item, rule FROM (
  SELECT c.system_id, c.doc_id, comp_id AS item, unnest(list_filter([CASE WHEN start_off < 0 OR end_off < 0 THEN 'negative offset' END,
    CASE WHEN end_off <= start_off THEN 'empty or inverted span' END, CASE WHEN end_off > length(d.text) THEN 'span beyond text' END,
    CASE WHEN start_off >= 0 AND end_off > start_off AND end_off <= length(d.text) AND substr(d.text, start_off + 1, end_off - start_off) <> c.text
      THEN 'text mismatch' END], lambda x: x IS NOT NULL)) AS rule FROM fx_claimed c JOIN documents d USING (doc_id)
  UNION ALL SELECT system_id, doc_id, comp_id, 'duplicate component id' FROM fx_claimed GROUP BY system_id, doc_id, comp_id HAVING count(*) > 1
  UNION ALL SELECT system_id, doc_id, rel_id, 'duplicate relation id' FROM fx_linked GROUP BY system_id, doc_id, rel_id HAVING count(*) > 1
  UNION ALL SELECT system_id, doc_id, rel_id, 'self loop' FROM fx_linked WHERE src = tgt
  UNION ALL SELECT system_id, doc_id, rel_id, 'endpoint is not a component' FROM (SELECT system_id, doc_id, rel_id, unnest([src, tgt]) AS e FROM fx_linked) r
    ANTI JOIN fx_claimed c ON c.system_id = r.system_id AND c.doc_id = r.doc_id AND c.comp_id = r.e)""",
    ("fx_claimed", "fx_linked"),
)
def b3_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("idx")
    text = _gold_text(spark, sf).select("doc_id", F.col("idx").alias("g"), "text")
    claimed = fx.pred(spark, sf).withColumn("g", F.floor(k / 2)).join(text, ["doc_id", "g"]).select(
        "system_id", "doc_id", F.when(k % 8 == 6, "P1").otherwise(F.col("comp_id")).alias("comp_id"),
        F.when(k % 10 == 4, F.col("end_off")).otherwise(F.col("start_off")).alias("start_off"), "end_off", "text",
    )
    linked = fx.pred_rel(spark, sf).select(
        "system_id", "doc_id", F.when(k % 14 == 0, "Q2").otherwise(F.col("rel_id")).alias("rel_id"), "src", "tgt"
    )
    return _per_system(
        lambda mine: va.violations(fx.docs(spark, sf), claimed.filter(mine), linked.filter(mine)),
    )


def _per_system(result) -> DataFrame:
    """The result for each system of the fixture, named."""
    return reduce(
        DataFrame.unionByName,
        [result(F.col("system_id") == k).withColumn("system_id", F.lit(k).cast("bigint")) for k in fx.SYSTEMS],
    )


@query(
    "b12_id_audit",
    """SELECT split, doc_id, unnest(list_filter([CASE WHEN split NOT IN ('train', 'val', 'test') THEN 'unknown split' END,
  CASE WHEN contains(doc_id, ' ') THEN 'blank in id' END, CASE WHEN length(doc_id) >= 64 THEN 'too long for an id' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT CASE WHEN page_id % 9 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN page_id % 4 = 0 THEN concat('page ', url) ELSE repeat(url, (page_id % 3)::INT + 1) END AS doc_id FROM pages)""",
)
def b12_id_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    named = F.when(p % 4 == 0, F.concat(F.lit("page "), "url")).otherwise(
        F.repeat("url", (p % 3).cast("int") + 1)
    )
    split = F.when(p % 9 == 0, "dev").otherwise("train")
    return va.id_problems(fx.table(spark, sf, "pages").select(split.alias("split"), named.alias("doc_id")))


CTE["fx_layered"] = (
    ("fx_gold", "fx_pred"),
    """SELECT x.*, length(text) AS n FROM (SELECT s AS system_id, 'gold' AS layer, doc_id, comp_id, start_off, end_off FROM fx_gold, (VALUES (0::BIGINT), (1)) ss(s)
  UNION ALL SELECT system_id, 'prediction', doc_id, comp_id, start_off, end_off FROM fx_pred) x JOIN documents USING (doc_id)""",
)
CTE["fx_segments"] = (
    ("fx_layered",),
    """SELECT b.system_id, b.doc_id, b.s AS start_off, b.e AS end_off,
  array_to_string(list_sort(list(h.comp_id) FILTER (h.layer = 'prediction')), ',') AS prediction,
  array_to_string(list_sort(list(h.comp_id) FILTER (h.layer = 'gold')), ',') AS gold
FROM (SELECT system_id, doc_id, pt AS s, lead(pt) OVER (PARTITION BY system_id, doc_id ORDER BY pt) AS e FROM (
    SELECT DISTINCT s AS system_id, doc_id, unnest([0, length(text)]) AS pt FROM documents, (VALUES (0::BIGINT), (1)) ss(s)
    UNION SELECT system_id, doc_id, unnest([least(greatest(start_off, 0), n), least(greatest(end_off, 0), n)]) FROM fx_layered)) b
LEFT JOIN fx_layered h ON h.system_id = b.system_id AND h.doc_id = b.doc_id AND h.start_off < b.e AND h.end_off > b.s
WHERE b.e > b.s GROUP BY b.system_id, b.doc_id, b.s, b.e""",
)


@query(
    "c16_segments",
    "SELECT system_id, doc_id, start_off, end_off, coalesce(prediction, '') AS prediction, coalesce(gold, '') AS gold FROM fx_segments",
    ("fx_segments",),
)
def c16_segments(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["layer", "doc_id", "comp_id", "start_off", "end_off"]
    gold = fx.gold(spark, sf).withColumn("layer", F.lit("gold")).select(cols)
    pred = fx.pred(spark, sf).withColumn("layer", F.lit("prediction"))
    docs = fx.docs(spark, sf)
    out = _per_system(lambda mine: sh.segments(docs, gold.unionByName(pred.filter(mine).select(cols))))
    return out.withColumns({c: F.array_join(c, ",") for c in ("prediction", "gold")})


@query(
    "c21_edge_neighbourhood",
    """SELECT g.doc_id, g.comp_id, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, o.n IS NULL AND i.n IS NULL AS isolated
FROM fx_gold g LEFT JOIN (SELECT doc_id, src, count(*) AS n FROM fx_gold_rel GROUP BY ALL) o ON o.doc_id = g.doc_id AND o.src = g.comp_id
LEFT JOIN (SELECT doc_id, tgt, count(*) AS n FROM fx_gold_rel GROUP BY ALL) i ON i.doc_id = g.doc_id AND i.tgt = g.comp_id""",
    ("fx_gold_rel",),
)
def c21_edge_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return sh.neighbourhood(fx.gold(spark, sf), fx.gold_rel(spark, sf))


@query(
    "c22_epoch_metrics",
    """SELECT epoch, eval_loss, loss FROM (SELECT unnest(range(0, 12)) AS epoch)
LEFT JOIN (SELECT round_even(event_id % 100 / 10.0::DOUBLE, 0)::BIGINT AS epoch,
  max_by(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN event_id END) AS eval_loss,
  max_by(CASE WHEN event_id % 2 = 1 THEN value END, CASE WHEN event_id % 2 = 1 THEN event_id END) AS loss FROM events GROUP BY 1) USING (epoch)""",
)
def c22_epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    log = fx.table(spark, sf, "events").select(
        e.alias("step"), ((e % 100) / F.lit(10.0)).alias("epoch"),
        F.when(e % 2 == 0, F.col("value")).alias("eval_loss"), F.when(e % 2 == 1, F.col("value")).alias("loss"),
    )
    return sel.attach_epoch_metrics(spark.range(12).withColumnRenamed("id", "epoch"), log, ["eval_loss", "loss"])


@query(
    "c23_component_lookup",
    """SELECT DISTINCT r.system_id, r.doc_id, r.tgt AS comp_id, coalesce(c.idx, -1) AS idx, c.ctype, coalesce(c.start_off, -1) AS start_off, coalesce(c.end_off, -1) AS end_off
FROM (SELECT DISTINCT system_id, doc_id, tgt FROM fx_pred_rel) r
LEFT JOIN (SELECT * FROM fx_pred QUALIFY row_number() OVER (PARTITION BY system_id, doc_id, comp_id ORDER BY idx) = 1) c
  ON c.system_id = r.system_id AND c.doc_id = r.doc_id AND c.comp_id = r.tgt""",
    ("fx_pred_rel", "fx_pred"),
)
def c23_component_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pred, rel = fx.pred(spark, sf), fx.pred_rel(spark, sf)
    found = _per_system(
        lambda mine: sh.component_by_id(
            pred.filter(mine).drop("system_id"), rel.filter(mine).select("doc_id", F.col("tgt").alias("comp_id")).distinct()
        )
    )
    return found.fillna(-1, ["idx", "start_off", "end_off"])


@query(
    "d4_dataset_summary",
    """SELECT 'documents' AS measure, '*' AS what, count(*)::DOUBLE AS value FROM fx_docs
UNION ALL SELECT 'mean_chars', '*', round_even(avg(length(text)), 1) FROM fx_docs UNION ALL SELECT 'max_chars', '*', max(length(text))::DOUBLE FROM fx_docs
UNION ALL SELECT 'by_split', split, count(*)::DOUBLE FROM fx_docs GROUP BY split
UNION ALL SELECT 'components_by_type', ctype, count(*)::DOUBLE FROM fx_gold GROUP BY ctype
UNION ALL SELECT 'relations_by_type', rtype, count(*)::DOUBLE FROM fx_gold_rel GROUP BY rtype
UNION ALL SELECT 'components', '*', count(*)::DOUBLE FROM fx_gold UNION ALL SELECT 'relations', '*', count(*)::DOUBLE FROM fx_gold_rel
UNION ALL SELECT 'stances', CASE WHEN idx % 2 = 0 THEN 'For' ELSE 'Against' END, count(*)::DOUBLE FROM fx_gold WHERE ctype = 'Claim' GROUP BY idx % 2
UNION ALL SELECT 'meta_lang', lang, count(*)::DOUBLE FROM fx_docs GROUP BY lang
UNION ALL SELECT 'meta_source', source, count(*)::DOUBLE FROM fx_docs GROUP BY source
UNION ALL SELECT 'typed_components', '*', 1.0::DOUBLE""",
    ("fx_docs", "fx_gold_rel"),
)
def d4_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("idx") % 2 == 0, "For").otherwise("Against")
    gold = fx.gold(spark, sf).withColumn("stance", F.when(F.col("ctype") == "Claim", side))
    return sh.dataset_summary(fx.docs(spark, sf), gold, fx.gold_rel(spark, sf), ("lang", "source"))


@query(
    "d22_graph_tally",
    """SELECT doc_id, coalesce(ctype, 'Untyped') AS what, count(*) AS n FROM (SELECT doc_id, CASE WHEN idx % 9 <> 0 THEN ctype END AS ctype FROM fx_gold) GROUP BY ALL
UNION ALL SELECT doc_id, 'Relations', count(*) FROM fx_gold_rel GROUP BY doc_id""",
    ("fx_gold_rel",),
)
def d22_graph_tally(spark: SparkSession, sf: str) -> DataFrame:
    some = fx.gold(spark, sf).withColumn("ctype", F.when(F.col("idx") % 9 != 0, F.col("ctype")))
    return sh.graph_tally(some, fx.gold_rel(spark, sf))


CTE["fx_graph"] = (
    ("fx_gold", "fx_gold_rel"),
    """SELECT d.doc_id, d.text, to_json({'components': coalesce(c.l, []), 'relations': coalesce(r.l, [])})::VARCHAR AS graph FROM documents d
LEFT JOIN (SELECT doc_id, list({'id': concat('c', idx + 1), 'type': ctype, 'text': substr(text, start_off + 1, end_off - start_off)} ORDER BY idx) AS l
  FROM fx_gold JOIN documents USING (doc_id) GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, list({'src': concat('c', substr(src, 2)), 'tgt': concat('c', substr(tgt, 2)), 'type': rtype} ORDER BY idx) AS l
  FROM fx_gold_rel GROUP BY doc_id) r USING (doc_id)""",
)


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.docs(spark, sf)
    made = sh.graphs(docs, _gold_text(spark, sf), fx.gold_rel(spark, sf))
    return docs.join(made, "doc_id")


@query("e1_renumbered_graph", "SELECT doc_id, sha256(graph) AS graph FROM fx_graph", ("fx_graph",))
def e1_renumbered_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _graphs(spark, sf).select("doc_id", F.sha2(F.to_json("graph"), 256).alias("graph"))


@query(
    "d17_sft_sizing",
    """SELECT split, count(*) AS documents, round_even(sum(a)::DOUBLE / count(*), 1) AS mean_answer_tokens, max(a) AS max_answer_tokens,
  round_even(sum(p)::DOUBLE / count(*), 1) AS mean_prompt_tokens, max(p) AS max_prompt_tokens, max(a + p) AS max_total_tokens
FROM (SELECT split, (length(graph) + 5 * len(regexp_extract_all(graph, '[^\\x00-\\x7f]')) + 6 * len(regexp_extract_all(graph, '[\\x{10000}-\\x{10ffff}]'))) // 3 AS a,
  length(g.text) // 3 AS p FROM fx_graph g JOIN fx_docs USING (doc_id)) GROUP BY split""",
    ("fx_graph", "fx_docs"),
)
def d17_sft_sizing(spark: SparkSession, sf: str) -> DataFrame:
    return sh.sizing(_graphs(spark, sf), ["split"])


PROMPT_SQL = "concat('List the claims and premises of the document below and how they are linked.\n\n<document>\n', text, '\n</document>')"


@query(
    "h6_chat_messages",
    f"""SELECT doc_id, unnest([0, 1, 2]) AS turn, unnest(['system', 'user', 'assistant']) AS role,
  unnest([sha256('{SYSTEM}'), sha256({PROMPT_SQL}), sha256(graph)]) AS content FROM fx_graph""",
    ("fx_graph",),
)
def h6_chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    chat = sh.messages(F.col("text"), F.to_json("graph"), SYSTEM)
    rows = _graphs(spark, sf).select("doc_id", F.posexplode(chat).alias("turn", "m"))
    return rows.select(
        "doc_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.sha2("m.content", 256).alias("content")
    )


@query(
    "h7_grammar_conformance",
    """SELECT d.doc_id, coalesce(c.n, 0) <= 30 AND coalesce(r.n, 0) <= 22 AND coalesce(c.m, 0) < 100 AS conforms FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, max(idx + 1) AS m FROM fx_gold GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_gold_rel GROUP BY doc_id) r USING (doc_id)""",
    ("fx_gold_rel",),
)
def h7_grammar_conformance(spark: SparkSession, sf: str) -> DataFrame:
    return _graphs(spark, sf).select("doc_id", sh.conforms(F.col("graph")).alias("conforms"))


@query(
    "h7_types_and_budget",
    """SELECT d.doc_id, coalesce(c.n, 0) <= 30 AND coalesce(r.n, 0) <= 22 AND coalesce(c.m, 0) < 100
    AND NOT (d.doc_id % 7 = 3 AND coalesce(c.n, 0) > 0) AS conforms,
  coalesce(c.n, 0) * 50 + coalesce(r.n, 0) * 25 AS token_bound, coalesce(c.n, 0) * 50 + coalesce(r.n, 0) * 25 < 400 AS within_400,
  30 * 50 + 22 * 25 < 3072 AS closes
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, max(idx + 1) AS m FROM fx_gold GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_gold_rel GROUP BY doc_id) r USING (doc_id)""",
    ("fx_gold_rel",),
)
def h7_types_and_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a type outside the scheme do not conform; every answer's worst case in tokens."""
    other = F.when(F.col("doc_id") % 7 == 3, "Evidence")
    retyped = F.transform("graph.components", lambda c: c.withField("type", F.coalesce(other, c["type"])))
    rows = _graphs(spark, sf).withColumn("graph", F.col("graph").withField("components", retyped))
    bound = sh.token_bound(F.size("graph.components"), F.size("graph.relations")).cast("bigint")
    return rows.select(
        "doc_id", sh.conforms(F.col("graph")).alias("conforms"), bound.alias("token_bound"),
        (bound < 400).alias("within_400"), F.lit(sh.grammar_closes()).alias("closes"),
    )


CTE["fx_sizes"] = (
    ("fx_docs", "fx_gold"),
    """SELECT doc_id, count(g.idx) AS n_components FROM fx_docs d LEFT JOIN fx_gold g USING (doc_id) WHERE d.split = 'train' GROUP BY doc_id""",
)


def _train_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.gold(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_components"))
    train = fx.docs(spark, sf).filter("split = 'train'").select("doc_id")
    return train.join(n, "doc_id", "left").fillna(0, ["n_components"])


@query(
    "e5_validation_carve",
    """SELECT doc_id, n_components, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('-', 13, doc_id)), doc_id)
    <= round_even((count(*) OVER (PARTITION BY stratum)) * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, (row_number() OVER (ORDER BY n_components, doc_id) - 1) // greatest(1, (count(*) OVER ()) // 4) AS stratum FROM fx_sizes)""",
    ("fx_sizes",),
)
def e5_validation_carve(spark: SparkSession, sf: str) -> DataFrame:
    return sh.carve_validation(_train_sizes(spark, sf))


CTE["fx_picked"] = (
    ("fx_sizes",),
    """SELECT doc_id, n_components FROM (SELECT *, row_number() OVER (ORDER BY n_components, doc_id) - 1 AS pos, count(*) OVER () AS n FROM fx_sizes WHERE n_components > 0)
WHERE pos >= n // 4 AND pos < 3 * n // 4 ORDER BY md5(concat_ws('-', 17, doc_id)), doc_id LIMIT 3""",
)


@query("e6_exemplar_pick", "SELECT * FROM fx_picked", ("fx_picked",))
def e6_exemplar_pick(spark: SparkSession, sf: str) -> DataFrame:
    return sh.pick_exemplars(_train_sizes(spark, sf))


@query(
    "h5_prompt_fingerprint",
    f"""SELECT concat('v2-', substr(sha256(to_json({{'version': 'v2', 'system': '{SYSTEM}',
  'turns': list({{'doc_id': doc_id, 'turn': turn, 'role': role, 'content': content}} ORDER BY doc_id, turn)}})::VARCHAR), 1, 16)) AS fingerprint
FROM (SELECT doc_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, unnest([{PROMPT_SQL}, graph]) AS content
  FROM fx_graph JOIN fx_picked USING (doc_id))""",
    ("fx_graph", "fx_picked"),
)
def h5_prompt_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of the prompt rendered with the picked exemplars."""
    chosen = sh.pick_exemplars(_train_sizes(spark, sf)).select("doc_id")
    turns = sh.exemplar_turns(_graphs(spark, sf).join(chosen, "doc_id"))
    # six turns at most: three exemplars, two turns each
    listed = turns.agg(F.array_sort(F.collect_list(F.struct("doc_id", "turn", "role", "content"))).alias("t"))
    rendered = F.to_json(F.struct(F.lit("v2").alias("version"), F.lit(SYSTEM).alias("system"), F.col("t").alias("turns")))
    return listed.select(hashing.fingerprint("v2", rendered).alias("fingerprint"))


@query(
    "h8_prefix_parity",
    """SELECT doc_id, starts_with(a, b) OR starts_with(b, a) AS is_prefix, coalesce(min(i) FILTER (substr(a, i + 1, 1) <> substr(b, i + 1, 1)), any_value(n)) AS first_difference
FROM (SELECT doc_id, a, b, least(length(a), length(b)) AS n, unnest(range(0, greatest(1, least(length(a), length(b))))) AS i FROM (
  SELECT doc_id, text AS a, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) ELSE concat(substr(text, 1, length(text) // 3), '#', text) END AS b FROM documents))
GROUP BY doc_id, a, b""",
)
def h8_prefix_parity(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.length("text"), F.col("text")
    half = F.substring(text, F.lit(1), F.floor(n / 2).cast("int"))
    third = F.concat(F.substring(text, F.lit(1), F.floor(n / 3).cast("int")), F.lit("#"), text)
    rows = fx.dealt_texts(spark, sf).select(
        "doc_id", text.alias("a"), F.when(F.col("doc_id") % 3 == 0, half).otherwise(third).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "doc_id", (F.startswith(a, b) | F.startswith(b, a)).alias("is_prefix"),
        tx.first_difference(a, b).alias("first_difference"),
    )


# ---- order and sets -------------------------------------------------------------------
@query(
    "f4_document_order",
    "SELECT doc_id, comp_id, start_off FROM fx_gold ORDER BY doc_id, start_off",
    ("fx_gold",),
)
def f4_document_order(spark: SparkSession, sf: str) -> DataFrame:
    return fx.gold(spark, sf).select("doc_id", "comp_id", "start_off").orderBy("doc_id", "start_off")


@query(
    "g1_union_of_failures",
    """SELECT doc_id FROM fx_gen WHERE NOT json_valid(answer) UNION SELECT doc_id FROM fx_gen WHERE finish_reason = 'length'
UNION SELECT doc_id FROM fx_gen WHERE json_valid(answer) AND json_type(CASE WHEN json_valid(answer) THEN answer END) <> 'OBJECT'""",
    ("fx_gen",),
)
def g1_union_of_failures(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.answers import unparseable

    gen = fx.gen(spark, sf)
    cut_off = gen.filter("finish_reason = 'length'").select("doc_id")
    return unparseable(gen).union(cut_off).distinct()


@query(
    "g2_corpora_share_ids",
    """SELECT doc_id, count(DISTINCT corpus) AS groups FROM (SELECT doc_id, 'documents' AS corpus FROM documents
  UNION ALL SELECT page_id, 'pages' FROM pages) GROUP BY doc_id HAVING count(DISTINCT corpus) > 1""",
)
def g2_corpora_share_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("corpus"))
    b = fx.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("corpus"))
    return va.shared_ids(a.unionByName(b), "corpus")


@query(
    "g3_unpaired_stems",
    """(SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 EXCEPT SELECT doc_id FROM labels)
UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)""",
)
def g3_unpaired_stems(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.sources.standoff import unpaired

    texts = fx.table(spark, sf, "documents").filter("doc_id % 7 <> 0").select("doc_id")
    return unpaired(texts, fx.table(spark, sf, "labels").select("doc_id"))


@query(
    "g4_split_disjointness",
    """SELECT count(*) AS shared FROM (SELECT doc_id FROM (SELECT doc_id, split FROM fx_docs) GROUP BY doc_id HAVING count(DISTINCT split) > 1)""",
    ("fx_docs",),
)
def g4_split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    return va.shared_ids(fx.docs(spark, sf), "split").agg(F.count(F.lit(1)).alias("shared"))

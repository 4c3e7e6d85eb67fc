"""Graphs, splits, exemplars and chat records made from annotated documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.ranking import positions
from marginalia.schemas import (
    COMPONENT_ID_PATTERN,
    COMPONENT_TYPES,
    MAX_COMPONENTS,
    MAX_RELATIONS,
    RELATION_TYPES,
)
from marginalia.session import dealt

# ---- fixed values --------------------------------------------------------------
SPLIT_SEED = 13
VAL_FRACTION = 0.2
STRATA = 4
EXEMPLAR_SEED = 17
EXEMPLARS = 3
# tokens of a component and of a relation in an answer, and of a whole answer
COMPONENT_TOKENS = 50
RELATION_TOKENS = 25
MAX_OUTPUT_TOKENS = 3072
USER_PROMPT = (
    "List the claims and premises of the document below and how they are linked.\n\n<document>\n",
    "\n</document>",
)
# ---------------------------------------------------------------------------------


def renumber(components: DataFrame) -> DataFrame:
    """``c1..cN`` in document order; a missing type is a Premise."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    return components.select(
        "doc_id", "idx", "comp_id",
        F.concat(F.lit("c"), nth).alias("new_id"),
        F.coalesce("ctype", F.lit("Premise")).alias("ctype"),
    )


def renumber_edges(components: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges between renumbered components; edges with an unknown end are dropped."""
    names = renumber(components).select("doc_id", "comp_id", "new_id")
    out = relations
    for end in ("src", "tgt"):
        out = out.join(
            names.withColumnsRenamed({"comp_id": end, "new_id": f"new_{end}"}), ["doc_id", end]
        )
    return out.select("doc_id", "idx", F.col("new_src").alias("src"), F.col("new_tgt").alias("tgt"), "rtype")


def graphs(docs: DataFrame, components: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, graph): the annotated graph as the answer expected for the document.

    ``components`` carries its text. The arrays are the document's own rows.
    """
    named = renumber(components).join(
        components.select("doc_id", "idx", "text"), ["doc_id", "idx"]
    )
    comps = named.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "new_id", "ctype", "text"))).alias("c")
    )
    rels = renumber_edges(components, relations).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "src", "tgt", "rtype"))).alias("r")
    )
    ctype = "array<struct<id:string,type:string,text:string>>"
    rtype = "array<struct<src:string,tgt:string,type:string>>"
    c = F.transform("c", lambda x: F.struct(x["new_id"].alias("id"), x["ctype"].alias("type"), x["text"].alias("text")))
    r = F.transform("r", lambda x: F.struct(x["src"].alias("src"), x["tgt"].alias("tgt"), x["rtype"].alias("type")))
    return (
        docs.select("doc_id")
        .join(comps, "doc_id", "left")
        .join(rels, "doc_id", "left")
        .select(
            "doc_id",
            F.struct(
                F.coalesce(c, F.array().cast(ctype)).alias("components"),
                F.coalesce(r, F.array().cast(rtype)).alias("relations"),
            ).alias("graph"),
        )
    )


def user_prompt(text: Column) -> Column:
    return F.concat(F.lit(USER_PROMPT[0]), text, F.lit(USER_PROMPT[1]))


def messages(text: Column, answer: Column, system: str) -> Column:
    """A chat record: system, user and, where there is one, the answer."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    asked = F.array(turn("system", F.lit(system)), turn("user", user_prompt(text)))
    return F.when(answer.isNull(), asked).otherwise(F.concat(asked, F.array(turn("assistant", answer))))


def exemplar_turns(exemplars: DataFrame) -> DataFrame:
    """Alternating user and assistant turns, exemplars in id order."""
    turns = F.array(
        F.struct(F.lit("user").alias("role"), user_prompt(F.col("text")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.to_json("graph").alias("content")),
    )
    return exemplars.select("doc_id", F.posexplode(turns).alias("turn", "t")).select(
        "doc_id", "turn", "t.role", "t.content"
    )


def _ascii_length(text: Column) -> Column:
    """Length of a JSON text once non-ASCII characters are escaped as \\uXXXX."""
    beyond = F.length(F.regexp_replace(text, "[\\x{10000}-\\x{10ffff}]", "xx"))
    other = F.regexp_count(text, F.lit("[^\\x00-\\x7f]"))
    astral = F.regexp_count(text, F.lit("[\\x{10000}-\\x{10ffff}]"))
    return (beyond + 5 * other + 5 * astral).cast("bigint")


def sizing(records: DataFrame, keys: list[str]) -> DataFrame:
    """Token estimates (a third of the characters) of answers and prompts per group."""
    answer = F.floor(_ascii_length(F.to_json("graph")) / 3)
    prompt = F.floor(F.length("text") / 3)
    rows = records.select(*keys, answer.alias("a"), prompt.alias("p"))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("documents"),
        F.bround(F.sum("a") / n, 1).alias("mean_answer_tokens"),
        F.max("a").alias("max_answer_tokens"),
        F.bround(F.sum("p") / n, 1).alias("mean_prompt_tokens"),
        F.max("p").alias("max_prompt_tokens"),
        F.max(F.col("a") + F.col("p")).alias("max_total_tokens"),
    )


def seeded(seed: int) -> Column:
    """A repeatable order of documents, different for every seed."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("doc_id").cast("string")))


def ranked_by_size(sizes: DataFrame) -> DataFrame:
    """0-based position of documents ordered by (n_components, doc_id), and their number."""
    total = sizes.agg(F.count(F.lit(1)).alias("n"))
    return positions(sizes, ["n_components", "doc_id"]).join(F.broadcast(total))


def carve_validation(
    sizes: DataFrame, fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED, strata: int = STRATA
) -> DataFrame:
    """Training documents with the split they end in: a share of every size stratum moves to val.

    A document's place inside its stratum is its place in the order by stratum and hash, less
    the documents of the strata before; no task holds a stratum.
    """
    ranked = ranked_by_size(sizes)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / strata))
    keyed = ranked.select(
        "doc_id", "n_components", F.floor(F.col("pos") / size).alias("stratum"), size.alias("size"), "n",
        seeded(seed).alias("hash"),
    )
    placed = positions(keyed, ["stratum", "hash", "doc_id"])
    nth = F.col("pos") - F.col("stratum") * F.col("size")
    # the last stratum may be short
    members = F.least("size", F.col("n") - F.col("stratum") * F.col("size"))
    take = F.bround(members * F.lit(float(fraction)), 0)
    return placed.select(
        "doc_id", "n_components", "stratum", F.when(nth < take, "val").otherwise("train").alias("split")
    )


def pick_exemplars(sizes: DataFrame, k: int = EXEMPLARS, seed: int = EXEMPLAR_SEED) -> DataFrame:
    """``k`` training documents from the middle half by size."""
    ranked = ranked_by_size(sizes.filter("n_components > 0"))
    lo, hi = F.floor(F.col("n") / 4), F.floor(F.col("n") * 3 / 4)
    middle = ((F.col("pos") >= lo) & (F.col("pos") < hi)) | (lo >= hi)
    return ranked.filter(middle).orderBy(seeded(seed), "doc_id").limit(k).select("doc_id", "n_components")


def conforms(graph: Column) -> Column:
    """Whether an answer stays inside the bounded grammar: sizes, ids and types."""
    c, r = graph["components"], graph["relations"]
    return (
        (F.size(c) <= MAX_COMPONENTS)
        & (F.size(r) <= MAX_RELATIONS)
        & F.forall(c, lambda x: x["id"].rlike(COMPONENT_ID_PATTERN) & x["type"].isin(*COMPONENT_TYPES))
        & F.forall(
            r,
            lambda x: x["src"].rlike(COMPONENT_ID_PATTERN)
            & x["tgt"].rlike(COMPONENT_ID_PATTERN)
            & x["type"].isin(*RELATION_TYPES),
        )
    )


def token_bound(components: Column, relations: Column) -> Column:
    """Most tokens an answer with so many components and relations takes."""
    return components * F.lit(COMPONENT_TOKENS) + relations * F.lit(RELATION_TOKENS)


def grammar_closes(max_tokens: int = MAX_OUTPUT_TOKENS) -> bool:
    """Whether the largest answer of the grammar fits, so that generation always reaches its end."""
    return MAX_COMPONENTS * COMPONENT_TOKENS + MAX_RELATIONS * RELATION_TOKENS < max_tokens


def dataset_summary(
    docs: DataFrame, components: DataFrame, relations: DataFrame, meta: Sequence[str] = ()
) -> DataFrame:
    """Counts only, long form: (measure, what, value).

    ``meta`` names columns of ``docs`` whose values are counted. Stances are counted
    where ``components`` has a column of that name; a component without one is left out.
    """
    n = F.count(F.lit(1)).cast("double").alias("value")

    def counted(df: DataFrame, measure: str, col: Column) -> DataFrame:
        return df.groupBy(col.alias("what")).agg(n).select(F.lit(measure).alias("measure"), "what", "value")

    chars = docs.agg(
        F.count(F.lit(1)).cast("double").alias("documents"),
        F.bround(F.avg(F.length("text")), 1).alias("mean_chars"),
        F.max(F.length("text")).cast("double").alias("max_chars"),
    ).unpivot([], ["documents", "mean_chars", "max_chars"], "measure", "value")
    label = F.coalesce("ctype", F.lit("untyped"))
    typed = components.agg(F.max(F.col("ctype").isNotNull().cast("int")).cast("double").alias("value"))
    whole = F.lit("*")
    more = [counted(components, "components", whole), counted(relations, "relations", whole)]
    if "stance" in components.columns:
        more.append(counted(components.filter("stance IS NOT NULL"), "stances", F.col("stance")))
    more += [counted(docs, f"meta_{m}", F.coalesce(F.col(m).cast("string"), F.lit("absent"))) for m in meta]
    base = (
        chars.select("measure", whole.alias("what"), "value")
        .unionByName(counted(docs, "by_split", F.col("split")))
        .unionByName(counted(components, "components_by_type", label))
        .unionByName(counted(relations, "relations_by_type", F.col("rtype")))
        .unionByName(typed.select(F.lit("typed_components").alias("measure"), whole.alias("what"), "value"))
    )
    return reduce(DataFrame.unionByName, more, base)


def segments(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut every text at the span bounds and list the spans over each piece, per layer.

    ``spans (doc_id, layer, comp_id, start_off, end_off)``; bounds are clamped to
    the text. Spans travel once, dealt by document; there their bounds are numbered and a span
    is spread over the pieces it covers, which are counted by the bounds inside it.
    """
    size, edge, over = 0, 1, 2
    zero, kind = F.lit(0).cast("bigint"), F.col("kind")
    n = docs.select("doc_id", F.length("text").cast("bigint").alias("n"), F.lit(size).alias("kind"))
    rows = (
        spans.select("doc_id", "layer", "comp_id", "start_off", "end_off", F.lit(over).alias("kind"))
        .unionByName(n, allowMissingColumns=True)
        .filter(F.col("doc_id").isNotNull())
    )
    rows = dealt(rows, spans.count(), "doc_id")
    ahead = W.partitionBy("doc_id").orderBy("kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("sizes", F.collect_list(F.when(kind == size, F.struct("n"))).over(ahead))
    rows = rows.withColumn("of", F.explode(F.when(kind == size, F.array(F.struct("n"))).otherwise(F.col("sizes"))))
    clamped = [F.greatest(zero, F.least(c, "of.n")).alias(name) for c, name in (("start_off", "s"), ("end_off", "e"))]
    bounds = F.when(kind == size, F.array(zero, F.col("n"))).otherwise(F.array("s", "e"))
    placed = (
        rows.select("doc_id", "kind", "layer", "comp_id", "n", *clamped)
        .select("*", F.posexplode(bounds).alias("which", "at"))
        .withColumn("k", F.dense_rank().over(W.partitionBy("doc_id").orderBy("at")))
        # every row names a bound; those of spans come again as themselves
        .withColumn("kind", F.explode(F.when(kind == over, F.array(F.lit(edge), F.lit(over))).otherwise(F.array(F.lit(edge)))))
    )
    own = [F.when(kind == over, F.col(c)).alias(c) for c in ("layer", "comp_id", "s", "e")]
    known = (
        placed.groupBy("doc_id", "kind", F.when(kind == edge, F.col("k")).alias("k"), *own)
        .agg(
            F.max("at").alias("at"),
            F.max(F.when(F.col("which") == 0, F.col("k"))).alias("from_k"),
            F.max(F.when(F.col("which") == 1, F.col("k"))).alias("to_k"),
            F.count_if(F.col("which") == 0).cast("int").alias("times"),
        )
        .filter((kind == edge) | (F.col("to_k") > F.col("from_k")))
    )
    covered = F.when(kind == edge, F.array("k")).otherwise(F.sequence("from_k", F.col("to_k") - 1))
    each = known.select("doc_id", "kind", "layer", "comp_id", "at", "times", F.explode(covered).alias("k"))
    listed = each.groupBy("doc_id", "k").agg(
        F.max(F.when(kind == edge, F.col("at"))).alias("start_off"),
        *[
            F.array_sort(F.flatten(F.collect_list(
                F.when((kind == over) & (F.col("layer") == layer) & F.col("comp_id").isNotNull(), F.array_repeat("comp_id", F.col("times")))
            ))).alias(layer)
            for layer in ("prediction", "gold")
        ],
    )
    until = F.lead("start_off").over(W.partitionBy("doc_id").orderBy("k"))
    return (
        listed.withColumn("end_off", until)
        .filter(F.col("end_off") > F.col("start_off"))
        .select("doc_id", "start_off", "end_off", "prediction", "gold")
    )


def neighbourhood(components: DataFrame, relations: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of every component; isolated ones have none."""

    def degree(end: str, name: str) -> DataFrame:
        return relations.groupBy("doc_id", F.col(end).alias("comp_id")).agg(F.count(F.lit(1)).alias(name))

    out = components.select("doc_id", "comp_id")
    for end, name in (("src", "outgoing"), ("tgt", "incoming")):
        out = out.join(degree(end, name), ["doc_id", "comp_id"], "left")
    return out.fillna(0, ["outgoing", "incoming"]).withColumn(
        "isolated", (F.col("outgoing") == 0) & (F.col("incoming") == 0)
    )


def graph_tally(components: DataFrame, relations: DataFrame) -> DataFrame:
    """Components by type and the number of relations per document."""
    types = components.groupBy("doc_id", F.coalesce("ctype", F.lit("Untyped")).alias("what")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rels = relations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return types.unionByName(rels.select("doc_id", F.lit("Relations").alias("what"), "n"))


def component_by_id(components: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first component of an id in its document, or nulls."""
    first = components.groupBy("doc_id", "comp_id").agg(
        F.min_by(F.struct("idx", "ctype", "start_off", "end_off"), "idx").alias("c")
    )
    return wanted.join(first, ["doc_id", "comp_id"], "left").select("doc_id", "comp_id", "c.*")

"""Argument-graph XML: segments, units, and edges reduced to unit-to-unit relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import blocks, piece_of, strip
from marginalia.session import cut

# ---- fixed values -----------------------------------------------------------------
DIRECT = {"sup": "supports", "exa": "supports", "reb": "attacks"}
JOINER = " "
# -------------------------------------------------------------------------------------

GRAPH = (
    "_id string, _topic_id string, _stance string, "
    "edu array<struct<_id:string,_VALUE:string>>, adu array<struct<_id:string,_type:string>>, "
    "edge array<struct<_id:string,_src:string,_trg:string,_type:string>>"
)


def parse(xml: DataFrame) -> DataFrame:
    """(doc_id, g) of rows ``(doc_id, xml)``; malformed XML fails."""
    return xml.select("doc_id", F.from_xml("xml", GRAPH, {"mode": "FAILFAST"}).alias("g"))


def segment_text(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, segments): segments joined by one space, and where each one lies."""
    empty = F.raise_error(F.concat("doc_id", F.lit(": empty segment")))
    parts = graphs.select("doc_id", F.posexplode("g.edu").alias("pos", "e")).select(
        "doc_id", "pos", F.col("e._id").alias("edu_id"), strip(F.coalesce("e._VALUE", F.lit(""))).alias("part")
    )
    parts = parts.withColumn("part", F.when(F.col("part") == "", empty.cast("string")).otherwise(F.col("part")))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part") + len(JOINER)).over(before), F.lit(0)).cast("bigint")
    segments = parts.withColumn("start_off", start).withColumn(
        "end_off", F.col("start_off") + F.length("part")
    )
    # a text is put together from its own row's segments
    text = F.array_join(F.transform("g.edu", lambda e: strip(F.coalesce(e["_VALUE"], F.lit("")))), JOINER)
    return graphs.select("doc_id", text.alias("text")), segments.drop("part")


def edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("doc_id", F.posexplode("g.edge").alias("pos", "e")).select(
        "doc_id", "pos", F.col("e._id").alias("edge_id"), F.col("e._src").alias("src"),
        F.col("e._trg").alias("trg"), F.col("e._type").alias("etype"),
    )


def unit_spans(edge_rows: DataFrame, segments: DataFrame) -> DataFrame:
    """A unit reaches from its first segment's start to its last one's end."""
    seg = edge_rows.filter("etype = 'seg'").select("doc_id", "edge_id", F.col("src").alias("edu_id"), F.col("trg").alias("adu_id"))
    lost = F.raise_error(F.concat("doc_id", F.lit("/"), "edge_id", F.lit(": unknown segment")))
    met = seg.join(segments, ["doc_id", "edu_id"], "left")
    start = F.when(F.col("start_off").isNull(), lost.cast("bigint")).otherwise(F.col("start_off"))
    return met.groupBy("doc_id", "adu_id").agg(F.min(start).alias("start_off"), F.max("end_off").alias("end_off"))


def components(graphs: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Untyped components; a unit without a segment fails."""
    units = graphs.select("doc_id", F.explode("g.adu").alias("a")).select(
        "doc_id", F.col("a._id").alias("adu_id"), F.col("a._type").alias("role")
    )
    bare = F.raise_error(F.concat("doc_id", F.lit("/"), "adu_id", F.lit(": unit without segment")))
    placed = units.join(spans, ["doc_id", "adu_id"], "left").withColumn(
        "start_off", F.when(F.col("start_off").isNull(), bare.cast("bigint")).otherwise(F.col("start_off"))
    )
    texts = docs.select("doc_id", blocks(F.col("text")).alias("text")).hint("merge")
    return placed.join(texts, "doc_id").select(
        "doc_id", F.col("adu_id").alias("comp_id"), "role", F.lit(None).cast("string").alias("ctype"),
        "start_off", "end_off", piece_of(F.col("text"), F.col("start_off"), F.col("end_off")).alias("text"),
    )


def _doubled(state: DataFrame) -> DataFrame:
    """Follow all open pointers to their ends: each takes over the pointer of the edge it has reached.

    ``state``: ``doc_id, edge_id, to, len, open, most``: ``len`` links lead from ``edge_id`` to ``to``;
    an open pointer may go on. Ways double every round, so the longest chain needs as many rounds
    as its length has binary digits. A way longer than ``most`` goes round in a loop (``looped``).
    """
    state = cut(state.withColumn("looped", F.lit(False)))
    while not state.filter("open").isEmpty():
        reached = state.select("doc_id", *(F.col(c).alias(f"x_{c}") for c in ("edge_id", "to", "len", "open", "looped")))
        way = F.col("len") + F.col("x_len")
        beyond = F.col("x_looped") | (F.col("x_open") & (way > F.col("most")))
        moved = (
            state.filter("open")
            .withColumn("x_edge_id", F.col("to"))
            .join(reached, ["doc_id", "x_edge_id"])
            .select(
                "doc_id", "edge_id", F.col("x_to").alias("to"), way.alias("len"),
                (F.col("x_open") & ~beyond).alias("open"), "most", beyond.alias("looped"),
            )
        )
        state = cut(state.filter("not open").unionByName(moved))
    return state


def _chain_ends(step: DataFrame) -> DataFrame:
    """``doc_id, edge_id, to, len, looped`` per added premise: the first edge of another kind on
    its way and the number of added premises before it.

    On a way into a loop ``len`` counts every edge met once.
    """
    adds = step.filter("etype = 'add'").groupBy("doc_id", "edge_id").agg(F.max_by("trg", "pos").alias("to"))
    adds = cut(adds)
    most = adds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("most"))
    others = adds.select("doc_id", F.col("edge_id").alias("to"), F.lit(True).alias("is_add"))
    first = (
        adds.join(others, ["doc_id", "to"], "left")
        .join(most, "doc_id")
        .select("doc_id", "edge_id", "to", F.lit(1).cast("bigint").alias("len"), F.col("is_add").isNotNull().alias("open"), "most")
    )
    ways = _doubled(first)
    plain = ways.filter("not looped").select("doc_id", "edge_id", "to", "len", "looped")
    looped = ways.filter("looped")
    if looped.isEmpty():
        return plain
    # having gone further than there are edges, ways end anywhere on their loops, and on all of them
    ring = cut(looped.select("doc_id", F.col("to").alias("edge_id")).distinct())
    steps = cut(ring.join(adds, ["doc_id", "edge_id"]).withColumn("low", F.col("edge_id")))
    longest = ring.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    for _ in range(int(longest).bit_length()):
        ahead = steps.select("doc_id", F.col("edge_id").alias("to"), F.col("to").alias("x_to"), F.col("low").alias("x_low"))
        steps = cut(
            steps.join(ahead, ["doc_id", "to"])
            .select("doc_id", "edge_id", F.col("x_to").alias("to"), F.least("low", "x_low").alias("low"))
        )
    around = steps.groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("around"))
    sized = cut(steps.join(around, ["doc_id", "low"]).select("doc_id", "edge_id", "around"))
    on_ring = sized.select("doc_id", "edge_id", F.col("edge_id").alias("to"), F.col("around").alias("len"), F.lit(True).alias("looped"))
    # ways to a loop: as before, with the loop's edges as ends
    tails = looped.select("doc_id", "edge_id", "most").join(ring, ["doc_id", "edge_id"], "left_anti").join(adds, ["doc_id", "edge_id"])
    entry = ring.select("doc_id", F.col("edge_id").alias("to"), F.lit(True).alias("is_ring"))
    into = _doubled(
        tails.join(entry, ["doc_id", "to"], "left")
        .select("doc_id", "edge_id", "to", F.lit(1).cast("bigint").alias("len"), F.col("is_ring").isNull().alias("open"), "most")
    )
    met = into.drop("looped").join(sized.withColumnRenamed("edge_id", "to"), ["doc_id", "to"]).select(
        "doc_id", "edge_id", "to", (F.col("len") + F.col("around")).alias("len"), F.lit(True).alias("looped")
    )
    return plain.unionByName(on_ring).unionByName(met)


def resolve_edges(edge_rows: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, outcomes): every edge reduced to a type and a target unit.

    Support and rebuttal keep their target unit; aimed at an edge they take that
    edge's source, and so does an undercut, as an attack. An added premise takes
    over what the edge it joins resolves to. A chain that meets itself is
    unresolvable. Of edges that share an id the last one counts as the edge to join.
    ``outcomes`` has one row per edge with its result and the number of edges noted
    as unresolvable on its account.
    """
    rows = edge_rows.filter("etype <> 'seg'")
    odd = F.raise_error(F.concat("doc_id", F.lit("/"), "edge_id", F.lit(": unknown edge type ")))
    known = F.col("etype").isin(*DIRECT, "und", "add")
    rows = rows.withColumn("etype", F.when(known, F.col("etype")).otherwise(odd.cast("string")))
    target = edge_rows.select("doc_id", F.col("edge_id").alias("trg"), F.col("src").alias("ref_src"))
    node = units.select("doc_id", F.col("adu_id").alias("trg"), F.lit(True).alias("is_unit")).distinct()
    direct: Column = F.lit(None).cast("string")
    for etype, rtype in DIRECT.items():
        direct = F.when(F.col("etype") == etype, rtype).otherwise(direct)
    rtype = F.when(F.col("etype") == "und", "attacks").otherwise(direct)
    aim = F.when(F.col("is_unit") & (F.col("etype") != "und"), F.col("trg")).otherwise(F.col("ref_src"))
    step = cut(
        rows.join(target, ["doc_id", "trg"], "left")
        .join(node, ["doc_id", "trg"], "left")
        .withColumn("rtype", rtype)
        .withColumn("tgt", F.when(F.col("etype") != "add", aim))
        .select("doc_id", "pos", "edge_id", "src", "trg", "etype", "rtype", "tgt", "ref_src")
    )
    own = ["doc_id", "pos", "edge_id", "src", "etype"]
    settled = [
        step.filter("etype <> 'add'").select(
            *own, "rtype", "tgt", F.when(F.col("tgt").isNull(), 1).otherwise(0).alias("noted")
        )
    ]
    links = step.groupBy("doc_id", F.col("edge_id").alias("to")).agg(
        F.max_by(F.struct("etype", "rtype", "tgt"), "pos").alias("end")
    )
    ends = _chain_ends(step)
    missing = F.col("end").isNull()
    failed = F.col("looped") | missing | F.col("end.tgt").isNull()
    # noted: every edge on the way, and the one the chain failed at where it exists
    noted = F.when(failed, F.col("len") + F.when(~F.col("looped") & missing, 0).otherwise(1)).otherwise(0)
    settled.append(
        step.filter("etype = 'add'").select(*own)
        .join(ends, ["doc_id", "edge_id"])
        .join(links, ["doc_id", "to"], "left")
        .select(
            *own,
            F.when(~failed, F.col("end.rtype")).alias("rtype"),
            F.when(~failed, F.col("end.tgt")).alias("tgt"),
            noted.cast("int").alias("noted"),
        )
    )
    outcomes = reduce(DataFrame.unionByName, settled)
    loops = F.coalesce(F.col("tgt") == F.col("src"), F.lit(False))
    outcomes = outcomes.withColumn("noted", F.when(loops, 1).otherwise(F.col("noted"))).withColumn(
        "kept", F.col("tgt").isNotNull() & ~loops
    )
    relations = outcomes.filter("kept").select(
        "doc_id", "pos", F.col("edge_id").alias("rel_id"), "src", "tgt", "rtype"
    )
    return relations, outcomes


def flattening(outcomes: DataFrame) -> DataFrame:
    """What was lost per document: undercuts, linked premises, unresolvable edges."""
    resolved = F.col("tgt").isNotNull()
    return outcomes.groupBy("doc_id").agg(
        F.count_if((F.col("etype") == "und") & resolved).alias("undercuts_flattened"),
        F.count_if((F.col("etype") == "add") & resolved).alias("linked_premises_flattened"),
        F.sum("noted").cast("bigint").alias("unresolvable_edges"),
    )

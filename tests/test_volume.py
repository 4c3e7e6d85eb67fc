"""What travels between tasks: spans, text and relations once each."""

import tracemalloc

import numpy as np
import pyarrow as pa

from marginalia.functions import text as tx
from marginalia.functions.groups import whole_groups
from marginalia.llm import toxicity
from marginalia.operators import matching as m
from marginalia.operators import resample as rs
from marginalia.operators import scoring as s
from marginalia.operators import shaping as sh
from marginalia.schemas import STANDARD_CRITERIA

SPAN = "doc_id long, idx long, comp_id string, ctype string, start_off long, end_off long"
REL = "doc_id long, idx long, rel_id string, src string, tgt string, rtype string"


def tables(spark):
    text = " ".join(["word"] * 60)
    docs = spark.createDataFrame([(d, text) for d in range(6)], "doc_id long, text string")
    gold = spark.createDataFrame([(d, i, f"T{i}", "Claim", i * 25, i * 25 + 19) for d in range(6) for i in range(9)], SPAN)
    moved = [(0, d, i, f"P{i}", "Claim", i * 25 + 5 * (i % 2), i * 25 + 19) for d in range(6) for i in range(9)]
    pred = spark.createDataFrame(moved, "system_id long, " + SPAN)
    links = [(d, i, f"R{i}", f"T{i}", f"T{i + 1}", "supports") for d in range(6) for i in range(8)]
    made = [(0, d, i, f"Q{i}", f"P{i}", f"P{i + 1}", "supports") for d in range(6) for i in range(8)]
    return docs, gold, pred, spark.createDataFrame(links, REL), spark.createDataFrame(made, "system_id long, " + REL)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_spans_and_text_are_dealt_once(spark):
    docs, gold, pred, _, _ = tables(spark)
    pairs = m.match(docs, gold, pred, [0])
    assert exchanges(pairs) == 1
    found = {(r.criterion, r.n) for r in pairs.groupBy("criterion").agg({"*": "count"}).toDF("criterion", "n").collect()}
    want = {c.label: 30 if c.span == "exact" else 54 for c in STANDARD_CRITERIA}
    assert found == set(want.items())


def test_edges_are_dealt_once(spark):
    docs, gold, pred, gold_rel, pred_rel = tables(spark)
    pairs = spark.createDataFrame(m.match(docs, gold, pred, [0]).toPandas())
    edges = s.edge_matches(pairs, gold_rel, pred_rel)
    assert exchanges(edges) == 1
    assert edges.filter("criterion = 'overlap>=0.5/typed' AND hits = 1").count() == 2 * 48 // 2
    assert edges.filter("criterion LIKE 'exact%'").count() == 0


def test_second_numbers_only_for_large_variances():
    def refuse(i, j):
        raise AssertionError("asked for nothing")

    n, u = np.full((3, 2), 40), np.full((3, 2), 0.5)
    got = rs.binomial(n, np.array([1, 1]), np.array([2, 4]), u, refuse)
    assert got[:, 0].tolist() == [20] * 3 and got[:, 1].tolist() == [10] * 3


def test_segments_deal_spans_once(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "")], "doc_id long, text string")
    rows = [(1, "gold", "T1", 0, 4), (1, "gold", "T1", 0, 4), (1, "prediction", "P1", 2, 99), (2, "gold", "T1", 0, 3)]
    spans = spark.createDataFrame(rows, "doc_id long, layer string, comp_id string, start_off long, end_off long")
    got = sh.segments(docs, spans)
    assert exchanges(got) == 1
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, 2, [], ["T1", "T1"]), (1, 2, 4, ["P1"], ["T1", "T1"]), (1, 4, 10, ["P1"], []),
    ]


def test_regression_holds_few_copies_of_its_entries():
    rng = np.random.default_rng(1)
    n, each, size = 400, 2_000, 1 << 16
    indices = np.concatenate([np.sort(rng.choice(size, each, replace=False)) for _ in range(n)]).astype(np.int32)
    y, ratio = (np.arange(n) % 2).astype(float), rng.normal(0, 0.3, size)
    tracemalloc.start()
    toxicity._regression(y, np.ones(n), indices, np.full(n, each), ratio, toxicity.Settings(bits=16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * n * each


def test_fit_keeps_the_regression_off_the_driver(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3_000)]
    rows = [(i, " ".join(rng.choice(words, 300)) + " vile" * (i % 2), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").cache()
    assert df.count() == 300
    tracemalloc.start()
    model = toxicity.fit(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and peak < 32 << 20  # a few arrays of 2^bits numbers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_and_edges_sort_rows_once(spark):
    docs, gold, pred, gold_rel, pred_rel = tables(spark)
    pairs = m.match(docs, gold, pred, [0])
    before = plan(pairs)
    edges = s.edge_matches(spark.createDataFrame(pairs.toPandas()), gold_rel, pred_rel)
    for made in (before, plan(edges)):
        assert "Window" not in made and made.count("Sort [") == 1, made


def test_token_indexes_of_several_texts(spark):
    words = tx.word_points(spark).value
    for text in ("añb _c2", "", "𝒳 x٣-Ω", "日本 語"):
        got = spark.createDataFrame([(1, text)], "doc_id long, text string")
        offsets = sorted((r.start_off, r.end_off) for r in tx.token_offsets(got).collect())
        made = tx.Texts(["one two", text, "three"], words)
        for at in range(len(text) + 1):
            place = np.array([at])
            assert made.tokens(np.array([1]), place, "lo")[0] == sum(e <= at for _, e in offsets)
            assert made.tokens(np.array([1]), place, "hi")[0] == sum(b < at for b, _ in offsets)


def test_pieces_hold_whole_groups():
    rows = pa.table({"k": ["a"] * 3 + ["b"] * 9 + ["c"] + ["d"] * 2, "i": range(15)})
    found = [(t.column("i").to_pylist(), at.tolist()) for t, at in whole_groups(iter(rows.to_batches(max_chunksize=2)), ["k"])]
    assert [i for some, _ in found for i in some] == list(range(15))
    assert [some[i] for some, at in found for i in at] == [0, 3, 12, 13]


def test_unknown_texts_and_positions_pair_by_what_is_known(spark):
    """Without a text all spans of a document have the same, unknown range; a repeated text counts its spans again."""
    docs = spark.createDataFrame([(1, None), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    gold = [(1, 0, "T1", "Claim", 0, 5), (1, 1, "T2", "Claim", 7, 9), (2, 0, "T1", "Claim", 0, 3), (2, 1, "T2", "Claim", 2, None)]
    pred = [(0, *r[:2], "P", None, *r[4:]) for r in gold] + [(9, *gold[0])]
    criteria = [c for c in STANDARD_CRITERIA if not c.typed]
    got = m.match(docs, spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, "system_id long, " + SPAN), [0], criteria)
    found = {}
    for r in got.collect():
        found.setdefault((r.criterion, r.doc_id), []).append((r.g_idx, r.p_idx))
    pairs = [(0, 0), (1, 1)]
    assert {k: sorted(set(v)) for k, v in found.items()} == {(c.label, d): pairs for c in criteria for d in (1, 2)}
    assert len(found["exact/untyped", 1]) == 2 and len(found["exact/untyped", 2]) > 2

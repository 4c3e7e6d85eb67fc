"""Work on texts grows with their length, is done once, and is shared between tasks."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import align as al
from marginalia.operators import assemble as asm
from marginalia.operators.validate import violations
from marginalia.plans import all_queries
from marginalia.plans.answer_queries import _gold_text

SMALL = "/root/testdata/sf0.001"


def _took(run):
    began = time.perf_counter()
    got = run()
    return got, time.perf_counter() - began


# ---- similarity (F16 F17) ------------------------------------------------------
def _story(seed: int, n: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def _plain_coarse(needle: str, hay: str):
    best = (0.0, None)
    for scale in al.SCALES:
        window = max(al.MIN_WINDOW, int(len(needle) * scale))
        for at in range(0, max(1, len(hay) - window + 1), max(1, window // 4)):
            ratio = SequenceMatcher(None, needle.lower(), hay.lower()[at : at + window]).ratio()
            if ratio > best[0]:
                best = ratio, (at, min(at + window, len(hay)), ratio)
    return best[1] if best[0] > al.MIN_RATIO else None


def test_coarse_search_equals_trying_all_windows():
    for seed in range(6):
        hay = _story(seed, 120)
        words = hay[100 + 10 * seed : 160 + 10 * seed].split()
        needle = " ".join(w for i, w in enumerate(words) if i % 5 != 2)
        assert al.find(needle, hay, refine=False) == _plain_coarse(needle, hay)


def test_few_ratios_are_computed(monkeypatch):
    made = []

    class Counted(SequenceMatcher):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    monkeypatch.setattr(al, "SequenceMatcher", Counted)
    hay = _story(3)
    needle = hay[700:760].replace("e", "x", 3)
    assert al.find(needle, hay, refine=True)[2] > 0.9
    assert len(made) < 40


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert al.Common(a).length(b) == table[-1][-1]
        assert list(al.Common(a).lengths(b)) == table[-1]


def test_aligned_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def jaccard(i):
        seen.add(1)
        return 0.25 * (i % 4)

    at = F.col("id")
    rows = spark.range(20).select(
        F.lit("c").alias("condition"), at.alias("gold_start"), (at + 9).alias("gold_end"),
        (at + at % 3).alias("start_off"), (at + 9).alias("end_off"), jaccard.asNondeterministic()("id").alias("jaccard"),
    )
    got = asm.alignment_error(rows, ["condition"]).collect()
    assert got[0].components == 20 and got[0].start_error_p90 == 2
    assert seen.value == 20


# ---- prefixes (F19) -----------------------------------------------------------------
def test_first_difference_is_linear(spark):
    n = 1_500_000
    pair = spark.range(1).select(F.repeat(F.lit("abc"), n // 3).alias("a"))
    pair = pair.select("a", F.concat(F.expr(f"substr(a, 1, {n - 5})"), F.lit("#b")).alias("b"))
    got, seconds = _took(lambda: pair.select(tx.first_difference(F.col("a"), F.col("b")).alias("d")).first().d)
    assert got == n - 5 and seconds < 20


def test_first_difference_of_short_texts(spark):
    some = ["", "a", "b", "ab", "a" * 127, "a" * 128, "a" * 129, "a" * 128 + "b", "😀" * 130, "😀" * 129 + "x"]
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    for r in pairs.select("a", "b", tx.first_difference(F.col("a"), F.col("b")).alias("d")).collect():
        short = min(len(r.a), len(r.b))
        assert r.d == next((i for i in range(short) if r.a[i] != r.b[i]), short)


# ---- pieces and words (F20-F22 F24-F26 F29-F31 F34 F35) -------------------------------
def test_pieces_of_blocks(spark):
    text = "".join(random.Random(2).choice("ab é😀\n") for _ in range(700))
    spans = [(s, e) for s in (0, 1, 127, 128, 129, 300, 690, 705) for e in (s, s + 1, s + 127, s + 128, s + 300)]
    rows = spark.createDataFrame([(text, s, e) for s, e in spans], "text string, s bigint, e bigint")
    got = rows.select("s", "e", tx.piece_of(tx.blocks(F.col("text")), F.col("s"), F.col("e")).alias("p")).collect()
    assert all(r.p == text[r.s : r.e] for r in got)


def test_words_of_any_space(spark):
    some = ["", " ", "a", " a ", "a b\x85c\t\n d", "　x　"]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", tx.words(F.col("t")).alias("w"))
    assert all(r.w == r.t.split() for r in rows.collect())


def test_spans_of_one_file_are_cut_by_many_tasks(spark):
    assert _gold_text(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_violations_do_not_walk_a_text_per_component(spark):
    n, k = 3_000_000, 6_000
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcde"), n // 5).alias("text"))
    at = F.col("id") * (n // k)
    comps = spark.range(k).select(
        F.lit(0).cast("bigint").alias("doc_id"), F.concat(F.lit("T"), "id").alias("comp_id"), at.alias("start_off"),
        (at + 5).alias("end_off"), F.when(F.col("id") == 7, "x").otherwise("abcde").alias("text"),
    )
    none = spark.createDataFrame([], "doc_id bigint, rel_id string, src string, tgt string")
    got, seconds = _took(violations(docs, comps, none).collect)
    assert [(r.item, r.rule) for r in got] == [("T7", "text mismatch")] and seconds < 30


@pytest.mark.parametrize(
    "name, step",
    [
        ("a3_standoff_components", "collect_list"), ("a3_standoff_relations", "collect_list"),
        ("a4_archive_members", "MapInPandas"), ("a5_arggraph_components", "from_xml"), ("c14_unit_spans", "from_xml"),
    ],
)
def test_what_is_read_more_than_once_is_made_once(spark, name, step):
    made = all_queries()[name](spark, SMALL)
    assert made.count() > 0
    assert step.lower() not in made._jdf.queryExecution().optimizedPlan().toString().lower()

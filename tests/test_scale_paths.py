"""Operators that spread what one task used to hold: totals, places, chains, shingles, resampling."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import cascade as cs
from marginalia.operators import cost, guards, matching, shaping
from marginalia.operators import ranking as rk
from marginalia.operators import resample as rs
from marginalia.sources import arggraph as ag
from marginalia.sources import files, snapshots


# ---- running totals and places -----------------------------------------------
def test_running_total_equals_plain_sum(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(10)) for i in range(500)]
    got = rk.running(spark.createDataFrame(rows, "a int, b int, v bigint").repartition(5), ["a", "b"], F.col("v"), "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.a, r.b)):
        assert r.before == total
        total += r.v
    assert len(got) == 500
    assert rk.positions(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_admission_with_all_calls_in_one_moment(spark):
    n = 400
    calls = spark.range(n).select(
        F.lit("2024-01-01 00:00:30").cast("timestamp").alias("ts"), F.col("id").alias("event_id"), F.lit("m").alias("model"),
        F.lit(0.25).alias("dollars"), F.lit(0.5).alias("projected"),
    )
    got = cost.admission(calls, 50.0).orderBy("event_id").collect()
    assert [r.spent_before for r in got] == [0.25 * i for i in range(n)]
    # 0.25 i + 0.5 > 50 from the 199th on
    assert [r.admitted for r in got] == [i <= 198 for i in range(n)]


def test_carve_and_pick_with_equal_sizes(spark):
    sizes = spark.range(101).select(F.col("id").alias("doc_id"), F.lit(3).cast("bigint").alias("n_components"))
    got = shaping.carve_validation(sizes).collect()
    assert len(got) == 101
    by = {}
    for r in got:
        by.setdefault(r.stratum, []).append(r)
    assert sorted(map(len, by.values())) == [1, 25, 25, 25, 25]
    assert all(sum(r.split == "val" for r in rows) == round(len(rows) * 0.2) for rows in by.values())
    ids = [sorted(r.doc_id for r in by[s]) for s in sorted(by)]
    assert [i for part in ids for i in part] == list(range(101))
    assert shaping.pick_exemplars(sizes).count() == 3


# ---- chains ------------------------------------------------------------------
def edge_table(spark, edges):
    rows = [(d, i, *e) for i, (d, *e) in enumerate(edges)]
    return spark.createDataFrame(rows, "doc_id string, pos int, edge_id string, src string, trg string, etype string")


def resolved(spark, edges, units):
    rel, out = ag.resolve_edges(edge_table(spark, edges), spark.createDataFrame(units, "doc_id string, adu_id string"))
    return {(r.doc_id, r.edge_id): (r.rtype, r.tgt, r.noted, r.kept) for r in out.collect()}


def plain(edges, units):
    """Each chain followed link by link."""
    known, unit = {(d, e): (s, t, k) for d, e, s, t, k in edges}, set(units)
    direct = {"sup": "supports", "exa": "supports", "reb": "attacks", "und": "attacks"}

    def step(d, s, t, k):
        if (d, t) in unit and k != "und":
            return direct[k], t
        hit = known.get((d, t))
        return direct[k], hit[0] if hit else None

    out = {}
    for d, e, s, t, k in edges:
        if k != "add":
            rtype, tgt = step(d, s, t, k)
            noted = int(tgt is None)
        else:
            seen, at, rtype, tgt = [e], t, None, None
            while True:
                hit = known.get((d, at))
                if at in seen or hit is None:
                    noted = len(seen) + (at in seen)
                    break
                if hit[2] != "add":
                    rtype, tgt = step(d, *hit)
                    noted = 0 if tgt is not None else len(seen) + 1
                    rtype = rtype if tgt is not None else None
                    break
                seen.append(at)
                at = hit[1]
        if tgt is not None and tgt == s:
            noted = 1
        out[d, e] = (rtype, tgt, noted, tgt is not None and tgt != s)
    return out


def test_chains_equal_plain_walk(spark):
    rng = random.Random(11)
    edges, units = [], []
    for d in "pqrst":
        units += [(d, f"a{i}") for i in range(4)]
        n = rng.randrange(5, 40)
        for i in range(n):
            kind = rng.choice(["add"] * 6 + ["sup", "und", "reb"])
            trg = rng.choice([f"c{rng.randrange(n)}"] * 6 + [f"a{rng.randrange(4)}", "zz"])
            edges.append((d, f"c{i}", f"a{rng.randrange(4)}", trg, kind))
    # a way into a loop, a loop of its own, an edge that joins itself
    edges += [("u", "c1", "a0", "c2", "add"), ("u", "c2", "a0", "c3", "add"), ("u", "c3", "a0", "c4", "add"), ("u", "c4", "a0", "c2", "add")]
    edges += [("u", "x", "a0", "x", "add"), ("u", "y", "a0", "x", "add"), ("u", "ok", "a0", "a1", "sup"), ("u", "on", "a2", "ok", "add")]
    units += [("u", "a0"), ("u", "a1"), ("u", "a2")]
    assert resolved(spark, edges, units) == plain(edges, units)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, calls = 1000, []
    edges = [("d", "c0", "a1", "a0", "sup")] + [("d", f"c{i}", f"a{i + 1}", f"c{i - 1}", "add") for i in range(1, n + 1)]
    units = [("d", f"a{i}") for i in range(n + 2)]
    cut = ag.cut
    monkeypatch.setattr(ag, "cut", lambda df: calls.append(1) or cut(df))
    got = resolved(spark, edges, units)
    assert all(got["d", f"c{i}"] == ("supports", "a0", 0, True) for i in range(n + 1))
    assert len(calls) <= 2 + 1 + 11  # edges, added premises, the first state, rounds


# ---- shingles ----------------------------------------------------------------
def test_contamination_by_either_way(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    texts.append((99, " ".join(texts[0][1].split() * 3)))
    protected = [(0, " ".join(texts[0][1].split()[5:40])), (1, texts[7][1].upper()), (2, "short")]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    held = set().union(*(grams(t) for _, t in protected))
    want = {i: len(grams(t) & held) for i, t in texts if grams(t) & held}
    a = guards.shingles(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id")
    b = guards.shingles(spark.createDataFrame(protected, "item_id int, text string"), "item_id")
    for limit, bits in ((10**6, 1 << 30), (3, 1 << 30), (3, 1)):
        monkeypatch.setattr(guards, "HELD_SHINGLES", limit)
        monkeypatch.setattr(guards, "FILTER_BITS", bits)
        assert {r.doc_id: r.shared for r in guards.contamination(a, "doc_id", b).collect()} == want


# ---- resampling --------------------------------------------------------------
def test_binomial_draws_have_the_right_moments():
    it = np.arange(40_000)
    sizes = np.array([5, 1, 40, 300, 2, 7, 90, 1, 0, 3])
    drawn = rs.split(sizes, np.full(len(it), sizes.sum()), 0, 0, it, 0)
    n = sizes.sum()
    assert (drawn.sum(axis=1) == n).all() and (drawn >= 0).all()
    spread = np.sqrt(n * sizes / n * (1 - sizes / n))
    assert (np.abs(drawn.mean(axis=0) - sizes) <= 5 * spread / 200 + 1e-12).all()
    assert np.allclose(drawn.var(axis=0), spread**2, rtol=0.05)
    want = -np.sqrt(300 * 90 / ((n - 300) * (n - 90)))
    assert np.corrcoef(drawn[:, 3], drawn[:, 6])[0, 1] == pytest.approx(want, abs=0.02)


def test_buckets_and_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("u", i, rng.randrange(9), rng.randrange(9), rng.randrange(4)) for i in range(400)]
    counts = spark.createDataFrame(rows, "unit string, doc_id int, tp bigint, fp bigint, fn bigint")

    def sums():
        return sorted(map(tuple, rs._splits(counts, ["unit"], rs.ONE, 60, 3).collect()))

    want = sums()
    assert len(want) == 60
    monkeypatch.setattr(rs, "BUCKET_HEIGHT", 4)
    monkeypatch.setattr(rs, "CHUNK", 7)
    assert sums() == want


# ---- cascade -----------------------------------------------------------------
def test_operating_points(spark):
    cols = ", ".join(f"{leg}_{k}_{c} bigint" for leg in "ab" for k in cs.KINDS for c in cs.COUNTS)
    rows = [(1, -0.5, *([1, 0, 0] * 2), *([3, 0, 0] * 2)), (2, -0.1, *([1, 1, 1] * 2), *([2, 0, 0] * 2)), (3, None, *([0, 1, 1] * 2), *([1, 0, 0] * 2))]
    docs = spark.createDataFrame(rows, f"doc_id int, conf double, {cols}")
    got = {r.point: r for r in cs.operating_points(docs, F.lit(-0.3), F.lit(0.001), F.lit(0.01)).collect()}
    assert [got[p].escalated for p in ("first_only", "cascade", "second_only")] == [1, 2, 3]
    assert got["second_only"].component_f1 == 1.0 and got["cascade"].component_f1 == pytest.approx(10 / 12)
    assert got["cascade"].usd_per_1k == pytest.approx((3 * 0.001 + 2 * 0.01) / 3 * 1000)
    assert got["cascade"].threshold == -0.3 and got["first_only"].threshold is None


def test_criterion_of_an_untyped_corpus(spark):
    gold = spark.createDataFrame([("a", None), ("b", "Claim")], "doc_id string, ctype string")
    pick = lambda df: spark.range(1).select(cs.criterion_for(df, "t", "u").alias("c")).first().c
    assert pick(gold) == "t" and pick(gold.filter("doc_id = 'a'")) == "u" and pick(gold.limit(0)) == "u"


# ---- files -------------------------------------------------------------------
def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    schema = "system string, prompt_version string, doc_id bigint, comp_id string"

    def write(*rows):
        return snapshots.commit(spark.createDataFrame(list(rows), schema), folder)

    assert write(("a", "v1", 1, "x"), ("b", "v1", 1, "y")) == 1
    assert write(("a", "v1", 2, "z")) == 2
    kind = spark.createDataFrame([], schema).schema
    newest = {(r.system, r.doc_id, r.version) for r in snapshots.latest(spark, folder, kind).collect()}
    assert newest == {("a", 2, 2), ("b", 1, 1)}
    assert snapshots.history(spark, folder, kind).count() == 3
    assert {r.comp_id for r in snapshots.history(spark, folder, kind, system="a").collect()} == {"x", "z"}
    assert snapshots.latest(spark, str(tmp_path / "none"), kind).count() == 0
    # a write without a manifest is not seen
    spark.createDataFrame([(9, "q")], "doc_id bigint, comp_id string").write.json(f"{folder}/data/00000003-x/system=a/prompt_version=v1")
    assert snapshots.history(spark, folder, kind).count() == 3


def test_one_split_of_one_corpus(spark, tmp_path):
    rows = [(i, "ab"[i % 2], ("train", "val")[i % 3 == 0]) for i in range(12)]
    path = str(tmp_path / "docs")
    files.write_corpora(spark.createDataFrame(rows, "doc_id int, corpus string, split string"), path)
    mine = files.read_split(spark, path, "val", "a")
    assert {r.doc_id for r in mine.collect()} == {0, 6}
    plan = mine._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [x for x in plan.splitlines() if x.startswith("PartitionFilters")]
    assert filters and "corpus" in filters[0] and "split" in filters[0]
    with pytest.raises(FileNotFoundError, match="no corpus zz"):
        files.read_split(spark, path, "val", "zz")


def _first_fit(left, right):
    """Pairs of one document as written down: left in order, each with the first free right span."""
    used, out = set(), []
    for a, (lo, hi) in enumerate(left):
        for b, (x, y) in enumerate(right):
            shared = min(hi, y) - max(lo, x)
            if b not in used and shared > 0 and shared / (max(hi, y) - min(lo, x)) >= 0.5:
                used.add(b)
                out.append((a, b))
                break
    return out


def test_agreement_rounds(spark):
    """First fit in rounds gives the pairs of a plain loop: crowded spans, chains, repeats, empty sides."""
    rng = random.Random(3)
    crowd = [[(lo, lo + rng.randint(20, 60)) for lo in (rng.randint(0, 900) for _ in range(350))] for _ in range(2)]
    stairs = [[(10 * i, 10 * i + 30) for i in range(12)], [(10 * i + 5, 10 * i + 35) for i in range(12)]]
    same = [[(5, 9)] * 6, [(5, 9)] * 4]
    texts = {1: crowd, 2: stairs, 3: same, 4: [[(0, 5)], []], 5: [[(7, 7)], [(7, 7)]]}
    schema = "doc_id int, idx int, comp_id string, start_off int, end_off int"

    def side(k):
        rows = [(d, i, f"{'ab'[k]}{i}", *s) for d, both in texts.items() for i, s in enumerate(both[k])]
        return spark.createDataFrame([*rows, (None, 0, "x", 0, 5), (6, 0, "y", None, 5)], schema)

    pairs = matching.agreement(side(0), side(1))
    got = sorted((r.doc_id, r.l_idx, r.r_idx) for r in pairs.collect())
    assert got == sorted((d, *p) for d, both in texts.items() for p in _first_fit(*both))
    rates = {r.doc_id: r for r in matching.agreement_rate(pairs, side(0), side(1)).collect()}
    assert (rates[3].n_left, rates[3].n_right, rates[3].n_paired, rates[3].rate) == (6, 4, 4, 0.8)
    assert rates[4].rate == 0
    assert matching.agreement(side(0).limit(0), side(1)).isEmpty()


def test_long_strings_of_deep_documents(spark):
    """All levels come from one plan: a document nested 200 deep, brackets inside strings, broken JSON."""
    long = "one two three four five six seven eight nine"
    deep = '{"a":[' * 100 + f'"{long}"' + "]}" * 100
    tricky = '{"k": "' + "[{" * 40 + f' \\" {long}", "note": "{long}", "m": [1, null, ["{long} ten"]]}}'
    rows = [(1, deep), (2, tricky), (3, "[" * 500), (4, None), (5, f'"{long}"'), (6, "{}")]
    got = guards.long_strings(spark.createDataFrame(rows, "doc_id int, body string"), "doc_id", "body").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 9), (2, "k", 11), (2, "m", 10), (5, "<root>", 9)]
    assert guards.long_strings(spark.createDataFrame([], "doc_id int, body string"), "doc_id", "body").isEmpty()


def test_checksum_audit(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    found = files.checksums(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).drop("path")
    right = {n: hashlib.sha256(n.encode()).hexdigest() for n in "abcd"}
    expected = spark.createDataFrame([("a", right["a"]), ("b", right["a"]), ("d", right["d"])], "name string, sha256 string")
    got = {r.name: r.status for r in files.audit_checksums(found, expected).collect()}
    assert got == {"a": "ok", "b": "differs", "c": "unexpected", "d": "missing"}


def test_scores_of_a_split_are_those_of_all_documents(spark, tmp_path):
    from marginalia.plans.scoring_queries import OVERLAP_TYPED, scores

    rows = [(i, f"ein Wort {i} und mehr " * (i % 9), "de", "s", len(f"ein Wort {i} und mehr " * (i % 9))) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    every = scores(spark, str(tmp_path), [OVERLAP_TYPED]).filter("doc_id % 5 in (0, 1)")
    some = scores(spark, str(tmp_path), [OVERLAP_TYPED], ["val", "test"])
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, some.collect()))


def test_choice_by_place_is_the_choice_of_the_whole_document(spark):
    import random

    from pyspark.sql import functions as F

    from marginalia.operators import matching as m

    rng = random.Random(3)
    names = ", ".join(f"{n} long" for n in ("g_idx", "p_idx", "g_id", "p_id", "g_type", "p_type"))
    rows = []
    for unit in range(40):
        # in half of the units an index stands for spans of several places
        step = 3 if unit % 2 else 1
        places = []
        for at in range(5):
            items = {(rng.random(), at * step + rng.randrange(3), at * step + rng.randrange(3), 0, 0, 0, 0) for _ in range(4)}
            places.append((sorted(items),))
        rows.append((unit, places))
    df = spark.createDataFrame(rows, f"unit int, places array<struct<items: array<struct<o: double, {names}>>>>")
    whole = m._taken(F.array_sort(F.flatten(F.col("places.items"))))
    got = df.select(F.array_sort(m._taken_by_place(F.col("places"))).alias("a"), F.array_sort(whole).alias("b")).collect()
    assert len(got) == 40 and all(r["a"] == r["b"] for r in got)


def test_draws_of_one_unit_are_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from marginalia.operators import resample as rs

    counts = spark.range(60).selectExpr("'k' as k", "id as doc_id", "id % 7 as tp", "id % 3 as fp", "id % 5 as fn")
    drawn = rs._splits(counts, ["k"], rs.ONE, 5_000, 0)
    assert drawn.agg(F.count(F.lit(1))).first()[0] == 5_000
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan

"""Nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marginalia.llm import ann, bpe, hmm, jaccard, packing, pii, repetition, secrets, toxicity, urls
from marginalia.llm.queries import URL_RULES, listed_hosts, vocabulary

LONG = "alpha beta gamma delta " * 40_000
RUN = "a" * 300_000
ROWS = [
    (1, "One short text with a mail to ann.b@example.org and more."),
    (1, "One short text with a mail to ann.b@example.org and more."),
    (2, None),
    (3, ""),
    (None, "A row without an id, card 4111 1111 1111 1111 and 10.0.0.1."),
    (4, LONG),
    (5, RUN),
    (6, "  \n\t "),
    (7, "password = hunter22xyz"),
]
# every operator must cope with columns named like its own
CLASH = "score ids decoded kept spans found base host path cid n component_id row_no word block".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


def test_hmm(docs, none):
    rows = docs.withColumn("held_out", F.col("doc_id") == 7)
    got = hmm.score(rows).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got["score"]).all()
    by = got.set_index("doc_id")
    assert by.loc[2, "n_tokens"] == by.loc[3, "n_tokens"] == by.loc[6, "n_tokens"] == 1
    assert by.loc[4, "n_tokens"] == 160_001
    assert hmm.score(none.withColumn("held_out", F.lit(False))).count() == 0
    untaught = hmm.score(docs.withColumn("held_out", F.lit(True))).toPandas()
    assert (untaught["train_tokens"] == 0).all() and np.isfinite(untaught["score"]).all()


def test_hmm_forward_matches_plain_recursion():
    rng = np.random.default_rng(1)
    k, c = 3, 11
    move, emit, start = rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T, rng.dirichlet(np.ones(k))
    lengths = np.array([4, 1, 9, 4, 30])
    seq = rng.integers(0, c, lengths.sum())
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    got = hmm.log_likelihoods(hmm.Model(start, move, emit), seq, begin, lengths)
    for b, n, g in zip(begin, lengths, got):
        a = start * emit[seq[b]]
        for x in seq[b + 1 : b + n]:
            a = (a @ move) * emit[x]
        assert np.isclose(np.log(a.sum()), g)


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(2)
    s = hmm.Settings(states=2, classes=8)
    lengths = np.full(40, 25)
    seq = np.concatenate([np.where(rng.random(25) < 0.9, i % 2 * 4, rng.integers(0, 8, 25)) for i in range(40)])
    begin = np.arange(40) * 25
    emit = rng.dirichlet(np.ones(8), 2).T
    model = hmm.Model(np.full(2, 0.5), np.array([[0.8, 0.2], [0.2, 0.8]]), emit)
    before = -np.inf
    for _ in range(5):
        counts = hmm.expected_counts(model, seq, begin, lengths)
        assert counts[-1] >= before - 1e-9
        assert np.isclose(counts[-1], hmm.log_likelihoods(model, seq, begin, lengths).sum())
        before = counts[-1]
        heads, moves, spent = counts[:2], counts[2:6].reshape(2, 2), counts[6:-1].reshape(8, 2)
        model = hmm.Model(heads / heads.sum(), moves / moves.sum(1, keepdims=True), spent / spent.sum(0))
    assert s.states == 2


def brute_components(rows, words, num, den):
    import re

    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [rows[find(i)][0] for i in range(len(rows))]


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_against_brute_force(spark, words, num):
    rng = np.random.default_rng(num)
    vocabulary_ = [f"w{i}" for i in range(400)]
    shared = list(rng.choice(vocabulary_, 40))
    rows = []
    for family in range(12):
        text = list(rng.choice(vocabulary_, rng.integers(3, 120)))
        if family % 3 == 0:
            text += shared
        for _ in range(rng.integers(1, 14)):
            copy = list(text)
            for _ in range(rng.integers(0, 6)):
                copy[rng.integers(0, len(copy))] = f"x{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.join(df, jaccard.Settings(words=words, num=num)).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows, words, num, 100)
    assert 1 < len(set(got.values())) < len(rows)


def test_jaccard_edges(docs, none):
    got = jaccard.join(docs).toPandas()
    assert len(got) == len(ROWS)
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert set(by.loc[1, "component_id"]) == {1} and by.loc[2, "component_id"] == 2 and by.loc[6, "n_shingles"] == 0
    assert by.loc[4, "n_shingles"] == 4
    assert got[got["doc_id"].isna()]["component_id"].isna().all()
    assert jaccard.join(none).count() == 0


def test_toxicity(spark, docs, none):
    good = [(i, f"kind words about gardens number {i} and rivers", 0) for i in range(30)]
    bad = [(100 + i, f"you worthless moron number {i} of the rivers", 1) for i in range(15)]
    odd = [(500, "no label", None), (501, None, 0)]
    rows = spark.createDataFrame(good + bad + odd, "doc_id long, text string, label int")
    model = toxicity.fit(rows)
    got = toxicity.score(docs, model)
    assert got.count() == len(ROWS) and got.filter("score is null or score < 0 or score > 1").isEmpty()
    tried = spark.createDataFrame([(1, "such a moron, worthless"), (2, "kind gardens and rivers")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(tried, model).collect()}
    assert scores[1] > 0.5 > scores[2]
    assert toxicity.score(none, model).count() == 0
    one_kind = toxicity.fit(rows.filter("label = 0"))
    assert toxicity.score(docs, one_kind).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score(docs, toxicity.fit(rows.limit(0))).count() == len(ROWS)


def test_secrets(spark, docs, none):
    got = secrets.find(docs.select("doc_id", "text", "base"))
    assert got.count() == len(ROWS)
    assert got.filter("doc_id = 7").select(secrets.joined(F.col("spans"))).first()[0] == "assign:0:22"
    assert secrets.find(none).count() == 0


def test_secrets_finds_random_strings(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(letters, 40)) for _ in range(20)]
    words = ["donaudampfschifffahrtsgesellschaft", "some-long-page-name-about-trains", "abcdefghijklmnopqrstuvwxyzabcdef", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(i, f"é key {k} end") for i, k in enumerate(keys)] + [(100 + i, f"é key {w} end") for i, w in enumerate(words * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.find(df).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    hits = [got[i] == "random:6:46" for i in range(20)]
    assert sum(hits) >= 18
    assert not any("random" in got[100 + i] for i in range(20))


def test_running_sums(spark):
    values = list(range(1, 200))
    row = spark.createDataFrame([(values,), ([],)], "v array<int>").select(secrets.running(F.col("v")).alias("r")).collect()
    assert row[0].r == [sum(values[:i]) for i in range(len(values))] and row[1].r == []


def test_packing(docs, none):
    got = packing.pack_documents(docs, vocabulary(), 1, digest=False).toPandas()
    assert set(got["doc_tokens"]) >= {1} and (got["length"] > 0).all()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() <= 2048
    whole = got[got["doc_id"] == 1].sort_values("start")["length"].sum()
    assert whole == 2 * got[got["doc_id"] == 1]["doc_tokens"].iloc[0]
    assert packing.pack_documents(none, vocabulary(), 1).count() == 0


def test_packing_keeps_every_limit(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 900)), int(rng.integers(0, 300))) for i in range(3000)] + [(-1, None, None), (-2, 9000, 8000)]
    limits = packing.Limits(tokens=512, segments=5, loss_tokens=300, pool=64)
    got = packing.pack(spark.createDataFrame(rows, "key long, tokens long, first_loss long").repartition(2), limits).toPandas()
    first = {k: (t or 0, f or 0) for k, t, f in rows}
    for key, part in got.sort_values("start").groupby("key"):
        assert part["start"].tolist() == [0, *np.cumsum(part["length"])[:-1]]
        assert part["length"].sum() == first[key][0]
    got["loss"] = [max(0, s + n - max(s, first[k][1])) for k, s, n in zip(got["key"], got["start"], got["length"])]
    by = got.groupby("sequence_id")
    assert by["length"].sum().max() <= 512 and by.size().max() <= 5 and by["loss"].sum().max() <= 300
    assert set(got["key"]) == {k for k, (t, _) in first.items() if t}


def test_ann(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, []), (None, [1.0] * 8), (2080, [1.0, None] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("entry", F.lit(0))
    got = ann.search(df.unionByName(df.limit(5)), F.col("vec_id") % 20 == 0).toPandas()
    good = {i: np.array(v) for i, v in rows[:360]}
    asked = [i for i in good if i % 20 == 0]
    assert sorted(set(got["query_id"])) == asked
    hits = 0
    for q, part in got.groupby("query_id"):
        want = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        hits += len({i for _, i in want} & set(part["vec_id"]))
    assert hits >= 0.9 * 20 * len(asked)
    assert ann.search(df.filter("vec_id = -5"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_ann_recall_with_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.7 * rng.normal(size=(20_000, 64))
    x *= np.exp(0.5 * rng.normal(size=len(x)))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 100 / np.linalg.norm(x[7])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "vector": x.tolist()}))
    got = ann.search(df, F.col("vec_id") % 200 == 0).toPandas()
    assert got["query_id"].nunique() == 100
    hits = 0
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(part["vec_id"]))
    assert hits >= 0.9 * 20 * 100


def test_ann_ties_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, float(i), 0.0]) for i in range(1, 301)] + [(1000, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").orderBy(F.desc("vec_id"))
    got = ann.search(df, F.col("vec_id") == 1000).orderBy("rank").toPandas()
    assert got["vec_id"].tolist() == list(range(1, 21)) and set(got["score"]) == {1.0}


def test_pii(spark, docs, none):
    got = pii.find(docs)
    assert got.count() == len(ROWS)
    spans = {r[0]: r[1] for r in got.select("doc_id", pii.joined(F.col("spans"))).collect()}
    assert spans[1] == "email:30:47" and spans[2] == spans[3] == "" and "card:" in spans[None] and "ip:" in spans[None]
    shown = got.filter("doc_id is null").select(pii.masked(F.col("text"), F.col("spans"))).first()[0]
    assert shown == "A row without an id, card [CARD] and [IP]."
    assert pii.find(none).count() == 0


def test_pii_discovers_identifiers_by_context(spark):
    seeds = [(i, f"please write to member address user{i}@example.org today") for i in range(10)]
    more = [(100 + i, f"please write to member address user{i}-at-box today") for i in range(3)]
    other = [(200 + i, f"the lot number{i} 77{i}45678 went out") for i in range(10)]
    rows = spark.createDataFrame(seeds + more + other, "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find(rows).select("doc_id", pii.joined(F.col("spans"))).collect()}
    assert got[100] == "id:31:43" and got[0].startswith("email:31:") and not any(got[200 + i] for i in range(10))


def test_bpe(docs, none):
    got = bpe.digests(docs, vocabulary()).toPandas()
    assert len(got) == len(ROWS) and set(got[got["doc_id"].isin([2, 3])]["n_tokens"]) == {0}
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary()), vocabulary())
    assert back.filter("decoded <> coalesce(text, '')").isEmpty() and back.count() == len(ROWS)
    assert bpe.digests(none, vocabulary()).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://www.example.com/en/a"), (2, "http://EXAMPLE.com/en/"), (3, "http://x.net/es/1?q#f"), (4, None), (5, ""),
        (6, "no scheme"), (7, "http://spam-farm.org/x"), (8, "http://example.com"), (9, "ftp://a.b.com/" + "d/" * 2000),
        (10, "http://x.net/fr"), (1, "http://www.example.com/en/a"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "rule", "key")})
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, URL_RULES, listed_hosts).collect()}
    assert got == {
        1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("net/es/", "block"), 4: (None, "allow"),
        5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow"), 9: ("com/", "allow"), 10: (None, "allow"),
    }
    assert urls.judge(pages.limit(0), URL_RULES, listed_hosts).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urls.build(listed, universe)
    got = universe.filter(cascade.contains(F.col("key")))
    assert got.count() == listed.count() and got.exceptAll(listed).isEmpty() and len(cascade.levels) > 2


def test_repetition(docs, none):
    got = repetition.judge(docs).toPandas()
    assert len(got) == len(ROWS)
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert by.loc[2, "n_words"] == by.loc[3, "n_words"] == 0 and not by.loc[4, "kept"] and by.loc[4, "longest_repeat"] == 159_996
    assert by.loc[5, "n_words"] == 1
    assert repetition.judge(none).count() == 0


def test_maximal_repeats():
    words = b"a b c d e f x a b c d e f y".split()
    assert repetition.maximal_spans(words, 3) == [(0, 6), (7, 13)]


def test_pipeline_stages(spark, tmp_path):
    words = [f"word{i}" for i in range(300)]
    rng = np.random.default_rng(6)
    clean = [" ".join(rng.choice(words, 60)) for _ in range(20)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s", 1), (101, clean[1] + " tail", "en", "s", 1), (102, "again and again " * 50, None, None, None)]
    rows += [(103, " ".join(rng.choice(words, 40)) + " write me@example.org", "en", "s", 1), (104, None, "en", "s", 0), (104, None, "en", "s", 0)]
    rows += [(200 + i, " ".join(rng.choice(words, 40)) + " moron idiot scum", "en", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i >= 200)) for i in [*range(20), *range(200, 208)]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == cp.COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not any(i >= 200 for i in kept["toxicity"]) and set(range(20)) <= kept["toxicity"]
    assert 102 not in kept["quality rules"] and set(range(20)) <= kept["quality rules"]
    assert not {100, 101} & kept["n-gram jaccard join"] and set(range(20)) <= kept["n-gram jaccard join"]
    assert "[EMAIL]" in docs.filter("doc_id = 103").first().text
    whole = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == kept["pii"]


def test_near_copies_of_rows_that_share_an_id(spark):
    words = [f"word{i}" for i in range(300)]
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(rng.choice(words, 60)) for _ in range(4))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, d), (3, d), (4, b + " tail"), (5, "short"), (5, "brief"), (5, "brief"), (6, None), (6, None), (None, a)]
    rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [(1, a), (2, b), (3, c), (3, d), (5, "brief"), (5, "short"), (6, None), (6, None), (None, a)]  # a short text is one shingle
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_special_tokens(spark):
    """Texts with thousands of special tokens, as crawled training text has them."""
    mark = "<|endoftext|>"
    docs = spark.createDataFrame([(1, mark * 100_000), (2, f"a {mark} b{mark}"), (3, f"{mark}x" * 20_000)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).toPandas().set_index("doc_id")
    assert (got["decoded"] == got["text"]).all()
    assert len(got.loc[1, "ids"]) == 100_000 and set(got.loc[1, "ids"]) == {50256}
    packed = packing.pack_documents(docs, vocabulary(), 1, digest=False).toPandas().sort_values(["doc_id", "start"])
    for i, pieces in packed.groupby("doc_id"):
        assert [*np.concatenate(list(pieces["ids"]))] == [*got.loc[i, "ids"], 1]


def test_toxicity_plain(spark):
    """The same scores as dense ratios and plain Newton steps over every feature, repeats and all."""
    texts = [("you utter fool", 1), ("you utter fool", 1), ("fool of a clown", 1), ("a fool and a clown", 1)]
    texts += [("the rivers are high", 0), ("gardens and rivers", 0), ("a clown in the gardens", 0), ("", 0), (None, 0)]
    rows = spark.createDataFrame([(i % 7, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    s = toxicity.Settings()
    grams = [{f" {t} "[i : i + n] for n in s.orders for i in range(len(t) + 3 - n)} if t else set() for t, _ in texts]
    names = sorted(set().union(*grams))
    x = np.array([[g in own for g in names] for own in grams], float)
    y = np.array([label for _, label in texts], float)
    extra = 2 * s.smoothing * np.array([(y == 0).mean(), (y == 1).mean()])
    share = [(x[y == k].sum(0) + extra[k]) / (y == k).sum() for k in (0, 1)]
    x = np.c_[x * np.log(share[1] / share[0]), np.ones(len(y))]
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    weight /= weight.mean()
    ridge = np.r_[np.full(len(names), s.ridge), 0]
    theta = np.zeros(len(names) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
        theta -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + ridge * theta)
    want = 1 / (1 + np.exp(-x @ theta))
    model = toxicity.fit(rows)
    tried = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(tried, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=2e-3)


def test_secrets_in_very_long_strings(spark):
    """A megabyte of base64 is one candidate; its test takes time in proportion, whatever ends it."""
    rng = np.random.default_rng(5)
    al = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    body = "".join(rng.choice(al, 1_000_000))
    rows = spark.createDataFrame([(1, f"x {body} y"), (2, f"x {'z' * 400_000}+- y")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.find(rows).collect()}
    assert got == {1: [(2, 1_000_002)], 2: []}


def test_pieces_merged_in_rounds_are_those_of_the_index():
    import random

    import public_tokenizers

    from marginalia.llm import bpe

    coder = bpe.PairIndexEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    words = ["a" * n for n in (1, 2, 3, 7, 63, 64, 65, 300)] + [" the", "ä" * 31, "=" * 40, "-" * 64]
    words += ["".join(rng.choice("etaoin sh0ä=é") for _ in range(rng.randrange(1, 90))) for _ in range(500)]
    raw = [w.encode() for w in words]
    expected = coder._merge_index(raw)
    assert coder._merge_rounds(raw) == expected
    assert coder.merge_pieces(words) == expected
    assert coder.merge_pieces([]) == [] and coder.merge_pieces(words[-1:]) == expected[-1:]


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np

    from marginalia.llm import jaccard

    rng = np.random.default_rng(4)
    for n in (1, 20, 300):
        a = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
        for new in (0, n // 10, n):
            b = np.r_[a[new:], rng.integers(0, 2**64, new, np.uint64, endpoint=False)]
            x, y = (jaccard.mark(v, 256).view(np.uint64) for v in (a, b))
            apart = int(np.bitwise_count(x ^ y).sum())
            assert apart <= 2 * new and (apart > 0) == (new > 0)


def test_pairs_are_ruled_out_by_marks_where_they_meet(spark):
    from marginalia.llm import jaccard

    s = jaccard.Settings()
    cols = ["a", "b", "a_n", "b_n", "a_shared", "b_shared", "a_pos", "b_pos", "pivot"]
    names = [*cols, *(f"{x}_{m}" for x in "ab" for m in s.marks)]
    zero, far = [0] * len(s.marks), [-1] * len(s.marks)
    rows = [[1, 2, 100, 100, 1, 1, 1, 1, 1, *zero, *zero], [1, 3, 100, 100, 1, 1, 1, 1, 1, *zero, *far]]
    met = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    assert [(r["a"], r["b"]) for r in jaccard._likely(met, s).collect()] == [(1, 2)]


def test_similar_sets_share_a_part():
    rng = np.random.default_rng(6)
    for num in (60, 80, 90):
        s = jaccard.Settings(num=num)
        for n in (2, 9, 10, 37, 250, 3_000):
            most = n * (100 - num) // num  # more than a similar larger set may have on top
            for extra in {0, most // 2, most}:
                a = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
                b = np.r_[a, rng.integers(0, 2**64, extra, np.uint64, endpoint=False)]
                found = [
                    {int(p) for low, h in jaccard.ranges(len(x), s) if h for p in jaccard.parts(np.sort(x), low, h)} for x in (a, b)
                ]
                assert extra == 0 or found[0] & found[1]


def test_common_shingles_alone_make_no_index_entries(spark):
    """Texts that share a passage and word pairs met among themselves by every common shingle."""
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"w{k}" for k in rng.integers(0, 6, 120))) for i in range(300)]
    rows += [(1000, rows[0][1] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = jaccard._index(df, jaccard.Settings()).groupBy("token").count().toPandas()["count"]
    # some 4,000 parts in all; every text has the passage and half of the word triples
    assert 5 <= len(held) < 200 and held.max() < 15, (len(held), held.max())
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert got[1000] == 0 and len(set(got.values())) == 300


def test_blocks_of_a_large_cluster_give_the_same_components(spark):
    """Every set is compared with all others of its cluster, however many blocks that has."""
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in rng.integers(0, 10**6, 150)], []
    for i in range(120):
        copy = list(base)
        for at in rng.integers(0, len(base), rng.integers(0, 14)):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df, jaccard.Settings(words=3, num=80, block=2_000)).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows, 3, 80, 100)
    assert 5 < len(set(got.values())) < 115


def test_unlike_texts_that_share_parts_make_no_rows_of_pairs(spark, monkeypatch):
    """Long texts with a half in common meet in many parts, and their marks rule out none of their pairs."""
    rng = np.random.default_rng(9)
    written, cut = [], jaccard.cut

    def counted(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(jaccard, "cut", counted)
    half = " ".join(f"p{i}" for i in range(1_000))
    rows = [(i, half + " " + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 700))) for i in range(100)]
    df = spark.createDataFrame([*rows, (100, rows[7][1] + " end")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df, jaccard.Settings(words=5, num=80)).collect()}
    assert got[100] == 7 and len(set(got.values())) == 100
    pairs = [t.count() for t in written if t.columns[:2] == ["a", "b"]]
    assert max(pairs) < 300, pairs


def test_leaves_name_only_what_reaches_a_known_place():
    """Each visited leaf named as many vectors as a result holds, however far from the query's nearest."""
    dots = np.array([[5.0, 1.0, 4.0, 4.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0]])
    slack, low = np.zeros(2), np.full(2, -np.inf)
    a, b = ann.leaders(dots, slack, low, 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4)]
    a, b = ann.leaders(dots, slack, np.array([4.5, 9.0]), 3)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0)]
    assert len(ann.leaders(dots, slack, low, 9)[0]) == 10

"""Every query against a plain brute-force version on whole small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from marginalia.llm import pii, queries
from marginalia.llm import repetition as rep

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).toPandas()


def by_doc(df, docs):
    assert sorted(df["doc_id"]) == sorted(docs["doc_id"])
    return df.set_index("doc_id").loc[docs["doc_id"]]


def test_op1(spark, docs):
    got = by_doc(run(spark, "op1_hmm_language_model"), docs)
    tokens = [[*WORD.findall(lowered(t)), None] for t in docs["text"]]
    held = [fold(i, 7) == 2 for i in docs["doc_id"]]
    count = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    assert list(got["held_out"]) == held
    assert list(got["n_tokens"]) == [len(w) for w in tokens]
    assert list(got["n_known"]) == [sum(count[w] > 0 for w in ws) for ws in tokens]
    assert set(got["train_tokens"]) == {n}
    base = [sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws) for ws in tokens]
    assert np.allclose(got["base_score"], base)
    out = got["held_out"].to_numpy()
    assert got["score"][out].sum() > got["base_score"][out].sum()
    assert (got["score"] < 0).all()


def test_op2(spark, docs):
    got = by_doc(run(spark, "op2_ngram_jaccard_join"), docs)
    sets = []
    for t in docs["text"]:
        w = WORD.findall(lowered(t))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    ids = list(docs["doc_id"])
    assert ids == sorted(ids)
    assert list(got["n_shingles"]) == [len(s) for s in sets]
    assert list(got["component_id"]) == [ids[find(i)] for i in range(len(ids))]
    assert len(set(got["component_id"])) < len(ids)


def test_op3(spark, docs):
    sf = "/root/testdata/sf0.01"
    all_docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = by_doc(run(spark, "op3_toxicity", sf), all_docs)
    assert list(got["held_out"]) == [fold(i, 5) == 0 for i in all_docs["doc_id"]]
    assert got["score"].between(0, 1).all()
    assert list(got["predicted"]) == [int(s >= 0.5) for s in got["score"]]
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")["toxic"]
    known = got[got["held_out"] & got.index.isin(labels.index)]
    assert (known["predicted"] == labels.loc[known.index]).mean() > 0.97


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_op4(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_doc(run(spark, "op4_secret_scan", "/root/testdata/sf0.01"), docs)
    base = [base_secrets(t) for t in docs["text"]]
    for k, kind in enumerate(("assign", "access", "hex")):
        assert list(got[f"n_{kind}"]) == [sum(s[1] == k for s in b) for b in base]
    want = [",".join(f"{kind}:{s}:{e}" for s, _, kind, e in b) for b in base]
    assert list(got["base_sha256"]) == list(map(sha, want))
    for spans, w in zip(got["spans"], want):
        assert [x for x in spans.split(",") if not x.startswith("random")] == w.split(",") or not w
    assert sum(map(len, base)) > 20


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    got = run(spark, "op5_vector_packing")
    assert set(got["doc_id"]) == set(docs["doc_id"])
    texts = docs.set_index("doc_id")["text"]
    for doc, rows in got.sort_values("start").groupby("doc_id"):
        ids = [*tok.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert set(rows["doc_tokens"]) == {len(ids)}
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        ends = (rows["offset"] + rows["length"]).tolist()
        assert rows["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert padding <= 0.02 * got["length"].sum()


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(e["embedding"].to_numpy()).astype(float), e["vec_id"].to_numpy()
    got = run(spark, "op6_projection_forest", sf)
    hits = 0
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(set(got["query_id"])) == sorted(asked)
    for q, rows in got.sort_values("rank").groupby("query_id"):
        score = x @ x[ids == q][0]
        want = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:20]
        assert rows["rank"].tolist() == list(range(1, 21))
        assert np.allclose(rows["score"], [score[ids == i][0] for i in rows["vec_id"]])
        keys = list(zip(-rows["score"], rows["vec_id"]))
        assert keys == sorted(keys) and q not in set(rows["vec_id"])
        hits += len({i for _, i in want} & set(rows["vec_id"]))
    assert hits >= 0.9 * 20 * len(asked)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_op7(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_doc(run(spark, "op7_personal_data", "/root/testdata/sf0.01"), docs)
    base = [base_pii(t) for t in docs["text"]]
    for kind in pii.KINDS:
        assert list(got[f"n_{kind}"]) == [sum(s[0] == kind for s in b) for b in base]
    want = [",".join(f"{k}:{s}:{e}" for k, s, e in b) for b in base]
    assert list(got["base_sha256"]) == list(map(sha, want))
    for spans, w in zip(got["spans"], want):
        assert spans.startswith(w)


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    got = by_doc(run(spark, "op8_bpe_round_trip"), docs)
    ids = [tok.encode(t, add_special_tokens=False).ids for t in docs["text"]]
    assert list(got["n_tokens"]) == list(map(len, ids))
    assert list(got["ids_sha256"]) == [sha(",".join(map(str, i))) for i in ids]
    assert list(got["decoded_sha256"]) == [sha(tok.decode(i, skip_special_tokens=False)) for i in ids]


def test_op9(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.SQL["op9_url_filter"]).df().set_index("page_id").sort_index()
    got = run(spark, "op9_url_filter").set_index("page_id").sort_index()
    assert got.where(got.notna(), None).equals(want[got.columns].where(want.notna(), None))
    assert set(got["verdict"]) == {"allow", "block"} and got["rule"].isna().any()


def brute_quality(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        len(words) < 10 or 100 * len(inside) > 20 * len(words),
    ]


def test_op10(spark, docs):
    got = by_doc(run(spark, "op10_repetition_rules"), docs)
    want = [brute_quality(t) for t in docs["text"]]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got[columns].to_numpy().tolist() == want
    assert not (got["kept"] & got["base_failed"]).any() and got["kept"].mean() > 0.7


def longest_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_suffix_array_repeats():
    rng = np.random.default_rng(0)
    lists = [[bytes([97 + c]) for c in rng.integers(0, 1 + k % 4, rng.integers(0, 40))] for k in range(60)]
    best, starts = rep.repeats(lists)
    for i, words in enumerate(lists):
        assert best[starts[i] : starts[i + 1] - 1].tolist() == longest_repeats(words)

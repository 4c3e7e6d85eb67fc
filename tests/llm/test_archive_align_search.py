"""Archives, token alignment and ranked search against plain versions, and their edge cases."""

import collections
import gzip
import hashlib
import itertools
import math
import re

import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import alignment, lexical, queries, warc
from marginalia.llm.bpe import byte_letters
from marginalia.session import scratch_path

SF = "/root/testdata/sf0.001"
CLASH = "score n terms rank file offset length payload first copies key seq pos left cut codes item slot".split()


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


# ---- archives ----------------------------------------------------------------
def plain_types(pages):
    """Digest, type and target of each page, the long way round."""
    first = {}
    for i, html in sorted((p, h or "") for p, h in pages):
        first.setdefault(html, i)
    out = {}
    for i, html in pages:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and first[html] != i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None)
    return out


def as_rows(df):
    return [
        (r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to))
        for r in df.itertuples()
    ]


def test_op11(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op11_warc_archive(spark, SF).toPandas().set_index("page_id").loc[pages["page_id"]]
    want = plain_types(list(zip(pages["page_id"], pages["html"])))
    assert as_rows(got) == [want[i] for i in pages["page_id"]]


def test_archive_copies(spark):
    long, other = "<p>same</p>" * 30, "é" * 80
    rows = [(9, "u9", long), (3, "u3", long), (4, "u4", "short"), (5, "u5", "short"), (7, None, other), (6, "u6", other), (8, "u8", None)]
    got = warc.round_trip(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).toPandas()
    want = plain_types([(i, h) for i, _, h in rows])
    assert as_rows(got.set_index("page_id").loc[list(want)]) == list(want.values())
    assert got["url"].isna().sum() == 1


def test_archive_repeated_and_null_ids(spark):
    long = "<p>same</p>" * 30
    rows = [(2, "u", long)] * 5 + [(None, "n", long), (3, "u", "x" * 200), (None, "a b\r\n%", "y" * 120), (None, None, "y" * 120)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert len(got) == len(rows)
    same = got[got["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()]
    assert sorted(same["record_type"]) == ["response"] + ["revisit"] * 5
    assert (same[same["record_type"] == "revisit"]["refers_to"] == 2).all()
    assert "a b\r\n%" in set(got["url"])
    assert sorted(got[got["payload_bytes"] == 120]["record_type"]) == ["response", "revisit"]


def test_archive_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_selected_records(spark):
    """Files are valid gzip, the index points at records, and only selected ones come back."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(3)
    folder = scratch_path(spark, "archive-test")
    index = warc.write(warc.decide(pages), folder, file_bytes=20_000)
    rows = index.toPandas()
    assert rows["file"].nunique() > 3
    store, path = warc.file_system(folder)
    for r in rows.head(5).itertuples():
        with store.open_input_file(f"{path}/{r.file}") as f:
            whole = f.read()
        assert gzip.decompress(whole).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert warc.parse(gzip.decompress(whole[r.offset : r.offset + r.length]))["payload_digest"] == r.payload_digest
    some = index.filter("page_id % 7 = 3")
    html = pages.filter("page_id % 7 = 3").toPandas().set_index("page_id")["html"]
    back = warc.read(some, folder).toPandas().set_index("page_id")
    assert sorted(back.index) == sorted(html.index)
    full = back[back["record_type"] == "response"]
    assert all(bytes(full.loc[i, "payload"]).decode() == html[i] for i in full.index)


def test_coalesced_ranges():
    near = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 21 + 2 * warc.GAP, 1), ("b", 0, 3)]
    assert [r[:3] for r in warc.coalesced(iter(near))] == [
        ("a", 0, 20 + warc.GAP),
        ("a", 21 + 2 * warc.GAP, 22 + 2 * warc.GAP),
        ("b", 0, 3),
    ]
    big = [("a", 0, warc.READ), ("a", warc.READ, warc.READ)]
    assert len(list(warc.coalesced(iter(big)))) == 2


def test_damaged_record():
    row = {"record_type": "response", "payload": b"x" * 200, "payload_bytes": 200, "payload_digest": hashlib.sha256(b"x" * 200).hexdigest(),
           "url": "u", "page_id": "1", "refers_to": None}
    raw = warc.record(row, "n", "2020-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"x" * 200
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"xxx", b"xyx", 1))


# ---- token alignment ---------------------------------------------------------
class PlainAligner:
    """Both libraries over whole texts, cuts by set intersection."""

    def __init__(self):
        self.a = Tokenizer.from_file(queries.vocabulary())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
        self.name = {i: k for k, i in self.a.get_vocab().items()}
        self.back = {c: b for b, c in byte_letters().items()}

    def groups(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        as_a = [bytes(self.back[c] for c in self.name[i]) for i in a]
        as_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if not (b"".join(as_a) == b"".join(as_b) == (" " + text).encode()):
            return None
        ends_a, ends_b = ([*itertools.accumulate(map(len, x))] for x in (as_a, as_b))
        out, i, j = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            k, n = i, j
            while i < len(a) and ends_a[i] <= c:
                i += 1
            while j < len(b) and ends_b[j] <= c:
                j += 1
            out.append((a[k:i], b[n:j]))
        return out

    def table(self, texts):
        found = [self.groups(t) for t in texts]
        links = [collections.Counter((x, y) for xs, ys in g or [] for x in xs for y in ys) for g in found]
        docs = collections.Counter(p for link in links for p in link)
        best = collections.defaultdict(int)
        for (x, _), c in docs.items():
            best[x] = max(best[x], c)
        out = []
        for g, link in zip(found, links):
            s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
            out.append((
                sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(link.values()),
                sum(n for p, n in link.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in link.items()),
                hashlib.sha256(s.encode()).hexdigest() if g else "",
            ))
        return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "", None, " ", "   ", "\n", "a", " a", "a ", "a\n", "\n\na", "a b\nc\td  e \n f", "x <|endoftext|> y<s> </s>", "a ▁b", "<0x41> a",
    "日本語 テキスト　空白", "été naïve coöperate", "tab\there\nand\r\nthere", "a" * 3000, "😀 😀😀\n😀", "9 99 999 9,999.99",
    "'s 't don't", "\x1c \x85 \xa0 x",
]


@pytest.mark.parametrize("settings", [alignment.Settings(), alignment.Settings(chunk=40, hot=30)])
def test_alignment_of_odd_texts(spark, settings):
    texts = ODD + ["one two three"] * 3
    rows = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = alignment.align(rows, queries.vocabulary(), queries.piece_model(), settings).toPandas()
    got = got.set_index("doc_id").loc[range(len(texts)), ALIGNED]
    assert [tuple(r) for r in got.itertuples(index=False)] == PlainAligner().table(texts)


@pytest.mark.parametrize("settings", [alignment.Settings(), alignment.Settings(chunk=600, hot=2000)])
def test_op12(spark, settings):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = alignment.align(rows, queries.vocabulary(), queries.piece_model(), settings).toPandas()
    got = got.set_index("doc_id").loc[docs["doc_id"], ALIGNED]
    assert [tuple(r) for r in got.itertuples(index=False)] == PlainAligner().table(docs["text"])


def test_alignment_of_repeated_ids_and_no_rows(spark):
    text = "alpha beta\ngamma " * 30
    rows = spark.createDataFrame([(None, text), (None, text), (4, text), (4, "x")], "doc_id long, text string")
    small = alignment.Settings(chunk=50)
    got = alignment.align(rows, queries.vocabulary(), queries.piece_model(), small).toPandas()
    assert got["doc_id"].isna().sum() == 2 and sorted(got["n_a"])[0] < sorted(got["n_a"])[1] == got["n_a"].max()
    assert (got["n_best"] <= got["n_links"]).all()
    assert alignment.align(rows.limit(0), queries.vocabulary(), queries.piece_model()).count() == 0


def test_fragments_compose_in_any_order():
    text = " one two  three\nfour five\t six seven\n\neight nine x" * 3

    def closed_of(parts):
        """All stretches, composing neighbours in the order of the tree given by ``parts``."""
        if isinstance(parts, str):
            f = alignment.fragment(parts)
            return f, ([f.closed] if f.closed else [])
        (x, before), (y, after) = map(closed_of, parts)
        f, mid = alignment.compose(x, y)
        return f, before + ([mid] if mid else []) + after

    want = alignment.units(text)
    n = len(text)
    for a, b in [(1, 2), (7, 30), (9, 10), (40, 41), (n // 2, n - 1)]:
        left = ((text[:a], text[a:b]), text[b:])
        right = (text[:a], (text[a:b], text[b:]))
        for tree in (left, right):
            f, closed = closed_of(tree)
            pieces = [p for p in [f.left, *closed, f.right] if p]
            assert "".join(pieces) == text
            assert [u for p in pieces for u in alignment.units(p)] == want
    assert alignment.compose(alignment.fragment(""), alignment.fragment("ab c"))[0] == alignment.compose(alignment.fragment("ab c"), alignment.fragment(""))[0]


# ---- ranked search -----------------------------------------------------------
TERM = re.compile(lexical.TERM)


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=50):
    """Every document scored for every item."""
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, size = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        asked, scores = set(terms_of(text)), []
        for i, c in counts:
            m = 50 + 50 * c.total() * n // size
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in asked & c.keys()
            )
            if s > 0:
                scores.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def found_by(df):
    return {k: list(zip(g["doc_id"], g["score"])) for k, g in df.sort_values("rank").groupby("item_id")}


def test_op13(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op13_lexical_search(spark, SF).toPandas()
    assert all(sorted(g["rank"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("item_id"))
    want = plain_search(zip(docs["doc_id"], docs["text"]), zip(items["item_id"], items["text"]))
    assert found_by(got) == {k: v for k, v in want.items() if v}


def test_search_in_blocks_with_long_items(spark, monkeypatch):
    """Items of more than 64 terms, several blocks of items, small blocks of documents."""
    monkeypatch.setattr(lexical, "CELLS", 1)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[(i * k) % 300] for k in range(1, 3 + i % 90))) for i in range(400)]
    items = [(1, " ".join(words[:150])), (2, "w7 W8 w9"), (3, "nothing here"), (4, " ".join(words[::3]))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(clashing(d), clashing(q), lexical.Settings(top=20, block_terms=60)).toPandas()
    assert found_by(got) == {k: v for k, v in plain_search(docs, items, 20).items() if v}


def test_search_edges(spark):
    docs = [(5, "b a"), (2, "A b"), (2, "A b"), (None, "a b"), (7, None), (8, " .,;"), (9, "é" * 10), (1, "c " * 1000 + "a")]
    items = [(1, "a"), (1, "b"), (2, None), (3, ""), (4, "É é a"), (None, "c")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(d, q).toPandas().sort_values("rank")
    one = got[got["item_id"] == 1]
    assert list(one["doc_id"])[:3] == [2, 2, 5] and pd.isna(list(one["doc_id"])[3])
    assert list(got[got["item_id"].isna()]["doc_id"]) == [1]
    assert set(got["item_id"].dropna()) == {1, 4}
    for a, b in ((d.limit(0), q), (d, q.limit(0))):
        assert lexical.search(a, b).count() == 0


def test_long_text_is_read_in_slices(monkeypatch):
    text = "alpha, beta! " * 500
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "SLICE", 64)
    assert lexical.term_counts(text) == whole == {b"alpha": 500, b"beta": 500}

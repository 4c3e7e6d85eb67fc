"""Formats: golden miniature inputs and error cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators import shaping as sh
from marginalia.operators import validate as va
from marginalia.operators.assemble import assemble, mint_ids
from marginalia.sources import arggraph as ag
from marginalia.sources import files, standoff
from marginalia.streaming import jobs

TEXT = "Night trams\n\nTrams should run all night. Late workers need them, since taxis cost too much.\n"
SPANS = {
    "T1": ("MajorClaim", "Trams should run all night"),
    "T2": ("Claim", "Late workers need them"),
    "T3": ("Premise", "taxis cost too much"),
}


def span_line(name, end=""):
    kind, words = SPANS[name]
    at = TEXT.index(words)
    return f"{name}\t{kind} {at} {at + len(words)}\t{words}{end}\n"


ANN = (
    span_line("T3") + span_line("T1") + span_line("T2", "\t") + "A1\tStance T2 For\nR1\tsupports Arg1:T3 Arg2:T2\t\n"
)


def docs(spark, ann=ANN, text=TEXT):
    return spark.createDataFrame([("d", text, ann)], "doc_id string, text string, ann string")


def test_standoff_document(spark):
    comps, rels, errors = standoff.parse_annotations(docs(spark))
    got = {r.comp_id: r for r in comps.collect()}
    assert {k: r.ctype for k, r in got.items()} == {"T1": "MajorClaim", "T2": "Claim", "T3": "Premise"}
    assert [got[k].idx for k in ("T1", "T2", "T3")] == [0, 1, 2]
    assert got["T2"].stance == "For" and got["T2"].check == "fixup" and got["T1"].check == "same"
    assert [(r.src, r.rtype, r.tgt) for r in rels.collect()] == [("T3", "supports", "T2")]
    assert errors.count() == 0


@pytest.mark.parametrize("bad", ["T1\tOther 0 5\tNight", "X1\tClaim 0 5\tNight", "R1\tsupports T1 T2", "A1\tStance T2 Maybe"])
def test_standoff_errors(spark, bad):
    _, _, errors = standoff.parse_annotations(docs(spark, ann=bad), strict=False)
    assert errors.count() == 1
    with pytest.raises(Exception):
        standoff.parse_annotations(docs(spark, ann=bad))[0].collect()
        standoff.parse_annotations(docs(spark, ann=bad))[1].collect()


def test_offset_drift_fails(spark):
    with pytest.raises(Exception, match="offsets and recorded text differ"):
        standoff.parse_annotations(docs(spark, text=TEXT.replace("\n", "\r\n")))[0].collect()


def test_archive_walk_and_pairing(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("p/e1.txt", TEXT)
        z.writestr("p/e1.ann", ANN)
        z.writestr("__MACOSX/p/._e1.txt", "junk")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("c/p.zip", inner.getvalue())
    packed = spark.createDataFrame([("a.zip", bytearray(outer.getvalue()))], "path string, content binary")
    members = standoff.archive_members(packed)
    assert members.count() == 2
    assert standoff.pair_members(members).first().text == TEXT
    with pytest.raises(Exception, match="unpaired file"):
        standoff.pair_members(members.filter("member like '%.txt'")).collect()


def test_repeated_span_id_means_the_last(spark):
    again = ANN + "T2\tPremise 0 5\tNight\n"
    comps, _, _ = standoff.parse_annotations(docs(spark, ann=again))
    assert {(r.comp_id, r.start_off) for r in comps.collect()} >= {("T2", 0)} and comps.count() == 3


def test_split_csv(spark):
    def read(text):
        made = spark.createDataFrame([("f", text)], "path string, value string")
        return {(r.doc_id, r.split) for r in standoff.read_split_csv(made).collect()}

    assert read('\ufeff"ID";"SET"\r\n"e1";"TRAIN"\r\n"e;2";"test"\r\n\r\n') == {("e1", "train"), ("e;2", "test")}
    with pytest.raises(Exception, match="no such split"):
        read('ID;SET\n"e1";"DEV"\n')
    with pytest.raises(Exception, match="no ID;SET header"):
        read('"e1";"TRAIN"\n')


def test_split_ids_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", f"d{i}") for i in range(7)] + [("test", "x")], "split string, doc_id string")
    for k, most in enumerate((100, 3)):
        files.write_split_ids(rows, str(tmp_path / f"s{k}"), most)
        assert sorted(files.read_split_ids(spark, str(tmp_path / f"s{k}")).collect()) == sorted(rows.collect())


PARTS = ("Trams should run all night.", "Late workers need them.", "Few would ride, say critics.")
XML = (
    "<arggraph id='g' topic_id='t' stance='pro'>"
    + "".join(f"<edu id='e{i}'><![CDATA[{p}]]></edu>" for i, p in enumerate(PARTS, 1))
    + "<adu id='a1' type='pro'/><adu id='a2' type='pro'/><adu id='a3' type='opp'/>"
    + "".join(f"<edge id='s{i}' src='e{i}' trg='a{i}' type='seg'/>" for i in (1, 2, 3))
    + "<edge id='c1' src='a2' trg='a1' type='sup'/><edge id='c2' src='a3' trg='c1' type='{kind}'/></arggraph>"
)


def graph(spark, kind="und"):
    g = ag.parse(spark.createDataFrame([("m", XML.format(kind=kind))], "doc_id string, xml string"))
    edges = ag.edges(g)
    return g, edges, edges.filter("etype = 'seg'").select("doc_id", F.col("trg").alias("adu_id"))


def test_argument_graph(spark):
    g, edges, units = graph(spark)
    text, segments = ag.segment_text(g)
    comps = ag.components(g, text, ag.unit_spans(edges, segments)).orderBy("start_off").collect()
    whole = " ".join(PARTS)
    assert text.first().text == whole
    assert [whole[c.start_off : c.end_off] for c in comps] == list(PARTS)
    rels, outcomes = ag.resolve_edges(edges, units)
    assert {(r.src, r.rtype, r.tgt) for r in rels.collect()} == {("a2", "supports", "a1"), ("a3", "attacks", "a2")}
    lost = ag.flattening(outcomes).first()
    assert (lost.undercuts_flattened, lost.unresolvable_edges) == (1, 0)


def test_unknown_edge_type_fails(spark):
    with pytest.raises(Exception, match="unknown edge type"):
        _, edges, units = graph(spark, "bogus")
        ag.resolve_edges(edges, units)[0].collect()


def test_documents_round_trip_and_closed_schema(spark, tmp_path):
    row = '{"doc_id":"a","source":"s","split":"train","text":"hi","components":[],"relations":[],"meta":{}}'
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(row + "\n\n")
    bad.write_text(row.replace('"meta":{}', '"meta":{},"more":1') + "\n")
    read = files.read_documents(spark, str(good))
    files.write_documents(read, str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out")).collect() == read.collect()
    with pytest.raises(Exception, match="unknown fields"):
        files.read_documents(spark, str(bad)).collect()


def test_newest_prediction_file_last_line_wins(spark, tmp_path):
    import os

    line = '{{"doc_id":"{}","components":[],"relations":[],"meta":{{"v":"{}"}}}}\n'
    (tmp_path / "m_v1.jsonl").write_text(line.format("a", "old"))
    (tmp_path / "m_v2.jsonl").write_text(line.format("a", "1") + line.format("b", "1") + line.format("a", "2"))
    os.utime(tmp_path / "m_v1.jsonl", (1, 1))
    got = {r.doc_id: r.meta["v"] for r in files.read_predictions(spark, str(tmp_path), "m").collect()}
    assert got == {"a": "2", "b": "1"}


def test_load_test_and_report_scans(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Name,Request Count,Failure Count,Requests/s,50%,95%,99%,Average Response Time,Max Response Time\n"
        "/x,1,0,1,1,1,1,1,1\nAggregated,20,1,2.5,5300,7300,N/A,5400.5,9000\n"
    )
    r = files.read_load_test(spark, str(tmp_path / "s.csv")).first()
    assert (r.requests, r.failures, r.p50_s, r.p99_s) == (20, 1, 5.3, 0.0)
    (tmp_path / "r.json").write_text(
        '{"model":"m","scores":{"exact/typed":{"status":"not_applicable"},"exact/untyped":'
        '{"components":{"f1_ci":{"point":0.5}},"relations":{"f1_ci":{"point":0.25}}}}}'
    )
    rows = files.read_report(spark, str(tmp_path / "r.json")).filter("status = 'scored'").collect()
    assert {(x.kind, x.point) for x in rows} == {("components", 0.5), ("relations", 0.25)}
    with pytest.raises(ValueError, match="checksum differs"):
        files.verify_checksum(spark, str(tmp_path / "s.csv"), "0" * 64)


def test_minted_ids(spark):
    def minted(*stated):
        rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(stated)], "doc_id string, idx bigint, stated string")
        return [r.comp_id for r in mint_ids(rows).orderBy("idx").collect()]

    assert minted("c1", "c1", "c2", "c1#2") == ["c1", "c1#2", "c2", "c1#2#4"]
    assert minted("c1", "c1", "c1#2", "c1#2#3") == ["c1", "c1#2", "c1#2#3", "c1#2#3#4"]


def test_ids_that_count_as_none(spark):
    text = "one two three four five six"
    said = ['"0"', '"false"', '"c1"', "0", "false", "[]", '""', "null", "7"]
    words = ["one", "two", "three", "four", "five", "six", "one", "two", "three"]
    parts = ", ".join(f'{{"id": {i}, "type": "Claim", "text": "{w}"}}' for i, w in zip(said, words))
    answer = f'{{"components": [{parts}], "relations": [{{"src": "0", "tgt": "c1", "type": "supports"}}]}}'
    one = spark.createDataFrame([("d", answer)], "doc_id string, answer string")
    comps, rels, _ = assemble(one, spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert [r.comp_id for r in comps.orderBy("idx").collect()] == ["0", "false", "c1", "c4", "c5", "c6", "c7", "c8", "7"]
    assert [(r.src, r.tgt) for r in rels.collect()] == [("0", "c1")]


def test_carve_takes_a_fifth_of_train(spark):
    sizes = spark.createDataFrame([(f"d{i:03}", i % 5 + 1) for i in range(80)], "doc_id string, n_components bigint")
    got = sh.carve_validation(sizes)
    assert 0.15 <= got.filter("split = 'val'").count() / 80 <= 0.25


def test_strict_validation(spark):
    d = spark.createDataFrame([("d", "abc")], "doc_id string, text string")
    c = spark.createDataFrame([("d", "T1", 0, 9, "abc")], "doc_id string, comp_id string, start_off bigint, end_off bigint, text string")
    r = spark.createDataFrame([], "doc_id string, rel_id string, src string, tgt string")
    with pytest.raises(ValueError, match="span beyond text"):
        va.require_valid(d, c, r)


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    src, progress = str(tmp_path / "ledger"), str(tmp_path / "progress")
    entry = "'' AS timestamp, 'm' AS model, 'd' AS doc_id, 1L AS input_tokens, 1L AS output_tokens, 0L AS cache_read_tokens, 0L AS cache_write_tokens, 1.5D AS dollars, 1D AS latency_s, false AS batch, false AS cached, '' AS note"
    for expected in (1.5, 3.0):
        files.append_ledger(spark.sql(f"SELECT {entry}"), src)
        out = jobs.run_to_end(jobs.spend_by_model(jobs.read_ledger(spark, src), 2.0), "complete", progress)
        row = out.first()
        assert row.spent == expected and row.over_cap == (expected > 2.0)
    assert jobs.run_to_end(jobs.spend_by_model(jobs.read_ledger(spark, src), 2.0), "complete", progress).first() == row


def test_restart_keeps_earlier_rows(spark, tmp_path):
    src, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for k, keys in enumerate((["a"], ["a", "b"], ["a", "b"])):
        if k < 2:
            spark.createDataFrame([(keys[-1], k)], "key string, n int").write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, n int").parquet(src)
        out = jobs.run_to_end(jobs.first_calls(stream, ["key"]), "append", progress)
        assert sorted(r.key for r in out.collect()) == keys


def ledger_part(spark, src, *rows):
    """One file of ledger entries ``(timestamp, model, doc_id, dollars)``."""
    made = spark.createDataFrame(list(rows), "timestamp string, model string, doc_id string, dollars double")
    none = {c: F.lit(0).cast("bigint") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")}
    files.append_ledger(made.coalesce(1).withColumns(none | {"latency_s": F.lit(1.0), "batch": F.lit(False), "cached": F.lit(False), "note": F.lit("")}), src)


def test_first_calls_lose_no_old_or_undated_row(spark, tmp_path):
    src, progress = str(tmp_path / "ledger"), str(tmp_path / "progress")
    ledger_part(spark, src, ("", "m", "a", 1.0), ("2024-01-01T00:00:00", "m", "b", 1.0))
    once = lambda: jobs.first_calls(jobs.read_ledger(spark, src, files_per_batch=1), ["doc_id", "model"])
    assert sorted(r.doc_id for r in jobs.run_to_end(once(), "append", progress).collect()) == ["a", "b"]
    ledger_part(spark, src, ("2023-06-01T00:00:00", "m", "c", 1.0), ("", "m", "d", 1.0), ("2020-01-01T00:00:00", "m", "a", 1.0))
    ledger_part(spark, src, ("1999-01-01T00:00:00", "n", "a", 1.0), ("", "m", "b", 1.0))
    got = sorted((r.doc_id, r.model) for r in jobs.run_to_end(once(), "append", progress).collect())
    assert got == [("a", "m"), ("a", "n"), ("b", "m"), ("c", "m"), ("d", "m")]


def test_quotes_in_split_files(spark):
    text = '"ID";"SET"\n"a""b;c";"TRAIN"\nplain;test\n'
    got = standoff.read_split_csv(spark.createDataFrame([("f", text)], "path string, value string")).collect()
    assert {(r.doc_id, r.split) for r in got} == {('a"b;c', "train"), ("plain", "test")}


def test_starts_from_any_folder(tmp_path):
    """A query whose Python runs on executors, from an empty working folder."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(e.queries()['i1_fuzzy_align'](s, '/root/testdata/sf0.001').limit(3).count())\n"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert ran.stdout.strip().endswith("3"), ran.stderr[-2000:]

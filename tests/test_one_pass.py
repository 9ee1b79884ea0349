"""Work that is done once: a response's parse, a document's bytes, the segments
that two sides of a join read, a large file's ranges."""

import os
import tempfile

from pyspark.sql import functions as F

from interlinear.functions.text import utrim, utrim_end
from interlinear.operators import blocks
from interlinear.operators import responses as P
from interlinear.plans import catalog
from interlinear.sources import files as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_body_is_parsed_once_whatever_filter_reads_its_status(spark):
    for name in ("error_summary", "response_lines"):
        assert _plan(catalog.QUERIES[name](spark, SF)).count("from_json(") == 3, name  # one for each provider


def test_results_of_each_provider_and_of_broken_bodies(spark):
    rows = [("baidu", '{"from":"en","trans_result":[{"src":"a","dst":"x"},{"src":"b"}]}'), ("baidu", '{"error_code":"1","error_msg":"m"}'),
            ("tencent", '{"Response":{"TargetTextList":["x","y"]}}'), ("tencent", '{"Response":{"Error":{"Code":"c","Message":"m"}}}'),
            ("niutrans", '{"tgt_text":"x\\ny\\u3000\\n"}'), ("niutrans", '{"error_code":"2","error_msg":"m","apikey":"k"}'),
            ("tencent", "no json"), ("other", "{}"), ("baidu", None), (None, "{}")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, provider string, body string")
    got = [tuple(r) for r in P.unify_responses(df).orderBy("i").select("status", "dst", "error_code", "error_msg").collect()]
    bad = ("bad_json", None, None, None)
    assert got == [("ok", ["x", None], None, None), ("error", None, "1", "m"), ("ok", ["x", "y"], None, None), ("error", None, "c", "m"),
                   ("ok", ["x", "y"], None, None), ("error", None, "2", "m"), bad, bad, bad, bad]


def test_trims_as_the_unicode_pattern_does(spark):
    odd = [chr(c) for c in [*range(0x21), 0x7F, *range(0x80, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(x,) for c in odd for x in (c, f"{c}a {c}b{c}\n", f"a{c}{c}", f" {c}é")] + [("",), (None,)], "x string")
    both, end = F.regexp_replace("x", r"(?U)^\s+|\s+$", ""), F.regexp_replace("x", r"(?U)\s+$", "")
    assert df.filter(~(utrim("x").eqNullSafe(both) & utrim_end("x").eqNullSafe(end))).count() == 0


def test_cells_are_counted_only_above_a_delimiter_row(monkeypatch):
    seen = []
    count = blocks._cells
    monkeypatch.setattr(blocks, "_cells", lambda x: seen.append(x) or count(x))
    kinds = blocks._columns("a | b\nc | d\n\n| a | b |\n|---|---|\n| c | d |")[1]
    assert kinds == ["text", "text", "blank", "table_head", "table_delim", "table_row"]
    assert sorted(seen) == ["| a | b |", "|---|---|"]


def test_slices_turn_a_text_into_bytes_once_a_document(spark):
    from interlinear.operators.segments import extract_segments, slice_by_range, whole_text
    s = extract_segments(spark.createDataFrame([(0, "é\n\nb\n\n- t"), (1, ""), (0, "c"), (None, "d")], "doc_id long, text string"))
    out = slice_by_range(s, whole_text(s))
    plan = _plan(out)
    assert "Generate explode(element_at(transform(array(" in plan[:plan.index("SortMergeJoin")]  # above the join of documents
    segs = s.filter("not is_tail and doc_id is not null")
    assert out.count() == segs.count() and set(out.columns) == {"doc_id", "seg_no", "byte_start", "byte_end", "piece", "matches"}


def test_segments_that_are_read_twice_are_made_once(spark):
    for name in ("slice_by_range", "align_positional", "extra_translation"):
        assert _plan(catalog.QUERIES[name](spark, SF)).count("_lines_of(") == 0, name  # read from the checkpoint


def test_a_large_file_is_checked_in_ranges(spark, monkeypatch):
    texts = ["aé\u20ac\U0001f600b" * 3, "plain" * 4, "\U0001f600" * 6]
    good = [t.encode() for t in texts]
    bad = [b"a" * 9 + b"\x80" + b"b" * 9, good[0][:-2], good[2][1:], b"ab" * 5 + b"\xed\xa0\x80" + b"c" * 5, b"abcd\xc0\xafabcd", b"abc" + b"\x80" * 9,
           b"a" * 10 + b"\xf0\x9f", b"abcd\xf4\x90\x80\x80abcd"]
    d = tempfile.mkdtemp(prefix="interlinear-test-")
    paths = []
    for i, content in enumerate(good + bad):
        paths.append(os.path.join(d, f"{'_' * (i % 2)}{i:02d}.md"))
        with open(paths[-1], "wb") as f:
            f.write(content)
    paths.append(paths[0])  # asked twice
    whole = sorted(map(tuple, S.read_files(spark, paths).collect()), key=str)
    for size in (1, 2, 3, 5, 7):
        monkeypatch.setattr(S, "RANGE", size)
        got = S.read_files(spark, paths)
        assert sorted(map(tuple, got.collect()), key=str) == whole, size
        assert "_check_ranges" in _plan(got)
    assert sum(r[3] == "normal" for r in whole) == 4

"""Batching goldens (B1-B9) and invariants."""

import goldens as G
import pytest
from made import docs

from interlinear import dims
from interlinear.operators import batching as B
from interlinear.operators.segments import extract_segments


@pytest.mark.parametrize("unit,limit", list(G.IO_BATCHES))
def test_greedy_batches_golden(spark, unit, limit):
    s = extract_segments(docs(spark, G.IO_EVENT_QUEUE))
    got = [r.batch_no for r in B.batch_segments(s, limit, unit).orderBy("seg_no").collect()]
    assert got == G.IO_BATCHES[(unit, limit)]


def test_batch_text_is_a_byte_slice(spark):
    s = extract_segments(docs(spark, G.IO_EVENT_QUEUE))
    bt = B.batch_text(B.batch_segments(s, 400, "bytes")).orderBy("batch_no").collect()
    whole = "".join(t + "\n" for t in G.IO_SEGMENTS)
    assert "".join(r.text for r in bt) == whole
    assert [r.n_bytes for r in bt] == [365, 305, 184]
    assert not any(r.oversize for r in bt)


def test_oversize_segment_is_alone(spark):
    s = extract_segments(docs(spark, G.IO_EVENT_QUEUE))
    bt = B.batch_text(B.batch_segments(s, 100, "bytes")).orderBy("batch_no").collect()
    assert [(r.first_seg, r.last_seg, r.oversize) for r in bt] == [
        (0, 0, False), (1, 1, True), (2, 2, False), (3, 3, True), (4, 4, True)]


def test_providers_rebatch_without_reextracting(spark):
    s = extract_segments(docs(spark, G.IO_EVENT_QUEUE))
    b = B.batch_by_providers(s, dims.PROVIDERS)
    got = {(r.provider, r.seg_no): r.batch_no for r in b.collect()}
    assert {got[("baidu", i)] for i in range(5)} == {0}
    assert len(b.filter("provider = 'tencent'").collect()) == 5


def test_invariants_on_driver_documents(spark):
    """No batch over the limit unless it is one segment; the next batch's first
    segment would not have fit (greedy maximality); batches tile the text."""
    from interlinear.plans import corpora as C
    s = extract_segments(C.lines_corpus(spark, "/root/testdata/sf0.001"))
    limit = 300
    bt = B.batch_text(B.batch_segments(s, limit, "chars")).collect()
    by_doc = {}
    for r in bt:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.n_chars <= limit or r.n_segments == 1
    seg_chars = {(r.doc_id, r.seg_no): r.n_chars for r in s.collect()}
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r.batch_no)
        for a, b in zip(rows, rows[1:]):
            assert a.last_seg + 1 == b.first_seg
            assert a.n_chars + seg_chars[(d, b.first_seg)] > limit


def test_plan_has_one_exchange(spark):
    from interlinear.plans import corpora as C
    s = extract_segments(C.lines_corpus(spark, "/root/testdata/sf0.001"))
    plan = B.batch_text(B.batch_segments(s, 2000, "chars"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_per_row_following_frames(spark):
    """Frames that start after the current row and run to the end of the
    partition are recomputed per row (quadratic per document): none allowed."""
    import re
    from interlinear.plans import corpora as C
    s = extract_segments(C.chat_corpus(spark, "/root/testdata/sf0.001"))
    plan = B.batch_text(B.batch_segments(s, 2000, "chars"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"RowFrame, [1-9][0-9]*, unboundedfollowing", plan)


def test_many_provider_limits_join_like_the_literal_form(spark):
    s = extract_segments(docs(spark, "one two\n\nthree four five\n\nsix\n", "x\n"))
    limits = [(f"p{n:04d}", "chars" if n % 2 else "bytes", n % 40) for n in range(300)]
    table = spark.createDataFrame(limits, "provider string, limit_unit string, limit_value long")
    cols = ["doc_id", "provider", "seg_no", "batch_no"]
    joined = B.batch_by_providers(s, table).select(*cols).collect()
    literal = B.batch_by_providers(s, limits).select(*cols).collect()
    assert sorted(joined) == sorted(literal) and len(joined) == 4 * 300


@pytest.mark.parametrize("unit", ["bytes", "chars"])
def test_text_batches_equal_the_two_step_form(spark, unit):
    s = extract_segments(docs(spark, G.BASE, "one two\n\nthr\u00e9e four five\n\nsix\n", "x\n", ""))
    cols = ["doc_id", "batch_no", "first_seg", "last_seg", "n_segments", "text", "n_bytes", "n_chars", "oversize"]
    for limit in (0, 1, 9, 16, 400):
        two = B.batch_text(B.batch_segments(s, limit, unit)).select(*cols).collect()
        assert sorted(B.text_batches(s, limit, unit).select(*cols).collect()) == sorted(two)
    cols.insert(0, "provider")
    two = B.batch_text(B.batch_by_providers(s, dims.PROVIDERS), extra_keys=["provider"]).select(*cols).collect()
    assert sorted(B.text_batches_by_providers(s, dims.providers(spark)).select(*cols).collect()) == sorted(two)

"""The fold over lines and the reading of inline markup are done once a text,
whatever filter stands above them, at a cost that does not grow with the plan."""

from made import docs
from pyspark.sql import functions as F

from interlinear.functions.inline import marked
from interlinear.operators.blocks import block_lines
from interlinear.operators.segments import extract_segments


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_the_text_does_not_repeat_the_reading(spark):
    d = docs(spark, "![](i.png)\n\n[<img src='x'>](u)\n\ntext\n", "")
    segs = extract_segments(d)
    empty = segs.filter(F.col("text") == "").select("doc_id", "seg_no", "text", "n_bytes")
    assert _plan(empty).count("_marks(") == _plan(segs).count("_marks(")
    assert _plan(empty).count("_lines_of(") == 1
    assert [(r.seg_no, r.n_bytes) for r in empty.orderBy("seg_no").collect()] == [(0, 1), (1, 1)]


def test_null_and_empty_texts_and_odd_line_ends(spark):
    d = spark.createDataFrame([(0, None), (1, ""), (2, "- a\r"), (None, "> x\r\n>\n")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.kind, r.body) for r in block_lines(d).collect()}
    assert got == {(1, 0): ("blank", ""), (2, 0): ("text", "a\r"), (None, 0): ("text", "x"), (None, 1): ("blank", ""), (None, 2): ("blank", "")}


def test_marked_pieces():
    assert marked("plain, prose", None) == ("plain, prose", None)
    text, kept = marked("a `` b` `` \\* <i>x</i>", None)
    assert kept == ["`b``", "*", "", ""]
    assert "x" in text and "<" not in text

"""A document is read in one step and written in one step: its lines are not
rows of the plan, whatever their number."""

from pyspark.sql import functions as F

from interlinear.functions.inline import events, read
from interlinear.operators.blocks import _cell_texts, _records
from interlinear.operators.render import render
from interlinear.operators.segments import extract_segments
from interlinear.plans import catalog
from interlinear.plans import jobs as J

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_is_read_and_written_without_rows_for_its_lines(spark):
    plan = _plan(catalog.QUERIES["render_table"](spark, SF))
    assert plan.count("ArrowEvalPython") == 2
    assert "posexplode" not in plan and "Window" not in plan
    # texts by key, translations by key, texts by key for the writing
    assert plan.count("Exchange hashpartitioning") == 3


def test_lines_of_texts_with_one_key_come_in_turn(spark):
    d = spark.createDataFrame([(1, "a\n\n| x | y |\n|--|--|\n| `c` | d |"), (1, "b1\nb2"), (2, "e"), (2, None), (None, "n"), (3, None), (4, "")],
                              "doc_id long, text string")
    segs = extract_segments(d)
    assert sorted((r.doc_id or 0, r.seg_no, r.block_no, r.text) for r in segs.collect()) == [
        (0, 0, 0, "n"), (1, 0, 0, "a"), (1, 1, 1, "b1 b2"), (1, 2, 2, "x"), (1, 3, 2, "y"), (1, 4, 4, "`c`d"), (2, 0, 0, "e")]
    t = segs.withColumn("translation", F.concat(F.lit("T|"), "text"))
    got = {r.doc_id: (r.rendered, r.n_segments, r.status) for r in render(d, t).collect()}
    assert got == {1: ("a\n\nT|a\nb1\n\nT|a\n\n\nT|b1 b2\nb2\n\nT|b1 b2\n|x\tT\\|x|y\tT\\|y|\n|--|--|\n|`c`|d\tT\\|`c`d|", 7, "ok"),
                   2: ("e\n\nT|e", 1, "ok"), None: ("n", 0, "empty"), 4: ("", 0, "empty")}


def test_failed_batches_and_reasons_of_a_document(spark):
    d = spark.createDataFrame([(1, "a\n\nb\n\nc")], "doc_id long, text string")
    t = extract_segments(d).withColumn("batch_ok", F.col("seg_no") != 1).withColumn("reason", F.when(F.col("seg_no") == 1, F.lit("no answer")))
    t = t.withColumn("translation", F.when(F.col("seg_no") == 0, F.lit("A")))
    assert tuple(render(d, t).first()) == (1, "a\n\nA\n\nb\n\nc", 3, 1, "partial", "no answer")


def test_lines_that_show_what_they_are_read_as_before():
    text = "p\n\nq\nr|s\n| a | b |\n|---|---|\n| c |\nx\n\n```\n| d |\n\n- e\n```\nf\n    g\n===\n- i\n  j\n\n<!-- h\n\n-->\nk\n"
    ls, _ = _records(text)
    assert [(x[1], x[6]) for x in ls] == [
        ("text", False), ("blank", False), ("text", False), ("text", True), ("text", True), ("text", True), ("text", True), ("text", True),
        ("blank", False), ("fence", False), ("code", False), ("code", False), ("code", False), ("fence", False), ("text", False),
        ("text", True), ("setext", True), ("text", False), ("text", True), ("blank", False), ("html", False), ("html", False), ("html", False),
        ("text", False), ("blank", False)]


def test_cells_and_inline_markup_in_python():
    assert _cell_texts(" | a |  ") == [" a "] and _cell_texts("a \\| b | c") == ["a \\| b ", " c"] and _cell_texts("|") == [""]
    assert _cell_texts("|a| \r ") == ["a", " \r "] and _cell_texts("|a| \r") == ["a\r"]
    assert read("&amp;lt; &#x41;&#0;&nope; snake_case \\* [x](u) `a  b`", None) == "&lt; A�&nope; snake_case * x `a  b`"
    assert events("a `b` *c*&lt;", None) == [(False, "a ", "a "), (True, "`b`", "`b`"), (False, " ", " "), (False, "c", "c"), (False, "<", "&lt;")]


def test_a_job_reads_the_same_segments_as_extraction(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(["# h\n\n> q\n\n| a |\n|--|\n| *b* |\n\n- t", "\n", None])], "doc_id long, text string")
    out = {r.doc_id: r.rendered for r in J.translate_corpus(d, J.JobConfig(materialize="none"), catalog.STUB).collect()}
    assert out == {0: "# h\n\n# [zh] h\n\n> q\n>\n> [zh] q\n\n|a\t[zh] a|\n|--|\n|*b\t[zh] b*|\n\n- t", 1: "\n"}

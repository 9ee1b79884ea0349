"""Alignment and rendering."""

import goldens as G
from made import docs
from pyspark.sql import functions as F

from interlinear.operators import align as A
from interlinear.operators import batching as B
from interlinear.operators.render import render
from interlinear.operators.segments import extract_segments
from interlinear.operators.translate import Service
from interlinear.plans import jobs as J
from interlinear.plans.stub import stub_service

STUB = Service(stub_service)


def stub_aligned(spark, text, key="doc_id"):
    d = docs(spark, text)
    s = extract_segments(d)
    return d, s.withColumn("translation", F.concat(F.lit("T:"), "text"))


def test_render_heading_paragraph_quote_code(spark):
    d, a = stub_aligned(spark, G.BASE)
    out = render(d, a).collect()[0].rendered
    assert out == ("# level one\n\n# T:level one\none paragraph `Inline code`\n\nT:one paragraph `Inline code`\n"
                   "```RUST\ncode block\n```\n\n> quote block\n>\n> T:quote block\n\n<a>A</a>\n\nT:A")


def test_render_table_cells(spark):
    d = docs(spark, G.TABLE)
    s = extract_segments(d).withColumn("translation", F.col("text"))
    out = render(d, s).collect()[0].rendered
    assert out == "\n" + G.TABLE_RENDERED + "\n"


def test_render_without_translations_is_the_source(spark):
    d = docs(spark, G.IO_EVENT_QUEUE)
    s = extract_segments(d).withColumn("translation", F.lit(None).cast("string"))
    assert render(d, s).collect()[0].rendered == G.IO_EVENT_QUEUE


def test_keyed_alignment_survives_trimmed_empty_segment(spark):
    text = "![](x.png)\n\nfirst\n\nsecond\n"
    d = docs(spark, text)
    s = extract_segments(d)
    b = B.batch_segments(s, 1000, "chars")
    lines = spark.createDataFrame([(0, 0, 0, "T1"), (0, 0, 1, "T2")], "doc_id long, batch_no int, pos int, line string")
    keyed = {r.seg_no: r.translation for r in A.align_keyed(b, lines).collect()}
    assert keyed == {0: None, 1: "T1", 2: "T2"}
    pos_lines = lines.select("doc_id", F.col("pos").alias("line_no"), "line")
    positional = {r.seg_no: r.translation for r in A.align_positional(s, pos_lines).collect()}
    assert positional == {0: "T1", 1: "T2", 2: None}  # the reference's shift
    rep = A.alignment_report(b, lines).collect()[0]
    assert (rep.n_segments, rep.n_lines, rep.n_missing, rep.n_extra, rep.n_trimmed) == (3, 2, 0, 0, 1)


def test_translate_corpus_job_and_retranslate(spark):
    d = docs(spark, "# Hi\n\nHello there.\n", "plain")
    out = {r.doc_id: r for r in J.translate_corpus(d, J.JobConfig(materialize="persist"), STUB).collect()}
    assert out[0].rendered == "# Hi\n\n# [zh] Hi\n\nHello there.\n\n[zh] Hello there.\n"
    assert out[0].status == "ok" and out[1].rendered == "plain\n\n[zh] plain"
    again = {r.doc_id: r.rendered for r in J.retranslate(d, J.JobConfig(materialize="none"), STUB).collect()}
    assert again[1] == "plain\n\n[zh] plain\n\n[zh] plain\n\n[zh] [zh] plain"


def test_job_with_user_function_and_table(spark):
    d = docs(spark, "one\n\ntwo\n")
    fn = lambda lines, f, t: [x.upper() for x in lines]
    r = J.translate_corpus(d, J.JobConfig(materialize="none"), translator=fn).collect()[0]
    assert r.rendered == "one\n\nONE\n\ntwo\n\nTWO\n"
    mem = spark.createDataFrame([("en", "zh", "one", "一"), ("en", "zh", "one", "一")],
                                "from_lang string, to_lang string, src string, dst string")
    r = J.translate_corpus(d, J.JobConfig(materialize="none"), translator=mem).collect()[0]
    assert r.rendered == "one\n\n一\n\ntwo\n"


def test_whole_document_mode(spark):
    d = docs(spark, "a\n\nb\n")
    r = J.translate_corpus(d, J.JobConfig(limit=0, materialize="none"), STUB).collect()[0]
    assert r.rendered == "a\n\n[zh] a\n\nb\n\n[zh] b\n"


def test_job_plan_has_no_broadcast_and_bounded_shuffles(spark):
    from interlinear.plans import corpora as C
    out = J.translate_corpus(C.sheet_corpus(spark, "/root/testdata/sf0.001"), J.JobConfig(), STUB)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan
    assert plan.count("Exchange hashpartitioning") <= 2


def test_translator_failures_do_not_stop_or_falsify(spark):
    """A failing call, a short and a long answer and a rejected language pair
    leave originals and statuses; the rest is translated."""
    import pytest
    d = docs(spark, "one\n\ntwo\n", "boom\n", "three\n\nextra\n")

    def fn(lines, f, t):
        if "boom" in lines:
            raise RuntimeError("no answer")
        if "extra" in lines:
            return [x.upper() for x in lines] + ["surplus"]
        return [lines[0].upper()]
    got = {r.doc_id: r for r in J.translate_corpus(d, J.JobConfig(materialize="none"), fn).collect()}
    assert got[0].rendered == "one\n\nONE\n\ntwo\n" and got[0].status == "ok"
    assert got[1].rendered == "boom\n" and got[1].status == "failed" and got[1].reason == "RuntimeError: no answer"
    assert got[2].rendered == "three\n\nTHREE\n\nextra\n\nEXTRA\n"
    for translator in (STUB, fn):
        cfg = J.JobConfig(to_lang="auto", materialize="none")
        r = J.translate_corpus(docs(spark, "one\n"), cfg, translator).collect()[0]
        assert (r.rendered, r.status, r.reason) == ("one\n", "failed", "target language cannot be auto")
    with pytest.raises(TypeError):
        J.translate_corpus(d)


def test_each_request_is_asked_once_per_pass(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(lines, f, t):
        with open(log, "a") as out:
            out.write("call\n")
        return [x.upper() for x in lines]
    r = J.retranslate(docs(spark, "one\n"), J.JobConfig(), fn).collect()[0]
    assert r.rendered == "one\n\nONE\n\nONE\n\nONE\n"
    assert len(open(log).readlines()) == 2


def test_cell_translation_with_a_pipe(spark):
    d = docs(spark, "| a |\n| --- |\n| b |\n")
    fn = lambda lines, f, t: [x + "|x\ny" for x in lines]
    r = J.translate_corpus(d, J.JobConfig(materialize="none"), fn).collect()[0]
    assert r.rendered == "|a\ta\\|x y|\n| --- |\n|b\tb\\|x y|\n"


def test_translation_memory_is_deterministic_and_splits_a_hot_line(spark):
    from interlinear.operators import translate as T
    mem = spark.createDataFrame([("en", "zh", "one", x) for x in "cab"], "from_lang string, to_lang string, src string, dst string")
    reqs = spark.range(3000).selectExpr("id as doc_id", "0 as batch_no", "'tencent' as provider", "'en' as from_lang",
                                        "'zh' as to_lang", "array('one', if(id % 50 = 0, cast(id as string), 'one')) as lines")
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        out = T.via_table(reqs.repartition(16), mem)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r.dst[0] == "a" for r in rows) and len(rows) == 3000
    assert "skew=true" in plan


def test_each_distinct_line_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "lines")

    def fn(lines, f, t):
        with open(log, "a") as out:
            out.writelines(x + "\n" for x in lines)
        return [x.upper() for x in lines]
    d = docs(spark, "one\n\ntwo\n\none\n", "two\n\n![](x.png)\n", *["one\n\nown %d\n" % n for n in range(20)], "", None)
    cfg = J.JobConfig(limit=40)
    once = J.translate_each_line_once(d, cfg, fn).collect()
    asked = open(log).read().split("\n")[:-1]
    assert sorted(asked) == sorted(["one", "two", *["own %d" % n for n in range(20)]])
    each = J.translate_corpus(d, cfg, lambda lines, f, t: [x.upper() for x in lines]).collect()
    assert sorted(map(tuple, once), key=str) == sorted(map(tuple, each), key=str)

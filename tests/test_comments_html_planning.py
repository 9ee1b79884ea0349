"""Code comments (C1-C3), HTML text (H1-H2), output planning."""

from made import docs
from pyspark.sql import functions as F

from interlinear.operators import comments as CM
from interlinear.operators import html as H
from interlinear.operators import planning as O

CODEBLOCK = """
```rust, ignored
//! module doc comment

/// doc comment
fn process_epoll_events(&mut self, event_id: usize) {
    // hidden comment
    self.callbacks_to_run.push((event_id, Js::Undefined) /* inline comment */ );
    self.epoll_pending_events -= 1;
}
```
"""

INSERTED = """//! module doc comment
// 模块文档注释

/// doc comment
// 文档注释
fn process_epoll_events(&mut self, event_id: usize) {
    // hidden comment
// 隐藏的注释
    self.callbacks_to_run.push((event_id, Js::Undefined) /* inline comment */
// 行内注释 );
    self.epoll_pending_events -= 1;
}
"""

SCRIPT = """
  <body>
    <script src="index.js"></script>
    <!-- Ancient IE support - load shiv & kill broken highlighter--><!--[if lt IE 9]>
<script src="https://oss.maxcdn.com/html5shiv/3.7.2/html5shiv.min.js"></script>
<script>window.hljs = null;</script>
<![endif]-->
    <!-- GA counter-->
    <script>
      ga('send', 'pageview');
    </script>
    <p>no scirpt from 1</p>
    <div class="container">
      <p>no scirpt from 2</p>
    </div>
  </body>
  <div class="container">
    <p>content outside body</p>
  </div>
"""


def test_code_blocks_and_comment_spans(spark):
    blocks = CM.code_blocks(docs(spark, CODEBLOCK))
    b = blocks.collect()[0]
    assert b.lang == "rust"
    cm = CM.code_comments(blocks).orderBy("idx").collect()
    assert [(r["from"], r["to"]) for r in cm] == [(0, 22), (24, 39), (98, 115), (173, 193)]
    assert "\n".join(r.comment for r in cm) == "! module doc comment\ndoc comment\nhidden comment\n* inline comment */"


def test_insert_comment_translations(spark):
    blocks = CM.code_blocks(docs(spark, CODEBLOCK))
    tr = spark.createDataFrame([(0, 0, i, t) for i, t in enumerate(["模块文档注释", "文档注释", "隐藏的注释", "行内注释"])],
                               "doc_id long, block_no int, idx int, translation string")
    out = CM.insert_comment_translations(blocks, tr).collect()[0].code_out
    assert out == INSERTED


def test_other_languages_are_skipped(spark):
    blocks = CM.code_blocks(docs(spark, "```python\n# x\n```\n"))
    assert CM.code_comments(blocks).count() == 0


def test_html_inner_text_drops_scripts_and_comments(spark):
    pages = spark.createDataFrame([(1, SCRIPT), (2, "<p>hi </p>")], "page_id long, html string")
    got = {r.page_id: r.text for r in H.html_inner_text(pages).collect()}
    assert got[1] == "no scirpt from 1 no scirpt from 2 content outside body"
    tags = H.html_tag_text(pages, "p").filter("page_id = 2").collect()
    assert [t.text for t in tags] == ["hi "]


def test_output_names(spark):
    df = spark.createDataFrame([("/root/test.md", "/root/test/", "/root/test", "name")],
                               "f string, d1 string, d2 string, bare string")
    r = df.select(O.output_file_path("f", F.lit("zh")).alias("a"), O.output_dir_path("d1", F.lit("zh")).alias("b"),
                  O.output_dir_path("d2", F.lit("zh")).alias("c"), O.output_file_path("bare", F.lit("zh")).alias("d"),
                  O.dir_output_path(F.lit("/out-zh"), "f").alias("e")).collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e) == ("/root/test-zh.md", "/root/test-zh", "/root/test-zh", "name-zh", "/out-zh/test.md")


def test_pair_and_skip(spark):
    ins = spark.createDataFrame([(0, "a.md"), (1, "b.md")], "ordinal int, path string")
    outs = spark.createDataFrame([(0, "x.md")], "ordinal int, out_path string")
    st = {r.ordinal: r.status for r in O.pair_inputs_outputs(ins, outs).collect()}
    assert st == {0: "paired", 1: "count_mismatch"}
    work = spark.createDataFrame([("a-zh.md",), ("b-zh.md",)], "out_path string")
    existing = spark.createDataFrame([("a-zh.md",)], "path string")
    todo, skipped = O.skip_existing(work, existing)
    assert [r.out_path for r in todo.collect()] == ["b-zh.md"]
    assert [r.out_path for r in skipped.collect()] == ["a-zh.md"]
    todo, skipped = O.skip_existing(work, existing, replace=True)
    assert todo.count() == 2 and skipped.count() == 0

"""Markdown corpora built from the driver tables by string concatenation.

Each builder is a narrow projection (one input row -> one document row), so
its work grows with the table it reads and it adds no shuffle. The oracles in
``catalog`` compute the expected segments directly from the same source
columns, never by re-parsing Markdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlinear.sources.tables import load

NL = "\n"


def lines_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: every line of ``documents`` becomes its own paragraph."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_replace("text", NL, NL + NL).alias("text"), "lang", "source")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: ``documents`` as is; a document is one paragraph with soft breaks."""
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _turn_key():
    return F.struct(F.col("conv_id"), F.col("turn")).alias("doc_id")


def chat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: one document per conversation turn: ``## role`` then the text."""
    c = load(spark, sf_dir, "conversations")
    return c.select(_turn_key(), F.concat(F.lit("## "), "role", F.lit(NL + NL), "text", F.lit(NL)).alias("text"))


def sheet_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: per event a two-column table, a fenced JSON block and a paragraph."""
    e = load(spark, sf_dir, "events")
    text = F.concat(
        F.lit("| event_type | user_id |" + NL + "| --- | ---: |" + NL + "| "), "event_type", F.lit(" | "),
        F.col("user_id").cast("string"), F.lit(" |" + NL + NL + "```json" + NL), "props",
        F.lit(NL + "```" + NL + NL + "Event "), F.col("event_id").cast("string"), F.lit(NL),
    )
    return e.select(F.col("event_id").alias("doc_id"), text.alias("text"))


def links_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: links, images, a code span, strong text, an empty image and an
    HTML-only link per part."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("["), "p_name", F.lit("](https://example.com/part/"), k, F.lit(") costs `"), "p_brand",
        F.lit("` and !["), "p_type", F.lit("](https://img.example.com/"), k, F.lit('.png "'), "p_type",
        F.lit('") **'), F.col("p_size").cast("string"), F.lit("** units" + NL + NL + "![](https://img.example.com/"),
        k, F.lit(".png)" + NL + NL + '[<img alt="'), "p_type", F.lit('" src="/i/'), k,
        F.lit('.png">](https://example.com/part/'), k, F.lit(")" + NL),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def lists_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F: each line of a turn as a tight list item, then the role as a paragraph."""
    c = load(spark, sf_dir, "conversations")
    items = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(NL), F.lit(NL + "- ")))
    return c.select(_turn_key(), F.concat(items, F.lit(NL + NL), "role", F.lit(NL)).alias("text"))


def tail_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F': heading, then a tight list that ends the document (tail text)."""
    c = load(spark, sf_dir, "conversations")
    items = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(NL), F.lit(NL + "- ")))
    return c.select(_turn_key(), F.concat(F.lit("## "), "role", F.lit(NL + NL), items, F.lit(NL)).alias("text"))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: per supplier a paragraph and a fenced Rust snippet with a line
    comment, a doc comment, a block comment and a string holding ``//``."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("Supplier "), "s_name", F.lit(NL + NL + "```Rust, ignored" + NL + "//! "), "s_name",
        F.lit(" module" + NL + "fn balance() -> i64 {" + NL + "    // nation "), F.col("s_nationkey").cast("string"),
        F.lit(NL + '    let x = "http://example.com/'), k, F.lit('"; /* key '), k,
        F.lit(" */" + NL + "    x" + NL + "}" + NL + "```" + NL),
    )
    return s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


def html_block_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: per labelled document an HTML block (several lines) and a paragraph."""
    lb = load(spark, sf_dir, "labels")
    text = F.concat(
        F.lit('<div class="label">' + NL + "quality "), F.col("quality").cast("string"),
        F.lit(NL + "toxic "), F.col("toxic").cast("string"), F.lit(NL + "</div>" + NL + NL + "Document "),
        F.col("doc_id").cast("string"), F.lit(NL))
    return lb.select("doc_id", text.alias("text"))


def html_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: per supplier a page with a quoted ``>``, comment marks in a script, an
    inline tag inside a word, a numeric reference, nested and unclosed elements."""
    s = load(spark, sf_dir, "supplier")
    html = F.concat(
        F.lit('<html><head><style>p > b {}</style><script>var x="<!--"; if (1 > 0) x = "</p>";</script></head><body><h1 title="a>b">'),
        "s_name", F.lit("</h1><!-- <script> --><div class='c>d'><p>x b<b>ol</b>d"), F.col("s_nationkey").cast("string"),
        F.lit("<p>it&#8217;s <div>"), "s_name", F.lit("</div></div><div>end"))
    return s.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))


def references_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: per part full, collapsed and shortcut reference links and an image by
    reference, an undefined one, and definitions of which one takes three lines."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("["), "p_name", F.lit("][Ref"), k, F.lit("] has ["), "p_brand", F.lit("][] and ["), "p_type", F.lit("] ![pic "), k, F.lit("][ref"), k,
        F.lit("] but [no]" + NL + NL + "[ref"), k, F.lit("]:" + NL + "  <https://example.com/part/"), k, F.lit("> 'title" + NL + "on two lines'" + NL + "["),
        F.upper("p_brand"), F.lit("]: /brand" + NL + "["), "p_type", F.lit('  ]: /type "t"' + NL + "Size "), F.col("p_size").cast("string"), F.lit(NL))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def nested_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: per part a tight list in a quote, in its first item a loose ordered list
    with two paragraphs and a fence, a lazy line, a quote in a quote."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("> - "), "p_name", F.lit(NL + ">   1. "), "p_brand", F.lit(NL + ">" + NL + ">      "), "p_type", F.lit(NL + "lazy "), k,
        F.lit(NL + ">      ```" + NL + ">      - no item" + NL + ">      ```" + NL + "> - size "), F.col("p_size").cast("string"),
        F.lit(NL + ">" + NL + "> > inner "), k, F.lit(NL + NL + "end" + NL))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def cells_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: per part a table whose cells inline markup splits into several pieces."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("| a | b |" + NL + "| --- | --- |" + NL + "| "), "p_name", F.lit(" `"), "p_brand", F.lit("` **"), "p_type", F.lit("** e | [x "), k,
        F.lit("](u"), k, F.lit(") &amp; y \\| z |" + NL))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def emphasis_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: per part nested, overlapping and unmatched delimiter runs."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("***"), "p_name", F.lit("** and "), "p_type", F.lit("* ~~"), k, F.lit("~~ a * b snake_case_x **open __"), "p_type", F.lit("__ [in *"), k,
        F.lit("](u)* foo*bar*baz"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def html_kinds_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: per label row the kinds of HTML block that end by a mark of their own,
    each across a blank line, with a paragraph behind each."""
    lb = load(spark, sf_dir, "labels")
    k = F.col("doc_id").cast("string")
    blocks = ["<!-- a" + NL + NL + "b -->", "<?php a" + NL + NL + "b ?>", "<!DOCTYPE a" + NL + NL + "b>", "<![CDATA[ a" + NL + NL + "b ]]>",
              "<pre>" + NL + NL + "b</pre>", "<div>" + NL + "b" + NL, "<x-y a='1'>" + NL + "b" + NL]
    parts = [c for n, b in enumerate(blocks) for c in (F.lit(b + NL + f"after {n} of "), k, F.lit(NL + NL))]
    return lb.select("doc_id", F.concat(*parts).alias("text"))

"""Fenced code blocks, their C-family comments, and translated comments.

C1 finds fenced code blocks with their language (info string up to the first
comma, lower-cased). C2 finds ``//`` line comments and ``/* */`` block
comments in blocks of language c, c++, cpp or rust, with byte spans; string
literals are consumed first so ``"http://x"`` is not a comment. C3 inserts a
new ``// translation`` line after each comment.

Blocks come from the line classification (``blocks.block_lines``); spans come from an explode of the
block's tokens and a running byte sum -- no per-row scanner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlinear.operators.blocks import block_lines

# Languages whose comments are C-family.
C_FAMILY = ["c", "c++", "cpp", "rust"]

# a string literal (it may span lines), a character literal, a line or block comment
TOKEN = r"\"(?:[^\"\\]++|\\[\s\S])*+\"|'(?:\\[^\n]|[^'\\\n])'|//[^\n]*|/\*[\s\S]*?\*/"


def code_blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, block_no, lang, code)``; code keeps its trailing newline."""
    # fenced blocks only: between their fences, without the fence's own indent
    lines = block_lines(docs, key, text_col).filter("info is not null and kind in ('fence', 'code')")
    g = lines.groupBy(key, "fence_no").agg(
        F.min("info").alias("info"),
        F.expr("array_sort(collect_list(case when kind = 'code' then struct(line_no, concat(case when left(body, fence_ind) = repeat(' ', fence_ind)"
               " then substring(body, fence_ind + 1) else ltrim(' \t', body) end, '\n') as code_line) end))").alias("ls"))
    code = F.array_join(F.transform("ls", lambda x: x["code_line"]), "")
    return g.select(key, (F.col("fence_no") - 1).cast("int").alias("block_no"),
                    F.lower(F.trim(F.split("info", ",")[0])).alias("lang"), code.alias("code"))


def code_comments(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per comment: ``idx``, byte span ``[from, to)`` and the
    comment text stripped of leading slashes and white space."""
    cf = blocks.filter(F.col("lang").isin(*C_FAMILY))
    pieces = F.split(F.col("code"), TOKEN, -1)
    toks = F.regexp_extract_all(F.col("code"), F.lit(TOKEN), 0)
    # piece_i, token_i alternate: lengths of both give every token's offset
    z = cf.select(key, "block_no", F.posexplode(F.arrays_zip(pieces.alias("p"), toks.alias("t"))).alias("i", "z"))
    z = z.select(key, "block_no", "i", F.col("z.t").alias("tok"),
                 (F.octet_length(F.col("z.p")) + F.coalesce(F.octet_length(F.col("z.t")), F.lit(0))).alias("step"),
                 F.octet_length(F.col("z.p")).alias("plen"))
    w = Window.partitionBy(key, "block_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("start", F.coalesce(F.sum("step").over(w), F.lit(0)) + F.col("plen"))
    c = z.filter(F.col("tok").startswith("/"))
    wi = Window.partitionBy(key, "block_no").orderBy("i")
    return c.select(
        key, "block_no", (F.row_number().over(wi) - 1).alias("idx"),
        F.col("start").cast("bigint").alias("from"),
        (F.col("start") + F.octet_length("tok")).cast("bigint").alias("to"),
        F.trim(F.regexp_replace(F.regexp_replace("tok", r"^/+", ""), r"(?U)^\s+|\s+$", "")).alias("comment"),
    )


def insert_comment_translations(blocks: DataFrame, translated: DataFrame, key: str = "doc_id") -> DataFrame:
    """After each comment insert a new line ``// translation``.

    ``translated(key, block_no, idx, translation)``. The block is cut at the
    comment ends and re-joined with the inserted lines (bytes before the
    first comment end, then each comment's following slice).
    """
    cm = code_comments(blocks, key).join(translated.hint("merge"), [key, "block_no", "idx"], "left")
    g = cm.groupBy(key, "block_no").agg(F.array_sort(F.collect_list(F.struct("idx", "to", "translation"))).alias("cs"))
    j = blocks.join(g.hint("merge"), [key, "block_no"], "left")
    raw = F.encode("code", "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("cs", lambda x: x["to"]))
    # slice k runs from ends[k] to ends[k+1] (the last one to the end)
    n = F.size("cs")
    slices = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        F.decode(F.substring(raw, (F.element_at(ends, k + 1) + 1).cast("int"),
                             F.when(k < n, F.element_at(ends, k + 2) - F.element_at(ends, k + 1))
                             .otherwise(F.length(raw)).cast("int")), "UTF-8").alias("s"),
        F.when(k < n, F.concat(F.lit("\n// "), F.coalesce(F.element_at("cs", k + 1)["translation"], F.lit(""))))
        .otherwise(F.lit("")).alias("ins")))
    out = F.when(F.col("cs").isNull(), F.col("code")).otherwise(
        F.array_join(F.transform(slices, lambda x: F.concat(x["s"], x["ins"])), ""))
    return j.select(key, "block_no", "lang", out.alias("code_out"))

"""A1-A5: put translated lines back on their segments.

Positional (A1) is the reference behaviour: the k-th line of a document's
flattened responses goes to its k-th segment, so one failed or trimmed batch
shifts every later translation. Keyed (A2, the default) joins on
(document, batch, line-in-batch), so a bad batch only loses its own lines.
Both are equi-joins on keys that start with the document key, so they reuse
the document partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlinear.functions.text import sql_str, utrim
from interlinear.operators.render import item_sql

_TEXT = r"(?U)\S"


def align_positional(segs: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A1: ``lines(key, line_no, line)`` numbered over the whole document
    (see ``responses.response_lines``) -> ``translation`` per segment."""
    s = segs.filter(~F.col("is_tail"))
    t = lines.select(key, F.col("line_no").alias("seg_no"), F.col("line").alias("translation"))
    return s.join(t.hint("merge"), [key, "seg_no"], "left")


def batch_line_keys(batched: DataFrame, key: str = "doc_id") -> DataFrame:
    """For segments with ``batch_no``: the position ``pos`` of the segment's
    line in its batch's trimmed request, or null when trimming removed it
    (blank segments at either end of the batch)."""
    w = Window.partitionBy(key, "batch_no")
    nb = utrim("text") != ""
    first_nb = F.min(F.when(nb, F.col("seg_no"))).over(w)
    last_nb = F.max(F.when(nb, F.col("seg_no"))).over(w)
    pos = F.when((F.col("seg_no") >= first_nb) & (F.col("seg_no") <= last_nb), F.col("seg_no") - first_nb)
    return batched.withColumn("pos", pos.cast("int"))


def align_keyed(batched: DataFrame, resp_lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2: join on (key, batch_no, pos); ``resp_lines(key, batch_no, pos, line)``."""
    s = batch_line_keys(batched, key)
    t = resp_lines.select(key, "batch_no", "pos", F.col("line").alias("translation"))
    return s.join(t.hint("merge"), [key, "batch_no", "pos"], "left")


def _aligned(resp: DataFrame, key: str) -> DataFrame:
    """``resp`` rows with their segments and translations as the array ``aligned``.

    ``resp`` rows are batches carrying their ``segs`` (see ``batching.batch_text``)
    and the parsed ``dst`` lines (null when the batch failed). Blank segments at
    either end of a batch were trimmed out of the request, so line j goes to the
    j-th segment from the first non-blank one."""
    nb = f"transform(segs, x -> x.text rlike {sql_str(_TEXT)})"
    # first/last non-blank position, once per batch (not once per element)
    r = resp.selectExpr("*", f"{nb} as __nb")
    r = r.selectExpr("*", "cast(array_position(__nb, true) as int) as __f",
                     "cast(size(segs) - array_position(reverse(__nb), true) + 1 as int) as __l")
    inside = "__f > 0 and i + 1 >= __f and i + 1 <= __l"
    reason = "reason" if "reason" in resp.columns else "cast(null as string) as reason"
    return r.selectExpr(
        f"`{key}`", "batch_no", reason,
        f"transform(segs, (x, i) -> named_struct('seg', x, 'translation',"
        f" case when dst is not null and {inside} then try_element_at(dst, i + 2 - __f) end,"
        f" 'pos', case when {inside} then i + 1 - __f end, 'batch_ok', dst is not null)) as aligned")


def align_in_batches(resp: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2 without a join: one explode per batch gives every segment with its
    ``translation`` (null for trimmed segments and failed batches)."""
    out = _aligned(resp, key).selectExpr(f"`{key}`", "batch_no", "reason", "explode(aligned) as e")
    seg_cols = [f.name for f in resp.schema["segs"].dataType.elementType.fields]
    return out.selectExpr(f"`{key}`", "batch_no", *[f"e.seg.`{c}` as `{c}`" for c in seg_cols],
                          "cast(e.pos as int) as pos", "e.translation as translation", "false as is_tail",
                          "e.batch_ok as batch_ok", "reason")


def gather_in_batches(resp: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2 for rendering: ``(key, items)``, a document's segments with what
    ``render.assemble`` reads of them, gathered batch by batch."""
    items = f"transform(aligned, e -> {item_sql('e.seg.', 'e.translation', 'e.batch_ok')}) as items"
    return _aligned(resp, key).selectExpr(f"`{key}`", items).groupBy(key).agg(F.flatten(F.collect_list("items")).alias("items"))


def report_in_batches(resp: DataFrame, key: str = "doc_id") -> DataFrame:
    """A5 from batch rows: segments, lines returned, missing, extra, trimmed."""
    nb = f"transform(segs, x -> x.text rlike {sql_str(_TEXT)})"
    first = f"array_position({nb}, true)"
    sent = f"case when {first} > 0 then size(segs) - array_position(reverse({nb}), true) + 2 - {first} else 0 end"
    lines = "coalesce(size(dst), 0)"
    return resp.selectExpr(
        f"`{key}`", "batch_no", "cast(size(segs) as bigint) as n_segments", f"cast({lines} as bigint) as n_lines",
        f"cast(greatest({sent} - {lines}, 0) as bigint) as n_missing",
        f"cast(greatest({lines} - {sent}, 0) as bigint) as n_extra",
        f"cast(size(segs) - {sent} as bigint) as n_trimmed")


def missing_translation(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """A3: segments left with the original only."""
    return aligned.filter(F.col("translation").isNull())


def extra_translation(segs: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A4: response lines that no segment takes (positional numbering)."""
    s = segs.filter(~F.col("is_tail")).select(key, F.col("seg_no").alias("line_no"))
    return lines.join(s.hint("merge"), [key, "line_no"], "left_anti")


def alignment_report(batched: DataFrame, resp_lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A5: per document and batch: segments, lines, missing and extra, and
    the blank segments trimmed out of the request (never sent, so not missing)."""
    s = batch_line_keys(batched, key).select(key, "batch_no", "pos", F.lit(1).alias("has_seg"))
    t = resp_lines.select(key, "batch_no", "pos", F.lit(1).alias("has_line"))
    j = s.join(t.hint("merge"), [key, "batch_no", "pos"], "full_outer")
    seg, line, pos = F.col("has_seg").isNotNull(), F.col("has_line").isNotNull(), F.col("pos").isNotNull()
    return j.groupBy(key, "batch_no").agg(
        F.sum(F.when(seg, 1).otherwise(0)).cast("bigint").alias("n_segments"),
        F.sum(F.when(line, 1).otherwise(0)).cast("bigint").alias("n_lines"),
        F.sum(F.when(seg & pos & ~line, 1).otherwise(0)).cast("bigint").alias("n_missing"),
        F.sum(F.when(~seg & line, 1).otherwise(0)).cast("bigint").alias("n_extra"),
        F.sum(F.when(seg & ~pos, 1).otherwise(0)).cast("bigint").alias("n_trimmed"),
    )

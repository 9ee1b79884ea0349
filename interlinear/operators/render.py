"""Two-language documents: each block followed by its translation.

Source lines are kept verbatim (code, HTML, rules, tight lists pass through,
A9). After the last line of a translated paragraph come a blank line and the
translation with the same quote/list prefix (A6); a heading is repeated at
its level with the translation (A7); a table row is rebuilt with
``cell<TAB>translation`` in each translated cell (A8). The document is then
assembled in line order (A10).

A document's text meets its gathered segments as one row (an equi-join on the
key), and one Arrow step splits it into lines (no block classification again)
and writes it; nothing is exploded to lines and grouped again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlinear.functions.inline import CARRY, CODE_SPAN, DEST, TAG
from interlinear.functions.java_regex import java
from interlinear.operators.blocks import _BAR, _LAST_BAR, _cell_texts, _split
from interlinear.operators.segments import lists, texts_by_key, trimmed
from interlinear.session import ship, use_document_partitioning

_DOCUMENT = {"rendered": pa.string(), "n_segments": pa.int64(), "n_failed": pa.int64(), "reason": pa.string()}

# markup of a cell that is no text: escapes' backslashes, code, tags, link destinations
_NO_TEXT = java(rf"\\(?=[!-/:-@\[-`{{-~])|{CODE_SPAN}|{TAG}|(?<=\]){DEST}")
_MAY_BE_NO_TEXT = re.compile(r"[\\`<\]]")
_LEAD, _QUOTES, _BREAK = java(r"^[ \t]*(>[ ]?)*[ \t]*\|"), java(r"^((?: {0,3}>[ ]?)*)"), re.compile("\r?\n")


def _with_pieces(cell: str, own: list[tuple]) -> str:
    """A cell with a TAB and the translation behind each piece of its text. The
    pieces are found one after the other, in a copy whose other markup is blanked."""
    cell = cell.replace("\\|", "|")
    masked = _NO_TEXT.sub(lambda m: CARRY * len(m[0]), cell) if _MAY_BE_NO_TEXT.search(cell) else cell
    out, at = [], 0
    for _, _, src, translation in own:
        found = masked.find(src, at)
        end = at if found < 0 else found + len(src)
        out += cell[at:end], "\t", _BREAK.sub(" ", translation) if "\n" in translation else translation
        at = end
    built = "".join(out) + cell[at:]
    return _BAR.sub(r"\\|", built) if "|" in built else built


def _rebuilt(line: str, cells: list[tuple]) -> str:
    """The row's cells (split on unescaped pipes) with translations."""
    quoted = ">" in line
    parts = _BAR.split(_LAST_BAR.sub("", _LEAD.sub("", line))) if quoted else _cell_texts(line)
    for n, cell in enumerate(parts):
        own = [x for x in cells if x[0] == n + 1]
        parts[n] = _with_pieces(trimmed(cell), own) if own else trimmed(cell)
    return f"{_QUOTES.match(line)[1] if quoted else ''}|{'|'.join(parts)}|"


def _inserts(own: list[tuple]) -> dict[int, tuple]:
    """Per source line: what is put behind it, translated cells (sub, piece, src, translation),
    how many segments end there, how many of them lost their translation to a
    failed batch, and why."""
    out: dict[int, tuple] = {}
    for block_no, seg_no, sub, piece, src, insert, ok, reason in own:
        here = out.get(block_no)
        if here is None:
            here = out[block_no] = ([], [], [], [])
        if insert is not None:
            if src is None:
                here[0].append((seg_no, insert))
            else:
                here[1].append((sub, piece, src, insert))
        here[2].append(ok)
        if reason is not None:
            here[3].append(reason)
    for add, cells, _, _ in out.values():
        add.sort()
        cells.sort()
    return out


def _document(texts: list[str], own: list[tuple]) -> tuple:
    """(rendered, n_segments, n_failed, reason) of a key's texts; the lines of
    several texts with one key come in turn, each with all that belongs to it."""
    inserts, out = _inserts(own), []
    size = failed = 0
    why = None
    for text in texts:
        for n, line in enumerate(_split(text)):
            here = inserts.get(n)
            if here is None:
                out.append((n, [line]))
                continue
            add, cells, ok, reasons = here
            out.append((n, [_rebuilt(line, cells) if cells else line, *[x for _, x in add]]))
            size, failed = size + len(ok), failed + ok.count(False)
            why = max([*reasons, why] if why else reasons) if reasons else why
    if len(texts) > 1:
        out.sort()
    return "\n".join([x for _, lines in out for x in lines]), size, failed, why


def _values(column: pa.Array) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_numpy(zero_copy_only=False).tolist() if column.null_count == 0 and pa.types.is_integer(column.type) else column.to_pylist()


def _tuples(items: pa.StructArray) -> list[tuple]:
    return list(zip(*map(_values, items.flatten())))


def _assembled(texts: pa.Array, items: pa.Array) -> pa.Array:
    rows = [_document(t, x) for t, x in zip(lists(texts), lists(items, _tuples))]
    columns = zip(*rows) if rows else [[]] * len(_DOCUMENT)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _DOCUMENT.values())], names=list(_DOCUMENT))


def item_sql(seg: str = "", translation: str = "translation", ok: str = "batch_ok", reason: str = "reason") -> str:
    """A segment as ``assemble`` reads it; ``seg``: where its columns are. ``src``
    marks a cell, ``insert`` is its translation or what comes behind the line."""
    c = lambda name: f"{seg}{name}"
    insert = (f"case when {c('kind')} = 'cell' then {translation} when {c('kind')} = 'heading' then"
              f" concat(rtrim({c('prefix')}), '\\n', {c('prefix')}, repeat('#', {c('level')}), ' ', {translation})"
              f" else concat(rtrim({c('prefix')}), '\\n', {c('prefix')}, {translation}) end")
    return (f"struct({c('block_no')} as block_no, {c('seg_no')} as seg_no, {c('sub')} as sub, {c('piece')} as piece,"
            f" case when {c('kind')} = 'cell' then {c('src')} end as src, {insert} as insert, coalesce({ok}, false) as ok, {reason} as reason)")


def gather(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, items)``: a document's aligned segments with what ``assemble`` reads of them."""
    a = aligned.filter(~F.col("is_tail"))
    item = item_sql(ok="batch_ok" if "batch_ok" in a.columns else "translation is not null",
                    reason="reason" if "reason" in a.columns else "cast(null as string)")
    return a.groupBy(key).agg(F.expr(f"collect_list({item})").alias("items"))


def assemble(docs: DataFrame, gathered: DataFrame, key: str = "doc_id", text_col: str = "text",
             distribute: bool = True) -> DataFrame:
    """Documents and their gathered segments -> one rendered document a key."""
    use_document_partitioning(docs.sparkSession)
    ship(docs.sparkSession)
    # both sides grow with the corpus: never broadcast, co-partitioned merge join
    both = texts_by_key(docs, key, text_col, distribute).filter("size(texts) > 0").join(gathered.hint("merge"), key, "left")
    step = F.arrow_udf(_assembled, "struct<rendered: string, n_segments: bigint, n_failed: bigint, reason: string>").asNondeterministic()
    none = F.array().cast(gathered.schema["items"].dataType)
    doc = both.select(key, step("texts", F.coalesce("items", none)).alias("d")).select(key, "d.*")
    status = (F.when(F.col("n_segments") == 0, F.lit("empty")).when(F.col("n_failed") == 0, F.lit("ok"))
              .when(F.col("n_failed") < F.col("n_segments"), F.lit("partial")).otherwise(F.lit("failed")))
    return doc.select(key, "rendered", "n_segments", "n_failed", status.alias("status"), "reason")


def render(docs: DataFrame, aligned: DataFrame, key: str = "doc_id", text_col: str = "text",
           distribute: bool = True) -> DataFrame:
    """Documents + aligned segments -> ``(key, rendered)`` with the document's
    ``n_segments``, ``n_failed``, ``status`` and ``reason``.

    The per-document assembly holds one document's segments -- the same
    size as the document row it came from (plus its translation).
    """
    return assemble(docs, gather(aligned, key), key, text_col, distribute)

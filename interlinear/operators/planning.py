"""Output naming, pairing, skipping and writing.

All of it is projection and joins on path keys; the listing of existing
outputs is a DataFrame (e.g. from ``binaryFile`` with only the ``path``
column selected), never a driver-side set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_file_path(path, to_lang) -> "F.Column":
    """O1: ``dir/stem.ext`` -> ``dir/stem-{to}.ext``; a name without an
    extension gets ``-{to}`` appended (no failure)."""
    p = F.col(path) if isinstance(path, str) else path
    t = F.col(to_lang) if isinstance(to_lang, str) else to_lang
    has_ext = p.rlike(r"[^/]\.[^./]+$")
    return F.when(has_ext, F.concat(F.regexp_extract(p, r"^(.*)(\.[^./]+)$", 1), F.lit("-"), t,
                                    F.regexp_extract(p, r"^(.*)(\.[^./]+)$", 2))) \
            .otherwise(F.concat(p, F.lit("-"), t))


def output_dir_path(path, to_lang) -> "F.Column":
    """O2: ``dir/name/`` or ``dir/name`` -> ``dir/name-{to}``; a trailing
    ``.ext`` of the last component is cut (file-stem semantics)."""
    p = F.col(path) if isinstance(path, str) else path
    t = F.col(to_lang) if isinstance(to_lang, str) else to_lang
    trimmed = F.regexp_replace(p, r"/+$", "")
    stem = F.regexp_replace(trimmed, r"([^/])\.[^./]*$", "$1")
    return F.concat(stem, F.lit("-"), t)


def dir_output_path(out_dir, path) -> "F.Column":
    """O3: output of a file found in a directory = output dir / same name."""
    d = F.col(out_dir) if isinstance(out_dir, str) else out_dir
    p = F.col(path) if isinstance(path, str) else path
    return F.concat(d, F.lit("/"), F.element_at(F.split(p, "/"), -1))


def pair_inputs_outputs(inputs: DataFrame, outputs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Explicit outputs paired with inputs by position (``ordinal``).

    A full outer equi-join on the ordinal; unpaired rows on either side mean
    the counts differ, reported per row as ``status='count_mismatch'``.
    """
    j = inputs.join(outputs.hint("merge"), ordinal, "full_outer")
    bad = F.col("path").isNull() | F.col("out_path").isNull()
    return j.withColumn("status", F.when(bad, F.lit("count_mismatch")).otherwise(F.lit("paired")))


def skip_existing(work: DataFrame, existing: DataFrame, replace: bool = False,
                  out_col: str = "out_path") -> tuple[DataFrame, DataFrame]:
    """(to_do, skipped). With ``replace`` off, items whose output already
    exists become skipped (left_semi) and are dropped from the work list
    (left_anti) before any content is used."""
    ex = existing.select(F.col("path").alias(out_col)).distinct()
    if replace:
        return work, work.limit(0)
    todo = work.join(ex.hint("merge"), out_col, "left_anti")
    skipped = work.join(ex.hint("merge"), out_col, "left_semi")
    return todo, skipped


def mark_existing(work: DataFrame, existing: DataFrame, replace: bool = False,
                  out_col: str = "out_path") -> DataFrame:
    """O5 in one pass: every work item with ``status`` 'skip' (its output
    exists and replace is off) or 'todo' -- a left equi-join on the output
    path against the distinct existing paths."""
    ex = existing.select(F.col("path").alias(out_col), F.lit(True).alias("_exists")).distinct()
    j = work.join(ex.hint("merge"), out_col, "left")
    skip = F.col("_exists").isNotNull() & F.lit(not replace)
    return j.withColumn("status", F.when(skip, F.lit("skip")).otherwise(F.lit("todo"))).drop("_exists")


def write_rendered(rendered: DataFrame, out: str, mode: str = "overwrite",
                   path_col: str = "out_path", content_col: str = "rendered") -> None:
    """Write ``(out_path, content)`` rows as a parquet table (atomic per
    task commit, safe to re-run), partitioned by nothing that grows."""
    rendered.select(path_col, content_col).write.mode(mode).parquet(out)


def export_files(rendered: DataFrame, path_col: str = "out_path", content_col: str = "rendered") -> None:
    """O6 (file form): one UTF-8 file per document, written by the executors.

    Paths are plain or ``file:`` paths on a file system that every executor
    can write (a shared mount); any other scheme is an error, use
    ``write_rendered`` there. Each attempt writes its own temporary file and
    renames it, so retried and speculative tasks are harmless.
    """
    def write_part(rows):
        import os
        import re
        import uuid
        for r in rows:
            p, c = r[path_col], r[content_col]
            if p is None or c is None:
                continue
            scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", p)
            if scheme and scheme[1] != "file":
                raise ValueError(f"export_files writes plain or file: paths, not {p!r}")
            p = re.sub(r"^file:/*", "/", p)
            os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
            tmp = f"{p}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(c)
            os.replace(tmp, p)

    rendered.select(path_col, content_col).foreachPartition(write_part)

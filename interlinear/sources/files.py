"""Documents from files, directories and inline text.

Files are read with Spark's ``binaryFile`` source (one row per file, read by
the executors), checked for valid UTF-8 with a native expression and decoded.
The ``text`` source with ``wholetext`` would silently turn bad bytes into
U+FFFD, which is why it is not used for S1. Names are listed on the driver
(they are the asked work list); contents are read by the executors. A file over
``RANGE`` bytes is checked in ranges, by many tasks; only if all of them are
valid is it read whole, as its one row needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlinear.session import ship

RANGE = 64 << 20  # bytes of a file that one task checks
BLOCK = 1 << 20   # bytes that it holds
DOC_COLS = ["path", "doc_kind", "content", "status"]


def _decode(df: DataFrame, kind: str) -> DataFrame:
    ok = F.is_valid_utf8(F.col("content"))
    return df.select(
        F.col("path"), F.lit(kind).alias("doc_kind"),
        F.when(ok, F.decode(F.col("content"), "UTF-8")).alias("content"),
        F.when(ok, F.lit("normal")).otherwise(F.lit("invalid_utf8")).alias("status"),
        F.col("length").alias("n_bytes"),
    )


_EMPTY = "path string, doc_kind string, content string, status string, n_bytes bigint"


def _listed(spark: SparkSession, paths: list[str], keep=lambda name: True) -> list[tuple[str, str, int]]:
    """(asked path, file path, bytes) of files, by the Hadoop file system: also
    hidden and empty ones, which Spark's readers leave out. A directory gives
    its own files only. A path that is not there gives (path, None, 0)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for asked in paths:
        path = jvm.org.apache.hadoop.fs.Path(asked)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            out.append((asked, None, 0))
            continue
        for f in fs.listStatus(path):
            if f.isFile() and keep(f.getPath().getName()):
                out.append((asked, f.getPath().toString(), f.getLen()))
    return out


def _open(path: str):
    import re

    from pyarrow import fs
    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return system.open_input_file(place)


def _read_hidden(batches):
    import pandas as pd
    for names in batches:
        read = []
        for path in names["path"]:
            with _open(path) as f:
                read.append(f.read())
        yield pd.DataFrame({"path": names["path"], "content": read, "length": [len(c) for c in read]})


def _valid_range(f, start: int, end: int) -> bool:
    """Whether the characters that start in a range are valid UTF-8. The bytes
    that go on a character at the range's start are left to the range before,
    which reads past its own end for them."""
    goes_on = lambda at: next((n for n, x in enumerate(f.read_at(4, at)) if x & 0xC0 != 0x80), min(4, f.size() - at))
    skip, more = goes_on(start) if start else 0, goes_on(end)
    if max(skip, more) > 3:  # no character has four of them
        return False
    from codecs import getincrementaldecoder
    decoder, at = getincrementaldecoder("utf-8")(), start + skip
    try:
        while at < end + more:
            block = f.read_at(min(BLOCK, end + more - at), at)
            if not block:
                raise OSError("file became shorter while it was read")
            decoder.decode(block)
            at += len(block)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def _check_ranges(batches):
    import pandas as pd
    for rows in batches:
        ok = []
        for path, start, end in zip(rows["path"], rows["start"], rows["end"]):
            with _open(path) as f:
                ok.append(_valid_range(f, int(start), int(end)))
        yield pd.DataFrame({"asked": rows["asked"], "path": rows["path"], "length": rows["length"], "ok": ok})


def _read_valid(batches):
    import pandas as pd
    for rows in batches:
        for path, length, ok in zip(rows["path"], rows["length"], rows["ok"]):
            content = None
            if ok:
                with _open(path) as f:
                    content = f.read()
            yield pd.DataFrame({"path": [path], "content": [content], "length": [length], "ok": [ok]})


def _load_large(spark: SparkSession, large: list[tuple[str, int]], kind: str) -> DataFrame:
    ship(spark)
    n = sum(-(-length // RANGE) for _, length in large)
    files = [(i, path, length) for i, (path, length) in enumerate(large)]  # a path may be asked twice
    ranges = spark.createDataFrame(files, "asked bigint, path string, length bigint").selectExpr(
        "*", f"explode(sequence(0L, length - 1, {RANGE}L)) as start").selectExpr(
        "*", f"least(start + {RANGE}, length) as end").repartition(min(n, 10_000))
    checked = ranges.mapInPandas(_check_ranges, "asked bigint, path string, length bigint, ok boolean")
    checked = checked.groupBy("asked", "path", "length").agg(F.min("ok").alias("ok"))
    # a valid file is one row; a task of its own for each, as far as that goes
    read = checked.repartition(min(len(large), 10_000), "asked").mapInPandas(
        _read_valid, "path string, content binary, length bigint, ok boolean")
    return read.select(
        "path", F.lit(kind).alias("doc_kind"), F.decode("content", "UTF-8").alias("content"),
        F.when(F.col("ok"), F.lit("normal")).otherwise(F.lit("invalid_utf8")).alias("status"), F.col("length").alias("n_bytes"))


def _load(spark: SparkSession, found: list[tuple[str, str, int]], kind: str) -> DataFrame:
    """Contents of listed files. Spark's readers skip names that start with a
    dot or an underscore; the executors read those through Arrow's file systems."""
    full = [p for _, p, n in found if p is not None and 0 < n <= RANGE]
    large = [(p, n) for _, p, n in found if p is not None and n > RANGE]
    rest = [(a if p is None else p, "missing" if p is None else "normal") for a, p, n in found if p is None or not n]
    empty = spark.createDataFrame([(p, kind, "" if s == "normal" else None, s, 0) for p, s in rest], _EMPTY)
    hidden = [p for p in full if p.rsplit("/", 1)[1][:1] in "._"]
    shown = [p for p in full if p.rsplit("/", 1)[1][:1] not in "._"]
    out = empty
    if shown:
        out = out.unionByName(_decode(spark.read.format("binaryFile").load(shown), kind))
    if hidden:
        names = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(min(len(hidden), 64))
        out = out.unionByName(_decode(names.mapInPandas(_read_hidden, "path string, content binary, length bigint"), kind))
    if large:
        out = out.unionByName(_load_large(spark, large, kind))
    return out


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Explicit paths, any extension, each file one document: also empty
    and hidden files. A path without a file is a row with status ``missing``."""
    return _load(spark, _listed(spark, paths), "file") if paths else spark.createDataFrame([], _EMPTY)


def read_dir(spark: SparkSession, dirs: list[str], extension: str = "md") -> DataFrame:
    """One directory level, names with exactly this extension
    (case-sensitive), no recursion; sub-folders of any name are ignored, hidden
    and empty files are read."""
    if not dirs:
        return spark.createDataFrame([], _EMPTY)
    return _load(spark, _listed(spark, dirs, lambda name: name.endswith("." + extension) and len(name) > len(extension) + 1), "dir")


def inline_docs(items: DataFrame, request_col: str = "request_id", pos_col: str = "pos",
                text_col: str = "text") -> DataFrame:
    """S3: the inline strings of one request, in order, joined by a blank line
    into ONE document. The group is one request's strings (command-line
    input), and the output row holds exactly that text."""
    g = items.groupBy(request_col).agg(F.array_sort(F.collect_list(F.struct(pos_col, text_col))).alias("xs"))
    return g.select(request_col, F.array_join(F.transform("xs", lambda x: x[text_col]), "\n\n").alias("content"),
                    F.lit("query").alias("doc_kind"))


def work_list(*sources: DataFrame) -> DataFrame:
    """Union of files, directory files and inline documents."""
    out = None
    for s in sources:
        s = s.select(*[c for c in ("path", "doc_kind", "content", "status") if c in s.columns])
        for c in ("path", "status"):
            if c not in s.columns:
                s = s.withColumn(c, F.lit("normal") if c == "status" else F.lit(None).cast("string"))
        s = s.select("path", "doc_kind", "content", "status")
        out = s if out is None else out.unionByName(s)
    return out

"""Benchmark decontamination with an FM-index per shard of documents.

Benchmark items are a stated query set: they are collected in blocks of
bounded size and every block is searched in all documents. A shard of
documents (at most ``SHARD_WORDS`` words) becomes an FM-index over word
numbers; all windows of the block are searched backwards at once through
wavelet ranks, occurrences are located by sampled positions, and their spans
are merged per document. Words outside the block's vocabulary can't be part of
an occurrence, so the index covers just the runs of vocabulary words that are
as long as the shortest window; all words are counted.

Words: ASCII letters lower-cased, maximal runs of ASCII letters, digits and
non-ASCII characters. Null or empty text has no words. Null or repeated ids
are kept, one row per input row. Items without words can't occur; rows of one
item id are one item, a null item id reads as ''. With an empty benchmark
nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_step, numbered, utf8
from .fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 8_000_000  # benchmark text collected at a time
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """Distinct windows of a block of items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {name: n for n, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple, set[int]] = {}
        for name, text in items:
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(len(coded) - size + 1, 1)):
                if part := tuple(coded[at:at + size]):
                    of.setdefault(part, set()).add(number[name])
        self.lengths = np.array([len(p) for p in of], np.int64)
        self.patterns = np.zeros((len(of), size), np.int64)
        for n, part in enumerate(of):
            self.patterns[n, size - len(part):] = part
        owners = [sorted(o) for o in of.values()]
        self.owners = np.array([o for own in owners for o in own], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + count)."""
    total = np.cumsum(counts)
    return np.repeat(starts - total + counts, counts) + np.arange(total[-1] if len(total) else 0)


def search_shard(texts: list[list[bytes]], windows: Windows) -> tuple[list[int], list[list[str]], list[list[dict]]]:
    """Per document of a shard: words hit, items found, merged spans."""
    n_docs = len(texts)
    hits, items, spans = [0] * n_docs, [[] for _ in texts], [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, n_docs)
    if not len(windows.lengths) or not sizes.sum():
        return hits, items, spans
    get = windows.vocabulary.get
    coded = np.fromiter((c for t in texts for c in map(get, t, repeat(0))), np.int64, int(sizes.sum()))
    doc_at = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(coded) + 1, bool)
    edge[doc_at] = True
    known = coded > 0
    begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = ends - begins >= windows.lengths.min()
    begins, counts = begins[long], (ends - begins)[long]
    if not len(begins):
        return hits, items, spans
    # the indexed sequence: a separator before every run; source is -1 there
    source = np.full(int(counts.sum()) + len(counts), -1, np.int64)
    source[np.arange(len(source))[_ranges(np.cumsum(counts + 1) - counts, counts)]] = _ranges(begins, counts)
    index = FMIndex(np.where(source >= 0, coded[source], 0))
    who, low, high = index.search(windows.patterns, windows.lengths)
    if not len(who):
        return hits, items, spans
    which = np.repeat(who, high - low)
    place = source[index.locate(_ranges(low, high - low))]
    cover = np.zeros(len(coded) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.lengths[which], -1)
    hit = np.cumsum(cover)[:-1] > 0
    doc = np.searchsorted(doc_at, place, "right") - 1
    owned = windows.owner_at[which + 1] - windows.owner_at[which]
    pairs = np.unique(np.repeat(doc, owned) * len(windows.names) + windows.owners[_ranges(windows.owner_at[which], owned)])
    for d, i in zip((pairs // len(windows.names)).tolist(), (pairs % len(windows.names)).tolist()):
        items[d].append(windows.names[i])
    first = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stop = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    owner = np.searchsorted(doc_at, first, "right") - 1
    for d, s, n in zip(owner.tolist(), (first - doc_at[owner]).tolist(), (stop - first).tolist()):
        spans[d].append({"start": s, "length": n})
        hits[d] += n
    return hits, items, spans


def find(docs: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    """One block of items against all documents: the columns of ``docs`` without
    ``utf8``, its last one, and what was found in it."""
    kept = docs.columns[:-1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items)
        for b in batches:
            texts, at = b.column(len(kept)).to_pylist(), 0
            while at < len(texts):
                shard, total, first = [], 0, at
                while at < len(texts) and (not shard or total + len(texts[at]) // 2 <= SHARD_WORDS):
                    shard.append(words(texts[at]))
                    total += len(shard[-1])
                    at += 1
                hits, found, spans = search_shard(shard, windows)
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(first, len(shard)).columns[:-1], pa.array([len(t) for t in shard], pa.int64()),
                     pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                    names=[*kept, *FOUND.names])

    return arrow_step(docs, step, T.StructType([*docs.schema.fields[:-1], *FOUND.fields]))


def _search(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """All blocks of the benchmark against ``docs``, whose columns come out as
    c0, c1, ... (no name can clash), with the found columns and contaminated."""
    own = [f"c{n}" for n in range(len(docs.columns))]
    rows = docs.toDF(*own).withColumn("utf8", utf8(own[docs.columns.index(text_col)]))
    queries = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                               utf8(item_text_col).alias("text")).distinct()
    size = queries.agg(F.sum(F.length("text") + F.length("item"))).first()[0] or 0
    n_blocks = 1 + size // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    items = lambda n: [(r.item, bytes(r.text)) for r in queries.where(block == n).collect()]
    if n_blocks == 1:
        found = find(rows, items(0))
    else:  # the same document in several blocks: unite what they hit, by row numbers that stay
        rows = numbered(rows, "texts")
        each = find(rows.select("row", "utf8"), items(0))
        for n in range(1, n_blocks):
            each = each.union(find(rows.select("row", "utf8"), items(n)))
        found = rows.drop("utf8").join(each.groupBy("row").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            merged_spans(F.flatten(F.collect_list("spans"))).alias("spans")), "row").drop("row")
        found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.length))
    return (found.withColumn("items", F.array_sort("items"))
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))


def merged_spans(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones united."""
    one = "array<struct<start: bigint, length: bigint>>"
    join = lambda done, s: F.when(
        (F.size(done) > 0) & (s.start <= F.element_at(done, -1).start + F.element_at(done, -1).length),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(done, -1).start.alias("start"),
            (F.greatest(F.element_at(done, -1).start + F.element_at(done, -1).length, s.start + s.length)
             - F.element_at(done, -1).start).alias("length"))))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(one), lambda done, s: join(done, s).cast(one))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids), spans
    (merged, in words) and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    found = _search(rows, rows.columns[1], benchmark, item_col, item_text_col)
    return found.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", "items", "spans", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows; what stays is unchanged."""
    found = _search(docs, text_col, benchmark, item_col, item_text_col).where("not contaminated")
    return found.select(*[f"c{n}" for n in range(len(docs.columns))]).toDF(*docs.columns)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    flat = text.translate(_WORD_BYTES)
    offsets, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        offsets.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for start, length in spans:
        out.append(text[done:offsets[start][0]])
        done = offsets[start + length - 1][1]
    return b"".join([*out, text[done:]])

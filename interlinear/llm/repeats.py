"""Exact removal of long repeated byte strings, by sorting sampled suffixes and
inducing the rest.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else, in the same or another document; strings never cross documents.

* **Sample.** Every window of LENGTH bytes picks one *anchor* in it: the
  position of the GRAM-byte string with the smallest hash, the last one on a
  tie. The choice depends on the window's bytes alone, so equal windows pick
  the same place, and an anchor is picked by a run of neighbouring windows
  (about 77). One tuple per anchor goes on: name of its gram, name of its
  *context* (all bytes its windows cover), document, place.
* **Sort.** Tuples are brought together by gram name with Spark's external,
  spilling shuffles; names whose tuples stand alone are dropped.
* **Induce.** Equal contexts settle all their windows at once. Where one gram
  has different contexts (the ends of repeats), one copy of each context is
  fetched from its document and the windows in it are compared; the result
  holds for every tuple with that context.
* Spans are gathered per document and cut out.

Work follows the input plus the ends of repeats, never pairs. Contexts of a
gram with more than ``GROUP`` of them are compared by Spark aggregation, not in
one task. Null text is empty; texts shorter than LENGTH keep all bytes; null
and repeated ids are kept, one row per input row; two equal rows remove each
other's strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, materialize, numbered, utf8

LENGTH = 200
GRAM = 48
GROUP = 100_000
CHUNK = 4 << 20  # window starts treated at a time
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; a random word per byte value."""
    n = CHUNK + LENGTH
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    words = np.array([xxhash.xxh64_intdigest(bytes([c]), 7) for c in range(256)], np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), words


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place, from prefix sums modulo 2^64."""
    up, down, words = _powers()
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(words[text] * up[:len(text)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:len(text) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows by anchor: first window, number of windows, anchor's
    distance from the first window, gram hash. One tuple of arrays per chunk."""
    span = LENGTH - GRAM + 1
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + LENGTH - 1, len(text) - at), at)
        h = gram_hashes(part)
        low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        wide = 1
        while 2 * wide <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        rest = span - wide
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        pick = (_PLACE - (low & _PLACE)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(pick)) + 1])
        count = np.diff(np.append(first, len(pick)))
        yield first + at, count, pick[first] - first, h[pick[first]]


def tuples(rows: DataFrame) -> DataFrame:
    """(row, first, n, gram, context): one tuple per anchor of every text."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            out, size = [], 0
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for first, count, away, gram in anchors(text):
                    context = np.fromiter(
                        (digest(text[f:e], d) for f, e, d in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), away.tolist())),
                        np.uint64, len(first))
                    out.append((np.full(len(first), row), first, count, gram.view(np.int64), context.view(np.int64)))
                    size += len(first)
                if size > 200_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out):
        row, first, count, gram, context = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(first, pa.int64()), pa.array(count.astype(np.int16)), pa.array(gram),
             pa.array(context)], names=["row", "first", "n", "gram", "context"])

    return arrow_step(rows, step, "row long, first long, n short, gram long, context long")


def fetch_contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, context, copies, bytes): the bytes of one copy of each context."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(w["gram"], w["context"], w["copies"], text[w["first"]:w["first"] + w["n"] + LENGTH - 1])
                   for text, ask in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in ask]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["gram", "context", "copies", "bytes"])

    asked = wanted.groupBy("at.row").agg(F.collect_list(F.struct("gram", "context", "copies", "at.first", "at.n")).alias("ask"))
    return arrow_step(rows.join(asked, "row").select("text", "ask"), step,
                      "gram long, context long, copies long, bytes binary")


def _runs(mark: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"s": s, "e": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]


def compare_contexts(contexts: DataFrame) -> DataFrame:
    """(gram, context, runs, later, bytes): runs [s, e) of windows that also
    occur in another context of the gram (all, if the context has copies).
    Contexts of a gram with too many of them come out with later = true."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(gram, held, later):
            runs = [[]] * len(held)
            if not later and held:
                hashes = [np.array([hash(c[2][j:j + LENGTH]) for j in range(len(c[2]) - LENGTH + 1)], np.int64) for c in held]
                value, back, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                again = np.split(times[back] > 1, np.cumsum([len(h) for h in hashes])[:-1])
                runs = [_runs(np.ones_like(a) if c[1] > 1 else a) for c, a in zip(held, again)]
            return pa.RecordBatch.from_arrays(
                [pa.array([gram] * len(held), pa.int64()), pa.array([c[0] for c in held], pa.int64()),
                 pa.array([c[1] for c in held], pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                 pa.array([later] * len(held), pa.bool_()), pa.array([c[2] if later else None for c in held], pa.binary())],
                names=["gram", "context", "copies", "runs", "later", "bytes"])

        now, held, large = None, [], False
        for b in batches:
            for gram, context, copies, raw in zip(*(c.to_pylist() for c in b.columns)):
                if gram != now:
                    if held:
                        yield out(now, held, large)
                    now, held, large = gram, [], False
                held.append((context, copies, raw))
                if len(held) >= GROUP:
                    yield out(now, held, True)
                    held, large = [], True
        if held:
            yield out(now, held, large)

    found = materialize(arrow_step(
        contexts.repartition("gram").sortWithinPartitions("gram"), step,
        "gram long, context long, copies long, runs array<struct<s: long, e: long>>, later boolean, bytes binary"), "contexts")
    # the exact way for grams with very many contexts: their windows as rows, counted by Spark
    windows = found.where("later").select("gram", "context", "copies", F.expr(
        f"explode(sequence(0, octet_length(bytes) - {LENGTH}))").alias("j"), "bytes")
    windows = windows.select("gram", "context", "copies", "j", F.xxhash64(F.expr(f"substring(bytes, j + 1, {LENGTH})")).alias("a"),
                             F.expr(f"hash(substring(bytes, j + 1, {LENGTH}))").alias("b"))
    several = windows.groupBy("gram", "a", "b").agg(F.count("*").alias("times")).where("times > 1")
    counted = windows.join(several, ["gram", "a", "b"], "left").where("times > 1 or copies > 1").groupBy("gram", "context").agg(
        F.collect_list(F.expr("named_struct('s', cast(j as bigint), 'e', cast(j + 1 as bigint))")).alias("runs"))
    return found.where("not later").select("gram", "context", "runs").union(counted)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, spans): byte spans [s, e) to remove, not yet merged."""
    all_tuples = materialize(tuples(rows), "anchors")
    # written, so that the join is one of two plain exchanges: then a common gram's partition can be split
    names = materialize(all_tuples.groupBy("gram").agg(F.count("*").alias("copies"), (F.min("context") == F.max("context")).alias("same"))
                        .where("copies > 1").select("gram", "same"), "grams")
    repeated = materialize(all_tuples.join(names, "gram"), "repeated")
    whole = repeated.where("same").select("row", F.col("first").alias("s"), F.expr(f"first + n + {LENGTH - 1}").alias("e"))
    ends = repeated.where("not same")
    contexts = ends.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "n")).alias("at"))
    runs = compare_contexts(fetch_contexts(rows, contexts)).where("size(runs) > 0")
    part = (ends.join(runs, ["gram", "context"]).select("row", "first", F.explode("runs").alias("r"))
            .select("row", F.expr("first + r.s").alias("s"), F.expr(f"first + r.e + {LENGTH - 1}").alias("e")))
    return whole.union(part).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the remaining bytes."""
    merged: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    kept, at = [], 0
    for s, e in merged:
        kept.append(text[at:s])
        at = e
    return merged, b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept (the remaining bytes) and spans (removed runs [s, e))."""
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")), "texts")
    found = repeated_spans(rows.select("row", "text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            done = [cut(t, s) for t, s in zip(texts, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(t) - len(k) for t, (_, k) in zip(texts, done)], pa.int64()),
                 pa.array([len(m) for m, _ in done], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for _, k in done]), pa.array([k for _, k in done], pa.binary()),
                 pa.array([[{"s": s, "e": e} for s, e in m] for m, _ in done],
                          pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return arrow_step(rows.join(found, "row", "left").select("doc_id", "text", "spans"), step,
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
                      "spans array<struct<s: long, e: long>>")

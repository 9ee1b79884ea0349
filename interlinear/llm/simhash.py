"""SimHash near-duplicate classes by pivot distance tables.

Fingerprint: 64 bits over word shingles (XXH64, seed 42); a bit is set if it
is set in more than half of the shingle hashes.

Linking (at most two differing bits), without all-pairs work:

1. Distinct fingerprints only; copies are one row from here on.
2. Each fingerprint gets a row of a *pivot distance table*: its Hamming
   distances to 64 staircase references (reference j has its lowest j bits
   set) and to 16 scattered references.
3. The steps between consecutive staircase distances are cut into groups. Two
   fingerprints within two bits have equal steps in all but two groups, so the
   steps of every such choice of groups are a join key. Five groups (10 keys of
   38 bits or more) come first; a key shared by more than ``BUCKET``
   fingerprints is not compared there but redone with twelve groups (66 keys),
   where a bucket has at most 4096 different fingerprints by construction.
4. In a bucket, pairs whose distances to any reference differ by more than two
   are discarded (triangle inequality), survivors are verified bit by bit, and
   the verified links leave the bucket as a star per class, so a dense bucket
   gives as many rows as it has members.
5. Components of the links, smallest document id per component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, connected_components, materialize, utf8

MAX_BITS = 2
BUCKET = 256
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one UTF-8 text (no words: 0), as an unsigned integer."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)  # one hash: its own majority
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(ends), CHUNK):
        packed = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp a signed 64-bit integer; null text has no words."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return arrow_step(rows, step, "id long, fp long")


def references(scattered: int = 16) -> np.ndarray:
    """64 staircase references followed by scattered ones (hashes of 0, 1, ...)."""
    stairs = [(1 << j) - 1 for j in range(1, 65)]
    return np.array(stairs + [xxhash.xxh64_intdigest(str(i)) for i in range(scattered)], np.uint64)


REFERENCES = references()


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference, one row each."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def step_keys(table: np.ndarray, own_bits: np.ndarray, groups: int) -> np.ndarray:
    """One key for each choice of ``groups - MAX_BITS`` groups of staircase steps.

    ``own_bits`` is the fingerprint's distance to zero: the staircase's start.
    Between reference j-1 and j the distance falls by one where bit j is set
    and grows by one where not, so equal steps are equal bits.
    """
    stairs = np.concatenate([own_bits[:, None], table[:, :64]], axis=1).astype(np.int16)
    falls = (np.diff(stairs, axis=1) < 0).astype(np.uint64)
    cuts = np.array_split(np.arange(64), groups)
    packed = np.stack([(falls[:, c] << (c - c[0]).astype(np.uint64)).sum(1, dtype=np.uint64) for c in cuts], axis=1)
    out = []
    for n, chosen in enumerate(combinations(range(groups), groups - MAX_BITS)):
        key = np.full(len(table), n, np.uint64)
        for g in chosen:  # mixes; a rare clash of keys only adds pairs that verification drops
            key = (key ^ packed[:, g]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.stack(out, axis=1)


def bucket_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified classes of one bucket: (member, smallest linked member) rows."""
    fps = np.unique(fps)
    table = distance_table(fps)[:, 64:].astype(np.int16)
    label = np.arange(len(fps))
    left, right = [], []
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(np.abs(table[at:at + 256, :1] - table[:, 0]) <= MAX_BITS)
        i = i + at
        i, j = i[i < j], j[i < j]
        for k in range(1, table.shape[1]):
            near = np.abs(table[i, k] - table[j, k]) <= MAX_BITS
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
        left.append(i[near])
        right.append(j[near])
    i, j = np.concatenate(left), np.concatenate(right)
    while len(i):
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (before == label).all():
            break
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def candidate_keys(fps: DataFrame, groups: int) -> DataFrame:
    """(key, fp): every fingerprint under each of its step keys."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(f), 4096):
                part = f[at:at + 4096]
                keys = step_keys(distance_table(part), np.bitwise_count(part), groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))],
                    names=["key", "fp"])

    return arrow_step(fps.select("fp"), step, "key long, fp long")


def links_in_buckets(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b, later): verified stars of each key's fingerprints; a key with more
    than ``most`` rows is not compared, its members come out with later = true.

    Rows of a key arrive together (sorted within partitions) and stream by:
    memory is bounded by ``most``, whatever the size of a key.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, later):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)),
                 pa.array(np.full(len(a), later))], names=["a", "b", "later"])

        def closed(f):
            if len(f) < 2:
                return None
            return rows(*bucket_links(f), False)

        key, held, large = None, np.empty(0, np.uint64), False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for n in np.flatnonzero((np.diff(cuts) > 1) | (np.arange(len(cuts) - 1) == 0)
                                    | (np.arange(len(cuts) - 1) == len(cuts) - 2)):
                at, to = cuts[n], cuts[n + 1]
                if at == to:
                    continue
                if keys[at] != key:
                    if not large and (out := closed(held)) is not None:
                        yield out
                    key, held, large = keys[at], np.empty(0, np.uint64), False
                held = np.concatenate([held, fps[at:to]])
                if large or len(held) > most:
                    yield rows(held, held, True)
                    held, large = np.empty(0, np.uint64), True
        if not large and (out := closed(held)) is not None:
            yield out

    return arrow_step(keyed.repartition("key").sortWithinPartitions("key"), step, "a long, b long, later boolean")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): stars whose components are those of all links at MAX_BITS bits."""
    first = materialize(links_in_buckets(candidate_keys(fps, 5), BUCKET).distinct(), "links")
    dense = first.where("later").select(F.col("a").alias("fp")).distinct()
    second = links_in_buckets(candidate_keys(dense, 12), 1 << 16)
    return first.where("not later").select("a", "b").union(second.where("a <> b").select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component (smallest document id reachable).

    Null or empty text: fingerprint zero, linked like any other. Null ids take
    part; a component of null ids only has a null component. Repeated rows give
    repeated rows. An empty table gives an empty result.
    """
    marked = materialize(with_fingerprint(docs, shingle, id_col, text_col), "fp")
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("low")), "fp-lows")
    classes = connected_components(fingerprint_links(fps))
    named = (fps.join(classes, fps.fp == classes.id, "left")
             .select("fp", "low", F.coalesce("component", "fp").alias("class")))
    lows = named.groupBy("class").agg(F.min("low").alias("component"))
    of_fp = named.join(lows, "class").select("fp", "component")
    return marked.join(of_fp, "fp").select("id", "fp", "component")

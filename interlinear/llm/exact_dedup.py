"""Exact duplicates by an extendible-hash index in shared files.

1. Every row gets a 64-bit hash and the SHA-256 of its text. Within an Arrow
   batch equal texts (compared byte by byte) are joined into one *carrier*, so
   a text that fills a third of the table travels once a batch, with its count
   and its best row. All rows are written once, without the text where a
   carrier has it.
2. *Owners* are ranges of the hash: a power of two of them, one for about
   ``OWNER_BYTES`` of carried text. An owner task streams the carriers of its
   ranges into extendible-hash indexes: a directory over the next bits of the
   hash points to buckets of at most ``PAGE`` hashes; an overfull bucket splits
   in two by its next bit, and the directory doubles when that bucket already
   used all of the directory's bits. Texts of one hash form a chain and are
   told apart by their bytes.
3. Directories and buckets are Parquet rows written through Spark (so a lost
   executor leaves no half-written index); the classes are read from them.
4. The rows meet their class by (hash, SHA-256) in an equi-join of slim rows,
   whose skewed keys adaptive execution splits.

Defined results: null text is the empty text. Of equal texts the row with the
largest id stays; among rows that share that id one stays, a null id is below
all others. Repeated rows give repeated rows. An empty table gives none.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, materialize, shared_dir, utf8

OWNER_BYTES = 32 << 20
LEAST_OWNERS = 64  # so that small tables use all cores, too
PAGE = 256
_HEAD = struct.Struct("<qqqqq?")  # hash, text length, rows, best id, best row, best id known
_SHA = 32
PAGES = "owner long, page int, depth int, slots array<int>, records binary, texts binary"


class Entry:
    __slots__ = ("text", "sha", "n", "best")

    def __init__(self, text: bytes, sha: bytes, n: int, best: tuple):
        self.text, self.sha, self.n, self.best = text, sha, n, best


class Bucket:
    """Chains of one key range; ``depth`` bits of the hash are the same in all."""

    def __init__(self, depth: int):
        self.depth = depth
        self.chains: dict[int, list[Entry]] = {}

    def to_bytes(self) -> tuple[bytes, bytes]:
        """(fixed-size records in chain order, their texts one after the other)."""
        flat = [(h, e) for h, chain in self.chains.items() for e in chain]
        records = b"".join(_HEAD.pack(h, len(e.text), e.n, e.best[1] or 0, e.best[2], e.best[0]) + e.sha for h, e in flat)
        return records, b"".join(e.text for _, e in flat)


def records(raw: bytes) -> Iterator[tuple]:
    """(hash, length, rows, best id, best row, SHA-256) of a bucket's records."""
    for at in range(0, len(raw), _HEAD.size + _SHA):
        h, size, n, best, row, known = _HEAD.unpack_from(raw, at)
        yield h, size, n, best if known else None, row, raw[at + _HEAD.size:at + _HEAD.size + _SHA]


class ExtendibleHash:
    """Index of one owner. The owner's own ``skip`` leading bits say nothing
    within it; the directory reads the ``depth`` bits that follow."""

    def __init__(self, skip: int, page: int = PAGE):
        self.skip, self.page, self.depth = skip, page, 0
        self.directory = [Bucket(0)]

    def slot(self, h: int) -> int:
        return ((h << self.skip) & (1 << 64) - 1) >> (64 - self.depth) if self.depth else 0

    def add(self, h: int, text: bytes, sha: bytes, n: int, best: tuple) -> None:
        """Count ``n`` more rows of a text; ``best`` orders (id known, id, row)."""
        key = h & (1 << 64) - 1
        bucket = self.directory[self.slot(key)]
        while h not in bucket.chains and len(bucket.chains) >= self.page and bucket.depth + self.skip < 64:
            self._split(bucket, self.slot(key))
            bucket = self.directory[self.slot(key)]
        chain = bucket.chains.setdefault(h, [])
        for e in chain:
            if e.text == text:
                e.n, e.best = e.n + n, max(e.best, best)
                return
        chain.append(Entry(text, sha, n, best))

    def _split(self, bucket: Bucket, slot: int) -> None:
        if bucket.depth == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth, slot = self.depth + 1, slot * 2
        halves = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        shift = 63 - self.skip - bucket.depth
        for h, chain in bucket.chains.items():
            halves[(h >> shift) & 1].chains[h] = chain
        span = 1 << (self.depth - bucket.depth)  # the bucket's directory entries are neighbours
        first = slot // span * span
        self.directory[first:first + span] = [halves[0]] * (span // 2) + [halves[1]] * (span // 2)

    def buckets(self) -> Iterator[tuple[Bucket, list[int]]]:
        """Every bucket once, with its directory entries."""
        at = 0
        while at < len(self.directory):
            bucket, span = self.directory[at], 1 << (self.depth - self.directory[at].depth)
            yield bucket, [at, at + span]
            at += span


def carriers(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    """All rows (row, doc_id, h, sha); the first of a text in its batch also
    carries text, n, best_id and best_row. Written once: row numbers stay."""
    text = utf8(text_col)
    h = F.xxhash64(text) if hash_bits == 64 else F.shiftleft(F.xxhash64(text), 64 - hash_bits)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       h.alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, key, h, sha, text = b.columns
            coded = pc.dictionary_encode(text)
            of = coded.indices.to_numpy()
            known = pc.is_valid(key).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(key, 0).to_numpy()
            order = np.lexsort((row.to_numpy(), ids, known, of))
            last = order[np.flatnonzero(np.diff(of[order], append=-1))]  # best row of each text
            first = np.unique(of, return_index=True)[1]
            at = np.full(b.num_rows, -1)
            at[first] = np.arange(len(first))
            take = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays(
                [row, key, h, sha, coded.dictionary.take(take), pa.array(np.bincount(of)).take(take),
                 key.take(pa.array(last)).take(take), row.take(pa.array(last)).take(take)],
                names=["row", "doc_id", "h", "sha", "text", "n", "best_id", "best_row"])

    return materialize(arrow_step(rows, step, "row long, doc_id long, h long, sha binary, text binary, n long, "
                                              "best_id long, best_row long"), "dedup-rows")


def build_index(carried: DataFrame, page: int = PAGE) -> DataFrame:
    """Write the index of ``carriers`` and return its table of buckets: owner,
    page (number of the bucket), depth, slots (first and behind last entry of
    the owner's directory), records and texts."""
    size = carried.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(LEAST_OWNERS - 1, size // OWNER_BYTES).bit_length()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(owner, index):
            for n, (bucket, slots) in enumerate(index.buckets()):
                own, texts = bucket.to_bytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owner], pa.int64()), pa.array([n], pa.int32()), pa.array([bucket.depth], pa.int32()),
                     pa.array([slots], pa.list_(pa.int32())), pa.array([own], pa.binary()), pa.array([texts], pa.binary())],
                    names=["owner", "page", "depth", "slots", "records", "texts"])

        now, index = None, None
        for b in batches:
            for owner, h, sha, text, n, best, row in zip(*(c.to_pylist() for c in b.columns)):
                if owner != now:
                    if index is not None:
                        yield from out(now, index)
                    now, index = owner, ExtendibleHash(bits, page)
                index.add(h, text, sha, n, (best is not None, best or 0, row))
        if index is not None:
            yield from out(now, index)

    rows = carried.where("text is not null").select(
        F.shiftrightunsigned("h", 64 - bits).alias("owner"), "h", "sha", "text", "n", "best_id", "best_row")
    path = f"{shared_dir(carried.sparkSession)}/interlinear-dedup-index-{uuid.uuid4().hex}"
    dealt = rows.repartition("owner").sortWithinPartitions("owner")
    arrow_step(dealt, step, PAGES).write.option("compression", "zstd").parquet(path)
    return carried.sparkSession.read.schema(PAGES).parquet(path)


def classes(index: DataFrame) -> DataFrame:
    """(h, sha, keep_id, keep_row, group_size) of every text in the index."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                found = list(records(raw))
                columns = list(zip(*found)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[5], pa.binary()), pa.array(columns[3], pa.int64()),
                     pa.array(columns[4], pa.int64()), pa.array(columns[2], pa.int64())],
                    names=["h", "sha", "keep_id", "keep_row", "group_size"])

    return arrow_step(index.select("records"), step, "h long, sha binary, keep_id long, keep_row long, group_size long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE,
                hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.
    ``hash_bits`` below 64 only serves to test chains of equal hashes."""
    rows = carriers(docs, id_col, text_col, hash_bits)
    of = classes(build_index(rows, page))
    return rows.select("row", "doc_id", "h", "sha").join(of, ["h", "sha"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))

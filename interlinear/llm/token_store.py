"""Token-id store: concatenated ids with Elias-Fano document boundaries.

``write`` range-partitions the documents by id (ties by a hash of the text, so
one repeated id can't fill a partition), encodes each partition's texts in
order and writes *pages* through Spark's Parquet writer: the files appear in
shared storage by its commit protocol, whichever executor is lost. A page is
self-contained:

    magic "EFT1" | documents u32 | ids u64 | bytes per id u8 | document ids i64[] |
    null flags u8[] | Elias-Fano blob of the running totals | ids

Elias-Fano of m totals over a page of n ids: ``floor(log2(n/m))`` low bits of
each total packed, the high parts in unary, and the bit position of every 64th
one as a 32-bit select sample: about ``2 + log2(n/m)`` bits a document.

``read`` returns documents from the files alone. Null text is the empty text
(it still gets the end id); null ids come first; repeated rows stay.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_step
from .tokens import encoder

PAGE_IDS = 2_000_000
SAMPLE = 64
PAGES = "shard int, page int, base long, n_ids long, payload binary"


class EliasFano:
    """A non-decreasing sequence of m values below 2^32 * 2^low, in quasi-succinct space."""

    def __init__(self, count: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.count, self.low, self.lower, self.upper, self.samples = count, low, lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        m, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // m).bit_length() - 1) if m else 0
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(m)
        upper = np.zeros(int(ones[-1]) + 1 if m else 0, np.uint8)
        upper[ones] = 1
        return cls(m, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"),
                   ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBII", self.count, self.low, len(self.lower), len(self.upper))
        return head + self.lower.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        count, low, n_lower, n_upper = struct.unpack_from("<IBII", raw, at)
        at += 13
        lower = np.frombuffer(raw, np.uint8, n_lower, at)
        upper = np.frombuffer(raw, np.uint8, n_upper, at + n_lower)
        n = -(-count // SAMPLE)
        at += n_lower + n_upper
        return cls(count, low, lower, upper, np.frombuffer(raw, "<u4", n, at)), at + 4 * n

    def _low_bits(self, i: np.ndarray) -> np.ndarray:
        at = np.asarray(i, np.int64)[:, None] * self.low + np.arange(self.low)
        bits = (self.lower[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.int64) << np.arange(self.low)).sum(1)

    def select(self, i: int) -> int:
        """Value i alone: from the sample before it, over at most its block of ones."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        to = int(self.samples[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(self.samples) else 8 * len(self.upper)
        first = start >> 3
        bits = np.unpackbits(self.upper[first:(to >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[start - 8 * first:])
        return ((start + int(ones[i % SAMPLE]) - i) << self.low) + int(self._low_bits(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.count]
        i = np.arange(self.count)
        return ((ones - i) << self.low) + self._low_bits(i)


def page_bytes(doc_ids: list, coded: list[bytes], width: int = 2) -> bytes:
    totals = np.cumsum([len(c) // width for c in coded])
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = b"EFT1" + struct.pack("<IQB", len(coded), int(totals[-1]), width)
    return b"".join([head, ids.tobytes(), null.tobytes(), EliasFano.encode(totals).to_bytes(), *coded])


class Page:
    def __init__(self, raw: bytes):
        if raw[:4] != b"EFT1":
            raise ValueError("not a token page")
        m, n, width = struct.unpack_from("<IQB", raw, 4)
        at = 17
        null = np.frombuffer(raw, np.uint8, m, at + 8 * m)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", m, at).tolist(), null)]
        self.totals, at = EliasFano.from_bytes(raw, at + 9 * m)
        self.ids = np.frombuffer(raw, f"<u{width}", n, at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the page, by two selects."""
        return self.ids[self.totals.select(i - 1) if i else 0:self.totals.select(i)]


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token store of ``docs`` to ``path`` (any folder Spark can write)."""
    end = np.array([end_id], "<u2").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        page, base, doc_ids, coded, held = 0, 0, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([base], pa.int64()),
                 pa.array([held // 2], pa.int64()), pa.array([page_bytes(doc_ids, coded)], pa.binary())],
                names=["shard", "page", "base", "n_ids", "payload"])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                doc_ids.append(key)
                coded.append(ids + end)
                held += len(ids) + 2
                if held >= 2 * PAGE_IDS:
                    yield out()
                    page, base, doc_ids, coded, held = page + 1, base + held // 2, [], [], 0
        if coded:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    arrow_step(rows, step, PAGES).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files:
    ``start`` counts the ids of all documents before it."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base, raw in zip(*(c.to_pylist() for c in b.columns)):
                page = Page(raw)
                ends = page.totals.values()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(page.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), shard, np.int32)), pa.array(page.doc_ids, pa.int64()),
                     pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    pages = spark.read.schema(PAGES).parquet(path)
    # one row per shard, that is per partition of the writer: a bounded table
    shards = pages.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = arrow_step(pages.select("shard", "base", "payload"), step,
                      "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return (rows.join(F.broadcast(firsts), "shard")
            .select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))

"""Bounded-space online packing of token sequences.

Each partition keeps ``OPEN`` windows of ``SIZE`` ids. A document's ids are cut
into full windows, which leave at once, and a rest, which goes to the open
window it fits best; if it fits none, the fullest open window is emitted and a
new one opened. What is still open when a partition ends is merged: groups of
``FAN`` partitions pack their open windows best-fit decreasing and pass on at
most ``OPEN`` of them, until one group is left; there the windows that are not
full are joined end to end and cut at the window size, so only one sequence of
the whole corpus is cut short by the end of the data.

The first step is written to the shared folder once (tokens are encoded once;
the closed pieces and the merge read the same rows). Null text is the empty
text: its document is the end id alone. Null and repeated ids are kept as they
are; every input row is packed. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, materialize
from .tokens import encoder

SIZE = 2048
OPEN = 64
FAN = 64
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary, part long, open boolean")
NAMES = [field.split()[0] for field in PIECES.split(", ")]


class Packer:
    """Open windows of one partition; a window is a list of items with a fill."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.space: list[tuple[int, int]] = []  # (room, window), ascending
        self.windows: dict[int, list] = {}
        self.next = 0

    def place(self, item, length: int) -> list | None:
        """Put an item of at most ``size`` ids; returns a window that had to be emitted."""
        emitted = None
        at = bisect_left(self.space, (length, -1))
        if at < len(self.space):
            room, w = self.space.pop(at)
        else:
            if len(self.space) >= self.most:
                _, full = self.space.pop(0)
                emitted = self.windows.pop(full)
            room, w, self.next = self.size, self.next, self.next + 1
            self.windows[w] = []
        self.windows[w].append(item)
        if room > length:
            insort(self.space, (room - length, w))
            return emitted
        full = self.windows.pop(w)
        if emitted is None:
            return full
        raise AssertionError("a full item was placed where another window had to go")  # callers emit full items

    def rest(self) -> list[list]:
        return [self.windows[w] for _, w in self.space]


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


class _Rows:
    """Builds piece rows; ids are 16-bit little-endian."""

    def __init__(self, part: int, stage: int):
        self.part, self.sequence, self.rows = part, (stage << 56) | (part << 28), []

    def emit(self, window: list[tuple], opened: bool = False) -> None:
        offset = 0
        for doc, start, tokens, ids in window:
            n = len(ids) // 2
            self.rows.append((doc, start, n, _crc(ids), tokens, self.sequence, offset, ids, self.part, opened))
            offset += n
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.binary(), pa.int64(), pa.bool_()]
        columns = zip(*self.rows) if self.rows else [[]] * len(types)
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def pack_partitions(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    end = np.array([end_id], "<u2").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, rows = encoder(vocabulary), Packer(), _Rows(TaskContext.get().partitionId(), 0)
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                ids += end
                tokens, start = len(ids) // 2, 0
                while tokens - start >= SIZE:
                    rows.emit([(key, start, tokens, ids[2 * start:2 * (start + SIZE)])])
                    start += SIZE
                if start < tokens:
                    full = packer.place((key, start, tokens, ids[2 * start:]), tokens - start)
                    if full is not None:
                        rows.emit(full)
                if len(rows.rows) > 5000:
                    yield rows.batch()
        for window in packer.rest():
            rows.emit(window, opened=True)
        yield rows.batch()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(arrow_step(rows, step, PIECES), "packed")


def _merge(windows: list[list], rows: _Rows, last: bool) -> None:
    """Best-fit decreasing over a group's open windows (whole windows are the items)."""
    packer = Packer(most=1 << 30)
    fill = lambda w: sum(len(p[3]) // 2 for p in w)
    for w in sorted(windows, key=lambda w: (-fill(w), w[0][0] or 0, w[0][1])):
        full = packer.place(w, fill(w))
        if full is not None:
            rows.emit([p for item in full for p in item])
    rest = [[p for item in bins for p in item] for bins in packer.rest()]  # fullest first
    if not last:
        for n, w in enumerate(rest):
            rows.emit(w, opened=n >= len(rest) - OPEN)
        return
    held, room = [], SIZE
    for doc, start, tokens, ids in (p for w in rest for p in w):
        while ids:
            cut = ids[:2 * room]
            held.append((doc, start, tokens, cut))
            start, room, ids = start + len(cut) // 2, room - len(cut) // 2, ids[len(cut):]
            if not room:
                rows.emit(held)
                held, room = [], SIZE
    if held:
        rows.emit(held)


def _merger(stage: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        rows, windows = _Rows(table.column("part")[0].as_py() // FAN, stage), {}
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["doc_tokens"], r["ids"]))
        _merge(list(windows.values()), rows, last)
        return pa.Table.from_batches([rows.batch()])

    return merge


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (binary, 16-bit little-endian)."""
    packed = pack_partitions(docs, vocabulary, end_id, id_col, text_col)
    done, opened, stage = packed.where("not open"), packed.where("open"), 1
    parts = (opened.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-parts // FAN)
        last = groups == 1

        merged = opened.groupBy((F.col("part") / FAN).cast("long").alias("g")).applyInArrow(_merger(stage, last), PIECES)
        merged = materialize(merged, f"packed{stage}")
        done = done.union(merged.where("not open"))
        if last:
            return done.drop("part", "open")
        opened, parts, stage = merged.where("open"), groups, stage + 1

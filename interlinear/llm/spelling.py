"""Spelling variants: words one edit apart, by composing finite-state machines.

The vocabulary is counted over all documents. Words of t letters and those of
t + 1 that are one edit apart share their first t // 2 letters before the edit
or their last t - t // 2 letters after it. So every word stands, for both
lengths it can pair at, in one *prefix* and one *suffix* (reversed) partition:
the words that leave the initial state of the vocabulary acceptor by the same
letters. A partition streams sorted words into two minimised acyclic acceptors
(t letters; t + 1 letters), and the composition

    acceptor o one-edit transducer o acceptor

is enumerated from its initial state: equal letters keep the transducer in its
first state, one replaced or inserted letter takes it to its second one, where
both acceptors must read the same rest. The edit is placed at the first letter
that differs, so each pair of words is accepted once.

A partition of more than ``most`` words is split exactly where its words begin
to differ: words that agree in the next letter form smaller partitions, and
pairs whose edit is that letter meet by the rest behind it (such a group has
one word a letter at most).

Forms and roots: the near word of largest count that has ``ratio`` times the
word's count; roots follow forms by doubling, a logarithmic number of joins.

Defined results: null text has no words, a null id reads as an empty one.
Repeated rows count once each. An empty table, or one without frequent words,
gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, materialize, utf8

RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")  # letters up to U+00FF, as UTF-8
DROP = 199
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
MOST = 50_000  # words of a partition; larger ones are split
FLUSH = 200_000


def without_letter(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LETTERS`` letters that occur ``least`` times."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = crc32(key + b":")
                for run, n in Counter(RUN.findall(text.lower())).items():
                    h = crc32(run, start)
                    word = without_letter(run, h) if h % DROP == 0 else run
                    if len(word) - word.count(b"\xc3") >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("key"), utf8(text_col).alias("text"))
    counted = arrow_step(rows, step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("word").cast("string").alias("word"), "n")


# -- machines ----------------------------------------------------------------

class Acceptor:
    """Minimal acyclic acceptor of words of one length, added in sorted order.
    A state is the number of its (letter, state) arcs; the final one has none."""

    def __init__(self):
        self.arcs: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.last, self.open = None, [[]]

    def _state(self, arcs: tuple) -> int:
        if arcs not in self.number:
            self.number[arcs] = len(self.arcs)
            self.arcs.append(arcs)
        return self.number[arcs]

    def _close(self, depth: int) -> None:
        """Minimise what hangs below ``depth`` of the last word."""
        while len(self.open) > depth + 1:
            state = self._state(tuple(self.open.pop()))
            self.open[-1].append((self.last[len(self.open) - 1], state))

    def add(self, word: str) -> None:
        same, end = 0, min(len(word), len(self.last or ""))
        while same < end and word[same] == self.last[same]:
            same += 1
        self._close(same)
        self.open += [[] for _ in word[same:]]
        self.last = word

    def initial(self) -> int | None:
        if self.last is None:
            return None
        self._close(0)
        return self._state(tuple(self.open[0]))


class Composition:
    """``left`` o one edit o ``right``: the right word has a letter replaced
    (``extra`` false, both acceptors are the same) or one letter more."""

    def __init__(self, left: Acceptor, right: Acceptor, extra: bool):
        self.left, self.right, self.extra = left, right, extra
        self.same: dict[tuple[int, int], list[str]] = {}

    def rest(self, p: int, q: int) -> list[str]:
        """Words that both states accept (the transducer's second state)."""
        if (found := self.same.get((p, q))) is None:
            to, a = dict(self.right.arcs[q]), self.left.arcs[p]
            found = [""] if not a and not to else [c + s for c, x in a if c in to for s in self.rest(x, to[c])]
            self.same[p, q] = found
        return found

    def pairs(self, p: int | None, q: int | None) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        todo = [("", p, q)] if p is not None and q is not None else []
        while todo:
            read, p, q = todo.pop()
            a, b = self.left.arcs[p], self.right.arcs[q]
            if self.extra:
                out += [(read + s, read + c + s) for c, y in b for s in self.rest(p, y) if s[:1] != c]
            else:
                out += [(read + c + s, read + d + s) for n, (c, x) in enumerate(a) for d, y in b[n + 1:] for s in self.rest(x, y)]
            to = dict(b)
            todo += [(read + c, x, to[c]) for c, x in a if c in to]
        return out


def near_in_partition(words: dict[str, int], start: str, letters: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among sorted words that begin with ``start`` and
    have ``letters`` letters, or one of them one more; the edit is behind ``start``."""
    short, long = Acceptor(), Acceptor()
    for w in words:
        (short if len(w) == letters else long).add(w[len(start):])
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * letters + 1000))
    p, q = short.initial(), long.initial()
    for u, v in Composition(short, short, False).pairs(p, p) + Composition(short, long, True).pairs(p, q):
        yield start + u, start + v


# -- partitions ----------------------------------------------------------------

_KEY = ["side", "t", "start"]


def partitioned(vocabulary: DataFrame) -> DataFrame:
    """(side, t, start, w, n): every word under its prefix and its suffix
    (``w`` reversed), as a word of t and of t + 1 letters."""
    return vocabulary.selectExpr("word", "n", f"explode(filter(array(char_length(word), char_length(word) - 1), t -> t >= {LEAST_LETTERS})) as t").selectExpr(
        "n", "t", "inline(array(named_struct('side', 'P', 'w', word, 'k', t div 2), "
        "named_struct('side', 'S', 'w', reverse(word), 'k', t - t div 2)))").selectExpr(
        "side", "t", "substring(w, 1, cast(k as int)) as start", "w", "n")


def _branching(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start`` prolonged by the letters that all words of its
    partition share: no pair has its edit there."""
    ends = rows.groupBy(*_KEY).agg(F.min("w").alias("low"), F.max("w").alias("high"))
    first = "array_position(zip_with(split(low, ''), split(high, ''), (a, b) -> a <=> b), false)"
    common = ends.selectExpr(*_KEY, f"left(low, cast(if({first} = 0, char_length(low), {first} - 1) as int)) as common")
    return rows.join(common, _KEY).selectExpr("side", "t", "common as start", "w", "n")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oversized partitions: (the same words under one more letter, the pairs
    whose edit is the letter behind ``start``)."""
    k = "char_length(start)"
    later = rows.where(f"char_length(w) > {k}").selectExpr("side", "t", f"substring(w, 1, {k} + 1) as start", "w", "n")
    behind = rows.selectExpr(*_KEY, "w", "n", f"inline(array(named_struct('c', substring(w, {k} + 1, 1), 'y', substring(w, {k} + 2)),"
                             f" named_struct('c', '', 'y', substring(w, {k} + 1))))")
    # replaced: both words leave t - 1 letters; inserted: the longer one leaves the whole shorter one
    behind = behind.where("c <> '' or char_length(w) = t").distinct()
    met = behind.groupBy(*_KEY, "y").agg(F.expr("array_sort(collect_list(struct(c, w, n)))").alias("m")).where("size(m) > 1")
    pairs = met.selectExpr("side", "t", "start", "y", "explode(flatten(transform(m, (a, i) -> transform(slice(m, i + 2, size(m)), b -> struct(a, b))))) as p")
    pairs = pairs.where("if(p.a.c = '', p.b.c <> '' and p.b.c <> substring(y, 1, 1), char_length(p.a.w) = t)").selectExpr(
        "side", "t", "p.a.w as u", "p.b.w as v", "p.a.n as nu", "p.b.n as nv")
    return later, pairs


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v, nu, nv): every pair of words one edit apart, once."""
    rows, found = materialize(partitioned(vocabulary), "spelling-parts"), []
    small = []
    while True:
        sizes = materialize(rows.groupBy(*_KEY).count(), "spelling-sizes")
        hot = sizes.where(f"count > {most}").drop("count")
        if hot.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(hot, _KEY, "left_anti"))
        later, pairs = _split(_branching(rows.join(hot, _KEY, "left_semi")))
        found.append(materialize(pairs, "spelling-pairs"))
        rows = materialize(later, "spelling-parts")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, words):
            side, t, start = key
            pairs = [(u, v, words[u], words[v]) for u, v in near_in_partition(words, start, t)] if len(words) > 1 else []
            for at in range(0, len(pairs), 10_000):
                u, v, nu, nv = zip(*pairs[at:at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([side] * len(u)), pa.array([t] * len(u), pa.int32()), pa.array(u), pa.array(v), pa.array(nu, pa.int64()),
                     pa.array(nv, pa.int64())], names=["side", "t", "u", "v", "nu", "nv"])

        key, words = None, {}
        for b in batches:
            for *now, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if now != key:
                    if key is not None:
                        yield from out(key, words)
                    key, words = now, {}
                words[w] = n
        if key is not None:
            yield from out(key, words)

    every = small[0]
    for s in small[1:]:
        every = every.union(s)
    dealt = every.repartition(*_KEY).sortWithinPartitions(*_KEY, "w").select(*_KEY, "w", "n")
    pairs = arrow_step(dealt, step, "side string, t int, u string, v string, nu long, nv long")
    for f in found:
        pairs = pairs.union(f.selectExpr("side", "t", "u", "v", "nu", "nv"))
    # a pair of the suffix side that also shares its prefix came from the prefix side
    pairs = pairs.selectExpr("side", "t", "if(side = 'P', u, reverse(u)) as u", "if(side = 'P', v, reverse(v)) as v", "nu", "nv")
    return pairs.where("side = 'P' or left(u, cast(t div 2 as int)) <> left(v, cast(t div 2 as int))").select("u", "v", "nu", "nv")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form reached. Forms have ever
    larger counts, so no path returns; each round doubles the steps taken."""
    now = materialize(forms.selectExpr("word", "form as root"), "spelling-roots")
    while True:
        after = now.selectExpr("word as root", "root as further")
        now = materialize(now.join(after, "root", "left").selectExpr("word", "coalesce(further, root) as root", "further is not null as moved"),
                          "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, ratio: int = RATIO,
             most: int = MOST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = materialize(word_counts(docs, id_col, text_col, least), "spelling-words")
    pairs = materialize(near_words(vocabulary, most), "spelling-near")
    both = pairs.selectExpr("u as word", "nu as n", "v as other", "nv as m").union(pairs.selectExpr("v", "nv", "u", "nu"))
    rows = both.union(vocabulary.selectExpr("word", "n", "cast(null as string)", "cast(null as long)"))
    each = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"),
                                    F.min(F.expr("if(other is null, null, struct(-m as m, other as other))")).alias("best"))
    each = materialize(each.selectExpr("word", "n", "n_near", f"if(-best.m >= {ratio} * n, best.other, null) as form",
                                       f"if(-best.m >= {ratio} * n, -best.m, null) as form_n"), "spelling-forms")
    last = roots(each.where("form is not null"))
    return each.join(last, "word", "left").selectExpr("word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n")

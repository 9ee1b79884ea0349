"""Language-model scoring with Brown class-based bigrams.

1. Word counts over all training documents (counted per task, summed by word).
   The ``HEAD`` most frequent words (a bounded table) get numbers that tasks look
   up; the texts are written once as numbers, all other words beside them.
2. Every word seen ``LEAST`` times gets a class, however many there are. The
   ``SEED`` most frequent ones are clustered by exchange, one move at a time, on
   their bigram counts over all training documents (at most (SEED + 2)^2 numbers,
   whatever the corpus). The others follow in ``BATCHED`` exchange passes: Spark
   counts each word's neighbouring classes, each word moves to the class that
   raises the likelihood of these counts most, and the class bigrams are counted
   again. Words outside the head take the last pass as rows of a table and meet
   their documents in an equi-join.
3. P(word | previous) = P(class | previous class) P(word | class). Rarer and
   unseen words form one open class whose emission uses their exact counts;
   transitions and the open class are smoothed additively.

Words: ASCII letters lower-cased, split at ASCII white space; a document ends
with one end token. Null text is empty (the end token alone). A null document
id reads as the empty text, whose checksum puts it in the held-out part.
Repeated ids and rows are scored one by one. Without training documents every
count is zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, materialize, utf8

SEED = 1024
CLASSES = 64
LEAST = 3  # rarer words stay in the open class
HEAD = 100_000
HEAD_BYTES = 64  # longer words are never looked up in the task
PASSES = 4
BATCHED = 2
FLUSH = 400_000
END = b" "  # no word: it holds a space
SMOOTH = 0.1


def training(doc_id: str) -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 10 != 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the column ``text``, with the end token once per document."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(text.lower().split())
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
            counts[END] += b.num_rows
        yield out()

    return arrow_step(texts.select("text"), step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(rows: DataFrame, numbers) -> DataFrame:
    """Texts as numbers: ``numbers`` (int32 a word, 0 outside the head), ``rare``
    (the distinct words outside) and ``spots`` (int32, which of them stands at each 0)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for b in batches:
            coded, rare, stops, spots = [], [], [0], []
            for text in b.column(3).to_pylist():
                words = text.lower().split()
                found = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
                outside = [words[i] for i in np.flatnonzero(found == 0).tolist()]
                place = {w: i for i, w in enumerate(dict.fromkeys(outside))}
                coded.append(found.tobytes())
                rare.extend(place)
                stops.append(len(rare))
                spots.append(np.fromiter(map(place.__getitem__, outside), np.int32, len(outside)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(coded, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(rare, pa.binary())), pa.array(spots, pa.binary())], names=["row", "doc_id", "training", "numbers", "rare", "spots"])

    return arrow_step(rows.select("row", "doc_id", "training", "text"), step,
                      "row long, doc_id long, training boolean, numbers binary, rare array<binary>, spots binary")


def _path(numbers: np.ndarray, of: np.ndarray, border: int) -> np.ndarray:
    path = np.full(len(numbers) + 2, border, np.int64)
    path[1:-1] = of[numbers]
    return path


def _summed(codes: list[np.ndarray], size: int) -> pa.RecordBatch:
    if size <= 2_000_000:
        n = np.bincount(np.concatenate(codes), minlength=1)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def _code_counts(cells: DataFrame, codes_of, size: int) -> DataFrame:
    """(code, n): occurrences of the codes below ``size`` that ``codes_of`` gives for a binary cell."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for b in batches:
            for cell in b.column(0).to_pylist():
                codes.append(codes_of(cell))
                held += len(codes[-1])
                if held > 4_000_000:
                    yield _summed(codes, size)
                    codes, held = [], 0
        if codes:
            yield _summed(codes, size)

    return arrow_step(cells, step, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def pair_counts(cells: DataFrame, of, border: int, dtype: str = "<i4") -> np.ndarray:
    """Counts of neighbours [previous, next] under the broadcast map ``of`` from
    numbers to 0 .. border - 1; ``border`` stands before and after a document."""
    wide = border + 1

    def codes_of(cell: bytes) -> np.ndarray:
        path = _path(np.frombuffer(cell, dtype), of.value, border)
        return path[:-1] * wide + path[1:]

    found = _code_counts(cells, codes_of, wide * wide).toArrow()
    pairs = np.zeros(wide * wide, np.int64)
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return pairs.reshape(wide, wide)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(g: np.ndarray, movable: np.ndarray, r: np.ndarray, l: np.ndarray, own: float) -> np.ndarray:
    """Rise of the likelihood if a word that the class bigrams ``g`` do not count
    joins each class: r and l count the classes after and before it, own its repeats."""
    rows, cols = g[movable], g[:, movable].T
    gain = (_f(rows + r) - _f(rows)).sum(1) + (_f(cols + l) - _f(cols)).sum(1)
    diag = g[movable, movable]
    gain += _f(diag + r[movable] + l[movable] + own) - _f(diag)
    gain -= _f(diag + r[movable]) - _f(diag) + _f(diag + l[movable]) - _f(diag)
    out_n, in_n = g.sum(1)[movable] + l[movable], g.sum(0)[movable] + r[movable]
    return gain - (_f(out_n + r.sum() + own) - _f(out_n) + _f(in_n + l.sum() + own) - _f(in_n))


def exchange(bigrams: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """Class of every word number. Number 0 (open class) and the last (border)
    keep classes of their own; the others start dealt out by frequency and move,
    one at a time, to the class with the largest likelihood gain."""
    n = len(bigrams)
    k = classes + 2
    of = np.concatenate([[0], 1 + np.arange(n - 2) % classes, [k - 1]])
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    b = bigrams.astype(np.float64)
    after, before = b @ member, b.T @ member  # word x class: followed by, preceded by
    g = member.T @ after
    movable = np.arange(1, classes + 1)
    for _ in range(passes):
        moves = 0
        for w in range(1, n - 1):
            a, self_count = of[w], b[w, w]
            r, l = after[w].copy(), before[w].copy()
            if not r.any() and not l.any():
                continue
            r[a] -= self_count
            l[a] -= self_count
            g[a] -= r
            g[:, a] -= l
            g[a, a] -= self_count
            gain = _gain(g, movable, r, l, self_count)
            to = int(movable[np.argmax(gain)])
            if gain[to - 1] <= gain[a - 1] + 1e-9:
                to = a
            g[to] += r
            g[:, to] += l
            g[to, to] += self_count
            if to != a:
                moves += 1
                of[w] = to
                after[:, a] -= b[:, w]
                after[:, to] += b[:, w]
                before[:, a] -= b[w]
                before[:, to] += b[w]
        if not moves:
            break
    return of


def best_class(g: np.ndarray, a: int, seen: np.ndarray) -> int:
    """Class for one word of class ``a``, which ``g`` counts. ``seen``:
    counts of the classes after it, before it, and of its own repeats."""
    k = len(g)
    r, l, own = seen[:k].copy(), seen[k:2 * k].copy(), seen[2 * k]
    r[a] -= own
    l[a] -= own
    g = g.copy()
    g[a] -= r
    g[:, a] -= l
    g[a, a] -= own
    gain = _gain(g, np.arange(1, k - 1), r, l, own)
    to = int(np.argmax(gain)) + 1
    return a if gain[to - 1] <= gain[a - 1] + 1e-9 else to


def _around(path: np.ndarray, spots: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Context codes of the words at ``spots``: class after, k + class before, 2k
    for a word that follows itself."""
    spots = spots + 1
    return np.concatenate([path[spots + 1], k + path[spots - 1], np.full(int(own.sum()), 2 * k)])


def head_contexts(cells: DataFrame, of, k: int, first: int, last: int) -> DataFrame:
    """(word, context, n) of the head words numbered first to last."""
    def codes_of(cell: bytes) -> np.ndarray:
        numbers = np.frombuffer(cell, "<i4")
        spots = np.flatnonzero((numbers >= first) & (numbers <= last))
        own = np.zeros(len(spots), bool)
        inner = spots < len(numbers) - 1
        own[inner] = numbers[spots[inner]] == numbers[spots[inner] + 1]
        word = numbers[spots].astype(np.int64)
        return np.concatenate([word, word, word[own]]) * (2 * k + 1) + _around(_path(numbers, of.value, k - 1), spots, k, own)

    wide = 2 * k + 1
    return _code_counts(cells, codes_of, (last + 1) * wide).select(F.expr(f"code div {wide}").alias("word"),
                                                                   (F.col("code") % wide).cast("int").alias("context"), "n")


def rare_contexts(coded: DataFrame, of, k: int) -> DataFrame:
    """(word, context, n) of the words outside the head, one context per occurrence:
    (class after * k + class before) * 2, plus 1 where the word follows itself.
    Summed per batch before they move; one shuffle by word serves both groupings."""
    size = 2 * k * k

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1).flatten().dictionary_encode()
            word = words.indices.to_numpy().astype(np.int64)
            starts = np.cumsum(b.column(1).value_lengths().to_numpy()) - b.column(1).value_lengths().to_numpy()
            codes = [np.zeros(0, np.int64)]
            for cell, at, start in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), starts.tolist()):
                if not at:
                    continue
                numbers, at = np.frombuffer(cell, "<i4"), np.frombuffer(at, "<i4")
                spots = np.flatnonzero(numbers == 0)
                own = np.zeros(len(spots), np.int64)
                own[:-1] = (at[:-1] == at[1:]) & (spots[:-1] + 1 == spots[1:])
                path = _path(numbers, of.value, k - 1)
                codes.append(word[start + at] * size + (path[spots + 2] * k + path[spots]) * 2 + own)
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code // size)), pa.array((code % size).astype(np.int32)),
                                              pa.array(n)], names=["word", "context", "n"])

    found = arrow_step(coded.select("numbers", "rare", "spots"), step, "word binary, context int, n long")
    return found.repartition("word").groupBy("word", "context").agg(F.sum("n").alias("n"))


def joining(g: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Classes for words of the open class, one row of ``seen`` (as in ``best_class``,
    but own repeats counted apart only) each, against the class bigrams as they stand."""
    k = len(g)
    inner, fg = slice(1, k - 1), _f(g)
    after, before, own = seen[:, :k], seen[:, k:2 * k], seen[:, 2 * k:]
    gain = np.zeros((len(seen), k - 2))
    for side, table, ftable in ((after, g.T, fg.T), (before, g, fg)):
        word, context = np.nonzero(side)
        if len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rise = _f(table[context, inner] + side[word, context][:, None]) - ftable[context, inner]
            gain[word[starts]] += np.add.reduceat(rise, starts)
    d, r, l = np.diag(g)[inner], after[:, inner], before[:, inner]
    gain += _f(d + r + l + own) + _f(d) - _f(d + r) - _f(d + l)
    out_n, in_n = g.sum(1)[inner] + l, g.sum(0)[inner] + r
    return 1 + np.argmax(gain - _f(out_n + after.sum(1, keepdims=True) + own) + _f(out_n)
                         - _f(in_n + before.sum(1, keepdims=True) + own) + _f(in_n), 1)


def moved(contexts: DataFrame, word_type: str, g, of, least: int) -> DataFrame:
    """(word, class, n) after one batched exchange pass. ``of`` gives the present
    class of a numbered word; None: words outside the head, of the open class, with
    the contexts of ``rare_contexts``. A word has at most 2 k + 1 or 2 k^2 contexts;
    the classes before it add up to its count."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = g.value.astype(np.float64)
        k = len(table)
        for b in batches:
            context, n = (b.column(1).flatten().field(i).to_numpy() for i in (0, 1))
            word = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            if of is None:
                own = context % 2 == 1
                word, context, n = (np.concatenate([word, word, word[own]]),
                                    np.concatenate([context // (2 * k), k + context // 2 % k, np.full(int(own.sum()), 2 * k)]),
                                    np.concatenate([n, n, n[own]]))
            prior = (context >= k) & (context < 2 * k)
            counts = np.bincount(word[prior], n[prior], b.num_rows).astype(np.int64)
            now = np.zeros(b.num_rows, np.int64) if of is None else of.value[b.column(0).to_numpy()]
            classes = np.zeros(b.num_rows, np.int64)
            often = np.flatnonzero(counts >= least)
            at = np.full(b.num_rows, -1)
            for some in np.split(often, range(1000, len(often), 1000)):
                at[:] = -1
                at[some] = np.arange(len(some))
                mine = at[word] >= 0
                seen = np.zeros((len(some), 2 * k + 1))
                np.add.at(seen, (at[word[mine]], context[mine]), n[mine])
                new = now[some] == 0
                apart = seen[new]
                apart[:, [0, k]] -= apart[:, 2 * k:]
                classes[some[new]] = joining(table, apart)
                for i in np.flatnonzero(~new).tolist():
                    classes[some[i]] = best_class(table, int(now[some[i]]), seen[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes.astype(np.int32)), pa.array(counts)], names=["word", "class", "n"])

    grouped = contexts.groupBy("word").agg(F.collect_list(F.struct("context", "n")).alias("seen"))
    return arrow_step(grouped, step, f"word {word_type}, class int, n long")


class Emissions:
    """Log10 emissions of words from their classes and counts."""

    def __init__(self, total: int, distinct: int, ends: int, class_n: np.ndarray, open_distinct: int):
        self.class_n, self.ends = class_n, ends
        self.open_norm = np.log10(class_n[0] + SMOOTH * (open_distinct + 1))
        self.base_norm = np.log10(total + SMOOTH * (distinct + 1))
        self.end_base = np.log10(ends + SMOOTH) - self.base_norm

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10(n + SMOOTH) - self.base_norm

    def emit(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        opened = classes == 0
        closed = np.log10(np.where(opened, 1, n) / np.where(opened, 1, self.class_n[classes]))
        return np.where(opened, np.log10(n + SMOOTH) - self.open_norm, closed)


class Model(NamedTuple):
    """What training leaves: all texts as class paths (``paths``), the classes of
    the head words by number (``of``, 0: open), their counts, the table (word,
    class, n) of the words outside the head, emissions and log10 transitions."""

    paths: DataFrame
    head: list[tuple[bytes, int]]
    of: np.ndarray
    rare: DataFrame
    emissions: Emissions
    move: np.ndarray


def _head(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: a count limit is found from a
    histogram in steps of a 16th of a doubling, then just the words above it
    are gathered (no task sends its own ``most`` words). Words of the step that
    would go beyond ``most`` stay outside."""
    words = counts.where((F.length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END)))
    step = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    total, cut = 0, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    if cut is None:
        return []
    found = words.where(step >= cut).select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda w: (-w[1], w[0]))


def class_paths(coded: DataFrame, rare: DataFrame, of, head_n, emissions) -> DataFrame:
    """One row per text: its class path (uint16), summed base and emission
    probabilities and known words. Words outside the head meet their class and count
    in an equi-join, one row per text and distinct word."""
    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, emissions_ = of.value, emissions.value
        base, emit = emissions_.base(head_n.value), emissions_.emit(classes, head_n.value)
        base[0] = emit[0] = 0  # added when the word is met
        for b in batches:
            path, bases, emits = [], [], []
            for cell in b.column(3).to_pylist():
                numbers = np.frombuffer(cell, "<i4")
                here = classes[numbers].astype("<u2")
                here[numbers == 0] = 65535
                path.append(here.tobytes())
                bases.append(float(base[numbers].sum()))
                emits.append(float(emit[numbers].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(path, pa.binary()), pa.array(bases, pa.float64()),
                                              pa.array(emits, pa.float64()), b.column(4)],
                                             names=["row", "doc_id", "training", "path", "base", "emit", "spots"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions_ = emissions.value
        for b in batches:
            paths, bases, emits, known, tokens = [], [], [], [], []
            met = b.column(7).flatten()
            place, of_rare, n_rare = (met.field(i).to_numpy() for i in range(3))
            stops = np.cumsum(b.column(7).value_lengths().fill_null(0).to_numpy()).tolist()
            for path, base, emit, spots, start, stop in zip(*(b.column(i).to_pylist() for i in range(3, 7)), [0, *stops], stops):
                path, spots = np.frombuffer(path, "<u2").copy(), np.frombuffer(spots, "<i4")
                unseen = 0
                if len(spots):
                    order = start + np.argsort(place[start:stop])[spots]
                    classes, n = of_rare[order], n_rare[order]
                    path[path == 65535] = classes
                    base += float(emissions_.base(n).sum())
                    emit += float(emissions_.emit(classes, n).sum())
                    unseen = int((n == 0).sum())
                paths.append(path.tobytes())
                bases.append(base + emissions_.end_base)
                emits.append(emit)
                known.append(len(path) - unseen + int(emissions_.ends > 0))
                tokens.append(len(path) + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(paths, pa.binary()), pa.array(bases, pa.float64()), pa.array(emits, pa.float64()),
                 pa.array(known, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "training", "path", "base", "emit", "known", "n_tokens"])

    first = arrow_step(coded.select("row", "doc_id", "training", "numbers", "spots"), ahead,
                       "row long, doc_id long, training boolean, path binary, base double, emit double, spots binary")
    met = coded.select("row", F.posexplode("rare").alias("at", "word")).join(rare, "word", "left").groupBy("row").agg(
        F.collect_list(F.struct("at", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))).alias("met"))
    return arrow_step(first.join(met, "row", "left"), whole, "doc_id long, training boolean, path binary, base double, emit double, "
                                                             "known long, n_tokens long")


def train(rows: DataFrame, seed: int, classes: int, head_size: int, least: int) -> Model:
    """Classes and probabilities from the rows (row, doc_id, text, training)."""
    sc = rows.sparkSession.sparkContext
    counts = materialize(word_counts(rows.where("training")), "word-counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"),
                                       F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    head = _head(counts, head_size)
    coded = materialize(encode(rows, sc.broadcast({w: n for n, (w, _) in enumerate(head, 1)})), "lm-numbers")
    cells = coded.where("training").select("numbers")
    k = classes + 2
    head_n = np.array([0, *(n for _, n in head)], np.int64)
    last = int((head_n >= least).sum()) if least > 0 else len(head)  # the head falls by count
    seed = min(seed, last)
    alone = np.arange(len(head) + 1)
    alone[seed + 1:] = 0
    of = np.zeros(len(head) + 1, np.int64)
    of[1:seed + 1] = exchange(pair_counts(cells, sc.broadcast(alone), seed + 1), classes, PASSES)[1:-1]
    for _ in range(BATCHED if last > seed else 0):
        now, g = sc.broadcast(of), sc.broadcast(pair_counts(cells, sc.broadcast(of), k - 1))
        found = moved(head_contexts(cells, now, k, seed + 1, last), "long", g, now, least).toArrow()
        of = of.copy()
        of[found.column("word").to_numpy()] = found.column("class").to_numpy()
    now, g = sc.broadcast(of), sc.broadcast(pair_counts(cells, sc.broadcast(of), k - 1))
    rare = materialize(moved(rare_contexts(coded.where("training"), now, k), "binary", g, None, least), "lm-rare")
    class_n, words = np.bincount(of[1:], head_n[1:], minlength=k), np.bincount(of[1:], minlength=k)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        class_n[r["class"]] += r["n"]
        words[r["class"]] += r["words"]
    emissions = Emissions(total, distinct, ends, class_n, int(words[0]))
    paths = materialize(class_paths(coded, rare, now, sc.broadcast(head_n), sc.broadcast(emissions)), "lm-paths")
    g = pair_counts(paths.where("training").select("path"), sc.broadcast(np.arange(k)), k - 1, "<u2")
    move = np.log10((g + SMOOTH) / (g.sum(1, keepdims=True) + SMOOTH * k))
    return Model(paths, head, of, rare, emissions, move)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
          classes: int = CLASSES, head_size: int = HEAD, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and perplexity (of the class model)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       utf8(text_col).alias("text"), training(id_col).alias("training"))
    model = train(rows, seed, classes, head_size, least)
    move = rows.sparkSession.sparkContext.broadcast(model.move)
    train_tokens = int(model.emissions.class_n.sum()) + int(model.emissions.ends)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = move.value
        same = np.arange(len(table))
        for b in batches:
            steps = []
            for cell in b.column(2).to_pylist():
                path = _path(np.frombuffer(cell, "<u2"), same, len(table) - 1)
                steps.append(float(table[path[:-1], path[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 3, 4, 5, 6)), pa.array(steps, pa.float64())],
                                             names=["doc_id", "training", "base", "emit", "known", "n_tokens", "steps"])

    scored = arrow_step(model.paths.select("doc_id", "training", "path", "base", "emit", "known", "n_tokens"), step,
                        "doc_id long, training boolean, base double, emit double, known long, n_tokens long, steps double")
    log10 = F.col("emit") + F.col("steps")
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), log10.alias("score"),
        F.pow(F.lit(10.0), -log10 / F.col("n_tokens")).alias("perplexity"))

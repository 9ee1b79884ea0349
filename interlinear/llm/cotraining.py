"""Quality classifier by co-training two views of a document.

The text view sees byte and word statistics and the presence of words that
tell the classes apart; the metadata view sees source, language and length.
Each starts from the labelled rows; in every round each view labels unlabelled
documents it is sure of and hands them to the *other* view's training set. Both
are then calibrated on labelled rows held out from training and combined by a
logistic model of the two calibrated log-odds. The same is done for every
target column of the labels (``quality``, ``toxic``).

The views of every document are computed and written once. Each round then
scores ALL documents with the present models on Spark; of those that a view is
sure of, the ``HANDED`` surest of each class (equal views count once) are handed
over. What the driver fits on is bounded and documented: at most ``FIT_ROWS``
labelled ids, chosen by a hash of their id and one row each, ``HANDED`` rows a
round, class and view, and ``LEXICON`` words a target; Newton steps go over blocks
of rows, so no wide matrix is held.

Defined results: null or empty text has zero statistics; null metadata is a
value of its own; repeated ids are scored row by row, but a labelled id is
fitted on one row (the least of its views); labels of one id are averaged and a
tie is no label. A target without labels, or with one class
only, scores its smoothed share (1/2 without labels). A document is kept if
its quality score is at least 1/2 and its toxic score is not above 1/2.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from hashlib import blake2b
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_step, materialize, utf8
from .decontamination import words

TARGETS = ("quality", "toxic")
FIT_ROWS = 12_000
LEXICON = 256
CHI = 30.0  # a word below this chi-squared (one degree of freedom) is noise
ROUNDS = 4
SURE = 0.97  # confidence that makes a pseudo-label
HANDED = 300  # pseudo-labels of a class that a view hands over in a round: the surest of all documents
BLOCK = 1000  # rows of a wide matrix held at a time
_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_SOURCES, _LANGS, _SIZES = 64, 16, 24


# -- views -----------------------------------------------------------------

def statistics(text: bytes) -> np.ndarray:
    """Shares of byte classes and punctuation marks, repetition of words and lines."""
    size = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    parts = text.split()
    n = max(1, len(parts))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, parts, parts[1:]))
    shares = np.concatenate([
        [seen[48:58].sum() / size, seen[65:91].sum() / size, seen[128:].sum() / size, seen[10] / size, seen[32] / size],
        seen[_PUNCTUATION] / size,
        [len(set(parts)) / n, again / n, len(set(lines)) / max(1, len(lines)), sum(map(bytes.isupper, parts)) / n]])
    return np.concatenate([np.sqrt(shares), [np.log1p(len(text)) / 10, min(1.0, size / n / 20)]])


N_STATISTICS = len(statistics(b""))


def text_view(text: bytes, lexicon: dict[bytes, int]) -> tuple[np.ndarray, list[int]]:
    """Statistics and the numbers of the lexicon's words that occur."""
    found = lexicon.keys() & set(words(text)) if lexicon else ()
    return statistics(text), sorted(lexicon[w] for w in found)


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Numbers of the three indicators that are set."""
    slot = lambda value, n: n - 1 if value is None else crc32(value.encode()) % (n - 1)
    size = _SIZES - 1 if n_chars is None else min(_SIZES - 2, int(log2(max(0, n_chars) + 1)))
    return [slot(source, _SOURCES), _SOURCES + slot(lang, _LANGS), _SOURCES + _LANGS + size]


class Views:
    """One view of many documents: shares (statistics, perhaps none) and the
    numbers of the indicators that are set; wide only a block at a time."""

    def __init__(self, shares: np.ndarray, hits: pa.ListArray, n_hits: int):
        self.shares, self.n_hits = shares, n_hits
        self.ends = np.cumsum(pc.list_value_length(hits).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.hits = hits.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.ends)

    def dense(self, at: int, to: int) -> np.ndarray:
        first = self.ends[at - 1] if at else 0
        sizes = np.diff(self.ends[at:to], prepend=first)
        x = np.zeros((to - at, self.shares.shape[1] + self.n_hits))
        x[:, :self.shares.shape[1]] = self.shares[at:to]
        x[np.repeat(np.arange(to - at), sizes), self.shares.shape[1] + self.hits[first:self.ends[to - 1]]] = 1
        return x


def blocks(parts: list) -> Iterator[np.ndarray]:
    """Dense rows of several views (or arrays), a block at a time."""
    for part in parts:
        for at in range(0, len(part), BLOCK):
            to = min(len(part), at + BLOCK)
            yield part.dense(at, to) if isinstance(part, Views) else part[at:to]


# -- models ----------------------------------------------------------------

class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps, self.weights = ridge, steps, None

    def fit(self, parts: list, y: np.ndarray) -> Logistic:
        self.prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        self.weights = None
        if len(y) == 0 or y.min() == y.max():
            return self
        self.mean = sum(x.sum(0) for x in blocks(parts)) / len(y)
        self.scale = np.maximum(np.sqrt(sum(((x - self.mean) ** 2).sum(0) for x in blocks(parts)) / len(y)), 1e-3)
        w = np.zeros(len(self.mean) + 1)
        w[-1] = self.prior
        eye = np.full(len(w), self.ridge)
        eye[-1] = 1e-6

        def sums(w, hessian=True):
            """Loss, gradient and curvature, summed over the blocks."""
            loss, g, h, at = 0.5 * (eye * w * w).sum(), -eye * w, np.diag(eye), 0
            for x in blocks(parts):
                z, t = self._scaled(x), y[at:at + len(x)]
                at += len(x)
                o = z @ w
                loss += np.logaddexp(0, np.where(t > 0.5, -1, 1) * o).sum()
                if hessian:
                    p = _share(o)
                    g = g + z.T @ (t - p)
                    h = h + (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
            return loss, g, h

        now, g, h = sums(w)
        for _ in range(self.steps):
            step = np.linalg.solve(h, g)
            after = sums(w + step, False)[0]
            while after > now and np.abs(step).max() > 1e-6:
                step /= 2
                after = sums(w + step, False)[0]
            w, gain = w + step, now - after
            now, g, h = sums(w)
            if gain < 1e-6 * (1 + now):
                break
        self.weights = w
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def log_odds(self, part) -> np.ndarray:
        if self.weights is None:
            return np.full(len(part), self.prior)
        return np.concatenate([np.empty(0), *(self._scaled(x) @ self.weights for x in blocks([part]))])


def _share(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


class CoTrained:
    """Two views, each taught by the other, calibrated and combined."""

    def __init__(self, views: list[Views], y: np.ndarray, of: list[Views], held: np.ndarray):
        """``views``: the labelled rows to train on with classes ``y``; ``of`` and
        ``held``: the rows and classes kept back for calibration."""
        self.own, self.labels = [[v] for v in views], [[y], [y]]
        self.held, self.classes = of, held

    def train(self) -> None:
        self.models = [Logistic().fit(x, np.concatenate(t)) for x, t in zip(self.own, self.labels)]

    def hand_over(self, to: int, rows: Views, label: int) -> None:
        self.own[to].append(rows)
        self.labels[to].append(np.full(len(rows), float(label)))

    def calibrate(self) -> None:
        sides = [m.log_odds(v) for m, v in zip(self.models, self.held)]
        self.calibrated = [Logistic(0.1).fit([s[:, None]], self.classes) for s in sides]
        both = np.stack([c.log_odds(s[:, None]) for c, s in zip(self.calibrated, sides)], axis=1)
        self.joint = Logistic(0.1).fit([both], self.classes)
        self.own = self.labels = self.held = self.classes = None

    def score(self, views: list[Views]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated share of each view and of both together."""
        sides = [c.log_odds(m.log_odds(v)[:, None]) for c, m, v in zip(self.calibrated, self.models, views)]
        return _share(sides[0]), _share(sides[1]), _share(self.joint.log_odds(np.stack(sides, axis=1)))


# -- fit and score ---------------------------------------------------------

def _fit_labels(labels: DataFrame, id_col: str) -> dict[int, tuple]:
    """Labels of at most FIT_ROWS ids, lowest hash first (None: no label)."""
    means = [F.avg(F.col(t).cast("double")).alias(t) for t in TARGETS]
    rows = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*means)
            .orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect())
    return {r.id: tuple(None if r[t] is None or r[t] == 0.5 else float(r[t] > 0.5) for t in TARGETS) for r in rows}


def _lexicons(docs: DataFrame, chosen) -> dict[bytes, int]:
    """Words whose presence tells labelled documents apart best (chi-squared)."""
    n = len(TARGETS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        labels = chosen.value
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key in labels:
                    said = set(words(text))
                    for t, y in enumerate(labels[key]):
                        if y is not None:
                            counts.update((w, 2 * t + int(y)) for w in said)
                            counts[(b"", 2 * t + int(y))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in counts], pa.binary()), pa.array([s for _, s in counts], pa.int32()),
             pa.array(counts.values(), pa.int64())], names=["word", "side", "n"])

    counted = arrow_step(docs.select("id", "text"), step, "word binary, side int, n long").groupBy("word").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(2 * n)])
    counted = materialize(counted, "quality-words")  # or each of the queries below would count anew
    total = counted.where(F.length("word") == 0).first()
    if total is None:
        return {}
    out: dict[bytes, int] = {}
    for t in range(n):
        n0, n1 = total[f"n{2 * t}"], total[f"n{2 * t + 1}"]
        if not n0 or not n1:
            continue
        a, b = F.col(f"n{2 * t + 1}").cast("double"), F.col(f"n{2 * t}").cast("double")
        chi = F.pow(a * n0 - b * n1, 2) * (n0 + n1) / ((a + b) * (n0 + n1 - a - b + 1) * n0 * n1)
        top = (counted.where((F.length("word") > 0) & (a + b >= 4)).select("word", chi.alias("chi"))
               .where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "word").limit(LEXICON).collect())
        for r in top:
            out.setdefault(bytes(r.word), len(out))
    return out


_VIEW = "shares binary, hits array<int>, meta array<int>, view binary"


def _with_views(docs: DataFrame, lexicon: dict[bytes, int]) -> DataFrame:
    """``docs`` (id, text, source, lang, n_chars first) with both views of each
    row and a digest of them; written once."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                text, source, lang, n_chars = (c.to_pylist() for c in part.columns[-4:])
                own = [text_view(t, lexicon) for t in text]
                shares = [s.astype("<f4").tobytes() for s, _ in own]
                meta = [metadata_view(*m) for m in zip(source, lang, n_chars)]
                digest = [blake2b(s + np.array([*h, -1, *m], "<i4").tobytes(), digest_size=16).digest()
                          for s, (_, h), m in zip(shares, own, meta)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-4], pa.array(shares, pa.binary()), pa.array([h for _, h in own], pa.list_(pa.int32())),
                     pa.array(meta, pa.list_(pa.int32())), pa.array(digest, pa.binary())], names=[*kept, "__shares", "__hits", "__meta", "__view"])

    kept = docs.columns[:-4]
    out = T.StructType(list(docs.schema.fields[:-4]))
    out.add("__shares", T.BinaryType()).add("__hits", T.ArrayType(T.IntegerType())).add("__meta", T.ArrayType(T.IntegerType())).add("__view", T.BinaryType())
    return materialize(arrow_step(docs, step, out), "quality-views")


def _views(shares: pa.Array, hits: pa.ListArray, meta: pa.ListArray, lexicon: dict) -> list[Views]:
    table = np.frombuffer(b"".join(shares.to_pylist()), "<f4").reshape(-1, N_STATISTICS)
    return [Views(table, hits, len(lexicon)), Views(np.zeros((len(meta), 0), np.float32), meta, _SOURCES + _LANGS + _SIZES)]


def _columns(table: pa.Table) -> list[pa.Array]:
    return [table.column(c).combine_chunks() for c in ("shares", "hits", "meta")]


def _surest(views: DataFrame, models, lexicon, labelled, seen) -> dict[tuple, pa.Table]:
    """(target, teacher, label) -> the HANDED rows that the teacher is surest
    of among all documents without a label for the target and not ``seen``."""
    sc = views.sparkSession.sparkContext
    shared = sc.broadcast((models, lexicon, labelled, seen))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, lexicon, labelled, seen = shared.value
        for b in batches:
            ids, view = b.column(0).to_pylist(), b.column(4).to_pylist()
            both = _views(*b.columns[1:4], lexicon)
            for t, model in enumerate(models):
                free = np.array([labelled.get(i, _NO_LABELS)[t] is None for i in ids], bool)
                for teacher in (0, 1):
                    p = _share(model.models[teacher].log_odds(both[teacher]))
                    for label in (0, 1):
                        sure = np.flatnonzero(free & ((p if label else 1 - p) >= SURE))
                        rank, taken = np.abs(p[sure] - label), {}
                        for n in np.argsort(rank, kind="stable"):
                            if view[sure[n]] not in seen[t, teacher] and view[sure[n]] not in taken:
                                taken[view[sure[n]]] = (float(rank[n]), int(sure[n]))
                                if len(taken) == HANDED:
                                    break
                        if taken:
                            at = pa.array([n for _, n in taken.values()])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([4 * t + 2 * teacher + label] * len(at), pa.int32()), pa.array([r for r, _ in taken.values()], pa.float64()),
                                 *[c.take(at) for c in b.columns[1:]]], names=["side", "rank", "shares", "hits", "meta", "view"])

    rows = arrow_step(views.selectExpr("id", "__shares", "__hits", "__meta", "__view"), step, f"side int, rank double, {_VIEW}")
    first = Window.partitionBy("side").orderBy("rank", "view")  # ranked in each task first, so few rows meet
    best = rows.dropDuplicates(["side", "view"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= HANDED).drop("n")
    found = best.toArrow().sort_by([(c, "ascending") for c in ("side", "rank", "view")])  # few rows
    return {(side // 4, side // 2 % 2, side % 2): found.filter(pc.equal(found["side"], side)) for side in pc.unique(found["side"]).to_pylist()}


_NO_LABELS = (None,) * len(TARGETS)


def fit(views: DataFrame, chosen: dict[int, tuple], lexicon: dict[bytes, int]) -> list[CoTrained]:
    """The co-trained model of each target from the views of all documents."""
    spark = views.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], "id long")  # at most FIT_ROWS
    one = views.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct("__view", "__shares", "__hits", "__meta")).alias("v"))
    rows = one.selectExpr("id", "v.__shares as shares", "v.__hits as hits", "v.__meta as meta").toArrow().sort_by("id")
    key = rows.column("id").to_pylist()
    back = [crc32(str(i).encode()) % 4 == 0 for i in key]  # held back for calibration
    models = []
    for t in range(len(TARGETS)):
        part = {h: [n for n, i in enumerate(key) if chosen[i][t] is not None and back[n] == h] for h in (False, True)}
        sides = {h: (_views(*_columns(rows.take(pa.array(at, pa.int64()))), lexicon), np.array([chosen[key[n]][t] for n in at], float))
                 for h, at in part.items()}
        models.append(CoTrained(*sides[False], *sides[True]))
    seen: dict[tuple, set] = {(t, v): set() for t in range(len(TARGETS)) for v in (0, 1)}
    for turn in range(ROUNDS + 1):
        for m in models:
            m.train()
        if turn == ROUNDS or not any(len(m.labels[0][0]) for m in models):
            break
        light = [copy(m) for m in models]
        for m in light:
            m.own = m.labels = m.held = m.classes = None
        found = _surest(views, light, lexicon, chosen, seen)
        for (t, teacher, label), table in found.items():
            models[t].hand_over(1 - teacher, _views(*_columns(table), lexicon)[1 - teacher], label)
            seen[t, teacher].update(table.column("view").to_pylist())
        if not found:
            break
    for m in models:
        m.calibrate()
    return models


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          meta_cols: tuple[str, str, str] = ("source", "lang", "n_chars"), label_id_col: str = "doc_id") -> DataFrame:
    """``docs`` (without columns of the names added here) with, per target, ``<target>_text``, ``<target>_metadata`` (the
    calibrated views) and ``<target>_score``, and ``keep``."""
    names = docs.columns
    added = [f"{t}_{what}" for t in TARGETS for what in ("text", "metadata", "score")]
    kept = [c for c in names if c not in added and c != "keep"]
    meta = [(F.col(c) if c in names else F.lit(None)).cast(k).alias(as_) for c, as_, k in zip(
        meta_cols, ("source", "lang", "n_chars"), ("string", "string", "long"))]
    key, text = F.col(id_col).cast("long"), utf8(text_col)
    chosen = _fit_labels(labels, label_id_col)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    lexicon = _lexicons(docs.select(key.alias("id"), text.alias("text")), shared)
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(kept)], key.alias("id"),
                       text.alias("text"), *meta)
    views = _with_views(wide, lexicon)
    model = docs.sparkSession.sparkContext.broadcast((lexicon, fit(views, chosen, lexicon)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, models = model.value
        for b in batches:
            both = _views(*b.columns[-3:], lexicon)
            scores = [s for m in models for s in m.score(both)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *[pa.array(s, pa.float64()) for s in scores]],
                                             names=[*kept, *added])

    out = T.StructType([T.StructField(c, f.dataType, f.nullable, f.metadata) for c, f in zip(kept, wide.schema.fields)])
    for c in added:
        out = out.add(c, "double")
    rows = views.select(*[f"c{n}" for n in range(len(kept))], "__shares", "__hits", "__meta")
    return arrow_step(rows, step, out).withColumn("keep", F.expr("quality_score >= 0.5 and toxic_score <= 0.5"))

"""Trained models: normalised probabilities, held-out accuracy, whole pages."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from interlinear.llm import class_lm, cotraining, html_blocks

SF = "/root/testdata/sf0.01"


def _by_hand(model, rows):
    """Counts, base and model scores of (doc_id, text) in plain Python, from the
    classes that training gave the words."""
    words = [[*t.encode().lower().split()] for _, t in rows]
    train = [w for (i, _), w in zip(rows, words) if zlib.crc32(str(i).encode()) % 10]
    n = Counter(x for w in train for x in w)
    of = {w: int(c) for (w, _), c in zip(model.head, model.of[1:])} | {bytes(r.word): r["class"] for r in model.rare.collect()}
    assert set(of) == set(n) and {bytes(r.word): r.n for r in model.rare.collect()}.items() <= n.items()
    border = len(model.move) - 1
    total, vocabulary = sum(n.values()) + len(train), len(n) + (len(train) > 0)
    inside = Counter()
    for w, m in n.items():
        inside[of[w]] += m
    opened = sum(c == 0 for c in of.values())

    def path(w):
        return [border, *[of.get(x, 0) for x in w], border]
    pairs = Counter(p for w in train for p in zip(path(w), path(w)[1:]))
    left = Counter()
    for (a, _), m in pairs.items():
        left[a] += m

    def emit(x):
        c = of.get(x, 0)
        return n[x] / inside[c] if c else (n[x] + .1) / (inside[0] + .1 * (opened + 1))
    for (i, _), w in zip(rows, words):
        p = path(w)
        yield (i, len(w) + 1, sum(n[x] > 0 for x in w) + (len(train) > 0), total,
               sum(math.log10((c + .1) / (total + .1 * (vocabulary + 1))) for c in [*(n[x] for x in w), len(train)]),
               sum(math.log10((pairs[q] + .1) / (left[q[0]] + .1 * (border + 1))) for q in zip(p, p[1:])) + sum(math.log10(emit(x)) for x in w))


@pytest.mark.parametrize("seed, head_size", [(8, 40), (1024, 100_000), (3, 0)])
def test_class_scores_against_brute_force(spark, seed, head_size):
    """Also with most words outside the head: they get classes and exact counts too."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["long" * 30, "Éa", "X"]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(3, "long" * 30 + " new-word"), (3, "long" * 30 + " new-word"), (7, "rare rare rare\trare only here"), (10, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    args = dict(seed=seed, classes=5, head_size=head_size, least=3)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", class_lm.utf8("text").alias("text"),
                           class_lm.training("doc_id").alias("training"))
    model = class_lm.train(numbered, **args)
    in_class = {bytes(r.word): r["class"] for r in model.rare.collect()} | {w: int(c) for (w, _), c in zip(model.head, model.of[1:])}
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 10 for x in t.encode().lower().split())
    assert all((in_class[w] > 0) == (n >= 3) for w, n in counts.items())
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in class_lm.score(docs, **args).collect())
    want = sorted(_by_hand(model, rows))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:]), (g, w)


def test_class_model_is_a_distribution(spark):
    """For each previous class, all words, the unseen ones and the end add up to 1."""
    rows = [(1, "the cat sat on the mat and the dog sat on the log while a bird sang to the cat " * 3 + "once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", class_lm.utf8("text").alias("text"), F.lit(True).alias("training"))
    model = class_lm.train(numbered, 6, 2, 8, 2)
    counts = {w: (n, c) for (w, n), c in zip(model.head, model.of[1:])} | {bytes(r.word): (r.n, r["class"]) for r in model.rare.collect()}
    mass = np.zeros(4)
    for n, c in counts.values():
        mass[c] += 10 ** float(model.emissions.emit(np.array([c]), np.array([n]))[0])
    mass[0] += class_lm.SMOOTH / 10 ** model.emissions.open_norm
    assert np.allclose((10 ** model.move).sum(1), 1) and np.allclose(mass, [1, 1, 1, 0])
    assert counts[b"once"] == (1, 0) and all(c > 0 for n, c in counts.values() if n > 1)


def test_batched_moves_raise_the_likelihood_most():
    """The moves of a pass against the likelihood written out, class by class."""
    rng = np.random.default_rng(8)
    g = rng.poisson(20, (6, 6)).astype(float)

    def likelihood(g):
        return class_lm._f(g).sum() - class_lm._f(g.sum(0)).sum() - class_lm._f(g.sum(1)).sum()

    def put(g, c, seen, sign):
        g = g.copy()
        g[c] += sign * seen[:6]
        g[:, c] += sign * seen[6:12]
        g[c, c] += sign * seen[12]
        return g
    seen = rng.poisson(.7, (40, 13)).astype(float)
    want = [1 + int(np.argmax([likelihood(put(g, c, s, 1)) for c in range(1, 5)])) for s in seen]
    assert class_lm.joining(g, seen).tolist() == want
    for a, s in zip(rng.integers(1, 5, 40), seen):
        counted = s.copy()  # with the word in class a, its repeats stand among its neighbours
        counted[[a, 6 + a]] += s[12]
        best = 1 + int(np.argmax([likelihood(put(g, c, s, 1)) for c in range(1, 5)]))
        assert class_lm.best_class(put(g, a, s, 1), a, counted) == best


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    kinds = np.concatenate([[0], np.arange(40) % 4 + 1, [5]])  # hidden classes of 40 words
    rates = rng.random((6, 6)) ** 6 * 60
    bigrams = rng.poisson(rates[kinds][:, kinds])

    def likelihood(of):
        g = np.zeros((10, 10))
        np.add.at(g, (of[:, None].repeat(42, 1), of[None].repeat(42, 0)), bigrams)
        return class_lm._f(g).sum() - class_lm._f(g.sum(0)).sum() - class_lm._f(g.sum(1)).sum()
    start = np.concatenate([[0], 1 + np.arange(40) % 8, [9]])
    rng.shuffle(start[1:-1])
    dealt = class_lm.exchange(bigrams, 8, 0)
    moved = class_lm.exchange(bigrams, 8, 10)
    assert likelihood(moved) >= likelihood(dealt) and likelihood(moved) > likelihood(start)
    assert moved[0] == 0 and moved[-1] == 9 and set(moved[1:-1]) <= set(range(1, 9))


def test_cotraining_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = cotraining.score(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(got) > 80
    assert np.mean([(r.quality_score >= 0.5) == r.quality for r in got]) >= 0.95
    assert np.mean([(r.toxic_score > 0.5) == r.toxic for r in got]) >= 0.9


def test_pages_by_their_markup(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("<h1>|</h1>|<p>|</p>", article))
        assert got[r.page_id] == "\n".join(t for t in texts if t)


def test_a_repeated_labelled_id_fills_nothing(spark):
    """30,000 rows of one labelled id leave the other labelled ids in the fit."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    hot = labels.orderBy("doc_id").limit(1).select("doc_id")
    many = docs.join(hot, "doc_id").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.lit(30_000))).alias("copy"))
    many = many.select("doc_id", F.lit("short text").alias("text"), "lang", "source", "n_chars")
    got = cotraining.score(docs.union(many), labels.where("doc_id % 3 <> 0"))
    held = got.join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "quality_score").collect()
    assert np.mean([(r.quality_score >= .5) == bool(r.quality) for r in held]) > .9


def test_bigrams_keep_borders_apart(spark):
    cells = spark.createDataFrame([(np.array([1, 3, 4, 2], np.int32).tobytes(),)], "numbers binary")
    got = class_lm.pair_counts(cells, spark.sparkContext.broadcast(np.array([0, 1, 2, 0, 0])), 3)  # two words of their own
    path = [3, 1, 0, 0, 2, 3]  # border, a, open class twice, b, border
    want = np.zeros((4, 4), int)
    np.add.at(want, (path[:-1], path[1:]), 1)
    assert (got == want).all()


def test_articles_outlive_their_wrappers_names(spark):
    text = "A first sentence of some length that says what happened there. "
    pages = {
        f"<div class='layout has-sidebar'><article><h1>Head</h1><p>{text}</article></div>": f"Head\n{text.strip()}",
        f"<div class='page with-search no-comments'><article><p>{text}</article></div>": text.strip(),
        f"<div class='post no-comments'><p>{text}<p>{text}</div>": f"{text.strip()}\n{text.strip()}",
        f"<main><div class='search-page'><p>{text}</div></main>": text.strip(),
        f"<article><p>{text}<section id=related-work><h2>Others</h2><p>{text}</section></article>": f"{text.strip()}\nOthers\n{text.strip()}",
        f"<article><p>{text}<noscript><p>{text}</noscript><p>Let <math>x = 2</math> be given, as we said above.</article>":
            f"{text.strip()}\n{text.strip()}\nLet x = 2 be given, as we said above.",
        f"<article><p>{text}</article><div class=comment-list><article><p>Nice words, thank you for them.</article></div>": text.strip(),
        f"<article><p>{text}<div class=related-posts><a>More of this</a></div></article>": text.strip(),
    }
    rows = [(n, "u", p, "clash", 1) for n, p in enumerate(pages)] * 2 + [(99, "u", f"<article><p>{text * 20_000}</article>", "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_blocks.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = list(pages.values())[r.page_id] if r.page_id < 99 else (text * 20_000).strip()
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id

"""Every operator and stage on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing column names, against brute force where it differs
from the plain cases of the other tests."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import decontaminate, repeats, simhash_components

from interlinear.llm import (class_lm, cotraining, decontamination, html_blocks, packing, repeats as R, simhash,
                             surrogates, token_store, topk)
from interlinear.llm.common import shared_dir

LONG = "lorem ipsum dolor " * 8000
ROWS = [(1, "The cat sat on the mat, the cat sat."), (1, "The cat sat on the mat, the cat sat."), (2, None), (3, ""),
        (None, "a null id"), (None, None), (4, " \t\n "), (5, LONG), (6, "bob@mail.example.com +1 (017) 555-7713"),
        (7, "İ ß \x00 <|endoftext|> é́  x"), (8, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, t, "en" if t else None, None, None, n, "c", "r") for n, (i, t) in enumerate(ROWS)],
        "doc_id long, text string, lang string, source string, n_chars long, row long, component string, n_entities string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def _ids(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_token_store(spark, docs, none):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(vocabulary)
    plain.encode_special_tokens = True
    path = f"{shared_dir(spark)}/store-edges"
    token_store.write(docs, vocabulary, path)
    got = token_store.read(spark, path).collect()
    assert len(got) == len(ROWS)
    expected = sorted((i if i is not None else -1, t or "") for i, t in ROWS)
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), expected, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_store.write(none, vocabulary, path + "-none")
    assert token_store.read(spark, path + "-none").count() == 0


def test_elias_fano():
    for values in ([], [0], [5, 5, 5], [0, 0, 7, 1000, 1001], np.cumsum(np.arange(500) % 37).tolist(), [2**33]):
        ef, end = token_store.EliasFano.from_bytes(b"xx" + token_store.EliasFano.encode(values).to_bytes(), 2)
        assert ef.values().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    page = token_store.Page(token_store.page_bytes([None, 3], [b"\1\0", b"\2\0\3\0"]))
    assert page.doc_ids == [None, 3] and page.document(1).tolist() == [2, 3] and page.document(0).tolist() == [1]


def test_packing(docs, none):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    per_seq = {}
    for r in got:
        assert r.length * 2 == len(r.ids)
        per_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in per_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sum(r.length for r in got if r.start == 0) + sum(r.length for r in got if r.start) == sum(
        r.doc_tokens for r in got if r.start == 0)
    assert sum(r.start == 0 for r in got) == len(ROWS)
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).select("id", "fp", "component").collect()
    assert _ids([(r.id, r.component) for r in got]) == _ids([(i, c) for i, c in simhash_components(ROWS)])
    assert simhash.near_duplicates(none).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    items = [("a", "the cat sat on the mat"), ("b", "x"), ("b", "x"), (None, "null id"), ("c", None), ("d", " ".join(["lorem ipsum dolor"] * 9)), ("e", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = _ids(decontaminate(ROWS, items))
    for size in (8_000_000, 20):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.decontaminate(docs, bench).collect()
        assert _ids([(r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in got]) == expected
        assert all(sum(s.length for s in r.spans) == r.n_hit for r in got)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not e[-1] for e in expected)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_repeats(docs, none):
    expected = _ids(repeats(ROWS))
    got = R.remove_repeats(docs).collect()
    assert _ids([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]) == expected
    assert R.remove_repeats(none).count() == 0


def test_class_lm(docs, none):
    got = class_lm.score(docs, seed=4, classes=2, head_size=3, least=1).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert np.isfinite([r.base_score, r.score, r.perplexity]).all()
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0)
    assert class_lm.score(none).count() == 0


def test_class_lm_without_training_rows(docs):
    got = class_lm.score(docs.where("doc_id is null")).collect()
    assert [r.train_tokens for r in got] == [0, 0] and all(r.n_known == 0 and r.base_score == 0 for r in got)


def test_surrogates(docs, none):
    got = surrogates.pseudonymize(docs, "key").select("doc_id", "text", "n_entities").collect()
    before = _ids(ROWS)
    after = _ids([(r.doc_id, r.text) for r in got])
    assert len(after) == len(before)
    assert [a for a in after if a[0] != 6] == [b for b in before if b[0] != 6]
    changed = next(t for i, t in after if i == 6)
    assert "bob@mail" not in changed and "555-7713" not in changed and "+1 (" in changed
    assert surrogates.pseudonymize(none, "key").count() == 0


def test_cotraining(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, None), (None, 1, 1), (8, 1, 0), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for rows in (labels, labels.where("false")):
        got = cotraining.score(docs, rows).collect()
        assert len(got) == len(ROWS) and all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in got)
    assert all(r.keep for r in got)  # nothing is known, nothing is rejected
    assert cotraining.score(none, labels).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<article><p>one<p>two <b>bo</b>ld"),
                                   (5, "u", "<p title='x>"), (6, "u", "<script>if (a < b) '</p>'"), (None, "u", "<!-- open")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    assert got[1].text == got[2].text == got[5].text == got[6].text == got[None].text == ""
    assert got[3].text == "plain & text" and got[4].text == "one\ntwo bold" and got[4].n_chars == 12
    assert html_blocks.extract(pages.where("false")).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.5, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0]), (7, [1.0, 0.5, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, "id % 50 = 0", k=5).collect()
    usable = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for at, (i, v) in enumerate(usable):
        if i is not None and i % 50 == 0:
            others = [(-sum(map(np.multiply, v, w)), j is None, j or 0) for n, (j, w) in enumerate(usable) if n != at]
            expected += [(i, rank, None if late else j, int(-s)) for rank, (s, late, j) in enumerate(sorted(others)[:5], 1)]
    assert _ids([tuple(r) for r in got]) == _ids(expected)
    assert topk.top_k(vectors.where("false"), "id % 50 = 0").count() == 0

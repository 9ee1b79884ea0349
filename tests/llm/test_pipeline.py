"""Each stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline as P
from brute import decontaminate, simhash_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [(str(i), t) for i, t in items]
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = P.materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows} if name != "packing" else None
        if name == "near_duplicates":
            expected = {c for _, c in simhash_components(list(before.items()))}
            assert set(after) == expected and all(before[i] == t for i, t in after.items())
        elif name == "benchmark":
            expected = {i for i, *_, bad in decontaminate(list(before.items()), items) if not bad}
            assert set(after) == expected and all(before[i] == t for i, t in after.items())
        elif name == "personal_data":
            assert set(after) == set(before)
            private = [m for t in before.values() for m in re.findall(r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}", t)]
            assert private and not any(m in t for m in private for t in after.values())
        elif name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            tokens = {r.doc_id: r.doc_tokens for r in rows}
            assert sum(r.length for r in rows) == sum(tokens.values())
        docs = out


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "packing"]


def test_stages_on_nulls_and_clashing_names(spark):
    """Null ids and texts, repeated rows and columns named like the operators' own."""
    rows = [(1, "bob@mail.example.com wrote to ann", "en"), (1, "bob@mail.example.com wrote to ann", "en"), (2, None, None),
            (3, "", "de"), (None, "a null id", None), (4, "word " * 3000, "en")]
    docs = spark.createDataFrame([(i, t, g, None, None, 7, "k", "s", 9, "r", "c") for i, t, g in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n_entities int, keep string, "
                                 "quality_score string, c0 int, row string, utf8 string")
    empty = docs.where("false")
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, SF), "edge-" + name)
        got = out.collect()
        assert P.materialize(stage(spark, empty, SF), "none-" + name).count() == 0
        if name == "packing":
            assert sum(r.start == 0 for r in got) == len(docs.collect())
            continue
        assert out.schema == docs.schema
        assert all((r.n_entities, r.keep, r.quality_score, r.c0, r.row, r.utf8) == (7, "k", "s", 9, "r", "c") for r in got)
        if name == "near_duplicates":  # copies are one, null and empty texts are alike
            assert len({r.text or "" for r in got}) == len(got)
        if name == "personal_data":
            assert not any("bob@" in (r.text or "") for r in got)
        docs = out

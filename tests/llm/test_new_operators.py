"""Spelling variants, Merkle manifest and exact duplicates against brute force,
on edge rows, random rows and rows that fill one group."""

import random
from zlib import crc32

import pytest
from brute import exact_groups, merkle, spelling
from pyspark.sql import functions as F

from interlinear.llm import exact_dedup, merkle as M, spelling as S

LONG = "lorem ipsum " * 20_000
EDGE = [(1, "Abc"), (1, "Abc"), (2, None), (3, ""), (None, "Abc"), (None, None), (4, LONG), (5, LONG), (6, "é́ \x00 ß"), (7, "abc")]


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


# -- exact duplicates ---------------------------------------------------------

@pytest.mark.parametrize("bits, page", [(64, 256), (64, 2), (7, 2)])
def test_exact_groups(spark, bits, page):
    rng = random.Random(bits + page)
    rows = EDGE + [(n, f"text {rng.randrange(300)}") for n in range(600)] + [(n, "a hot text") for n in range(1000, 1500)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, h string, sha string, row long").repartition(5)
    got = exact_dedup.deduplicate(df, page=page, hash_bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert _sorted(got.collect()) == _sorted(exact_groups(rows))
    assert exact_dedup.deduplicate(df.where("false")).count() == 0


def test_buckets_split_and_chain():
    index = exact_dedup.ExtendibleHash(6, page=4)
    rng = random.Random(1)
    own = [rng.getrandbits(58) for _ in range(500)] + [7] * 20
    for n, h in enumerate(own):
        index.add(h, b"%d" % n, b"s" * 32, 1, (True, n, n))
        index.add(h, b"%d" % n, b"s" * 32, 2, (True, -1, n))
    assert len(index.directory) == 1 << index.depth and index.depth >= 7
    found = [r for b, (first, behind) in index.buckets() for r in exact_dedup.records(b.to_bytes()[0])]
    assert sorted(r[0] for r in found) == sorted(own) and {r[2] for r in found} == {3}
    for bucket, (first, behind) in index.buckets():
        assert len(bucket.chains) <= 4 and behind - first == 1 << (index.depth - bucket.depth)
        assert all(first <= index.slot(h) < behind for h in bucket.chains)
    assert len(index.directory[index.slot(7)].chains[7]) == 20  # one chain, told apart by bytes


# -- Merkle manifest ----------------------------------------------------------

def _tamper(r):
    if r[0] is None or r[4] is None or crc32(str(r[0]).encode()) % 3:
        return r
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))


def _manifest(df):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return M.manifest(df, ("doc_id", "source", "lang", "n_chars", "text"),
                      tampered={"text": F.translate("text", M.UPPER, M.LOWER)}, where=third)


def test_manifest(spark):
    rng = random.Random(3)
    rows = [(i, None if i else "s", lang, i, t) for (i, t), lang in zip(EDGE, ["en", "en", None, "", "de", None, "é", "en", "zz", "a"])]
    rows += [(rng.randrange(10**6), rng.choice(["s", None]), rng.choice(["en"] * 6 + ["de", None, "fr"]), n, f"Text {n}") for n in range(700)]
    rows += [(n, "one", f"lang{n:03}", None, "Xx") for n in range(70)]  # more than 64 groups
    rows += [(99, "same", "hot", 1, "A")] * 200
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g long, digest string")
    got = _manifest(df.repartition(6))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _sorted(got.collect()) == _sorted(merkle(rows, _tamper))
    assert _manifest(df.where("false")).count() == 0
    one = rows[:1]
    assert _sorted(_manifest(df.limit(1)).collect()) == _sorted(merkle(one, _tamper))


def test_manifest_of_many_blocks(spark):
    rows = [(n, "s", "en" if n % 40 else "de", n, f"T{n}") for n in range(4 * M.BLOCK + 77)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _sorted(_manifest(df).collect()) == _sorted(merkle(rows, _tamper))


def test_van_emde_boas_addresses():
    for levels in range(1, 6):
        places = M.addresses(levels)
        assert sorted(p for row in places for p in row.tolist()) == list(range(sum(8**d for d in range(levels))))
    # the bottom half of a subtree is one run of places
    four = M.addresses(4)
    own = [four[2][5], *four[3][40:48]]
    assert sorted(own) == list(range(min(own), min(own) + 9))


# -- spelling variants --------------------------------------------------------

def _texts(seed):
    rng = random.Random(seed)
    letters = "abcÉé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    rows = []
    for n in range(120):
        words = []
        for _ in range(80):
            w = rng.choice(base[:20] if rng.random() < .7 else base)
            if rng.random() < .3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice([rng.choice(letters), "", w[at] + rng.choice(letters)]) + w[at + 1:]
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((n if n % 9 else None, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, "x" * 3000 + " " + ("y" * 2999 + " ") * 6 + ("y" * 3000 + " ") * 40)]


@pytest.mark.parametrize("most", [50_000, 12, 2])
def test_spelling_variants(spark, most):
    rows = _texts(most)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = S.variants(df, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == spelling(rows)


def test_spelling_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(none).count() == 0
    assert S.variants(spark.createDataFrame([(1, "too rare words here")], "doc_id long, text string")).count() == 0


def test_acceptor_is_minimal():
    a = S.Acceptor()
    for w in sorted(["barks", "parks", "barns", "parns"]):
        a.add(w)
    assert a.initial() is not None and len(a.arcs) == 6  # one state for each letter that is left

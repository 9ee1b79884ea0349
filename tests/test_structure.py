"""Containers, link definitions, cell pieces and delimiter runs: cases written
after the CommonMark rules, and documents of many markers or lines."""

import time

from made import docs
from pyspark.sql import functions as F

from interlinear.functions import text as T
from interlinear.operators.render import render
from interlinear.operators.segments import extract_segments


def _texts(spark, cases):
    got = {n: [] for n in range(len(cases))}
    for r in extract_segments(docs(spark, *cases)).orderBy("doc_id", "seg_no").collect():
        got[r.doc_id].append(r.text + ("[tail]" if r.is_tail else ""))
    return [got[n] for n in range(len(cases))]


def test_containers(spark):
    cases = {
        "> - a\n>\n>   b\n> - c\n\nd": ["a", "b", "c", "d"],
        "- > q1\n  > q2\n- x\n": ["q1 q2", "x[tail]"],
        "1. one\n   - two\n     1. three\n\n        more three\n   - four\n2. five\n\npara": ["onetwothree", "more three", "fourfivepara"],
        "- a\n\n  - b\n  - c\n- d\n": ["a", "bcd"],
        "- a\n  - b\n\n  - c\n- d\n\nend": ["ab", "c", "dend"],
        "> a\nlazy\n> > b\nlazy2\n": ["a lazy", "b lazy2"],
        "- a\n\n      code\n\n  text\n": ["a", "text"],
        "- # head\n- b\n\npara": ["head", "bpara"],
        "- > a\n  >\n- b\n\nc": ["a", "bc"],
        "* a\n+ b\n\nc": ["abc"],
        "-\n\n  no item\n": ["no item"],
        "a\n-\n": ["a"],
        "| a |\n| - |\n> q\n": ["a", "q"],
        "a | b\n:- | -\n- x\n\ny": ["a", "b", "xy"], "a | b\n- | -\n": ["a | b", "| -[tail]"],
        "": [], "\n\n": [], "\tcode\n\nx": ["x"],
    }
    assert _texts(spark, cases) == list(cases.values())


def test_link_definitions(spark):
    cases = {
        "[Foo Bar]: <u v> \"t\"\n[x]:\n/url\n'multi\nline'\ntext [foo  bar][] ![img][x] [y][X] [nope][] \\[foo bar]\n":
            ["text foo  bar img y [nope][] [foo bar]"],
        "[a]: /u \"bad title\nstill para [a]\n\nq [a]": ['[a]: /u "bad title still para [a]', "q [a]"],
        "- t\n\n[a]: /u\n\n[a] z": ["ta z"],
        "[foo][bar][baz]\n\n[baz]: /u": ["[foo]bar"],
        "[![alt](i)](u) [a [b](c) d](e)": ["alt [a b d](e)"],
        "para\n[a]: /no\n\n[a]": ["para [a]: /no", "[a]"],
        "`a[b](c)` [x`](y)`": ["`a[b](c)` [x`](y)`"],
        "[b\\]c]: /u\n\n[b\\]c]": ["b]c"],
    }
    assert _texts(spark, cases) == list(cases.values())


def test_delimiter_runs(spark):
    cases = {
        "*a **b* c** d": ["a b c d"], "**foo*bar**baz*": ["foo*barbaz*"], "***strong** em*": ["strong em"],
        "foo***bar***baz": ["foobarbaz"], "*foo [bar*](u) x*": ["foo bar* x"], 'a*"foo"*': ['a*"foo"*'], "**a~~b**c~~": ["a~~bc~~"],
        "~~x~~ ~y~ ~~~z~~~": ["x ~y~ ~~~z~~~"], "foo_bar_ _x_y": ["foo_bar_ _x_y"], "**": ["**"], "a****b": ["a****b"],
    }
    assert _texts(spark, cases) == list(cases.values())


def test_many_markers_and_lines_in_linear_time(spark):
    for mark in ("*a ", "a* ", "*a* ", "[a] ", "**x _y "):
        start = time.time()
        few = extract_segments(docs(spark, mark * 2_000)).count()
        short, start = time.time() - start, time.time()
        assert extract_segments(docs(spark, mark * 40_000)).count() == few == 1
        assert time.time() - start < 10 * short + 10  # twenty times the text
    assert extract_segments(docs(spark, "- a\n  > b\n" * 8_000)).count() == 8_000


def test_fold_over_pieces(spark):
    """A running sum with an output for each element, at lengths around the piece sizes."""
    step = "named_struct('n', s.n + x, 'cur', array_append(s.cur, s.n + x))"
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 10_000):
        xs = f"slice(sequence(1, {max(n, 1)}), 1, {n})"
        got = spark.range(1).selectExpr(T.fold(xs, {"n": "0"}, "int", step) + " as v").first().v
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_rendered_segments_are_originals_and_translations_in_turn(spark):
    cases = ["> - a\n>\n>   b\n>\n> - c\n\nd\n", "1. one\n\n   - two\n\n     > three\n\n2. four\n\n# h\n", "> > deep\n> lazy\n\n- x\n\n      code\n\n  y\n",
             "- a\n\n  1. b\n\n     c\n\n- d\n\nplain *em* text\n"]
    d = docs(spark, *cases)
    segs = extract_segments(d).withColumn("translation", F.concat(F.lit("T "), "text"))
    own = {}
    for r in segs.orderBy("doc_id", "seg_no").collect():
        own.setdefault(r.doc_id, []).extend([r.text, "T " + r.text])
    again = {}
    for r in extract_segments(render(d, segs), text_col="rendered").orderBy("doc_id", "seg_no").collect():
        again.setdefault(r.doc_id, []).append(r.text)
    assert again == own


def test_cell_pieces_go_back_to_their_places(spark):
    text = "| a | b |\n| --- | --- |\n| x `c` **d** e | [l](u) &amp; \\* z |\n| `only` | p\\|q |\n"
    d = docs(spark, text)
    segs = extract_segments(d).withColumn("translation", F.concat(F.lit("T("), "text", F.lit(")")))
    assert [r.text for r in segs.orderBy("seg_no").collect()] == ["a", "b", "x ", "`c` ", "d", " e", "l", " ", "&", " ", "* z", "`only`p|q"]
    assert render(d, segs).first().rendered == (
        "|a\tT(a)|b\tT(b)|\n| --- | --- |\n|x \tT(x )`c` \tT(`c` )**d\tT(d)** e\tT( e)|[l\tT(l)](u) \tT( )&amp;\tT(&) \tT( )\\* z\tT(* z)|\n"
        "|`only`|p\\|q\tT(`only`p\\|q)|\n")


def test_elements_end_at_their_own_tag_also_deep_down(spark):
    from interlinear.operators.html import html_tag_text
    page = "<div>a<div>b</div>c<div>d</div></div></div>e<div>f"
    d = spark.createDataFrame([(0, page), (1, None), (2, "")], "page_id long, html string")
    assert [(r.pos, r.text) for r in html_tag_text(d, "div").orderBy("pos").collect()] == [(0, "abcd"), (1, "b"), (2, "d"), (3, "f")]
    deep = spark.createDataFrame([(0, "<div>" * 20_000 + "x" + "</div>" * 20_000)], "page_id long, html string")
    start = time.time()
    assert {r.text for r in html_tag_text(deep, "div").collect()} == {"x"}
    assert time.time() - start < 60

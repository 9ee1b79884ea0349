"""H1 / H2: visible text of HTML pages, as native expressions.

H1 removes comments and script elements (style elements too unless
``keep_style``); whichever of them begins first wins, so comment marks in a
script and scripts in a comment do no harm. Block-level tags then become a
space and inline tags nothing, character references are decoded and white
space is collapsed. H2 returns the text of every element with a given tag name:
elements that end by themselves (``p``, ``li``, ...) run to the next tag that
closes them, others to their matching end tag, also when nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlinear.functions.text import col_of, decode_entities, fold, let

# the rest of a tag: quoted values may hold a closing bracket
_REST = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
_COMMENT = r"<!--[\s\S]*?-->"
_SCRIPT = r"<script\b" + _REST + r"[\s\S]*?</script\s*>"
_STYLE = r"<style\b" + _REST + r"[\s\S]*?</style\s*>"
# Inline elements, whose tags do not part words.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
# Elements without a needed end tag, and what ends a paragraph.
IMPLIED = set("p li dt dd td th tr option".split())
BLOCK = ("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
         "header hr html li main menu nav ol pre section table td th tr ul")
_INLINE_TAG = r"(?i)</?(?:" + INLINE.replace(" ", "|") + r")(?=[\s/>])" + _REST
TAG = r"</?[a-zA-Z]" + _REST + r"|<[!?][^>]*>"
WS = r"\s+"


def _without_scripts(c: Column, keep_style: bool = True) -> Column:
    return F.regexp_replace(c, "(?i)" + "|".join([_COMMENT, _SCRIPT] + ([] if keep_style else [_STYLE])), " ")


def visible_text(c, keep_style: bool = True) -> Column:
    """H1 as a column expression."""
    t = F.regexp_replace(_without_scripts(col_of(c), keep_style), _INLINE_TAG, "")
    t = decode_entities(F.regexp_replace(t, TAG, " "))
    return F.trim(F.regexp_replace(t, WS, " "))


def html_inner_text(pages: DataFrame, key: str = "page_id", html_col: str = "html",
                    keep_style: bool = True) -> DataFrame:
    return pages.select(key, visible_text(html_col, keep_style).alias("text"))


# Where every element's text begins and ends, in page order: a fold gives each tag
# its level and the characters before it, and among the tags of a level, in order,
# an element's end follows its start.
_LEVELS = fold(
    "transform(t, (x, i) -> named_struct('i', i, 'n', char_length(element_at(p, i + 1)), 'ends', startswith(x, '</')))", {"d": "0", "c": "0"},
    "struct<level: int, i: int, c: int, ends: boolean>",
    "named_struct('d', if(x.ends, greatest(0, s.d - 1), s.d + 1), 'c', s.c + x.n, 'cur', array_append(s.cur,"
    " named_struct('level', if(x.ends, s.d, s.d + 1), 'i', x.i, 'c', s.c + x.n, 'ends', x.ends)))", "array_sort(s.cur)")
_SPANS = let("o", _LEVELS, "array_sort(transform(filter(transform(o, (x, k) -> named_struct('x', x, 'y', try_element_at(o, k + 2))), e -> not e.x.ends),"
             " e -> named_struct('i', e.x.i, 'a', e.x.c, 'z', if(coalesce(e.y.level = e.x.level and e.y.ends, false), e.y.c, char_length(whole)))))")


def html_tag_text(pages: DataFrame, tag: str = "p", key: str = "page_id", html_col: str = "html") -> DataFrame:
    """H2: one row per element ``<tag>`` in page order: its position and its text."""
    names = f"{tag}|{BLOCK.replace(' ', '|')}" if tag == "p" else tag
    token = rf"(?i)</?(?:{names})(?=[\s/>])" + _REST
    clean = _without_scripts(col_of(html_col))
    cut = pages.select(key, F.split(clean, token, -1).alias("p"), F.regexp_extract_all(clean, F.lit(token), F.lit(0)).alias("t"))
    opens = lambda x: x.rlike(rf"(?i)^<{tag}(?=[\s/>])")
    if tag in IMPLIED:  # up to the next token
        inner = F.transform(F.filter(F.arrays_zip(F.slice("p", 2, F.size("t")).alias("p"), "t"), lambda x: opens(x["t"])),
                            lambda x: x["p"])
    else:  # to its own end tag, else to the end of the page
        cut = cut.withColumn("whole", F.array_join("p", ""))
        inner = F.expr(f"transform({_SPANS}, e -> substring(whole, e.a + 1, e.z - e.a))")
    rows = cut.select(key, F.posexplode(inner).alias("pos", "raw"))
    return rows.select(key, "pos", decode_entities(F.regexp_replace("raw", TAG, "")).alias("text"))

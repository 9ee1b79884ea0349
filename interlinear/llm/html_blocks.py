"""Main-text extraction from flat text blocks with a trained decision tree.

A page is cut into flat text blocks (one per run of text between block-level
tags). A block's features are its word count and link density, those of its
neighbours, and where it stands (inside an article, inside page furniture by
tag or by class name, heading). A CART decision tree, trained here on the
blocks of a small labelled table of pages, keeps or drops each block.

Defined results: null or empty html gives the empty text; markup cut off at
the end of the page, unclosed tags, quotes, comments and scripts are read up to
the end; text outside any tag is a block. Every input row gives one row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step

# Element kinds and the class or id words of page furniture.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
            "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p "
            "pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style title textarea iframe template select button".split())  # no text of the article: scripts, form parts
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav footer aside form menu dialog".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe signup login register menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social comment comments "
    "commentlist reply replies respond disqus footer masthead copyright disclaimer pagination pager tagcloud search "
    "toolbar skip".split())
HEADER_WORDS = {"header", "topbar"}
READER_WORDS = set("comment comments commentlist reply replies respond disqus".split())
# inside an article these name furniture only alone or beside a word for a list or a box
WEAK_WORDS = set("related recommended search social".split())
LIST_WORDS = set("post posts article articles story stories link links news box widget bar form results items list icons buttons".split())
# what a wrapper has or has not is no name of its own
_STATE = re.compile(r"(?:no|has|with|without|is|hide)[-_]", re.I)

# The labelled table. A block that starts with + is main text.
TRAINING = [
    "<body><nav><ul><li><a href=/>-Home</a><li><a href=/n>-News</a><li><a>-About us</a></ul></nav><div class=ad>-Buy two, "
    "get one free this week only.</div><article><h1>+A walk by the river</h1><p>+We left early, before the town was awake, "
    "and followed the path along the water for two hours.<p>+Cold.<p>+The second bridge was closed, so we <a>turned "
    "back</a> and took the road over the hill instead.</article><footer>-(c) 2020 River Press. All rights reserved.</footer>",
    "<header><div>-The Daily Page</div><div>-Free and independent since 1950, every day of the week but Sunday.</div></header>"
    "<main><h1>+Council votes</h1><p>+The council voted on Monday to keep the library open for another year.</p><p>+It was "
    "close.</p><ul><li>+Nine in favour</li><li>+Eight against</li></ul></main><aside><h3>-Most read</h3><p>-Ten recipes for "
    "rainy days that the whole family will enjoy.</p></aside><div id=comments><p>-I was there and it was not like that at "
    "all, people shouted.</p><p>-Great piece!</p></div>",
    "<div class=cookie-notice><p>-We use cookies to make this site work. Read more in our policy.</p><a>-Accept</a></div>"
    "<div class=content><h2>+How to mend a chair</h2><p>+First take the seat off and look at the joints: if they are loose, "
    "they need new glue, not more nails.</p><p>+Let it dry.</p><p>+Sand the legs lightly, oil them twice and wait a day "
    "before you sit on it again.</p></div><div class='sidebar widget'><p>-Sign up and get a tip a day by mail from our "
    "workshop.</p></div>",
    "<div><a>-Home</a> <a>-Shop</a> <a>-Contact</a></div><div><a>-Archive 2019</a></div><div>+Our cat was found after three "
    "weeks in the shed of a neighbour, thin but in good health and very loud.</div><div>+She is home.</div><div>+Thanks to "
    "all who helped us look for her in the rain, day and night.</div><div><a>-Next post</a> <a>-Previous post</a></div>",
    "<article><header><h1>+Rain again</h1></header><p>+It rained.</p><p>+By noon the field was under water and the match was "
    "called off, to nobody's surprise.</p><form><label>-Your mail address</label><p>-Leave your mail and we will write to "
    "you.</p></form><footer><p>-Filed under weather</p></footer></article><section class=related-posts><h3>-You may also "
    "like</h3><p>-Sun at last, and what it did to the grass</p></section>",
    "<div class=article-body><p>+Prices rose again in March, the bureau said.</p><div class=promo-box><p>-Subscribe now and "
    "save half for a whole year of reading.</p></div><p>+Bread was the exception.</p><p>+Analysts had expected a smaller "
    "rise, since fuel has been cheap for months.</p></div><div class=social-share><span>-Share this story with your "
    "friends</span></div><div class=comment-list><p>-First! Nothing surprises me any more.</p></div>",
    "<article><h1>+B.</h1><p>+One.</p><p>+Two words.</p><p>+Yes.</p></article><div class=alert>-This page will be down for "
    "repair on Sunday from two to four.</div><footer><p>-Printed on paper from well kept forests, delivered by bike to your "
    "door.</p><p>-Imprint</p></footer>",
    "<nav><p>-Here you find everything about our club, its teams and its history.</p><a>-Teams</a></nav><main><p>+The club was "
    "founded by four friends who had a ball and no field.</p><p>+<a>The first field</a></p><p>+It was a meadow.</p></main>",
]

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
FEATURES = ["words", "links", "words before", "links before", "words after", "links after", "article", "furniture tag",
            "furniture name", "heading"]


def _named(attributes: str, article: int) -> int:
    """Whether a class, id or role names furniture: 2 for reader comments."""
    found = 0
    for v in _NAMES.finditer(attributes):
        for token in (v[1] or v[2] or v[3] or "").split():
            if _STATE.match(token):
                continue
            said = {w.lower() for w in _WORD.findall(token)}
            if said & READER_WORDS:
                return 2
            strong = said & (FURNITURE_WORDS - WEAK_WORDS) or (not article and said & HEADER_WORDS)
            weak = said & WEAK_WORDS and (not article or len(said) == 1 or said & LIST_WORDS)
            found = 1 if strong or weak else found
    return found


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, own features) of the non-empty blocks of a page; text is decoded,
    its white space single spaces, trimmed."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, int, int, int]] = []  # name, article, furniture by tag, by name (2: reader comments)
    pieces: list[tuple[str, bool]] = []
    in_link, heading = False, 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
            if text:
                words = max(1, text.count(" ") + 1)
                linked = sum(len(p.split()) for p, a in pieces if a)
                _, article, tag, name = stack[-1] if stack else ("", 0, 0, 0)
                out.append((text, [words, min(1.0, linked / words), article, tag, min(name, 1), heading]))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            pieces.append((page[at:], in_link))
            break
        if m.start() > at:
            pieces.append((page[at:m.start()], in_link))
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            if name in BLOCK or name in ("title", "button", "select", "textarea"):
                flush()
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br":
            pieces.append(("\n", in_link))
            continue
        if name == "a":
            in_link = not closing
            continue
        if name not in BLOCK:
            continue
        flush()
        heading = int(not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6"))
        in_link = False
        if name in VOID:
            continue
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in ("p", "li", "td", "th", "dd", "dt", "tr", "option"):  # an open one of the same kind ends here
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    del stack[n:]
                    break
                if stack[n][0] not in ("p", "li", "td", "th", "dd", "dt"):
                    break
        _, article, tag, named = stack[-1] if stack else ("", 0, 0, 0)
        if name in ("article", "main"):
            # a wrapper's name does not mark the article in it; reader comments stay marked
            article, named = 1, 0 if named == 1 and not article else named
        if name in FURNITURE or (name == "header" and not article):
            tag = 1
        if name not in ("html", "body", "article", "main"):
            named = max(named, _named(m[3], article))
        stack.append((name, article, tag, named))
    flush()
    return out


def features(found: list[tuple[str, list[float]]]) -> np.ndarray:
    """One row per block, columns as FEATURES; before the first and after the
    last block stand zeros."""
    own = np.array([f for _, f in found], float).reshape(len(found), 6)
    edge = np.zeros((1, 2))
    sizes = np.concatenate([edge, own[:, :2], edge])
    return np.concatenate([own[:, :2], sizes[:-2], sizes[2:], own[:, 2:]], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """CART with Gini impurity: nested (feature, limit, below, above), a leaf is
    True or False. Ties between splits go to the lower feature number."""
    share = y.mean()
    if share in (0, 1) or depth == 0 or len(y) < 2 * least:
        return bool(share >= 0.5)
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            below = x[:, f] <= limit
            n = below.sum()
            if least <= n <= len(y) - least:
                a, b = y[below].mean(), y[~below].mean()
                impurity = 2 * a * (1 - a) * n + 2 * b * (1 - b) * (len(y) - n)
                if impurity < best[0] - 1e-9:
                    best = (impurity, f, limit)
    if best[1] is None:
        return bool(share >= 0.5)
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    feature, limit, low, high = tree
    below = x[:, feature] <= limit
    out = np.empty(len(x), bool)
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


def train(pages: list[str] | None = None):
    """Decision tree from labelled pages (default: the table above)."""
    found = [blocks(p) for p in pages or TRAINING]
    labels = np.array([text.startswith("+") for page in found for text, _ in page])
    return grow(np.concatenate([features(page) for page in found]), labels)


def extract(pages: DataFrame, html_col: str = "html", tree=None) -> DataFrame:
    """``pages`` without its html, with ``text`` (kept blocks joined by a line
    feed) and ``n_chars``."""
    tree = train() if tree is None else tree
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(p) for p in b.column(len(kept)).to_pylist()]
            sizes = [len(page) for page in found]
            keep = iter(decide(tree, np.concatenate([features(page) for page in found])) if sum(sizes) else ())
            texts = ["\n".join([text for text, _ in page if next(keep)]) for page in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    from pyspark.sql import types as T

    out = T.StructType([f for f in rows.schema.fields if f.name != "__html"]).add("text", "string").add("n_chars", "long")
    return arrow_step(rows, step, out)

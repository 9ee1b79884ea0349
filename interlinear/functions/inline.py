"""Markdown inline markup: protected pieces set apart, brackets to links,
emphasis and strike markers dropped, character references decoded.

Called by the Arrow step that reads a document (``operators.segments``). Plain
prose leaves after a few substring tests.
"""

from __future__ import annotations

import re
from functools import cache
from html.entities import html5
from unicodedata import category

from interlinear.functions.java_regex import java

# Private-use characters stand for pieces that no rule may touch (open, number,
# close; a source character equal to ``open`` becomes open + own), for the ends
# of a link, for markup that was dropped and for the end of a carried paragraph.
_OPEN, _OWN, _CLOSE, _LINK, _LINKED, _GONE, CARRY = (chr(0xE000 + n) for n in range(7))

# A code span: a backtick run, content, the same run again.
CODE_SPAN = r"(?<!`)(`+)(?!`)([^" + CARRY + r"]*?[^`" + CARRY + r"])\1(?!`)"
_AUTOLINK = r"<([a-zA-Z][a-zA-Z0-9+.\-]{1,31}:[^<>\s]*|[^<>\s@]+@[^<>\s@]+\.[^<>\s@]+)>"
TAG = (r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|<![A-Za-z][^>]*>|"
        r"</?[a-zA-Z][a-zA-Z0-9\-]*(?:\s+[a-zA-Z_:][a-zA-Z0-9_.:\-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>")
_FOOTNOTE = r"\[\^[^\]\s]+\]"
# What no later rule may touch: escapes, code spans, autolinks, raw HTML, footnote references.
PROTECTED = r"\\[!-/:-@\[-`{-~]|" + f"{CODE_SPAN}|{_AUTOLINK}|{TAG}|{_FOOTNOTE}"


def _nested(open_: str, close: str, plain: str, depth: int) -> str:
    """Balanced brackets as a regex, nested up to ``depth`` levels."""
    inner = f"{plain}*+"
    for _ in range(depth):
        inner = f"(?:{plain}++|{open_}{inner}{close})*+"
    return inner


# CommonMark bounds nested parentheses of a link destination at 32 levels.
DEST = r"\(\s*+(?:<[^<>\n]*>|" + _nested(r"\(", r"\)", r"[^()\s]", 32) + r")(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)"
_BRACKET = rf"!?\[|\](?=({DEST})?)(?=(\[[^\[\]]{{0,999}}\])?)|{CARRY}"

_APART = ("`", "<", "\\", _OPEN, "[^")  # a text without these has no protected pieces
_protected, _bracket = java(PROTECTED), java(_BRACKET)
_ticks, _padded, _whole_autolink = java("^`+|`+$"), java(r"^ ([\s\S]*[^ ][\s\S]*) $"), java("^" + _AUTOLINK + "$")
_escape, _space, _number = java(r"\\(?=[!-/:-@\[-`{-~])"), java(r"\s+"), java(f"{_OPEN}([0-9]+){_CLOSE}")
_runs = re.compile(rf"\*+|_+|~+|[{_LINK}{_LINKED}{CARRY}]")


def label_key(x: str) -> str:
    """Link labels match without case, outer white space, runs of it and escapes."""
    return _space.sub(" ", _escape.sub("", x)).strip(" ").lower()


def _apart(text: str) -> tuple[str, list[str] | None]:
    """``text`` with numbers for its protected pieces, and what these read as."""
    if not any(c in text for c in _APART):
        return text, None
    kept, out, at = [], [], 0
    for n, found in enumerate(_protected.finditer(text)):
        x = found[0]
        if x[0] == "`":
            piece = "`" + _padded.sub(r"\1", _ticks.sub("", x)) + "`"
        elif x[0] == "\\":
            piece = x[1:]
        else:
            piece = x[1:-1] if _whole_autolink.search(x) else ""
        kept.append(piece)
        out += text[at:found.start()].replace(_OPEN, _OPEN + _OWN), f"{_OPEN}{n}{_CLOSE}"
        at = found.end()
    return "".join(out) + text[at:].replace(_OPEN, _OPEN + _OWN), kept


def _links(t: str, refs: list[str] | None, kept: list[str] | None) -> str:
    """Brackets to links: one pass over the brackets with a stack of the open
    ones. A closing bracket makes a link if a destination follows, or a label
    (or its own text, where none follows) that the document defines. Link ends
    become marks and what follows the text of a link is dropped."""
    ms = list(_bracket.finditer(t))
    if not ms:
        return t
    starts, ends = [m.start() for m in ms] + [len(t)], [m.end() for m in ms]
    size = lambda j: starts[j + 1] - ends[j]  # noqa: E731  the text behind mark j
    opened: list[tuple[int, bool]] = []
    dead = skip = 0
    act, cut = [0] * len(ms), [0] * len(ms)

    def length(j: int, top: int) -> int:
        """Of what is dropped behind a link that ends at mark j; -1: no link."""
        dest, label = ms[j][1] or "", ms[j][2] or ""
        if dest:
            return len(dest)
        if refs is None:
            return -1
        if label in ("", "[]"):
            own = "" if j - top > 999 else t[ends[top]:starts[j]]
            if _OPEN in own:
                own = _number.sub(lambda m: (kept or [])[int(m[1])], own).replace(_OPEN + _OWN, _OPEN)
            return len(label) if label_key(own) in refs else -1
        return len(label) if label_key(label[1:-1]) in refs else -1

    for j, m in enumerate(ms):
        mark = m[0]
        if skip > 0:
            rest = skip - len(mark)
            act[j], cut[j], skip = 3, max(0, min(rest, size(j))), max(0, rest - size(j))
        elif mark == CARRY:
            opened, dead = [], 0
        elif mark != "]":
            opened.append((j, mark == "!["))
        elif opened:
            top, image = opened[-1]
            k = -1 if not image and len(opened) <= dead else length(j, top)
            opened.pop()
            if k < 0:
                dead = min(dead, len(opened))
            else:
                dead = min(dead, len(opened)) if image else len(opened)
                act[top], act[j], cut[j], skip = 1, 2, min(k, size(j)), max(0, k - size(j))
    out = [t[:starts[0]]]
    for j, m in enumerate(ms):
        out += (m[0], _LINK, _LINKED, "")[act[j]], t[ends[j] + cut[j]:starts[j + 1]]
    return "".join(out)


@cache
def _kind(c: str) -> tuple[bool, bool]:
    """(white space or an end, punctuation) of a character beside a run."""
    return (c in ("", CARRY) or c in " \t\n\v\f\r\u0085" or category(c)[0] == "Z",
            c != "" and (_OPEN <= c <= _GONE or category(c)[0] in "PS"))


def _emphasis(t: str) -> str:
    """Matched emphasis and strike markers dropped: one pass over the delimiter
    runs with a stack of those that may open, by flanking and the rule of three;
    a link's text is a level of its own. A run that no later one could close
    is never pushed, and matched ones leave, so the work is linear in the text."""
    ms = list(_runs.finditer(t))
    if not ms:
        return t
    runs = []  # (marker, length, may open, may close)
    last = {"*": -1, "_": -1, "~": -1}
    for j, m in enumerate(ms):
        c, n = m[0][0], len(m[0])
        if c not in last:
            runs.append((c, n, False, False))
            continue
        wb, pb = _kind(t[m.start() - 1:m.start()] if m.start() else "")
        wa, pa_ = _kind(t[m.end():m.end() + 1])
        left, right = not wa and (not pa_ or wb or pb), not wb and (not pb or wa or pa_)
        opens, closes = left, right
        if c == "_":
            opens, closes = left and (not right or pb), right and (not left or pa_)
        elif c == "~":
            opens, closes = left and n == 2, right and n == 2
        runs.append((c, n, opens, closes))
        if closes:
            last[c] = j
    left_of = [0] * len(runs)  # markers that stay of each run
    st: list[tuple] = []  # (run, marker, markers left, length, both)
    count = {"*": 0, "_": 0, "~": 0}  # of the stack
    floors: list[int] = []

    def drop(to: int, stay: bool = True) -> None:
        while len(st) > to:
            e = st.pop()
            count[e[1]] -= 1
            if stay:
                left_of[e[0]] = e[2]

    for j, (c, n, opens, closes) in enumerate(runs):
        floor = floors[-1] if floors else 0
        if c == _LINK:
            floors.append(len(st))
        elif c == _LINKED:
            drop(floor)
            floors = floors[:-1]
        elif c == CARRY:
            drop(0)
            floors, left_of[j] = [], 1
        else:
            rem = n
            if closes and count[c]:
                for _ in range(max(1, len(st) - floor)):
                    i = len(st) - 1 if rem else -1
                    while i >= floor:
                        _, ec, en, size, both = st[i]
                        if (ec == c and (c != "~" or en == n) and not ((both or (opens and closes)) and (size + n) % 3 == 0
                                                                        and not (size % 3 == 0 and n % 3 == 0))):
                            break
                        i -= 1
                    if i < floor:
                        break
                    drop(i + 1)
                    e = st[i]
                    if e[2] > rem:
                        st[i] = (e[0], c, e[2] - rem, e[3], e[4])
                    else:
                        drop(i, False)
                    rem = max(0, rem - e[2])
            if rem and opens and j < last[c]:
                st.append((j, c, rem, n, opens and closes))
                count[c] += 1
            else:
                left_of[j] = rem
    drop(0)
    out, at = [], 0
    for m, n in zip(ms, left_of):
        out += t[at:m.start()], m[0][0] * n if n else m[0] if m[0] in (_LINK, _LINKED) else _GONE
        at = m.end()
    return "".join(out) + t[at:]


def marked(text: str, refs: list[str] | None) -> tuple[str, list[str] | None]:
    """A text with its markup read, and its protected pieces (None: it has none)."""
    t, kept = _apart(text)
    if "[" in t:
        t = _links(t, refs, kept)
    return _emphasis(t) if "*" in t or "~~" in t or ("_" in t and _beside_word.search(t)) else t, kept


_markup = re.compile(rf"[`<\\\[*_~&{_OPEN}{_LINK}-{CARRY}]")  # a text without these reads as it is
# a run of underscores inside a word neither opens nor closes
_beside_word = re.compile("(?<![A-Za-z0-9_])_|_(?![A-Za-z0-9_])")
_dropped = re.compile(f"[{_LINK}-{CARRY}]")
_reference = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


def _character(found: re.Match) -> str:
    """Numeric references by code point, names from the HTML5 table; unknown names stay."""
    x = found[0]
    if x[1] != "#":
        return html5.get(x[1:], x)
    n = int(x[3:-1], 16) if x[2] in "xX" else int(x[2:-1])
    return chr(n) if 1 <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else chr(0xFFFD)


def _decoded(x: str) -> str:
    """Each reference is read once, so ``&amp;lt;`` stays ``&lt;``."""
    return _reference.sub(_character, x) if "&" in x else x


def unmarked(x: str) -> str:
    return x if x.isascii() else _dropped.sub("", x)


def read(text: str, refs: list[str] | None) -> str:
    """Markdown inline markup to the text a translator should see.

    Links become their label (also reference links that ``refs``, the labels
    that the document defines, knows), images their alt text, emphasis and strike
    markers are dropped, raw HTML tags are dropped (their inner text stays),
    footnote references vanish, code spans keep one backtick on each side,
    backslash escapes become their character, character references are decoded.
    """
    if not _markup.search(text):
        return text
    t, kept = marked(text, refs)
    t = _decoded(unmarked(t))
    return t if kept is None else _number.sub(lambda m: kept[int(m[1])], t).replace(_OPEN + _OWN, _OPEN)


_special = re.compile(f"[&{_LINK}-{CARRY}]")
_own = re.compile(f"{_OPEN}([0-9]+){_CLOSE}")
# an escaped character begins a new run of text
_token = re.compile(rf"{_OPEN}[0-9]+{_CLOSE}[^{_OPEN}{_LINK}-{CARRY}&]*|&[A-Za-z0-9#]+;|"
                    rf"[^{_OPEN}{_LINK}-{CARRY}&]+(?:&(?![A-Za-z0-9#]+;)[^{_OPEN}{_LINK}-{CARRY}&]*)*|&|{_OPEN}{_OWN}")


def events(text: str, refs: list[str] | None) -> list[tuple[bool, str, str]]:
    """(code, text, as written) in order: a code span is one event, and so is
    every run of text between pieces of markup (emphasis and link ends, code,
    tags, escapes, character references)."""
    if not _markup.search(text):
        return [(False, text, text)]
    t, kept = marked(text, refs)
    if kept is None and not _special.search(t):
        return [(False, t, t)]
    out: list[tuple[bool, str]] = []
    for x in _token.findall(t):
        own = _own.match(x)
        if own is None:
            out.append((False, x))
            continue
        piece, rest = (kept or [])[int(own[1])], x[own.end():]
        if len(piece) == 1:
            out.append((False, piece + rest))
        else:
            out += (piece[:1] == "`", piece), (False, rest)
    return [(code, x if code else _decoded(x.replace(_OPEN + _OWN, _OPEN)), x) for code, x in out if x]

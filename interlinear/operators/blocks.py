"""M1 / M4 / M7: split documents into lines and classify each line's block role.

Each document is one input row, and all block structure comes from one fold
over its lines whose state is the stack of open containers (quotes and list
items), the open leaf (paragraph, fence, HTML block, table) and the ids of the
lists found loose. So quotes in items, items in quotes, nested lists, lazy
lines and code in containers need no window: the line explode is narrow, and
the corpus is hash-distributed on the document key once (``distribute_docs``)
for the island grouping that follows. The fold runs over Arrow batches of
documents (a line costs one pass of plain tests; the same fold as a column
expression copied its state after every line).

Documents without any line that could start a block but a paragraph skip it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlinear.functions.inline import label_key
from interlinear.functions.java_regex import java
from interlinear.functions.text import sql_str as _sql_str
from interlinear.session import ship

# CommonMark HTML block start condition 6 tag names.
HTML_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd "
    "details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav "
    "noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
).split()

# What starts an HTML block and what ends it; the last two end at a blank line.
_HTML_KINDS = [
    (r"(?i)^ {0,3}<(script|pre|style|textarea)([ \t>]|$)", r"(?i)</(script|pre|style|textarea)>"),
    (r"^ {0,3}<!--", "-->"),
    (r"^ {0,3}<\?", r"\?>"),
    (r"^ {0,3}<!\[CDATA\[", r"\]\]>"),
    (r"^ {0,3}<![A-Za-z]", ">"),
    (r"(?i)^ {0,3}</?(" + "|".join(HTML_BLOCK_TAGS) + r")([ \t>]|/>|$)", "blank"),
]
# the seventh kind, any whole tag on a line of its own, does not end a paragraph
_HTML_COND_7 = (
    r"^ {0,3}(<[a-zA-Z][a-zA-Z0-9\-]*(\s+[a-zA-Z_:][a-zA-Z0-9_.:\-]*(\s*=\s*([^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
    r"|</[a-zA-Z][a-zA-Z0-9\-]*\s*>)\s*$"
)
_FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
_ATX = r"^ {0,3}#{1,6}([ \t]|$)"
_HR = r"^ {0,3}([-*_])([ \t]*\1){2,}[ \t]*$"
_SETEXT = r"^ {0,3}(=+|-+)[ \t]*$"
_QUOTE = r"^ {0,3}> ?"
_ITEM = r"^ {0,3}([-*+]|[0-9]{1,9}[.)])([ \t]|$)"
# inside a paragraph only a bullet or a one with text behind it starts a list
_NO_LATE_ITEM = r"^ {0,3}(?:(?!0*1[.)])[0-9]{1,9}[.)]|(?:[-*+]|[0-9]{1,9}[.)])[ \t]*$)"
_MARKERS = r"^(?:[ >]|[-*+](?= |$)|[0-9]{1,9}[.)](?= |$))*"
_DELIM_ROW = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
_FOOTDEF = r"^ {0,3}\[\^[^\]]+\]:"
# a line that may start something other than a paragraph
_STRUCTURE = r"(?m)^[ \t]*(?:[>#`~<=|:*+_\[-]|[0-9]{1,9}[.)])|^(?: {4}| {0,3}\t)|\|"
# a link reference definition at the start of a paragraph's text
LINKDEF = (r"\[(?=[^\]]*[^\]\s])((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*+\n?[ \t]*+(?:<(?:[^<>\n\\]|\\.)*>|(?!<)[^\s]+)"
           r"(?:(?:[ \t]++\n?[ \t]*+|\n[ \t]*+)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*+(?:\n|$)")

# one source line; ``it``: the line opens a list item
_LINE = ("array<struct<body: string, kind: string, qdepth: int, list_id: int, prefix: string, it: boolean, loose: boolean,"
         " first: boolean, last: boolean, info: string, fence_ind: int, fence_no: int, refs: array<string>>>")
_LINE_TYPES = {"body": pa.string(), "kind": pa.string(), "qdepth": pa.int32(), "list_id": pa.int32(), "prefix": pa.string(),
               "it": pa.bool_(), "loose": pa.bool_(), "first": pa.bool_(), "last": pa.bool_(), "info": pa.string(),
               "fence_ind": pa.int32(), "fence_no": pa.int32(), "refs": pa.list_(pa.string())}
_MAY_START = frozenset(" `~<#-*_+>=[|:0123456789")  # what a line begins with that may be more than text
ENDS = "\n\r\u0085\u2028\u2029"  # before a last one of these, Java's $ matches too
LINES_AT_ONCE = 20_000  # line records held as Python objects


def distribute_docs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-distribute documents on their key (the pipeline's only Exchange).

    No partition count is fixed here: ``spark.sql.shuffle.partitions`` sets
    it, and AQE may coalesce small partitions at run time.
    """
    return docs.repartition(key)


_TABBED = java(r"^[ \t>]*(?:(?:[-*+]|[0-9]{1,9}[.)])[ \t]+)*")
_OPENS = java(r"^ {0,3}(?:>|[-*+]([ \t]|$)|[0-9]{1,9}[.)]([ \t]|$))")
_MARK = java(r"^( {0,3}(?:[-*+]|[0-9]{1,9}[.)]))( *)")
_BAR, _LEAD_BAR, _LAST_BAR = java(r"(?<!\\)\|"), java(r"^[ \t]*\|"), java(r"(?<!\\)\|[ \t]*$")
_quote, _item, _no_late_item, _markers, _hr, _fence, _atx, _setext, _delim_row, _footdef, _html_cond_7 = map(
    java, (_QUOTE, _ITEM, _NO_LATE_ITEM, _MARKERS, _HR, _FENCE, _ATX, _SETEXT, _DELIM_ROW, _FOOTDEF, _HTML_COND_7))
_html_kinds = [(java(start), end) for start, end in _HTML_KINDS]
_html_ends = {end: java(end) for _, end in _HTML_KINDS}
_def_start, _defs, _def = java(r"^\[[^^\]]"), java("^(?:" + LINKDEF + ")+"), java(LINKDEF)


def _split(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def _indent(x: str) -> int:
    return len(x) - len(x.lstrip(" ")) if x[:1] == " " else 0


def _cell_texts(x: str) -> list[str]:
    """The cells of a table line."""
    if "\\" not in x and x[-1:] not in ENDS:
        end = x.rstrip(" \t")
        x = end[:-1] if end[-1:] == "|" else x
        bare = x.lstrip(" \t")
        return (bare[1:] if bare[:1] == "|" else x).split("|")
    return _BAR.split(_LAST_BAR.sub("", _LEAD_BAR.sub("", x)))


def _cells(x: str) -> int:
    """Number of cells of a table line."""
    return len(_cell_texts(x))


def _opened(r: str, late: bool) -> tuple[str, list]:
    """The rest of a line behind the containers that it opens, and these as
    (kind, width, marker); ``late``: the line may go on a paragraph."""
    new: list = []
    for _ in range(max(1, len(_markers.match(r)[0]))):
        quote = _quote.match(r)
        if quote:
            r = r[quote.end():]
            new.append(("q", 0, ""))
        elif _item.match(r) and not _hr.match(r) and not (late and not new and _no_late_item.match(r)):
            mark = _MARK.match(r)
            m, sp = len(mark[1]), len(mark[2])
            width = m + 1 if r[m:].strip(" \t") == "" or sp >= 5 else m + sp
            new.append(("l", width, r[m - 1:m]))
            r = r[width:]
        else:
            break
    return r, new


def _html_start(r: str, para: bool) -> str:
    """What ends the HTML block that a line starts, empty if it starts none."""
    for start, end in _html_kinds:
        if start.match(r):
            return end
    return "blank" if not para and _html_cond_7.match(r) else ""


def _records(text: str) -> tuple[list, set]:
    """(line records, ids of loose lists) of a document's text; a record is
    (body, kind, qdepth, list_id, prefix, it, goes on a paragraph, info, fence_ind, fence_no)."""
    st: list = []  # open containers (kind, width, marker, list id)
    para = tbl = bl = pe = False
    pl = fl = fi = fno = bq = nl = depth = 0
    fc = h = prefix = ""
    info = piped = None  # piped: the line before, if it may be a table's head
    out, loose = [], set()
    for x in _split(text):
        if not st and "\t" not in x:  # outside of containers most lines show what they are
            c = x[:1]
            kind = ""
            if fc:
                kind = "code" if c != fc and c != " " else ""
            elif not h:
                kind = "blank" if c == "" else ("table_row" if c == "|" else "") if tbl else "" if c in _MAY_START else "text"
            if kind:
                goes_on = para and kind == "text"
                if kind != "code":
                    info = None
                out.append((x, kind, depth, 0, prefix, False, goes_on, info, fi, fno))
                para = kind == "text"
                pl = pl + 1 if goes_on else int(para)
                piped = x if para and "|" in x else None
                tbl, bl, bq, pe = kind == "table_row", kind == "blank", 0, False
                continue
        if "\t" in x:
            lead = _TABBED.match(x)[0]
            x = lead.replace("\t", "    ") + x[len(lead):]
        # 1. which open containers go on, and what is left of the line
        r, n, q = x, 0, 0
        for c in st:
            if c[0] == "q":
                quote = _quote.match(r)
                if not quote:
                    break
                r, q = r[quote.end():], q + 1
            elif r.strip(" \t") == "":
                if pe and n == len(st) - 1:
                    break
                r = ""
            elif _indent(r) >= c[1]:
                r = r[c[1]:]
            else:
                break
            n += 1
        al = n == len(st)
        inf, inh = fc != "" and al, h != "" and al
        # 2. containers that the line opens
        new: list = []
        bare = r.strip(" \t")
        if bare and bare[0] in ">-*+0123456789" and not inf and not inh and _OPENS.match(r):
            r, new = _opened(r, al and para)
            bare = r.strip(" \t")
        # 3. what the rest of the line is
        blank, c0, ind, inx, late = bare == "", bare[:1], _indent(r), inf or inh, para and not new
        cont = late and al
        closes = inf and ind <= 3 and r.lstrip(" ")[:1] == fc and len(bare) >= fl and bare.replace(fc, "") == ""
        fo, hs, atx, hr = "", "", False, False
        if not inx and not blank:
            if c0 in "`~":
                found = _fence.match(r)
                fo = found[1] if found else ""
            elif c0 == "<":
                hs = _html_start(r, late) if ind <= 3 else ""
            elif c0 == "#":
                atx = bool(_atx.match(r))
            elif c0 in "-*_":
                hr = bool(_hr.match(r))
        lazy = late and not al and not blank and fo == "" and not atx and not hr and hs == ""
        if inf:
            kind = "fence" if closes else "code"
        elif inh and not (h == "blank" and blank):
            kind = "html"
        elif blank:
            kind = "blank"
        elif lazy:
            kind = "text"
        elif fo:
            kind = "fence"
        elif ind >= 4 and not inx and not late:
            kind = "code"
        elif hs:
            kind = "html"
        elif tbl and al and not new and not atx and not hr:
            kind = "table_row"
        elif cont and pl == 1 and piped is not None and c0 in "|-:" and "|" in r and _delim_row.match(r) and _cells(r) == _cells(piped):
            kind = "table_delim"
        elif atx:
            kind = "heading"
        elif cont and c0 in "=-" and _setext.match(r):
            kind = "setext"
        elif hr:
            kind = "hr"
        elif c0 == "[" and not cont and _footdef.match(r):
            kind = "footdef"
        else:
            kind = "text"
        before = st
        if not lazy and (new or not al):
            st = before[:n]
            for j, (k, w, t) in enumerate(new):
                same = j == 0 and len(before) > n and before[n][0] == "l" and before[n][2] == t
                st.append((k, w, t, 0 if k == "q" else before[n][3] if same else nl + 1 + j))
            depth = sum(c[0] == "q" for c in st)
            prefix = "".join("> " if c[0] == "q" else " " * c[1] for c in st)
        # a blank line between two items, or two blocks of one item, makes their list loose
        if bl and not blank and not inx and not lazy and bq == q:
            if new and st[n][0] == "l" and st[n][3] <= nl:
                loose.add(st[n][3])
            elif n > 0 and before[n - 1][0] == "l":
                loose.add(before[n - 1][3])
        goes_on = kind in ("text", "setext") and (lazy or cont)
        fence = kind == "fence" and not inf
        if fence:
            info, fi, fno, fl = r[ind + len(fo):].strip(" \t"), ind, fno + 1, len(fo)
        elif not inf:
            info = None
        out.append((r, kind, depth, st[-1][3] if st else 0, prefix, bool(new) and new[-1][0] == "l", goes_on, info, fi, fno))
        para = kind in ("text", "footdef")
        pl = 0 if not para else pl + 1 if goes_on else 1
        piped = r if kind == "text" and "|" in r else None
        fc = fo[:1] if fence else fc if inf and not closes else ""
        if inh:
            h = "" if (blank if h == "blank" else _html_ends[h].search(r)) else h
        else:
            h = "" if kind != "html" or (hs != "blank" and _html_ends[hs].search(r)) else hs
        tbl = kind in ("table_delim", "table_row")
        bl, bq, pe, nl = kind == "blank" and not new and not inf, q, bool(new) and blank, nl + len(new)
    loose.discard(0)
    return out, loose


def _definitions(ls: list) -> tuple[set, list]:
    """(numbers of the lines that define links, their labels): definitions stand
    at the start of a paragraph and may take several lines."""
    numbers: set[int] = set()
    labels: dict[str, None] = {}
    if any(x[1] == "text" and "]:" in x[0] for x in ls):
        at = 0
        while at < len(ls):
            end = at + 1
            if ls[at][1] in ("text", "footdef"):
                while end < len(ls) and ls[end][1] == "text" and ls[end][6]:
                    end += 1
                if _def_start.match(ls[at][0].lstrip(" ")):
                    text = "\n".join(x[0].lstrip(" \t") for x in ls[at:end])
                    cut = _defs.match(text)
                    if cut and cut[0]:
                        used = end - at if cut.end() == len(text) else cut[0].count("\n")
                        numbers.update(range(at, at + used))
                        labels.update((label_key(found[1]), None) for found in _def.finditer(cut[0]))
            at = end
    return numbers, list(labels)


def _plain_columns(text: str) -> tuple:
    """Columns of a text whose lines start nothing but paragraphs."""
    body = _split(text)
    n, here = len(body), [x.strip(" \t") != "" for x in body]
    first = [not (x and before) for x, before in zip(here, [False, *here])]
    zero, no, none = [0] * n, [False] * n, [None] * n
    return (body, ["text" if x else "blank" for x in here], zero, zero, [""] * n, no, no, first, [*first[1:], True],
            none, zero, zero, none)


def _columns(text: str) -> tuple:
    """Columns of a text's lines, in the order of ``_LINE_TYPES``."""
    ls, loose = _records(text)
    numbers, labels = _definitions(ls) if "]:" in text else ((), [])
    body, kind, depth, list_id, prefix, it, goes_on, info, fi, fno = map(list, zip(*ls))
    n, first = len(body), [not x for x in goes_on]
    last = [*first[1:], True]  # only text and setext lines go on
    for i in range(1, n):
        if kind[i] == "table_delim" and kind[i - 1] == "text":
            kind[i - 1] = "table_head"
    for i in numbers:
        if kind[i] == "text":
            kind[i] = "linkdef"
        if i + 1 < n:
            first[i + 1] = True
    return (body, kind, depth, list_id, prefix, it, [x > 0 and x in loose for x in list_id] if loose else [False] * n,
            first, last, info, fi, fno, [labels if "[" in x else None for x in body] if labels else [None] * n)


def _lines_of(texts: pa.Array, structured: pa.Array) -> pa.Array:
    """The lines of each text, column by column; they turn into Arrow arrays
    when ``LINES_AT_ONCE`` are held."""
    offsets, parts, n = [0], [], 0
    held: list[list] = [[] for _ in _LINE_TYPES]

    def put() -> None:
        parts.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(held, _LINE_TYPES.values())], names=list(_LINE_TYPES)))
        for column in held:
            column.clear()

    for text, flag in zip(texts, structured):
        if text.is_valid:
            found = _columns(text.as_py()) if flag.as_py() else _plain_columns(text.as_py())
            n += len(found[0])
            for column, values in zip(held, found):
                column += values
            if len(held[0]) >= LINES_AT_ONCE:
                put()
        offsets.append(n)
    put()
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))


def block_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text",
                distribute: bool = True) -> DataFrame:
    """One row per source line with its block classification.

    Output columns: key, line_no, body (the line behind its container marks),
    kind, qdepth, prefix (what a further line in the same containers begins
    with), list_id (of the item that directly holds the line, else 0), loose,
    first and last (line of its paragraph), info, fence_ind, fence_no, level,
    content, refs (the document's link labels, where the line may use one).

    kind is one of: blank, fence, code, html, heading, setext, hr, text,
    footdef, linkdef, table_head, table_delim, table_row.
    """
    src = docs.select(key, text_col)
    if distribute:
        src = distribute_docs(src, key)
    k = f"`{key}`"
    ship(docs.sparkSession)
    # once a document: no filter or projection may repeat it
    fold = F.arrow_udf(_lines_of, _LINE).asNondeterministic()
    found = src.select(key, fold(F.col(text_col), F.coalesce(F.col(text_col).rlike(_STRUCTURE), F.lit(False))).alias("ls"))
    rows = found.selectExpr(k, "posexplode(ls) as (line_no, x)")
    lines = rows.selectExpr(k, "line_no", *[f"x.{c} as {c}" for c in _LINE_TYPES])
    heading_text = (
        f"regexp_replace(regexp_replace(regexp_replace(body, {_sql_str(r'^ {0,3}#{1,6}[ \t]*')}, ''),"
        f" {_sql_str(r'[ \t]*\{[^{}]*\}[ \t]*$')}, ''), {_sql_str(r'(^|[ \t]+)#+[ \t]*$')}, '')")
    item_text = f"if(it, regexp_replace(body, {_sql_str(r'^[ \t]*\[[ xX]\][ \t]+')}, ''), body)"
    footdef_text = f"regexp_replace(body, {_sql_str(r'^ {0,3}\[\^[^\]]+\]:[ \t]*')}, '')"
    content = (f"case when kind = 'heading' then {heading_text} when kind = 'footdef' then {footdef_text}"
               f" when kind = 'text' then {item_text} end")
    level = ("case when kind = 'heading' then length(regexp_extract(body, '^ {0,3}(#{1,6})', 1))"
             " when kind = 'setext' then (case when contains(body, '=') then 1 else 2 end) else 0 end")
    return lines.selectExpr("*", f"{level} as level", f"trim(' \t', {content}) as content").drop("it")

"""Column-expression helpers for text: Unicode trimming, lengths, link labels,
HTML entities.

Everything here returns a ``Column`` made of native Spark expressions, so it
stays inside whole-stage codegen (regexp_replace, split, zip_with, ...).
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from interlinear.functions.inline import _CLOSE, _LINK, _LINKED, _OPEN, _OWN, CARRY, TAG, _nested  # noqa: F401

# Unicode white space (Java's \s with UNICODE_CHARACTER_CLASS): a pattern with
# it would test every character of a text, a trim by list only the ends.
_WS = ("\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Strip Unicode white space at both ends."""
    return F.trim(col_of(c), F.lit(_WS))


def utrim_end(c) -> Column:
    """Strip Unicode white space at the end only."""
    return F.rtrim(col_of(c), F.lit(_WS))


def seg_bytes(c) -> Column:
    """UTF-8 byte length plus the trailing newline every segment carries."""
    return (F.octet_length(col_of(c)) + F.lit(1)).cast("bigint")


def seg_chars(c) -> Column:
    """Unicode scalar count plus the trailing newline."""
    return (F.char_length(col_of(c)) + F.lit(1)).cast("bigint")


# --- SQL building blocks ---------------------------------------------------

def sql_str(s: str) -> str:
    """A Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value`` once, so that an optimizer
    rewrite which substitutes the value grows the expression linearly."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def struct_of(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def fold(xs: str, start: dict[str, str], out: str, step: str, finish: str = "s.cur") -> str:
    """Left fold of ``step`` over the array ``xs``, whose state has the fields of
    ``start`` and the list ``cur`` of output records (type ``out``).

    ``step`` sees the state ``s`` and the element ``x`` and gives the next state;
    ``finish`` sees the last one, ``cur`` holding all records. Spark copies the
    whole state after each step, so the list is kept short: the fold runs over
    pieces of pieces of 64 elements and a piece's records leave the inner state
    at its end. A piece's steps cost the same however long the array is.
    """
    empty = f"cast(array() as array<{out}>)"
    fields = lambda s: ", ".join(f"'{f}', {s}.{f}" for f in start)

    def level(n: int, chunk: str, state: str) -> str:
        if n == 0:
            return f"aggregate({chunk}, named_struct({fields(state)}, 'cur', {empty}), (s, x) -> {step}, s -> s)"
        size, c = 64 ** n, f"c{n}"
        parts = f"transform(sequence(0, greatest(0, size({chunk}) - 1) div {size}), k{n} -> slice({chunk}, cast(k{n} * {size} + 1 as int), {size}))"
        inner = let(f"r{n}", level(n - 1, c, f"s{n}"), f"named_struct({fields(f'r{n}')}, 'full', array_append(s{n}.full, r{n}.cur))")
        return (f"aggregate({parts}, named_struct({fields(state)}, 'full', cast(array() as array<array<{out}>>)), (s{n}, {c}) -> {inner},"
                f" s{n} -> named_struct({fields(f's{n}')}, 'cur', flatten(s{n}.full)))")

    return let("x0", f"named_struct('a', {xs}, {', '.join(f"'{k}', {v}" for k, v in start.items())})",
               let("s", level(2, "x0.a", "x0"), finish))


# --- Markdown inline text -------------------------------------------------

def decode_entities(c) -> Column:
    """Decode numeric and named character references."""
    return F.element_at(F.transform(F.array(col_of(c)), _decoded), 1)


def _names() -> Column:
    """Named references as a map by first letter of maps, so that a look-up
    reads one letter's names and not all of them."""
    by: dict[str, dict[str, str]] = {}
    for name, char in html5.items():
        if name.endswith(";"):
            by.setdefault(name[:2], {})[name[:-1]] = char
    return F.from_json(F.lit(json.dumps(by, ensure_ascii=False)), "map<string,map<string,string>>")


def _decoded(v: Column) -> Column:
    """Numeric references by code point, names from the HTML5 table; each
    reference is read once, so ``&amp;lt;`` stays ``&lt;``. Unknown names stay."""
    ref = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = _names()

    def one(r):
        hexed = F.lower(F.substring(r, F.lit(3), F.lit(1))) == "x"
        cp = F.when(hexed, F.conv(F.regexp_extract(r, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(
            F.regexp_extract(r, "([0-9]+)", 1)).cast("bigint")
        numeric = F.when(cp.between(1, 1114111) & ~cp.between(55296, 57343),
                         F.decode(F.unhex(F.lpad(F.conv(cp.cast("string"), 10, 16), 8, "0")), "UTF-32")).otherwise(F.lit(chr(0xFFFD)))
        own = F.try_element_at(names, F.substring(r, F.lit(2), F.lit(2)))
        named = F.coalesce(F.try_element_at(own, F.substring(r, F.lit(2), F.length(r) - 2)), r)
        return F.when(F.substring(r, F.lit(2), F.lit(1)) == "#", numeric).otherwise(named)
    pieces = F.zip_with(F.split(v, ref, -1), F.transform(F.regexp_extract_all(v, F.lit(ref), F.lit(0)), one),
                        lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit(""))))
    return F.when(F.contains(v, F.lit("&")), F.array_join(pieces, "")).otherwise(v)


def _restored(x: str, kept: str) -> str:
    """``x`` with its protected pieces put back."""
    mark = sql_str(f"{_OPEN}([0-9]+){_CLOSE}")
    return (f"replace(array_join(zip_with(split({x}, {mark}, -1), regexp_extract_all({x}, {mark}, 1),"
            f" (p, k) -> concat(coalesce(p, ''), case when k is null then '' else element_at({kept}, cast(k as int) + 1) end)),"
            f" ''), {sql_str(_OPEN + _OWN)}, {sql_str(_OPEN)})")


_MARKS = f"[{_LINK}-{CARRY}]"


def link_labels(marked: str, kept: str) -> str:
    """SQL: the texts between link marks (M17), outermost links and images, as
    Markdown without its links."""
    inside = _nested(_LINK, _LINKED, f"[^{_LINK}{_LINKED}]", 16)
    found = f"regexp_extract_all({marked}, {sql_str(f'{_LINK}({inside}){_LINKED}')}, 1)"
    plain = f"regexp_replace(l, {sql_str(_MARKS)}, '')"
    return f"transform({found}, l -> " + let("u", plain, f"if({kept} is null, u, {_restored('u', kept)})") + ")"

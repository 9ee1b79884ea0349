"""Keyed surrogates for personal data, with DataFrame functions only.

A detected mention is cut into parts (a name into given name and surname), a
part has a type and a canonical form, and each canonical form gets one
surrogate from a keyed hash:

* same type and format: digits for digits, letters for letters of the same
  script and case, separators, country codes and top-level domains kept,
  octets in range, check digits valid where they were valid; letters outside
  ``ALPHABETS`` become Latin ones;
* given names keep gender and script;
* the same canonical form gets the same surrogate in every document and in
  every way of writing it (coreference), a compressed IPv6 address and its
  eight groups included; a surname found in a document is replaced wherever
  it stands as a word of its own in that document;
* collision check: surrogates of one type are made distinct, and none equals a
  canonical form that occurs in the corpus: losers are hashed again until no
  clash is left. Given names get a letter more each time; where a form is so
  short that its surrogates run out (``CROWDED`` attempts), they grow too, by
  letters or digits, and IPv4 octets change their width.

Null or empty text has no mention and stays as it is. Repeated rows are
rewritten alike; null ids are kept. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

# Titles and given names by gender and script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]}
GIVEN = {("f", "latin"): ["Alice", "Amélie", "Barbara", "Carmen", "Charlotte", "Emily", "Heidi", "Ingrid", "Jennifer",
                          "Laura", "Linda", "Margaret", "Maria", "Mary", "Patricia", "Sophie", "Susan", "Ursula"],
         ("m", "latin"): ["Andreas", "Charles", "David", "François", "George", "Hans", "James", "Javier", "John", "Jürgen",
                          "Klaus", "Michael", "Miguel", "Pierre", "Robert", "Thomas", "Wolfgang", "William"],
         ("f", "cyrillic"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
         ("m", "cyrillic"): ["Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"]}
# Alphabets a letter is replaced within.
DIGITS = "0123456789"
CROWDED = 6  # attempts in the form's own length: as many clashes in a row mean that it has too few surrogates
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ", "абвгдежзийклмнопрстуфхцчшщыэюя",
             "αβγδεζηθικλμνξοπρστυφχψω"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9a-fA-F]{1,4}"
_LABEL = r"(?i:token|secret|passwd|password|api_key|apikey|api-key|access_key)\\?[\"']?\s{0,3}[=:]"
_QUOTE = r"\s{0,3}\\?[\"']?"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# national numbers: trunk 0 (or 00 and a country) and 8 to 13 digits, no date; Russian 8; Spanish groups; US with or without 1
_NO_DATE = r"(?!(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})(?![./ -]?\d))"
_NATIONAL = "|".join([
    rf"{_NO_DATE}(?=\(?0(?:[() ./-]{{0,2}}\d){{7,12}}(?![() ./-]{{0,2}}\d))(?:\(0{{1,2}}[1-9]\d{{0,4}}\)|0{{1,2}}[1-9]\d{{0,4}})(?:[ ./-]{{0,2}}\(?\d{{1,8}}\)?){{1,6}}(?<=\d)",
    r"8[ -]?(?:\(\d{3,5}\)|\d{3,5})[ -]?\d{1,3}[ -]\d{2}[ -]?\d{2}",
    r"[6-9]\d{2}[ .-]\d{2}[ .-]\d{2}[ .-]\d{2}|[89]\d[ .-]\d{3}[ .-]\d{2}[ .-]\d{2}|[6-9]\d{2}[ -]\d{3}[ -]\d{3}",
    r"(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"])
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"
# in this order: the first kind that matches at a place wins
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": rf"(?=[\w./+-]{{8}})(?=[._/+-]*[A-Za-z0-9])(?<=[=:]{_QUOTE})(?<={_LABEL}{_QUOTE})[\w./+-]{{8,}}"
              r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|(?:[0-9a-f]{32,}|[0-9A-F]{32,}))\b",
    "mac": r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b",
    # compressed: only in the ranges that are dealt out, so that slices (1::2) and names (a::b) of code stay
    "ipv6": rf"\b(?:{_HEX}:){{7}}{_HEX}\b"
            rf"|(?<![\w:])(?!{_HEX}(?:::?{_HEX}){{7}})(?:(?:[23][0-9a-fA-F]{{3}}|[fF][c-fC-F][0-9a-fA-F]{{2}}|64:[fF]{{2}}9[bB])(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?"
            rf"|::[fF]{{4}}:{_HEX}:{_HEX})(?!\w|:[\w:]|\.\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b(?<=\d.{0,40})",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
             rf"|(?<![\d.,+/-])(?<!\d[ ])(?:{_NATIONAL})(?![\d/-]|[.,]\d|\p{{L}})",
    "name": rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:{_TITLE} {_NAME}(?: {_NAME})?|{_GIVEN} {_NAME})",
}
#: a mention starts after a character that is no letter or digit, or at a digit, plus or bracket
MENTION = r"(?:(?<![\p{L}\p{N}])|(?=[\d+(])(?<!\d))(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: cheap test that lets most clean texts skip the search: every match of KINDS holds or follows a match of it
TRIGGER = (rf"[0-9@]|(?=[A-Z\u0410-\u042Fг])(?<!\p{{L}})(?:{_TITLE}|{_GIVEN}) \p{{Lu}}|[=:](?<={_LABEL})"
           r"|AKIA|gh[pousr]_|sk-|eyJ|[a-f]{32}|[A-F]{32}|(?:[a-fA-F]{2}[:-]){5}|(?:[a-fA-F]{1,4}:){7}|[fF][c-fC-F][a-fA-F]{2}:")
_OPEN, _CLOSE = "\ue0f0", "\ue0f1"  # private use: set around mentions, in one search


def pieces(text: str) -> Column:
    """A text cut at its mentions: text, mention, text, ... (null for null).
    A text that holds one of the two marks itself is searched twice instead."""
    c = F.col(text)
    marked = F.split(F.regexp_replace(c, f"({MENTION})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    between, said = F.split(c, MENTION, -1), F.regexp_extract_all(c, F.lit(MENTION), F.lit(0))
    twice = F.flatten(F.zip_with(between, said, lambda b, s: F.when(s.isNull(), F.array(b)).otherwise(F.array(b, s))))
    return F.when(~c.rlike(TRIGGER), F.array(c)).when(c.contains(_OPEN) | c.contains(_CLOSE), twice).otherwise(marked)


def _kind(mention: Column) -> Column:
    """Kind of a whole mention; what is none of the others stood after a secret's label."""
    out = F.lit("secret")
    for kind, pattern in reversed(KINDS.items()):
        if kind != "secret":
            out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def parts(found: DataFrame) -> DataFrame:
    """(mention, place, type, canonical, written): parts of distinct mentions.
    A part of type '' is kept as written (titles, spaces)."""
    m = F.col("mention")
    gender = F.lit(None).cast("string")
    for (g, _), names in GIVEN.items():
        gender = F.coalesce(gender, F.when(F.col("word").isin(names), F.lit(g)))
    by_title = F.when(m.rlike(r"\A(?:" + "|".join(TITLES["f"]) + r")\.? "), "f").otherwise("m")
    rows = found.select("mention", _kind(m).alias("kind"))
    words = (rows.where("kind = 'name'").select("mention", F.posexplode(F.split("mention", r"(?<= )|(?= )|(?=['’]s\z)")).alias("place", "word"))
             .withColumn("own", F.col("word").rlike(r"\A['’]s\z"))
             .withColumn("last", F.max(F.when(~F.col("own"), F.col("place"))).over(_by_mention())))
    is_title = (F.col("place") == 0) & F.col("word").rlike(rf"\A{_TITLE}\z")
    is_given = gender.isNotNull() | ((F.col("place") > 0) & (F.col("place") < F.col("last")))
    names = words.select(
        "mention", "place",
        F.when(is_title | F.col("own") | (F.col("word") == " "), "")
        .when(is_given & (F.col("place") < F.col("last")),
              F.concat(F.lit("given:"), F.coalesce(gender, by_title), F.lit(":"), _script(F.col("word"))))
        .otherwise("surname").alias("type"), F.lower("word").alias("canonical"), F.col("word").alias("written"))
    digits = F.regexp_replace(m, r"\D", "")
    country = F.regexp_extract(m, r"\A\+(\d{1,3})[ .(-]", 1)
    rest = rows.where("kind <> 'name'").select(
        "mention", F.lit(0).alias("place"), F.col("kind").alias("type"),
        F.when(F.col("kind").isin("ssn", "card"), digits)
        .when(F.col("kind") == "phone", F.concat(country, F.lit("|"), F.expr("substring(regexp_replace(mention, '[^0-9]', ''), "
              "1 + char_length(regexp_extract(mention, '^[+]([0-9]{1,3})[ .(-]', 1)))")))
        .when(F.col("kind") == "iban", F.regexp_replace(m, " ", ""))
        .when(F.col("kind") == "ipv6", _eight_groups(m))
        .when(F.col("kind") == "secret", m).otherwise(F.lower(m)).alias("canonical"), m.alias("written"))
    return names.union(rest)


def _halves(address: Column) -> tuple[Column, Column, Column]:
    """Groups before and after '::', and the number of groups it stands for."""
    side = lambda n: F.filter(F.split(F.coalesce(F.get(F.split(address, "::"), F.lit(n)), F.lit("")), ":"), lambda x: x != "")
    return side(0), side(1), F.lit(8) - F.size(side(0)) - F.size(side(1))


def _eight_groups(address: Column) -> Column:
    left, right, gap = _halves(address)
    every = F.concat(left, F.filter(F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), lambda x: gap > 0), right)
    return F.array_join(F.transform(every, lambda x: F.lpad(F.lower(x), 4, "0")), ":")


def _by_mention():
    from pyspark.sql import Window

    return Window.partitionBy("mention")


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), F.lit(1) + byte % len(alphabet), F.lit(1))


def _stream(key: str) -> Column:
    """Hash bytes (hexadecimal) of the columns type, canonical, attempt."""
    seed = F.concat_ws("|", F.lit(key), F.col("type"), F.col("attempt").cast("string"), F.col("canonical"))
    blocks = F.floor((F.char_length("canonical") + 1 + F.col("attempt")) / 32).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), blocks), lambda b: F.sha2(F.concat_ws("#", seed, b.cast("string")), 256)), "")


def surrogate(stream: Column) -> Column:
    """Surrogate of the columns type, canonical, attempt: a canonical form again."""
    c, kind = F.col("canonical"), F.col("type")
    n = F.char_length(c)
    more = F.greatest(F.col("attempt") - CROWDED + 1, F.lit(0))  # letters, digits that a crowded form grows by
    byte = lambda i: F.conv(F.substring(stream, F.lit(2) * i - 1, F.lit(2)), 16, 10).cast("int")
    hexadecimal = c.rlike(r"\A[0-9a-f]+\z|\A[0-9A-F]+\z") | kind.isin("mac", "ipv6")

    def letter(i: Column) -> Column:
        ch = F.substring(c, i, F.lit(1))
        low = F.lower(ch)
        out = F.when(ch.rlike(r"\p{L}"), F.when(ch == low, _pick(ALPHABETS[0], byte(i))).otherwise(F.upper(_pick(ALPHABETS[0], byte(i))))).otherwise(ch)
        for alphabet in reversed(ALPHABETS):
            new = _pick(alphabet, byte(i))
            out = F.when(F.instr(F.lit(alphabet), low) > 0, F.when(ch == low, new).otherwise(F.upper(new))).otherwise(out)
        hexed = F.when(ch.rlike("[0-9a-fA-F]"), F.when(c.rlike("[A-F]"), F.upper(_pick("0123456789abcdef", byte(i))))
                       .otherwise(_pick("0123456789abcdef", byte(i)))).otherwise(ch)
        return F.when(hexadecimal & kind.isin("secret", "mac", "ipv6"), hexed) \
            .when(F.instr(F.lit(DIGITS), ch) > 0, _pick(DIGITS, byte(i))).otherwise(out)

    def octet_digit(i: Column) -> Column:
        ch, before = F.substring(c, i, F.lit(1)), F.substring(c, F.greatest(i - 1, F.lit(1)), F.lit(1))
        first = (i == 1) | (before == ".")
        three = F.substring(c, i, F.lit(3)).rlike(r"\A\d{3}\z")
        return F.when(ch == ".", ch).when(first & three, F.lit("1")).when(first, _pick("123456789", byte(i))).otherwise(_pick(DIGITS, byte(i)))

    spelled = lambda start, end, one: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i >= start) & (i <= end)), one), "")
    # groups of zeros and the range (first two digits) stay
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(39)), lambda i: F.when(
        (i <= 2) | (i % 5 == 0) | ((more == 0) & (F.substring(c, i - (i - 1) % 5, F.lit(4)) == "0000")), F.substring(c, i, F.lit(1))).otherwise(letter(i))), "")
    host_end = n - F.char_length(F.substring_index(c, ".", -1)) - 1
    doubled = lambda d: F.when(d > 9, d - 9).otherwise(d)

    def luhn(number: Column, shift: int) -> Column:
        """Luhn sum; shift 0: the last digit counts once, 1: twice."""
        size = F.char_length(number)
        return F.aggregate(F.transform(F.filter(F.sequence(F.lit(1), size + 1), lambda i: i <= size), lambda i: F.when(
            (size - i + shift) % 2 == 1, doubled(F.lit(2) * F.substring(number, i, F.lit(1)).cast("int")))
            .otherwise(F.substring(number, i, F.lit(1)).cast("int"))), F.lit(0), lambda a, x: a + x)

    body = spelled(F.lit(1), n - 1, letter)
    card = F.when(luhn(c, 0) % 10 == 0, F.concat(body, ((F.lit(10) - luhn(body, 1) % 10) % 10).cast("string"))) \
        .otherwise(spelled(F.lit(1), n, letter))
    def tail(alphabet: str, start: Column, size: Column) -> Column:
        """``size`` letters from the bytes after ``start``."""
        return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), size), lambda i: i > 0), lambda i: _pick(alphabet, byte(start + i))), "")

    grown = F.when(_script(c) == "cyrillic", tail(ALPHABETS[2], n, more)).when(_script(c) == "greek", tail(ALPHABETS[3], n, more)) \
        .when(hexadecimal & (kind == "secret"), tail("0123456789abcdef", n, more)).otherwise(tail(ALPHABETS[0], n, more))
    any_octet = F.array_join(F.transform(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), lambda i: byte(i).cast("string")), ".")
    given = F.lit(None).cast("string")
    for (g, script), names in GIVEN.items():
        chosen = F.element_at(F.array(*[F.lit(x.lower()) for x in names]), F.lit(1) + byte(F.lit(1)) % len(names))
        letters = tail(ALPHABETS[0] if script == "latin" else ALPHABETS[2], F.lit(1), F.col("attempt"))
        given = F.when(kind == f"given:{g}:{script}",
                       F.concat(chosen, letters)).otherwise(given)
    bar = F.instr(c, "|")
    return F.when(kind == "email", F.concat(grown, spelled(F.lit(1), host_end, letter), F.substring(c, host_end + 1, n))) \
        .when(kind == "ip", F.when(more > 0, any_octet).otherwise(spelled(F.lit(1), n, octet_digit))) \
        .when(kind == "card", card) \
        .when(kind == "ipv6", groups) \
        .when(kind == "phone", F.concat(F.substring(c, F.lit(1), bar), spelled(bar + 1, n, letter), tail(DIGITS, n, more))) \
        .when(kind == "iban", F.concat(F.substring(c, F.lit(1), F.lit(2)), spelled(F.lit(3), n, letter))) \
        .when(given.isNotNull(), given).when(kind.isin("ssn", "mac"), spelled(F.lit(1), n, letter)) \
        .otherwise(F.concat(spelled(F.lit(1), n, letter), grown))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, canonical, attempt, surrogate): distinct per type, none a form that occurs.
    Surrogates grow with the attempts, so free ones outnumber the losers in the end."""
    wide = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much to compute: dealt out, or it is coalesced to one task
    lost = entities.select("type", "canonical").distinct().withColumn("attempt", F.lit(0)).repartition(wide, "type", "canonical")
    table = None
    while True:
        streams = materialize(lost.withColumn("stream", _stream(key)), "streams")  # written, or each letter would hash again
        hashed = streams.withColumn("surrogate", surrogate(F.col("stream"))).drop("stream")
        table = materialize(hashed if table is None else table.join(lost, ["type", "canonical"], "left_anti").union(hashed), "surrogates")
        kept = table.groupBy("type", "surrogate").agg(F.min("canonical").alias("kept"))
        real = table.select("type", F.col("canonical").alias("surrogate")).withColumn("real", F.lit(True))
        judged = table.join(kept, ["type", "surrogate"]).join(real, ["type", "surrogate"], "left")
        lost = materialize(judged.where("canonical <> kept or real").select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
                           .repartition(wide, "type", "canonical"), "lost")
        if lost.isEmpty():
            return table


def written_like(written: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate with the separators and the case of one way of writing it."""
    flat = F.regexp_replace(surrogate, r"\|", "")
    at = lambda i: F.char_length(F.regexp_replace(F.substring(written, F.lit(1), i), "[^0-9A-Za-z]", ""))
    every = F.sequence(F.lit(1), F.char_length(written))
    filled = F.array_join(F.transform(every, lambda i: F.when(
        F.substring(written, i, F.lit(1)).rlike("[0-9A-Za-z]"), F.substring(flat, at(i), F.lit(1))).otherwise(F.substring(written, i, F.lit(1)))), "")
    cased = F.array_join(F.transform(every, lambda i: F.when(
        F.substring(written, i, F.lit(1)) != F.lower(F.substring(written, i, F.lit(1))), F.upper(F.substring(surrogate, i, F.lit(1))))
        .otherwise(F.substring(surrogate, i, F.lit(1)))), "")
    capitals = (written == F.upper(written)) & (written != F.lower(written)) & (F.char_length(written) > 1)
    beyond = F.substring(surrogate, F.char_length(written) + 1, F.char_length(surrogate))  # what it has grown by
    cased = F.when(kind == "ip", surrogate).when((kind == "email") & (beyond != ""), F.when(capitals, F.upper(surrogate)).otherwise(surrogate)) \
        .otherwise(F.concat(cased, F.when(capitals, F.upper(beyond)).otherwise(beyond)))
    filled = F.concat(filled, F.substring(flat, F.char_length(F.regexp_replace(written, "[^0-9A-Za-z]", "")) + 1, F.char_length(flat)))
    given = F.when((written == F.upper(written)) & (F.char_length(written) > 1), F.upper(surrogate)) \
        .otherwise(F.concat(F.upper(F.substring(surrogate, F.lit(1), F.lit(1))), F.expr("substring(surrogate, 2)")))
    left, right, gap = _halves(written)
    mine = F.split(surrogate, ":")
    like = lambda groups, start: F.transform(groups, lambda x, i: F.when(F.char_length(x) == 4, F.get(mine, start + i)).otherwise(
        F.regexp_replace(F.get(mine, start + i), r"\A0{1,3}", "")))
    inner = F.array_join(F.slice(mine, F.size(left) + 1, F.greatest(gap, F.lit(0))), ":")
    short = F.concat(F.array_join(like(left, F.lit(0)), ":"),
                     F.when(~written.contains("::"), "").when(inner.rlike("[1-9a-f]"), F.concat(
                         F.when(F.size(left) > 0, ":").otherwise(""), inner, F.when(F.size(right) > 0, ":").otherwise(""))).otherwise("::"),
                     F.array_join(like(right, F.lit(8) - F.size(right)), ":"))
    address = F.when(written.rlike("[A-F]"), F.upper(short)).otherwise(short)
    return F.when(kind == "", written).when(kind == "ipv6", address).when(kind.isin("ssn", "card", "phone", "iban"), filled) \
        .when(kind == "secret", surrogate).when(kind.startswith("given:"), given).otherwise(cased)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text rewritten, plus ``n_entities`` (mentions replaced)."""
    row, names = "row", [f"c{n}" for n in range(len(docs.columns))]  # own names: none can clash
    rows, given, text_col = numbered(docs.toDF(*names), "texts"), docs.columns, names[docs.columns.index(text_col)]
    found = rows.select(row, pieces(text_col).alias("p")).where("size(p) > 1")
    found = materialize(found.select(row, F.expr("array_distinct(filter(p, (x, i) -> i % 2 = 1))").alias("mentions")), "mentions")
    each = found.select(row, F.explode("mentions").alias("mention"))
    cut = parts(materialize(each.select("mention").distinct(), "mentioned"))
    chosen = assign(cut.where("type <> ''"), key).select("type", "canonical", "surrogate")
    new = cut.join(chosen, ["type", "canonical"], "left")
    like = lambda written: written_like(written, F.col("surrogate"), F.col("type"))
    alone = F.when(F.col("type") == "surname", F.transform(F.array("written", F.upper("written")), lambda w: F.struct(
        F.char_length(w).alias("size"), w.alias("said"), like(w).alias("new"))))
    by_mention = new.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("place", like(F.col("written")).alias("new")))).alias("p"),
                                            F.flatten(F.collect_list(alone)).alias("alone")).select(
        "mention", F.array_join(F.col("p.new"), "").alias("new"), "alone")
    maps = each.join(by_mention, "mention").groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("__new"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("alone")))).alias("alone"))
    first = F.filter("alone", lambda x, i: (i == 0) | (F.get("alone", i - 1)["said"] != x["said"]))  # one new form each
    maps = maps.withColumn("alone", first).select(
        row, "__new", F.map_from_entries(F.transform("alone", lambda x: F.struct(x["said"], x["new"]))).alias("__alone"),
        F.when(F.size("alone") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.reverse(F.col("alone.said")), "|"),
                                             F.lit(r")(?![\p{L}\p{N}])"))).alias("__names"))
    joined = rows.join(maps, row, "left")
    joined = joined.withColumn("__p", F.when(F.col("__new").isNotNull(), pieces(text_col)))
    cut_again = F.transform("__p", lambda x, i: F.when(i % 2 == 1, F.array(F.coalesce(F.try_element_at("__new", x), x)))
                            .when(F.col("__names").isNull(), F.array(x)).otherwise(_renamed(x)))
    joined = joined.withColumn("__p", cut_again)
    has = F.col("__p").isNotNull()
    text = F.when(has, F.array_join(F.flatten("__p"), "")).otherwise(F.col(text_col))
    # odd pieces are mentions, and so is every second part of the others
    n = F.aggregate("__p", (F.size("__p") - 1) / 2, lambda a, x: a + F.floor(F.size(x) / 2))
    return joined.select(*[(text if c == text_col else F.col(c)).alias(as_) for c, as_ in zip(names, given)
                           if as_ != "n_entities"], F.when(has, n).otherwise(0).cast("long").alias("n_entities"))


def _renamed(x: Column) -> Column:
    """Text between mentions, cut at surnames of the document and these replaced."""
    said = F.regexp_extract_all(x, F.col("__names"), F.lit(0))
    return F.flatten(F.zip_with(F.split(x, F.col("__names"), -1), said, lambda b, s: F.when(s.isNull(), F.array(b)).otherwise(
        F.array(b, F.try_element_at("__alone", s)))))

"""Column expressions on texts: tokens, shingles, escapes, clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and however deep in lambdas ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; everything else separates. Null gives no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{Alnum}]+"), lambda t: t != "")


_ALNUM = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """tokens() of a text in a worker; all bytes of other characters than ASCII ones separate."""
    return (text or "").lower().encode().translate(_ALNUM).split()


def shingles(words: Column, size: int) -> Column:
    """The distinct runs of ``size`` words, in first-seen order; a shorter non-empty text is one shingle."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= size, runs).otherwise(short))

    return let(words, of)


def escape_search_syntax(text: Column) -> Column:
    """A backslash before every character that a full-syntax search query treats as an operator."""
    return F.regexp_replace(text, r"""([\\+\-&|(){}\[\]^"~*?:/;<>=@#%`])""", r"\\$1")


def double_quotes(text: Column) -> Column:
    """Single quotes doubled, as in a filter literal."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def unescape(text: Column) -> Column:
    """Escaped line feeds and double quotes as the characters."""
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def without_trailing_slash(text: Column) -> Column:
    """Exactly one trailing slash off."""
    return F.regexp_replace(text, "/$", "")


def salvaged_json(text: Column) -> Column:
    """From the first opening to the last closing brace, or the text itself."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(text)


def csv_items(text: Column) -> Column:
    """Comma-separated items, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_of(items: Column) -> Column:
    """Items that are not blank, comma-joined."""
    return F.array_join(F.filter(items, lambda x: ~is_blank(x)), ",")


def truncated(text: Column, most: int) -> Column:
    """The text, or its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def joined_lines(lines: Column) -> Column:
    """Lines that are not null, with single blanks between them."""
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), " ")


#: Named characters of HTML that pages use; numbered ones need no table.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "cent": "¢", "pound": "£",
    "yen": "¥", "euro": "€", "szlig": "ß", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ntilde": "ñ", "oacute": "ó", "aacute": "á",
}


def without_entities(text: Column) -> Column:
    """Character references of HTML as their characters, each read once; unknown names and impossible numbers stay."""
    pieces = F.split(text, r"&(?=(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});)", -1)
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def shown(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"\A([^;]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).try_cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(named, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(i == 0, piece).when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    return F.array_join(F.transform(pieces, shown), "")

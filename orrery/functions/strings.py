"""String functions with the semantics of the SQL dialect where Spark's differ."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F


def left(s: Column, n: int) -> Column:
    """First n characters; a negative n drops that many at the end."""
    return F.substring(s, 1, n) if n >= 0 else F.when(F.length(s) > -n, F.substr(s, F.lit(1), F.length(s) + n)).when(s.isNotNull(), F.lit(""))


def right(s: Column, n: int) -> Column:
    """Last n characters; a negative n drops that many at the start."""
    if n >= 0:
        return F.when(F.length(s) <= n, s).otherwise(F.substr(s, F.length(s) - n + 1, F.lit(n)))
    return F.substr(s, F.lit(1 - n), F.length(s))


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """A window that may begin before the string."""
    if length is None:
        return F.substr(s, F.lit(max(1, start)), F.length(s))
    if length < 0:
        raise ValueError("negative substring length not allowed")
    end = start + length
    return F.substr(s, F.lit(max(1, start)), F.lit(max(0, end - max(1, start))))


def concat(*parts: Column) -> Column:
    """Joined text; nulls are skipped."""
    return F.concat_ws("", *(p.cast("string") for p in parts))


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match is replaced, all with flag g; i ignores case. \\1 to \\9 and \\& refer to groups."""
    found = ("(?i)" if "i" in flags else "") + pattern
    java = re.sub(r"\\([0-9&])", lambda m: "$" + ("0" if m[1] == "&" else m[1]), replacement.replace("$", r"\$"))
    if "g" in flags:
        return F.regexp_replace(s, found, java)
    # what stands before the first match is group 1, the match group 2, so its own groups move by two
    moved = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", java)
    return F.regexp_replace(s, rf"(?s)\A(.*?)({found})", "$1" + moved)


def similar_to(pattern: str, escape: str = "\\") -> str:
    """Java regular expression of a SIMILAR TO pattern, for rlike."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        if inside:
            out.append("\\\\" if c == "\\" else c)
            inside = c != "]"
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[":
            out.append(c)
            inside = True
        elif c == "(":
            out.append("(?:")
        elif c in "|*+?{})":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


def string_to_array(s: Column, delimiter: str, null_text: str | None = None) -> Column:
    """Split at a literal delimiter; an empty text has no elements."""
    parts = F.split(s, re.escape(delimiter)) if delimiter else F.array(s)
    some = F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
    return some if null_text is None else F.transform(some, lambda x: F.when(x != null_text, x))


def btrim(s: Column, characters: str = " ") -> Column:
    return F.trim(s, F.lit(characters))


def ltrim(s: Column, characters: str = " ") -> Column:
    return F.ltrim(s, F.lit(characters))


def rtrim(s: Column, characters: str = " ") -> Column:
    return F.rtrim(s, F.lit(characters))


def quote_ident(s: Column) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s: Column) -> Column:
    body = F.replace(s, F.lit("'"), F.lit("''"))
    slash = F.replace(body, F.lit("\\"), F.lit("\\\\"))
    return F.when(F.instr(s, "\\") > 0, F.concat(F.lit(" E'"), slash, F.lit("'"))).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def encode(b: Column, kind: str) -> Column:
    """Text of bytes: hex, base64 (lines of 76) or escape."""
    if kind == "hex":
        return F.lower(F.hex(b))
    if kind == "base64":
        flat = F.replace(F.base64(b), F.lit("\r\n"), F.lit(""))
        return F.regexp_replace(flat, r"(.{76})(?=.)", "$1\n")
    if kind == "escape":
        pairs = F.filter(F.regexp_extract_all(F.hex(b), F.lit("(..)")), lambda x: x != "")
        shown = lambda h: F.conv(h, 16, 10).cast("int")
        octal = lambda h: F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))
        return F.array_join(F.transform(pairs, lambda h: F.when((shown(h) == 0) | (shown(h) >= 128), octal(h)).when(shown(h) == 92, F.lit("\\\\")).otherwise(F.char(shown(h)))), "")
    raise ValueError(f"unrecognized encoding: {kind}")


def decode(s: Column, kind: str) -> Column:
    if kind == "hex":
        return F.unhex(F.regexp_replace(s, r"\s", ""))
    if kind == "base64":
        return F.unbase64(F.regexp_replace(s, r"\s", ""))
    raise ValueError(f"unrecognized encoding: {kind}")


def get_byte(b: Column, n: int) -> Column:
    return F.conv(F.substring(F.hex(b), 2 * n + 1, 2), 16, 10).cast("int")


def set_byte(b: Column, n: int, value: int) -> Column:
    h = F.hex(b)
    return F.unhex(F.overlay(h, F.lit(f"{value & 255:02X}"), F.lit(2 * n + 1), F.lit(2)))


def get_bit(bits: Column, n: int) -> Column:
    """Bit n, from the left, of a text of 0 and 1."""
    return F.substring(bits, n + 1, 1).cast("int")


def set_bit(bits: Column, n: int, value: int) -> Column:
    return F.overlay(bits, F.lit(str(value)), F.lit(n + 1), F.lit(1))


def bits_and(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bits_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def bits_xor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: F.when(x != y, "1").otherwise("0"))


def bits_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bits_shift(a: Column, n: int) -> Column:
    """Shifted left by n (right if negative); the length stays."""
    zero = F.repeat(F.lit("0"), F.lit(abs(n)))
    return F.substr(F.concat(a, zero), F.lit(n + 1), F.length(a)) if n >= 0 else F.substr(F.concat(zero, a), F.lit(1), F.length(a))


def _bitwise(a: Column, b: Column, f) -> Column:
    return F.array_join(F.zip_with(F.regexp_extract_all(a, F.lit("([01])")), F.regexp_extract_all(b, F.lit("([01])")), f), "")


def parse_ident(s: Column) -> Column:
    """Parts of a qualified name; plain ones in lower case, quoted ones as written."""
    parts = F.regexp_extract_all(s, F.lit(r'("(?:[^"]|"")*"|[^.\s"]+)'))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(p)))


def format_text(template: str, *values: Column) -> Column:
    """format(): %s text, %I identifier, %L literal, %% a per cent sign; %n$ picks an argument."""
    parts: list[Column] = []
    nth = 0
    for piece in re.split(r"(%(?:\d+\$)?[sIL%])", template):
        if piece == "%%":
            parts.append(F.lit("%"))
        elif m := re.fullmatch(r"%(?:(\d+)\$)?([sIL])", piece):
            at = int(m[1]) - 1 if m[1] else nth
            nth = at + 1
            v = values[at].cast("string")
            parts.append({"s": F.coalesce(v, F.lit("")), "I": quote_ident(v), "L": quote_nullable(v)}[m[2]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


#: Letters with marks and their plain forms: fixed values.
MARKED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def unaccent(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.translate(s, MARKED, PLAIN), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


@cache
def _marks() -> tuple[str, str]:
    """Characters that hold marks and what is left of them, then the marks themselves, which go."""
    held, left, marks = [], [], []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Mn", "Mc", "Me"):
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        bare = unicodedata.normalize("NFC", "".join(x for x in parts if unicodedata.category(x) not in ("Mn", "Mc", "Me")))
        if bare != c and len(bare) == 1:
            held.append(c)
            left.append(bare)
    return "".join(held + marks), "".join(left)


def strip_accents(s: Column) -> Column:
    """Without the marks on letters; letters of their own (ß, æ, ø) stay, unlike in unaccent()."""
    return F.translate(s, *_marks())


def to_ascii(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, MARKED, PLAIN), r"[^\x00-\x7F]", " ")


def initcap(s: Column) -> Column:
    """Each run of letters and digits in lower case with its first letter in upper case, whatever parts the runs."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def starts_with(s: Column, prefix: Column) -> Column:
    return F.startswith(s, prefix)


def convert_to(s: Column, encoding: str) -> Column:
    """Bytes of a text in UTF8, LATIN1, UTF16 or SQL_ASCII."""
    return F.encode(s, ENCODINGS[encoding.upper()])


def convert_from(b: Column, encoding: str) -> Column:
    return F.decode(b, ENCODINGS[encoding.upper()])


#: Encodings by the names that conversions take, and those that Spark knows them by: fixed values.
ENCODINGS = {"UTF8": "UTF-8", "LATIN1": "ISO-8859-1", "UTF16": "UTF-16", "SQL_ASCII": "US-ASCII"}

"""Text helpers that give Spark columns Python's string semantics.

Java's ``\\s``, ``\\w`` and ``\\b`` differ from Python's (ASCII only, or the Unicode tables of
``(?U)``, which lack U+001C-U+001F and count combining marks as word characters). Signatures
must not depend on that, so patterns are written once in the common notation and
:func:`java_regex` spells the classes out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The line boundaries of str.splitlines, as members of a character class.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_BREAK = rf"\r\n|[{LINE_ENDS}]"

_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
# white space within a line, and anything within a line: ASCII is taken by a single range
_INDENT = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_TO_LINE_END = rf"[ -~]*+(?:[^{LINE_ENDS}][ -~]*+)*+"
_WORD = r"\p{L}\p{N}_"
_INSIDE = {"\\d": r"\p{Nd}", "\\s": _SPACE, "\\w": _WORD}
_OUTSIDE = {
    "\\d": r"\p{Nd}",
    "\\s": f"[{_SPACE}]",
    "\\S": f"[^{_SPACE}]",
    "\\w": f"[{_WORD}]",
    "\\b": f"(?![{_WORD}])",
}
# Java looks behind one UTF-16 unit unless the lookbehind holds a supplementary character; this
# one is a digit, so it adds nothing to the class.
_WORD_STARTS = f"(?<![{_WORD}\U0001d7d8])"
# On ASCII, RE2's own classes are Python's, all but white space.
_ASCII_SPACE = r"\t-\r\x1c-\x20"


def is_ascii(c: Column) -> Column:
    """Whether all characters take one byte, so that there is one for each byte."""
    return (F.octet_length(c) == F.char_length(c)) & F.is_valid_utf8(c)


def java_regex(pattern: str, flags: str = "") -> str:
    r"""Spell out ``\d \s \S \w \b`` as Python means them.

    A ``\b`` must stand next to a word character of the pattern: after it, or before it when it
    opens the pattern. One lookaround is then enough, at half the price of the general form; an
    opening one looks behind only where the next atom fits.
    ``flags`` are Java inline flags; ``d`` (only ``\n`` ends a line) is always on.
    """
    opening, rest = "", pattern
    if pattern.startswith(r"\b"):
        rest = pattern.removeprefix(r"\b")
        atom = re.match(r"\(?(\[[^\]]*\]|\\.|.)", rest)[1]
        opening = f"(?={_spelled(atom)}){_WORD_STARTS}"
    return f"(?d{flags}){opening}{_spelled(rest)}"


def re2_regex(pattern: str, flags: str = "") -> str:
    """The same pattern for RE2, for texts of which :func:`is_ascii` holds."""
    space = {"\\s": f"[{_ASCII_SPACE}]", "\\S": f"[^{_ASCII_SPACE}]"}
    return (f"(?{flags})" if flags else "") + _spelled(pattern, space, {"\\s": _ASCII_SPACE})


def _spelled(pattern: str, outside: dict = _OUTSIDE, inside: dict = _INSIDE) -> str:
    in_class = False
    out = []
    for token in re.findall(r"\\.|[^\\]", pattern, re.DOTALL):
        out.append((inside if in_class else outside).get(token, token))
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
    return "".join(out)


def strip(c: Column) -> Column:
    """White space off both ends, as ``str.strip``."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def first_chars(c: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def split_lines(c: Column) -> Column:
    """Array of lines. A final line break leaves one trailing empty element."""
    return F.split(c, LINE_BREAK)


def pack_lines(c: Column) -> Column:
    """Stripped lines without the empty ones, one line feed between them.

    The same as splitting, stripping, filtering and joining, in one pass over the text.
    """
    # what comes before a character is looked at only where a run of blanks begins
    edge = rf"(?:[{LINE_ENDS}]|{_INDENT}(?<!{_INDENT}{{2}}){_INDENT}*+[{LINE_ENDS}])[{_SPACE}]*+"
    return strip(F.regexp_replace(c, edge, "\n"))


def lines_after(c: Column, mark: str) -> Column:
    """Array of what follows ``mark`` on each line that starts with it, indented or not."""
    line = rf"(?:\A|[{LINE_ENDS}]){_INDENT}*+{re.escape(mark)}({_TO_LINE_END})"
    return F.regexp_extract_all(c, F.lit(line), F.lit(1))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)

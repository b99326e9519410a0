"""Python string semantics as Spark column expressions.

Fixed values (they must equal Python's definitions for equal results):

* white space of ``str.strip()`` / ``str.isspace()``: TAB, LF, VT, FF, CR,
  U+001C..U+001F, SPACE, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
  U+2029, U+202F, U+205F, U+3000
* word characters of ``re`` on ``str``: letters, numbers and underscore
  (``[\\p{L}\\p{N}_]``); combining marks are not word characters.
* decimal digits of ``re`` ``\\d`` on ``str``: ``\\p{Nd}``.

Apart from the alias pattern, the patterns use only syntax that Java regex and
RE2 read the same way, so the DuckDB oracle runs the very same strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space of str.strip(), in code point order (fixed values)
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# the same set as a regex class, written with \x{..} escapes
WS = "[" + "".join(f"\\x{{{ord(ch):04X}}}" for ch in WS_CHARS) + "]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# table alias in front of a column: t.col -> col. A run starts only where no word
# character stands before it and is never given back, so a long word is read once.
ALIAS_PATTERN = f"(?<!{WORD}){WORD}++\\.({WORD}+)"
# list numbering "1. " or "2) " at the start of a rule
NUMBERING_PATTERN = f"^{WS}*{DIGIT}+[.)]{WS}*"
FENCE_OPEN_PATTERN = "^```(json)?"
TRAILING_TICKS_PATTERN = "`+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: plain ``trim`` removes spaces only, so trim the whole
    white-space set (linear, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def remove_aliases(c) -> Column:
    """M4: ``x.id`` -> ``id`` everywhere, left to right, non-overlapping.

    Faithful to the original: decimals and dotted literals are damaged too
    (``0.05`` -> ``05``, ``'u.v'`` -> ``'v'``, ``a.b.c`` -> ``b.c``).
    """
    return F.regexp_replace(_c(c), ALIAS_PATTERN, "$1")


def strip_numbering(c) -> Column:
    """Strip, then drop a leading ``1.`` / ``2)`` and the space after it."""
    return F.regexp_replace(py_strip(c), NUMBERING_PATTERN, "")


def strip_code_fence(c) -> Column:
    """L1: strip; when the text opens with a code fence, drop the opening
    ```` ``` ```` (and ``json``), strip, drop trailing backticks, strip."""
    s = py_strip(c)
    inner = py_strip(F.regexp_replace(
        py_strip(F.regexp_replace(s, FENCE_OPEN_PATTERN, "")), TRAILING_TICKS_PATTERN, ""))
    return F.when(s.startswith("```"), inner).otherwise(s)


def is_blank(c) -> Column:
    return py_strip(c) == ""

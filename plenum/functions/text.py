"""Small native text columns with the blank and number rules of the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line besides "\n".
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# A Unicode noncharacter, used to cut text at the matches of a pattern.
CUT = "\uffff"

ALPHABET = [chr(65 + i) for i in range(26)]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim every Unicode blank from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def present(text: Column) -> Column:
    """True when the text has at least one visible character (NULL is absent)."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def swap(text: Column, old: str, new: str) -> Column:
    """``translate`` for rare characters: it looks up every single character,
    so rows without any of them skip it after one quick scan."""
    return F.when(text.rlike(any_of(old)), F.translate(text, old, new)).otherwise(text)


def any_of(characters: str) -> str:
    """A pattern's character class of these characters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]"


def lines(text: Column) -> Column:
    """Lines of a text.  A two-character line end yields an extra empty line,
    which all callers drop together with the other blank lines."""
    return F.split(swap(text, OTHER_LINE_ENDS, "\n" * len(OTHER_LINE_ENDS)), "\n")


def split_at(text: Column, pattern: str) -> Column:
    """Split at a pattern.  ``split`` compiles its pattern for every row,
    ``regexp_replace`` keeps it, so the cut is made on a single character."""
    return F.split(F.regexp_replace(text, pattern, CUT), CUT)


def letter_at(position: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char((position + 65).cast("int"))


def letters_for(values: Column) -> Column:
    """Positional labels A, B, ... for an array."""
    return F.transform(values, lambda _, i: F.char((i + 65).cast("int")))


def flag(value: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(value, F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """Share as a double; an empty whole gives 0.0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"


def to_number(text: Column) -> Column:
    """Decimal text (digit groups with ``_`` allowed) to double, else NULL."""
    clean = strip(text)
    return F.when(
        clean.rlike(_NUMBER), F.regexp_replace(clean, "_", "").try_cast("double")
    )


def hex_number(hexed: Column, digits: int) -> Column:
    """The first ``digits`` hex digits as an exact decimal."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("decimal(20,0)")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)

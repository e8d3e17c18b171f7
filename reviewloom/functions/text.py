"""Text expressions: whitespace, word counts, content IDs, display text.

All of them are native column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Unicode-aware "\s" covers.
WHITESPACE_CODE_POINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE_CHARS = "".join(map(chr, WHITESPACE_CODE_POINTS))
# The same set as a Java regex class. Printable ASCII is ruled out first, which is fastest.
WHITESPACE = r"[[^!-~]&&[^\x{180e}]&&[\h\v\x1c-\x1f]]"
_WORD_CHAR = r"[[^\h\v\x1c\x1d\x1e\x1f]\x{180e}]"
#: And as a class that RE2 reads, too.
WHITESPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

ID_SEPARATOR = "\x01"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def or_empty(value: Column | str) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def strip_ws(value: Column | str) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(_col(value), F.lit(WHITESPACE_CHARS))


def collapse_ws(value: Column | str) -> Column:
    """Strip, and turn every inner whitespace run into one blank."""
    return F.btrim(F.regexp_replace(_col(value), WHITESPACE + "+", " "))


def word_count(value: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for NULL or blank text."""
    flat = collapse_ws(or_empty(value))
    # No branches, so that generated code computes the collapsed text once.
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return blanks + (flat != "").cast("int")


def has_words(value: Column | str, n: int) -> Column:
    """Whether there are at least ``n`` words; looks no further than needed for small ``n``."""
    if n <= 16:
        pattern = f"^{WHITESPACE}*+(?:{_WORD_CHAR}++{WHITESPACE}++){{{n - 1}}}+{_WORD_CHAR}"
        return F.coalesce(_col(value).rlike(pattern), F.lit(False))
    return F.size(F.split(collapse_ws(or_empty(value)), " ")) >= n


def normalize_text(value: Column | str) -> Column:
    """Lower-case text with collapsed whitespace; NULL counts as empty."""
    return F.lower(collapse_ws(or_empty(value)))


def stable_id(text: Column | str = "text", asin: Column | str = "asin") -> Column:
    """Content ID: SHA-1 over the normalised text, a separator and the normalised asin."""
    key = F.concat(
        normalize_text(text), F.lit(ID_SEPARATOR), F.lower(strip_ws(or_empty(asin)))
    )
    return F.sha1(key.cast("binary"))


def display_text(
    title: Column | str = "title", text: Column | str = "text", max_len: int = 400
) -> Column:
    """Title and text for a labelling screen, cut to ``max_len`` characters."""
    joined = strip_ws(
        F.concat(strip_ws(or_empty(title)), F.lit("  "), strip_ws(or_empty(text)))
    )
    cut = F.concat(F.substring(joined, 1, max_len), F.lit(" ..."))
    return F.when(F.length(joined) > max_len, cut).otherwise(joined)

"""String expressions: trimming, lengths, font names, labels, path and message tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Style suffixes removed from a font name, in this order, and the fallback font.
FONT_SUFFIXES = (",Bold", ",Italic", "-Bold", "-Italic", "-Roman", "-Regular")
DEFAULT_FONT = "Segoe UI"

# What a message says when a file is locked.
PROTECTED_WORDS = ("password", "protected", "encrypted")

#: Smallest font size, in pixels, of an edit box, and the share of a line's height used
#: when the font size is unknown.
MIN_EDIT_FONT = 10.0
FALLBACK_FONT_SHARE = 0.75


def trim_whitespace(s: Column) -> Column:
    """Strip every kind of Unicode white space; Spark's ``trim`` strips spaces only."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def is_blank(s: Column) -> Column:
    """Null, empty or nothing but white space."""
    return s.isNull() | ~s.rlike(r"(?U)\S")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units, which differs from ``length`` outside the BMP."""
    n = F.length(s)
    # ASCII needs no encoding to be counted.
    return F.when(F.octet_length(s) == n, n).otherwise(
        F.shiftright(F.octet_length(F.encode(s, "UTF-16BE")), 1)
    )


def normalise_font(name: Column) -> Column:
    """Drop a subset prefix (through the first ``+``) and style suffixes, in their fixed order."""
    plus = F.instr(name, "+")
    out = F.when(plus > 0, F.substring(name, plus + 1, F.length(name))).otherwise(name)
    for suffix in FONT_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.when(is_blank(out), F.lit(DEFAULT_FONT)).otherwise(out)


def edit_font_size(font_size: Column, scale_y: Column, line_height: Column) -> Column:
    """Font size of an edit box in pixels."""
    wanted = F.coalesce(font_size * scale_y, line_height * FALLBACK_FONT_SHARE)
    return F.greatest(wanted, F.lit(MIN_EDIT_FONT))


def page_label(page_idx: Column) -> Column:
    return F.concat(F.lit("Page "), (page_idx + 1).cast("string"))


def is_protected(message: Column) -> Column:
    """Whether a failure message says that the file is locked; null says nothing."""
    pattern = "|".join(PROTECTED_WORDS)
    return F.coalesce(F.lower(message).rlike(pattern), F.lit(False))


def has_extension(path: Column, extension: str = ".pdf") -> Column:
    return F.lower(path).endswith(extension.lower())


def hit_status(n: Column) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" found"))).otherwise("No matches")

"""Text functions over columns. Blanks are Unicode ones unless said otherwise, as typed documents have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"


def collapsed(c: Column) -> Column:
    """Runs of blanks (tabs and no-break blanks too) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def furniture_key(c: Column) -> Column:
    """What repeated headers and footers have in common: case, digits and blanks don't count."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\d+", "#"), BLANKS, " "))


def title_key(c: Column) -> Column:
    """Titles are compared without case, blanks, or stops and colons at the ends."""
    return F.lower(F.regexp_replace(collapsed(c), r"^[.:]+|[.:]+$", ""))


def cleaned(c: Column) -> Column:
    """Line ends and tabs as blanks; other control characters and private-use characters out."""
    return F.regexp_replace(F.regexp_replace(c, r"[\n\t]", " "), "[\\x00-\\x08\\x0b-\\x1f\\x7f\\ue000-\\uf8ff]", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, the unit of document offsets."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def lone_numbers(c: Column) -> Column:
    """The numbers of a line that has nothing but numbers of up to three digits; else an empty list."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(c, BLANKS, " ")), " "), lambda t: t != "")
    return F.when(F.forall(tokens, lambda t: t.rlike(r"^\d{1,3}$")), F.transform(tokens, lambda t: t.cast("int"))).otherwise(F.array().cast("array<int>"))


# Patterns of decorative lines, of page numbers (on furniture keys), and of copyright notices.
DECORATIVE = r"^[\s*\-–—_=~•·.]+$"
PAGE_NUMBER = r"(?i)^\W*(page\s*)?#+(\s*(of|/)\s*#+)?(\s*\|\s*page)?\W*$"
COPYRIGHT = r"(?i)copyright|©|all rights reserved"


def is_decorative(c: Column) -> Column:
    return c.rlike(DECORATIVE)


def is_page_number(c: Column) -> Column:
    return furniture_key(c).rlike(PAGE_NUMBER)


def is_copyright(c: Column) -> Column:
    return c.rlike(COPYRIGHT)


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"[.?!:][\"'”’)]?\s*$")


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c

"""Text normalisation as Column functions. Java patterns carry (?U) so that classes are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "\ufeff"
#: Transliteration of Cyrillic letters, one for one and one for several.
SINGLE_FROM, SINGLE_TO = "абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye"
SEVERAL = {"ж": "zh", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def strip(x: Column) -> Column:
    """Unicode white space off both ends; trim() takes only U+0020."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def optional(x: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def fold(x: Column) -> Column:
    """Lower case with ё as е."""
    return F.translate(F.lower(x), "ё", "е")


def normalize_text(x: Column) -> Column:
    """One kind of line end, single spaces, at most one blank line between paragraphs."""
    x = F.replace(x, F.lit(BOM), F.lit(""))
    x = F.regexp_replace(x, r"\r\n|\r", "\n")
    x = F.replace(x, F.lit("\u2029"), F.lit("\n\n"))
    x = F.regexp_replace(x, "[\\f\\x0B\u0085\u2028]", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def normalize_html_line(x: Column) -> Column:
    return strip(F.regexp_replace(F.replace(x, F.lit(BOM), F.lit("")), "[ \\t\\f\\x0B\u00a0]+", " "))


def normalize_docx_line(x: Column) -> Column:
    return collapse(F.replace(x, F.lit(BOM), F.lit("")))


def identity(x: Column) -> Column:
    """Letters and digits of Latin and Cyrillic in lower case; null as the empty string."""
    return F.regexp_replace(fold(F.coalesce(x.cast("string"), F.lit(""))), "[^a-zа-я0-9]+", "")


def article_number(x: Column) -> Column:
    """The first dotted number, else null."""
    return F.nullif(F.regexp_extract(x.cast("string"), r"\d+(?:\.\d+)*", 0), F.lit(""))


def slugify(x: Column) -> Column:
    x = F.translate(F.lower(x), SINGLE_FROM, SINGLE_TO)
    for letter, latin in SEVERAL.items():
        x = F.replace(x, F.lit(letter), F.lit(latin))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("document"))


def preview(x: Column, length: int = 200) -> Column:
    return F.substring(collapse(x), 1, length)


def stem_of(filename: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename, r"(?s)(?<=.)\.[^.]*$", "")


def first_alpha_is_lower(x: Column) -> Column:
    return x.rlike(r"^\P{L}*\p{Ll}")

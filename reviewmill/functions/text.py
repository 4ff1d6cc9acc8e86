"""Text columns: intactness score, mojibake repair, blanks, URL marker, clipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewmill import constants as C

_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# A search only asks whether a match exists: one character before the dot is enough (a run there
# would cost quadratic time in long words), and the word boundary after the suffix is spelled out.
_URL_SEARCH = "(?iu)" + C.URL_PATTERN.replace("[a-z0-9-]+", "[a-z0-9-]").replace(
    r"\b", r"(?![\p{L}\p{N}_])"
)
_NOISE = rf"[^\p{{L}}\p{{N}}_{_SPACE}{C.HANGUL_CHARS}{C.PLAIN_PUNCTUATION}]+"


def _count(text: Column, pattern: str) -> Column:
    # Removing whole runs and comparing lengths touches far fewer matches than counting one by one.
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def as_text(text: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def intactness(text: Column) -> Column:
    """Share of Hangul and ASCII letters minus the weighted share of mojibake and odd symbols."""
    n = F.length(text)
    signal = (_count(text, f"[{C.HANGUL_CHARS}]+") + _count(text, f"[{C.ASCII_LETTERS}]+")) / n
    noise = (
        _count(text, f"[{C.MOJIBAKE_CHARS}]+") * C.MOJIBAKE_WEIGHT + _count(text, _NOISE)
    ) / n
    return F.when(n == 0, F.lit(-1.0)).otherwise(signal - noise)


def redecoded(text: Column) -> Column:
    """The text read as UTF-8 from its Latin-1 bytes; NULL where that is impossible or pointless.

    A UTF-8 lead byte followed by a continuation byte must occur, and no character may lie
    beyond U+00FF, before the (throwing) Latin-1 encoder is reached.
    """
    plausible = text.rlike("[\\xC2-\\xF4][\\x80-\\xBF]") & ~text.rlike("[^\\x00-\\xFF]")
    return F.when(
        plausible, F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    )


def is_better(candidate: Column, text: Column) -> Column:
    """True where the re-decoded candidate differs and scores higher than the original."""
    return F.coalesce(
        (candidate != text) & (intactness(candidate) > intactness(text)), F.lit(False)
    )


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def embeddable(text: Column) -> Column:
    """Blank text is embedded as one space."""
    text = as_text(text)
    return F.when(is_blank(text), F.lit(" ")).otherwise(text)


def has_url(text: Column) -> Column:
    return F.coalesce(text.rlike(_URL_SEARCH), F.lit(False))


def one_line(text: Column) -> Column:
    return strip(F.translate(as_text(text), "\n", " "))


def clip(text: Column, n: int, ellipsis: bool = True) -> Column:
    """One line, stripped, at most n characters, with an ellipsis where something was cut."""
    line = one_line(text)
    cut = F.substring(line, 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(line) > n, F.concat(cut, F.lit(C.ELLIPSIS))).otherwise(line)


def table_cell(text: Column) -> Column:
    """Pipes would end a Markdown table cell."""
    return F.translate(text, "|", "/")


def corrupt(text: Column) -> Column:
    """UTF-8 bytes read as Latin-1: the damage that the repair undoes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")

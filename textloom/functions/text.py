"""Column expressions over text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters counted as hidden, and the weights of pauses.
ZERO_WIDTH = "​‌‍⁠﻿"
PAUSES = {",": 1, ".": 2, ":": 2, "-": 2, "–": 2, ";": 3, "—": 3, "!": 4, "?": 4, "،": 1, "؟": 4}


def words(text: Column) -> Column:
    """Runs of A-Z letters."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", "")) == 0


def sentences(text: Column) -> Column:
    """Plain split after . ! ? and white space; blank parts dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 0)


def zero_width(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def trailing_space(text: Column) -> Column:
    """Blanks and tabs at line ends."""
    return F.length(text) - F.length(F.regexp_replace(text, r"(?m)[ \t]+(?=\n|\z)", ""))


def breaks(text: Column) -> Column:
    """Line breaks in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code point offset."""
    return breaks(F.substring(text, F.lit(1), offset)) + 1


def german_fold(text: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# The clean-up of marked-up text. Each step is a pattern and what stands for it; parity needs these steps in this
# order, for a line that a prefix was taken from may need a full stop, and the full stops need the line breaks.
FENCED = (r"(?s)```(?:(?!```).)*```", " ")
INLINE = (r"`[^`\n]+`", " ")
RULE = (r"(?m)^[\t ]*[*=-]{3,}[\t ]*$", " ")
PREFIX = (r"(?m)^[\t ]*(?:=>|#{1,6}|[>|*-])[\t ]*", "")
EMPHASIS = (r"[_*~]{1,3}", "")
BLANKS = (r"\s+", " ")


def full_stops(ends: str) -> tuple[str, str]:
    """A full stop for each line that ends without one of `ends`."""
    return rf"(?m)([^\s{ends}])[\t ]*$", "$1."


def cleaned(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def prose(text: Column) -> Column:
    """Markdown to prose."""
    return cleaned(text, FENCED, INLINE, RULE, PREFIX, full_stops(".!?"), EMPHASIS, BLANKS)


LATIN_WORDS = (r"[A-Za-z]+", " ")
IN_LINE = (r"[\t\f\r ]+", " ")


def prose_of_script(text: Column, marks: str = "", ends: str = ".!?") -> Column:
    """As prose, for scripts other than Latin: Latin words and the given marks are dropped, emphasis stays."""
    own = [(marks, "")] if marks else []
    return cleaned(text, FENCED, INLINE, RULE, PREFIX, LATIN_WORDS, *own, IN_LINE, full_stops(ends), BLANKS)


def prose_ko(text: Column) -> Column:
    """Korean prose: besides, only Hangul, white space and . , ! ? stay."""
    return cleaned(text, FENCED, INLINE, (r"(?m)^[\t ]*(?:#{1,6}|[>|*-])[\t ]*", ""), LATIN_WORDS, (r"[^가-힣ᄀ-ᇿ㄰-㆏\s.,!?]", " "), (r"[^\S\n]+", " "), full_stops(".!?"), BLANKS)


#: Arabic vowel marks and the elongation sign.
HARAKAT = r"[\x{0610}-\x{061A}\x{0640}\x{064B}-\x{065F}\x{0670}]"


def pauses(text: Column) -> Column:
    """Magnitudes of the punctuation marks, in order."""
    table = F.create_map(*[F.lit(x) for kv in PAUSES.items() for x in kv])
    return F.transform(F.regexp_extract_all(text, F.lit("[,.:\\-–;—!?،؟]"), F.lit(0)), lambda c: F.element_at(table, c))

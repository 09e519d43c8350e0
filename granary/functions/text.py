"""Unicode text cleaning as column expressions: normal forms, invisible characters, white space."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
UNICODE_VERSION = "16.0.0"

# Code point ranges.  White space is what str.isspace() says; invisible is
# General_Category Cf and Default_Ignorable_Code_Point.
WHITESPACE_RANGES = (
    (0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
)


def char_class(ranges) -> str:
    """A regular expression class for code point ranges."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


WHITESPACE, INVISIBLE = char_class(WHITESPACE_RANGES), char_class(INVISIBLE_RANGES)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_form(form: str | None) -> str | None:
    """One of FORMS in any letter case; None skips normalization."""
    if form is None:
        return None
    if not isinstance(form, str):
        raise TypeError("form must be a string or None")
    if form.upper() not in FORMS:
        raise ValueError(f"unknown form {form!r}: expected one of {', '.join(FORMS)}")
    return form.upper()


def normal_form(c: Column | str, form: str) -> Column:
    """Unicode normal form, by the ICU library that Spark ships (Unicode 16).  Null stays null.

    Catalyst holds the call for nondeterministic: project it before using it in a join or an aggregate.
    """
    form, c = parse_form(form), column(c)
    method = "compose" if form in ("NFC", "NFKC") else "decompose"
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(form in ("NFKC", "NFKD")))
    return F.when(c.isNotNull(), done)


def normal_form_python(form: str):
    """The same by Python's tables (of Python's Unicode version), as a fallback where ICU isn't on the class path."""
    form = parse_form(form)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


def is_normalized(c: Column | str, form: str = "NFC") -> Column:
    c = column(c)
    return c == normal_form(c, form)


def _characters(ranges) -> str:
    return "".join(chr(x) for a, b in ranges for x in range(a, b + 1))


def fold_whitespace(c: Column | str) -> Column:
    """Runs of white space become one space; white space at both ends goes.

    White space becomes spaces by table lookup; a regular expression would test each character against all ranges.
    """
    spaces = _characters(WHITESPACE_RANGES)
    return F.trim(F.regexp_replace(F.translate(column(c), spaces, " " * len(spaces)), "  +", " "))


def strip_invisible(c: Column | str) -> Column:
    """By table lookup, as :func:`fold_whitespace`."""
    return F.translate(column(c), _characters(INVISIBLE_RANGES), "")


def is_whitespace(c: Column | str) -> Column:
    """Whether a one-character string is white space."""
    return column(c).rlike(f"^{WHITESPACE}$")


def is_invisible(c: Column | str) -> Column:
    return column(c).rlike(f"^{INVISIBLE}$")


def count_invisible(c: Column | str) -> Column:
    c = column(c)
    return (F.length(c) - F.length(strip_invisible(c))).cast("long")


def normalize(c: Column | str, form: str | None = "NFC", *, fold: bool = False, strip: bool = False) -> Column:
    """The pipeline in its fixed order: strip invisible characters, normalize, fold white space.  Idempotent."""
    c = column(c)
    if strip:
        c = strip_invisible(c)
    if form is not None:
        c = normal_form(c, form)
    return fold_whitespace(c) if fold else c


def normalize_many(df, columns: list[str], form: str | None = "NFC", *, fold: bool = False, strip: bool = False):
    """Several columns of a table at once."""
    return df.withColumns({c: normalize(f"`{c}`", form, fold=fold, strip=strip) for c in columns})

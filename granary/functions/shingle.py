"""Texts to sets of shingles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, column

# The separators.  White space is the White_Space property; then punctuation and symbols.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
PUNCTUATION = (
    "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    "¡§«¶·»¿‐‑‒–—―‘’‚‛“”„‟†‡•…‰′″‹›※、。〃〈〉《》「」『』【】〔〕〖〗〜〝〞〟・"
    "！＂＃％＆＇（）＊，－．／：；？＠［＼］＿｛｝～｡､"
)
#: Languages written without spaces between words.
CHAR_LANGUAGES = ("ja", "zh")
MODES = ("word", "char")


def separators() -> list[str]:
    return sorted(set(WHITE + PUNCTUATION))


def is_separator(c: Column | str) -> Column:
    return column(c).rlike(f"^{SEPARATOR}$")


SEPARATOR = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in separators()) + "]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.transform(F.array(value), body)[0]


def words(c: Column | str) -> Column:
    """Lower-case words between separators.

    Separators become spaces by table lookup first: a regular expression would test each character against all of them.
    """
    seps = "".join(separators())
    return F.filter(F.split(F.translate(F.lower(column(c)), seps, " " * len(seps)), " "), lambda w: w != "")


def _grams(units: Column, joiner: str) -> Column:
    def body(u: Column) -> Column:
        n = F.size(u)
        # Elements are taken one by one: slice() copies the whole array on every call.
        three = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(joiner, F.get(u, i), F.get(u, i + 1), F.get(u, i + 2))))
        return F.when(u.isNull(), None).when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(F.array_join(u, joiner))).otherwise(three)

    return _let(units, body)


def word_shingles(c: Column | str) -> Column:
    """Distinct three-word shingles in first-seen order; all words as one shingle if there are fewer than three."""
    return _grams(words(c), " ")


def char_shingles(c: Column | str) -> Column:
    """The same over code points, separators left out."""
    bare = F.translate(F.lower(column(c)), "".join(separators()), "")
    return _grams(F.filter(F.split(bare, ""), lambda x: x != ""), "")


def shingles(c: Column | str, mode: str | Column = "word") -> Column:
    """``mode`` is ``word``, ``char`` or a column of these."""
    if isinstance(mode, Column):
        return F.when(mode == "word", word_shingles(c)).when(mode == "char", char_shingles(c))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: expected word or char")
    return word_shingles(c) if mode == "word" else char_shingles(c)


def mode_of(lang: Column | str) -> Column:
    return F.when(column(lang).isin(*CHAR_LANGUAGES), "char").otherwise("word")


def shingle_digest(s: Column | str) -> Column:
    """SHA-1 over each shingle and a newline: depends on order and boundaries."""
    return F.sha1(F.array_join(F.transform(column(s), lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"))


def paragraphs(c: Column | str, least: int = 40) -> Column:
    """Stripped paragraphs between blank lines, of at least ``least`` characters; white space is all that Unicode calls so."""
    return F.filter(F.transform(F.split(column(c), rf"\n{WHITESPACE}*\n"), lambda p: F.regexp_replace(p, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")), lambda p: F.length(p) >= least)

"""Near copies of texts by small seeded edits, as column expressions: what similarity measures are tried on."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

#: One of these is done to a word of the text, or to its end.
KINDS = ("delete", "insert", "replace", "swap", "duplicate", "case", "truncate")


def _simple_upper(c: str) -> str:
    """Unicode's simple mapping: one character for one; ß has its capital ẞ, so that lower case leads back."""
    return "ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)


_CASED = [(c, u) for c in map(chr, range(1, sys.maxunicode + 1)) if (u := _simple_upper(c)) != c]
_SMALL, _CAPITAL = ("".join(x) for x in zip(*_CASED))


def simple_upper(c: Column | str) -> Column:
    """Upper case by one character for each: ``upper()`` turns ß into SS, which lower case doesn't undo."""
    return F.translate(column(c), _SMALL, _CAPITAL)


def lowers_alone(c: Column | str) -> Column:
    """The text without the two letters that ``lower()`` doesn't map one for one: Σ, which becomes ς at the end of a word and σ elsewhere, and İ, which becomes two characters."""
    return F.replace(F.replace(column(c), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))


def _draw(seed: int, key: Column, nth: int) -> Column:
    """Hex digits that depend on seed, key and number of the edit only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{nth}")).cast("binary"))


def _number(h: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(h, start, size), 16, 10).cast("long")


def near_duplicate(text: Column | str, key: Column | str, edits: int = 1, seed: int = 1) -> Column:
    """The text after so many edits, each at a random word (parts between spaces) by a random kind; the key, an id say, and the seed decide.

    Null stays null.  An edit that the text is too short for leaves it as it is.
    """
    if not 1 <= edits <= 3:
        raise ValueError("edits must be 1 to 3")
    out = F.split(column(text), " ")
    for nth in range(edits):

        def edited(w: Column) -> Column:
            h = _draw(seed, column(key), nth)  # noqa: B023
            n = F.size(w).cast("long")
            at = F.pmod(_number(h, 3, 8), n)
            kind, word = F.pmod(_number(h, 1, 2), F.lit(len(KINDS))), F.substring(h, 11, 6)
            before, own, after = F.slice(w, F.lit(1), at.cast("int")), F.get(w, at.cast("int")), F.slice(w, (at + 2).cast("int"), F.size(w))
            done = {
                "delete": F.when(n > 1, F.concat(before, after)),
                "insert": F.concat(before, F.array(word, own), after),
                "replace": F.concat(before, F.array(word), after),
                "swap": F.when(at + 1 < n, F.concat(before, F.array(F.get(w, (at + 1).cast("int")), own), F.slice(w, (at + 3).cast("int"), F.size(w)))),
                "duplicate": F.concat(before, F.array(own, own), after),
                "case": F.concat(before, F.array(simple_upper(own)), after),
                "truncate": F.slice(w, F.lit(1), F.greatest(F.floor(n * 9 / 10), F.lit(1)).cast("int")),
            }
            result = F.lit(None).cast("array<string>")
            for i, name in enumerate(KINDS):
                result = F.when(kind == i, done[name]).otherwise(result)
            return F.coalesce(result, w)

        out = F.transform(F.array(out), edited)[0]
    return F.array_join(out, " ")

"""Tokens, lines and case rules. Everything here is a built-in expression and stays in generated code."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never search terms (English and Indonesian).
STOP_WORDS = """the and or with from into when where that of are how for in to is on by as at be this it
yang dan atau di ke dari untuk pada saat dengan ini itu""".split()

LONGEST_TERM_BYTES = 256


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only: names are matched by this rule."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def terms(c: Column) -> Column:
    """Search terms in order: camel case is split, other characters than letters and numbers part words, stop words and single characters go."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    words = F.split(spaced, r"[^\p{L}\p{N}]+")
    fit = F.filter(words, lambda w: (F.length(w) > 1) & (F.octet_length(w) <= LONGEST_TERM_BYTES) & ~F.lower(w).isin(STOP_WORDS))
    return F.transform(fit, lambda w: F.lower(w))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\t-\r\x85\p{Z}]+|[\t-\r\x85\p{Z}]+$", "")


def one_line(c: Column) -> Column:
    """White space collapsed, for signatures."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def longest_backticks(c: Column) -> Column:
    """Length of the longest run of backticks, by which fences are chosen."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence(c: Column) -> Column:
    run = longest_backticks(c)
    return F.repeat(F.lit("`"), F.when(run >= 3, run + 1).otherwise(F.lit(3)))

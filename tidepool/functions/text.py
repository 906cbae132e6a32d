"""Text functions as columns. White space is Unicode's, as ``(?U)`` has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import ColumnOrName, col


#: Unicode's white space, which is what (?U)\\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: ColumnOrName) -> Column:
    """Looks at the two ends only."""
    return F.btrim(col(c), F.lit(SPACES))


def blank_to_null(c: ColumnOrName) -> Column:
    """Null where nothing but white space is there; else the value as it is."""
    return F.when(strip(col(c).cast("string")) != "", col(c))


def first_filled(*cs: ColumnOrName) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(c) for c in cs))


def folded(c: ColumnOrName) -> Column:
    """Stripped and lower-cased; null is ''."""
    return F.lower(strip(F.coalesce(col(c).cast("string"), F.lit(""))))


def text_key(c: ColumnOrName) -> Column:
    """What texts are compared by: folded, runs of white space as one space."""
    return F.regexp_replace(folded(c), r"(?U)\s+", " ")


def phrase(c: ColumnOrName) -> Column:
    """Lower case, anything but a-z, 0-9 and white space as a space, runs as one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", " "))


def char_count(c: ColumnOrName, chars: str) -> Column:
    """How many characters are among ``chars``."""
    return F.length(c) - F.length(F.translate(col(c), chars, ""))


def run_length(c: ColumnOrName, pattern: str) -> Column:
    """Characters in the runs that match; ``regexp_count`` would make an array of all of them."""
    return F.length(c) - F.length(F.regexp_replace(col(c), pattern, ""))


def word_count(c: ColumnOrName) -> Column:
    """Each word is brought down to one mark, which white space never is."""
    return F.coalesce(char_count(F.regexp_replace(col(c), r"(?U)\S++", "w"), "w"), F.lit(0))


def tokens(c: ColumnOrName) -> Column:
    """Runs of letters, digits and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))


def token_count(c: ColumnOrName) -> Column:
    return char_count(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[a-z0-9']++", "\x01"), "\x01") - char_count(F.coalesce(col(c), F.lit("")), "\x01")


def count_of(c: ColumnOrName, words: list[str] | tuple[str, ...]) -> Column:
    """How many tokens are one of the words; only those that are become an array."""
    return F.regexp_count(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(any_of(words))) if words else F.lit(0)


def any_of(words: list[str] | tuple[str, ...]) -> str:
    """A pattern for tokens of lower-cased text that are one of the words."""
    return rf"(?<![a-z0-9'])(?:{'|'.join(sorted(words, key=len, reverse=True))})(?![a-z0-9'])"


def sentences(c: ColumnOrName) -> Column:
    """Stripped sentences: cut after . ! ? before white space, and at line feeds; blank ones left out."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])(?U)\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def csv_items(c: ColumnOrName) -> Column:
    """Lower-cased items of a comma list, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def caps_ratio(c: ColumnOrName) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return ratio(run_length(t, "[A-Z]++"), run_length(t, "[A-Za-z]++"))


def exclamation_ratio(c: ColumnOrName) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return ratio(char_count(t, "!"), F.length(t))


def joined_text(*cs: ColumnOrName, sep: str = ". ") -> Column:
    """The filled parts, stripped of nothing, with a separator between."""
    return F.concat_ws(sep, *(blank_to_null(c) for c in cs))


def quote(c: ColumnOrName, most: int = 240) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")), 1, most)


def title_case(c: ColumnOrName) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def video_id(c: ColumnOrName) -> Column:
    """The 11-character id of a watch, short or embed link, or of a bare id."""
    marks = [r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"(?:embed|shorts)/([A-Za-z0-9_-]{11})", r"^([A-Za-z0-9_-]{11})$"]
    return F.coalesce(*(F.nullif(F.regexp_extract(strip(col(c)), m, 1), F.lit("")) for m in marks))


def unfenced(c: ColumnOrName) -> Column:
    """Text without the code fence around it."""
    return strip(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))

"""Column expressions on texts: segments, marking, seeded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SEGMENT = WORD + r"+|[^\p{L}\p{N}_]"
BLANK = r"^[ \t\n\r\f\x0B]$"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def segments(text: Column) -> Column:
    """The text cut into runs of word characters and single other characters; nothing is left out."""
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))


def mark_at(text: Column, start: Column, size: Column) -> Column:
    """The text with asterisks around `size` characters from the 0-based `start`."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit("*"), F.substring(text, start + 1, size), F.lit("*"), F.substring(text, start + size + 1, F.length(text)))


def mark_first(text: Column, word: Column) -> Column:
    """The text with asterisks around the first occurrence of the word, in any case, between Unicode word
    edges; null if there is none, or if the text has an asterisk already."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    marked = F.regexp_replace(text, F.concat(F.lit(rf"(?s)(?iu)\A(.*?){EDGE}("), quoted, F.lit(f"){EDGE}")), F.lit("$1*$2*"))
    return F.when((F.instr(text, "*") == 0) & (marked != text), marked)


def key(*parts: Column | str | int) -> Column:
    """A seeded sort key: the MD5 of the parts."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def number(k: Column, below: Column | int) -> Column:
    """A number from 0 to below - 1, drawn by a key."""
    return F.conv(F.substring(k, 1, 8), 16, 10).cast("long") % (below if isinstance(below, Column) else F.lit(below))

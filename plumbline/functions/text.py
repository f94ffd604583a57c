"""Text helpers shared by the document, catalogue and lesson jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped at both ends of a text, and the line ends.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
CONTENTS_TITLE = "## DOCUMENTATION TABLE OF CONTENTS\n"
TRUNCATED = "\n... (truncated)\n"
QUERY_TRUNCATED = (
    "\n... [SYSTEM WARNING: Result truncated. Rewrite your query to be more targeted.]"
)
TRANSCRIPT_TRUNCATED = "\n... (exploration transcript truncated)\n"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def truncate(text: Column, budget: int, marker: str = TRUNCATED) -> Column:
    """At most ``budget`` characters, then the marker; a budget of 0 or less is off."""
    if budget <= 0:
        return text
    return F.when(
        F.length(text) > budget, F.concat(F.left(text, F.lit(budget)), F.lit(marker))
    ).otherwise(text)


def contents(text: Column) -> Column:
    """All lines starting with ``#``, stripped, one per line; '' when there is none."""
    heads = F.filter(lines(text), lambda line: line.startswith("#"))
    return F.array_join(F.transform(heads, strip), "\n")


def with_contents(text: Column) -> Column:
    """Table of contents in front of the document; a document without heads is unchanged."""
    heads = contents(text)
    return F.when(
        heads != "", F.concat(F.lit(CONTENTS_TITLE), heads, F.lit("\n\n"), text)
    ).otherwise(text)


def normal_pattern(text: Column) -> Column:
    """Form in which lesson patterns are compared: first line, stripped, lower case."""
    first = F.element_at(lines(strip(text)), 1)
    return F.lower(strip(first))

"""Text as Python sees it, in native expressions: Unicode white space, code points, lines, paragraphs and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's class of what str.isspace() accepts.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

SPAN = "struct<start:bigint,end:bigint,score:double>"
SPANS = f"array<{SPAN}>"
ATTRIBUTES = f"map<string,{SPANS}>"


def strip(text: Column) -> Column:
    """str.strip()."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def split_words(text: Column) -> Column:
    """str.split(): maximal runs without white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda w: w != "")


def split_lines(text: Column, separator: str = "\n") -> Column:
    """str.split(separator), trailing empty parts and all."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def unit(key: Column, seed: int = 0) -> Column:
    """A number from 0 up to 1, fixed by the key and the seed: the first 52 bits of an MD5."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13)
    return F.conv(head, 16, 10).cast("long") / float(1 << 52)


def span(start, end, score) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(start).cast("long").alias("start"), lit(end).cast("long").alias("end"), lit(score).cast("double").alias("score"))


def whole(text: Column, score) -> Column:
    """The single span of the whole text with that score, rounded to five digits."""
    score = score if isinstance(score, Column) else F.lit(score)
    return F.array(span(0, F.length(text), F.round(score.cast("double"), 5)))


def none() -> Column:
    return F.array().cast(SPANS)


def variable_name(name: Column) -> Column:
    """Whatever may not be in an attribute's name becomes an underscore."""
    return F.regexp_replace(name, "[^0-9A-Z_a-z]", "_")

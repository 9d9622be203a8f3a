"""Text functions: lines, blanks, byte 4-grams, scores and block prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search keeps scores of 0.3 and more: 77 of 255. Overlaps keep scores above 0.5: twice the shared part exceeds the smaller one.
SEARCH_LEAST = 77

#: The characters of a block prefix and the styles they stand for, in the styles' order.
PREFIXES = {"#": "Heading", "-": "List", ">": "Quote", ",": "Aside"}


def lines(text: Column) -> Column:
    """All lines, blank and trailing empty ones included."""
    return F.split(text, "\n", -1)


def is_blank(text: Column) -> Column:
    """Whether the text is empty or white space, as Unicode has it."""
    return ~text.rlike(r"(?U)\S")


def padded(text: Column) -> Column:
    """The UTF-8 bytes of the text with three zero bytes at both ends; bytes, as their parts are found without counting characters."""
    zeros = F.to_binary(F.lit("000000"), F.lit("hex"))
    return F.concat(zeros, F.encode(text, "utf-8"), zeros)


def gram_at(bytes_: Column, i: Column) -> Column:
    """The 4 bytes from place i as 8 hex digits."""
    return F.hex(F.substring(bytes_, i + 1, F.lit(4)))


def places(text: Column) -> Column:
    """Where the grams of a text begin: L + 3 places for L bytes."""
    return F.sequence(F.lit(0), F.octet_length(text) + 2)


def inner_places(text: Column) -> Column:
    """As `places` for a search term, without those at its ends, as far as it has that many: min((n - 1) div 2, 3) of n at each."""
    n = F.octet_length(text) + 3
    drop = F.least(F.floor((n - 1) / 2), F.lit(3)).cast("int")
    return F.sequence(drop, n - drop - 1)


def part(x: str, whole: str) -> Column:
    """x / whole (column names) in 255ths, rounded down; null for an empty whole."""
    return F.expr(f"cast(if({whole} > 0, (255 * cast({x} as bigint)) div cast({whole} as bigint), null) as int)")


def block_styles(line: Column) -> Column:
    """The set of styles that a line's prefix names, in the styles' order; empty without a prefix."""
    marks = F.regexp_extract(line, "^([,>#-]+) ", 1)
    return F.filter(F.array(*[F.when(F.contains(marks, F.lit(c)), F.lit(s)) for c, s in PREFIXES.items()]), lambda s: s.isNotNull())


def block_rest(line: Column) -> Column:
    """The line without its prefix, or without the backslash that escapes one."""
    return F.when(line.rlike("^[,>#-]+ "), F.regexp_replace(line, "^[,>#-]+ ", "")).when(line.rlike(r"^\\[,>#-]* "), F.substring(line, 2, 1 << 30)).otherwise(line)

"""Ids are UUIDs in canonical lower-case text, whose order is that of their bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = str(uuid.UUID(int=0))


def from_text(text: Column) -> Column:
    """A deterministic id for a text: its MD5 with hyphens."""
    return hyphenated(F.md5(text))


def hyphenated(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def xor(a: Column, b: Column) -> Column:
    """The bitwise exclusive or of two ids: an involution, with the root as its identity."""
    x, y = F.replace(a, F.lit("-")), F.replace(b, F.lit("-"))
    words = [F.conv(F.substring(x, i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(y, i, 8), 16, 10).cast("long")) for i in (1, 9, 17, 25)]
    return hyphenated(F.lower(F.concat(*[F.lpad(F.hex(w), 8, "0") for w in words])))

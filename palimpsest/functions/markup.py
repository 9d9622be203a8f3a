"""The single-line markup language: parsing, writing and their Arrow-batched column functions.

A block is {"type": "Text", "styles": [...], "spans": [{"type": "Text", "styles":
[...], "text": ...}]}; empty styles are left out of its JSON.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: The marks of spans and blocks, each in the order of its styles.
SPAN_MARKS = {"*": "Bold", "_": "Italic", "~": "Struck", "`": "Code"}
BLOCK_MARKS = {"#": "Heading", "-": "List", ">": "Quote", ",": "Aside"}
SPAN_ORDER, BLOCK_ORDER = list(SPAN_MARKS.values()), list(BLOCK_MARKS.values())
#: Characters that a written text escapes.
ESCAPED = "\\*_~`|"

_PREFIX = re.compile(r"[,>#-]+ ")
_ESCAPED_PREFIX = re.compile(r"\\[,>#-]* ")
# a run of backslashes, a mark, or plain text
_TOKEN = re.compile(r"\\+|[*_~`]|[^\\*_~`]+")
_ESCAPED = re.compile(f"[{re.escape(ESCAPED)}]")
_MARK = {s: c for c, s in (*SPAN_MARKS.items(), *BLOCK_MARKS.items())}


class MarkupError(ValueError):
    """A line with a newline in it, or a block that no markup stands for."""


def _ordered(styles, order: list[str]) -> list[str]:
    return [s for s in order if s in styles]


def parse(line: str) -> tuple[list[str], list[tuple[list[str], str]]]:
    """(block styles, [(span styles, text)]) of one line."""
    if "\n" in line:
        raise MarkupError("found a newline")
    styles: list[str] = []
    if m := _PREFIX.match(line):
        styles = _ordered({BLOCK_MARKS[c] for c in m[0][:-1]}, BLOCK_ORDER)
        line = line[m.end() :]
    elif _ESCAPED_PREFIX.match(line):
        line = line[1:]
    spans, text, active, escaped = [], "", set(), False

    def flush() -> None:
        nonlocal text
        if text:
            spans.append((_ordered(active, SPAN_ORDER), text))
        text = ""

    for token in _TOKEN.findall(line):
        if token[0] == "\\":
            text += "\\" * (len(token) // 2)  # each pair is one backslash; an odd one escapes what follows
            escaped = len(token) % 2 == 1
            continue
        if token in SPAN_MARKS:
            if escaped:
                text += token
            else:
                flush()
                active ^= {SPAN_MARKS[token]}
        else:
            text += "\\" * escaped + token
        escaped = False
    flush()
    return styles, spans


def _turn(held: list[str], wanted) -> tuple[str, list[str]]:
    """The marks between a span and the next, and the styles that are open then: the innermost is closed first."""
    closed = [s for s in held[::-1] if s not in wanted]
    opened = [s for s in SPAN_ORDER[::-1] if s in wanted and s not in held]
    return "".join(_MARK[s] for s in closed + opened), [s for s in held if s in wanted] + opened


def write(styles, spans) -> str:
    """The line of a block: its marks, the spans with marks where styles change, and all marks closed in the end.

    Characters that would be read as marks are escaped, and so is a prefix that
    the last span's text begins with.
    """
    block = "".join(_MARK[s] for s in BLOCK_ORDER[::-1] if s in styles)
    said, held = [f"{block} " if block else ""], []
    if spans and _PREFIX.match(spans[-1][1]):
        said.append("\\")
    for own, text in [*spans, ([], "")]:
        marks, held = _turn(held, own)
        said += [marks, _ESCAPED.sub(r"\\\g<0>", text)]
    return "".join(said)


def to_json(line: str) -> str:
    styles, spans = parse(line)
    block = {"type": "Text"} | ({"styles": styles} if styles else {})
    return json.dumps(block | {"spans": [{"type": "Text"} | ({"styles": s} if s else {}) | {"text": t} for s, t in spans]}, ensure_ascii=False, separators=(",", ":"))


def from_json(block: str) -> str:
    held = json.loads(block)
    if held.get("type") != "Text" or any(s.get("type") != "Text" for s in held["spans"]):
        raise MarkupError("only blocks of text have a markup")
    return write(held.get("styles", []), [(s.get("styles", []), s["text"]) for s in held["spans"]])


def to_node(line: str) -> dict:
    """The node that a line stands for: its span, or a chain of its spans, in a page or in its block styles."""
    styles, spans = parse(line)
    made = [{"Styled": {"Span": s, "child": {"Text": t}}} if s else {"Text": t} for s, t in spans]
    inner = made[0] if len(made) == 1 else {"List": "Chain", "children": made}
    return {"Styled": {"Block": styles, "child": inner}} if styles else {"List": "Page", "children": [inner]}


_STYLES = ArrayType(StringType())
BLOCK = StructType().add("block_styles", _STYLES).add("spans", ArrayType(StructType().add("styles", _STYLES).add("text", StringType())))


@F.pandas_udf(BLOCK)
def parse_column(lines: pd.Series) -> pd.DataFrame:
    found = [parse(x) if x is not None and "\n" not in x else ([], []) for x in lines]
    return pd.DataFrame({"block_styles": [s for s, _ in found], "spans": [[{"styles": a, "text": t} for a, t in p] for _, p in found]})


@F.pandas_udf(StringType())
def json_column(lines: pd.Series) -> pd.Series:
    return lines.map(to_json, na_action="ignore")


@F.pandas_udf(StringType())
def rewritten_column(lines: pd.Series) -> pd.Series:
    """Each line parsed and written again."""
    return lines.map(lambda x: write(*parse(x)), na_action="ignore")

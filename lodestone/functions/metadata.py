"""Nested metadata: YAML headers of texts as VARIANT values, keys laid over them by path.

What is read of YAML: block mappings and lists in any nesting, `[...]` and `{...}` on one or several lines, plain and
quoted scalars (null, booleans, integers and decimals get their types; dates stay text), `|` and `>` blocks, comments.
Anchors, tags and several documents are not. Of a key that comes twice the last counts, as with a mapping.

Rows: without a header, {}. A null text and a header that can't be read are NULL. Headers of any length and up to
DEPTH levels are read whole; deeper ones can't be read.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HEADER = r"^---[ \t]*\r?\n([\s\S]*?)(?:\r?\n)?---[ \t]*(?:\r?\n|$)"
DEPTH = 100
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-#\[\]{}"'&*!|>%@`,](?:[^#:]|:(?=\S)|(?<=\S)#)*?|-(?=\S)[^:]*?)[ \t]*:(?:[ \t]+(.*)|)$""", re.S)
_FLOW = re.compile(r"""[ \t\n]*([\[\]{},]|:(?=[ \t\n\[\]{},"']|$)|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\[\]{},:\s](?:[^\[\]{},:]|:(?![ \t\n]))*)""")
# Words that stand for something else than text.
_WORDS = {"": None, "~": None, "null": None, "true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}


def scalar(text: str):
    """The value of a scalar as written."""
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return json.loads(re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", text), strict=False)
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if re.fullmatch(r"[-+]?(0|[1-9][0-9]{0,17})", text):
        return int(text)
    if re.fullmatch(r"[-+]?[0-9]+\.[0-9]*([eE][-+]?[0-9]{1,2})?", text):
        return float(text)
    return text


def _flow(text: str):
    """The value of `[...]` or `{...}`: one pass with a stack of open containers."""
    at, stack, done = 0, [], None
    while at < len(text.rstrip()):
        m = _FLOW.match(text, at)
        if not m or done is not None:
            raise ValueError("flow value")
        at, part = m.end(), m.group(1)
        top = stack[-1] if stack else None
        if part in "[{":
            if len(stack) == DEPTH:
                raise ValueError("too deep")
            stack.append({"into": [] if part == "[" else {}, "key": None, "item": None, "has": False})
        elif top is None:
            raise ValueError("flow value")
        elif part == ":" and isinstance(top["into"], dict):
            top["key"], top["has"], top["item"] = _name(top["item"]), False, None
        elif part in ",]}":
            if isinstance(top["into"], list):
                if top["has"]:
                    top["into"].append(top["item"])
            elif top["key"] is not None or top["has"]:
                key, item = (top["key"], top["item"]) if top["key"] is not None else (_name(top["item"]), None)
                top["into"][key] = item
            top["key"], top["item"], top["has"] = None, None, False
            if part != ",":
                if (part == "]") != isinstance(top["into"], list):
                    raise ValueError("flow value")
                stack.pop()
                if stack:
                    stack[-1]["item"], stack[-1]["has"] = top["into"], True
                else:
                    done = top["into"]
        else:
            top["item"], top["has"] = scalar(part), True
    if done is None:
        raise ValueError("flow value is open")
    return done


def _name(key) -> str:
    return key if isinstance(key, str) else json.dumps(key)


def _bare(line: str) -> str:
    """A line without its comment; a # inside quotes is none."""
    if "#" not in line:
        return line.rstrip()
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Lines:
    """Lines of a header and the place in them; a list item's rest is put back as a line of its own."""

    def __init__(self, text: str) -> None:
        self.lines, self.at = text.splitlines(), 0

    def next(self) -> tuple[int, str] | None:
        """(indent, text) of the next line that says something, left in place."""
        while self.at < len(self.lines):
            bare = _bare(self.lines[self.at])
            if bare.strip():
                return len(bare) - len(bare.lstrip(" ")), bare.lstrip(" ")
            self.at += 1
        return None

    def block_text(self, style: str, indent: int) -> str:
        """The lines below `|` or `>` that are further in than `indent`."""
        own = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > indent):
            own.append(self.lines[self.at])
            self.at += 1
        first = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
        body = "\n".join(x[first:].rstrip() if not x.strip() else x[first:] for x in own).rstrip("\n")
        if style[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", body).replace("\n\n", "\n")
        return body if "-" in style or not body else body + "\n"

    def value(self, rest: str, indent: int, depth: int, in_map: bool):
        """What stands behind a key or dash: on its line, or below it."""
        if re.fullmatch(r"[|>][-+0-9]*", rest):
            return self.block_text(rest, indent)
        if rest[:1] in ("[", "{"):
            own = [rest]
            while True:
                try:
                    if own[-1][-1] in "]}":  # it may end here
                        return _flow("\n".join(own))
                    problem = ValueError("flow value is open")
                except ValueError as e:
                    problem = e
                below = self.next()
                if below is None or below[0] <= indent and below[1][:1] not in ("]", "}"):
                    raise problem
                own.append(below[1])
                self.at += 1
        if rest:
            while not rest.startswith(("'", '"')) and (below := self.next()) and below[0] > indent:  # a plain scalar goes on
                rest += " " + below[1].strip()
                self.at += 1
            return scalar(rest)
        below = self.next()
        if below and (below[0] > indent or in_map and below[0] == indent and re.match(r"-( |$)", below[1])):
            return self.block(below[0], depth + 1)
        return None

    def block(self, indent: int, depth: int = 0):
        """The mapping or list whose lines begin at this indent."""
        if depth > DEPTH:
            raise ValueError("too deep")
        out = None
        while (line := self.next()) and line[0] == indent:
            dash = re.match(r"-(?:\s+|$)", line[1])
            if out is None:
                out = [] if dash else {}
            if isinstance(out, list):
                if not dash:
                    break
                rest = line[1][dash.end() :]
                if rest and (_KEY.match(rest) or re.match(r"-( |$)", rest)):
                    inner = indent + dash.end()
                    self.lines[self.at] = " " * inner + rest
                    out.append(self.block(inner, depth + 1))
                    continue
                self.at += 1
                out.append(self.value(rest, indent, depth, False))
                continue
            key = None if dash else _KEY.match(line[1])
            if not key:
                raise ValueError("neither a key nor an item")
            self.at += 1
            out[_name(scalar(key.group(1)))] = self.value((key.group(2) or "").strip(), indent, depth, True)
        return out


def parse(header: str):
    """The value of a YAML header; raises ValueError where it can't be read."""
    lines = _Lines(header)
    first = lines.next()
    if first is None:
        return {}
    if first[1][0] in "[{":
        lines.at += 1
        out = lines.value(first[1], -1, 0, False)
    else:
        out = lines.block(first[0])
    if lines.next() is not None or not isinstance(out, dict):
        raise ValueError("not one mapping")
    return out


@F.pandas_udf(StringType())
def _as_json(headers: pd.Series) -> pd.Series:
    def one(header):
        try:
            return None if header is None else json.dumps(parse(header), allow_nan=False)
        except ValueError:
            return None

    return headers.map(one)


def frontmatter(text: Column) -> Column:
    """The header of a text as a VARIANT; only headers leave the JVM."""
    header = F.when(text.startswith("---"), F.regexp_extract(text, HEADER, 1))
    return F.when(F.coalesce(header, F.lit("")) != "", F.try_parse_json(_as_json(header))).when(text.isNotNull(), F.parse_json(F.lit("{}")))


def overlay(value: Column, own: dict[str, Column]) -> Column:
    """A VARIANT with own values at their paths (`a.b.c`), which win; what is no object on the way gives place to one."""
    for path, new in own.items():
        value = _put(value, path.split("."), new)
    return value


def _put(value: Column, path: list[str], new: Column) -> Column:
    held = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    below = new.cast("variant") if len(path) == 1 else _put(F.try_element_at(held, F.lit(path[0])), path[1:], new)
    return F.to_variant_object(F.map_concat(F.map_filter(held, lambda k, _: k != path[0]), F.create_map(F.lit(path[0]), below)))

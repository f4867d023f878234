"""Configuration formats parsed into key paths with the spans of their values: JSON, YAML and XML.

Parsers are lenient and keep what they can read: a file that is broken half-way gives the entries
before that. Positions count in characters.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    path: tuple[str, ...]  # names from the top; items of a list have their number
    start: int  # of the value, between its delimiters
    end: int
    value: str
    style: str  # quoted, plain, block, number or text (of XML)


_JSON = re.compile(r"""(?P<space>[\s,]+|//[^\n]*|\#[^\n]*)|(?P<open>[{\[])|(?P<close>[}\]])|(?P<colon>:)|"(?P<string>(?:\\.|[^"\\])*)"|'(?P<single>(?:\\.|[^'\\\n])*)'|(?P<bare>[^\s,:{}\[\]"']+)""")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_LINE = re.compile(r"(?P<indent>[ \t]*)(?P<text>[^\n]*)(?:\n|\Z)")
_KEY = re.compile(r"""(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<k>[^\s#&*!|>%@`"'\[\]{},:?\-][^:\n#]*?|-[^\s:][^:\n]*?))\s*:(?=\s|$)[ \t]*""")
_YAML_LINE = re.compile(r"""(?m)^[ \t]*(?:- +)*(?:"[^"\n]*"|'[^'\n]*'|[\w.\-/$ ]+):(?:[ \t]|\r?$)""")
_CONTENT_LINE = re.compile(r"(?m)^[ \t]*(?![ \t\r#])\S")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>|</(?P<ends>[\w:.\-]+)\s*>|<(?P<name>[A-Za-z_][\w:.\-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?P<name>[A-Za-z_][\w:.\-]*)\s*=\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)')")


def kind(text: str) -> str:
    """json, yaml, xml, or blank for everything else."""
    head = text.lstrip("﻿ \t\r\n")
    if head[:1] == "<" and re.match(r"<(?:\?xml|!--|!DOCTYPE|[A-Za-z_][\w:.\-]*(?:[\s/>]|$))", head):
        return "xml"
    if head[:1] == "{" or re.match(r"\[\s*(?:[\[{\"\d\-]|\])", head):
        return "json"
    lines = sum(1 for _ in _CONTENT_LINE.finditer(text))
    return "yaml" if lines and sum(1 for _ in _YAML_LINE.finditer(text)) >= 0.5 * lines else ""


def entries(text: str, form: str | None = None) -> list[Entry]:
    """The values of a file that is JSON, YAML or XML, in order."""
    return list({"json": json_values, "yaml": yaml_values, "xml": xml_values}.get(kind(text) if form is None else form, lambda _: ())(text))


def _plain(raw: str) -> str:
    """A quoted string without its escapes."""
    if "\\" not in raw:
        return raw
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        pass
    short = {"n": "\n", "t": "\t", "r": "\r"}
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else short.get(m[2], m[2]), raw)


def json_values(text: str, at: int = 0, end: int | None = None, path: tuple[str, ...] = ()) -> Iterator[Entry]:
    """Scalars of JSON, also with comments, single quotes and bare words, as in the flow style of YAML."""
    stack: list[list] = []  # of each open object its name in use, of each list the number of its item
    held: tuple | None = None  # a string that may be a name
    end = len(text) if end is None else end

    def put(item: tuple) -> Entry:
        start, stop, value, style = item
        return Entry((*path, *(str(s[1]) for s in stack if s[1] is not None)), start, stop, value, style)

    while at < end and (m := _JSON.match(text, at, end)):
        at = m.end()
        which = m.lastgroup
        if which == "space":
            if "," in m[0]:
                if held:
                    yield put(held)
                    held = None
                if stack and stack[-1][0] == "[":
                    stack[-1][1] += 1
                elif stack:
                    stack[-1][1] = None
        elif which == "colon":
            if held and stack and stack[-1][0] == "{":
                stack[-1][1], held = held[2], None
        elif which == "open":
            stack.append([m[0], 0 if m[0] == "[" else None])
        elif which == "close":
            if held:
                yield put(held)
                held = None
            if stack:
                stack.pop()
        else:
            if held:
                yield put(held)
            style = "quoted" if which in ("string", "single") else "number" if re.fullmatch(r"-?\d+(?:\.\d+)?", m[0]) else "plain"
            held = (m.start(which), m.end(which), _plain(m[which]), style)
    if held:
        yield put(held)


def yaml_values(text: str) -> Iterator[Entry]:
    """Scalars of YAML by indentation: plain, quoted and block ones, on the line of their key or below, items of lists, and the flow style."""
    levels: list[list] = []  # [indent, name or number of a list's item] of what is open
    at, n = 0, len(text)
    while at < n:
        m = _LINE.match(text, at)
        line_end, next_line = m.end("text"), m.end()
        indent, pos = len(m["indent"]), m.start("text")
        at = next_line if next_line > at else n
        body = m["text"].rstrip("\r")
        if not body or body[0] == "#" or body in ("---", "..."):
            continue
        while text[pos : pos + 2] in ("- ", "-\n", "-\r") or pos == n - 1 and text[pos] == "-":
            while levels and levels[-1][0] > indent:
                levels.pop()
            if levels and levels[-1][0] == indent and not isinstance(levels[-1][1], str):
                levels[-1][1] += 1
            else:
                levels.append([indent, 0])
            step = re.compile(r"-[ \t]*").match(text, pos).end() - pos
            indent, pos = indent + step, pos + step
        if pos >= line_end:
            continue
        key = _KEY.match(text, pos, line_end)
        if key:
            # a list may stand at the indentation of its key, items of which end with the next key
            while levels and levels[-1][0] >= indent:
                levels.pop()
            levels.append([indent, key["d"] or key["s"] or (key["k"] or "").strip()])
            pos = key.end()
        path = tuple(str(x[1]) for x in levels)
        rest = re.compile(r"(?:[&!][^\s]*[ \t]+)*").match(text, pos, line_end).end()
        tagged, pos = text[pos:rest], rest
        if pos >= line_end or text[pos] in "\r#":
            continue
        if "!" in tagged and re.search(r"!(?:vault|secret|env|ref|reference|sub|encrypted)\b", tagged):
            head = text[pos]
            if head in "|>":
                at = _block(text, at, indent)[2]
            continue
        c = text[pos]
        if c in "|>" and re.compile(r"[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\r?").fullmatch(text, pos, line_end):
            start, stop, at = _block(text, at, indent if key else indent - 1)
            if start >= 0:
                yield Entry(path, start, stop, text[start:stop], "block")
        elif c in "{[":
            stop = _flow_end(text, pos)
            yield from json_values(text, pos, stop, path)
            after = text.find("\n", stop - 1)
            at = max(at, after + 1 if after >= 0 else n)
        elif c in "\"'":
            q = re.compile(r'"((?:\\.|[^"\\])*)"' if c == '"' else r"'((?:''|[^'])*)'").match(text, pos)
            if q:
                yield Entry(path, q.start(1), q.end(1), _plain(q[1]) if c == '"' else q[1].replace("''", "'"), "quoted")
                if q.end() > at:
                    after = text.find("\n", q.end())
                    at = after + 1 if after >= 0 else n
        else:
            stop = pos + len(re.sub(r"\s+#.*$|\s+$", "", text[pos:line_end]))
            if stop > pos and c not in "*&@`%":
                value = text[pos:stop]
                yield Entry(path, pos, stop, value, "number" if re.fullmatch(r"-?\d+(?:\.\d+)?", value) else "plain")


def _block(text: str, at: int, indent: int) -> tuple[int, int, int]:
    """(start, end, next line) of the lines from ``at`` on that are blank or further in than ``indent``."""
    start = stop = -1
    while at < len(text):
        m = _LINE.match(text, at)
        body = m["text"].strip()
        if body and len(m["indent"]) <= indent:
            break
        if body:
            start, stop = m.start("text") if start < 0 else start, m.start("text") + len(m["text"].rstrip())
        if m.end() <= at:
            at = len(text)
            break
        at = m.end()
    return start, stop, at


def _flow_end(text: str, at: int) -> int:
    """Where the list or object that begins at ``at`` ends."""
    depth = 0
    while m := _JSON.match(text, at):
        depth += (m.lastgroup == "open") - (m.lastgroup == "close")
        at = m.end()
        if depth <= 0:
            return at
    return len(text)


def xml_values(text: str) -> Iterator[Entry]:
    """Texts of elements and values of attributes. An attribute ``value`` (also content of an element) beside one called key or name goes by that name."""
    stack: list[str] = []
    at = 0
    for m in _MARKUP.finditer(text):
        between = text[at : m.start()]
        if stack and between.strip() and "<" not in between:
            start = at + len(between) - len(between.lstrip())
            value = between.strip()
            yield Entry(tuple(stack), start, start + len(value), html.unescape(value), "text")
        at = m.end()
        if m["cdata"] is not None and m["cdata"].strip():
            yield Entry(tuple(stack), m.start("cdata"), m.end("cdata"), m["cdata"], "text")
        elif m["ends"]:
            if m["ends"] in stack:
                while stack.pop() != m["ends"]:
                    pass
        elif m["name"]:
            attributes = [(a["name"], a.start(a.lastgroup), a.end(a.lastgroup), a[a.lastgroup]) for a in _ATTRIBUTE.finditer(text, m.start("attrs"), m.end("attrs"))]
            named = next((v for n, _, _, v in attributes if n.lower() in ("key", "name", "id", "property")), None)
            for name, start, stop, value in attributes:
                if value == named and len(attributes) > 1 and name.lower() in ("key", "name", "id", "property"):
                    continue
                own = (named, name) if name.lower() in ("value", "val", "content", "connectionstring") and named else (name,)
                yield Entry((*stack, m["name"], *own), start, stop, html.unescape(value), "quoted")
            if not m["attrs"].rstrip().endswith("/"):
                stack.append(m["name"] if not named or sum(n.lower() in ("value", "val") for n, *_ in attributes) else named)


def tags(text: str) -> list[tuple[int, int]]:
    """Spans of the tags of XML."""
    return [m.span() for m in _MARKUP.finditer(text) if m["name"]]

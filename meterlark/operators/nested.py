"""Problem 2: deeply nested records as related flat tables, by structural variants.

A tree automaton classifies every object. Its states are built from the bottom up: a value's state is
null, bool, int, bigger (a whole number beyond 64 bits), number, text, a list of its items' states, or an object, whose state is the set of
its members with their states. Going down from the task, its transitions (level, member) -> level
tell which objects are clips, renditions and files; the list a transition reads has the state of a
list of that level, whatever its items look like, so that a parent's state doesn't depend on the
variants of its children. An object's *variant* is its state. Irregularities are undone before: member
names are compared without case and underscores, a string that holds JSON is what it holds, a single
object in place of a list is a list of one.

Records, clips, renditions and files go to a table of their level, which keeps the keys of all its
variants (the common supertype) and the key of the parent. Each variant's own members are a typed
table of their own, see ``subtypes``. All are read from one ``shred``. Payloads that can't be read
are set apart.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from json.decoder import scanstring
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlark.session import durable


class Level(NamedTuple):
    name: str
    member: str  # that holds its list in the level above
    common: tuple[str, ...]  # members kept for all variants


#: The levels below the record, each a transition of the automaton from the one before.
LEVELS = (Level("clip", "clips", ("clipid", "title")), Level("rendition", "renditions", ("kind",)), Level("file", "files", ("uri", "bytesize", "meta")))
RECORD = ("taskid",)
#: Types of the columns of subtype tables by state; everything else stays JSON.
TYPES = {"bool": "boolean", "int": "bigint", "number": "double", "text": "string", "null": "string"}
#: Whole numbers that a bigint holds; others have a state of their own and stay JSON.
_INT = range(-(1 << 63), 1 << 63)
_SCALARS = {bool: "bool", int: "int", float: "number", type(None): "null"}
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")


def member(name: str) -> str:
    """A member's name without case and underscores."""
    return name.replace("_", "").casefold()


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def loads(text: str) -> object:
    """The JSON of a text, nested however deeply; ValueError if it is none."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _deep_loads(text)


def _deep_loads(text: str) -> object:
    """As ``json.loads``, with a stack of its own."""
    skip = lambda at: _BLANK.match(text, at).end()
    stack: list = []  # open lists, and open objects with the name whose value comes next
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c == "{":
            at = skip(at + 1)
            if text[at : at + 1] == '"':
                name, at = scanstring(text, at + 1)
                at = skip(at)
                if text[at : at + 1] != ":":
                    raise ValueError("no value")
                stack.append(({}, name))
                at = skip(at + 1)
                continue
            if text[at : at + 1] != "}":
                raise ValueError("no member")
            value, at = {}, at + 1
        elif c == "[":
            at = skip(at + 1)
            if text[at : at + 1] != "]":
                stack.append(([], None))
                continue
            value, at = [], at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                m = _NUMBER.match(text, at)
                if not m:
                    raise ValueError("no JSON")
                value, at = float(m[0]) if m[1] or m[2] else int(m[0]), m.end()
        while stack:  # the value goes where it belongs, which may end lists and objects
            box, name = stack[-1]
            if name is None:
                box.append(value)
            else:
                box[name] = value
            at = skip(at)
            c, at = text[at : at + 1], skip(at + 1)
            if c == ("]" if name is None else "}"):
                stack.pop()
                value = box
                continue
            if c != ",":
                raise ValueError("no end")
            if name is not None:
                if text[at : at + 1] != '"':
                    raise ValueError("no member")
                name, at = scanstring(text, at + 1)
                at = skip(at)
                if text[at : at + 1] != ":":
                    raise ValueError("no value")
                stack[-1] = (box, name)
                at = skip(at + 1)
            break
        else:
            if skip(at) != len(text):
                raise ValueError("more than one value")
            return value


def dumps(value: object) -> str:
    """A value as JSON with sorted members."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        out, todo = [], [value]
        while todo:
            v = todo.pop()
            if isinstance(v, _Mark):
                out.append(v)
            elif isinstance(v, dict) and v:
                parts: list = [_Mark("{")]
                for i, k in enumerate(sorted(v)):
                    parts += [_Mark((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": "), v[k]]
                todo += reversed([*parts, _Mark("}")])
            elif isinstance(v, list) and v:
                parts = [_Mark("[")]
                for i, x in enumerate(v):
                    parts += [_Mark(", "), x] if i else [x]
                todo += reversed([*parts, _Mark("]")])
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


class _Mark(str):
    """Text of a value that is being written."""


@contextmanager
def _depth(most: int = 10_000_000):
    """Lets functions of this module call themselves as deeply as a payload is nested."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(most)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def opened(value: object) -> object:
    """The value itself, or what a string that holds JSON (an object, list, string or null) holds; each opening makes it shorter."""
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"', "n") or value == "":
            return value
        try:
            inner = loads(value)
        except ValueError:
            return value
        if inner is not None and not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def parse(payload: str | None) -> object:
    """The JSON of a payload, unwrapped; ValueError if it can't be read."""
    if payload is None:
        raise ValueError("no payload")
    return opened(loads(payload))


def members(node: dict) -> dict[str, object]:
    """Members by compared name; of members that differ in spelling only, the first that isn't null."""
    out: dict[str, object] = {}
    for name, value in node.items():
        key = member(name)
        if out.get(key) is None:
            out[key] = value
    return out


def children(node: dict[str, object], name: str) -> list[object]:
    """The list under a name: an object is a list of one, anything else than a list or object is empty."""
    value = opened(node.get(name))
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def state(value: object) -> str:
    """The automaton's state of a value, from the states of what it holds. An object's is named by a digest of its members and their states."""
    scalar = _SCALARS.get(type(value))
    if scalar:
        return scalar if scalar != "int" or value in _INT else "bigger"
    value = opened(value)
    if isinstance(value, str):
        return "text"
    if isinstance(value, dict):
        return "object#" + blake2b(shape(members(value)).encode(), digest_size=5).hexdigest()
    if isinstance(value, list):
        return f"list<{'|'.join(sorted({state(v) for v in value}))}>"
    return _SCALARS[type(value)]


def shape(node: dict[str, object], below: Level | None = None) -> str:
    """An object's members with their states, in order of name. ``below``: the transition from this object; what it reads is a list of that level."""
    parts = []
    for name, value in sorted(node.items()):
        inside = f"list<{below.name}>" if below and name == below.member and isinstance(opened(value), (dict, list)) else state(value)
        parts.append(f"{name if name.isalnum() else dumps(name)}:{inside}")
    return ",".join(parts)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else dumps(value)


def task(payload: str | None, first: str = LEVELS[0].member) -> dict[str, object] | None:
    """The task of a payload: the top object, or the object under its ``data`` where the top has no clips of its own; None for other JSON."""
    top = parse(payload)
    if not isinstance(top, dict):
        return None
    node = members(top)
    inner = opened(node.get("data"))
    if isinstance(inner, dict) and node.get(first) is None:
        return members(inner)
    return node


def rows(payload: str | None, levels: tuple[Level, ...] = LEVELS, common: tuple[str, ...] = RECORD, own: bool = True) -> list[tuple]:
    """(level, positions.., variant, common, own) of a payload: one of level ``record`` or ``unreadable``, and one for each object below."""
    try:
        node = task(payload, levels[0].member)
    except ValueError:
        node = None
    if node is None:
        return [("unreadable", *[None] * len(levels), None, [], None)]
    out: list[tuple] = []
    # objects with their level and place, last first; a level's objects come in the order of their lists
    todo: list[tuple[int, tuple, dict]] = [(-1, (), node)]
    while todo:
        at, place, node = todo.pop()
        name, kept = (levels[at].name, levels[at].common) if at >= 0 else ("record", common)
        below = levels[at + 1] if at + 1 < len(levels) else None
        fill = (*place, *[None] * (len(levels) - len(place)))
        if own:
            values = [(k, _text(node.get(k))) for k in kept]
            rest = dumps({k: opened(v) for k, v in node.items() if k not in kept and not (below and k == below.member)})
        else:
            values, rest = [], None
        out.append((name, *fill, shape(node, below), values, rest))
        if below:
            found = [(at + 1, (*place, i), members(item)) for i, x in enumerate(children(node, below.member), 1) if isinstance(item := opened(x), dict)]
            todo += reversed(found)
    return out


def shred(df: DataFrame, key: str, payload: str, levels: tuple[Level, ...] = LEVELS, common: tuple[str, ...] = RECORD, own: bool = True) -> DataFrame:
    """(key, level, a position for each level, variant, common, own): all objects of all payloads with the way to their parents.

    Positions count from 1 in the list as received, nulls and other non-objects included, which
    give no rows themselves. Null, empty and blank payloads, those that aren't JSON and those whose
    JSON isn't an object are ``unreadable``. ``own`` is the JSON of the members that aren't common
    to the level; it and ``common`` are left empty where only places and variants are asked for.
    Repeated records give their own rows; very long and very deep payloads are read whole; an empty
    table gives an empty table; other columns don't matter. Narrow: a record is taken apart where
    it is read.
    """
    places = [f"{x.name}_no" for x in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * len(levels), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                place, out = [], []
                with _depth():
                    for i, p in enumerate(part.column(1).to_pylist()):
                        got = rows(p, levels, common, own)
                        place += [i] * len(got)
                        out += got
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place)), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["k", "level", *places, "variant", "common", "own"])

    source = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("p"))
    schema = f"k {dict(source.dtypes)['k']}, level string, {', '.join(f'{p} int' for p in places)}, variant string, common map<string,string>, own string"
    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


def files_only(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, clip_no, rendition_no, file_no) of every object that the automaton takes for a file, from ``shred``."""
    return shred(df, key, payload, own=False).filter("level = 'file'").select(key, "clip_no", "rendition_no", "file_no")


def tables(objects: DataFrame, key: str) -> dict[str, DataFrame]:
    """The flat tables of a ``shred``: records, clips, renditions, files and unreadable, each keyed to its parent."""
    place = [key]
    flat = {"records": objects.filter("level = 'record'").select(key, "variant", *(F.col("common")[c].alias(c) for c in RECORD))}
    for x in LEVELS:
        place = [*place, f"{x.name}_no"]
        flat[f"{x.name}s"] = objects.filter(F.col("level") == x.name).select(*place, "variant", *(F.col("common")[c].alias(c) for c in x.common))
    return flat | {"unreadable": objects.filter("level = 'unreadable'").select(key)}


def variants(objects: DataFrame) -> DataFrame:
    """(level, variant, objects): how many objects there are of each variant."""
    return objects.filter("level <> 'unreadable'").groupBy("level", "variant").agg(F.count("*").alias("objects"))


def own_members(variant: str, common: tuple[str, ...], below: Level | None) -> list[tuple[str, str]]:
    """(name, state) of a variant's own members."""
    out, at = [], 0
    while at < len(variant):
        name, stop = scanstring(variant, at + 1) if variant[at] == '"' else (variant[at : variant.index(":", at)], variant.index(":", at))
        end = _end(variant, stop)
        if name not in common and not (below and name == below.member):
            out.append((name, variant[stop + 1 : end]))
        at = end + 1
    return out


def _end(variant: str, at: int) -> int:
    """Where a state ends: at a comma outside of its lists."""
    depth = 0
    for i in range(at, len(variant)):
        depth += (variant[i] == "<") - (variant[i] == ">")
        if variant[i] == "," and not depth:
            return i
    return len(variant)


def subtypes(objects: DataFrame, key: str, level: str) -> dict[str, DataFrame]:
    """A table for each variant of a level: the keys, and the variant's own members as columns of their types (lists and objects as JSON).

    ``objects`` is a written ``shred``, as each table reads it. The variants of a level are counted
    by aggregation and brought to the driver: they are shapes, whose number is that of the programs
    that write records, not of the records. Columns are named by member, with ``_`` behind names that
    are keys.
    """
    at = next((i for i, x in enumerate(LEVELS) if x.name == level), -1)
    common, below = (LEVELS[at].common if at >= 0 else RECORD), (LEVELS[at + 1] if at + 1 < len(LEVELS) else None)
    keys = [key, *(f"{x.name}_no" for x in LEVELS[: at + 1])]
    mine, out = objects.filter(F.col("level") == level), {}
    for row in mine.groupBy("variant").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "variant").collect():
        fields = own_members(row["variant"], common, below)
        schema = ", ".join(f"`{n.replace('`', '``')}` {TYPES.get(s, 'string')}" for n, s in fields)
        own = F.from_json("own", schema) if fields else None
        out[row["variant"]] = mine.filter(F.col("variant") == row["variant"]).select(*keys, *(own.getField(n).alias(n + "_" * (n in keys)) for n, _ in fields))
    return out


def values(objects: DataFrame, key: str) -> DataFrame:
    """(keys, level, variant, member, kind, text, whole, fraction, flag): the own members of all objects, each value in the column of its type; lists and objects are JSON in ``text``."""
    typed = F.explode(F.from_json("own", "map<string,variant>"))
    rows = objects.filter("level <> 'unreadable'").select(key, *(f"{x.name}_no" for x in LEVELS), "level", "variant", typed.alias("member", "v"))
    kind = F.schema_of_variant("v")
    get = lambda test, kind_: F.when(test, F.try_variant_get("v", "$", kind_))
    return rows.select(
        key, *(f"{x.name}_no" for x in LEVELS), "level", "variant", "member",
        F.when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "text").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("number").alias("kind"),
        F.when(kind != "VOID", F.try_variant_get("v", "$", "string")).alias("text"),
        get(kind == "BIGINT", "bigint").alias("whole"),
        get(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "double").alias("fraction"),
        get(kind == "BOOLEAN", "boolean").alias("flag"),
    )


def written(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``shred`` as a table in the shared folder, parted by level: one parse for all tables read from it, which read their own level only."""
    return durable(shred(df, key, payload), by="level")

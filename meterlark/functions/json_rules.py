"""Conditions on and edits of JSON texts."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

MODES = ("full", "prefix", "suffix", "contains", "gt", "gte", "lt", "lte")


def _at(doc: Column, path: str) -> tuple[Column, str]:
    """The variant and the JSON path in it that a dotted path means; a number is an index of a list, a negative one counts from its end."""
    steps = "$"
    for p in path.split("."):
        if re.fullmatch(r"-\d+", p):
            doc, steps = F.try_element_at(F.try_variant_get(doc, steps, "array<variant>"), F.lit(int(p))), "$"
        else:
            steps += f"[{p}]" if p.isdigit() else f"['{p}']"
    return doc, steps


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once a row, however often it is used: branches don't share what they compute."""
    return F.element_at(F.transform(F.array(value), then), 1)


def condition(doc: Column, path: str, mode: str, value: object, invert: bool = False, pass_missing_key: bool = False) -> Column:
    """One condition on a parsed document (a variant).

    A path that isn't there gives ``pass_missing_key``. A comparison of numbers needs a number, and
    equality a value of the same type (null equals null only): anything else is an error, which is
    null here, also inverted.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode in MODES[4:] and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise ValueError("a comparison needs a number")
    doc, at = _at(doc, path)
    return _let(F.try_variant_get(doc, at, "variant"), lambda v: F.when(v.isNotNull(), _test(v, mode, value, invert)).otherwise(F.lit(pass_missing_key)))


def _test(doc: Column, mode: str, value: object, invert: bool) -> Column:
    """A condition on a value that is there."""
    text, kind = F.try_variant_get(doc, "$", "string"), F.schema_of_variant(doc)
    numeric = kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)")
    number = F.when(numeric, F.try_variant_get(doc, "$", "double"))
    if mode == "full":
        if value is None:
            test = kind == "VOID"
        else:
            same = F.when(kind == "BOOLEAN", text == str(value).lower()) if isinstance(value, bool) else number == float(value) if isinstance(value, (int, float)) else F.when(kind == "STRING", text == str(value))
            test = F.when(kind == "VOID", F.lit(False)).otherwise(same)
    elif mode in ("prefix", "suffix", "contains"):
        test = {"prefix": text.startswith, "suffix": text.endswith, "contains": text.contains}[mode](str(value))
    else:
        test = {"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[mode]
    return ~test if invert else test


def rules(json_text: Column, conditions: list[dict], logic: str = "OR") -> Column:
    """Conditions joined by OR unless ``logic`` is AND; none at all is true. Broken JSON has no paths. Where any condition is an error, the rules don't hold."""
    if not conditions:
        return F.lit(True)
    tests = _let(F.try_parse_json(json_text), lambda doc: F.array(*(condition(doc, **c) for c in conditions)))
    holds = (lambda a: F.forall(a, lambda t: t)) if logic.upper() == "AND" else (lambda a: F.exists(a, lambda t: t))
    return _let(tests, lambda a: F.when(F.exists(a, lambda t: t.isNull()), F.lit(False)).otherwise(holds(a)))


def without_keys(json_text: Column, keys: list[str]) -> Column:
    """A JSON object without some members; null where the text is no JSON object."""
    # from_json reads the object members as they are; a text that isn't JSON at all gives null first
    members = F.from_json(F.when(F.try_parse_json(json_text).isNotNull(), json_text), "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, _: ~k.isin(keys)))


def _steps(path: str) -> list[str]:
    return [p for p in path.split(".") if p]


def _places(doc: object, steps: list[str]) -> Iterator[tuple[object, object]]:
    """(container, key) of every place a path names; ``*`` is any member or index, a negative number counts from the end."""
    head, rest = steps[0], steps[1:]
    if isinstance(doc, dict):
        keys: list = list(doc) if head == "*" else [head]
    elif isinstance(doc, list):
        keys = list(range(len(doc))) if head == "*" else [int(head) + (len(doc) if int(head) < 0 else 0)] if re.fullmatch(r"-?\d+", head) else []
        keys = [k for k in keys if 0 <= k < len(doc)]
    else:
        return
    for k in keys:
        if not rest:
            yield doc, k
        elif isinstance(doc, list) or k in doc:
            yield from _places(doc[k], rest)


def _get(doc: object, path: str) -> tuple[bool, object]:
    for box, k in _places(doc, _steps(path)):
        if isinstance(box, list) or k in box:
            return True, box[k]
    return False, None


def _set(doc: object, path: str, value: object) -> None:
    steps = _steps(path)
    box = doc
    if "*" not in steps:
        for s in steps[:-1]:  # members on the way are made
            if isinstance(box, dict):
                box = box.setdefault(s, {})
    for box, k in list(_places(doc, steps)):
        box[k] = copy.deepcopy(value)


def edit(doc: object, operations: list[dict]) -> object:
    """The edited document. Operations: mode, path, and value, from, to or pattern by mode.

    set, delete, copy, move, append, prepend, trim_prefix, trim_suffix, ensure_prefix,
    ensure_suffix, trim_space, to_lower, to_upper, replace, regex_replace, prune_objects.
    ``keep_origin`` leaves a place that is set already. Operations on strings skip other values.
    """
    for op in operations:
        mode, path, value = op["mode"], op.get("path", ""), op.get("value")
        if mode == "set":
            if not (op.get("keep_origin") and _get(doc, path)[0]):
                _set(doc, path, value)
        elif mode == "delete":
            for box, k in reversed(list(_places(doc, _steps(path)))):
                if isinstance(box, list) or k in box:
                    del box[k]
        elif mode in ("copy", "move"):
            there, found = _get(doc, op["from"])
            if there:
                if mode == "move":
                    doc = edit(doc, [{"mode": "delete", "path": op["from"]}])
                _set(doc, op["to"], found)
        elif mode == "prune_objects":
            doc = _prune(doc, value)
        else:
            for box, k in list(_places(doc, _steps(path))):
                if isinstance(box, dict) and k not in box:
                    continue
                box[k] = _changed(box[k], mode, op)
    return doc


def _changed(old: object, mode: str, op: dict) -> object:
    value = op.get("value", "")
    if isinstance(old, list) and mode in ("append", "prepend"):
        more = value if isinstance(value, list) else [value]
        return old + more if mode == "append" else more + old
    if isinstance(old, dict) and mode in ("append", "prepend") and isinstance(value, dict):
        return old | value if mode == "append" else value | old
    if not isinstance(old, str):
        return old
    plain = {
        "append": lambda: old + str(value),
        "prepend": lambda: str(value) + old,
        "trim_prefix": lambda: old.removeprefix(str(value)),
        "trim_suffix": lambda: old.removesuffix(str(value)),
        "ensure_prefix": lambda: old if old.startswith(str(value)) else str(value) + old,
        "ensure_suffix": lambda: old if old.endswith(str(value)) else old + str(value),
        "trim_space": old.strip,
        "to_lower": old.lower,
        "to_upper": old.upper,
        "replace": lambda: old.replace(op["from"], op.get("to", "")),
        "regex_replace": lambda: re.sub(op["pattern"], op.get("to", ""), old),
    }
    if mode not in plain:
        raise ValueError(f"no such operation: {mode}")
    return plain[mode]()


def _prune(doc: object, match: dict) -> object:
    """Without the objects that have all of the given members."""
    hit = lambda x: isinstance(x, dict) and all(x.get(k) == v for k, v in match.items())
    if isinstance(doc, dict):
        return {k: _prune(v, match) for k, v in doc.items() if not hit(v)}
    return [_prune(v, match) for v in doc if not hit(v)] if isinstance(doc, list) else doc


def edited(json_text: Column, operations: list[dict]) -> Column:
    """Texts edited in Arrow batches; a text that is no JSON stays as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(edit(json.loads(t), operations), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return t

        return texts.map(one)

    return run(json_text)

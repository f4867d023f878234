"""Scalar helpers: buckets, guarded division, rounding, masks, status ranges, calendar, token estimate."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def bucket(t: Column, size: int) -> Column:
    """Start of the bucket of ``size`` seconds that holds ``t``; the size is an hour if it isn't positive."""
    size = size if size > 0 else 3600
    return t - t % F.lit(size)


def away(x: Column, digits: int) -> Column:
    """Rounded half away from zero."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def divided(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, rounded; 0 where that is no number."""
    x = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(away(x, digits))


def digest(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def shown(quota: Column, kind: str = "USD", unit: int = 500_000, rate: float = 1.0) -> Column:
    """A quota in dollars, in another currency by its rate (CNY) or as it is (TOKENS)."""
    plain = quota.cast("double")
    return plain if kind == "TOKENS" else plain / unit * rate if kind == "CNY" else plain / unit


def share(part: Column, whole: Column) -> Column:
    return F.when((part > 0) & (whole > 0), away(part / whole, 4)).otherwise(F.lit(0.0))


def growth(now: Column, before: Column) -> Column:
    """Percent; 100 for what is new, 0 where there is nothing either time."""
    return F.when(F.coalesce(before, F.lit(0)) <= 0, F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(away((now - before) / before * 100, 4))


def contains(column: Column, needle: str | None) -> Column | None:
    """LIKE '%needle%' with ! as escape; no filter for a blank needle. Case counts."""
    needle = (needle or "").strip()
    if not needle:
        return None
    return F.like(column, F.lit("%" + re.sub(r"([!%_])", r"!\1", needle) + "%"), F.lit("!"))


def guarded_like(column: Column, pattern: str) -> Column:
    """A user's pattern with at most two % and at least two other bytes; without % it means equality."""
    bare = pattern.replace("%", "")
    if "%%" in pattern or pattern.count("%") > 2 or ("%" in pattern and len(bare.encode()) < 2):
        raise ValueError("pattern not allowed")
    if "%" not in pattern:
        return column == pattern
    return F.like(column, F.lit(re.sub(r"([!_])", r"!\1", pattern)), F.lit("!"))


def csv_items(column: Column) -> Column:
    """Items of a comma-separated column: trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def csv_has(column: Column, item: str | None) -> Column | None:
    """Whether a comma-separated column holds an item; no filter for blank, ``all`` and ``null``."""
    item = (item or "").strip()
    return None if item in ("", "all", "null") else F.array_contains(csv_items(column), item)


def mask_email(column: Column) -> Column:
    """An address without what stands before its first at-sign."""
    at = F.coalesce(F.instr(column, "@"), F.lit(0))
    return F.when(at == 0, F.lit("***masked***")).otherwise(F.concat(F.lit("***@"), F.substring(column, at + 1, F.length(column))))


def mask_ip(column: Column) -> Column:
    return F.regexp_replace(column, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "***.***.***.***")


# What is a URL, a host's name, a host's tail that is kept, and an API key.
_URL = r"https?://[^\s/$.?#][^\s]+"
_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
_TAIL = r"(?:^|\.)([^.]{0,3}\.[^.]{2}|[^.]*)$"
_API_KEY = r"(['\"]?)api_key:([^\s'\"]+)(['\"]?)"


def mask_url(column: Column) -> Column:
    """URLs keep their scheme, the tail of their host (two labels where it looks like that of a country) and the shape of their path and the names of their query."""

    def one(url: Column) -> Column:
        scheme = F.regexp_extract(url, r"^https?://", 0)
        rest = F.substring(url, F.length(scheme) + 1, F.length(url))
        host, path, asked = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
        tail = F.regexp_extract(host, _TAIL, 1)
        shape = F.when(path == "/", path).otherwise(F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", "/"), r"[^/]+", "***"))
        query = F.array_join(F.transform(F.filter(F.split(asked, "&"), lambda p: p != ""), lambda p: F.concat(F.regexp_extract(p, r"^[^=]*", 0), F.lit("=***"))), "&")
        return F.concat(scheme, F.when(F.instr(host, ".") > 0, F.concat(F.lit("***."), tail)).otherwise(F.lit("***")), F.regexp_replace(shape, r"(?<=.)/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))

    return _each(column, _URL, one)


def mask_domain(column: Column) -> Column:
    """Names of hosts keep their tail, with three stars for each label before it."""

    def one(host: Column) -> Column:
        tail = F.regexp_extract(host, _TAIL, 1)
        stars = F.greatest(F.size(F.split(host, r"\.")) - F.size(F.split(tail, r"\.")), F.lit(1))
        return F.concat(F.repeat(F.lit("***."), stars), tail)

    return _each(column, _DOMAIN, one)


def _each(column: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of a pattern changed: what stands between matches and the matches take turns."""
    between, found = F.split(column, pattern), F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.zip_with(between, F.transform(found, change), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def mask_sensitive(column: Column) -> Column:
    """URLs, then names of hosts, then IP addresses and API keys masked."""
    return F.regexp_replace(mask_ip(mask_domain(mask_url(column))), _API_KEY, "$1api_key:***$3")


def prefixed(id: Column, name: Column, keyword: str) -> Column:
    """Whether a name begins with a keyword; a whole number also means the id."""
    test = F.startswith(name, F.lit(keyword))
    return test | (id == int(keyword)) if re.fullmatch(r"[+-]?\d+", keyword) else test


def spent(status: Column, expires: Column, now: Column, closed: tuple[int, ...], open_: int) -> Column:
    """Whether a code is used up: its status is one of ``closed``, or it is open and its time, if it has one, is over."""
    return status.isin(*closed) | ((status == open_) & (expires != 0) & (expires < now))


def status_ranges(text: str) -> list[tuple[int, int]]:
    """``400-404, 500`` as sorted ranges; overlapping and adjacent ones are joined."""
    found: list[tuple[int, int]] = []
    for item in filter(None, (x.replace(" ", "") for x in text.replace("，", ",").split(","))):
        m = re.fullmatch(r"(\d{3})(?:-(\d{3}))?", item)
        low, high = (int(m[1]), int(m[2] or m[1])) if m else (0, -1)
        if not (100 <= low <= high <= 599):
            raise ValueError(f"no status range: {item}")
        found.append((low, high))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def in_status_ranges(code: Column, text: str) -> Column:
    test = F.lit(False)
    for low, high in status_ranges(text):
        test = test | code.between(low, high)
    return F.coalesce(test, F.lit(False))


def add_months(start: Column, months: int) -> Column:
    """A date some months later where a day that the month lacks runs over into the next: 31 January + 1 = 3 March."""
    first = F.add_months(F.trunc(start, "month"), months)
    return F.date_add(first, F.dayofmonth(start) - 1)


def next_reset(at: Column, period: str, seconds: int = 0, end: Column | None = None) -> Column:
    """Next midnight, Monday or first of the month after a timestamp, or so many seconds later (custom); null for other periods and past the end."""
    units = {"daily": ("day", "1 day"), "weekly": ("week", "7 days"), "monthly": ("month", "1 month")}
    if period in units:
        unit = units[period]
        then = F.date_trunc(unit[0], at) + F.expr(f"INTERVAL {unit[1]}")
    elif period == "custom" and seconds > 0:
        then = at + F.make_dt_interval(secs=F.lit(seconds))
    else:
        return F.lit(None).cast("timestamp")
    return then if end is None else F.when(end.isNull() | (then <= end), then)


def plan_end(start: Column, unit: str, value: int) -> Column:
    """The end of a plan of some years, months, days, hours or seconds (custom). Days that a month lacks run over."""
    if value <= 0 or unit not in ("year", "month", "day", "hour", "custom"):
        raise ValueError(f"no such plan: {value} {unit}")
    if unit in ("year", "month"):
        day = add_months(F.to_date(start), value * (12 if unit == "year" else 1))
        return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.unix_timestamp(start) - F.unix_timestamp(F.date_trunc("day", start)))
    return F.timestamp_seconds(F.unix_timestamp(start) + value * {"day": 86_400, "hour": 3600, "custom": 1}[unit])


# Weights of the token estimate by family of models; the last is for all others.
ESTIMATE_WEIGHTS = {
    "gemini": dict(word=1.15, number=2.8, cjk=0.68, symbol=0.38, math=1.05, url=1.2, at=2.5, emoji=1.08, newline=1.15, space=0.2),
    "claude": dict(word=1.13, number=1.63, cjk=1.21, symbol=0.4, math=4.52, url=1.26, at=2.82, emoji=2.6, newline=0.89, space=0.39),
    "": dict(word=1.02, number=1.55, cjk=0.85, symbol=0.4, math=2.68, url=1.0, at=2.0, emoji=2.12, newline=0.5, space=0.42),
}
_KINDS = ("newline", "space", "cjk", "emoji", "word", "number", "math", "at", "url", "symbol")
# Signs of mathematics outside the blocks of operators.
_MATH = "±×÷¬°′″‴⁺⁻⁼⁽⁾₊₋₌₍₎"


def _kind(code: int) -> str:
    """The class of a character; the first that fits of space, CJK, emoji, letter, number, mathematics, at-sign, URL delimiter."""
    c = chr(code)
    if c in "\n\t":
        return "newline"
    if c.isspace() and not 0x1C <= code <= 0x1F:
        return "space"
    name = unicodedata.name(c, "")
    if name.startswith("CJK ") and unicodedata.category(c) in ("Lo", "So") and ("IDEOGRAPH" in name or "RADICAL" in name) or name.startswith("KANGXI RADICAL") or code in (0x3005, 0x3007) or 0x3021 <= code <= 0x3029 or 0x3038 <= code <= 0x303B or 0x3040 <= code <= 0x30FF or 0xAC00 <= code <= 0xD7A3:
        return "cjk"
    if 0x2600 <= code <= 0x27BF or 0x1F300 <= code <= 0x1F9FF or 0x1FA00 <= code <= 0x1FAFF:
        return "emoji"
    category = unicodedata.category(c)[0]
    if category in "LN":
        return "word" if category == "L" else "number"
    if c in _MATH or 0x2200 <= code <= 0x22FF or 0x2A00 <= code <= 0x2AFF or 0x1D400 <= code <= 0x1D7FF:
        return "math"
    return "at" if c == "@" else "url" if c in "/:?&=;#%" else "symbol"


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """The class of each character, by number; 255 where it isn't looked up yet."""
    return np.full(0x110000, 255, np.uint8)


def estimates(texts: list[str | None], family: str = "") -> np.ndarray:
    """The estimate of each text; 0 for null."""
    w = ESTIMATE_WEIGHTS[next((f for f in ESTIMATE_WEIGHTS if f and f in family.lower()), "")]
    table, size = _table(), np.array([len(t) if t else 0 for t in texts], np.int64)
    codes = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = table[codes]
    if (kinds == 255).any():
        for code in np.unique(codes[kinds == 255]).tolist():
            table[code] = _KINDS.index(_kind(code))
        kinds = table[codes]
    # letters and digits count once a run; a text's first character always begins one
    begins = np.ones(len(kinds), bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    ends = np.cumsum(size)
    begins[(ends - size)[size > 0]] = True
    runs = (kinds == _KINDS.index("word")) | (kinds == _KINDS.index("number"))
    hundredths = np.array([round(100 * w[k]) for k in _KINDS])  # the weights have two places, so sums are exact
    upto = np.concatenate([[0], np.cumsum(hundredths[kinds] * (begins | ~runs))])
    return -(-(upto[ends] - upto[ends - size]) // 100)


def estimate_tokens(text: Column, family: str = "") -> Column:
    """A quick estimate of tokens: weighted counts of runs of letters, runs of digits and single other characters, rounded up; 0 for null.

    Ten counts by regular expression read a text ten times; this reads it once, in Arrow batches
    of character codes.
    """

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(estimates(texts.tolist(), family), index=texts.index)

    return run(text)

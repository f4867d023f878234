"""Problem 1: credentials in source code and configuration, found with byte offsets and masked in place.

JSON, YAML and XML are parsed into full key paths, see ``formats``. What has the shape of an
assignment is read in every file, also in comments and inside strings: env, properties, INI, shell,
Python, JavaScript and Go share ``key = value``, ``key: value``, ``key := value`` with optional
quotes. Keys are tested by name, values by shape; further parsers know credentials that stand
without a key: the user part of a URL or DSN, paths of webhooks, authorization schemes, options of
command-line clients, arguments of connecting calls, tokens with a telling prefix and key blocks. A
value may stand on the lines below its key (also as a block scalar), among the items of a list, or
under a neutral name below a key that names a secret, by indentation, braces or section head.
Values that only refer to a secret or stand in for one are left. Masks are spliced into the original
between the delimiters of the value: a plain word, or 0 in place of a number, so that the file
stays valid and quotes, line ends and everything else are as they were.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlark.llm import formats

#: What stands in place of a credential.
MASK = "REDACTED"


class Hit(NamedTuple):
    start: int  # characters from the text's beginning
    end: int
    key: str  # key path, or what told the credential
    kind: str
    mask: str = MASK


#: Last words of keys that name a secret, and keys ending in "key" that don't.
SECRET_WORDS = frozenset("password passwd pwd pass pw passphrase passcode secret secrets token credential credentials auth apikey authtoken accesskey secretkey privatekey psk".split())
#: Words that name a secret also at the end of a longer word.
SECRET_ENDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "secretkey", "accesskey")
OPEN_KEYS = frozenset("public primary foreign sort partition cache group order row shard map index unique routing hot host id event".split())
#: Beginnings of keys issued by services, followed by at least 12 characters of key.
PREFIXES = r"(?:sk-(?:live-|test-|proj-)?|nxk-(?:live|test)-|pat_|gwk_|rly\.|GWAK|AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|rk_live_|pk_live_|AIza|npm_|hf_|SG\.|dop_v1_|shp(?:at|ss|ca)_|ya29\.)"

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ASSIGN = re.compile(r"""(?P<q>["'`]?)(?P<key>[A-Za-z_][\w.\-]*)(?P=q)\s*(?::=|=>|=(?!=)|:(?!//|:))[ \t]*""")
_STRING = re.compile(r"""\"\"\"(?P<t>.*?)\"\"\"|"(?P<d>(?:\\.|[^"\\\n])*)"|'(?P<s>(?:\\.|[^'\\\n])*)'|`(?P<b>[^`\n]*)`""")
#: Names that say nothing of their value; the key they stand below does.
NEUTRAL = frozenset("value val literal plain plaintext raw current previous".split())
_LEAF = re.compile(rf"(?i)\b(?:{'|'.join(sorted(NEUTRAL))})[\"'`]?\s*[:=]")
_LINE = re.compile(r"(?m)^(?P<i>[ \t]*)(?P<v>[^\n]*?)[ \t\r]*$")
_OPENS = re.compile(r"[ \t]*(?P<block>[|>][+\-\d]*)?[ \t]*(?:#[^\n]*)?\r?")
_TOKEN = re.compile(r"""(?P<open>\{)|(?P<close>\})|(?<![\w.\-$])(?P<q>["'`]?)(?P<key>[A-Za-z_][\w.\-]*)(?P=q)(?=\s*[:=])|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
_OWNER = re.compile(r"""(?P<q>["'`]?)(?P<key>[A-Za-z_][\w.\-]*)(?P=q)\s*(?::=|=>|[:=])\s*(?:[\w.&*\[\]]+\s*)?$""")
_PLUS = re.compile(r"\s*\+?\s*(?=[\"'`])")
_URL = re.compile(r"""[A-Za-z][\w+.\-]*://(?P<user>[^\s:/@"'`]*):(?P<p>[^\s"'`]+)@(?=[\w\[\]-])""")
_DSN = re.compile(r"""(?<![\w/:])[\w.\-]+:(?P<p>[^\s"'`]+)@(?:tcp|unix|udp)\(""")
_QUERY = re.compile(r"""[?&](?P<key>[A-Za-z_][\w\-]*)=(?P<p>[^\s&"'`#]+)""")
_SCHEME = re.compile(r"""\b(?P<scheme>Bearer|Basic|Token|bearer|basic)[ \t]+(?P<p>[^\s"'`,;)]+)(?=["'`]|[ \t\r]*$)""", re.M)
_CURL = re.compile(r"""\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?(?P<q>["']?)(?P<user>[^\s:"']+):(?P<p>[^\s"']+)""")
_OPTION = re.compile(r"""\bredis-cli\b[^\n]*?\s(?:-a|--pass)[ =](?P<q>["']?)(?P<p>[^\s"']+)|\b(?:mysql|mysqldump|mariadb|mysqladmin)\b[^\n]*?\s-p(?P<q2>["']?)(?P<p2>[^\s"']+)|\bsshpass\s+-p[ ]?(?P<q3>["']?)(?P<p3>[^\s"']+)|\s--(?:password|passwd|pass|token|api-key|secret)[ =](?P<q4>["']?)(?P<p4>[^\s"']+)|\b(?:docker|podman|helm|oc|az|heroku)\b[^\n]*?\blogin\b[^\n]*?\s-p[ ](?P<q5>["']?)(?P<p5>[^\s"']+)""")
_CALL = re.compile(r"""\b(?P<f>connect|open|login|dial|authenticate|basic_?auth|set_?basic_?auth|create_?client|sign_?in)\s*\((?P<args>[^\n]*)""", re.I)
_ISSUED = re.compile(rf"(?<![\w-])(?P<p>{PREFIXES}[A-Za-z0-9_\-]{{12,}})")
_JWT = re.compile(r"(?<![\w.-])(?P<p>eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOB = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/]{40,}={0,2}(?![\w+/=])")
_PAIR = re.compile(r"""(?P<q>["'])(?P<key>[A-Za-z_][\w.\-]*)(?P=q)\s*,\s*(?=["'`])""")
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(?P<p>[^\s\"'`]+)")
_HOOK = re.compile(r"""https?://(?=[^\s"'`]*(?:hook|services/))[^\s"'`?]+/(?P<p>[A-Za-z0-9_\-]{16,})(?=["'`\s]|$)""")
_QUOTE = re.compile(r"""\\.|(?<![A-Za-z0-9])["'`]|["'`]""", re.S)
_NAMED = re.compile(r"(?mi)\bname[\"']?\s*:\s*[\"']?([\w.\-]+)[\"']?,?\s*\n?\s*[\"']?value[\"']?\s*:\s*")
_REFERENCE = re.compile(
    r"""^(?:
        \$\{.*|\$\(.*|\$[A-Za-z_]\w*|%[A-Z_][A-Z0-9_]*%|\{\{.*|\{[A-Za-z_.]\w*\}|<[A-Za-z][\w .:\-]*>|\[[A-Za-z][\w .\-]*\]|@[A-Z_][A-Z0-9_]*@|__\w+__
        |(?:vault|aws|gcp|ssm|secretsmanager|keyring|sops|op|env|file|azurekv|secret|secrets|ref)(?:\+\w+)?:.*|ENC\[.*|!(?:vault|secret|env|ref|reference|sub|encrypted)\b.*
        |/(?:run|var|etc|mnt|opt|home|secrets?|vault)/\S*|\./\S*|~/\S*
        |(?:os\.environ|os\.getenv|process\.env|getenv|env|config|settings|secrets?|viper|cfg|self|this|ctx|System\.getenv)[.\[(].*
    )$""",
    re.X | re.S,
)
#: Words that stand where a value is missing. Readable values in general are credentials.
_STAND_IN = frozenset("redacted masked hidden removed omitted changeme change-me change_me placeholder example todo tbd none null nil undefined true false yes no on off empty n/a na secret-here unset string".split())


def words(key: str) -> list[str]:
    """Lower-case words of a key: of snake, kebab, dotted and camel case."""
    return [w.lower() for w in _WORDS.findall(key)]


def sensitive(key: str) -> bool:
    """Whether the last part of a key path names a secret itself, not its name, place, size or public half."""
    w = words(key.rsplit(".", 1)[-1])
    if not w:
        return False
    last = w[-1] if not w[-1].isdigit() or len(w) < 2 else w[-2]
    if last in SECRET_WORDS or last.endswith(SECRET_ENDS):
        return True
    return last == "key" and (len(w) == 1 or w[-2] not in OPEN_KEYS)


def stand_in(value: str) -> bool:
    """Whether a value only refers to a secret, or stands where one is missing."""
    v = value.strip()
    if len(v) < 4 or _REFERENCE.match(v):
        return True
    low = v.lower().strip("-_.*<>[](){}\"' ")
    if not low or all(w in _STAND_IN for w in low.split()) or low in _STAND_IN or re.fullmatch(r"(?:your|my|insert|enter|put|the)[-_ ].*(?:here|key|token|secret|password)", low):
        return True
    core = re.sub(rf"^{PREFIXES}", "", v)
    return not core or len(set(core.lower().strip("-_"))) <= 1 or bool(re.fullmatch(r"[xX*•.#_\-]+", core)) or "..." in v or "***" in v


def _decoded(blob: str) -> str:
    try:
        return base64.b64decode(blob + "=" * (-len(blob) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return ""


def _strings(text: str, at: int) -> list[tuple[int, int, str]]:
    """The string literal at ``at`` and those joined to it: (start, end, value) of each between its quotes."""
    out, stop = [], at
    while m := _STRING.match(text, stop):
        which = m.lastgroup or "d"
        out.append((m.start(which), m.end(which), m[which]))
        joined = _PLUS.match(text, m.end())
        if not joined:
            break
        stop = joined.end()
    return out


#: Whatever tells a credential has one of these on its line, in lower case.
_CUES = (
    "psk", "aiza", "npm_", "hf_", "sg.", "dop_v1_", "shp", "ya29", "pass", "pwd", "pw", "secret", "token", "cred", "auth", "key", "://", "@tcp(", "@unix(", "@udp(", "bearer", "basic", "curl", "redis-cli", "mysql", "mariadb",
    "connect", "open", "login", "dial", "client", "sign", "eyj", "sk-", "nxk-", "pat_", "gwk_", "rly.", "gwak", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "k_live_",
)


_FOLLOWS = re.compile(r"\s*[^\n]*")


def _segments(text: str) -> list[tuple[int, int]]:
    """The lines that hold a cue, as spans in order.

    Every pattern begins on a line with a cue: the words that name a secret, and what else tells a
    credential, each hold one.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters have two in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lines: dict[int, int] = {}
    for cue in _CUES:
        at = low.find(cue)
        while at >= 0:
            end = low.find("\n", at)
            end = len(low) if end < 0 else end
            lines[low.rfind("\n", 0, at) + 1] = end
            at = low.find(cue, end)
    return sorted(lines.items())


#: What a match of a pattern holds in any case, one of them; patterns without an entry are tried everywhere.
_HOLDS = {
    _URL: ("://",), _HOOK: ("://",), _DSN: ("@tcp(", "@unix(", "@udp("), _QUERY: ("?", "&"), _SCHEME: ("Bearer", "Basic", "Token", "bearer", "basic"), _CURL: ("curl",), _NETRC: ("login",), _JWT: ("eyJ",),
    _OPTION: ("redis-cli", "mysql", "mariadb", "sshpass", "--", "login"), _PAIR: (",",), _CALL: ("(",),
}
#: Patterns whose match may go on to the next line.
_ON = {_ASSIGN, _PAIR, _NETRC, _CURL, _OPTION, _CALL}


def _every(pattern: re.Pattern, text: str, spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches that begin within the spans, as in a scan of the whole text; they may go on to the next line with something on it."""
    if pattern in _HOLDS and not any(x in text for x in _HOLDS[pattern]):
        return
    done, on = 0, pattern in _ON
    for a, b in spans:
        for m in pattern.finditer(text, max(a, done), _FOLLOWS.match(text, b).end() if on else b):
            if m.start() >= b:
                break
            done = m.end()
            yield m


def _inside(text: str, at: int) -> str:
    """The quote of the string that a place of a line is inside of, or blank."""
    quote = ""
    for m in _QUOTE.finditer(text, text.rfind("\n", 0, at) + 1, at):
        if m[0] == quote:
            quote = ""
        elif not quote and len(m[0]) == 1 and (m.start() == 0 or not text[m.start() - 1].isalnum()):
            quote = m[0]
    return quote


def _below(text: str, m: re.Match) -> tuple[int, int, bool] | None:
    """Where the value of an assignment stands that has none on its line: (start, end, whether it is a block scalar)."""
    stop = text.find("\n", m.end())
    if stop < 0 or not (head := _OPENS.fullmatch(text, m.end(), stop)):
        return None
    margin = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
    if margin.strip(" \t-"):
        return None
    first = last = -1
    for line in _LINE.finditer(text, stop + 1):
        if not line["v"]:
            continue
        if len(line["i"]) <= len(margin):
            break
        first, last = line.start("v") if first < 0 else first, line.end("v")
        if not head["block"]:
            break
    if first < 0 or head["block"]:
        return (first, last, True) if first >= 0 else None
    first += 2 * text.startswith("- ", first)
    return None if _ASSIGN.match(text, first) else (first, last, False)


def _neutral(text: str) -> Iterator[tuple[re.Match, str]]:
    """Assignments to a neutral name below a key that names a secret, with their key paths.

    What is below a key is told by indentation, braces and section heads; the nearest key that isn't neutral counts.
    """
    if not _LEAF.search(text):
        return
    section, indented, braces, at = "", [], [], 0
    for line in _LINE.finditer(text):
        body, depth = line["v"], len(line["i"])
        while body.startswith("- "):
            body, depth = body[2:].lstrip(), depth + 2
        if head := re.fullmatch(r"\[+([\w.\-: \"']+)\]+", body):
            section, indented = head[1].strip("\"' "), []
        if body and not braces:
            while indented and indented[-1][0] >= depth:
                indented.pop()
        here = line.start("v")
        for token in _TOKEN.finditer(text, here, line.end("v")):
            if token["open"]:
                named = _OWNER.search(text, max(at, token.start() - 2000), token.start())
                braces.append(named["key"] if named else "")
            elif token["close"]:
                if braces:
                    braces.pop()
            elif token["key"] and token["key"].lower() in NEUTRAL and (m := _ASSIGN.match(text, token.start())):
                path = [k for k in (section, *(k for _, k in indented), *braces) if k]
                owner = next((k for k in reversed(path) if k.rsplit(".", 1)[-1].lower() not in NEUTRAL), "")
                if sensitive(owner) or owner.endswith("s") and sensitive(owner[:-1]):
                    yield m, ".".join([*path, m["key"]])
        if not braces and (key := re.fullmatch(r"""["']?([A-Za-z_][\w.\-]*)["']?\s*:\s*(?:#.*)?""", body)):
            indented.append((depth, key[1]))


def _from_formats(text: str, kind: str) -> Iterator[Hit]:
    """Credentials among the values of a file in a format with key paths."""
    for e in formats.entries(text, kind):
        names = [n for n in e.path if not n.isdigit()]
        owner = next((n for n in reversed(names) if n.rsplit(".", 1)[-1].lower() not in NEUTRAL), "")
        listed = bool(e.path) and e.path[-1].isdigit()
        if not sensitive(owner) and not (owner.lower().endswith("s") and (listed or names[-1] != owner) and sensitive(owner[:-1])):
            continue
        direct = e.path[-1] == owner or e.style == "text"
        sure = direct and words(owner)[-1] not in ("key", "auth")
        if e.style == "block" and _ASSIGN.search(e.value) or "-----BEGIN" in e.value or stand_in(e.value):
            continue
        if e.style == "number" and not (sure and len(e.value) > 3) or e.style == "plain" and _REFERENCE.match(e.value):
            continue
        if _secretive(e.value) or sure:
            yield Hit(e.start, e.end, ".".join(e.path), "assigned", "0" if e.style == "number" else MASK)


def find(text: str, spans: list[tuple[int, int]] | None = None) -> list[Hit]:
    """Literal credentials of a file, in order, not overlapping. ``spans``: where patterns may begin, by default the lines with a cue."""
    spans = _segments(text) if spans is None else spans
    if not spans and "-----BEGIN" not in text and not _BLOB.search(text) and "value" not in text.lower():
        return []
    kind = formats.kind(text) if spans else ""
    hits: list[Hit] = list(_from_formats(text, kind))
    markup = formats.tags(text) if kind == "xml" else []
    every = lambda pattern: _every(pattern, text, spans)
    add = lambda s, e, key, kind: hits.append(Hit(s, e, key, kind, "0" if text[s:e].isdigit() and text[s - 1 : s] not in ('"', "'", "`") and kind == "assigned" else MASK)) if e > s else None
    blocks = []
    for m in _BLOCK.finditer(text):
        if blocks and m.start() < blocks[-1][1]:
            continue
        close = text.find("-----END", m.end())
        following = text.find("-----BEGIN", m.end())
        if close < 0 or 0 <= following < close:
            close = following if following >= 0 else len(text)
            end = close
        else:
            dashes = text.find("-----", close + 8)
            end = dashes + 5 if dashes >= 0 else len(text)
        body = re.sub(r"\\[nrt]|[\s\"'#;/+*]", "", text[m.end() : close])
        if len(body) >= 16 and not stand_in(body):
            blocks.append((m.start(), end))
            add(m.start(), end, "private key", "key_block")
    hidden = lambda a: any(s <= a < e for s, e in blocks)

    def assigned(m: re.Match, at: int, key: str, sure: bool) -> None:
        """Adds the literal at ``at``; ``sure``: whatever its shape."""
        parts = _strings(text, at)
        if parts:
            value = "".join(p[2] for p in parts)
            if _BLOCK.search(value) or "-----BEGIN" in value:
                return
            if not stand_in(value) and (_secretive(value) or sure):
                for s, e, _ in parts:
                    add(s, e, key, "assigned")
            return
        stop = text.find("\n", at)
        raw = text[at : stop if stop >= 0 else len(text)].rstrip("\r")
        around = _inside(text, m.start())
        if around:  # what is assigned inside of a string ends with it or with its part
            value = re.split(rf"[{around};&]", raw, maxsplit=1)[0].rstrip("\\").rstrip()
        else:
            value = re.sub(r"\s+[#;].*$|\s+//.*$", "", raw).rstrip()
        if value.endswith((";", ",")):
            value = value[:-1]
        if " " in value and m[0] == m["key"] + "=" and key.isupper() and _secretive(value.split(" ")[0]):
            value = value.split(" ")[0]  # a variable set for one command
        marked = "\"'`{[(" if "=" in m[0] else "\"'`{[(&|>"
        if value and value[0] not in marked and " " not in value and not re.search(r"^[A-Za-z_][\w.]*[(\[]", value) and not stand_in(value) and (_secretive(value) or sure) and not _expression(text, m, value):
            add(at, at + len(value), key, "assigned")

    def placed(m: re.Match, key: str, sure: bool) -> None:
        """Adds the value of an assignment, on its line or below."""
        below = _below(text, m)
        if below is None:
            assigned(m, m.end(), key, sure)
        elif hidden(below[0]):
            return
        elif below[2]:
            value = text[below[0] : below[1]]
            if not _ASSIGN.search(value) and not stand_in(value) and (_secretive(value) or sure):
                add(*below[:2], key, "assigned")
        else:
            assigned(m, below[0], key, sure)

    for m in every(_ASSIGN):
        key, at = m["key"], m.end()
        if not sensitive(key) or hidden(at) or any(a <= m.start() < b for a, b in markup) and not _inside(text, m.start()):
            continue
        placed(m, key, words(key)[-1] not in ("key", "auth"))
    for m, path in _neutral(text):
        if not hidden(m.end()):
            placed(m, path, False)
    for m in _NAMED.finditer(text) if "value" in text.lower() else ():
        if sensitive(m[1]):
            parts = _strings(text, m.end())
            if not parts:
                v = re.match(r"[^\s,}#]+", text[m.end() :])
                parts = [(m.end(), m.end() + v.end(), v[0])] if v else []
            if parts and not stand_in("".join(p[2] for p in parts)):
                for s, e, _ in parts:
                    add(s, e, m[1], "assigned")
    for m in every(_PAIR):
        parts = _strings(text, m.end())
        value = "".join(x[2] for x in parts)
        if sensitive(m["key"]) and _secretive(value) and not stand_in(value) and not sensitive(value) and not re.fullmatch(r"[A-Za-z_][A-Za-z_.]*", value):
            for s, e, _ in parts:
                add(s, e, m["key"], "assigned")
    for m in every(_HOOK):
        if re.search(r"[a-z]", m["p"]) and re.search(r"[A-Z]", m["p"]) and re.search(r"\d", m["p"]):
            add(*m.span("p"), "hook", "url")
    for pattern, kind in ((_URL, "url"), (_DSN, "dsn"), (_CURL, "option"), (_NETRC, "option")):
        for m in every(pattern):
            if not hidden(m.start()) and not stand_in(m["p"]):
                add(*m.span("p"), kind, kind)
    for m in every(_QUERY):
        if sensitive(m["key"]) and not stand_in(m["p"]):
            add(*m.span("p"), m["key"], "url")
    for m in every(_SCHEME):
        p = m["p"]
        if m["scheme"].lower() == "basic":
            user, colon, password = _decoded(p).partition(":")
            if colon and not stand_in(password):
                add(*m.span("p"), "basic", "scheme")
        elif not stand_in(p) and (re.search(r"[\d!-/:-@\[-`{-~A-Z]", p) or text[m.end() : m.end() + 1] in ("'", '"', "`")) and not re.fullmatch(r"[A-Z]?[a-z]+[.:]?", p):
            add(*m.span("p"), m["scheme"], "scheme")
    for m in every(_OPTION):
        for g in ("p", "p2", "p3", "p4", "p5"):
            if m[g] and not stand_in(m[g]):
                add(*m.span(g), "option", "option")
    for m in every(_CALL):
        base = m.start("args")
        literals = [(x.start(x.lastgroup or "d"), x.end(x.lastgroup or "d"), x[x.lastgroup or "d"], x.start()) for x in _STRING.finditer(m["args"])]
        # positional literals only: host, user, password or user, password
        plain = [x for x in literals if re.search(r"[(,]\s*$", "(" + m["args"][: x[3]])]
        if len(plain) >= 2:
            s, e, value, _ = plain[min(len(plain), 3) - 1]
            user = plain[min(len(plain), 3) - 2][2]
            if re.fullmatch(r"[\w.\-]{2,}", user) and not re.search(r"\.\w{1,4}$|/", user) and _secretive(value) and not stand_in(value) and "://" not in value and "@" not in value:
                add(base + s, base + e, m["f"], "argument")
    for pattern in (_ISSUED, _JWT):
        for m in every(pattern):
            if not hidden(m.start()) and not stand_in(m["p"]):
                add(*m.span("p"), "token", "token")
    for m in _BLOB.finditer(text):
        if hidden(m.start()):
            continue
        inner = _decoded(m[0])
        if inner and inner.isprintable() | ("\n" in inner) and (_BLOCK.search(inner) or _ISSUED.search(inner) or _JWT.search(inner) or _URL.search(inner) or _DSN.search(inner)):
            add(*m.span(), "encoded", "encoded")
    out: list[Hit] = []
    for h in sorted(hits, key=lambda h: (h.start, -h.end)):
        if not out or h.start >= out[-1].end:
            out.append(h)
        elif h.end > out[-1].end:
            out[-1] = out[-1]._replace(end=h.end)
    return out


def _secretive(value: str) -> bool:
    """Whether a string could be a password or key by its shape: of some length, not one plain word, number or host."""
    return len(value) >= 6 and not re.fullmatch(r"[a-z]+|[A-Z]+|[a-z]+[-_ ][a-z_\- ]+|[\w-]+(?:\.[\w-]+)*\.(?:example|com|net|org|io|local|internal)(?::\d+)?", value)


def _expression(text: str, m: re.Match, value: str) -> bool:
    """Whether an unquoted value is code: a name, call or number in a language with quoted strings."""
    line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
    code = ":=" in m[0] or re.search(r"\b(?:const|let|var|return|if|def|func|for)\b", line) is not None
    if code and not re.search(r"^\s*(?:#|//|;|--)", line):
        return True
    return bool(re.fullmatch(r"(?:os|process|self|this|config|settings|cfg|req|res|ctx|args|opts)(?:\.\w+)+\S*|\d{1,3}|[\[{(].*", value))


def mask(text: str) -> str:
    """The file with its credentials masked, everything else as it was: same lines, same delimiters.

    A key block keeps its first and last line, its inner characters but line ends become ``*``.
    """
    out, at = [], 0
    for h in find(text):
        out.append(text[at : h.start])
        if h.kind == "key_block":
            block = text[h.start : h.end]
            a, b = block.find("-----", 5) + 5, block.rfind("-----END")
            b = b if b > a else len(block)
            out.append(block[:a] + re.sub(r"\\[nrt]|[A-Za-z0-9+/=]", lambda c: c[0] if c[0][0] == "\\" else "*", block[a:b]) + block[b:])
        else:  # a block scalar keeps its lines
            out.append(re.sub(r"\S(?:[^\n]*\S)?", h.mask, text[h.start : h.end]) if "\n" in text[h.start : h.end] else h.mask)
        at = h.end
    return "".join([*out, text[at:]])


def _lines(text: str, hits: list[Hit]) -> list[int]:
    """Line of each hit, from 1; lines end at a line feed."""
    out, line, at = [], 1, 0
    for h in hits:
        line, at = line + text.count("\n", at, h.start), h.start
        out.append(line)
    return out


def credentials(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, from_byte, to_byte, key_path, kind): each credential of each file.

    Lines count from 1 and end at a line feed; bytes count in UTF-8 from 0. Null and empty files
    give no rows, repeated files give their own rows, very long ones are read whole; an empty
    table gives an empty table; other columns of ``df`` don't matter. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                hits = find(t)
                at = byte = 0
                for h, line in zip(hits, _lines(t, hits)):
                    start = byte + len(t[at : h.start].encode())
                    at, byte = h.end, start + len(t[h.start : h.end].encode())
                    place.append(i)
                    rows.append((line, start, byte, h.key, h.kind))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["k", "line_no", "from_byte", "to_byte", "key_path", "kind"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.length("t") > 0)
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, line_no int, from_byte long, to_byte long, key_path string, kind string").withColumnRenamed("k", key)


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every file with its credentials masked; null and empty files come out as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mask(t) if t else t for t in batch.column(1).to_pylist()], pa.string())], ["k", "t"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, t string").select(F.col("k").alias(key), F.col("t").alias(text))

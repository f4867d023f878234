"""Problem 3: personal details inside free text, found by anchor expansion and replaced by typed placeholders.

An Aho-Corasick automaton over all cues (at-signs, schemes, words before numbers, street words,
words before and behind names, frequent first names) finds anchors in one pass over a text; groups
of digits are anchors too. From each anchor a deterministic local parser expands to the boundaries
of an address, number or name, as far as its parts go, and validates it. Nothing else of a text is
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "phone", "id_number", "address", "person")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


#: Cues by the parser they call. Lower case; matched anywhere, the parsers check what stands around.
CUES = {
    "email": ["@", "＠", "(at)", "[at]", "{at}", "(a)", " at "],
    "id": [
        "ssn", "social security", "national id", "national insurance", "nino", "id no", "id number", "id card", "identity card", "identity no", "tax id", "tax no", "tin ", "vat id", "steuer-id", "steuernummer", "personalausweis", "ausweis", "passport", "reisepass",
        "passeport", "pasaporte", "driving licence", "driving license", "driver's licen", "driver licen", "licence no", "license no", "führerschein", "permis de conduire", "dni", "nie ", "nif", "numéro fiscal", "numéro de sécurité sociale", "insee", "身份证", "护照", "驾照", "税号", "パスポート", "マイナンバー", "運転免許", "旅券", "証件", "证件",
    ],
    "box": ["po box", "p.o. box", "p. o. box", "postfach", "apartado", "boîte postale", "bp "],
    "street": [" street", " st.", " st ", " road", " rd", " avenue", " ave", " lane", " ln", " drive", " boulevard", " blvd", " court", " way", " square", " terrace", " place", " close", " crescent", " row", " parkway", " highway", " hwy", " gardens", " grove", " mews", " hill", " walk"],
    "rue": ["rue ", "avenue ", "boulevard ", "impasse ", "chemin ", "allée ", "quai ", "calle ", "avenida ", "plaza ", "paseo ", "carrer ", "via "],
    "strasse": ["straße", "strasse", "str.", "weg ", "gasse ", "platz ", "allee ", "ufer ", "damm ", "ring ", "straat ", "laan ", "gracht "],
    "markt": ["am ", "an der ", "im ", "zum ", "zur ", "ul. ", "al. ", "pl. "],
    "cjk_address": ["丁目", "番地", "号室", "路", "街道"],
    "name_after": [
        "contact:", "contact person", "contact is", "cc ", "cc: ", "attn", "attention:", "regards,", "regards", "sincerely,", "cheers,", "best,", "yours,", "thanks,\n", "thank you,\n", "-- \n", "--\n", "ask for ", "spoke to ", "spoke with ", "talked to ", "talk to ", "came from ", "name is ", "name: ", "i am ", "this is ", "signed by ", "assigned to ",
        "pregunte por ", "me llamo ", "nombre: ", "saludos,", "ansprechpartner ist ", "ansprechpartnerin ist ", "ansprechpartner: ", "mein name ist ", "ich heiße ", "grüßen", "gruß", "prévenir ", "demandez ", "je m'appelle ", "cordialement,", "联系人", "姓名", "担当は", "担当者", "氏名",
    ],
    "title": ["mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "miss ", "dr ", "dr. ", "prof ", "prof. ", "herr ", "frau ", "m. ", "mme ", "madame ", "monsieur ", "señor ", "señora ", "sr. ", "sra. ", "don ", "doña "],
    "name_before": [" from our side", " from our team", " on every reply", " owns the account", " is my name", "さん", "様", "先生", "女士"],
}
#: Frequent first names of several languages: with a surname behind it, one is enough to tell a person.
FIRST_NAMES = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Andrew Kenneth Kevin Brian Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Emma Olivia Sophia Hannah Rachel Laura Anna Alice
Maria Marie Julia Lena Katrin Sabine Ursula Monika Petra Claudia Stefan Andreas Markus Jonas Lukas Felix Klaus Jürgen Wolfgang Hans Peter Pierre Jean Luc Michel Philippe Nicolas Camille Chloé Juan José Carlos Luis Antonio Manuel Javier Miguel Carmen Ana Lucía Sofía Isabel Giulia Marco Luca
Francesco Alessandro Paolo Giovanni Elena Chiara Omar Ahmed Ali Mohammed Fatima Aisha Noor Hassan Ibrahim Priya Raj Anil Ravi Sanjay Deepa Arjun Yuki Hiroshi Kenji Tomasz Piotr Katarzyna Ivan Olga Dmitri Natasha Sven Lars Ingrid Erik""".split()  # fmt: skip

_AT = re.compile(r"@|＠|\s*[\[({]\s*at?\s*[\])}]\s*| at ", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'\-]*[A-Za-z0-9_+\-])?$")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\.)[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+", re.I)
_HOST_SPOKEN = re.compile(r"[A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+|[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", re.I)

_B, _E = r"(?<![A-Za-z0-9_./#:\-])", r"(?![A-Za-z0-9_]|[./:\-]\d)"
#: A group of digits and what may stand between them; the places around it that a number's letters may take.
_DIGITS = re.compile(r"[+(]{0,2}\d(?:[\d .\-()/+]|[AB](?=[ \d]))*")
_ROOM = 6
_PHONES = [
    re.compile(p)
    for p in (
        rf"(?<![A-Za-z0-9_./#\-])\+\d{{1,3}}(?:[ .\-]?\(?\d{{1,6}}\)?){{1,6}}{_E}",  # international
        rf"{_B}(?:1[ .\-])?\(\d{{3}}\)[ .\-]?\d{{3}}[ .\-]\d{{4}}{_E}",
        rf"{_B}1[ .\-]\d{{3}}[ .\-]\d{{3}}[ .\-]\d{{4}}{_E}",
        rf"{_B}\d{{3}}([.\-])\d{{3}}\1\d{{4}}{_E}",
        rf"{_B}0\d{{1,4}}(?:[ \-/.]\d{{2,8}}){{1,5}}{_E}",  # national, with its trunk 0
        rf"{_B}0\d{{8,11}}{_E}",
        rf"{_B}1[3-9]\d{{9}}{_E}",  # mobile numbers of eleven digits
    )
]
_PHONE_CUE = re.compile(r"(?i)(?:phone|tel|telefon|mobile|cell|fax|call|ring|number|numéro|número|nummer|rufen|appel|llam|电话|電話|手机|携帯)[^\d\n]{0,12}$")
_PLAIN_PHONE = re.compile(rf"{_B}\d{{3}}[ .\-]?\d{{3,4}}[ .\-]?\d{{4}}{_E}")

_ID_SHAPES = [
    re.compile(rf"{_B}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}"),  # national insurance
    re.compile(rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}"),  # social security
    re.compile(rf"{_B}\d{{6}}(?:19|20)\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{{3}}[\dXx]{_E}"),  # resident identity
    re.compile(rf"{_B}\d{{8}}-?[A-HJ-NP-TV-Z]{_E}"),  # DNI
    re.compile(rf"{_B}[12] ?\d{{2}} ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{{3}} ?\d{{3}}(?: ?\d{{2}}){_E}"),  # INSEE
]
#: Behind a cue: a number of at least six characters, of digits and capitals, in groups.
_ID_AFTER = re.compile(r"(?:\s*(?:no\.?|nr\.?|number|num\.?|nº|n°|#|is|ist|est|es|:|：|=|は|为|是|番号|号码|号))*\s*(?P<v>(?=[A-Z0-9 .\-/]*\d)[A-Z0-9](?:[A-Z0-9]|[ .\-/](?=[A-Z0-9]*\d)){4,24}[A-Z0-9])(?![a-z0-9])", re.I)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*"
_STREET_WORD = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Square|Terrace|Place|Close|Crescent|Row|Parkway|Highway|Hwy|Gardens|Grove|Mews|Hill|Walk)"
_STREET = re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite)\s+\w+,?\s+)?\b\d{{1,5}}[a-zA-Z]?(?:[-–/]\d+)?,?\s+(?:{_CAP}[ \-]){{1,4}}{_STREET_WORD}(?![a-z])(?:,?\s+(?:Apt|Flat|Unit|Suite|Floor)\.?\s*\w+)?(?:[,\n]\s*(?:\d{{4,6}}\s+)?{_CAP}(?: {_CAP})?(?:\s+\d{{4,6}}|\s+[A-Z]{{1,2}}\d\w?\s*\d[A-Z]{{2}})?)?")
_BOX = re.compile(rf"(?i:P\.?\s?O\.?\s?Box|Postfach|Apartado(?: de correos)?|Boîte postale|BP)\s+(?:\d+[\d ]*)(?:,\s*(?:\d{{4,6}}\s+)?{_CAP}(?: {_CAP})*(?:\s+\d{{4,6}})?)?")
_RUE = re.compile(rf"(?:\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-c]))?,?\s+)(?i:rue|avenue|boulevard|impasse|chemin|allée|quai)\s+(?:d[eu]s?\s+|de la\s+|de l'|d')?{_CAP}(?:[ \-]{_CAP})*(?:,\s*\d{{4,6}}\s+{_CAP}(?: {_CAP})*)?|(?i:calle|avenida|plaza|paseo|carrer|via)\s+(?:de\s+(?:l[ao]s?\s+)?|del\s+)?{_CAP}(?: {_CAP})*,?\s+(?:n\.?º?\s*)?\d{{1,4}}(?:,\s*\d{{4,6}}\s+{_CAP}(?: {_CAP})*)?")
_STRASSE = re.compile(rf"[A-ZÄÖÜ][\w\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|straat|laan|gracht)\s+\d{{1,4}}\s?[a-z]?(?![\w%])(?:,?\s+(?:\d{{4,6}}\s+)?{_CAP}(?: {_CAP})?)?|[A-ZÄÖÜ][\w\-]+\s+(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring)\s+\d{{1,4}}\s?[a-z]?(?![\w%])(?:,?\s+\d{{4,6}}\s+{_CAP}(?: {_CAP})?)?")
_MARKT = re.compile(rf"\b(?:Am|An der|Im|Zum|Zur)\s+(?:{_CAP}\s+){{1,3}}\d{{1,4}}\s?[a-z]?,\s*\d{{5}}\s+{_CAP}|\b(?i:ul|al|pl)\.\s+(?:[^\W\d_]\w*\s+){{1,3}}\d{{1,4}}\w?(?:/\d+)?(?:,\s*\d{{2}}-\d{{3}}\s+[^\W\d_]\w*)?")
_CJK_ADDRESS = re.compile(r"[一-鿿]{2,}(?:市|区|県|省|都|府)[一-鿿ぁ-ヿ0-9０-９\-－]*?(?:\d+|[０-９]+)(?:号|番地|番|丁目)")

_PART = r"[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|\.)"
_SURNAME = rf"(?:(?:van|von|de|der|den|del|della|di|da|la|le|bin|al|O['’])[ ]?)?{_PART}(?:['’\-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|M|Mme|Sr|Sra|Herr|Frau|Madame|Monsieur|Señora?|Don|Doña)\.?[ ])"
_NAME = re.compile(rf"(?:{_TITLE}+{_SURNAME}(?:[ ]{_SURNAME})?|{_SURNAME},[ ]{_PART}|{_PART}[ ](?:[A-Z]\.[ ])?{_SURNAME}(?:[ ]{_SURNAME}(?=[.,;!?\n]|$| when| about| on | from| en ))?|{_PART})")
_CJK_NAME = re.compile(r"(?:\s*(?:是|为|は|：|:)\s*)?(?P<v>[一-鿿]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+)+)")
#: Words that are no part of a person's name though written with a capital: roles, weekdays, kinds of places and things.
_NO_NAME = frozenset(
    "the a an our your their this that these those it we i you he she they and or but if when what why how team support desk service customer customers agent user users system admin administrator gateway server model models channel cloud lite pro mini group account ticket order billing sales office company department north south east west street road lane avenue monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december all everyone anyone someone engineering operations platform status board http https api".split()
)


class Finder:
    def __init__(self) -> None:
        import ahocorasick

        self.cues = ahocorasick.Automaton()
        for parser, words in CUES.items():
            for w in words:
                self.cues.add_word(w, (parser, len(w)))
        for name in FIRST_NAMES:
            self.cues.add_word(name.lower() + " ", ("first_name", len(name) + 1))
        self.cues.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """Personal details of a text, in order, not overlapping."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int, int, str]] = []  # rank of the kind where spans overlap

        def take(rank: int, start: int, end: int, kind: str) -> None:
            found.append((rank, start, end, kind))

        for last, (parser, size) in self.cues.iter(low):
            end, start = last + 1, last + 1 - size
            if parser == "email":
                s = _email(text, start, end)
                if s:
                    take(0, *s, "email")
            elif parser == "id":
                if (start == 0 or not low[start - 1].isascii() or not low[start - 1].isalnum()) and (m := _ID_AFTER.match(text, end)) and _is_id(m["v"]):
                    take(1, m.start("v"), m.start("v") + len(m["v"].rstrip(" .-/")), "id_number")
            elif parser in _STREETS:
                for m in _STREETS[parser].finditer(text, *_around(text, start, end)):
                    take(2, *m.span(), "address")
            elif parser == "cjk_address":
                a, b = start, end
                while a > 0 and _CJK_PART(text[a - 1]):
                    a -= 1
                while b < len(text) and _CJK_PART(text[b]):
                    b += 1
                for m in _CJK_ADDRESS.finditer(text, a, b):
                    take(2, *m.span(), "address")
            elif parser == "first_name":
                if (start == 0 or not low[start - 1].isalnum()) and text[start].isupper() and (m := _NAME.match(text, start)) and m.end() > end and _is_name(m[0]) and not _STREET_END.match(text, m.end()):
                    take(4, *m.span(), "person")
            elif parser == "name_after":
                if start == 0 or not low[start].isascii() or not (low[start - 1].isalnum() and low[start - 1].isascii()):
                    s = _name_at(text, end, low[start:end])
                    if s:
                        take(4, *s, "person")
            elif parser == "title":
                if start == 0 or not low[start - 1].isalnum():
                    m = _NAME.match(text, start if text[start].isupper() else end)
                    if m and m.end() > end and _is_name(m[0]) and (text[start].isupper() or size > 5):  # short titles have a capital
                        take(4, *m.span(), "person")
            elif parser == "name_before":
                s = _name_before(text, start)
                if s:
                    take(4, *s, "person")
        for group in _DIGITS.finditer(text):
            if sum(map(str.isdigit, group[0])) < 6:
                continue
            room = max(0, group.start() - _ROOM), min(len(text), group.end() + _ROOM)
            for pattern in _ID_SHAPES:
                for m in pattern.finditer(text, *room):
                    if not re.search(r"(?i)(?:order|invoice|ticket|trace|batch|inv|ref|rma|bestellung|commande|pedido|request)[\s#:.\-]*$", text[max(0, m.start() - 14) : m.start()]):
                        take(1, *m.span(), "id_number")
            for k, pattern in enumerate(_PHONES):
                for m in pattern.finditer(text, *room):
                    if _is_phone(m[0]) and not re.search(r"(?i)(?:order|invoice|ticket|trace|batch|inv|ref|id|no|rma|bestellung|commande|pedido|request)[\s#:.\-]{0,3}$", text[max(0, m.start() - 14) : m.start()]):
                        take(3, *m.span(), "phone")
            for m in _PLAIN_PHONE.finditer(text, *room):
                if _PHONE_CUE.search(text[max(0, m.start() - 30) : m.start()]):
                    take(3, *m.span(), "phone")
        kept: list[Span] = []
        for _, s, e, kind in sorted(found, key=lambda x: (x[0], x[1] - x[2])):
            if all(e <= k.start or s >= k.end for k in kept):
                kept.append(Span(s, e, kind))
        return sorted(kept)


_STREETS = {"street": _STREET, "rue": _RUE, "strasse": _STRASSE, "box": _BOX, "markt": _MARKT}
_STREET_END = re.compile(rf"[ ]{_STREET_WORD}(?![a-z])")


def _CJK_PART(c: str) -> bool:
    return "一" <= c <= "鿿" or "ぁ" <= c <= "ヿ" or c.isdigit() or c in "-－"


def _around(text: str, start: int, end: int, words: int = 14) -> tuple[int, int]:
    """The words before and behind an anchor that an address may have."""
    a, b = start, end
    for _ in range(words):
        if a <= 0:
            break
        a = max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), 0)
    for _ in range(words):
        space, line = text.find(" ", b + 1), text.find("\n", b + 1)
        b = min(x if x >= 0 else len(text) for x in (space, line))
        if b >= len(text):
            break
    return a, b


def _email(text: str, start: int, end: int) -> tuple[int, int] | None:
    spoken = text[start:end].lower() == " at "
    left = start
    while left > 0 and text[left - 1] == " " and not spoken:
        left -= 1
    if left < start and text[start] == "@":
        return None
    begin = left
    while begin > 0 and text[begin - 1] in _LOCAL_SIGNS:
        begin -= 1
    local = _LOCAL.search(text[begin:left])
    right = end
    while right < len(text) and text[right] == " " and text[start] != "@":
        right += 1
    host = (_HOST_SPOKEN if spoken else _HOST).match(text, right)
    if not local or not host:
        return None
    if spoken and " dot " not in host[0].lower():
        return None
    plain = re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*| dot ", ".", host[0], flags=re.I)
    top = plain.rsplit(".", 1)[-1]
    if not (top.isalpha() and len(top) >= 2) or ".." in plain:
        return None
    return left - len(local[0]), host.end()


def _is_id(value: str) -> bool:
    core = re.sub(r"[ .\-/]", "", value)
    return 6 <= len(core) <= 20 and sum(c.isdigit() for c in core) >= 5


def _is_phone(value: str) -> bool:
    n = sum(c.isdigit() for c in value)
    if value.startswith("+"):
        return 8 <= n <= 15
    return 9 <= n <= 12 and not re.match(r"00\d", re.sub(r"\D", "", value)) if value[0] == "0" else True


def _is_name(value: str) -> bool:
    bare = re.sub(rf"^(?:{_TITLE})+", "", value)
    parts = re.findall(r"[^\s,.\-]+", bare)
    return bool(parts) and any(len(p) >= 2 for p in parts) and not any(len(p) >= 2 and p.lower() in _NO_NAME for p in parts)


def _name_at(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """A name that begins behind a cue."""
    if not cue[-1].isascii():
        m = _CJK_NAME.match(text, at)
        return m.span("v") if m else None
    # a sign-off has the name on its own line
    m = re.compile(r"[ \t]*[,:]?[ \t]*\n+[ \t]*" if re.search(r"regards|sincerely|cheers|best|yours|saludos|grüßen|gruß|cordialement", cue) else r"[\s:,]{0,3}").match(text, at)
    if not m:
        return None
    name = _NAME.match(text, m.end())
    if not name:
        return None
    alone = " " not in name[0]
    if alone and (cue.strip() in ("cc", "i am", "this is", "talk to", "came from", "assigned to", "demandez", "attn", "contact is") or not name[0][1:2].islower()):
        return None
    value = name[0]
    while not _is_name(value) and " " in value:  # the next sentence's first word may have joined
        value = value.rsplit(" ", 1)[0].rstrip(",")
    if not _is_name(value) or alone and len(value) < 3:
        return None
    return m.end(), m.end() + len(value)


def _name_before(text: str, at: int) -> tuple[int, int] | None:
    """A name that ends before a cue."""
    if text[at : at + 1] in "さ様先女":
        m = re.search(r"(?:[一-鿿]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+)+)$", text[_around(text, at, at, 5)[0] : at])
        return (at - len(m[0]), at) if m else None
    begin = _around(text, at, at, 6)[0]
    best = None
    for m in re.finditer(r"(?<![\w.])[A-ZÀ-Þ]", text[begin:at]):
        n = _NAME.fullmatch(text, begin + m.start(), at)
        if n and _is_name(n[0]) and " " in n[0]:
            best = n.span()
            break
    return best


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def replace(text: str) -> str:
    """The text with each personal detail replaced by a placeholder that names its kind."""
    out, at = [], 0
    for s in finder().spans(text):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def personal(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, from_char, to_char, kind, value): each personal detail of each text.

    Characters count from 0. Null, empty and blank texts give no rows, repeated rows their own,
    very long texts are read whole; an empty table gives an empty table; other columns of ``df``
    don't matter. Narrow: no shuffle. Equal texts of a batch are read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        for batch in batches:
            coded = batch.column(batch.num_columns - 1).dictionary_encode()
            spans = [(t, f.spans(t)) for t in coded.dictionary.to_pylist()]
            place, rows = [], []
            for i, c in enumerate(coded.indices.to_pylist()):
                t, found = spans[c]
                for s in found:
                    place.append(i)
                    rows.append((s.start, s.end, s.kind, t[s.start : s.end]))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
                taken = pa.array(place)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(batch.num_columns - 1)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*(f"k{i}" for i in range(batch.num_columns - 1)), "from_char", "to_char", "kind", "value"])

    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).cast("string").alias("t")).filter(F.length(F.trim("t")) > 0)
    schema = ", ".join(f"k{i} {dict(rows.dtypes)[f'k{i}']}" for i in range(len(keys))) + ", from_char int, to_char int, kind string, value string"
    return rows.mapInArrow(run, schema).toDF(*keys, "from_char", "to_char", "kind", "value")


def kinds(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): each kind once for each row."""
    return found.select(*keys, "kind").distinct()


def placeholders(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text): every text with its personal details replaced; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(batch.num_columns - 1).dictionary_encode()
            new = pa.array([replace(t) for t in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns - 1)), new.take(coded.indices)], [*(f"k{i}" for i in range(batch.num_columns - 1)), "t"])

    cols: list[Column] = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(*cols, F.col(text).cast("string").alias("t"))
    schema = ", ".join(f"k{i} {dict(rows.dtypes)[f'k{i}']}" for i in range(len(keys))) + ", t string"
    return rows.mapInArrow(run, schema).toDF(*keys, text)

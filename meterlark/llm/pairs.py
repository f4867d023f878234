"""Problem 4: defective question-answer pairs, by tagging the answer's clauses with a conditional random field.

An answer is cut into clauses. A linear-chain CRF tags them ``answer``, ``refusal``, ``echo``,
``foreign`` or ``unfinished``; the tags' coverage of the answer decides on the pair's defect. Its
features compare a clause with the question (share of words, repetition), look at its form (how it
ends, brackets, code, numbers) and its language, count function words (negations, pronouns of the
first and second person, other frequent words), and hold its words and pairs of words as far as the
training material has them. The CRF is trained here, on at most TRAINING sequences that ``clauses``
makes from sentences of other subjects, seeded; weights of single words are held small, so that the
general features carry over to other wordings. An answer without any clause to tag is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlark.llm import clauses as clauses_of

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Bound of the training set, in sequences.
TRAINING = 3000

#: Frequent short words by language; a clause's language is the one of most hits.
STOP_WORDS = {
    "en": "the a an is are was were be been to of and or in on at for with that this it you your not no can do does how what why where when which will from by as if then they we our has have each per after before one but once while than so only all any same also its them until yes open wait check enter set there keep kept",
    "fr": "le la les un une des du de et ou est sont était être à au aux en dans pour par sur avec que qui ne pas plus ce cette ces vous votre nous il elle ils elles se son sa ses comment pourquoi combien quel quelle où quand puis après avant si mais rien tous toutes leur dont souvent chaque mon ma mes l d qu n s c j jamais oui ouvrez y a",
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren sein zu im in an am auf aus bei mit nach von vor für über um als auch nicht kein keine wie was warum wann wo welche welcher ich sie wir ihr mein ihre es er wird werden kann können dann wenn aber nur noch schon bleiben bis etwa zum zur ja öffnen dass nichts etwas alle diese dieser dieses unter durch",
    "es": "el la los las un una unos unas de del y o es son era ser a al en por para con que qué no más lo se su sus mi mis cómo por qué cuándo dónde cuál cuánto cuánta si pero como antes después cada este esta estos estas usted nosotros ellos entonces unos hay muy ya todo todos nada tras sin sobre entre sí abra le les puede nos",
}
_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _words in STOP_WORDS.items():
    for _word in set(_words.split()):
        _WORD_LANGS.setdefault(_word, []).append(_lang)
_KANA, _HAN, _HANGUL, _CYRILLIC, _ARABIC = (re.compile(p) for p in ("[ぁ-ゟァ-ヺー]", "[一-鿿]", "[가-힣]", "[Ѐ-ӿ]", "[؀-ۿ]"))
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = {"fr": "àâçèêëîïôùûœ", "de": "äöüß", "es": "ñ¿¡óáíú"}

#: How languages are called where a question asks for one.
LANGUAGES = {
    "en": "english|anglais|englisch|inglés|ingles|英语|英文|英語",
    "fr": "french|français|francais|französisch|francés|法语|法文|フランス語",
    "de": "german|allemand|deutsch|alemán|aleman|德语|德文|ドイツ語",
    "es": "spanish|espagnol|spanisch|español|espanol|castellano|西班牙语|西班牙文|スペイン語",
    "zh": "chinese|chinois|chinesisch|chino|中文|汉语|中国語|mandarin",
    "ja": "japanese|japonais|japanisch|japonés|japones|日语|日文|日本語",
}
_ASKED = {lang: re.compile(rf"(?i)(?:\b(?:in|into|en|auf|ins|au|al)\s+|用|以|で?|翻译成|answer\s+|reply\s+)(?:{names})") for lang, names in LANGUAGES.items()}
_ASKING = re.compile(r"(?i)answer|reply|respond|write|explain|translate|répon|répond|expliqu|tradui|antwort|erklär|übersetz|schreib|respond|contest|expli|traduz|traduc|回答|回复|答复|翻译|解释|答え|回答|返信|説明|翻訳|please|bitte|merci|por favor|请|ください|s'il vous")

#: Function words that tell who speaks and whether something is denied, as stems of words or, in Chinese and Japanese, parts of the text.
_NEGATION = re.compile(r"(?i)\b(?:not|no|none|nothing|never|nobody|cannot|\w+n['’]t|unable|ne|n['’]|pas|rien|aucun\w*|jamais|sans|nicht|nichts|kein\w*|nie|niemand|nunca|nada|ningún|ninguna?|sin)\b|不|没|無|无|未|拒|ない|ません|ず(?:に|、)|いたしかね|控え")
_FIRST = re.compile(r"(?i)\b(?:i|me|my|we|us|our|je|j['’]|me|m['’]|mon|ma|mes|nous|notre|nos|ich|mir|mich|mein\w*|wir|uns|unser\w*|yo|mi|mis|nosotros|nuestr[oa]s?)\b|我|私|当社|当方|弊社|こちら")
_SECOND = re.compile(r"(?i)\b(?:you|your|vous|votre|vos|sie|ihnen|ihr\w*|usted|su|sus)\b|您|你|ください|お客様")
_POINTING = re.compile(r"(?i)\b(?:that|this|such|these|it|cela|ça|ce|cette|ces|das|dies\w*|dazu|darüber|darauf|dabei|hierzu|solche\w*|eso|esto|esa|ese|este|ello|tal)\b|这|此|该|その|この|それ|これ")
#: Words with which no sentence ends.
DANGLING = frozenset(
    "se the a an to of and or in on at for with that this your our their its is are was were be been by as if from than but because should would could will can may must not no which who whose when while until into each every any some more most very also without le la les un une des du de et ou à au aux en dans pour par sur avec que qui ne ce cette ces vous votre leur der die das den dem des ein eine einen einem einer und oder zu im am auf aus bei mit nach von vor für über um als auch wie wenn dass weil el los las del y o al por para con su sus como si lo una uno".split()
)
#: Stand-ins for an answer that is missing.
MISSING = frozenset("n/a na none null nil nan tbd tba todo pending unknown empty undefined - -- no answer not answered not available no reply placeholder to be done to be determined answer missing sans réponse aucune réponse keine antwort sin respuesta 无 暂无 无回答 没有回答 なし 未回答 回答なし".replace("no answer", "no_answer").replace("not answered", "not_answered").replace("not available", "not_available").replace("no reply", "no_reply").replace("to be done", "to_be_done").replace("to be determined", "to_be_determined").replace("answer missing", "answer_missing").replace("sans réponse", "sans_réponse").replace("aucune réponse", "aucune_réponse").replace("keine antwort", "keine_antwort").replace("sin respuesta", "sin_respuesta").split())

_NOT_PLAIN = re.compile(r"[\W_]+")
_TAG_OR_ENTITY = re.compile(r"<[^<>]{0,80}>|&(?:nbsp|zwnj|zwsp|#\d+|#x[0-9a-fA-F]+|amp|lt|gt|quot);")
_BLANK = re.compile(r"[\s​-‏⁠﻿­　⠀]+")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？；])[」』”）]*\s*|\n+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_END = re.compile(r"[.!?…。！？」』]['\"”’)\]»`*_]*$")
_URL_END = re.compile(r"(?:https?://|www\.)\S+$|\S+@\S+\.\w+$")


@lru_cache(maxsize=1 << 14)
def language(text: str) -> str | None:
    """The language of a text by script, frequent words and special letters; None if there is no telling."""
    if not text.isascii():
        if _KANA.search(text):
            return "ja"
        if len(_HAN.findall(text)) >= 2:
            return "zh"
        for lang, script in (("ko", _HANGUL), ("ru", _CYRILLIC), ("ar", _ARABIC)):
            if len(script.findall(text)) >= 3:
                return lang
    low = text.lower()
    score = dict.fromkeys(STOP_WORDS, 0.0)
    for w in _LATIN.findall(low):
        for lang in _WORD_LANGS.get(w, ()):
            score[lang] += 1
    if not low.isascii():
        for lang, letters in _MARKS.items():
            score[lang] += 0.7 * min(3, sum(low.count(c) for c in letters))
    best, next_best = sorted(score, key=score.get, reverse=True)[:2]
    return best if score[best] >= 1.5 and score[best] > 1.15 * score[next_best] else None


def plain(text: str) -> str:
    """Letters and digits only, in lower case."""
    return _NOT_PLAIN.sub("", text.casefold())


def is_empty(answer: str | None) -> bool:
    """No answer: null, blank, only marks, or a stand-in for one."""
    if answer is None:
        return True
    if "<" not in answer and "&" not in answer and sum(map(str.isalnum, answer[:64])) > 24:
        return False  # more than any stand-in has
    bare = _BLANK.sub(" ", _TAG_OR_ENTITY.sub(" ", answer)).strip()
    if not any(c.isalnum() for c in bare):
        return True
    core = _BLANK.sub("_", re.sub(r"^[\W_]+|[\W_]+$", "", bare.lower()))
    return core in MISSING


def clauses(answer: str) -> list[str]:
    """Sentences and lines of an answer; a code block is one clause."""
    out, at = [], 0
    for m in _FENCE.finditer(answer):
        out += _CLAUSE.split(answer[at : m.start()])
        out.append(m[0])
        at = m.end()
    out += _CLAUSE.split(answer[at:])
    return [c for c in out if any(x.isalnum() for x in c)]


FEATURES = (
    "bias", "echo", "echo_share", "share", "negated", "first", "second", "pointing", "negated_first", "negated_pointing", "plain_words", "numbers", "length", "foreign", "native", "last", "open_end", "open_end_short", "dangling", "url_end",
    "fence_open", "fence_closed", "bracket_open", "first_clause", "after_echo", "open_end_foreign",
)
#: Training sequences that a word must occur in to be a feature, and the strength that holds weights small: of general features and of words.
COMMON, HOLD, HOLD_WORDS = 3, 1e-3, 1e-5
_REFUSAL, _ECHO = TAGS.index("refusal"), 1  # the tag that words speak for or against, and the feature that makes them silent
_TOKEN = re.compile(r"\d+|[^\W\d_]+(?:['’][^\W\d_]+)?")
_WIDE = re.compile(r"[一-鿿ぁ-ゟァ-ヺー]+")
_LABEL = re.compile(r"(?i)^(?:q|question|frage|pregunta|问|問|質問)\s*[:：]\s*")
_NUMBERS = re.compile(r"\d+")
_IN_CODE = re.compile(r"[()\[\]{}`]")


class Asked(NamedTuple):
    """What a question says of its answers."""

    plain: str
    lang: str | None
    words: frozenset


def alike(text: str) -> str:
    """The text with all numbers the same, which is what texts are compared by but for echoes."""
    return _NUMBERS.sub("0", text)


@lru_cache(maxsize=1 << 14)
def asked(question: str) -> Asked:
    return Asked(plain(question), language(question), frozenset(re.findall(r"\w+", alike(question).casefold())))


@lru_cache(maxsize=1 << 12)
def wanted(question: str) -> frozenset:
    """The languages that a question asks to be answered in."""
    return frozenset(x for x, p in _ASKED.items() if p.search(question)) if _ASKING.search(question) else frozenset()


def words(clause: str) -> tuple[str, ...]:
    """Words and pairs of words of a clause, numbers as one; of Chinese and Japanese, pairs of characters."""
    w = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(clause.lower().replace("’", "'")) if not _WIDE.match(t)]
    out = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
    for run in _WIDE.findall(clause) if not clause.isascii() else ():
        out |= {run[i : i + 2] for i in range(len(run) - 1)}
    return tuple(sorted(out))


@lru_cache(maxsize=1 << 14)
def _own(c: str) -> tuple:
    """What a clause, its numbers made alike, says by itself: its words, length, language, function words and end."""
    fence, bare = c.startswith("```"), c.strip()
    w = re.findall(r"\w+", c.casefold())
    told = [bool(p.search(c)) for p in (_NEGATION, _FIRST, _SECOND, _POINTING)] if not fence else [False] * 4
    lang = None if fence else language(c)
    stop = sum(x in _WORD_LANGS for x in w) / len(w) if w and lang not in ("zh", "ja") else 0.0
    ended = bool(_END.search(bare)) or fence and bare.endswith("```") and len(bare) > 6
    dangling = bool(w) and (w[-1] in DANGLING or bare.endswith((",", ":", ";", "(", "-", "，", "、", "：")))
    brackets = bool(_IN_CODE.search(c)) and any(c.count(a) > c.count(b) for a, b in ("()", "[]", "{}")) or "（" in c and c.count("（") > c.count("）") or c.count("「") > c.count("」") or not fence and c.count("`") % 2 == 1
    quoted = len(bare) > 2 and bare[0] == bare[-1] and bare[0] in "`\"'"
    return w, sum(len(run) - 1 for run in _WIDE.findall(c)) // 2, fence, lang, told, stop, ended, dangling, brackets, quoted, bool(_URL_END.search(bare)), any(x.isdigit() for x in w)


def features(question: str, parts: list[str], tail_blank: bool) -> list[list[float]]:
    """The general features of each clause."""
    q = asked(question)
    rows, covered, whole = [], 0.0, len(parts) == 1
    for i, c in enumerate(parts):
        w, wide, fence, lang, (negated, first, second, pointing), stop, ended, dangling, brackets, quoted, url, numbers = _own(alike(c))
        p = plain(_LABEL.sub("", c.strip(" >\"'“”*_\t")))
        last, n = i == len(parts) - 1, len(q.plain)
        native = lang is not None and (lang == q.lang or lang in wanted(question))
        again = n >= 4 and len(p) >= n and p == (q.plain * (len(p) // n + 1))[: len(p)] and len(p) % n == 0
        echo = not fence and n >= 4 and (again or len(p) >= 4 and p in q.plain)
        part = len(p) / n if echo and not again else 1.0 if echo else n / len(p) if n >= 4 and not fence and q.plain in p else 0.0
        share = sum(x in q.words for x in w) / len(w) if w and not fence else 0.0
        short = whole and (not tail_blank and len(w) + wide <= 3 and len(p) <= 24 and not dangling or quoted)
        open_end = last and not ended and not url
        rows.append([
            1.0, echo, part, share, negated, first, second, pointing, negated and first, negated and pointing, stop, numbers, min(len(p), 120) / 120, lang is not None and q.lang is not None and not native, native, last, open_end and not short, open_end and short,
            open_end and dangling, last and url, fence and not ended, fence and ended, last and brackets, i == 0, covered, open_end and i > 0 and lang is not None and not native,
        ])
        covered = float(echo or covered == 1)
    return rows


class Model(NamedTuple):
    general: np.ndarray  # features x tags
    lexical: np.ndarray  # by word, for a refusal
    follow: np.ndarray  # tags + 1 x tags, the last row for the start
    index: dict[str, int]  # words by row of ``lexical``

    def by_words(self, clause: str) -> float:
        """What a clause's words say for a refusal."""
        known = [self.index[w] for w in words(clause) if w in self.index]
        return float(self.lexical[known].sum()) / max(len(known), 1) ** 0.5

    def scores(self, rows: list[list[float]], parts: list[str], by_words: Callable[[str], float]) -> np.ndarray:
        """Of each clause for each tag."""
        out = np.array(rows, float) @ self.general
        out[:, _REFUSAL] += [0.0 if r[_ECHO] else by_words(alike(c)) for r, c in zip(rows, parts)]
        return out


def _train(data: list, rounds: int = 150, rate: float = 0.1) -> Model:
    """By Adam on the exact likelihood."""
    counts: dict[str, int] = {}
    for _, parts, _ in data:
        for w in {w for c, _ in parts for w in words(alike(c))}:
            counts[w] = counts.get(w, 0) + 1
    index = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= COMMON))}
    n, most, k, g = len(data), max(len(parts) for _, parts, _ in data), len(TAGS), len(FEATURES)
    x, y, on = np.zeros((n, most, g)), np.zeros((n, most), int), np.zeros((n, most), bool)
    places: list[int] = []  # of clauses, of their words and the words' weight
    named: list[int] = []
    weight: list[float] = []
    for i, (q, parts, blank) in enumerate(data):
        x[i, : len(parts)] = features(q, [c for c, _ in parts], blank)
        for j, (c, t) in enumerate(parts):
            known = [index[w] for w in words(alike(c)) if w in index] if not x[i, j, _ECHO] else []
            places += [i * most + j] * len(known)
            named += known
            weight += [1 / np.sqrt(max(len(known), 1))] * len(known)
            y[i, j], on[i, j] = TAGS.index(t), True
    flat, last = x.reshape(n * most, g), on.sum(1) - 1
    at, which, amount = np.array(places), np.array(named), np.array(weight)
    w, v, a = np.zeros((g, k)), np.zeros(len(index)), np.zeros((k + 1, k))
    moment = [np.zeros_like(z) for z in (w, v, a, w, v, a)]
    lse = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
    gold = np.eye(k)[y] * on[..., None]
    pairs = np.zeros((k + 1, k))
    np.add.at(pairs, (k, y[:, 0]), 1)
    for t in range(1, most):
        np.add.at(pairs, (y[on[:, t], t - 1], y[on[:, t], t]), 1)
    for step in range(1, rounds + 1):
        s = flat @ w
        s[:, _REFUSAL] += np.bincount(at, v[which] * amount, n * most)
        s = s.reshape(n, most, k)
        f, b = np.zeros((n, most, k)), np.zeros((n, most, k))
        f[:, 0] = s[:, 0] + a[k]
        for t in range(1, most):
            f[:, t] = np.where(on[:, t, None], lse(f[:, t - 1, :, None] + a[None, :k], 1) + s[:, t], f[:, t - 1])
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], lse(a[None, :k] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[np.arange(n), last], 1)
        p = np.exp(f + b - z[:, None, None]) * on[..., None]
        expected = np.zeros_like(pairs)
        expected[k] = p[:, 0].sum(0)
        for t in range(1, most):
            joint = f[:, t - 1, :, None] + a[None, :k] + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None]
            expected[:k] += (np.exp(joint) * on[:, t, None, None]).sum(0)
        miss = (gold - p).reshape(n * most, k)
        by_word = np.bincount(which, miss[at, _REFUSAL] * amount, len(index))
        for j, grad in enumerate([flat.T @ miss / n - HOLD * w, by_word / n - HOLD_WORDS * v, (pairs - expected) / n - HOLD * a]):
            moment[j] = 0.9 * moment[j] + 0.1 * grad
            moment[j + 3] = 0.999 * moment[j + 3] + 0.001 * grad * grad
            (w, v, a)[j][...] += rate * (moment[j] / (1 - 0.9**step)) / (np.sqrt(moment[j + 3] / (1 - 0.999**step)) + 1e-8)
    return Model(w, v, a, index)


@lru_cache(maxsize=1)
def model() -> Model:
    """The trained CRF; the same in every process."""
    return _train(clauses_of.sequences(TRAINING))


def tag(model: Model, scores: np.ndarray) -> list[str]:
    """The likeliest tags (Viterbi)."""
    k = len(TAGS)
    score, back = scores[0] + model.follow[k], []
    if len(scores) == 1:
        return [TAGS[int(score.argmax())]]
    for t in range(1, len(scores)):
        step = score[:, None] + model.follow[:k]
        back.append(step.argmax(0))
        score = step.max(0) + scores[t]
    path = [int(score.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return [TAGS[i] for i in reversed(path)]


def defect(model: Model, question: str | None, answer: str | None, by_words: Callable[[str], float] | None = None) -> str | None:
    """The defect of a pair, None if it is sound. A null question compares as an empty one."""
    if is_empty(answer):
        return "empty"
    question, parts = question or "", clauses(answer)
    tags = tag(model, model.scores(features(question, parts, answer != answer.rstrip(" ")), parts, by_words or model.by_words))
    share = dict.fromkeys(TAGS, 0)
    for c, t in zip(parts, tags):
        share[t] += len(c)
    body = sum(share.values()) - share["echo"]
    if not body:
        return "copied_question"
    if share["refusal"] and share["refusal"] >= 0.9 * body:
        return "refusal"
    if share["foreign"] > 0.5 * body:
        return "other_language"
    return "truncated" if tags[-1] == "unfinished" else None


def defects(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(key, defect): each defective pair with one defect.

    A null, blank or stand-in answer is ``empty``; a null question is read as an empty one. Repeated
    rows repeat, very long texts are read whole, an empty table gives an empty table and other
    columns of ``df`` don't matter. Where several defects meet: empty, copied_question, refusal,
    other_language, truncated, in this order. Narrow; the CRF is trained once on the driver and
    goes along with the tasks (the words of the training material by five tags, some 100 KB).
    """
    trained = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_words = lru_cache(maxsize=1 << 15)(trained.by_words)
        for batch in batches:
            found = [defect(trained, q, a, by_words) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            place = [i for i, d in enumerate(found) if d]
            if place:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array([found[i] for i in place])], ["k", "defect"])

    rows = df.select(F.col(key).alias("k"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, defect string").withColumnRenamed("k", key)

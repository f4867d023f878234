"""Problem 9: oversized texts cut into pieces at natural boundaries, with an overlap.

Every token boundary gets a strength: 6 paragraph, 5 line, 4 sentence, 3 clause, 2 between words,
1 inside a word, 0 inside a character (never cut). A sparse table over the strengths answers "the
strongest boundary in this range, the rightmost of equals" by two look-ups; each piece ends at the
strongest boundary of its permissible window, and the next one begins at the strongest boundary of
the window behind that end, so that the pieces overlap. The few levels of the table that the fixed
window widths need are kept, so memory is a small multiple of the text whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterlark.llm import bpe

#: Most bytes, and so tokens, of a character: an overlap of fewer might not hold one.
WIDEST = 4
_STEP = 1 << 28  # a strength's weight against the position, which breaks ties rightward


class RangeMax:
    """Sparse table over ``values``; ``widths`` are the only widths of ranges that may be asked for."""

    def __init__(self, values: np.ndarray, widths: list[int]):
        self.levels: dict[int, np.ndarray] = {}
        need, level, k = {int(w).bit_length() - 1 for w in widths if w > 0}, values, 0
        while True:
            if k in need:
                self.levels[k] = level
            if k >= max(need):
                break
            half = 1 << k
            if len(level) <= half:
                break
            level, k = np.maximum(level[:-half], level[half:]), k + 1

    def best(self, left: int, right: int) -> int:
        """Largest value in [left, right]."""
        k = (right - left + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[left], level[right - (1 << k) + 1]))


def strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Strengths of the boundaries at byte positions ``at`` (0 < at <= len) of UTF-8 ``data``."""
    pad = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(1, np.uint8)])
    p = at + 4
    b3, b2, b1, b0 = pad[p - 3], pad[p - 2], pad[p - 1], pad[p]
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    s = np.ones(len(at), np.int64)
    wide = (b0 >= 0xE3) & (b0 <= 0xEA)  # a CJK character begins: as good as a word's beginning
    s[blank(b0) | blank(b1) | (b0 == 0) | wide] = 2
    ideographic = (b3 == 0xE3) & (b2 == 0x80)
    fullwidth = (b3 == 0xEF) & (b2 == 0xBC)
    s[(np.isin(b1, np.frombuffer(b",;:", np.uint8)) & blank(b0)) | (ideographic & (b1 == 0x81)) | (fullwidth & np.isin(b1, [0x8C, 0x9A, 0x9B]))] = 3
    s[(np.isin(b1, np.frombuffer(b".!?", np.uint8)) & blank(b0)) | (ideographic & (b1 == 0x82)) | (fullwidth & np.isin(b1, [0x81, 0x9F]))] = 4
    line = (b1 == 10) & (b0 != 10) & (b0 != 13)
    s[line] = 5
    s[line & ((b2 == 10) | ((b2 == 13) & (b3 == 10)))] = 6
    s[(b0 & 0xC0) == 0x80] = 0
    return s


def cut(data: np.ndarray, ends: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (first token, end token) of a text of more than ``most`` tokens that end at the bytes ``ends``."""
    n = len(ends)
    value = np.concatenate([[0], strengths(data, ends)]) * _STEP + np.arange(n + 1)
    least, near = max(most // 2, overlap + 1), max(1, overlap // 4)
    index = RangeMax(value, [most - least + 1, overlap - near + 1, overlap])
    out, start = [], 0
    while n - start > most:
        end = index.best(start + least, start + most) % _STEP
        out.append((start, end))
        back = index.best(end - overlap, end - near)
        if back < _STEP:
            back = index.best(end - overlap, end - 1)
        start = back % _STEP
    out.append((start, n))
    return out


class _Text:
    """A text on its way to pieces."""

    def __init__(self, place: int, raw: bytes, ids: np.ndarray, begins: np.ndarray, token_size: np.ndarray, most: int, overlap: int):
        self.place, self.raw, self.begins, self.limit, self.lap = place, raw, begins, most, overlap
        self.data, self.ends = np.frombuffer(raw, np.uint8), np.cumsum(token_size[ids])
        self.offset = np.concatenate([[0], self.ends])
        self.by_bytes = False

    def count_bytes(self, spans: list[tuple[int, int]]) -> None:
        """From now on each byte of the spans counts as a token: no text has more tokens than bytes."""
        inside = np.zeros(len(self.ends), bool)
        for a, b in spans:
            inside[a:b] = True
        units = np.where(inside, np.diff(self.offset), 1)
        first = np.cumsum(units) - units
        begins = np.zeros(int(units.sum()), bool)
        begins[first] = self.begins
        last = np.repeat(self.ends, units)
        self.ends = last - (np.repeat(first + units, units) - 1 - np.arange(len(last)))
        self.begins, self.offset, self.by_bytes = begins, np.concatenate([[0], self.ends]), True

    def cut(self) -> None:
        self.parts = cut(self.data, self.ends, self.limit, self.lap)
        self.spans = self.parts + [(b[0], a[1]) for a, b in zip(self.parts, self.parts[1:])]  # pieces, then what they share
        self.sizes = [b - a for a, b in self.spans]

    def bytes_of(self, span: tuple[int, int]) -> tuple[int, int]:
        return int(self.offset[span[0]]), int(self.offset[span[1]])

    def same_alone(self, span: tuple[int, int]) -> bool:
        """Whether the span surely has the same tokens when encoded by itself: it begins and ends with a word, and not in a run of white space, which the end of a text cuts in another way."""
        a, b = span
        if self.by_bytes or not self.begins[a] or b < len(self.begins) and not self.begins[b]:
            return False
        if b == len(self.begins):
            return True
        tail = self.raw[max(0, int(self.offset[b]) - 8) : int(self.offset[b])].decode(errors="ignore")
        return not tail[-1:].isspace() or not tail[-2:-1].isspace() and len(tail) > 1


def _settle(e: bpe.Encoder, texts: list[_Text], most: int, overlap: int) -> None:
    """Cuts texts; where a piece or overlap has too many tokens when encoded by itself, again with smaller limits, and where these would fall below half, with that span counted by bytes, until all fit. Spans in doubt of all texts are encoded together."""
    while texts:
        doubts: list[tuple[_Text, int]] = []
        for t in texts:
            t.cut()
            doubts += [(t, i) for i, span in enumerate(t.spans) if not t.same_alone(span)]
        if not doubts:
            return
        alone = pa.array([t.raw[slice(*t.bytes_of(t.spans[i]))].decode() for t, i in doubts], pa.large_string())
        sizes = np.concatenate([e.encode(part.cast(pa.string()))[1] for _, part in bpe.slices(alone)])
        over: dict[int, list] = {}
        for (t, i), size in zip(doubts, sizes.tolist()):
            t.sizes[i] = size
            piece = i < len(t.parts)
            excess = size - (most if piece else overlap)
            if excess > 0:
                worst = over.setdefault(id(t), [t, 0, 0, []])
                worst[1 if piece else 2] = max(worst[1 if piece else 2], excess)
                worst[3].append(t.spans[i])
        texts = []
        for t, by_piece, by_lap, spans in over.values():
            if t.limit - by_piece < most // 2 or t.lap - by_lap < min(overlap, WIDEST):
                t.count_bytes(spans)
            else:
                t.limit, t.lap = t.limit - by_piece, t.lap - by_lap
            texts.append(t)


def pieces(df: DataFrame, key: str, text: str, path: str, most: int = 1024, overlap: int = 64, with_text: bool = True) -> DataFrame:
    """Pieces of the texts of more than ``most`` tokens: (key, piece_no, n_pieces, from_byte, to_byte, n_tokens[, piece]).

    Pieces are numbered from 1, each has at most ``most`` tokens when encoded by itself, and two
    consecutive ones share at least one and at most ``overlap`` tokens. Bytes count in UTF-8 from 0.
    Texts of at most ``most`` tokens, among them null, empty and blank ones, give no rows: they
    need no cutting. Texts without any boundary are cut between characters. Repeated rows repeat
    their pieces; an empty table gives an empty table; other columns of ``df`` don't matter.

    Narrow: a text is cut where it is read. Texts of at most ``most`` bytes can't have more tokens
    and are left out by the JVM before any Python runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, part in bpe.slices(texts):
                ids, sizes, begins = e.encode_words(part)
                first = np.concatenate([[0], np.cumsum(sizes)])
                large = [_Text(at + i, part[i].as_py().encode(), ids[first[i] : first[i + 1]], begins[first[i] : first[i + 1]], e.token_size, most, overlap) for i in np.flatnonzero(sizes > most).tolist()]
                _settle(e, large, most, overlap)
                rows = [(t.place, k + 1, len(t.parts), *(span := t.bytes_of(p)), t.sizes[k], t.raw[slice(*span)].decode() if with_text else None) for t in large for k, p in enumerate(t.parts)]
                if rows:
                    place, *rest = zip(*rows)
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()][: 5 + with_text]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(place)), *(pa.array(c, t) for c, t in zip(rest, kinds))], names=["k", "piece_no", "n_pieces", "from_byte", "to_byte", "n_tokens", "piece"][: 6 + with_text])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.octet_length("t") > most)
    schema = f"k {dict(rows.dtypes)['k']}, piece_no int, n_pieces int, from_byte long, to_byte long, n_tokens int" + ", piece string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)

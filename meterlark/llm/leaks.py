"""Problem 8: passages of held-out items inside a corpus, by a distributed positional inverted index.

1. Index. Every part of the corpus becomes a segment of the index where it is read: each text's
   words are numbered, and for each word that occurs in an item the segment keeps its posting list,
   the sorted places at which it stands (texts lie one behind another with a gap, so that a place
   tells text and position, and no phrase runs from one text into the next). Segments are written
   to the shared folder; nothing is shuffled, as each text's postings stay together.
2. Statistics. The lengths of all segments' posting lists, summed by word, tell how rare each word
   is in the whole corpus.
3. Search. Of each run of ``least`` words of an item, the rarest is an anchor. In every segment the
   anchor's list is shifted by its position in the item, which gives the places where the item
   could begin; these are intersected with the shifted lists of its neighbours, and a run of at
   least ``least`` matches in a row that holds the anchor is a hit. Every such passage holds the
   anchor of its first window, so none is missed.
4. Proximity. Where words may be missing, a window has so many anchors that one must be there. The
   places around each anchor are looked up, and spans that hold enough words of a window are hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meterlark.llm import bpe
from meterlark.session import durable

#: Text of the items that one search may hold in memory; more items go in blocks, which search the same index.
BLOCK_BYTES = 16_000_000
#: Distinct words of items for which one index is made; where items have more, there are several.
INDEX_WORDS = 1_000_000
#: Text of a segment, at least one text: the larger, the fewer times the items are gone through.
SEGMENT_BYTES = 16_000_000
#: Words of an item whose windows are looked for together, and places looked at together.
STRETCH = 128
PLACES = 100_000
WORDS_SQL = rf"""
SELECT CASE WHEN t IS NULL THEN [] WHEN regexp_matches(t, '[^{bpe.USUAL}]') THEN NULL
            ELSE regexp_extract_all(replace(replace(lower(t), 'i̇', 'i'), 'ς', 'σ'), '[\pL\pN]+') END AS w
FROM texts
"""
_WORD = re.compile(r"[^\W_]+")
#: Stands between items of one key.
_PARTING = -1


class _Lower(dict):
    """Lower case of each character by itself, as ``lower`` of the query has it."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = out = ord(low[0]) if len(low) == 1 or code == 0x130 else code
        return out


_LOWER = _Lower()


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case, where both forms of the small sigma are one and i with a dot is i."""
    return _WORD.findall(text.translate(_LOWER).replace("i\u0307", "i").replace("ς", "σ"))


class Cutter:
    """Cuts batches of texts into words."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words one after another, and the number of words of each text (0 for null)."""
        self.db.register("texts", pa.table({"t": texts}))
        col = self.db.sql(WORDS_SQL).to_arrow_table()["w"].combine_chunks()
        self.db.unregister("texts")
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.string()))
        if col.null_count:
            odd = np.flatnonzero(np.asarray(pc.is_null(col)))
            other = pa.array([words_of(t) for t in texts.take(pa.array(odd)).to_pylist()], col.type)
            place = np.arange(len(col))
            place[odd] = len(col) + np.arange(len(odd))
            col = pa.concat_arrays([col, other]).take(pa.array(place))
        return col.flatten(), np.asarray(pc.list_value_length(col)).astype(np.int64)


_CUTTER: list[Cutter] = []


def _cutter() -> Cutter:
    if not _CUTTER:
        _CUTTER.append(Cutter())
    return _CUTTER[0]


def index(corpus: DataFrame, key: str, text: str, terms: dict[str, int], gap: int) -> DataFrame:
    """Segments of the positional index over ``terms``: (segment, keys, starts, terms, counts, places).

    ``starts``: first place of each text; ``places``: the posting lists one behind another, each
    as differences. The arrays are packed 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter()
        pack = lambda a: np.ascontiguousarray(a, np.int32).tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, part in bpe.slices(texts, SEGMENT_BYTES):
                flat, per_text = cutter(part)
                coded = flat.dictionary_encode()
                local = np.fromiter((terms.get(w, -1) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
                term = local[coded.indices.to_numpy()] if len(local) else np.zeros(0, np.int32)
                room = per_text + gap
                starts = np.cumsum(room) - room
                place = np.arange(len(term)) + np.repeat(starts - (np.cumsum(per_text) - per_text), per_text)
                kept = term >= 0
                term, place = term[kept], place[kept]
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                present, first, counts = np.unique(term, return_index=True, return_counts=True)
                step = np.diff(place, prepend=0)
                step[first] = place[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([keys.slice(at, len(part)).to_pylist()], pa.list_(keys.type)), *(pa.array([pack(x)], pa.binary()) for x in (starts, present)), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([pack(step)], pa.binary()), pa.array([present.tolist()], pa.list_(pa.int32()))],
                    ["segment", "keys", "starts", "present", "counts", "places", "terms"],
                )

    rows = corpus.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(run, f"segment string, keys array<{kind}>, starts binary, present binary, counts array<long>, places binary, terms array<int>")


def anchors(item: np.ndarray, rarity: np.ndarray, least: int) -> list[int]:
    """Positions of the rarest word of each run of ``least`` words."""
    weight = rarity[item]
    return sorted({s + int(np.argmin(weight[s : s + least])) for s in range(len(item) - least + 1)})


def _unpack(batch: pa.RecordBatch, row: int) -> tuple[pa.Scalar, np.ndarray, dict[int, np.ndarray]]:
    """A segment's keys, first places of its texts and posting lists by term."""
    keys, starts, present, counts, places = (batch.column(c)[row] for c in range(5))
    starts, present, step = (np.frombuffer(x.as_py(), np.int32) for x in (starts, present, places))
    counts = np.array(counts.as_py(), np.int64)
    if not len(step):
        return keys, starts, {}
    ends, total = np.cumsum(counts), np.cumsum(step.astype(np.int64))
    posting = total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), counts)
    return keys, starts, {int(t): posting[e - c : e] for t, e, c in zip(present, ends, counts)}


def _windows(item: np.ndarray, rarity: np.ndarray, least: int, share: float) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Windows of ``least`` words, a stretch of the item at a time: (terms from the rarest on, masks by 64 terms and window, words needed by window, anchors).

    A window of n words that needs m of them can miss n - m, so that of its n - m + 1 rarest one
    must be there: these are its anchors. Words that the corpus doesn't hold are the rarest.
    """
    width = max(STRETCH, 2 * least)
    for at in range(0, len(item) - least + 1, width - least + 1):
        terms, local = np.unique(item[at : at + width], return_inverse=True)
        order = np.argsort(rarity[terms], kind="stable")
        terms, local = terms[order], np.argsort(order)[local]
        runs = np.sort(np.lib.stride_tricks.sliding_window_view(local, least), axis=1)
        runs = runs[terms[runs[:, -1]] != len(rarity) - 1]  # none reaches from one text of a key into the next
        if not len(runs):
            continue
        new = np.diff(runs, axis=1, prepend=-1) > 0
        distinct = new.sum(axis=1)
        needed = np.maximum(np.ceil(share * distinct).astype(np.int64), 1)
        anchor = np.unique(runs[new & (new.cumsum(axis=1) <= (distinct - needed + 1)[:, None])])
        bit = np.uint64(1) << (runs & 63).astype(np.uint64)
        masks = [np.bitwise_or.reduce(np.where(runs >> 6 == lane, bit, np.uint64(0)), axis=1) for lane in range(-(-len(terms) // 64))]
        yield terms, masks, needed, terms[anchor]


def _held(term: np.ndarray, begin: np.ndarray, length: int, bits: list[np.ndarray]) -> list[np.ndarray]:
    """Bits of the terms at ``length`` places from each of ``begin`` on."""
    held = [np.zeros(len(begin), np.uint64) for _ in bits]
    for k in range(length):
        here = term[begin + k]
        for h, b in zip(held, bits):
            h |= b[here]
    return held


def _count(held: list[np.ndarray], mask: list[np.uint64]) -> np.ndarray:
    return np.sum([np.bitwise_count(h & m) for h, m in zip(held, mask)], axis=0, dtype=np.int64)


def _near(segments: DataFrame, kind: str, items: dict, rarity: np.ndarray, least: int, share: float, slack: int) -> DataFrame:
    """(k, item, words): most distinct words of a window of an item that stand in one span of ``slack`` places (``least``, if more)."""
    span = max(slack, least)
    pad = span - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: list[np.ndarray] = []
        for batch in batches:
            for row in range(batch.num_rows):
                keys, starts, lists = _unpack(batch, row)
                best: dict[tuple[int, int], int] = {}
                top = max((int(x[-1]) for x in lists.values()), default=0)
                term = np.full(top + 1 + 2 * pad, len(rarity), np.int32)  # with ``pad`` empty places before and behind
                for t, places in lists.items():
                    term[places + pad] = t
                for item_id, item in items.items():
                    for terms, masks, needed, anchored in _windows(item, rarity, least, share):
                        here = [lists[t] for t in anchored.tolist() if t in lists]
                        if not here:
                            continue
                        while len(bits) < len(masks):
                            bits.append(np.zeros(len(rarity) + 1, np.uint64))
                        own = bits[: len(masks)]
                        for lane, b in enumerate(own):
                            part = terms[64 * lane : 64 * lane + 64]
                            b[part] = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
                        every, fewest = [np.bitwise_or.reduce(m) for m in masks], needed.min()
                        here = np.concatenate(here)
                        for at in range(0, len(here), PLACES):
                            # spans are told by their last place, which lies in the text or in the gap behind it
                            around = here[at : at + PLACES]
                            around = around[_count(_held(term, around, 2 * pad + 1, own), every) >= fewest]
                            last = np.unique(around[:, None] + np.arange(span))
                            held = _held(term, last, span, own)
                            enough = _count(held, every) >= fewest
                            last, held = last[enough], [h[enough] for h in held]
                            most = np.zeros(len(last), np.int64)
                            for w, least_words in enumerate(needed.tolist()):
                                count = _count(held, [m[w] for m in masks])
                                np.maximum(most, count, out=most, where=count >= least_words)
                            last, most = last[most > 0], most[most > 0]
                            if len(last):
                                docs, first = np.unique(np.searchsorted(starts, last, "right") - 1, return_index=True)
                                for doc, n in zip(docs.tolist(), np.maximum.reduceat(most, first).tolist()):
                                    best[doc, item_id] = max(best.get((doc, item_id), 0), n)
                        for b in own:
                            b[terms] = 0
                if best:
                    yield pa.RecordBatch.from_arrays([keys.values.take(pa.array([d for d, _ in best])), pa.array([i for _, i in best]), pa.array(list(best.values()), pa.int32())], ["k", "item", "run"])

    return segments.select("keys", "starts", "present", "counts", "places").mapInArrow(run, f"k {kind}, item long, run int")


def _search(segments: DataFrame, kind: str, items: dict, rarity: np.ndarray, least: int) -> DataFrame:
    """(k, item, run): longest runs of consecutive words, of at least ``least``."""
    by_word: dict[int, list[tuple[object, np.ndarray, int]]] = {}  # the anchors of each word
    for i, item in items.items():
        for at in anchors(item, rarity, least):
            by_word.setdefault(int(item[at]), []).append((i, item, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, starts, lists = _unpack(batch, row)
                best: dict[tuple[int, object], int] = {}
                for word, posting in lists.items():
                    for item_id, item, at in by_word.get(word, ()):
                        begin = posting - at  # where the item's first word would stand
                        run_right, alive = np.ones(len(begin), np.int64), np.ones(len(begin), bool)
                        for direction in (1, -1):
                            alive[:] = True
                            j = at + direction
                            while 0 <= j < len(item) and alive.any():
                                other = lists.get(int(item[j]))
                                if other is None:
                                    break
                                want = begin[alive] + j
                                found = np.searchsorted(other, want)
                                hit = other[np.minimum(found, len(other) - 1)] == want
                                alive[np.flatnonzero(alive)[~hit]] = False
                                run_right[alive] += 1
                                j += direction
                        for k in np.flatnonzero(run_right >= least).tolist():
                            doc = int(np.searchsorted(starts, begin[k] + at, "right")) - 1
                            best[doc, item_id] = max(best.get((doc, item_id), 0), int(run_right[k]))
                if best:
                    docs = pa.array([d for d, _ in best])
                    yield pa.RecordBatch.from_arrays([keys.values.take(docs), pa.array([i for _, i in best]), pa.array(list(best.values()), pa.int32())], ["k", "item", "run"])

    return segments.select("keys", "starts", "present", "counts", "places").mapInArrow(run, f"k {kind}, item long, run int")


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, near: tuple[float, int] | None = None) -> DataFrame:
    """(key, item_key, words): texts that hold at least ``least`` consecutive words of an item.

    ``words`` is the longest such run. With ``near`` = (share, slack) instead texts that hold that
    share of the distinct words of a run of ``least`` words of an item, whichever they are, in any
    order within one span of ``slack`` places (of ``least``, if that is more); ``words`` is their
    highest number. Words are the longest runs of letters and digits in lower case, whatever stands
    between them. One row for each pair of keys: rows that repeat a key count
    as one text each and give one row. Null, empty or blank texts and items, items of fewer than
    ``least`` words and rows without a key match nothing; an empty table on either side gives an
    empty result; further columns don't matter. item_key must be a whole number.

    The items are the query set and are held by each task, in blocks of at most BLOCK_BYTES whose
    number follows their measured size. The corpus is cut into words and indexed once for as many
    blocks as have INDEX_WORDS distinct words, and never shuffled; each block is searched by itself.
    """
    chosen = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).dropna()
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks, kind = max(1, -(-int(size) // BLOCK_BYTES)), dict(corpus.dtypes)[key]
    cutter, gap = Cutter(), max(least, near[1] if near else 0) + 1

    def of_block(b: int, terms: dict[str, int]) -> dict[int, np.ndarray]:
        """The items of a block as numbers of their words, which are added to ``terms``."""
        inside: Column = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b
        cut: dict[int, list[np.ndarray]] = {}
        rows = chosen.filter(inside).toLocalIterator()
        while part := list(islice(rows, 1000)):
            flat, counts = cutter(pa.array([r["t"] for r in part], pa.string()))
            words, ends = flat.to_pylist(), np.cumsum(counts).tolist()
            for r, n, end in zip(part, counts.tolist(), ends):
                if n >= least:
                    cut.setdefault(r["i"], []).append(np.array([terms.setdefault(x, len(terms)) for x in words[end - n : end]], np.int32))
        # items of one key stand behind one another, parted by a word that occurs nowhere
        return {i: np.concatenate([x for part in parts for x in ([_PARTING], part)][1:]).astype(np.int32) for i, parts in cut.items()}

    found, b = [], 0
    while b < blocks:
        terms: dict[str, int] = {}
        first = b
        while b < blocks and len(terms) < INDEX_WORDS:
            joined = of_block(b, terms)
            b += 1
        segments = durable(index(corpus, key, text, terms, gap))
        counts = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("z")).groupBy("z.terms").agg(F.sum("z.counts").alias("n")).collect()
        rarity = np.zeros(len(terms) + 1, np.int64)
        rarity[-1] = np.iinfo(np.int64).max
        for r in counts:  # at most one row for each word of the items
            rarity[r["terms"]] = r["n"]
        for block in range(first, b):
            own = joined if b - first == 1 else of_block(block, terms)
            own = {i: np.where(item == _PARTING, len(terms), item).astype(np.int32) for i, item in own.items()}
            part = _near(segments, kind, own, rarity, least, *near) if near else _search(segments, kind, own, rarity, least)
            part = part.groupBy("k", "item").agg(F.max("run").alias("words"))
            found.append(part if blocks == 1 else durable(part))
    return reduce(DataFrame.unionByName, found).groupBy("k", "item").agg(F.max("words").alias("words")).select(F.col("k").alias(key), F.col("item").alias(item_key), "words")

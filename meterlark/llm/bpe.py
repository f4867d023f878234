"""Byte-level BPE as DuckDB recursive queries over token-position rows.

A text is cut into words by the vocabulary's word pattern, distinct words are encoded once per
worker process, and the texts' ids are put together from the words' ids.

Encoding a set of words is one recursive query: a row holds (word, position, token, next position);
each round joins neighbouring rows with the merge table, contracts every word's leftmost pair of
least rank and stops when no word has a pair left (fixpoint); an ordered aggregation by position
then reads off each word's ids.

Words beyond ``LONG`` bytes take a second recursive query, whose rounds contract every pair of which
it is sure that nothing can come before it, so that their number doesn't grow with the word. A pair
of rank r is sure on its left if no token that can come to stand there (one whose last constituent
is the present neighbour) merges with it at a rank below r, or if all pairs as far back as the
longest token reaches have no lower rank; likewise on its right. Equal pairs that overlap, as in a
run of one letter, are taken alternately from the left. The pair of least rank of all is always
sure, so every round makes progress, and the ids are those of contracting one pair at a time.

Words beyond ``WINDOW`` bytes are encoded in overlapping windows. Every two neighbouring tokens of
an encoding are the encoding of their own bytes, and any row of tokens of which this holds is the
encoding of the whole; so two windows join at a token that both have. Where they share none, they
are encoded again as one, or, beyond ``WIDEST``, the second from where a token of the first begins.
Memory is that of a query over some windows, whatever the length of a word.

Strings that look like special tokens are ordinary text. An empty text has no ids, null stays null.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as a character class without its brackets. RE2's own \s knows ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Marks where a run of white space gives its last character to the word behind it (RE2 has no
#: look-ahead). A noncharacter; texts that hold it anyway go another way.
MARK = "﷐"
WORDS = rf"'(?:[stmd]|re|ve|ll)| ?\pL+| ?\pN+| ?[^{SPACE}\pL\pN{MARK}]+|[{SPACE}]+"
#: The same cut for the `regex` module, which has look-ahead: for texts with MARK or characters whose class RE2 may not know.
EXACT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Characters outside these ranges are cut by the `regex` module: RE2's tables may be older than the vocabulary's.
USUAL = r"\x{0}-\x{52F}\x{2000}-\x{206F}\x{3000}-\x{9FEF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}"
WORDS_SQL = f"""
SELECT CASE WHEN t IS NULL THEN [] WHEN regexp_matches(t, '[^{USUAL}]') THEN NULL
            WHEN regexp_matches(t, '[{SPACE}][{SPACE}]') THEN regexp_extract_all(regexp_replace(t, '([{SPACE}])([{SPACE}][^{SPACE}])', '\\1{MARK}\\2', 'g'), '{WORDS.replace("'", "''")}')
            ELSE regexp_extract_all(t, '{WORDS.replace("'", "''")}') END AS w
FROM texts
"""
LONG = 64
#: Bytes of a window of a long word, those that two windows share, and those up to which windows grow together.
WINDOW, SHARED, WIDEST = 2048, 256, 1_000_000
#: Bytes of windows in one query.
QUERY_BYTES = 300_000
#: Characters from which on a text is worked through in parts.
PART = 4_000_000
#: Distinct words kept per worker process before the store begins anew; it bounds memory, not results.
KEPT_WORDS = 400_000

SHORT_SQL = """
WITH RECURSIVE step(word, pos, tok, nxt, round) AS (
    SELECT word, pos, tok, nxt, 0 FROM seed
    UNION ALL
    SELECT s.word, s.pos,
           CASE WHEN s.pos = b.best.pos THEN b.best.made ELSE s.tok END,
           CASE WHEN s.pos = b.best.pos THEN b.best.after ELSE s.nxt END,
           s.round + 1
    FROM step s JOIN (
        SELECT x.word, min({'rank': m.rank, 'pos': x.pos, 'gone': y.pos, 'after': y.nxt, 'made': m.made}) AS best
        FROM step x JOIN step y ON x.nxt = y.pos JOIN merges m ON m.l = x.tok AND m.r = y.tok
        GROUP BY x.word
    ) b ON s.word = b.word
    WHERE s.pos <> b.best.gone
)
"""
LONG_SQL = """
WITH RECURSIVE step(word, pos, tok, round) AS (
    SELECT word, pos, tok, 0 FROM seed
    UNION ALL
    SELECT word, pos, CASE WHEN taken THEN made ELSE tok END, round + 1
    FROM (
        SELECT word, pos, tok, made, round, taken, lag(taken, 1, false) OVER w AS gone, max(taken) OVER (PARTITION BY word) AS live
        FROM (
            -- within a run of one token the pairs at even distance from its first are taken, if its ends are sure
            SELECT *, rank IS NOT NULL
                      AND (n - (max(CASE WHEN opens THEN 2 * n + left_sure::INT END) OVER w) // 2) % 2 = 0
                      AND (max(CASE WHEN opens THEN 2 * n + left_sure::INT END) OVER w) % 2 = 1
                      AND (min(CASE WHEN closes THEN 2 * n + right_sure::INT END) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) % 2 = 1 AS taken
            FROM (
                SELECT p.*, m.rank, m.made,
                       prev IS DISTINCT FROM tok OR tok IS DISTINCT FROM nxt AS opens,
                       tok IS DISTINCT FROM nxt OR nxt IS DISTINCT FROM after AS closes,
                       coalesce(coalesce(a.rank, 2147483647) > m.rank OR min(m.rank) OVER (PARTITION BY p.word ORDER BY p.pos RANGE BETWEEN {far} PRECEDING AND CURRENT ROW) = m.rank, false) AS left_sure,
                       coalesce(coalesce(b.rank, 2147483647) >= m.rank OR min(m.rank) OVER (PARTITION BY p.word ORDER BY p.pos RANGE BETWEEN CURRENT ROW AND {far} FOLLOWING) = m.rank, false) AS right_sure
                FROM (SELECT *, row_number() OVER w AS n, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS after FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)) p
                LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
                LEFT JOIN from_left a ON a.s = p.prev AND a.t = p.tok
                LEFT JOIN from_right b ON b.t = p.nxt AND b.u = p.after
            ) WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) WINDOW w AS (PARTITION BY word ORDER BY pos)
    ) WHERE live AND NOT gone
)
"""
#: The ids of each word by position, of its last round.
READ_SQL = """
SELECT s.word, list(s.tok ORDER BY s.pos) AS ids
FROM step s JOIN (SELECT word, max(round) AS last FROM step GROUP BY word) f ON s.word = f.word AND s.round = f.last
GROUP BY s.word ORDER BY s.word
"""
#: Where a word surely begins: at a blank or line feed behind something else.
_BREAK = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files of byte-level BPE write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Encodes batches of texts by the vocabulary file at ``path`` (the JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.first = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        #: Bytes of each token: in the file a letter stands for a byte.
        self.token_size = np.zeros(max(vocab.values()) + 1, np.int64)
        self.token_bytes: list[bytes] = [b""] * len(self.token_size)
        for token, i in vocab.items():
            self.token_size[i] = len(token)
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = pa.table({"l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "made": pa.array([vocab[a + b] for a, b in pairs], pa.int32())})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.long_sql = LONG_SQL.format(far=2 * int(self.token_size.max()))
        # the least rank at which a token whose last constituent is s merges with t, and at which t merges with one whose first is u
        parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        sides: list[dict[tuple[int, int], int]] = [{}, {}]
        for rank, (a, b) in enumerate(pairs):
            for side, t in ((1, vocab[a]), (0, vocab[b])):
                while True:
                    sides[1 - side].setdefault((t, vocab[b]) if side else (vocab[a], t), rank)
                    if t not in parts:
                        break
                    t = parts[t][side]
        for name, (x, y), found in (("from_left", "st", sides[0]), ("from_right", "tu", sides[1])):
            self.db.register("side", pa.table({x: pa.array([k[0] for k in found], pa.int32()), y: pa.array([k[1] for k in found], pa.int32()), "rank": pa.array(list(found.values()), pa.int32())}))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM side")
            self.db.unregister("side")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.pool, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after another, and the number of words of each text (0 for null)."""
        self.db.register("texts", pa.table({"t": texts}))
        rows = self.db.sql(WORDS_SQL).to_arrow_table()
        self.db.unregister("texts")
        col = rows["w"].combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.string()))
        if col.null_count:
            import regex

            cut, odd = regex.compile(EXACT), np.flatnonzero(np.asarray(pc.is_null(col)))
            other = pa.array([cut.findall(t) for t in texts.take(pa.array(odd)).to_pylist()], col.type)
            place = np.arange(len(col))
            place[odd] = len(col) + np.arange(len(odd))
            col = pa.concat_arrays([col, other]).take(pa.array(place))
        return col.flatten(), np.asarray(pc.list_value_length(col)).astype(np.int64)

    def _contract(self, sql: str, raw: list[bytes], most: int) -> list[np.ndarray]:
        """The ids of each string of bytes by itself, queried in runs of about ``most`` bytes."""
        size = np.array([len(b) for b in raw], np.int64)
        out: list[np.ndarray] = []
        run = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(raw)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            data = np.frombuffer(b"".join(raw[x:y]), np.uint8)
            pos = np.arange(len(data), dtype=np.int32)
            nxt = pos + 1
            nxt[np.cumsum(size[x:y]) - 1] = -1
            self.db.register("seed", pa.table({"word": np.repeat(np.arange(y - x, dtype=np.int32), size[x:y]), "pos": pos, "tok": self.first[data], "nxt": nxt}))
            ids = self.db.sql(sql + READ_SQL).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("seed")
            if isinstance(ids, pa.ChunkedArray):
                ids = pa.concat_arrays(ids.chunks)
            flat, offsets = ids.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
            out += [flat[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return out

    def _windows(self, raw: bytes) -> np.ndarray:
        """The ids of a word of more than a window."""
        spans = [(a, min(a + WINDOW, len(raw))) for a in range(0, max(1, len(raw) - SHARED), WINDOW - SHARED)]
        ids = self._contract(self.long_sql, [raw[a:b] for a, b in spans], QUERY_BYTES)
        while True:
            starts = [np.concatenate([[a], a + np.cumsum(self.token_size[i])]) for (a, _), i in zip(spans, ids)]
            joints, again = [], False
            for left, right in zip(range(len(spans)), range(1, len(spans))):
                # a token both have begins and ends at the same bytes
                x, y = starts[left], starts[right]
                common, i, j = np.intersect1d(x[:-1], y[:-1], assume_unique=True, return_indices=True)
                same = np.flatnonzero(x[i + 1] == y[j + 1])
                joints.append((int(i[same[len(same) // 2]]), int(j[same[len(same) // 2]])) if len(same) else None)
                again = again or not len(same)
            if not again:
                begin, out = 0, []
                for k, joint in enumerate([*joints, (len(ids[-1]), 0)]):
                    out.append(ids[k][begin : joint[0]])
                    begin = joint[1]
                return np.concatenate(out)
            new: list[tuple[int, int]] = []
            known: list[np.ndarray | None] = []
            for k, (a, b) in enumerate(spans):
                fails = k > 0 and joints[k - 1] is None
                if fails and (b - new[-1][0] <= WIDEST or known[-1] is None or a in starts[k - 1]):
                    new[-1], known[-1] = (new[-1][0], b), None
                elif fails:  # from where the token behind the middle of what both share begins
                    new.append((int(starts[k - 1][np.searchsorted(starts[k - 1], a)]), b))
                    known.append(None)
                else:
                    new.append((a, b))
                    known.append(ids[k])
            todo = [k for k, i in enumerate(known) if i is None]
            for k, i in zip(todo, self._contract(self.long_sql, [raw[new[k][0] : new[k][1]] for k in todo], QUERY_BYTES)):
                known[k] = i
            spans, ids = new, known

    def _learn(self, new: list[str]) -> None:
        """Encodes words not met before and stores their ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.array([len(b) for b in raw], np.int64)
        out: list[np.ndarray | None] = [None] * len(new)
        for sql, which, most in ((SHORT_SQL, size <= LONG, 1_000_000), (self.long_sql, (size > LONG) & (size <= WINDOW), QUERY_BYTES)):
            for i, ids in zip(np.flatnonzero(which).tolist(), self._contract(sql, [raw[i] for i in np.flatnonzero(which)], most)):
                out[i] = ids
        for i in np.flatnonzero(size > WINDOW).tolist():
            out[i] = self._windows(raw[i])
        counts = np.array([len(o) for o in out], np.int64)
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.start = np.concatenate([self.start, self.filled + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)])
        self.count = np.concatenate([self.count, counts])
        self.filled += len(flat)
        base = len(self.known)
        for k, w in enumerate(new):
            self.known[w] = base + k

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (0 for null)."""
        return self.encode_words(texts)[:2]

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and whether each id begins a word."""
        if (np.asarray(pc.fill_null(pc.binary_length(texts), 0)) > PART).any():
            return self._in_parts(texts)
        return self._whole(texts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, per_text = self.words(texts)
        if len(self.known) > KEPT_WORDS:
            self.forget()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [w for w in names if w not in self.known]
        if new:
            self._learn(new)
        if not names:
            return np.zeros(0, np.int32), np.zeros(len(per_text), np.int64), np.zeros(0, bool)
        local = np.fromiter((self.known[w] for w in names), np.int64, len(names))
        word = local[coded.indices.to_numpy()]
        count = self.count[word]
        ends = np.cumsum(count)
        where = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(self.start[word] - (ends - count), count)
        text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
        begins = np.zeros(int(ends[-1]), bool)
        begins[ends - count] = True
        return self.pool[where], np.diff(np.concatenate([[0], text_ends])), begins


    def _in_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode_words``, with long texts cut where a word begins, so that a text's words are never all in memory."""
        parts, owner = [], []
        for i, t in enumerate(texts.to_pylist()):
            at = 0
            while t is not None and (m := _BREAK.search(t, at + PART // 4)):
                parts.append(t[at : m.start()])
                owner.append(i)
                at = m.start()
            parts.append(t if t is None else t[at:])
            owner.append(i)
        done = [self._whole(part) for _, part in slices(pa.array(parts, pa.string()), PART)]
        ids, sizes, begins = (np.concatenate(x) for x in zip(*done))
        return ids, np.bincount(owner, sizes, len(texts)).astype(np.int64), begins

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; of a text's ids, its UTF-8."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most_bytes: int = 6_000_000):
    """Cuts a batch of texts into runs of about ``most_bytes``, at least one text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    run = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)

import base64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from meterlark.llm import bpe, encode, split

PATH = encode.vocabulary()
ODD = ["", " ", "\n", "a  b\n\n c \t ", "  lead", "trail  ", "x y", "　z", "😀😀 hi", "<|endoftext|> a", "aaa" * 300, "'s 'S it's", "½² Ⅷ", "x" * 3000 + "  ", " " * 50 + "a", "﷐ q  r", "a\x1c\x1cb", "𝒜𝒷 12", "é niño", "汉字" * 200, "\r\n\r\nq", "don't we'll I'M"]


@pytest.fixture(scope="module")
def truth():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids_of(texts):
    ids, sizes = bpe.encoder(PATH).encode(pa.array(texts, pa.string()))
    off = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


def test_odd_texts(truth):
    assert ids_of(ODD) == [truth(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z1'st\n\t.é汉😀　-"), max_size=30), max_size=5))
def test_any_text(truth, texts):
    assert ids_of(texts) == [truth(t) for t in texts]


def test_store_begins_anew(truth, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for t in ("one two three four", "five six one", "one"):
        assert ids_of([t]) == [truth(t)]


LETTERS = ["ab", "aab", "abcdefghijklmnopqrstuvwxyz", "-=", "汉字あ", "ÃÂ", "ha", "😀é"]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(LETTERS), st.integers(65, 6000), st.integers(0, 10**6))
def test_long_words(truth, letters, n, seed):
    rng = np.random.default_rng(seed)
    word = "".join(np.array(list(letters))[rng.integers(0, len(letters), n)])
    assert ids_of([word, word[: n // 2]]) == [truth(word), truth(word[: n // 2])]


@pytest.mark.parametrize("word", ["あ" * 30_000, "haha" * 9_000, "x" * 50_001, "abcabcabd" * 4_000, "汉字" * 9_001])
@pytest.mark.parametrize("widest", [1_000_000, 5_000])
def test_windows_without_a_common_token(truth, monkeypatch, word, widest):
    monkeypatch.setattr(bpe, "WIDEST", widest)
    assert bpe.encoder(PATH)._windows(word.encode()).tolist() == truth(word)


def test_a_word_of_many_windows(spark):
    rng = np.random.default_rng(4)
    word = rng.choice(np.frombuffer("abcdefghijklmnopqrstuvwxyz".encode(), np.uint8), 150_000).tobytes().decode()
    df = spark.createDataFrame([(1, word), (2, "汉" * 200_000), (3, None), (4, "")], "k long, t string")
    ids = encode.encode(df, "k", "t", PATH)
    assert {r["k"]: r["t"] for r in encode.decode(ids, "k", "ids", PATH, "t").collect()} == {r["k"]: r["t"] for r in df.collect()}


def test_texts_in_parts(truth, monkeypatch):
    texts = ["one  two\n\nthree 'tis don't " * 40, None, "short", "", "x" * 300 + " y", "a\u00a0 b \n c" * 60]
    whole = ids_of(texts)
    monkeypatch.setattr(bpe, "PART", 64)
    assert ids_of(texts) == whole == [[] if t is None else truth(t) for t in texts]


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    back = encode.decode(encode.encode(docs, "doc_id", "text", PATH), "doc_id", "ids", PATH)
    assert docs.exceptAll(back).isEmpty() and back.count() == docs.count()


def test_corpus(spark, data, truth):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(docs, "doc_id", "text", PATH).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (None if r["text"] is None else truth(r["text"]))


def test_encode_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, None, 7), (3, "", 8)], "k long, t string, ids int")
    assert sorted(map(str, encode.encode(df, "k", "t", PATH).collect())) == sorted(["Row(k=1, ids=[64])", "Row(k=1, ids=[64])", "Row(k=2, ids=None)", "Row(k=3, ids=[])"])
    assert encode.encode(df.limit(0), "k", "t", PATH).count() == 0


def whole(rows, text, truth, most=1024, overlap=64):
    raw = text.encode()
    assert rows[0].from_byte == 0 and rows[-1].to_byte == len(raw)
    for r in rows:
        assert raw[r.from_byte : r.to_byte].decode() == r.piece and len(truth(r.piece)) == r.n_tokens <= most and r.n_pieces == len(rows)
    for a, b in zip(rows, rows[1:]):
        assert b.piece_no == a.piece_no + 1 and a.from_byte < b.from_byte < a.to_byte < b.to_byte
        assert 0 < len(truth(raw[b.from_byte : a.to_byte].decode())) <= overlap


def test_pieces(spark, data, truth):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out: dict = {}
    for r in split.pieces(docs, "doc_id", "text", PATH).orderBy("doc_id", "piece_no").collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == {k for k, t in texts.items() if t and len(truth(t)) > 1024}
    for k, rows in out.items():
        whole(rows, texts[k], truth)


@pytest.mark.parametrize("text", ["x" * 9000, "汉" * 3000, "😀" * 1500, "a b " * 2000, "\n" * 4000 + "end", "word. " * 1500, "ab1-" * 3000, " " * 6000 + "z"])
def test_texts_without_paragraphs(spark, truth, text):
    df = spark.createDataFrame([(1, text, "no")], "k long, t string, piece string")
    rows = split.pieces(df, "k", "t", PATH).orderBy("piece_no").collect()
    if len(truth(text)) > 1024:
        whole(rows, text, truth)
    else:
        assert not rows


def test_pieces_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "short")], "k long, t string")
    assert split.pieces(df, "k", "t", PATH).count() == 0 and split.pieces(df.limit(0), "k", "t", PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=40, max_size=200), st.data())
def test_range_maximum(values, data):
    v = np.array(values, np.int64) * split._STEP + np.arange(len(values))
    width = data.draw(st.integers(1, 33))
    left = data.draw(st.integers(0, len(values) - width))
    assert split.RangeMax(v, [width]).best(left, left + width - 1) == v[left : left + width].max()


def test_strengths():
    text = "One, two. Three\nfour\n\nfive。six"
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(1, len(raw) + 1)
    s = dict(zip(at.tolist(), split.strengths(raw, at).tolist()))
    assert [s[4], s[9], s[16], s[22], s[29], s[28], s[2], s[5]] == [3, 4, 5, 6, 4, 0, 1, 2]


class Worst:
    """An encoder for which a span by itself has as many tokens as bytes, if it holds an x."""

    def encode(self, texts):
        return None, np.array([len(t.encode()) if "x" in t else -(-len(t.encode()) // 4) for t in texts.to_pylist()])


@pytest.mark.parametrize("raw", ["x" * 4000, "abcd" * 300 + "x" * 400 + "abcd" * 300, "é" * 800 + "xxxx" + "😀" * 500])
def test_pieces_that_grow_when_cut(raw):
    data = raw.encode()
    n = len(data) // 4
    t = split._Text(0, data, np.zeros(n, np.int32), np.zeros(n, bool), np.array([4]), 64, 8)
    split._settle(Worst(), [t], 64, 8)
    texts = [data[slice(*t.bytes_of(s))].decode() for s in t.spans]
    assert Worst().encode(pa.array(texts))[1].tolist() == t.sizes
    assert max(t.sizes[: len(t.parts)]) <= 64 and max(t.sizes[len(t.parts) :]) <= 8
    places = [t.bytes_of(p) for p in t.parts]
    assert places[0][0] == 0 and places[-1][1] == len(data)
    assert all(a[0] < b[0] < a[1] < b[1] for a, b in zip(places, places[1:]))


def test_count_bytes():
    t = split._Text(0, b"one two", np.array([0, 1, 2]), np.array([True, True, False]), np.array([3, 2, 2]), 8, 4)
    t.count_bytes([(1, 2)])
    assert t.ends.tolist() == [3, 4, 5, 7] and t.begins.tolist() == [True, True, False, False] and t.offset.tolist() == [0, 3, 4, 5, 7]

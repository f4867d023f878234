"""Problem 7: every text of a corpus as its list of token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterlark.llm import bpe


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, which must lie at the same place on all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(df: DataFrame, key: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """(key, out): ids of ``text`` by the byte-level BPE at ``path``, without special tokens.

    One narrow stage: no shuffle, one pass over the two columns read. See ``bpe`` for the method.
    Each row of ``df`` gives a row, whatever its other columns are called; repeated rows repeat.
    null gives null, the empty text the empty list, blank text the ids of its blanks. Very long
    texts are encoded whole, also those without any blank: texts in parts that begin with a word,
    words in windows, see ``bpe``. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, part in bpe.slices(texts):
                ids, sizes = e.encode(part)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pc.is_null(part))], ["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), F.col("ids").alias(out))


def decode(df: DataFrame, key: str, ids: str, path: str, out: str = "text") -> DataFrame:
    """(key, out): the texts of lists of ids; null stays null, the empty list gives the empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path)
        for batch in batches:
            texts = [None if x is None else e.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    rows = df.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("i"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, t string").select(F.col("k").alias(key), F.col("t").alias(out))

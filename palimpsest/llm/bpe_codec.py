"""Operator 4, BPE encoding and decoding: a contiguous array of boundaries and adjacent ranks for each short word.

The array is scanned for its least rank, that boundary is deleted and the neighbouring ranks refreshed. Scanning is quadratic
in a word's length, so words of over 256 bytes are merged by a heap, which gives the same ids.

Null text encodes as empty: no ids, empty decoded text. Rows may repeat. A column named like an output is replaced. Null ids
decode to null. Bytes that are not UTF-8 decode to U+FFFD. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import SPACE, byte_letters, heap_merges, load, scan_merges
from palimpsest.llm.common import Memo, each, give_back

PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + "]+(?![^" + SPACE + "])|[" + SPACE + "]+")
SHORT = 256


class Codec:
    def __init__(self, path: str):
        spec = load(path)
        letters = byte_letters()
        self.first, self.merges = [spec["vocab"][c] for c in letters], spec["merges"]
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [b""] * (1 + max(chain(spec["vocab"].values(), spec["added"].values())))
        for token, i in spec["vocab"].items():
            self.bytes_of[i] = bytes(back[c] for c in token) if token not in spec["added"] else token.encode()
        for token, i in spec["added"].items():
            self.bytes_of[i] = token.encode()
        self.added = spec["added"]
        marks = sorted(self.added, key=len, reverse=True)
        self.mark = regex.compile(f"({'|'.join(map(regex.escape, marks))})") if marks else None
        self.pieces = Memo(self.of_piece, 50_000)  # in a worker that goes on to other stages too

    def of_piece(self, piece: str) -> tuple[int, ...]:
        symbols = [self.first[b] for b in piece.encode()]
        return tuple(scan_merges(symbols, self.merges) if len(symbols) <= SHORT else heap_merges(symbols, self.merges)[1])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.mark and any(mark in text for mark in self.added):
            parts = self.mark.split(text)  # texts and special tokens in turn
            return [i for k, part in enumerate(parts) for i in ([self.added[part]] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, PIECE.findall(text))))

    def decode(self, ids) -> str | None:
        return None if ids is None else b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>; path: a byte-level BPE file that every executor can read."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _lists([np.array(codec(path).encode(t), np.int32) for t in each(texts)])

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of a column of ids, special tokens included."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        return pa.array(map(codec(path).decode, each(rows)), pa.string())

    return texts(ids)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids (array<int>) and decoded (the text of these ids), from one pass over the rows."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(path)
        rows, back = [], []
        for t in each(texts):
            ids = c.encode(t)
            rows.append(np.array(ids, np.int32))
            back.append(c.decode(ids))
        out = pa.StructArray.from_arrays([_lists(rows), pa.array(back, pa.string())], ["ids", "decoded"])
        del rows, back
        give_back()
        return out

    return df.withColumn("__bpe", both(F.col(text))).withColumn("ids", F.col("__bpe.ids")).withColumn("decoded", F.col("__bpe.decoded")).drop("__bpe")

"""Operator 1, token counts: byte-pair merging by a heap over a linked list; no identifiers are emitted.

A word's count is its number of initial symbols less its merges. Words between white space are counted once per worker and
remembered; Spark deals the rows out, and nothing is shuffled.

A text of any length is read whole; words over 64 characters are counted anew each time. Null text counts as empty: 0 bytes, 0 tokens. Rows may repeat; each gets its own count. A column named like an output is
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import SPACE, byte_letters, heap_merges, load
from palimpsest.llm.common import Memo, each

#: Control characters at which Python's str.split() cuts, though they are not white space to the tokenizer.
ODD = regex.compile("[\x1c-\x1f]")
BLANK = regex.compile(f"[{SPACE}]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")


class Counter:
    """Counts the tokens of texts by one tokenizer file."""

    def __init__(self, path: str):
        spec = load(path)
        letters = [spec["vocab"][c] for c in byte_letters()]
        self.inner, self.merges = letters, spec["merges"]
        self.last = [spec["vocab"][c + spec["suffix"]] for c in byte_letters()]
        added = sorted(spec["added"], key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.marks = added
        self.words, self.pieces = Memo(self.of_word), Memo(self.of_piece)

    def of_word(self, word: str) -> int:
        """Tokens of a text that has no white space."""
        plain = word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word)))
        return sum(map(self.pieces.__getitem__, PIECE.findall(plain)))

    def of_piece(self, piece: str) -> int:
        data = piece.encode()
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return len(symbols) - heap_merges(symbols, self.merges)[0]

    def plain(self, text: str) -> int:
        words = [w for w in BLANK.split(text) if w] if ODD.search(text) else text.split()
        return sum(map(self.words.__getitem__, words))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(mark in text for mark in self.marks):
            parts = self.added.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column as a bigint column; path: a word-level BPE file that every executor can read."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(map(counter(path), each(texts)), pa.int64())

    return count(text)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", n_tokens(F.col(text), path)).withColumn("over_limit", F.col("n_tokens") > limit)

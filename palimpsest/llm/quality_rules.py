"""Operator 5, quality rules: compression bands.

The zstandard ratio (compressed bytes / bytes) of the whole text, and of each fixed chunk of it, must lie in the band of its
length: text below it is repetitive, text above it incompressible. A document is rejected if the whole is out of its band, or
more than `max_bad_chunks` of its chunks are. Beside the verdict stand the plain counts of the base rules.

A text of any length is judged whole, in memory that grows with its length. Null text counts as empty: no words, so base_failed. Rows may repeat; each is judged on its own. A column named like an
output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import each, give_back
from palimpsest.llm.shingles import WIDTH, windows, word_hashes

#: Fixed values: (least bytes, lowest ratio, highest ratio). Short texts hold little to compress and much frame.
BANDS = ((0, 0.0, 9.0), (64, 0.35, 1.5), (128, 0.40, 1.15), (256, 0.42, 0.95), (512, 0.42, 0.85), (1024, 0.42, 0.78), (2048, 0.40, 0.73), (4096, 0.385, 0.70), (8192, 0.375, 0.68), (16384, 0.365, 0.66), (32768, 0.355, 0.64))
CHUNK = 4096
MAX_BAD_CHUNKS = 0.25
#: A last chunk below so many bytes is mostly zstandard's frame (10 bytes for 1); it counts as a chunk, but never as a bad one.
LEAST_TAIL = 64
LEVEL = 3

SYMBOLS = "#*$%&|<>"
FIELDS = "n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,ratio:double,n_chunks:long,n_bad_chunks:long,in_band:boolean"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = word_hashes(text.encode())
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeated = 0
    if len(words) > WIDTH:
        h = windows(words)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h) + WIDTH, np.int64)  # +1 where a repeated window begins, -1 past its last word
        at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        np.add.at(twice, at, 1)
        np.add.at(twice, at + WIDTH, -1)
        repeated = int((np.cumsum(twice) > 0).sum())
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def out_of_band(size: int, ratio: float, bands=BANDS) -> bool:
    _, low, high = bands[bisect_right([b[0] for b in bands], size) - 1]
    return not low <= ratio <= high


def compression(data: bytes, compress, bands=BANDS, chunk: int = CHUNK, most: float = MAX_BAD_CHUNKS) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, those out of band, and whether the text is in its bands."""
    ratio = len(compress(data)) / max(1, len(data))
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)] if len(data) > chunk else []
    bad = sum(len(p) >= min(LEAST_TAIL, chunk) and out_of_band(len(p), len(compress(p)) / len(p), bands) for p in parts)
    return ratio, len(parts), bad, not out_of_band(len(data), ratio, bands) and bad <= most * len(parts)


def quality_rules(df: DataFrame, text: str = "text", bands=BANDS, chunk: int = CHUNK, max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """df with the base counts, base_failed, ratio, n_chunks, n_bad_chunks, in_band and kept."""

    @F.arrow_udf("struct<" + FIELDS + ">")
    def judge(texts: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = []
        for t in each(texts):
            t = t or ""
            rows.append((*base_counts(t), *compression(t.encode(), compress, bands, chunk, max_bad_chunks)))
        names = [x.partition(":")[0] for x in FIELDS.split(",")]
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        give_back()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [x.partition(":")[0] for x in FIELDS.split(",")]
    out = df.withColumn("__quality", judge(F.col(text))).withColumns({n: F.col(f"__quality.{n}") for n in names}).drop("__quality")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))

"""Operator 2, language identification: word-first backoff.

Training counts words by language over a bounded sample of labelled rows, in Spark; the model keeps the most frequent words
and character n-grams (word ends marked). A known word scores its log frequency in each language; an unseen word scores the
mean log frequency of its known n-grams of the longest size that has any, from five characters down to one. A text's language
is that of the greatest sum over its words; its score is the softmax of the sums.

Bounds, all parameters: `per_lang` rows a language (those of the least hash of their id), `max_words` and `max_grams` entries,
fewer if the languages are so many that the model would hold over CELLS numbers; no language is left out. Null or empty text,
and text without a letter, is `und` with score 0; so is everything where nothing was learned. A text of any length is scored whole. Ties go to the language first by code point. Rows may repeat. A column named like an
output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, bounded, each

LETTERS = regex.compile(r"\p{L}+")
LONGEST = 5
PER_LANG, MAX_WORDS, MAX_GRAMS = 2000, 60_000, 60_000
#: Numbers of four bytes that a model holds at most, entries by languages: it is sent to every worker.
CELLS = 24_000_000
#: Numbers that a worker remembers at most in each generation of a memo.
HELD = 2_000_000
#: Long words give their n-grams by pieces of so many beginnings.
PIECE = 64
#: Added to each count, so that a word not seen in a language only makes it unlikely.
SMOOTH = 0.5


def training_rows(df: DataFrame, id_col: str, lang: str, text: str, per_lang: int = PER_LANG) -> DataFrame:
    """lang, text: at most per_lang rows of each language, by the hash of their id."""
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = bounded(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # A margin over the wanted share leaves enough rows for the exact bound that follows.
    some = known.withColumn("place", place).join(n, "lang").filter(F.col("place") <= (1.5 * per_lang + 50) / F.col("n"))
    best = Window.partitionBy("lang").orderBy("place", "id")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_lang).select("lang", "text")


def _top(counts: DataFrame, key: str, most: int) -> list:
    """The most frequent keys with their counts by language."""
    by_key = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("all"))
    return by_key.filter("all > 1").orderBy(F.desc("all"), key).limit(most).collect()


def train(df: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, **bounds) -> dict:
    """The model, at most max_words + max_grams rows: languages, and log frequencies by word and by n-gram."""
    rows = training_rows(df, id_col, lang, text, **bounds)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    marked = words.select("lang", "n", F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.length("w") - 1, F.lit(PIECE))).alias("at")
    marked = marked.select("lang", "n", "w", at).select("lang", "n", F.expr(f"substring(w, at + 1, {PIECE + LONGEST - 1})").alias("w"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")
    cuts = marked.select("lang", "n", "w", sizes).filter(F.length("w") >= F.col("size"))
    grams = cuts.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("w") - F.col("size") + 1)), lambda i: F.substring("w", i, F.col("size")))).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = sorted((r["lang"] for r in words.select("lang").distinct().collect()), key=str.encode)
    room = CELLS // max(1, len(langs)) / (max_words + max_grams)
    found, pieces = (_top(counts, key, int(most * min(1.0, room))) for counts, key, most in ((words, "word", max_words), (grams, "gram", max_grams)))
    words.unpersist()

    def table(entries: list, key: str, groups) -> tuple[dict[str, int], np.ndarray]:
        counts = np.array([[r["by"].get(x, 0) for x in langs] for r in entries], np.float64).reshape(len(entries), len(langs)) + SMOOTH
        group = np.array([groups(r[key]) for r in entries], np.int64)
        for g in set(group.tolist()):
            counts[group == g] /= counts[group == g].sum(axis=0)
        return {r[key]: k for k, r in enumerate(entries)}, np.log(counts).astype(np.float32)

    return {"id": uuid.uuid4().hex, "langs": langs, "words": table(found, "word", lambda w: 0), "grams": table(pieces, "gram", len)}


class Scorer:
    """Scores texts by a model; runs without white space are scored once and remembered."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.none = (0.0,) * len(self.langs)
        held = max(1000, HELD // max(1, len(self.langs)))
        self.chunks = Memo(self.of_chunk, min(150_000, held))
        self.rows = Memo(self.of_gram, held)  # known n-grams as Python numbers

    def of_gram(self, gram: str) -> tuple[float, ...]:
        places, rows = self.grams
        return tuple(rows[places[gram]].tolist())

    def of_word(self, word: str) -> tuple[float, ...]:
        places, rows = self.words
        if (at := places.get(word)) is not None:
            return tuple(rows[at].tolist())
        places = self.grams[0]
        marked = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = [self.rows[g] for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in places]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return self.none

    def of_chunk(self, chunk: str) -> tuple[float, ...]:
        """Scores of a run without white space, one a language; empty if it has no letter."""
        words = LETTERS.findall(chunk.lower())
        if len(words) == 1:
            return self.of_word(words[0])
        return tuple(map(sum, zip(*map(self.of_word, words), strict=True)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        scored = list(filter(None, map(self.chunks.__getitem__, text.split()))) if text and self.langs else []
        if not scored:
            return "und", 0.0
        sums = list(map(sum, zip(*scored, strict=True)))
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.langs[best], 1 / sum(math.exp(max(-700.0, s - sums[best])) for s in sums)


#: The scorer that a worker used last, so that its tasks share what it remembers.
_last: dict[str, Scorer] = {}


def scorer(name: str, model) -> Scorer:
    if name not in _last:
        _last.clear()
        _last[name] = Scorer(model())
    return _last[name]


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams
    name = model["id"]

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        score = scorer(name, lambda: sent.value)
        pairs = [score(t) for t in each(texts)]
        return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], ["lang", "score"])

    return df.withColumn("__lang", judge(F.col(text))).withColumn("lang_pred", F.col("__lang.lang")).withColumn("score", F.col("__lang.score")).drop("__lang")


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """df with held_out, lang_pred and score; learned from the rows that are not held out."""
    model = train(df.filter(~held_out(id_col)), id_col, lang, text)
    return predict(df.withColumn("held_out", held_out(id_col)), model, text)

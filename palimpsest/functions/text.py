"""Token, word, sentence and pattern functions as columns; none leaves the JVM."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal when texts are compared.
STOPWORDS = (
    "a an the this that these those both all some any each every "
    "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs one ones something anything nothing everything "
    "what which who whom whose where when why how "
    "and but or nor so if then than because also too as "
    "of in on at to for with from by about into over under "
    "is are was were be been being am do does did have has had will would can could should may might must shall get got go going went use using used "
    "just really very actually still now here there again not no yes ok okay please thanks"
).split()
# Words that refer back to the conversation.
BACK_REFERENCES = "mention mentioned earlier before previously discuss discussed say said tell told talk talked remember recall remind back above again conversation".split()
# Words that name no topic by themselves, and those dropped before one.
TOPIC_STOPWORDS = "a an the this that these those it its they them their we our ours you your i my me he she him her his what which who whom whose where when why how there here something anything nothing everything one ones and but or so if then also both all some any".split()
DETERMINERS = "the a an our my your their".split()
# Phrases that settle something, and marks of dense text.
DECISIONS = r"(?iU)\b(?:keep|delete|summarize|uncertain|concluded|chose|settled on|we agreed|go with|the plan is|let's go with|let's use|we'll go with|we'll use|decided to|decision is|going to use|going with|the answer is|concluded that|final choice|in conclusion|to summarize|the solution is|I will use|we should use|stick with|switching to)\b"
DENSE = r"\b[A-Z][a-zA-Z]+\b|\b\d+\.?\d*\b|`[^`]+`|https?://\S+"
# What a person puts before a statement.
OPENERS = r"(?iU)^(?:(?:ok(?:ay)?|so|alright|right|well|actually|also|and|but|now|yes|yeah|sure|fine|great|good|cool|perfect|thanks|thank you|got it|understood|noted|sounds good)\b[\s,]*)+"
LABEL = r"(?U)^\w+(?:[\s-]+\w+){0,3}:\s+"
ENDINGS = r"[.!;:,]+$"
GENERAL = "general"
ELLIPSIS = "…"


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


#: Counts the tokens of a text; operators take one as a parameter, so that a vocabulary's own (a pandas UDF, say) can stand in.
Counter = Callable[[Column], Column]


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then() of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; null of null."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def tokenize_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def significant_words(text: Column) -> Column:
    return F.filter(F.array_except(F.array_distinct(tokenize_words(text)), _words(STOPWORDS)), lambda w: F.length(w) > 1)


def asked_words(text: Column) -> Column:
    return F.array_except(significant_words(text), _words(BACK_REFERENCES))


def counted_words(words: Column, asked: Column, few: int = 256) -> Column:
    """An array of (word, c): how often each asked word that is among the words stands there. asked: distinct, without nulls.

    Up to `few` such words are counted one by one; for more, words are sorted with a mark before each asked one, so that the
    work stays in proportion to a long text.
    """
    pair = lambda w, c: F.struct(w.alias("word"), c.cast("long").alias("c"))
    one_by_one = lambda words, met: F.transform(met, lambda w: pair(w, F.size(words) - F.size(F.array_remove(words, w))))
    marked = lambda words, met: F.sort_array(F.concat(F.transform(met, lambda w: F.struct(w.alias("w"), F.lit(0).alias("k"))), F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(1).alias("k")))))
    starts = lambda rows: F.filter(F.transform(rows, lambda r, i: F.when((i == 0) | (F.get(rows, i - 1)["w"] != r["w"]), F.struct(r["w"].alias("w"), r["k"].alias("k"), i.alias("i")))), lambda r: r.isNotNull())
    runs = lambda heads, n: F.filter(F.transform(heads, lambda r, i: F.when(r["k"] == 0, pair(r["w"], F.coalesce(F.get(heads, i + 1)["i"], n) - r["i"] - 1))), lambda r: r.isNotNull())
    sorted_ = lambda words, met: once(marked(words, met), lambda rows: once(starts(rows), lambda heads: runs(heads, F.size(rows))))
    return once(words, lambda ws: once(F.array_intersect(ws, asked), lambda met: F.when(F.size(met) <= few, one_by_one(ws, met)).otherwise(sorted_(ws, met))))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; spaces that stand alone are left where they are."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " "))


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters in lower case that stand for another letter, or for several, where case doesn't count: a rule, not a list."""
    folds = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c != c.casefold()}
    return {c: x for c, x in folds.items() if len(x) == 1}, {c: x for c, x in folds.items() if len(x) > 1 and c != "ß"}


def folded(text: Column) -> Column:
    """Text in which case doesn't count: lower case, then letters such as ß, ﬁ or ς as the letters that they stand for."""
    one, several = _folds()
    low = F.replace(F.translate(F.lower(text), "".join(one), "".join(one.values())), F.lit("ß"), F.lit("ss"))
    # Ligatures are rare: only texts with one are gone through for each. They are told by what is left without them, since a
    # pattern tries its letters one after the other at every place.
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")) for c, x in several.items()))
    whole = F.when(F.char_length(F.translate(low, "".join(several), "")) < F.char_length(low), F.aggregate(pairs, low, lambda s, p: F.replace(s, p.c, p.x))).otherwise(low)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(whole)  # plain letters fold to themselves


def normalise_value(text: Column) -> Column:
    return folded(F.regexp_replace(squeezed(text), r"[.!;,]+$", ""))


def normalise_topic(raw: Column) -> Column:
    """A topic's label: lower case, no determiner before it; null if only stopwords; `general` for null."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " ")), " "), lambda w: w != "")
    fixed = F.size(F.filter(words, lambda w: ~w.isin(DETERMINERS)))
    # Words are dropped from the front while they are determiners and not the last.
    first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(~w.isin(DETERMINERS), i)), lambda i: i.isNotNull()))
    start = F.when(fixed == 0, F.size(words)).otherwise(first + 1)
    kept = F.slice(words, F.greatest(F.lit(1), start).cast("int"), F.greatest(F.lit(1), F.size(words)))
    label = F.when(F.exists(kept, lambda w: ~w.isin(TOPIC_STOPWORDS)), F.array_join(kept, " "))
    return F.when(raw.isNull(), F.lit(GENERAL)).otherwise(label)


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def strip_statement(sentence: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(sentence, OPENERS, ""), LABEL, ""), OPENERS, "")
    return F.trim(F.regexp_replace(bare, ENDINGS, ""))


def phrase_pattern(phrase: Column) -> Column:
    """A pattern for the phrase as whole words, however they are spaced; its first letter is tried before the costlier look behind."""
    line = squeezed(phrase)
    escaped = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}\s_])", r"\\$1")
    return F.concat(F.lit("(?iU)(?="), escaped(F.substring(line, 1, 1)), F.lit(r")(?<!\w)"), F.replace(escaped(line), F.lit(" "), F.lit(r"\s+")), F.lit(r"(?!\w)"))


def mentions(text: Column, phrase: Column) -> Column:
    return F.coalesce(F.regexp_like(text, phrase_pattern(phrase)), F.lit(False))


def escape_delimiters(text: Column, tag: str = "transcript") -> Column:
    """The text unable to end its block or to forge a turn's label."""
    closed = F.regexp_replace(text, rf"(?i)<(/?)(\s*{re.escape(tag)}\s*>)", r"<\\$1$2")
    return F.regexp_replace(closed, r"(?m)^(\s*)\[(turn\s+\d+\])", r"$1\\[$2")


def first_sentence(text: Column, longest: int = 100) -> Column:
    """The first sentence on one line, cut at a word with an ellipsis if it is longer."""
    line = squeezed(text)
    found = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    sentence = F.when(found != "", found).otherwise(line)
    short = F.regexp_replace(F.substring(sentence, 1, longest - 1), r"\s\S*$", "")
    return F.when(F.char_length(sentence) <= longest, sentence).otherwise(F.concat(short, F.lit(ELLIPSIS)))


def preview(text: Column, longest: int = 50) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def title(text: Column, longest: int = 72) -> Column:
    line = squeezed(text)
    return F.when(F.char_length(line) > longest, F.concat(F.rtrim(F.substring(line, 1, longest - 1)), F.lit(ELLIPSIS))).otherwise(line)


def decision_score(text: Column) -> Column:
    return F.least(F.regexp_count(text, F.lit(DECISIONS)) / F.lit(3.0), F.lit(1.0))


def density_signals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + DENSE))


def density_score(text: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.least(density_signals(text) / tokens / F.lit(0.5), F.lit(1.0))).otherwise(F.lit(0.0))


def seconds(ts: Column) -> Column:
    """A timestamp of either kind as seconds."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)

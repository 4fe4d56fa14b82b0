"""Which texts name which phrases (X8), for many phrases at once and without a pattern for each pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import folded, mentions, once
from palimpsest.sources.state import cut

#: A phrase is known by so many of its first tokens: the greatest of these that it has. Each is twice the one before.
ANCHORS = (1, 2, 4, 8)
#: Anchors of up to so many phrases (a hash each) are sent to every executor, so that other tokens of texts are never shuffled.
FEW = 200_000
#: Of groups with up to so many phrases, each text gets the list; texts of larger groups give hashes of their tokens.
LISTED = 64


def tokens(text: Column) -> Column:
    """Words, and every other mark by itself; letters that a pattern without case takes for one another are one."""
    same = F.translate(folded(text), "ı\u0307", "i")  # i with and without its dot, which stands alone once in lower case
    each = lambda line, flag: F.regexp_extract_all(line, F.lit(flag + r"(\w+|[^\w\s])"), F.lit(1))
    return F.when(F.octet_length(text) == F.char_length(text), each(F.lower(text), "")).otherwise(each(same, "(?U)"))  # plain letters need no classes


def _runs(words: Column, then: Callable[[list[Column]], Column], longest: int = ANCHORS[-1]) -> Column:
    """then() of the hashes of all runs of each length in ANCHORS up to longest, by their first token; null where a run would pass the end.

    A run's hash is that of its halves' hashes, so that no run's text is put together.
    """

    def halves(known: list[Column]) -> Column:
        if ANCHORS[len(known) - 1] >= longest or len(known) == len(ANCHORS):
            return then(known)
        half, short = ANCHORS[len(known) - 1], known[-1]
        both = F.transform(short, lambda x, i: F.when(i + half < F.size(short), F.xxhash64(x, F.get(short, i + half))))
        both = F.transform(both, lambda x, i: F.when(i + 2 * half <= F.size(short), x))
        return once(both, lambda h: halves([*known, h]))

    return once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: halves([h]))


def anchor(words: Column) -> Column:
    """The hash of a phrase's first tokens; null for a phrase without any."""
    return _runs(words, lambda runs: F.coalesce(*(F.get(r, F.lit(0)) for r in reversed(runs))))


def anchors(words: Column, longest: int = ANCHORS[-1]) -> Column:
    """The hashes of all runs of tokens in a text that a phrase could begin with, and perhaps a null; longest: of the runs."""
    return _runs(words, lambda runs: F.array_distinct(F.concat(*runs)), longest)


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def _by_hashes(texts: DataFrame, phrases: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """A phrase stands in a text only where its first tokens do, so they meet by hashes of these, an equal join; the pattern for
    whole words is tried on what has met. Texts meet by their content, so ids may be null or repeated."""
    key = (F.xxhash64(F.lit(1), "text").alias("__a"), F.xxhash64(F.lit(2), "text").alias("__b"))
    known = phrases.withColumn("__at", anchor(tokens(F.col("phrase")))).filter("__at is not null")
    wanted = cut(known.select(*within, "__at", F.least(F.size(tokens(F.col("phrase"))), F.lit(ANCHORS[-1])).alias("__run")).groupBy(*within, "__at").agg(F.max("__run").alias("__run")))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max("__run").alias("run")).first()
    longest = max(a for a in ANCHORS if a <= (size.run or 1))
    wanted = wanted.drop("__run")
    if size.n <= FEW:
        wanted = F.broadcast(wanted)
    read = texts.filter("text is not null")
    met = read.select(*within, *key, tokens(F.col("text")).alias("__words"))
    met = met.select(*within, "__a", "__b", F.explode(anchors(F.col("__words"), longest)).alias("__at")).join(wanted, [*within, "__at"], "left_semi").distinct()
    pairs = met.join(known, [*within, "__at"]).drop("__at")
    found = read.select("*", *key).join(pairs, [*within, "__a", "__b"]).filter(mentions(F.col("text"), F.col("phrase")))
    return found.select(*within, *_others(texts, *within, "text"), *_others(phrases, *within, "phrase"))


def _by_lists(texts: DataFrame, phrases: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Each text gets its group's phrases as a list; the pattern is tried for those whose first token is among the text's.

    A text is read once and nothing of it is laid out, so this grows with the texts alone as long as lists are short.
    """
    own, others = _others(phrases, *within, "phrase"), _others(texts, *within, "text")
    first = F.get(tokens(F.col("phrase")), F.lit(0))
    lists = phrases.withColumn("__first", first).filter("__first is not null").groupBy(*within).agg(F.collect_list(F.struct("__first", "phrase", *own)).alias("__list"))
    held = F.array_intersect(F.transform("__list", lambda p: p["__first"]), tokens(F.col("text")))
    tried = once(held, lambda h: F.filter("__list", lambda p: F.array_contains(h, p["__first"])))
    met = texts.filter("text is not null").join(lists, [*within]).select(*within, *others, "text", F.explode(tried).alias("__p"))
    return met.filter(mentions(F.col("text"), F.col("__p.phrase"))).select(*within, *others, *(F.col(f"__p.{c}") for c in own))


def find_mentions(texts: DataFrame, phrases: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Texts (text, any others) that name phrases (phrase, any others): the other columns of both, a row a pair.

    within: columns of both that must be equal, e.g. the conversation; phrases, the smaller table, are then read twice.

    Within groups of up to LISTED phrases each text is held against the group's list; larger groups, and phrases without a
    group, meet by hashes of first tokens. Each row of a text that names a phrase counts, also where rows are alike. Null
    texts, and phrases that are null or blank, meet nothing; long texts are read whole; empty tables give none. Apart from
    `within`, the tables should share no column name.
    """
    if not within:
        return _by_hashes(texts, phrases)
    phrases = phrases.dropna(subset=[*within])
    large = cut(phrases.groupBy(*within).count().filter(F.col("count") > LISTED).select(*within))
    if large.isEmpty():
        return _by_lists(texts, phrases, within)
    rest = _by_hashes(texts.join(large, [*within], "left_semi"), phrases.join(large, [*within], "left_semi"), within)
    return _by_lists(texts, phrases.join(large, [*within], "left_anti"), within).unionByName(rest)

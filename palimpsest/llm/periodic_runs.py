"""Operator 12, periodic run detection: Baier grouping.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; those of at least `least` words
and `times` * q words are given. Of each text:

1. Words are numbered, and only stretches that a run may cover are kept. In a run of three periods and six words or more each
   three words stand at least three times, so a word in no three such words can't be in one; what is left is looked at again.
   No run is lost, and none reaches over a cut.
2. The first phase of Baier's suffix sorter groups a stretch's suffixes. Groups are taken from the greatest down; each suffix of
   a group hands the group's length on to the nearest suffix before it that stands in a lower group, and suffixes that were
   handed the same group equally often part from their own group, as a greater one. At the end a group's length is that of the
   longest Lyndon word at its suffixes, and suffixes of one group begin with the same Lyndon word. The same is done with the
   order of words turned round.
3. Three times the same Lyndon word in a row is the core of a run with that word's length as its period, in one of the two
   orders. The core is extended to both sides by the longest common extension of two places a period apart.

Steps 2 and 3 take time in proportion to a stretch's length, but for the union of places and extensions (a logarithm at most).

Null or empty text has no words, no runs and an empty collapsed text. A text of any length is read whole; memory for it grows
with its number of words. A word of any length is one word. Runs with equal starts come by period. Rows may repeat and are read
alike. Columns named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import each
from palimpsest.llm.shingles import PLACES

LEAST, TIMES = 6, 4
PASSES = 8


def grouped(s: list[int], falling: bool = False) -> tuple[list[int], list[int]]:
    """Of each place in s the length of the longest Lyndon word that begins there, and a number for that word."""
    n = len(s)
    values = sorted(set(s), reverse=falling)
    first = {v: g for g, v in enumerate(values)}
    group = [first[v] for v in s]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(values)
    lower = list(range(-1, len(values) - 1))
    upper = [*range(1, len(values)), -1]
    left = list(range(n))  # left[i] == i while i is in a group not taken yet; else a place before i to look at

    def before(i: int) -> int:
        """The nearest place from i down that stands in a lower group."""
        end = i
        while end >= 0 and left[end] != end:
            end = left[end]
        while i > end and left[i] != end:
            left[i], i = end, left[i]
        return end

    taken = len(values) - 1
    while taken >= 0:
        own = [i for i in members[taken] if group[i] == taken]
        members[taken] = []
        for i in own:
            left[i] = i - 1
        handed = Counter(map(before, own))
        handed.pop(-1, None)
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in handed.items():
            parts.setdefault((times, group[p]), []).append(p)
        for times, g in sorted(parts, reverse=True):
            new = len(length)
            length.append(length[g] + times * length[taken])
            for p in parts[times, g]:
                group[p] = new
            members.append(parts[times, g])
            lower.append(g)
            upper.append(upper[g])
            lower[upper[g]] = new
            upper[g] = new
        taken = lower[taken]
    return [length[g] for g in group], group


def alike(s: list[int], a: int, b: int, most: int) -> int:
    """Items that s has in common from a on and from b on, `most` at most."""
    n, step = 0, 4
    while n < most and s[a + n : a + min(n + step, most)] == s[b + n : b + min(n + step, most)]:
        n, step = min(n + step, most), 2 * step
    if n == most:
        return n
    while step > 1:
        step = (step + 1) // 2
        end = min(n + step, most)
        if s[a + n : a + end] == s[b + n : b + end]:
            n = end
    while n < most and s[a + n] == s[b + n]:
        n += 1
    return n


def runs_of(s: list[int], times: int = TIMES, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs in s with length >= max(least, times * period); times is 3 at least, 4 for one word."""
    found: set[tuple[int, int, int]] = set()
    n, back = len(s), s[::-1]
    for falling in (False, True):
        lengths, word = grouped(s, falling)
        last = {}  # of each period, where the run ends that was found last
        for i in range(n):
            q = lengths[i]
            if i + 3 * q > n or word[i + q] != word[i] or word[i + 2 * q] != word[i] or last.get(q, -1) >= i + q:
                continue
            end = i + 3 * q + alike(s, i + 2 * q, i + 3 * q, n - i - 3 * q)
            start = i - alike(back, n - i, n - i - q, i)
            last[q] = end
            if end - start >= max(least, times * q):
                found.add((start, end - start, q))
    return found


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that runs may cover, in which each three words stand three times.

    Three words are known by a hash; where two share one, a stretch is only longer than it need be. After PASSES looks at a
    stretch it is taken as it is, so that time stays in proportion to the text.
    """
    out, open_ = [], [(0, len(ids), 0)]
    while open_:
        start, end, looks = open_.pop()
        if end - start < LEAST:
            continue
        own = ids[start:end]
        three = own[:-2] * PLACES[0] + own[1:-1] * PLACES[1] + own[2:] * PLACES[2]
        in_order = np.sort(three)
        often = in_order[2:][in_order[2:] == in_order[:-2]]
        if not len(often):
            continue
        often = np.unique(often)
        at = np.minimum(np.searchsorted(often, three), len(often) - 1)
        begins = np.flatnonzero(often[at] == three)
        inside = np.zeros(len(own), bool)
        for k in range(3):
            inside[begins + k] = True
        if inside.all() or looks == PASSES:
            out.append((start, end))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        open_ += [(start + int(a), start + int(b), looks + 1) for a, b in edges.reshape(-1, 2)]
    return out


def words_of(text: str | None) -> list[bytes]:
    """The runs of characters other than ASCII white space, in UTF-8."""
    return text.encode().split() if text else []


def runs_of_words(words: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period."""
    if times < 4 or least < LEAST:
        raise ValueError("runs of at least four periods and six words can be found")
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    found = []
    for start, end in stretches(ids):
        found += [(start + a, n, q) for a, n, q in runs_of(ids[start:end].tolist(), times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside runs and each run's first period; a word goes if any run has it after its first period."""
    if not runs:
        return b" ".join(words).decode()
    depth = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        depth[start + q] += 1
        depth[start + n] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()


RUNS = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def read_runs(text: Column, times: int = TIMES, least: int = LEAST) -> Column:
    """struct<n_words, runs, collapsed> of a text."""
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    @F.arrow_udf(RUNS)
    def read(texts: pa.Array) -> pa.Array:
        n, runs, out = [], [], []
        for t in each(texts):
            words = words_of(t)
            own = runs_of_words(words, times, least)
            n.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
            out.append(collapsed(words, own))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(out, pa.string())], ["n_words", "runs", "collapsed"])

    return read(text)


def periodic_runs(docs: DataFrame, text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs and collapsed (the text's words joined by one space, repeats of a period left out)."""
    found = docs.withColumn("__read", read_runs(F.col(text), times, least))
    return found.withColumns({name: F.col("__read").getField(name) for name in ("n_words", "runs", "collapsed")}).drop("__read")


def greatest(runs: Column) -> Column:
    """The run with the greatest length over period, of equals the first by start, then period; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    return F.aggregate(runs, none, more)


def written(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")

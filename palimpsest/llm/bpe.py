"""Byte-pair merging of one short word, in two forms that give the same merges."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

#: White space as the tokenizers' regular expressions know it.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(4)
def load(path: str) -> dict:
    """Vocabulary, merges by pair of ids as (rank, new id), and added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    suffix = spec["model"].get("end_of_word_suffix") or ""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
    return {"vocab": vocab, "merges": merges, "suffix": suffix, "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def heap_merges(symbols: list[int], merges: dict) -> tuple[int, list[int]]:
    """Number of merges, and what is left, by a heap of adjacent pairs over a doubly linked list; n log n for any length."""
    end = len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(*merge, i, symbols[i], symbols[i + 1]) for i in range(end - 1) if (merge := merges.get((symbols[i], symbols[i + 1])))]
    heapify(heap)
    done = 0
    while heap:
        _, new, i, a, b = heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= end or symbols[j] != b:
            continue  # one of the two has been merged since
        done += 1
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if merge := merges.get((new, symbols[k])):
                heappush(heap, (*merge, i, new, symbols[k]))
        h = before[i]
        if h >= 0 and (merge := merges.get((symbols[h], new))):
            heappush(heap, (*merge, h, symbols[h], new))
    return done, [s for s in symbols if s >= 0]


#: The rank of a pair that does not merge.
NEVER = (1 << 60, -1)


def scan_merges(symbols: list[int], merges: dict) -> list[int]:
    """What is left after all merges, by a contiguous array of adjacent ranks scanned for its minimum; for short words."""
    ranks = [merges.get(pair, NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least is NEVER:
            break
        i = ranks.index(least)
        symbols[i] = least[1]
        del symbols[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = merges.get((symbols[i], symbols[i + 1]), NEVER)
        if i:
            ranks[i - 1] = merges.get((symbols[i - 1], symbols[i]), NEVER)
    return symbols

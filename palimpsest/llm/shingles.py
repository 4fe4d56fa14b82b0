"""Words and word shingles of a text as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Odd multipliers, one for each place in a shingle, and those of the final mixing.
PLACES = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % 2**64 | 1) for k in range(WIDTH)]
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


#: A random number for each byte; ASCII white space parts words; A-Z lower-cased.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * PLACES[1])
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes hashed at a time, cut between words; a longer word is hashed by itself.
PIECE = 1 << 18
#: An odd number and its inverse modulo 2**64, and their powers as far as texts of up to PIECE bytes have needed them.
BASE = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    made = {}
    for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
        steps = np.full(max(n, min(PIECE, 2 * n)), base, np.uint64)
        steps[0] = 1
        made[name] = np.multiply.accumulate(steps)
    if n <= PIECE:
        _powers.update(made)
    return made["up"], made["down"]


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each run of bytes other than ASCII white space: a polynomial over its bytes, mixed with its length.

    Sums over the whole text give every word's polynomial at once, without a step in Python for each word.
    """
    text = np.frombuffer(data, np.uint8)
    if lower:
        text = LOWER[text]
    if len(text) > PIECE:
        blanks = np.flatnonzero(BLANK[text])
        cuts = [0]
        while len(text) - cuts[-1] > PIECE:
            k = int(np.searchsorted(blanks, cuts[-1] + PIECE, "right"))
            if k and blanks[k - 1] > cuts[-1]:
                cuts.append(int(blanks[k - 1]))  # the last blank that keeps the piece short
            elif k < len(blanks):
                cuts.append(int(blanks[k]))
            else:
                break
        return np.concatenate([_hashed(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)])
    return _hashed(text)


def _hashed(text: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate([[True], BLANK[text], [True]])).nonzero()[0]
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTES[text] * up[: len(text)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACES[2]) if len(starts) else np.zeros(0, np.uint64)


def windows(words: np.ndarray) -> np.ndarray:
    """One hash for each window of WIDTH words, in place; empty with fewer words."""
    n = max(0, len(words) - WIDTH + 1)
    h = np.zeros(n, np.uint64)
    for k, place in enumerate(PLACES):
        h += words[k : k + n] * place
    return mixed(h)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles, A-Z lower-cased; with fewer words one for the whole sequence."""
    words = word_hashes(text.encode(), lower=True) if text else np.zeros(0, np.uint64)
    if 0 < len(words) < WIDTH:
        h = np.full(1, len(words), np.uint64)
        for w in words:
            h = mixed(h * PLACES[0] + w)
        return h
    return np.unique(windows(words))

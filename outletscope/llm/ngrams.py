"""Character n-grams of many texts as numbers, for linear classifiers."""

from __future__ import annotations

import numpy as np

SPACE = 32
#: Odd multipliers of the hash of an n-gram, one per place.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _letters() -> np.ndarray:
    """Per code unit of the basic plane, the unit in lower case where it is a letter, else a space."""
    out = np.full(1 << 16, SPACE, dtype=np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


LETTERS = _letters()


def codes(texts: list[str], letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after the other, a space before and after each, and where each text begins.

    With letters_only, letters are lower-cased and everything else of the basic plane is a space.
    """
    joined = "".join([f" {t} " for t in texts])
    out = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if letters_only:
        out = np.where(out < 1 << 16, LETTERS[np.minimum(out, (1 << 16) - 1)], out)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    return out, starts


def hashed(units: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n-gram that begins at each code point; order - 1 fewer than code points."""
    n = len(units) - order + 1
    total = np.full(n, np.uint32(order), dtype=np.uint32)
    for place in range(order):
        total += units[place : place + n] * PLACES[place]
        total ^= total >> np.uint32(15)
    return ((total * PLACES[0]) >> np.uint32(32 - bits)).astype(np.int32)


def ngram_stretches(text: str, orders: tuple[int, ...], bits: int, letters_only: bool, chars: int):
    """The buckets of all n-grams of one text and which count, as in ngram_rows, a stretch of so many code points at once.

    Each stretch gives a list with an entry per order, of the n-grams that begin in it.
    """
    whole = f" {text} "
    for first in range(0, len(whole), chars):
        units = codes([whole[first : first + chars + max(orders) - 1]], letters_only)[0][1:-1]
        blank = units == SPACE
        found = []
        for order in orders:
            n = min(chars, max(0, len(units) - order + 1))
            counts = np.zeros(n, bool)
            for place in range(order):
                counts |= ~blank[place : place + n]
            found.append((hashed(units, order, bits)[:n] if n else np.zeros(0, np.int32), counts))
        yield found


def ngram_rows(texts: list[str], orders: tuple[int, ...], bits: int, letters_only: bool):
    """For each order: the buckets of all n-grams, where each text's n-grams begin, and which n-grams count.

    N-grams of blanks only, and those that reach into the next text, don't count.
    """
    units, starts = codes(texts, letters_only)
    blank = units == SPACE
    for order in orders:
        buckets = hashed(units, order, bits)
        counts = ~blank[: len(buckets)]
        for place in range(1, order):
            counts |= ~blank[place : place + len(buckets)]
        for back in range(1, order):
            over = starts[1:] - back
            counts[over[over < len(buckets)]] = False
        yield buckets, np.minimum(starts[:-1], len(buckets)), counts

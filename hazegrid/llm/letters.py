"""Character n-grams of texts as hash buckets, in whole arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLANK = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, anything but letters being a blank."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(c) + 2, BLANK, np.uint32)
    out[1:-1] = np.where(_is_letter()[c], c, BLANK)
    return out


def grams(c: np.ndarray, sizes: range, bits: int) -> np.ndarray:
    """Buckets, ``bits`` wide, of all n-grams that lie in one word; its first and last may hold the blank around it."""
    letter = c != BLANK
    out, h = [], c * np.uint32(0x9E3779B1)
    inner = np.ones(len(c), bool)  # of the n-gram from here on: all but its ends are letters
    for n in range(2, sizes.stop):
        if len(c) < n:
            break
        if n > 2:
            inner = inner[:-1] & letter[n - 2:len(c) - 1]
        else:
            inner = inner[:-1]
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1:] * np.uint32(0x9E3779B1)
        if n in sizes:
            ok = inner & (letter[:-1] | letter[1:] if n == 2 else True)
            x = h[ok]
            x = (x ^ (x >> np.uint32(16))) * np.uint32(0xC2B2AE35)
            out.append((x ^ (x >> np.uint32(13))) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)

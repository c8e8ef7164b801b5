"""Small text helpers that several operators share."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

WORD = re.compile(r"\w+")


LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _numbers() -> dict[int, str]:
    """What LETTERS takes though it is no letter (Unicode's L), such as superscripts, fractions and Roman numerals; each to a space."""
    import unicodedata

    return {i: " " for i in range(128, sys.maxunicode + 1) if chr(i).isalnum() and not unicodedata.category(chr(i)).startswith("L")}


def letter_runs(text: str) -> list[str]:
    """Runs of letters."""
    runs = LETTERS.findall(text)
    if runs and not text.isascii() and not "".join(runs).isalpha():
        runs = LETTERS.findall(text.translate(_numbers()))
    return runs


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (xor-shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


class Memo(dict):
    """word -> make(word), in two generations: when the young one holds half of `most` bytes, it becomes the old one. Memory stays
    bounded however long words and values are, and what is in use survives. A word that alone takes a part in WIDE of it isn't kept."""

    #: Bytes counted for an entry besides its key and value.
    ENTRY, WIDE = 100, 1000

    def __init__(self, make, most: int = 32 << 20):
        super().__init__()
        self.make, self.half, self.old, self.size = make, most // 2, {}, 0

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        self.keep(word, out)
        return out

    def keep(self, word, out) -> None:
        both = word.__class__ is bytes and out.__class__ is bytes
        size = self.ENTRY + (len(word) + len(out) + 66 if both else sys.getsizeof(word) + sys.getsizeof(out))
        if size > self.half // self.WIDE:
            return
        if self.size + size > self.half:
            self.old, self.size = dict(self), 0
            self.clear()
        self[word] = out
        self.size += size


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path in the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+://|file:/", uri) else f"file://{uri}")

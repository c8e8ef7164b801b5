"""Seeds, content identities and perceptual hashes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(seed: str, key: Column) -> Column:
    """60 bits that depend on seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """stable_hash as a number in [0, 1)."""
    return stable_hash(seed, key) / F.lit(float(1 << 60))


def stable_seed(*parts: Column) -> Column:
    """A seed of 60 bits from any number of values, each written with its length, so that no two lists of values run together."""
    told = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    text = F.concat(*[x for t in told for x in (F.length(t).cast("string"), F.lit(":"), t)])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def content_seed(content: Column) -> Column:
    """The CRC of a binary or text column."""
    return F.crc32(content)


def fingerprint(tag: str, payload: Column, snapshots: Column) -> Column:
    """Digest of a domain tag, a payload and a snapshot map as sorted JSON."""
    return F.sha2(F.concat(F.lit(tag + "\n"), payload, F.lit("\n"), canonical_json(snapshots)), 256)


def canonical_json(m: Column) -> Column:
    """A string map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def pack_bits(bits: Column) -> Column:
    """Array of booleans (at most 63) to a bigint; element 0 is the lowest bit."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dhash(x: Column, rows: int = 8, cols: int = 8) -> Column:
    """Sign of the step from each value to its right neighbour, row by row."""
    at = [(r * cols + c) for r in range(rows) for c in range(cols - 1)]
    return pack_bits(F.array(*[F.get(x, i + 1) > F.get(x, i) for i in at]))


def dct_basis(n: int = 8) -> list[float]:
    """Orthonormal DCT-II, row-major (frequency, position)."""
    return [math.sqrt((1 if u == 0 else 2) / n) * math.cos(math.pi * (2 * r + 1) * u / (2 * n)) for u in range(n) for r in range(n)]


def dct2(x: Column, n: int = 8) -> Column:
    """Two-dimensional DCT of an n x n block (row-major): first along rows' index, then along columns'."""
    every, line = F.sequence(F.lit(0), F.lit(n * n - 1)), F.sequence(F.lit(0), F.lit(n - 1))
    div = lambda k: F.floor(k / n).cast("int")

    def along_rows(basis, x):
        return F.transform(every, lambda k: F.aggregate(line, F.lit(0.0), lambda a, r: a + F.get(basis, div(k) * n + r) * F.get(x, r * n + k % n)))

    def along_columns(basis, half):
        return F.transform(every, lambda k: F.aggregate(line, F.lit(0.0), lambda a, c: a + F.get(basis, (k % n) * n + c) * F.get(half, div(k) * n + c)))

    basis = F.array(*[F.lit(v) for v in dct_basis(n)])
    return let(basis, lambda b: let(along_rows(b, x), lambda half: along_columns(b, half)))


def phash(x: Column) -> Column:
    """Bits of the coefficients above the median of coefficients 1 to 63; coefficient 0's own bit is left out, so 63 bits."""
    bits = lambda rest: let(F.get(F.array_sort(rest), 31), lambda median: F.transform(rest, lambda v: v > median))
    return pack_bits(let(F.slice(dct2(x), 2, 63), bits))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")

"""Bitset columns: ``array<bigint>`` of 32-bit words, all operations inside codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.schema import CONNECTOR_ATOMS

WORD = 32


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def popcount(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: F.bit_count(x)))


def superset(x: Column, q: Column, words: int | None = None) -> Column:
    """Whether ``x`` has every bit of ``q``; a stated number of ``words`` is compared in generated code."""
    if words:
        return reduce(lambda a, b: a & b, [q[w].bitwiseAND(x[w]) == q[w] for w in range(words)])
    return F.forall(F.zip_with(q, x, lambda a, b: a.bitwiseAND(b) == a), lambda t: t)


def intersection(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def hamming(a: Column, b: Column, words: int | None = None) -> Column:
    """The number of bits that differ. As :func:`superset` with ``words``."""
    if words:
        return reduce(lambda x, y: x + y, [F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(words)])
    return _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))


def tanimoto(a: Column, b: Column, words: int | None = None) -> Column:
    """Shared bits over all bits; null for two empty sets. As :func:`superset` with ``words``."""
    if words:
        shared, either = (reduce(lambda x, y: x + y, [F.bit_count(f(a[w], b[w])) for w in range(words)]) for f in (Column.bitwiseAND, Column.bitwiseOR))
        return F.when(either != 0, shared.cast("double") / either.cast("double"))
    return F.try_divide(popcount(intersection(a, b)).cast("double"), popcount(union(a, b)).cast("double"))


def tanimoto_to_hamming(cardinality: Column, t: float) -> Column:
    """The largest Hamming distance that a similarity of ``t`` or more leaves."""
    return F.floor(cardinality * (1.0 / t - 1.0)).cast("int")


def from_flags(flags: Column, words: int) -> Column:
    """Words from an array of booleans, bit 0 first."""
    return F.array(*[
        _long_sum(F.transform(F.slice(flags, w * WORD + 1, WORD), lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
        for w in range(words)
    ])


def _long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def from_positions(positions: Column, words: int) -> Column:
    """Words from an array of bit positions."""
    return F.array(*[
        F.aggregate(
            F.transform(F.filter(positions, lambda p: (p >= w * WORD) & (p < (w + 1) * WORD)), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p - w * WORD).cast("int"))),
            F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x),
        )
        for w in range(words)
    ])


def to_bit_string(a: Column) -> Column:
    """``0`` and ``1`` characters, bit 0 first."""
    return F.array_join(F.flatten(F.transform(a, lambda x: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1).cast("long")).cast("string")))), "")


def from_bit_string(s: Column, words: int) -> Column:
    return from_flags(F.transform(F.split(s, ""), lambda c: c == "1"), words)


def to_base64(a: Column) -> Column:
    """Little-endian bytes of the words, trailing zero bytes dropped, in Base64."""
    hexes = F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0"))
    little = F.transform(hexes, lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))
    return F.base64(F.unhex(F.regexp_replace(F.array_join(little, ""), "(00)+$", "")))


def from_base64(s: Column, words: int) -> Column:
    hexes = F.rpad(F.hex(F.unbase64(s)), words * 8, "0")
    return F.array(*[
        F.conv(F.concat(*[F.substring(hexes, w * 8 + k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long") for w in range(words)
    ])


def order_key(a: Column) -> Column:
    """An array that sorts bitsets by their most significant words first."""
    return F.reverse(a)


def connector_mask(structure: Column) -> Column:
    """The connectors that a structure carries, one bit each."""
    out = F.lit(0)
    for k, atom in enumerate(CONNECTOR_ATOMS):
        out = out.bitwiseOR(F.when(structure.contains(f"[{atom}]"), F.lit(1 << k)).otherwise(F.lit(0)))
    return out


def mask_hash(a: Column, masks: Sequence[Sequence[int]]) -> Column:
    """Multi-index hashes: the number of set bits under each of some disjoint masks."""
    return F.array(*[popcount(F.zip_with(a, F.array(*[F.lit(w).cast("long") for w in m]), lambda x, y: x.bitwiseAND(y))) for m in masks])


def disjoint_masks(bits: int, count: int, seed: int = 456) -> list[list[int]]:
    """``count`` disjoint random masks that together cover all bits."""
    import random

    order = list(range(bits))
    random.Random(seed).shuffle(order)
    out = []
    for k in range(count):
        words = [0] * (-(-bits // WORD))
        for p in order[k::count]:
            words[p // WORD] |= 1 << (p % WORD)
        out.append(words)
    return out


def projection_hash(a: Column, positions: Sequence[int], multipliers: Sequence[int], modulus: int = 32768) -> Column:
    """A random-projection hash: the sum of multipliers of the projected bits that are set."""
    total = F.lit(0).cast("long")
    for p, m in zip(positions, multipliers):
        bit = F.call_function("shiftright", a[p // WORD], F.lit(p % WORD)).bitwiseAND(F.lit(1).cast("long"))
        total = total + bit * F.lit(m)
    return total % modulus

"""Scalar functions of the space operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_index(token: Column) -> Column:
    """An integer, else the last run of digits (``R2`` is 2); null without digits."""
    digits = F.regexp_extract(token, "([0-9]+)[^0-9]*$", 1)
    return F.coalesce(F.trim(token).try_cast("int"), F.when(digits != "", digits.try_cast("int")))


def file_reaction(name: Column) -> Column:
    """The reaction id in a file name: extension, ``_synthon`` and trailing ``_<n>`` dropped."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, "_synthons?$", ""), "_[0-9]+$", "")


def file_set_index(name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", ""), "_synthons?$", "")
    return F.regexp_extract(stem, "_([0-9]+)$", 1).try_cast("int")


def sanitise(token: Column) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and dash become ``_``."""
    return F.regexp_replace(token, "[^a-zA-Z0-9._-]+", "_")


def suffix_lookup(m: Column, key: Column) -> Column:
    """The entry of ``key``, else of the smallest key that ``key`` ends with."""
    ends = F.map_filter(m, lambda k, v: F.endswith(key, k))
    return F.coalesce(F.try_element_at(m, key), F.try_element_at(ends, F.array_min(F.map_keys(ends))))


def size_range(size: Column) -> tuple[Column, Column]:
    """Compatible sizes: ``min(s - 4, floor(0.75 s))`` to ``max(s + 4, ceil(1.33 s))``."""
    return F.least(size - 4, F.floor(size * 0.75)).cast("int"), F.greatest(size + 4, F.ceil(size * 1.33)).cast("int")


# The compatible connector distances (least, most) of distances 0, 1, 2, ...
# The last pair also holds for every greater distance.
DISTANCES = (
    (1, 4), (1, 4), (1, 4), (2, 5), (2, 6), (3, 7), (4, 9), (5, 10),
    (6, 11), (7, 12), (7, 13), (7, 14), (8, 16), (9, 17), (10, 18), (11, 19),
    (12, 20), (13, 21), (14, 22), (15, 23), (16, 24), (17, 25), (18, 26), (19, 27),
    (20, 28), (21, 29), (22, 30), (23, 31), (24, 32), (25, 33), (26, 34), (27, 35),
)


def distance_range(d: Column) -> tuple[Column, Column]:
    """Compatible connector distances: least and most, by the fixed table."""
    place = F.when(d.isNotNull(), F.least(d, F.lit(len(DISTANCES) - 1))).cast("int")
    return tuple(F.get(F.array(*[F.lit(pair[k]) for pair in DISTANCES]), place) for k in (0, 1))


def merge_descriptors(descriptors: Column, added: dict[str, Column], overwrite: bool = False) -> Column:
    """``descriptors`` (a map of strings, null counts as empty) with entries added.

    An entry that is there already stays, unless ``overwrite``; null values are not added.
    """
    old = F.coalesce(descriptors, F.create_map().cast("map<string,string>"))
    new = F.map_filter(F.create_map(*[c for k, v in added.items() for c in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a) if overwrite else F.coalesce(a, b))


def size_cap(n: Column, scale: float, offset: float, max_centers: int) -> Column:
    """``ceil(scale * sqrt(n) + offset)`` within 1 and n, and at most ``max_centers``."""
    return F.least(F.greatest(F.lit(1), F.least(n, F.ceil(F.sqrt(n) * scale + offset))), F.lit(max_centers)).cast("int")


def bucket_label(n: Column) -> Column:
    """Seven size classes of a reaction."""
    out = F.lit(">100B")
    for limit, label in reversed(((10**6, "<1M"), (10**7, "1M-10M"), (10**8, "10M-100M"), (10**9, "100M-1B"), (10**10, "1B-10B"), (10**11, "10B-100B"))):
        out = F.when(n < limit, F.lit(label)).otherwise(out)
    return out


BUCKETS = ("<1M", "1M-10M", "10M-100M", "100M-1B", "1B-10B", "10B-100B", ">100B")

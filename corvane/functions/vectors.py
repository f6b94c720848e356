"""Vectors as arrays of doubles, in expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from corvane.functions.naming import RESIDUES


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    size = norm(v)
    return F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_binary(v: Column) -> Column:
    return F.forall(v, lambda x: x.isin(0.0, 1.0))


def one_hot(sequence: Column, length: int, alphabet: str = RESIDUES) -> Column:
    """Zero-padded positions times letters, flattened."""
    letters = F.array(*(F.lit(c) for c in alphabet))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.transform(letters, lambda c: (F.substr(sequence, i, F.lit(1)) == c).cast("double"))))


def ordinal(sequence: Column, length: int, alphabet: str = RESIDUES) -> Column:
    """The place of each letter in the alphabet, from 1; 0 for others and behind the end."""
    places = F.create_map(*(F.lit(x) for i, c in enumerate(alphabet) for x in (c, i + 1.0)))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.coalesce(F.element_at(places, F.substr(sequence, i, F.lit(1))), F.lit(0.0)))


def frequencies(sequence: Column, alphabet: str = RESIDUES) -> Column:
    """The share of each letter."""
    return F.transform(F.array(*(F.lit(c) for c in alphabet)), lambda c: F.coalesce(F.try_divide((F.length(sequence) - F.length(F.replace(sequence, c, F.lit("")))).cast("double"), F.length(sequence)), F.lit(0.0)))


# The public hydropathy, volume and charge scales of residues, in the alphabet's order.
HYDROPATHY = [1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3]
VOLUME = [88.6, 108.5, 111.1, 138.4, 189.9, 60.1, 153.2, 166.7, 168.6, 166.7, 162.9, 114.1, 112.7, 143.8, 173.4, 89.0, 116.1, 140.0, 227.8, 193.6]
CHARGE = [0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def property_of(sequence: Column, length: int, values: list[float], alphabet: str = RESIDUES) -> Column:
    """The letters' values, 0 for other letters and behind the end."""
    known = F.create_map(*(F.lit(x) for c, v in zip(alphabet, values, strict=True) for x in (c, v)))
    letters = F.filter(F.split(F.coalesce(F.substr(sequence, F.lit(1), F.lit(length)), F.lit("")), ""), lambda c: c != "")
    own = F.transform(letters, lambda c: F.coalesce(F.element_at(known, c), F.lit(0.0)))
    return F.concat(own, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(own)))


def physicochemical(sequence: Column, length: int) -> Column:
    """Hydropathy, volume and charge of each position, one after the other."""
    return F.concat(*(property_of(sequence, length, v) for v in (HYDROPATHY, VOLUME, CHARGE)))


def fourier(v: Column, n: int) -> Column:
    """Sizes of the first half of the discrete Fourier transform of n numbers, as sums of sines and cosines, which are known before any row is read."""
    waves = [F.struct(*(F.array(*(F.lit(float(wave(2 * math.pi * k * j / n))) for j in range(n))).alias(a) for a, wave in (("c", math.cos), ("s", math.sin)))) for k in range(n // 2 + 1)]
    size = lambda x, w: F.sqrt(F.pow(dot(x, w["c"]), 2.0) + F.pow(dot(x, w["s"]), 2.0))
    # The numbers are made once a row, not once a frequency: they are bound by the outer function.
    return F.flatten(F.transform(F.array(v), lambda x: F.transform(F.array(*waves), lambda w: size(x, w))))


def k_mers(sequence: Column, k: int = 3) -> Column:
    """All runs of k letters, in order."""
    return F.when(F.length(sequence) >= k, F.transform(F.sequence(F.lit(1), F.length(sequence) - (k - 1)), lambda i: F.substr(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def assignment_hash(train_ids: Column, test_ids: Column) -> Column:
    """sha-256 of TRAIN and TEST, each followed by its sorted ids, each id by a NUL."""
    def part(tag: str, ids: Column) -> Column:
        return F.concat(F.lit(tag), F.array_join(F.transform(F.array_sort(ids), lambda i: F.concat(i, F.lit("\0"))), ""))

    return F.sha2(F.concat(part("TRAIN", train_ids), part("TEST", test_ids)).cast("binary"), 256)

"""Randomness from hashing.

Every sample, split and projection depends only on a seed and on keys of the row or column, so a
retried task, another partitioning or another cluster size gives the same numbers. ``rand(seed)``
depends on the partitioning and does not have this property.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52  # 13 hexadecimal digits: an exact integer both as BIGINT and as DOUBLE


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def hash52(*parts) -> Column:
    """Integer in [0, 2^52) from the md5 of the parts joined by ``:``. Plain values are literals."""
    text = F.concat_ws(":", *[_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform number in [0, 1)."""
    return hash52(*parts).cast("double") / F.lit(float(2**HASH_BITS))


def normal(*parts) -> Column:
    """Standard normal number by the Box-Muller transform of two hashed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "a"))


def md5_bucket(key, buckets: int) -> Column:
    """The 128-bit md5 of ``key`` modulo ``buckets``, by Horner's rule over 32-bit digits."""
    if not 1 <= buckets < 2**31:
        raise ValueError("buckets must be between 1 and 2^31 - 1")
    digest = F.md5(_column(key).cast("string"))
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        digit = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(2**32 % buckets) + digit, F.lit(buckets).cast("bigint"))
    return rest.cast("int")


# Inside tasks, where numpy needs many numbers per row: a 64-bit key is mixed with an index (Steele, Lea, Flood 2014).
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(key, index) -> np.ndarray:
    """The numbers of the stream ``key`` at the positions ``index``; both may be arrays."""
    with np.errstate(over="ignore"):
        return mix64(np.asarray(key, np.uint64) + (np.asarray(index, np.uint64) + np.uint64(1)) * STEP)


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as uniform numbers in [0, 1)."""
    return (x >> np.uint64(11)) * 2.0**-53

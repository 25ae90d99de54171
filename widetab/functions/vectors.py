"""Row-local functions on the ``features`` array. None of them shuffles."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 64  # up to this width expressions are unrolled, so that they stay in generated code


def array_literal(values: Sequence, element: str = "double") -> Column:
    """A constant array. Long ones are parsed from one JSON literal, which the optimizer folds."""
    values = [v.item() if hasattr(v, "item") else v for v in values]
    if len(values) <= UNROLL_LIMIT:
        return F.array(*[F.lit(v).cast(element) for v in values]).cast(f"array<{element}>")
    return F.from_json(F.lit(json.dumps(values)), f"array<{element}>")


def _as_column(values, element: str = "double") -> Column:
    return values if isinstance(values, Column) else array_literal(values, element)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda is not enough: the optimizer may put the whole expression behind it
    into the lambda, which then computes it for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gather(features: Column, indices: Column) -> Column:
    """Elements at the positions in an array column."""
    return bind(features, lambda row: F.transform(indices, lambda i: F.get(row, i)))


def take(features: Column, indices: Sequence[int]) -> Column:
    """Elements at ``indices`` in the order of the list."""
    if len(indices) <= UNROLL_LIMIT:
        return F.array(*[F.get(features, F.lit(int(i))) for i in indices]).cast("array<double>")
    return gather(features, array_literal([int(i) for i in indices], "int"))


def complement(width: int, indices: Sequence[int]) -> Column:
    """The column positions that are not in ``indices``, ascending."""
    if width <= 0:
        return F.array().cast("array<int>")
    everything = F.sequence(F.lit(0), F.lit(width - 1))
    return F.array_except(everything, array_literal([int(i) for i in indices], "int"))


def hconcat(*arrays: Column) -> Column:
    """Two or more projections of the same row side by side."""
    return F.concat(*arrays)


def clean_nonfinite(features: Column) -> Column:
    """NULL, NaN and infinite elements become 0."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.transform(features, lambda v: F.when(bad(v), F.lit(0.0)).otherwise(v))


def nan_to_null(features: Column) -> Column:
    return F.transform(features, lambda v: F.when(F.isnan(v), F.lit(None)).otherwise(v).cast("double"))


def fill(features: Column, values) -> Column:
    """Missing elements take the value at the same position of ``values``."""
    return F.zip_with(features, _as_column(values), lambda v, m: F.coalesce(v, m))


def standardize(features: Column, mean, scale) -> Column:
    centred = F.zip_with(features, _as_column(mean), lambda v, m: v - m)
    return F.zip_with(centred, _as_column(scale), lambda v, s: v / s)


def project_gate(weights: Column, k: int, eps: float = 1e-12) -> Column:
    """Clip absolute weights to [0, 1] and scale them to the Euclidean norm ``sqrt(k)``."""
    clipped = F.transform(weights, lambda w: F.least(F.abs(w), F.lit(1.0)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, w: a + w * w)) + F.lit(eps)
    scaled = lambda c, n: F.transform(c, lambda w: w / n * F.lit(float(k) ** 0.5))
    return bind(clipped, lambda c: bind(norm(c), lambda n: scaled(c, n)))


def noise_gate(features: Column, weights: Column, noise: Column, sigma: float) -> Column:
    """``x * w + sigma * (1 - |w|) * noise`` element by element (all three arrays equally long)."""
    gated = F.zip_with(features, weights, lambda x, w: x * w)
    amount = F.zip_with(weights, noise, lambda w, e: F.lit(float(sigma)) * (F.lit(1.0) - F.abs(w)) * e)
    return F.zip_with(gated, amount, lambda a, b: a + b)


def pool(features: Column, clusters: Sequence[Sequence[int]]) -> Column:
    """Mean of the elements of each cluster. Every input element is read once, in the row."""
    members = F.from_json(F.lit(json.dumps([[int(i) for i in c] for c in clusters])), "array<array<int>>")
    total = lambda row, c: F.aggregate(c, F.lit(0.0), lambda a, i: a + F.get(row, i))
    return bind(features, lambda row: F.transform(members, lambda c: total(row, c) / F.size(c).cast("double")))

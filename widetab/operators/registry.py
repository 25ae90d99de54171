"""Methods and learners by name."""

from __future__ import annotations

from widetab.operators import gate, reduce, select
from widetab.operators.base import Reducer

REDUCERS: dict[str, type[Reducer]] = {
    c.method: c
    for c in (
        select.Original, select.RandomSelector, select.VarianceSelector, select.TreeSelector, select.KBestSelector,
        reduce.PCAReducer, reduce.RandomProjectionReducer, reduce.WardReducer, reduce.KernelPCAReducer,
        reduce.KBestPCAReducer, gate.GateSelector, select.LassoSelector, select.EnsembleSelector,
    )
}


def register_reducer(cls: type[Reducer]) -> type[Reducer]:
    """Add a user's own method under its ``method`` name."""
    REDUCERS[cls.method] = cls
    return cls


def make_reducer(method: str, **params) -> Reducer:
    if method not in REDUCERS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(REDUCERS)}")
    return REDUCERS[method](**params)

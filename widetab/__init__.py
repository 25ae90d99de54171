"""A PySpark toolkit for tables with very many columns: impute, encode, split, narrow, learn, score, report."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task functions are sent with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

from widetab.operators.registry import make_reducer, register_reducer  # noqa: E402
from widetab.operators.learn import bag, make_learner, register_learner, score_with  # noqa: E402
from widetab.operators.base import Reducer, ReducerModel  # noqa: E402
from widetab.plans.experiment import Experiment, run, width_sweep  # noqa: E402
from widetab.session import build_session  # noqa: E402

__all__ = [
    "Experiment", "Reducer", "ReducerModel", "bag", "build_session", "make_learner", "make_reducer",
    "register_learner", "register_reducer", "run", "score_with", "width_sweep",
]

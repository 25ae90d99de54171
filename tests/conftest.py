import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from widetab.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, x, y=None, ids=None):
    """A numpy matrix as a feature table spread over several partitions."""
    ids = range(len(x)) if ids is None else ids
    y = np.zeros(len(x)) if y is None else y
    rows = [(int(i), v.item() if hasattr(v, "item") else v, [None if np.isnan(c) else float(c) for c in r]) for i, v, r in zip(ids, y, x)]
    kind = "string" if isinstance(rows[0][1], str) else "int" if isinstance(rows[0][1], int) else "double"
    return spark.createDataFrame(rows, f"row_id bigint, label {kind}, features array<double>").repartition(4)


def to_numpy(df, column="features"):
    rows = sorted((r["row_id"], r[column]) for r in df.select("row_id", column).collect())
    return np.array([r[1] for r in rows], dtype=float)


@pytest.fixture
def planted():
    """200 x 30 with four informative columns (3, 11, 17, 25)."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 30))
    signal = [3, 11, 17, 25]
    score = x[:, signal].sum(axis=1)
    return x, score, signal

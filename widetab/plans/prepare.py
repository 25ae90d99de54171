"""The preprocessing pipeline of one split: impute, encode, impute again, and optionally narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.operators.base import Reducer
from widetab.operators.encode import ColumnEncoder, LabelCoder
from widetab.operators.impute import ColumnImputer, FeatureImputer


class FittedStages:
    """What was fitted on the training rows, in order: applied to other rows it prepares them like test rows."""

    def __init__(self, stages: list, names: list[str]):
        self.stages, self.names = list(stages), list(names)

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df


class Prepared:
    """Encoded parts of a split with what was learnt from the training rows."""

    def __init__(self, train: DataFrame, test: DataFrame, names: list[str], classes: list, reducer=None, fitted: FittedStages | None = None):
        self.train, self.test, self.names, self.classes, self.reducer, self.fitted = train, test, names, classes, reducer, fitted


def is_encoded(df: DataFrame) -> bool:
    return "features" in df.columns and df.schema["features"].dataType.typeName() == "array"


def prepare(
    train: DataFrame, test: DataFrame, task_type: str, label: str = "label", row_id: str = "row_id",
    reducer: Reducer | None = None, own_stats: bool = False, names: list[str] | None = None,
) -> Prepared:
    """Fit everything on ``train`` and apply it to both parts.

    ``own_stats`` fills the test part from its own statistics. A table that already has the array layout
    only gets its missing features filled. With ``reducer`` the features are narrowed once per split.
    """
    classes: list = []
    stages: list = []
    if is_encoded(train):
        imputer = FeatureImputer()
        filled = imputer.fit(train)
        stages.append(filled)
        test_filler = imputer.fit(test) if own_stats else filled
        encoded_train, encoded_test, names_out = filled.transform(train), test_filler.transform(test), list(names or [])
    else:
        features = [c for c in train.columns if c not in (label, row_id)]
        imputer = ColumnImputer(features)
        filled = imputer.fit(train)
        test_filler = imputer.fit(test) if own_stats else filled
        full_train, full_test = filled.transform(train), test_filler.transform(test)
        encoder = ColumnEncoder(label, row_id).fit(full_train)
        encoded_train, encoded_test = encoder.transform(full_train), encoder.transform(full_test)
        names_out = encoder.names_out
        stages += [filled, encoder]
        # Encoding can leave gaps (a value outside a two-valued column, a missing timestamp).
        if encoder.may_leave_gaps:
            again = FeatureImputer().fit(encoded_train)
            stages.append(again)
            encoded_train, encoded_test = again.transform(encoded_train), again.transform(encoded_test)
    if task_type != "regression":
        coder = LabelCoder().fit(encoded_train)
        classes = coder.classes
        stages.append(coder)
        encoded_train, encoded_test = coder.transform(encoded_train), coder.transform(encoded_test)
    else:
        encoded_train = encoded_train.withColumn("label", F.col("label").cast("double"))
        encoded_test = encoded_test.withColumn("label", F.col("label").cast("double"))
    model = None
    if reducer is not None:
        model = reducer.fit(encoded_train)
        stages.append(model)
        encoded_train, encoded_test, names_out = model.transform(encoded_train), model.transform(encoded_test), model.names_out
    return Prepared(encoded_train, encoded_test, names_out, classes, model, FittedStages(stages, names_out))

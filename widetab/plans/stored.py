"""Fitted stages as files: imputers, encoders, label coders, reducers, learners and whole bagged models.

A stored object is a folder: one JSON row with its plain state, a folder for each object it holds, a Parquet table for each
table it holds. Code tables of any length and classes keep their types that way, and nothing passes through the driver
that the fitted object does not hold there anyway.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.operators import base, boosting, encode, impute, learn, target
from widetab.plans.prepare import FittedStages


class Shape:
    """How a class is taken apart: plain values, objects inside it, tables inside it."""

    def __init__(self, split: Callable, build: Callable):
        self.split, self.build = split, build


def _union(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    joined = None
    for name, table in tables.items():
        own = table.select(F.lit(name).alias("column"), "value", "code")
        joined = own if joined is None else joined.unionByName(own)
    return {} if joined is None else {"codes": joined}


def _encoder(m):
    names = ("label", "row_id", "keep", "columns", "binary", "literal", "modes", "constant", "duplicates", "hot")
    return {n: getattr(m, n) for n in names} | {"dates": sorted(m.dates), "long": list(m.tables)}, {}, _union(m.tables)


def _build_encoder(state, parts, tables):
    long = {c: tables["codes"].filter(F.col("column") == c).select("value", "code") for c in state["long"]}
    binary = {c: tuple(v) for c, v in state["binary"].items()}
    hot = [tuple(h) for h in state["hot"]]
    return encode.ColumnEncoderModel(
        state["label"], state["row_id"], state["keep"], state["columns"], set(state["dates"]), binary, state["literal"], long,
        state["modes"], state["constant"], state["duplicates"], hot)


def _classes(m):
    dtype = m.dtype or "string"
    spark = SparkSession.getActiveSession()
    return {"label": m.label, "out": m.out}, {}, {"classes": spark.createDataFrame(list(enumerate(m.classes)), f"position int, value {dtype}")}


def _build_classes(state, parts, tables):
    rows = tables["classes"].orderBy("position").collect()
    return encode.LabelCoderModel(state["label"], state["out"], [r["value"] for r in rows], tables["classes"].schema["value"].dataType.simpleString())


def _trees(m):
    trees = [{n: getattr(t, n).tolist() for n in ("feature", "bin", "left", "value")} for t in m.trees]
    state = {"trees": trees, "base": m.base.tolist(), "cuts": [c.tolist() for c in m.cuts], "classes": m.classes, "centre": m.centre, "scale": m.scale}
    return state, {} if m.statistics is None else {"statistics": m.statistics}, {}


def _build_trees(state, parts, tables):
    trees = []
    for t in state["trees"]:
        tree = boosting.Tree(state["classes"])
        tree.feature, tree.bin, tree.left = (np.array(t[n], np.int32) for n in ("feature", "bin", "left"))
        tree.value = np.array(t["value"], float).reshape(-1, state["classes"])
        trees.append(tree)
    model = boosting.BoostedModel(trees, np.array(state["base"], float), [np.array(c, float) for c in state["cuts"]], state["classes"], state["centre"], state["scale"])
    model.statistics = parts.get("statistics")
    return model


def _statistics(m):
    e = m.encoder
    classes = 0 if e.wanted == [None] else 2 if e.wanted == [1] else len(e.wanted)
    state = {"categories": e.categories, "task_type": e.task_type, "classes": classes, "seed": e.seed, "weight": e.weight, "prior": m.prior}
    return state, {}, {"table": m.table}


def _build_statistics(state, parts, tables):
    encoder = target.TargetEncoder(state["categories"], state["task_type"], state["classes"], state["seed"], state["weight"])
    return target.TargetStatistics(encoder, state["prior"], tables["table"])


def _bagged(m):
    parts = {f"fold{i}_{n}": p for i, pair in enumerate(m.folds) for n, p in zip(("reducer", "learner"), pair) if p is not None}
    if m.refit is not None:
        parts |= {f"refit_{n}": p for n, p in zip(("reducer", "learner"), m.refit) if p is not None}
    state = {"val_scores": m.val_scores, "task_type": m.task_type, "folds": len(m.folds), "refit": m.refit is not None}
    return state, parts, {} if m.oof is None else {"oof": m.oof}


def _build_bagged(state, parts, tables):
    pair = lambda name: (parts.get(f"{name}_reducer"), parts[f"{name}_learner"])
    folds = [pair(f"fold{i}") for i in range(state["folds"])]
    return learn.BaggedModel(tables.get("oof"), state["val_scores"], folds, pair("refit") if state["refit"] else None, state["task_type"])


def _stages(m):
    return {"names": m.names, "stages": len(m.stages)}, {f"stage{i}": s for i, s in enumerate(m.stages)}, {}


SHAPES = {
    "ColumnImputerModel": Shape(lambda m: ({"means": m.means, "modes": m.modes}, {}, {}), lambda s, p, t: impute.ColumnImputerModel(s["means"], s["modes"])),
    "FeatureImputerModel": Shape(lambda m: ({"means": m.means}, {}, {}), lambda s, p, t: impute.FeatureImputerModel(s["means"])),
    "ColumnEncoderModel": Shape(_encoder, _build_encoder),
    "LabelCoderModel": Shape(_classes, _build_classes),
    "BoostedModel": Shape(_trees, _build_trees),
    "TargetStatistics": Shape(_statistics, _build_statistics),
    "BaggedModel": Shape(_bagged, _build_bagged),
    "FittedStages": Shape(_stages, lambda s, p, t: FittedStages([p[f"stage{i}"] for i in range(s["stages"])], s["names"])),
}


def save(fitted, path: str) -> None:
    """Write a fitted object below ``path``, which must not hold one already."""
    spark = SparkSession.getActiveSession()
    kind = type(fitted).__name__
    if isinstance(fitted, base.ReducerModel):
        note, parts, tables = {"kind": "ReducerModel"}, {}, {}
        fitted.save(f"{path}/reducer")
    elif isinstance(fitted, learn.SparkLearnerModel):
        note, parts, tables = {"kind": kind, "state": {"task_type": fitted.task_type, "classes": fitted.classes}}, {}, {}
        fitted.model.write().save(f"{path}/model")
    elif kind in SHAPES:
        state, parts, tables = SHAPES[kind].split(fitted)
        note = {"kind": kind, "state": state, "parts": list(parts), "tables": list(tables)}
    else:
        raise ValueError(f"a {kind} cannot be stored")
    for name, part in parts.items():
        save(part, f"{path}/{name}")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.parquet(f"{path}/note")


def load(spark: SparkSession, path: str):
    """The object written below ``path``."""
    note = json.loads(spark.read.parquet(f"{path}/note").first()["note"])
    if note["kind"] == "ReducerModel":
        return base.ReducerModel.load(f"{path}/reducer")
    if note["kind"] == "SparkLearnerModel":
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        return learn.SparkLearnerModel(model, note["state"]["task_type"], note["state"]["classes"])
    parts = {name: load(spark, f"{path}/{name}") for name in note["parts"]}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in note["tables"]}
    return SHAPES[note["kind"]].build(note["state"], parts, tables)

"""Method x repeat x fold experiments and width sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions.naming import metrics_for, split_budget
from widetab.operators import split
from widetab.operators.layout import checked_broadcast
from widetab.operators.learn import bag, fit_alone, make_learner
from widetab.operators.registry import make_reducer
from widetab.operators.stats import infer_task_type
from widetab.plans.prepare import prepare
from widetab.plans.report import method_summary
from widetab.sources import results as result_files
from widetab.sources.tables import split_dimensions

RESULT_SCHEMA = (
    "dataset_name string, model string, method string, num_features int, repeat int, fold int, seed int, "
    "metric string, score double, norm_rmse double, val_score double, fold_time double"
)
ERROR_SCHEMA = "dataset_name string, model string, method string, num_features int, repeat int, fold int, seed int, message string, stage string"

# Repeats and folds of a table without published splits, and of a dry run.
DIMENSIONS, DRY_DIMENSIONS = (10, 3), (2, 2)

# Default width sweep.
SWEEP_WIDTHS = tuple(range(100, 1401, 100))


@dataclass(frozen=True)
class Experiment:
    """What to run.

    ``scope`` is where a method is fitted: once per ``split`` or inside every inner ``fold``. A ``splitter``
    takes the table, repeat, fold and fold seed, and adds a ``part`` column with ``train`` and ``test``.

    Repeats and folds that are not given are those of the published splits, 10 x 3 without any; a ``dry_run`` has 2 x 2.
    Without ``bagging`` a unit fits one learner to all training rows and has no validation score. ``reducer_seed``
    ``scope`` seeds a method by the repeat when it is fitted once per split, and by the seed of the experiment inside
    folds; ``repeat`` and ``base`` choose one of them for both.
    """

    dataset_name: str
    model: str = "gbt"
    methods: Sequence[str] = ("random_fs",)
    task_type: str | None = None
    num_features: int = 150
    num_repeats: int | None = None
    num_folds: int | None = None
    num_k_folds: int = 8
    bagging: bool = True
    dry_run: bool = False
    test_size: float = 0.3
    seed: int = 44
    scope: str = "fold"
    own_stats: bool = False
    save_time: bool = True
    reducer_seed: str = "scope"
    parallelism: int = 4
    splitter: Callable[[DataFrame, int, int, int], DataFrame] | None = None
    method_params: dict = field(default_factory=dict)
    learner_params: dict = field(default_factory=dict)


def split_parts(table: DataFrame, splits: DataFrame | None, exp: Experiment, task_type: str, repeat: int, fold: int):
    """Training and test rows of one unit."""
    fold_seed = exp.seed + 100 * repeat + fold
    if exp.splitter is not None:
        marked = exp.splitter(table, repeat, fold, fold_seed)
    elif splits is not None:
        chosen = splits.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).select("row_id", "part")
        marked = table.join(checked_broadcast(chosen), "row_id")
    elif "is_test" in table.columns:
        marked = split.boundary_split(table).drop("is_test")
    else:
        label = None if task_type == "regression" else "label"
        marked = split.holdout(table, exp.test_size, fold_seed, label)
    side = lambda name: marked.filter(F.col("part") == name).drop("part")
    return side("train"), side("test")


def units(exp: Experiment, table: DataFrame, splits: DataFrame | None = None) -> list[tuple[int, int]]:
    """Repeats x folds; a fixed appended test table gives the same split every time, so it runs once."""
    if "is_test" in table.columns and splits is None and exp.splitter is None:
        return [(0, 0)]
    if exp.dry_run:
        repeats, folds = DRY_DIMENSIONS
    else:
        missing = exp.num_repeats is None or exp.num_folds is None
        given = split_dimensions(splits) if missing and splits is not None else DIMENSIONS
        repeats, folds = exp.num_repeats or given[0], exp.num_folds or given[1]
    return [(r, f) for r in range(repeats) for f in range(folds)]


def run(table: DataFrame, exp: Experiment, splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(results, errors)``: one result row per method and unit, one error row per failed unit.

    The driver only schedules: every unit is a handful of Spark jobs on the whole table. A split is
    imputed and encoded once for all methods and kept while they run.
    """
    return _run(table, exp, splits, (exp.num_features,))


def _run(table: DataFrame, exp: Experiment, splits: DataFrame | None, widths: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    if exp.scope not in ("split", "fold"):
        raise ValueError(f"unknown scope {exp.scope!r}")
    if exp.reducer_seed not in ("scope", "repeat", "base"):
        raise ValueError(f"unknown reducer_seed {exp.reducer_seed!r}")
    spark = table.sparkSession
    task_type = infer_task_type(table, "label", exp.task_type)
    metric = metrics_for(task_type)[0]
    results, errors = [], []
    for repeat, fold in units(exp, table, splits):
        rep_seed = exp.seed + 100 * repeat
        keys = lambda method, k: (exp.dataset_name, exp.model, method, int(k), repeat, fold, rep_seed)
        try:
            prepared = prepare(*split_parts(table, splits, exp, task_type, repeat, fold), task_type, own_stats=exp.own_stats)
            train, test = prepared.train.persist(), prepared.test.persist()
        except Exception as error:  # a failed split fails all its methods and nothing else
            errors += [(*keys(m, k), _message(error), "prepare") for k in widths for m in exp.methods]
            continue
        for k in widths:
            for method in exp.methods:
                started, stage = time.monotonic(), []
                try:
                    scores, val = _unit(train, test, prepared, replace(exp, num_features=int(k)), method, task_type, rep_seed, stage)
                    elapsed = time.monotonic() - started if exp.save_time else None
                    results.append((*keys(method, k), metric, scores[metric], scores.get("norm_rmse"), val.get(metric), elapsed))
                except Exception as error:
                    errors.append((*keys(method, k), _message(error), stage[-1]))
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(results, RESULT_SCHEMA), spark.createDataFrame(errors, ERROR_SCHEMA)


def save_run(results: DataFrame, exp: Experiment, path: str, started: datetime, finished: datetime | None = None) -> DataFrame:
    """Append the result rows below ``path/results`` and one configuration per method below ``path/configs``.

    Returns the summary: mean and deviation of the score per method and metric. A run of one table has a
    row per method and unit, so its times are few enough to read back.
    """
    result_files.write_results(results, f"{path}/results")
    times: dict[str, list[float]] = {m: [] for m in exp.methods}
    for r in results.select("method", "fold_time").filter(F.col("fold_time").isNotNull()).collect():
        times[r["method"]].append(r["fold_time"])
    stamp = started.strftime("%Y%m%d_%H%M%S")
    for method in exp.methods:
        selected, projected = split_budget(exp.num_features, exp.method_params.get(method, {}).get("fs_ratio", 0.75))
        config = asdict(exp) | {
            "method": method, "num_kbest_features": selected, "num_pca_comps": projected, "time_start": stamp,
            "time_finish": (finished or datetime.now()).strftime("%Y%m%d_%H%M%S"),
        }
        run_id = f"{exp.dataset_name}_{method}_num_features_{exp.num_features}_{stamp}"
        result_files.write_config(results.sparkSession, run_id, config, f"{path}/configs", times[method] if exp.save_time else None)
    return method_summary(results, by=("method", "metric"))


def _message(error: Exception) -> str:
    text = str(error).strip() or repr(error)
    return f"{type(error).__name__}: {text.splitlines()[0]}"


def _unit(train, test, prepared, exp: Experiment, method: str, task_type: str, rep_seed: int, stage: list[str]):
    """Test and validation scores of one method; ``stage`` notes what has been begun."""
    stage.append("reduce")
    by_repeat = exp.reducer_seed == "repeat" or exp.reducer_seed == "scope" and exp.scope == "split"
    reducer = make_reducer(
        method, num_features=exp.num_features, task_type=task_type, seed=rep_seed if by_repeat else exp.seed, names=prepared.names or None,
        **exp.method_params.get(method, {}),
    )
    learner = make_learner(exp.model, task_type=task_type, classes=len(prepared.classes), seed=rep_seed, **exp.learner_params)
    if exp.scope == "split":
        narrowed = reducer.fit(train)
        train, test, reducer = narrowed.transform(train), narrowed.transform(test), None
    elif method == "original":
        reducer = None
    stage.append("fit")
    if exp.bagging:
        fitted = bag(train, learner, reducer, exp.num_k_folds, task_type, rep_seed, parallelism=exp.parallelism)
    else:
        fitted = fit_alone(train, learner, reducer, task_type)
    stage.append("score")
    scores = fitted.score(test)
    fitted.release()
    return scores, fitted.val_scores


def width_sweep(table: DataFrame, exp: Experiment, widths: Sequence[int] = SWEEP_WIDTHS, splits: DataFrame | None = None):
    """The experiment at every target width; ``(results, errors)`` of all widths together.

    A split is prepared once and serves all widths.
    """
    return _run(table, exp, splits, widths)


def metric_columns(results: DataFrame) -> DataFrame:
    """The long results with one column per metric and its validation score, as older files have them."""
    keys = [c for c in results.columns if c not in ("metric", "score", "val_score")]
    for name in ("log_loss", "roc_auc", "rmse"):
        results = results.withColumn(name, F.when(F.col("metric") == name, F.col("score")))
        results = results.withColumn(f"val_{name}", F.when(F.col("metric") == name, F.col("val_score")))
    return results.select(*keys, *[p + m for m in ("log_loss", "roc_auc", "rmse") for p in ("", "val_")])


def grid(datasets: DataFrame, models: Sequence[str], methods: Sequence[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Models x datasets x methods for a ``(dataset)`` table; aliases are resolved, unknown ones raise.

    A dataset may be an alias, a numeric id or ``csv:<path>``. Small lists are exploded inside the row.
    """
    name = F.col("dataset")
    pairs = [F.lit(v) for item in (aliases or {}).items() for v in item]
    known = F.try_element_at(F.create_map(*pairs), name) if pairs else F.lit(None).cast("string")
    source = (
        F.when(name.startswith("csv:"), F.regexp_replace(name, "^csv:", "csv_path:"))
        .when(name.rlike(r"^\d+$"), F.concat(F.lit("task:"), name))
        .when(known.isNotNull(), F.concat(F.lit("task:"), known))
    )
    resolved = F.when(source.isNotNull(), source).otherwise(
        F.raise_error(F.concat(F.lit("unknown dataset alias "), name))
    )
    return (
        datasets.withColumn("source", resolved)
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    )

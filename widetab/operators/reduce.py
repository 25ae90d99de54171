"""Methods that replace the features by fewer new ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widetab.functions.rng import hash52, normal
from widetab.operators import matrix
from widetab.operators.base import (
    KernelModel, PoolingModel, ProjectionModel, Reducer, ReducerModel, SelectAndProjectModel, SelectorModel,
)
from widetab.operators.layout import known_width
from widetab.operators.matrix import FOLD_BYTES, GRAM_LIMIT
from widetab.operators.select import KBestSelector
from widetab.operators.ward import ward_clusters
from widetab.functions.naming import split_budget

BLOCK_WIDTH = 64  # directions that one pass over the rows of a very wide table multiplies
BLOCK_CELLS = 1 << 23  # cells of a wider block than the axes ask for
RESIDUAL = 1e-6  # largest residual of a principal axis, as a share of the largest variance


def numbered(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{i}" for i in range(k)]


def fix_signs(axes: np.ndarray) -> np.ndarray:
    """Turn every column so that its largest-magnitude entry is positive (lowest index on ties)."""
    top = np.abs(axes).argmax(axis=0)
    signs = np.sign(axes[top, np.arange(axes.shape[1])])
    return axes * np.where(signs == 0, 1.0, signs)


def leading_axes(symmetric: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` largest eigenvalues and their eigenvectors as columns, signs fixed."""
    values, vectors = np.linalg.eigh(symmetric)
    order = np.argsort(-values, kind="stable")[:k]
    return np.maximum(values[order], 0.0), fix_signs(vectors[:, order])


def principal_axes(df: DataFrame, k: int, seed: int = 0, gram_limit: int = GRAM_LIMIT, features: str = "features", tol: float = RESIDUAL):
    """``(axes d x k, means, explained variances, total variance)`` of the centred features.

    Narrow tables: one pass for the means, one for the covariance, eigenvectors on the driver. Wide ones: block Lanczos,
    whose passes return a few columns of length d. Both give axes with ``|C v - variance v| <= tol * largest variance``.
    """
    n, means, variances = matrix.column_moments(df, features)
    d = len(means)
    if not 1 <= k <= min(n, d):
        raise ValueError(f"cannot compute {k} components of {n} rows and {d} features")
    total = float(variances.sum() * n / max(n - 1, 1))
    if d > gram_limit:
        axes, values = block_lanczos(df, d, n, means, k, seed, features=features, tol=tol)
        return axes, means, values, total
    gram = matrix.collect_blocks(matrix.gram_blocks(df, d, means, features), d, d, symmetric=True)
    values, axes = leading_axes(gram / max(n - 1, 1), k)
    return axes, means, values, total


def block_lanczos(df: DataFrame, d: int, n: int, means: np.ndarray, k: int, seed: int, block: int = 0, features: str = "features", tol: float = RESIDUAL, max_passes: int = 300):
    """Leading eigenvectors of the covariance without forming it: a Krylov space of blocks with thick restarts.

    Every pass over the rows multiplies one block of directions. The best axes of the space spanned so far are found on
    the driver with their residuals; what the image of the last block has outside that space is the next block, and it
    holds the residuals of all axes. Blocks are wide, also for few axes: reading the rows costs more than multiplying them,
    and a wide block spares passes. When the space has grown to three times the axes wanted and a block it is replaced by
    the best ones (Wu and Simon 2000). The driver holds that many columns twice. It ends when all residuals are within ``tol`` of the largest eigenvalue, or when the space
    cannot grow any more, and raises an error when ``max_passes`` do not suffice.
    """
    block = min(block or max(8, min(k, BLOCK_WIDTH), min(BLOCK_WIDTH, BLOCK_CELLS // d)), d)
    kept_size = min(d, k + block)
    largest = min(d, 3 * kept_size)
    rng = np.random.Generator(np.random.Philox(key=seed))
    fresh = np.linalg.qr(rng.standard_normal((d, block)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_passes):
        image = np.hstack([image, matrix.normal_equations_pass(df, fresh, means, features)])
        basis = np.hstack([basis, fresh])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        wanted = min(k, len(values))
        axes = basis @ turn[:, :wanted]
        rest = image @ turn[:, :wanted] - axes * values[:wanted]
        sizes = np.linalg.norm(rest, axis=0)
        bound = tol * max(values[0], 1e-300)
        if len(values) >= k and (sizes <= bound).all():
            break
        spanned, outside = basis, image[:, -fresh.shape[1]:]
        if basis.shape[1] + block > largest:
            basis, image = basis @ turn[:, :kept_size], image @ turn[:, :kept_size]
        fresh = new_directions(spanned, outside / max(np.linalg.norm(outside), 1e-300))
        if fresh.shape[1] < block:  # as many random directions as are missing, so that the space can reach what it has not seen
            fresh = np.hstack([fresh, rng.standard_normal((d, block - fresh.shape[1]))])
        fresh = new_directions(basis, fresh)
        if not fresh.shape[1]:
            break
    else:
        raise ValueError(f"{max_passes} passes leave residuals of {sizes.max():.3g} against {bound:.3g}; ask for fewer components")
    signed = fix_signs(axes)
    return signed, np.maximum(values[:k], 0.0) / max(n - 1, 1)


def new_directions(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``block`` outside the space of ``basis``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-10] / size[size > 1e-10]
    q, r = np.linalg.qr(block) if block.shape[1] else (block, np.zeros((0, 0)))
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    return q[:, :max(0, len(basis) - basis.shape[1])]


def one_scan_fits(df: DataFrame, folds: int) -> bool:
    """Whether the covariance matrices of all folds together are small enough for the driver."""
    return matrix.fold_matrices_fit(known_width(df), folds, FOLD_BYTES)


class PCAReducer(Reducer):
    """Projection of the centred features on the principal axes."""

    method = "pca_dr"

    def _fit(self, df: DataFrame) -> ProjectionModel:
        k = self.get("num_features")
        axes, means, values, total = principal_axes(df, k, self.get("seed"))
        return ProjectionModel(axes, means @ axes, numbered("PCA", k), values, total)

    def fit_folds(self, df, folds, fold="fold"):
        if not one_scan_fits(df, folds):
            return super().fit_folds(df, folds, fold)
        k, models = self.get("num_features"), {}
        for i, (n, means, gram) in enumerate(matrix.fold_covariances(df, folds, fold)):
            if not 1 <= k <= min(n, len(means)):
                raise ValueError(f"cannot compute {k} components of {n} rows and {len(means)} features")
            values, axes = leading_axes(gram / max(n - 1, 1), k)
            models[i] = ProjectionModel(axes, means @ axes, numbered("PCA", k), values, float(np.trace(gram)) / max(n - 1, 1))
        return models


def gaussian_matrix(spark: SparkSession, d: int, k: int, seed: int) -> DataFrame:
    """``(feature_idx, weights ARRAY<DOUBLE>)``: entries N(0, 1/k) hashed from (seed, row, column)."""
    cell = lambda j: normal(seed, F.col("id"), j) / F.sqrt(F.lit(float(k)))
    return spark.range(d).select(
        F.col("id").cast("int").alias("feature_idx"),
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), cell).alias("weights"),
    )


class RandomProjectionReducer(Reducer):
    """Gaussian random projection; it does not look at the data and does not centre."""

    method = "random_dr"

    def _fit(self, df: DataFrame) -> ProjectionModel:
        d, k = self._width(df), self.get("num_features")
        if k < 1:
            raise ValueError("at least one component is needed")
        table = gaussian_matrix(df.sparkSession, d, k, self.get("seed")).orderBy("feature_idx").toArrow()
        weights = matrix.batch_matrix(table.column("weights"), k)
        return ProjectionModel(weights, np.zeros(k), numbered("RP", k))


class WardReducer(Reducer):
    """Means of Ward clusters of features, numbered by their smallest member."""

    method = "agglo_dr"

    def _fit(self, df: DataFrame) -> PoolingModel:
        k = self.get("num_features")
        return PoolingModel(ward_clusters(df, k), numbered("Agglo", k))


def choose_landmarks(df: DataFrame, m: int, seed: int) -> DataFrame:
    """``m`` rows with the smallest hashes: a bounded top-k, not a sort."""
    key = hash52(seed, F.col("row_id"))
    return df.select("row_id", "features", key.alias("_key")).orderBy("_key", "row_id").limit(m).drop("_key")


class Landmarks:
    """Rows whose kernel functions span those of all rows, up to a residual.

    ``points @ ...`` is the incomplete Cholesky factor of the kernel: the kernel of a row with the points, times
    ``whiten``, gives coordinates whose products are the kernel without the residual.
    """

    def __init__(self, d: int, gamma: float):
        self.gamma, self.points, self.ids = gamma, np.zeros((0, d)), []
        self.factor = np.zeros((0, 0))  # lower triangular: factor @ factor.T is the kernel of the points

    @property
    def whiten(self) -> np.ndarray:
        return np.linalg.inv(self.factor).T if len(self.ids) else np.zeros((0, 0))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return matrix.kernel_rows(x, self.points, self.gamma) @ self.whiten

    def add(self, x: np.ndarray, row_id, coordinates: np.ndarray, residual: float) -> None:
        m = len(self.ids)
        factor = np.zeros((m + 1, m + 1))
        factor[:m, :m], factor[m, :m], factor[m, m] = self.factor, coordinates, np.sqrt(residual)
        self.points, self.factor = np.vstack([self.points, x]), factor
        self.ids.append(row_id)

    def take(self, x: np.ndarray, ids: list, slack: float, limit: int, least: float) -> int:
        """Add candidates in the order of their residuals; how many were added.

        All other rows have at most the residual of the last candidate. So the candidate with the largest residual is the
        next pivot as long as it exceeds that; ``slack`` below 1 also takes those that exceed this share of it.
        """
        rows = self.coordinates(x)
        residual = np.round(1.0 - (rows * rows).sum(axis=1), 12)
        bound, added = slack * residual[-1], 0
        free = np.ones(len(x), bool)
        while free.any() and len(self.ids) < limit:
            best = int(np.where(free, residual, -np.inf).argmax())
            if residual[best] <= least or added and residual[best] <= bound:
                break
            self.add(x[best], ids[best], rows[best], residual[best])
            free[best] = False
            added += 1
            column = (matrix.kernel_rows(x, x[best:best + 1], self.gamma)[:, 0] - rows @ rows[best]) / np.sqrt(residual[best])
            rows = np.column_stack([rows, column])
            residual = np.round(1.0 - (rows * rows).sum(axis=1), 12)
        return added


def kernel_landmarks(df: DataFrame, gamma: float, share: float, least: int = 1, limit: int | None = None, candidates: int = 64, slack: float = 0.5, seed: int = 0):
    """``(landmarks, residual)``: pivoted incomplete Cholesky of the RBF kernel of all rows (Fine and Scheinberg 2001).

    Landmarks are added, the largest residual first, until the residual is at most ``1 - share`` of the trace of the
    centred kernel and there are ``least`` of them, or no row has a residual. One pass gives the residual of all rows and
    those with the largest ones; equal residuals are ordered by hash and id. ``limit`` ends it earlier: the residual says
    what is left.
    """
    d = known_width(df)
    marks = Landmarks(d, gamma)
    rows = df.select("row_id", "features", hash52(seed, F.col("row_id")).alias("_key"))
    kind = dict(rows.dtypes)["row_id"]
    while True:
        m, frozen = len(marks.ids), df.sparkSession.sparkContext.broadcast((marks.points, marks.whiten))

        def measure(batches, m=m, frozen=frozen):
            points, whiten = frozen.value
            total = np.zeros(m + 3)  # rows, residuals, squared lengths, coordinates
            best: list = []
            for batch in batches:
                x, parts = matrix.batch_matrix(batch.column(1), d), []
                for piece in matrix.row_pieces(len(x), m):
                    own = matrix.kernel_rows(x[piece], points, gamma) @ whiten if m else np.zeros((piece.stop - piece.start, 0))
                    length = np.einsum("ij,ij->i", own, own)
                    parts.append(np.round(1.0 - length, 12))
                    total += np.concatenate([[len(own), parts[-1].sum(), length.sum()], own.sum(axis=0)])
                residual = np.concatenate(parts) if parts else np.zeros(0)
                keys = batch.column(2).to_pylist()
                ids = batch.column(0).to_pylist()
                top = np.argsort(-residual, kind="stable")
                top = top[residual[top] >= residual[top[min(candidates, len(top)) - 1]]] if len(top) else top
                best += [(-residual[i], keys[i], ids[i], x[i].copy()) for i in top]
                best = sorted(best, key=lambda r: r[:3])[:candidates]
            lists = [[r[i] for r in best] for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *[-v for v in lists[0]]], pa.float64()), pa.array([None, *lists[1]], pa.int64()), pa.array([None, *lists[2]]).cast(batch_kind), pa.array([total, *[r[3] for r in best]])],
                names=["residual", "_key", "row_id", "features"])

        batch_kind = pa.string() if kind == "string" else pa.int64()
        found = rows.mapInArrow(measure, f"residual double, _key bigint, row_id {'string' if kind == 'string' else 'bigint'}, features array<double>").persist()
        sums = matrix.add_rows(found.filter("residual is null").select("features"))
        n, left, length = sums[:3]
        if not n:
            raise ValueError("the table has no rows")
        trace = length - (sums[3:] ** 2).sum() / n + left  # of the centred kernel
        enough = left <= (1.0 - share) * trace and m >= least
        if enough or (limit is not None and m >= limit):
            found.unpersist()
            frozen.destroy()
            return marks, float(left / trace) if trace > 0 else 0.0
        top = found.filter("residual is not null").orderBy(F.col("residual").desc(), "_key", "row_id").limit(candidates).toArrow()
        found.unpersist()
        frozen.destroy()
        x = matrix.batch_matrix(top.column("features"), d)
        if 8 * (m + len(x)) * (d + m + len(x)) > 2 * matrix.MAX_BROADCAST_BYTES:
            raise ValueError(f"{m} landmarks leave {left / trace:.3g} of the kernel, and more are too large to broadcast; lower kernel_share or gamma, or set num_landmarks")
        if not marks.take(x, top.column("row_id").to_pylist(), slack, limit or len(x) + m, 1e-10):
            return marks, float(max(left, 0.0) / trace) if trace > 0 else 0.0


class KernelPCAReducer(Reducer):
    """RBF kernel PCA by a pivoted incomplete Cholesky factor of the kernel.

    Rows become landmarks until these span ``kernel_share`` of the centred kernel of all rows; every row is mapped to its
    coordinates, and the principal axes are those of the mapped rows. The share that is not spanned stays on the model as
    ``residual``; with a share of 1 the result is exact kernel PCA. ``num_landmarks`` asks for that many landmarks instead,
    and the residual tells what is missing. It is an error when ``num_features`` components do not exist.
    """

    method = "kpca_dr"

    def _fit(self, df: DataFrame) -> KernelModel:
        d, k = self._width(df), self.get("num_features")
        gamma = self.get("gamma") or 1.0 / d
        limit = self.get("num_landmarks")
        share = 1.0 if limit is not None and not self.isSet(self.kernel_share) else self.get("kernel_share")
        marks, residual = kernel_landmarks(df, gamma, share, least=k + 1, limit=limit, seed=self.get("seed"))
        m = len(marks.ids)
        if not 1 <= k <= m:
            raise ValueError(f"cannot compute {k} components from {m} landmarks")
        mapped = matrix.kernel_project(df.select("row_id", "features"), marks.points, gamma, marks.whiten, np.zeros(m))
        axes, means, spread, total = principal_axes(mapped, k, self.get("seed"))
        if spread[-1] <= 1e-10 * max(total, 1e-300):
            raise ValueError(f"cannot compute {k} components: the centred kernel has a rank of {int((spread > 1e-10 * total).sum())}")
        turned = marks.whiten @ axes
        components = fix_signs(turned)
        return KernelModel(marks.points, gamma, components, (means @ axes) * _sign_change(turned, components), numbered("KPCA", k), spread, residual)


def _sign_change(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.sign((before * after).sum(axis=0))


class KBestPCAReducer(Reducer):
    """The best features by univariate F, and principal components of the remaining ones."""

    method = "kbest+pca"

    def _budget(self) -> tuple[int, int]:
        selected, projected = split_budget(self.get("num_features"), self.get("fs_ratio"))
        given = self.get("num_kbest_features"), self.get("num_pca_comps")
        return (selected if given[0] is None else given[0], projected if given[1] is None else given[1])

    def _fit(self, df: DataFrame) -> ReducerModel:
        k1, k2 = self._budget()
        names = self.get("names")
        selector = KBestSelector(num_features=k1, task_type=self.get("task_type"), names=names or None).fit(df)
        return combine_with_pca(df, selector, k2, self.get("seed"))

    def fit_folds(self, df, folds, fold="fold"):
        k1, k2 = self._budget()
        names = self.get("names") or None
        selectors = KBestSelector(num_features=k1, task_type=self.get("task_type"), names=names).fit_folds(df, folds, fold)
        if not one_scan_fits(df, folds):
            return {i: combine_with_pca(df.filter(F.col(fold) != i), s, k2, self.get("seed")) for i, s in selectors.items()}
        # The components of the remaining features come from that part of the full fold matrices.
        models: dict[int, ReducerModel] = {}
        for i, (n, means, gram) in enumerate(matrix.fold_covariances(df, folds, fold)):
            selector = selectors[i]
            remaining = sorted(set(range(len(means))) - set(selector.indices))
            if not remaining or k2 == 0:
                models[i] = selector
                continue
            if k2 > min(n, len(remaining)):
                raise ValueError(f"cannot compute {k2} components of {n} rows and {len(remaining)} features")
            _, axes = leading_axes(gram[np.ix_(remaining, remaining)] / max(n - 1, 1), k2)
            models[i] = select_and_project(selector, remaining, axes, means[remaining])
        return models


def combine_with_pca(df: DataFrame, selector: SelectorModel, k2: int, seed: int) -> ReducerModel:
    d = known_width(df)
    chosen = set(selector.indices)
    remaining = [i for i in range(d) if i not in chosen]
    if not remaining or k2 == 0:
        return selector
    rest = SelectorModel(remaining, [str(i) for i in remaining]).transform(df)
    axes, means, _, _ = principal_axes(rest, k2, seed)
    return select_and_project(selector, remaining, axes, means)


def select_and_project(selector: SelectorModel, remaining: list[int], axes: np.ndarray, means: np.ndarray) -> SelectAndProjectModel:
    names = [*selector.names_out, *numbered("PCA", axes.shape[1])]
    return SelectAndProjectModel(selector.indices, remaining, axes, means @ axes, names, selector.report)


__all__ = [
    "PCAReducer", "RandomProjectionReducer", "WardReducer", "KernelPCAReducer", "KBestPCAReducer",
    "principal_axes", "block_lanczos", "kernel_landmarks", "gaussian_matrix", "choose_landmarks",
]

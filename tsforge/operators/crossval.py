"""Cross-validation of least squares from sums that can be subtracted.

One pass adds up, for each fold, the moments ``[x, 1, y]' [x, 1, y]`` of its rows. What a fold trains
on is the total less its own moments, so the scalers and fits of all folds cost one pass,
whatever their number, and no row is copied into the folds that use it. The fits stay a small table, one
row per fold with scaler and model together; a second pass applies all of them to each row as it
passes by and adds up errors by (fold of the row, fold of the model), from which validation scores are
the own cells and training scores the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = "fold INT, i INT, row ARRAY<DOUBLE>"
_FITS = (
    "fold INT, train_rows BIGINT, val_rows BIGINT, x_mean ARRAY<DOUBLE>, x_scale ARRAY<DOUBLE>, "
    "weights ARRAY<ARRAY<DOUBLE>>, bias ARRAY<DOUBLE>, train_mse DOUBLE, val_mse DOUBLE"
)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _known(rows: DataFrame) -> DataFrame:
    """Rows with a fold, a complete input and a complete target."""
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.select(F.col("fold").cast("int").alias("fold"), "x", "y").where(
        F.col("fold").isNotNull() & whole("x") & whole("y")
    )


def fold_moments(rows: DataFrame, inputs: int, targets: int) -> DataFrame:
    """``(fold, i, row)``: line ``i`` of each fold's moments of ``(fold, x ARRAY, y ARRAY)`` rows.

    A task sums the folds it meets and hands on their matrices; Spark adds those up by line.
    """
    width = inputs + 1 + targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x, y = _matrix(batch.column(1), inputs), _matrix(batch.column(2), targets)
            z = np.hstack([x, np.ones((len(x), 1)), y])
            for k in np.unique(fold):
                part = z[fold == k]
                total[int(k)] = total.get(int(k), 0) + part.T @ part
        for k, m in total.items():
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([k] * width, pa.int32()), "i": pa.array(range(width), pa.int32()),
                "row": pa.array(list(m), pa.list_(pa.float64())),
            })

    partial = _known(rows).mapInArrow(run, _CELLS)
    cells = partial.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    return cells.groupBy("fold", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).select(
        "fold", "i", F.col("row.v").alias("row")
    )


def _solve(m: np.ndarray, inputs: int, ridge: float):
    """(mean, scale, weights, bias) of scaled least squares from moments; zero spread scales by one."""
    n = m[inputs, inputs]
    xm, ym = m[:inputs, inputs] / n, m[inputs + 1 :, inputs] / n
    cov = m[:inputs, :inputs] / n - np.outer(xm, xm)
    cross = m[:inputs, inputs + 1 :] / n - np.outer(xm, ym)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[scale <= 1e-12 * np.maximum(np.abs(xm), 1.0)] = 1.0
    gram = cov / np.outer(scale, scale) + ridge * np.eye(inputs)
    weights = np.linalg.lstsq(gram, cross / scale[:, None], rcond=1e-12)[0]
    return xm, scale, weights, ym


def _mse(m: np.ndarray, inputs: int, xm, scale, weights, ym) -> float:
    """Mean squared error over all targets from moments: the mean of (y - b - W'(x - xm) / scale)**2."""
    n = m[inputs, inputs]
    if n == 0:
        return float("nan")
    w = weights / scale[:, None]
    # Columns that turn [x, 1, y] into residuals.
    out = np.vstack([-w, (xm @ w - ym)[None, :], np.eye(len(ym))])
    return float(np.mean(np.maximum(np.einsum("it,ij,jt->t", out, m, out), 0.0) / n))


def fold_fits(moments: DataFrame, inputs: int, targets: int, ridge: float = 0.0) -> DataFrame:
    """One row per fold: the scaler and the model fitted on all other folds, and both mean squared errors.

    The moments of all folds are ``folds * (inputs + 1 + targets)`` lines and are solved in one task. A fold
    that leaves nothing to train on has no row.
    """
    width = inputs + 1 + targets

    def run(lines: pa.Table) -> pa.Table:
        fold, i = lines["fold"].to_numpy(), lines["i"].to_numpy()
        values = np.array(lines["row"].to_pylist(), dtype=float)
        own = {int(k): np.zeros((width, width)) for k in np.unique(fold)}
        for k, place, row in zip(fold.tolist(), i.tolist(), values):
            own[k][place] = row
        total = sum(own.values())
        out = []
        for k, mine in sorted(own.items()):
            rest = total - mine
            if rest[inputs, inputs] < 0.5:
                continue
            fit = _solve(rest, inputs, ridge)
            xm, scale, weights, ym = fit
            out.append({
                "fold": k, "train_rows": round(rest[inputs, inputs]), "val_rows": round(mine[inputs, inputs]),
                "x_mean": xm.tolist(), "x_scale": scale.tolist(), "weights": weights.T.tolist(), "bias": ym.tolist(),
                "train_mse": _mse(rest, inputs, *fit), "val_mse": _mse(mine, inputs, *fit),
            })
        return pa.Table.from_pylist(out, schema=_fits_schema())

    return moments.groupBy(F.pmod("i", F.lit(1)).alias("all")).applyInArrow(run, _FITS)


def _fits_schema() -> pa.Schema:
    many = pa.list_(pa.float64())
    return pa.schema([
        ("fold", pa.int32()), ("train_rows", pa.int64()), ("val_rows", pa.int64()), ("x_mean", many), ("x_scale", many),
        ("weights", pa.list_(many)), ("bias", many), ("train_mse", pa.float64()), ("val_mse", pa.float64()),
    ])


def fold_errors(rows: DataFrame, fits: DataFrame, inputs: int, targets: int) -> DataFrame:
    """``(fold, split, rows, mse, rmse, mae)`` of every fold's model over its validation rows and over its
    training rows, means over rows and targets.

    Each row meets all models in the batch it arrives in; a task hands on sums by (fold of the row, model).
    """
    table = fits.toArrow().sort_by("fold")  # one row a fold
    number = table["fold"].to_numpy()
    mean, scale = (np.array(table[c].to_pylist(), dtype=float) for c in ("x_mean", "x_scale"))
    weights, bias = (np.array(table[c].to_pylist(), dtype=float) for c in ("weights", "bias"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            home = batch.column(0).to_numpy()
            x, y = _matrix(batch.column(1), inputs), _matrix(batch.column(2), targets)
            for k in range(len(number)):
                error = y - ((x - mean[k]) / scale[k] @ weights[k].T + bias[k])
                square, size = (error * error).sum(axis=1), np.abs(error).sum(axis=1)
                for h in np.unique(home):
                    at = home == h
                    key = (int(number[k]), int(h))
                    sums[key] = sums.get(key, 0) + np.array([at.sum(), square[at].sum(), size[at].sum()])
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([k for k, _ in keys], pa.int32()), "home": pa.array([h for _, h in keys], pa.int32()),
                "n": pa.array([round(sums[k][0]) for k in keys], pa.int64()),
                "square": pa.array([sums[k][1] for k in keys], pa.float64()),
                "size": pa.array([sums[k][2] for k in keys], pa.float64()),
            })

    cells = _known(rows).mapInArrow(run, "fold INT, home INT, n BIGINT, square DOUBLE, size DOUBLE")
    split = F.when(F.col("home") == F.col("fold"), "val").otherwise("train")
    mse = F.sum("square") / (F.sum("n") * targets)
    return cells.groupBy("fold", split.alias("split")).agg(
        F.sum("n").alias("rows"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        (F.sum("size") / (F.sum("n") * targets)).alias("mae"),
    )


def cross_validate(
    rows: DataFrame, inputs: int, targets: int = 1, ridge: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """``(fits, scores)`` of ``(fold, x ARRAY, y ARRAY)`` rows: ``fold_fits`` and ``fold_errors``.

    ``rows`` is read twice; write it first if it is costly. Rows with a missing input or target take no part.
    """
    fits = fold_fits(fold_moments(rows, inputs, targets), inputs, targets, ridge)
    return fits, fold_errors(rows, fits, inputs, targets)

"""Forecasters fitted and scored as Spark jobs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.constants import AR_LAGS, FOLDS, HORIZON_HOURS
from tsforge.functions.columns import round2, signed_exp
from tsforge.session import literal_table

# ------------------------------------------------------------- boosted trees


def gbt_pipeline(features: Sequence[str], target: str, depth: int = 5, rounds: int = 100, rate: float = 0.1, **params):
    """Missing features take their mean over the training rows; no row is left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"_filled_{c}" for c in features]
    imputer = Imputer(inputCols=list(features), outputCols=filled, strategy="mean")
    assembler = VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="error")
    trees = GBTRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="prediction",
        maxDepth=depth,
        maxIter=rounds,
        stepSize=rate,
        seed=0,
        **params,
    )
    return Pipeline(stages=[imputer, assembler, trees])


def gbt_fit_predict(
    train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, **params
) -> DataFrame:
    """Boosted trees fitted on the rows of ``train`` that have a target; ``rows``, all of them,
    with a ``prediction`` column."""
    numbers = [F.col(c).cast("double").alias(c) for c in features]
    known = train.where(F.col(target).isNotNull()).select(*numbers, F.col(target).cast("double").alias(target))
    model = gbt_pipeline(features, target, **params).fit(known)
    # The imputer wants doubles under the names it was fitted with; the given columns come back after.
    kept = rows.withColumns({f"_given_{c}": F.col(c) for c in features})
    found = model.transform(kept.withColumns({c: F.col(c).cast("double") for c in features}))
    found = found.withColumns({c: F.col(f"_given_{c}") for c in features})
    return found.drop("_features", *[f"_{kind}_{c}" for kind in ("given", "filled") for c in features])


# Ranges a random draw is taken from, for the parameters these trees have.
SEARCH_SPACE = {
    "maxDepth": (3, 10, "int"),
    "stepSize": (0.01, 0.3, "log"),
    "maxIter": (100, 1000, "int"),
    "minInstancesPerNode": (1, 7, "int"),
    "subsamplingRate": (0.6, 1.0, "float"),
}


def _from_unit(u, lo, hi, kind: str, floor, exp):
    """A draw between ``lo`` and ``hi`` from ``u`` in [0, 1)."""
    if kind == "int":
        return floor(lo + u * (hi - lo + 1))
    if kind == "log":
        return exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
    return lo + u * (hi - lo)


def draw_parameters(draws: int, seed: int | str = 0, space: Mapping[str, tuple] = SEARCH_SPACE) -> list[dict]:
    """``draws`` seeded parameter sets. A draw depends on seed, number and name alone: the first 12 hex digits of
    the MD5 of ``seed|number|name`` are a fraction of 16**12, so any engine can repeat a single draw."""

    def unit(number: int, name: str) -> float:
        return int(hashlib.md5(f"{seed}|{number}|{name}".encode()).hexdigest()[:12], 16) / 16**12

    return [
        {name: _from_unit(unit(k, name), *bounds, floor=math.floor, exp=math.exp) for name, bounds in space.items()}
        for k in range(draws)
    ]


def draw_table(
    seeds: DataFrame, seed: str, draws: int, space: Mapping[str, tuple] = SEARCH_SPACE
) -> DataFrame:
    """The same draws as a table, for each seed in a column (a number, or the name of a series that is searched by
    itself): ``(seed, draw, <parameters>)``."""

    def column(name: str, lo, hi, kind: str) -> Column:
        text = F.concat_ws("|", F.col(seed).cast("string"), F.col("draw").cast("string"), F.lit(name))
        unit = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / 16**12
        drawn = _from_unit(unit, lo, hi, kind, floor=F.floor, exp=F.exp)
        return drawn.cast("int" if kind == "int" else "double").alias(name)

    numbered = seeds.select(seed).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return numbered.select(seed, "draw", *[column(name, *bounds) for name, bounds in space.items()])


def random_search(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: str = "fold",
    folds: int = FOLDS,
    draws: int = 20,
    seed: int = 0,
    parallelism: int = 4,
    space: Mapping[str, tuple] = SEARCH_SPACE,
):
    """Mean MSE over the given folds for each seeded draw. Returns ``(best model, scores)``:
    one score row per draw, ``(draw, <parameters>, mse, best)``."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    pipeline = gbt_pipeline(features, target)
    trees = pipeline.getStages()[-1]
    drawn = draw_parameters(draws, seed, space)
    maps = [{trees.getParam(name): value for name, value in one.items()} for one in drawn]
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse"),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    )
    model = search.fit(df.select(*features, target, F.col(fold).cast("int").alias(fold)))
    best = int(np.argmin(model.avgMetrics))
    names = list(space)
    kinds = {"int": "INT"}
    ddl = ", ".join(["draw INT", *[f"{n} {kinds.get(space[n][2], 'DOUBLE')}" for n in names], "mse DOUBLE", "best BOOLEAN"])
    scores = [
        (i, *[one[n] for n in names], float(mse), i == best)
        for i, (one, mse) in enumerate(zip(drawn, model.avgMetrics))
    ]
    return model.bestModel, literal_table(df.sparkSession, scores, ddl)


# ------------------------------------------------------- linear autoregression


@dataclass(frozen=True)
class LinearForecast:
    """``y = x @ weights + bias`` for every horizon hour at once."""

    weights: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _moments(lags: int, horizon: int):
    """Partial sums of ``[x, 1]' [x, 1, y]``, one row of the matrix per output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lags + 1, lags + 1 + horizon))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, lags)
                y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, horizon)
                one = np.hstack([x, np.ones((len(x), 1))])
                total += one.T @ np.hstack([one, y])
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(lags + 1), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))}
        )

    return run


def moments_of(windows: DataFrame, x: Column, y: str, lags: int, horizon: int) -> DataFrame:
    """``[x, 1]' [x, 1, y]`` over all windows as cells ``(i, j, v)``.

    Every task sums its own ``(lags+1) x (lags+1+horizon)`` moments, and Spark adds them up by
    matrix cell.
    """
    sums = windows.select(x.alias("x"), F.col(y).alias("y")).mapInArrow(
        _moments(lags, horizon), "i INT, row ARRAY<DOUBLE>"
    )
    return sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def ar_fit(
    windows: DataFrame,
    target: str,
    lags: int = AR_LAGS,
    horizon: int = HORIZON_HOURS,
    ridge: float = 1e-6,
    past: str = "past",
    y: str = "y",
) -> LinearForecast:
    """Last ``lags`` target values -> all horizon hours, linear with bias, least squares.

    Only the matrix of moments reaches the driver, whatever the number of windows.
    """
    cells = moments_of(windows, last_values(target, lags, past), y, lags, horizon)
    cells = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    moments = np.zeros((lags + 1, lags + 1 + horizon))
    for line in cells.select("i", "row.v").collect():  # lags + 1 rows
        moments[line[0]] = line[1]
    gram, cross = moments[:, : lags + 1], moments[:, lags + 1 :]
    penalty = ridge * np.eye(lags + 1)
    penalty[-1, -1] = 0.0
    solved = np.linalg.lstsq(gram + penalty, cross, rcond=None)[0]
    return LinearForecast(solved[:-1], solved[-1])


def last_values(target: str, lags: int = AR_LAGS, past: str = "past") -> Column:
    """The model input of ``ar_fit``: the last ``lags`` target values of a window."""
    return F.transform(F.slice(past, -lags, lags), lambda r: r[target].cast("double"))


def ar_mimo(train: DataFrame, windows: DataFrame, target: str, lags: int = AR_LAGS, **options) -> DataFrame:
    """Fit on ``train`` and add ``predicted`` to ``windows``."""
    model = ar_fit(train, target, lags, **options)
    return score_windows(windows, model, last_values(target, lags))


# --------------------------------------------------------------------- scoring


def score_windows(
    windows: DataFrame,
    model: Callable[[np.ndarray], np.ndarray],
    inputs: Column,
    out: str = "predicted",
    inverse: str | None = None,
    rounded: bool = False,
) -> DataFrame:
    """Apply a fitted model to the array column ``inputs``, a batch of windows at a time.

    Only ``inputs`` crosses to Python. ``inverse='signed_exp'`` maps the result back from
    log space and ``rounded`` rounds it to 2 places, both in the JVM.
    """
    shipped = windows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def predict(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.asarray(shipped.value(np.stack(batch.to_numpy())), dtype=float)))

    result = F.col(out)
    if inverse == "signed_exp":
        result = F.transform(result, signed_exp)
    elif inverse is not None:
        raise ValueError(f"unknown inverse {inverse!r}")
    if rounded:
        result = F.transform(result, round2)
    return windows.withColumn(out, predict(inputs)).withColumn(out, result)


def sigmoid(logit: Column | str) -> Column:
    return 1 / (1 + F.exp(-F.col(logit) if isinstance(logit, str) else -logit))


def gated_blend(df: DataFrame, a: str, b: str, logit: str, out: str = "blended") -> DataFrame:
    """``g a + (1 - g) b`` with ``g = sigmoid(logit)`` per window; ``a`` and ``b`` are both
    numbers or both arrays."""
    g = sigmoid(logit)
    if df.schema[a].dataType.typeName() == "array":
        return (
            df.withColumn("_g", g)
            .withColumn(out, F.zip_with(a, b, lambda x, y: F.col("_g") * x + (1 - F.col("_g")) * y))
            .drop("_g")
        )
    return df.withColumn(out, g * F.col(a) + (1 - g) * F.col(b))


def mean_ablation(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    model: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """How much the squared error grows when a feature is replaced by its mean.

    Each batch is scored once as it is and once per feature, in place, so rows are not
    multiplied; a task hands back one row of sums per feature. A row that lacks the target or a
    feature is not scored, and the means are those of the scored rows. Returns ``(feature,
    base_rmse, ablated_rmse, change, scored, left_out)``.
    """
    names = list(features)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    complete = F.col(target).isNotNull()
    for c in names:
        complete = complete & F.col(c).isNotNull()
    whole = df.where(complete)
    means = whole.agg(F.array(*[F.avg(c) for c in names]).alias("m")).scalar()
    left_out = df.agg(F.count_if(~complete).alias("n")).scalar()
    rows = whole.select(
        F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
        F.col(target).cast("double").alias("y"),
        means.alias("m"),
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, base, ablated = 0, 0.0, np.zeros(len(names))
        for batch in batches:
            if batch.empty:
                continue
            x, y = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()
            mean = np.asarray(batch["m"].iloc[0], dtype=float)
            n += len(y)
            base += float(np.sum((np.ravel(shipped.value(x)) - y) ** 2))
            for j in range(len(names)):
                changed = x.copy()
                changed[:, j] = mean[j]
                ablated[j] += float(np.sum((np.ravel(shipped.value(changed)) - y) ** 2))
        yield pd.DataFrame({"feature": names, "n": n, "base": base, "ablated": ablated})

    partial = rows.mapInPandas(sums, "feature STRING, n BIGINT, base DOUBLE, ablated DOUBLE")
    n = F.nullif(F.sum("n"), F.lit(0))
    return (
        partial.groupBy("feature")
        .agg(
            F.sqrt(F.sum("base") / n).alias("base_rmse"),
            F.sqrt(F.sum("ablated") / n).alias("ablated_rmse"),
            F.sum("n").alias("scored"),
        )
        .withColumn("change", F.col("ablated_rmse") - F.col("base_rmse"))
        .withColumn("left_out", left_out)
    )

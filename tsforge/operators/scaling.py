"""Imputation and scaling. Parameters are one row per feature, ``(feature, mean, scale)``,
fitted by one aggregate and applied as plain column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsforge.constants import CYCLICAL_COLUMNS
from tsforge.session import literal_table, materialise


def impute_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Null -> mean over the training rows (``pyspark.ml.feature.Imputer``)."""
    from pyspark.ml.feature import Imputer

    names = list(columns)
    filled = [f"_imputed_{c}" for c in names]
    model = Imputer(strategy="mean", inputCols=names, outputCols=filled).fit(train if train is not None else df)
    done = model.transform(df)
    return done.select(*[F.col(f"_imputed_{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def standard_fit(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per feature (0 becomes 1), per ``keys``.

    A null counts as 0, as the fitted steps impute before they scale.
    """
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = df.groupBy(*keys).agg(
        *[F.struct(F.avg(zero[c]).alias("mean"), F.stddev_pop(zero[c]).alias("std")).alias(c) for c in columns]
    )
    long = stats.unpivot(list(keys), list(columns), "feature", "_s") if len(columns) > 1 else stats.select(
        *keys, F.lit(columns[0]).alias("feature"), F.col(columns[0]).alias("_s")
    )
    std = F.col("_s.std")
    return long.select(
        *keys, "feature", F.col("_s.mean").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale")
    )


def standard_fit_windows(
    windows: DataFrame, array: str, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """``standard_fit`` over every hour of every window: an hour counts once per window
    that holds it. The explode feeds the partial aggregate in the same stage."""
    rows = windows.select(*keys, F.explode(array).alias("_h")).select(
        *keys, *[F.col(f"_h.{c}").alias(c) for c in columns]
    )
    return standard_fit(rows, columns, keys)


def standard_fit_parts(
    windows: DataFrame, parts: Mapping[str, Sequence[str] | None], keys: Sequence[str] = ()
) -> DataFrame:
    """``standard_fit_windows`` of several arrays in one pass: ``(part, feature, mean, scale)``.

    ``parts`` maps an array of hour structs to its features, or an array of numbers (the target) to None. The
    hours of all arrays of a window go through one aggregate with a set of sums per array and feature.
    """
    slots = [(name, c, f"{name}.{c}") for name, columns in parts.items() for c in (columns or [name])]

    def hour(name: str, columns: Sequence[str] | None) -> Callable[[Column], Column]:
        """An hour of one array as values of its own slots; those of other arrays stay null."""

        def cells(h: Column) -> Column:
            own = {slot: F.coalesce((h[c] if columns else h).cast("double"), F.lit(0.0)) for part, c, slot in slots if part == name}
            return F.struct(*[own.get(slot, F.lit(None).cast("double")).alias(slot) for *_, slot in slots])

        return cells

    rows = [F.transform(name, hour(name, columns)) for name, columns in parts.items()]
    flat = windows.select(*keys, F.explode(F.concat(*rows)).alias("_h"))
    stats = flat.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(
                    F.lit(part).alias("part"),
                    F.lit(c).alias("feature"),
                    F.avg(F.col("_h")[slot]).alias("mean"),
                    F.stddev_pop(F.col("_h")[slot]).alias("std"),
                )
                for part, c, slot in slots
            ]
        ).alias("_s")
    )
    std = F.col("std")
    return stats.select(*keys, F.inline("_s")).select(
        *keys, "part", "feature", "mean", F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale")
    )


def _one_row(params: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The parameters of ``columns`` as a single struct of structs, one row per ``keys``.

    A column with no parameters, or with several (those of more than one fold), stops the job.
    """
    both = F.struct(F.col("mean"), F.col("scale"))

    def only(c: str) -> Column:
        wrong = F.raise_error(F.lit(f"not exactly one scaler row for {c!r}"))
        one = F.max(F.when(F.col("feature") == c, both))
        return F.when(F.count_if(F.col("feature") == c) == 1, one).otherwise(wrong).alias(c)

    picked = [only(c) for c in columns]
    return params.groupBy(*keys).agg(F.struct(*picked).alias("_p"))


def _attach(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Without keys, a scalar subquery: Spark evaluates it once and hands every task one
    struct. With keys (a fold number), a join to one row per key, left to Spark's own size
    check to broadcast."""
    row = _one_row(params, columns, keys)
    return df.join(row, list(keys), "left") if keys else df.withColumn("_p", row.scalar())


def _z(value: Column, p: Column) -> Column:
    return (F.coalesce(value.cast("double"), F.lit(0.0)) - p["mean"]) / p["scale"]


def standard_apply(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / scale`` on columns; nulls are imputed with 0 first."""
    p = F.col("_p")
    return _attach(df, params, columns).withColumns({c: _z(F.col(c), p[c]) for c in columns}).drop("_p")


def standard_apply_windows(
    windows: DataFrame, array: str, params: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """The same on an array of hour structs; other fields are kept as they are. ``keys``
    picks the parameters of the window's fold."""
    fields = windows.schema[array].dataType.elementType.fieldNames()
    p = F.col("_p")

    def scaled(h: Column) -> Column:
        return F.struct(*[(_z(h[f], p[f]) if f in columns else h[f]).alias(f) for f in fields])

    return _attach(windows, params, columns, keys).withColumn(array, F.transform(array, scaled)).drop("_p")


def scale_passthrough(
    df: DataFrame,
    columns: Sequence[str],
    train: DataFrame | None = None,
    passthrough: Sequence[str] = tuple(CYCLICAL_COLUMNS),
) -> DataFrame:
    """Impute with the train mean and scale all of ``columns`` but the passthrough ones."""
    names = [c for c in columns if c not in passthrough]
    fit_on = train if train is not None else df
    # Filling with the mean leaves the mean as it is and shrinks the spread by the share of
    # known values, so one aggregate fits both steps.
    stats = fit_on.agg(
        F.struct(
            *[
                F.struct(
                    F.avg(c).alias("mean"),
                    (F.stddev_pop(c) * F.sqrt(F.count(c) / F.count(F.lit(1)))).alias("std"),
                ).alias(c)
                for c in names
            ]
        ).alias("p")
    )
    p = F.col("_p")

    def z(c: str) -> Column:
        std = p[c]["std"]
        return (F.coalesce(F.col(c), p[c]["mean"]) - p[c]["mean"]) / F.when(std == 0, 1.0).otherwise(std)

    return df.withColumn("_p", stats.scalar()).withColumns({c: z(c) for c in names}).drop("_p")


def target_fit(windows: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """One mean and deviation over all target hours of the (training) windows."""
    return standard_fit(windows.select(*keys, F.explode(y).alias("y")), ["y"], keys)


def target_scale(windows: DataFrame, params: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    p = F.col("_p")["y"]
    return (
        _attach(windows, params, ["y"], keys)
        .withColumn(y, F.transform(y, lambda v: (v - p["mean"]) / p["scale"]))
        .drop("_p")
    )


def target_unscale(windows: DataFrame, params: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    p = F.col("_p")["y"]
    return (
        _attach(windows, params, ["y"], keys)
        .withColumn(y, F.transform(y, lambda v: v * p["scale"] + p["mean"]))
        .drop("_p")
    )


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


SLOTS = 4096


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], q: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10000
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, of any number of rows, without gathering a
    column's values anywhere. A fit: it writes the columns once and runs three jobs over them that each return
    a few numbers per column.

    1. A fixed-size sketch gives two edges around each quantile; least and greatest value are edges too, so
       every range is as wide as the values in it.
    2. Rows below and at each edge are counted, which tells for every wanted rank which edge
       it is or between which two edges it lies.
    3. The values strictly between such edges, normally about 1 in 2,500 rows, are grouped
       and ranked. A bad sketch costs time here, never exactness.
    """
    names, wide = list(columns), 2.0 / accuracy

    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    df = materialise(df.select(*[value(c).alias(c) for c in names]), "columns")
    asked = [x for p in q for x in (max(p - wide, 0.0), min(p + wide, 1.0))]
    ends = [end(value(c)).alias(f"{name} {c}") for c in names for name, end in (("min", F.min), ("max", F.max))]
    sketch = df.agg(*[F.percentile_approx(value(c), asked, accuracy).alias(c) for c in names], *ends).first()
    edges = {c: sorted({*(sketch[c] or []), *(x for x in (sketch[f"min {c}"], sketch[f"max {c}"]) if x is not None)}) for c in names}
    sums = [F.count(value(c)).alias(f"n {c}") for c in names]
    for c in names:
        for i, x in enumerate(edges[c]):
            sums += [F.count_if(value(c) < x).alias(f"lt{i} {c}"), F.count_if(value(c) <= x).alias(f"le{i} {c}")]
    counts = df.agg(*sums).first()

    ranks = {c: [(p * (counts[f"n {c}"] - 1)) for p in q] for c in names}
    at: dict[tuple[str, int], float] = {}
    open_ranges: dict[tuple[str, float, float], list[tuple[int, int]]] = {}
    for c in names:
        wanted = {int(k) for r in ranks[c] if r >= 0 for k in (math.floor(r), math.ceil(r))}
        below, lower = 0, -math.inf
        for i, x in enumerate([*edges[c], math.inf]):
            lt = counts[f"lt{i} {c}"] if x < math.inf else counts[f"n {c}"]
            le = counts[f"le{i} {c}"] if x < math.inf else lt
            for k in wanted:
                if below <= k < lt:
                    open_ranges.setdefault((c, lower, x), []).append((k, k - below))
                elif lt <= k < le:
                    at[c, k] = x
            below, lower = le, x
    at.update(_ranked_between(df, value, open_ranges))

    found: dict[str, list[float | None]] = {}
    for c in names:
        found[c] = []
        for r in ranks[c]:
            if r < 0:
                found[c].append(None)
                continue
            a, b = at[c, math.floor(r)], at[c, math.ceil(r)]
            found[c].append(a + (b - a) * (r - math.floor(r)))
    return found


def _ranked_between(df: DataFrame, value, open_ranges) -> dict[tuple[str, int], float]:
    """Values at ranks inside open value ranges: ``{(column, lo, hi): [(rank, offset)]}``.
    Ranked in two passes, 4,096 slots across each range and then inside the slots."""
    if not open_ranges:
        return {}
    parts, ranges, near = [], list(open_ranges), F.lit(False)
    for number, (c, lo, hi) in enumerate(ranges):
        v = value(c)
        inside = (v > lo) & (v < hi)
        near, width = near | inside, hi - lo
        slot = F.floor((v - lo) / width * SLOTS) if 0 < width < math.inf else F.lit(0)
        parts.append(
            F.when(inside, F.struct(F.lit(number).alias("range"), slot.cast("long").alias("slot"), v.alias("v")))
        )
    rows = df.where(near).select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("p.*")
    distinct = rows.groupBy("range", "slot", "v").agg(F.count(F.lit(1)).alias("c"))
    slots = distinct.groupBy("range", "slot").agg(F.sum("c").alias("c"))
    offsets = slots.select(
        "range", "slot", (F.sum("c").over(Window.partitionBy("range").orderBy("slot")) - F.col("c")).alias("before")
    )
    ranked = distinct.join(offsets, ["range", "slot"]).withColumn(
        "upto", F.col("before") + F.sum("c").over(Window.partitionBy("range", "slot").orderBy("v"))
    )
    hits, keys = [], []
    for number, key in enumerate(ranges):
        for k, offset in open_ranges[key]:
            here = (F.col("range") == number) & (F.col("upto") > offset) & (F.col("upto") - F.col("c") <= offset)
            hits.append(F.max(F.when(here, F.col("v"))).alias(f"r{len(hits)}"))
            keys.append((key[0], k))
    row = ranked.agg(*hits).first()
    return {key: row[i] for i, key in enumerate(keys)}


def robust_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median and interquartile range per feature (0 becomes 1) as ``mean`` and ``scale``."""
    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    rows = []
    for c in columns:
        low, middle, high = found[c]
        spread = None if middle is None else (high - low) or 1.0
        rows.append((c, middle, spread))
    return literal_table(df.sparkSession, rows, "feature STRING, mean DOUBLE, scale DOUBLE")


def robust_scale(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre by the median and divide by the interquartile range; nulls stay null."""
    p = F.col("_p")
    return (
        _attach(df, params, columns)
        .withColumns({c: (F.col(c) - p[c]["mean"]) / p[c]["scale"] for c in columns})
        .drop("_p")
    )

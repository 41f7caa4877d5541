from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tsforge.operators import splits as p

S = ["series"]


@pytest.fixture(scope="module")
def index(spark):
    first = datetime(2023, 1, 1, 23)
    rows = [(s, first + timedelta(days=i)) for s, n in (("A", 900), ("B", 400)) for i in range(n) if i % 37 != 5]
    df = spark.createDataFrame(rows, "series STRING, anchor TIMESTAMP")
    return df.withColumn("window_date", F.col("anchor") + F.expr("INTERVAL 12 HOURS"))


def _parts(df, series="A"):
    out = {}
    for r in df.where(F.col("series") == series).orderBy("anchor").collect():
        out.setdefault(r.split, []).append(r.anchor)
    return out


def _gap_hours(train, val):
    return ((val[0] - timedelta(hours=168)) - (train[-1] + timedelta(hours=23))).total_seconds() / 3600


def test_gap_split_by_definition(index):
    got = _parts(p.split_fraction_gap(index, S))
    anchors = [r.anchor for r in index.where("series = 'A'").orderBy("anchor").collect()]
    n = len(anchors)
    k = int(n * 0.2)
    train = anchors[: n - 2 * k]
    far = timedelta(hours=192 + 168 + 23)
    start = next(i for i in range(n - 2 * k, n) if anchors[i] >= train[-1] + far)
    val = anchors[start : start + k]
    test = [a for a in anchors[start + k :] if a >= val[-1] + far]
    assert (got["train"], got["val"], got["test"]) == (train, val, test)
    assert _gap_hours(train, val) >= 192 and _gap_hours(val, test) >= 192


def test_calendar_split_keeps_the_gap(index):
    got = _parts(p.split_calendar(index, S))
    assert all((a + timedelta(hours=13)).year < 2024 for a in got["train"])
    assert _gap_hours(got["train"], got["val"]) >= 192 and _gap_hours(got["val"], got["test"]) >= 192


def test_no_window_meets_the_gap(spark):
    days = [datetime(2023, 12, 20) + timedelta(days=i) for i in range(18)]
    df = spark.createDataFrame([("A", d, d + timedelta(hours=12)) for d in days], "series STRING, anchor TIMESTAMP, window_date TIMESTAMP")
    assert set(_parts(p.split_calendar(df, S))) == {"train"}


def test_folds_grow_and_keep_their_gap(index):
    rows = p.folds_expanding(index, S).where("series = 'A'").collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.fold, r.split), set()).add(r.anchor)
    test = seen[0, "test"]
    for i in range(1, 6):
        train, val = sorted(seen[i, "train"]), sorted(seen.get((i, "val"), []))
        assert not set(train) & set(val) and not test & (set(train) | set(val))
        if val:
            assert _gap_hours(train, val) >= 192
        if i > 1:
            assert seen[i - 1, "train"] < seen[i, "train"]
    # A fifth of the windows, less the ones in the gap.
    assert 0.17 < len(test) / index.where("series = 'A'").count() < 0.2


def test_row_split_drops_the_first_rows(index):
    got = _parts(p.split_fraction_rows(index, S, "anchor"))
    n = index.where("series = 'A'").count()
    k = int(n * 0.2)
    assert (len(got["train"]), len(got["val"]), len(got["test"])) == (n - 2 * k, k - 97, k - 97)


def test_shuffles_keep_the_rows_and_are_repeatable(spark, index):
    cut = p.split_fraction_gap(index, S).withColumn("was", F.col("split"))
    keys = ["series", "anchor"]
    across = p.shuffle_across(cut, keys, seed=3)
    assert sorted(map(tuple, across.select(keys).collect())) == sorted(map(tuple, cut.select(keys).collect()))
    sizes = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    assert sizes(across, "split") == sizes(cut, "split")
    assert sorted(r.position for r in across.collect()) == list(range(1, cut.count() + 1))
    again = p.shuffle_across(cut.repartition(3), keys, seed=3)
    assert sorted(map(str, again.select(*keys, "position").collect())) == sorted(map(str, across.select(*keys, "position").collect()))
    other = p.shuffle_across(cut, keys, seed=4)
    assert sorted(map(str, other.select(*keys, "position").collect())) != sorted(map(str, across.select(*keys, "position").collect()))
    within = p.shuffle_within(cut, keys, seed=3)
    assert within.where("split <> was").count() == 0
    for name, size in sizes(cut, "split").items():
        assert sorted(r.position for r in within.where(F.col("split") == name).collect()) == list(range(1, size + 1))


def test_random_split_is_stable(spark):
    df = spark.range(5000)
    a = p.random_split(df, ["id"]).where("split = 'train'")
    b = p.random_split(df.repartition(7), ["id"]).where("split = 'train'")
    assert a.exceptAll(b).count() == 0 and abs(a.count() / 5000 - 0.8) < 0.03


def test_kfold_blocks(index):
    rows = p.kfold(index, S, "anchor").where("series = 'B'").orderBy("anchor").collect()
    folds = [r.fold for r in rows]
    assert folds == sorted(folds) and set(folds) == set(range(5))
    sizes = [folds.count(i) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_report_gaps(index):
    cut = p.split_fraction_gap(index, S).where("series = 'A'")
    row = p.split_gaps(p.split_report(cut)).first()
    assert row.train_val_gap >= 192 and row.val_test_gap >= 192


@pytest.mark.parametrize("n", [0, 1, 2, 4, 9, 23, 60, 400])
@pytest.mark.parametrize("step", [1, 3])
def test_splits_of_any_length_by_definition(spark, n, step):
    anchors = [datetime(2023, 1, 1, 23) + timedelta(days=i * step) for i in range(n) if i % 11 != 4]
    n, far = len(anchors), timedelta(hours=192 + 168 + 23)
    df = spark.createDataFrame([("A", a, a) for a in anchors], "series STRING, anchor TIMESTAMP, window_date TIMESTAMP")
    share = lambda m: int(round(m * 0.2, 9))
    k = share(n)
    n_train = n - 2 * k
    want = {(a, "train") for a in anchors[:n_train]}
    start = next((i for i in range(n_train, n) if n_train and anchors[i] >= anchors[n_train - 1] + far), None)
    if start is not None:
        want |= {(a, "val") for a in anchors[start : start + k]}
        end = anchors[min(start + k, n) - 1]
        want |= {(a, "test") for a in anchors[start + k :] if a >= end + far}
    assert {(r.anchor, r.split) for r in p.split_fraction_gap(df, S).collect()} == want

    rest = n - k
    want = set()
    start = next((i for i in range(rest, n) if rest and anchors[i] >= anchors[rest - 1] + far), None)
    if start is not None:
        want |= {(a, 0, "test") for a in anchors[start : start + k]}
    for fold in range(1, 6):
        size = fold * (rest // 5)
        train = size - share(size)
        want |= {(a, fold, "train") for a in anchors[:train]}
        want |= {(a, fold, "val") for a in anchors[train:size] if train and a >= anchors[train - 1] + far}
    assert {(r.anchor, r.fold, r.split) for r in p.folds_expanding(df, S).collect()} == want


def test_draws_can_be_repeated_elsewhere(spark):
    import hashlib

    got = spark.range(50).select("id", p.md5_draw(["id"], seed=3).alias("draw")).collect()
    assert [r.draw for r in got] == [int(hashlib.md5(f"3|{r.id}".encode()).hexdigest()[:15], 16) for r in got]

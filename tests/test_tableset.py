"""Deletes over several tables at once, and what a failure leaves."""

import pytest
from pyspark.sql import DataFrameWriter

from tsforge.sources import tableset as t


@pytest.fixture()
def root(spark, tmp_path):
    rows = [("Spain", 1), ("France", 2), (None, 3), ("Spain", 4)]
    tables = {name: spark.createDataFrame(rows, "country STRING, v INT") for name in t.TABLE_OF.values()}
    flows = [("Spain", "France", 1), ("France", "Spain", 2), ("France", "Italy", 3), ("Italy", None, 4)]
    tables["crossborder_flows"] = spark.createDataFrame(flows, "country_from STRING, country_to STRING, v INT")
    log = [("Spain", "prices"), ("Spain", "load"), ("France", "prices"), (None, "prices")]
    tables[t.LOG] = spark.createDataFrame(log, "country STRING, data_type STRING")
    t.create(spark, str(tmp_path / "set"), tables)
    return str(tmp_path / "set")


def _rows(spark, root):
    return {n: sorted(map(tuple, t.read(spark, root, n).collect()), key=repr) for n in (*t.TABLE_OF.values(), t.LOG)}


def _counts(df):
    return {r["table"]: (r["deleted"], r["kept"]) for r in df.collect()}


def test_an_entity_goes_from_all_tables_and_the_log(spark, root):
    got = _counts(t.delete(spark, root, "Spain"))
    assert got == {**{n: (2, 2) for n in t.TABLE_OF.values()}, t.LOG: (2, 2)}
    left = _rows(spark, root)
    assert left["day_ahead_prices"] == [("France", 2), (None, 3)] and left[t.LOG] == [("France", "prices"), (None, "prices")]
    assert left["crossborder_flows"] == [("France", "Italy", 3), ("Italy", None, 4)]
    assert _counts(t.delete(spark, root, "Spain"))["load_data"] == (0, 2)


def test_one_type_leaves_the_others(spark, root):
    before = _rows(spark, root)
    assert _counts(t.delete(spark, root, "Spain", "prices")) == {"day_ahead_prices": (2, 2), t.LOG: (1, 3)}
    after = _rows(spark, root)
    assert {n for n in before if before[n] != after[n]} == {"day_ahead_prices", t.LOG}
    assert _counts(t.delete(spark, root, None, "load"))["load_data"] == (4, 0)
    with pytest.raises(ValueError):
        t.delete(spark, root, "Spain", "nope")


def test_everything(spark, root):
    assert all(kept == 0 for _, kept in _counts(t.delete(spark, root)).values())
    assert all(not rows for rows in _rows(spark, root).values())


def test_a_failure_between_tables_leaves_all_as_they_were(spark, root, monkeypatch):
    before, version = _rows(spark, root), t.current(spark, root)
    write, calls = DataFrameWriter.parquet, []

    def failing(self, path, *args, **kwargs):
        calls.append(path)
        if len(calls) == 3:
            raise RuntimeError("disk full")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(RuntimeError):
        t.delete(spark, root, "Spain")
    monkeypatch.undo()
    assert len(calls) == 3 and t.current(spark, root) == version and _rows(spark, root) == before
    assert _counts(t.delete(spark, root, "Spain"))[t.LOG] == (2, 2)

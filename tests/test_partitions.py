"""What functions over whole partitions get, and what of it lies in memory."""

import copy
import json
import pickle
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from brindle.functions import opaque
from brindle.functions.rows import Rows

N = 50_000


def batches(n=N):
    return [pa.RecordBatch.from_pydict({"k": pa.array(range(i, min(i + 7_001, n)), pa.int64()), "s": pa.array([None if k % 3 else str(k) for k in range(i, min(i + 7_001, n))])}) for i in range(0, n, 7_001)]


def as_list(n=N):
    return [r for b in batches(n) for r in b.to_pylist()]


class Taken:
    """A DataFrame's stand-in, which runs what is given to it over batches of this process."""

    def mapInArrow(self, run, schema):
        return lambda batches: list(run(batches))


def test_a_partition_is_not_held_as_dicts():
    schema = StructType().add("n", "long").add("total", "long")
    run = opaque.over_partitions(Taken(), lambda rows: [(len(rows), sum(r["k"] for r in rows) + rows[-1]["k"] - rows[N]["k"])], schema)
    tracemalloc.start()
    out = run(pa.RecordBatch.from_pydict({"k": pa.array(range(i, i + 10_000), pa.int64())}) for i in range(0, 300_000, 10_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].to_pylist() == [{"n": 300_000, "total": sum(range(300_000)) + 299_999 - N}]
    # as a list of dicts it takes over 200 bytes a row, 60 MB
    assert peak < 12_000_000


def test_reading_gives_what_a_list_gives():
    rows, plain = Rows(batches=batches()), as_list()
    assert len(rows) == N and rows and list(rows) == plain and list(reversed(rows)) == plain[::-1]
    assert [rows[k] for k in (0, -1, 7_000, 7_001, 25_000, -N, 3)] == [plain[k] for k in (0, -1, 7_000, 7_001, 25_000, -N, 3)]
    assert rows[5:20_000:3] == plain[5:20_000:3] and rows[::-1] == plain[::-1] and rows[N:] == []
    for k in (N, -N - 1):
        with pytest.raises(IndexError):
            rows[k]
    with pytest.raises(TypeError):
        rows["k"]
    assert {"k": 40_000, "s": None} in rows and {"k": -1, "s": None} not in rows
    assert rows.index({"k": 30_001, "s": None}) == 30_001 and rows.count({"k": 3, "s": "3"}) == 1
    assert max(rows, key=lambda r: -abs(r["k"] - 33_333))["k"] == 33_333
    assert list(zip(rows, rows)) == list(zip(plain, plain))
    assert rows._list is None and rows == plain and plain == rows and rows + [1] == [*plain, 1]
    assert json.dumps(rows[7]) == json.dumps(plain[7]) and pickle.loads(pickle.dumps(rows)) == plain and type(pickle.loads(pickle.dumps(rows[7]))) is dict


@pytest.mark.parametrize("none", [[], [pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64())})]])
def test_without_rows(none):
    rows = Rows(batches=none)
    assert not rows and len(rows) == 0 and list(rows) == [] == rows and rows[1:] == []
    rows.append(1)
    assert rows == [1]


def test_changed_and_held_rows_stay():
    rows = Rows(batches=batches())
    first = rows[0]
    for r in rows:
        if r["k"] % 1_000 == 0:
            r["k"] = -r["k"]
    rows[17].update(s="x")
    held = rows[40_000]
    assert rows[0] is first and len(list(rows)) == N and rows[40_000] is held
    held["s"] = "late"
    del rows[41]["s"]
    expected = [{"k": -k if k % 1_000 == 0 else k, "s": "late" if k == 40_000 else "x" if k == 17 else None if k % 3 else str(k)} for k in range(N)]
    del expected[41]["s"]
    assert [dict(r) for r in rows] == expected and rows._list is None


@pytest.mark.parametrize(
    "change",
    [
        lambda x: x.sort(key=lambda r: -r["k"]),
        lambda x: x.reverse(),
        lambda x: x.append({"k": -1, "s": None}),
        lambda x: x.insert(3, {"k": -1, "s": None}),
        lambda x: x.extend(list(x[:5])),
        lambda x: x.pop(7),
        lambda x: x.remove({"k": 9, "s": "9"}),
        lambda x: x.__setitem__(4, {"k": 0, "s": ""}),
        lambda x: x.__delitem__(slice(2, None, 2)),
        lambda x: x.clear(),
        lambda x: x.__iadd__([{"k": 5, "s": None}]),
        lambda x: copy.copy(x).clear(),
        lambda x: [x.pop() for r in x if r["k"] % 100 == 0],
    ],
)
def test_changes_of_the_list(change):
    rows, plain = Rows(batches=batches(9_000)), as_list(9_000)
    for x in (rows, plain):
        x[8_000]["s"] = "changed"
        change(x)
    assert rows == plain and list(rows) == plain and len(rows) == len(plain)


def test_nested_values_stay_changed():
    def f(rows):
        for r in rows:
            r["a"].append(r["k"])
        return rows

    nested = [pa.RecordBatch.from_pydict({"k": pa.array(range(20_000)), "a": pa.array([[k] for k in range(20_000)])})]
    assert [r["a"] for r in f(Rows(batches=nested))] == [[k, k] for k in range(20_000)]


def test_rows_that_a_function_gives_back(session):
    def f(rows):
        for r in rows:
            r["id"] *= 2
        return rows

    assert session.range(40_000, partitions=2).map_partitions_with(f, "id long").values() == list(range(0, 80_000, 2))
    assert session.range(40_000, partitions=2).map_partitions_with(lambda rows: rows[:2] + rows[-1:], "id long").values() == [0, 1, 19_999, 20_000, 20_001, 39_999]


def test_glom_makes_no_rows(session, monkeypatch):
    d, taken = session.range(10), []
    monkeypatch.setattr(type(d.df), "mapInArrow", lambda df, run, schema: taken.append(run) or df)
    d.glom("keys")
    tracemalloc.start()
    out = list(taken[0](pa.RecordBatch.from_pydict({"id": pa.array(range(i, i + 10_000), pa.int64())}) for i in range(0, 300_000, 10_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.num_rows for b in out] == [1] and out[0].column(0).to_pylist() == [list(range(300_000))]
    # the numbers alone take 32 bytes each as Python objects, 10 MB
    assert peak < 2_000_000


def test_glom_of_any_type(session):
    columns = {
        "n": "if(id % 3 = 0, null, id)",
        "s": "repeat('é', cast(id as int))",
        "d": "cast(id as decimal(38, 10)) / 3",
        "t": "timestamp_seconds(id * 100000000)",
        "l": "timestamp_seconds(id)::timestamp_ntz",
        "a": "array(id, null)",
        "m": "map(cast(id as string), id)",
        "x": "if(id % 2 = 0, null, named_struct('a', id, 'b', array(named_struct('c', id))))",
        "v": "null",
    }
    df = session.spark.range(0, 25, 1, 3).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    parts = [df.where(f"spark_partition_id() = {k}").collect() for k in range(3)]
    assert [r[0] for r in session.dataset(df).glom("rows").collect()] == parts
    for c in columns:
        assert [r[0] for r in session.dataset(df.select(c)).glom().collect()] == [[r[c] for r in p] for p in parts]
    few = session.dataset(df.where("n = 20"))
    assert [len(r[0]) for r in few.glom().collect()] == [0, 0, 1] and [r[0] for r in few.map("s").glom().collect()] == [[], [], ["é" * 20]]

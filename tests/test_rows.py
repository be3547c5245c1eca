"""Sources, row by row operators, sets and actions."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F


def test_range(session):
    assert [session.range(100).count(), session.range(0, 100).count(), session.range(0, 100, 4).count()] == [100, 100, 25]
    assert session.range(100).values() == list(range(100))
    assert session.range(0, 100, 4).values() == list(range(0, 100, 4))
    assert session.range(5, 0, -2).values() == [5, 3, 1]
    assert session.range(0, 1, 0.25).values() == [0, 0.25, 0.5, 0.75]
    assert session.range(3, 1).values() == session.range(1, 5, 0).values() == []
    assert session.range(10, partitions=3).num_partitions == 3


def test_parallelize_slices(session):
    d = session.parallelize(range(10), "x int", 4)
    assert d.values() == list(range(10))
    assert [len(r[0]) for r in d.glom().collect()] == [3, 3, 2, 2]
    assert session.parallelize([], "x int").values() == []


def test_union_keeps_order(session):
    a, b, c = session.range(10), session.range(10, 20), session.range(20, 30)
    assert a.union(b, c).values() == session.union(a, b, c).values() == list(range(30))
    down = a.sort(ascending=False)
    assert down.union(b.union(down)).values() == [*range(9, -1, -1), *range(10, 20), *range(9, -1, -1)]
    names = session.parallelize(["b", "a"], "id string").sort()
    assert names.union(session.parallelize(["c"], "id string")).values() == ["a", "b", "c"]
    assert [r[0] for r in down.union(b).take(12)][-3:] == [0, 10, 11]
    with pytest.raises(ValueError):
        session.union()
    with pytest.raises(ValueError):
        a.union(session.range(3).map(other=F.col("id")))


def test_take(session):
    assert [r[0] for r in session.range(100).take(30)] == list(range(30))
    assert [r[0] for r in session.range(10).take(30)] == list(range(10))
    assert session.empty("id long").take(30) == []


def test_max_min(session):
    empty = session.empty("id long")
    assert session.range(1000).max()[0] == 999 and session.range(120, 1000).min()[0] == 120
    assert empty.max() is None and empty.min() is None
    assert session.range(400).union(empty).max()[0] == 399


def test_max_min_ties_and_nulls(session):
    d = session.parallelize([(1, "a"), (2, "b"), (2, "c"), (1, "d"), (None, "e")], "k int, v string")
    assert d.max("k")["v"] == "c" and d.min("k")["v"] == "d"
    by_k = lambda a, b: (a["k"] or 0) - (b["k"] or 0)
    assert d.filter("k is not null").max_with(by_k)["v"] == "c" and d.filter("k is not null").min_with(by_k)["v"] == "d"
    numbers = session.parallelize([float("nan"), 1.0, None], "x double")
    assert numbers.max()[0] != numbers.max()[0] and numbers.min()[0] == 1.0  # NaN is the greatest


def test_map(session):
    four = 4
    assert session.range(1000).map_with(lambda r: four, "x int").values() == [4] * 1000
    assert session.range(1000).map(x=F.lit(4)).values() == [4] * 1000
    assert session.empty("id long").map_with(lambda r: four, "x int").values() == []


def test_flat_map(session):
    ones = F.when(F.col("id") < 30, F.array_repeat(F.lit(-1), 10)).otherwise(F.array().cast("array<int>"))
    assert session.range(120).flat_map(ones).values() == [-1] * 300
    assert session.range(120).flat_map_with(lambda r: [-1] * 10 if r["id"] < 30 else [], "x int").values() == [-1] * 300
    assert session.range(3).flat_map(F.array("id", F.col("id") * 10)).values() == [0, 0, 1, 10, 2, 20]


def test_filter(session):
    assert session.range(1000).filter(F.col("id") < 100).values() == list(range(100))
    assert session.range(1000).filter(F.lit(False)).values() == []
    assert session.range(10).filter_with(lambda r: r["id"] % 2).values() == [1, 3, 5, 7, 9]


def test_reduce(session):
    ones = session.range(1000).map(x=F.lit(1))
    assert ones.reduce(F.sum("x")) == 1000
    assert ones.reduce_with(lambda a, b: {"x": a["x"] + b["x"]}) == {"x": 1000}
    assert session.empty("x int").reduce_with(lambda a, b: a) is None
    assert session.empty("x int").reduce(F.sum("x")) is None
    # the fold is in order
    text = session.range(12).map(s=F.col("id").cast("string"))
    assert text.reduce_with(lambda a, b: {"s": a["s"] + b["s"]})["s"] == "".join(map(str, range(12)))


def test_map_partitions_and_glom(session):
    assert session.range(100).map_partitions_with(lambda rows: [-1 for _ in rows], "x int").values() == [-1] * 100
    assert session.empty("id long").map_partitions_with(lambda rows: [-1 for _ in rows], "x int").values() == []
    assert [x for r in session.range(100).glom().collect() for x in r[0]] == list(range(100))
    assert [r[0] for r in session.range(2, partitions=4).glom().collect()].count([]) == 2


def test_distinct(session):
    assert session.range(1000).map(x=F.lit(1)).distinct().values() == [1]
    d = session.parallelize([0, 0, None, None, 4], "x int").distinct()
    assert sorted(d.values(), key=str) == [0, 4, None]
    assert d.distinct(3).count() == 3
    assert sorted(session.parallelize(["", "", "a"], "x string").distinct().values()) == ["", "a"]


def test_function_errors_fail_actions(session):
    def fail(row):
        raise RuntimeError("no")

    with pytest.raises(PythonException):
        session.range(0, 100, 4).map_with(fail, "x int").count()


def test_captured_values_are_copies(session):
    seen = []
    assert session.range(5).map_with(lambda r: seen.append(r["id"]) or len(seen), "n int").count() == 5
    assert seen == []


def test_execute(session):
    def primes(i):
        return sum(all(n % p for p in range(2, int(n**0.5) + 1)) for n in range(max(2, i * 100), (i + 1) * 100))

    assert session.execute(10, primes, sum) == 168
    assert session.execute(0, primes) == []
    with pytest.raises(PythonException):
        session.execute(3, lambda i: 1 // (i - 1))


def test_options(session):
    assert session.options == {"default_partitions": 4, "default_storage": "disk"}
    assert session.range(8).num_partitions == 4


def test_min_of_rows_in_any_order(session):
    rows = [(1, "a"), (2, "b"), (1, "c"), (2, "d")]
    d = session.parallelize(rows, "k int, v string")
    assert d.sort_by("v").min("k")["v"] == "c" and d.sort_by("v", ascending=False).min("k")["v"] == "a"
    assert d.sort_by("v", ascending=False).max("k")["v"] == "b"
    assert d.union(d.map("k", v=F.lit("z"))).min("k")["v"] == "z"


def test_arithmetic_errors_are_errors(session):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        session.range(3).map(x=F.lit(1) / F.col("id")).collect()
    assert session.range(2).map(x=F.try_divide(F.lit(1), F.col("id"))).values() == [None, 1.0]


def test_create_session_joins_the_running_one(spark):
    from brindle.session import create_session

    other = create_session(default_partitions=2)
    assert other.spark is spark and other.range(10).num_partitions == 2


def test_tables(session, tmp_path):
    session.spark.range(5).write.json(f"{tmp_path}/t")
    assert sorted(session.table(f"{tmp_path}/t", "json").values()) == [0, 1, 2, 3, 4]

"""Text and binary files, connectors."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from brindle.session import Session
from brindle.sources.loaders import SharedFolder


@pytest.fixture
def shared(spark):
    s = Session(spark)
    s.register_file_loader(SharedFolder())
    return s


def test_text_round_trip(session, tmp_path):
    for k in range(3):
        session.range(1000, partitions=10).save_as_text_file(f"{tmp_path}/d/{k}", compression="gzip")
    d = session.text_file(f"{tmp_path}/d", recursive=True).map(v=F.col("value").cast("int"))
    assert tuple(d.df.agg(F.count("v"), F.max("v"), F.min("v"), F.sum("v")).first()) == (3000, 999, 0, 1_498_500)


def test_connector_round_trip(shared, tmp_path):
    at = f"file://{tmp_path}/d"
    shared.range(100, partitions=10).save_as_text_file(at, extension="gz", compressor=gzip.compress)
    assert sorted(os.listdir(tmp_path / "d")) == sorted([".success", *[f"part-{i}.gz" for i in range(10)]])
    unpack = lambda data, name: gzip.decompress(data) if name.endswith(".gz") else data
    assert sorted(map(int, shared.text_file(at, decompressor=unpack).values())) == list(range(100))
    with pytest.raises(FileExistsError):
        shared.range(1).save_as_text_file(at, overwrite=False)
    shared.range(2, partitions=3).save_as_text_file(at)
    assert sorted(os.listdir(tmp_path / "d")) == [".success", "part-0.txt", "part-1.txt", "part-2.txt"]
    assert sorted(os.path.getsize(tmp_path / "d" / f) for f in os.listdir(tmp_path / "d")) == [0, 0, 1, 1]


def test_overwrite(session, tmp_path):
    session.range(3).save_as_text_file(f"{tmp_path}/d")
    with pytest.raises(Exception, match="already exists"):
        session.range(3).save_as_text_file(f"{tmp_path}/d", overwrite=False)
    session.range(2).save_as_text_file(f"{tmp_path}/d")
    assert sorted(session.text_file(f"{tmp_path}/d").values()) == ["0", "1"]


def test_lines_keep_carriage_returns_and_backslashes(session, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\r\nb\\r\n\nlast\n")
    assert session.text_file(f"{tmp_path}/a.txt").values() == ["a\r", "b\\r", "", "last"]
    assert session.text_file(f"{tmp_path}/a.txt", encoding="latin1").values() == ["a\r", "b\\r", "", "last"]


def test_encodings(session, tmp_path):
    (tmp_path / "a").write_bytes("é\n".encode("latin1"))
    one = lambda encoding: session.whole_text_files(f"{tmp_path}/a", encoding=encoding).df.first()["value"]
    assert [one("latin1"), one("hex"), one("base64"), one("utf8")] == ["é\n", "e90a", "6Qo=", "�\n"]
    assert session.text_file(f"{tmp_path}/a").values() == ["�"]
    with pytest.raises(ValueError):
        one("klingon")
    with pytest.raises(ValueError):
        session.range(1).save_as_text_file(f"{tmp_path}/b", encoding="latin1")


def test_binary_and_whole_text(session, shared, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a", b"\x00\xff"), (".hidden", b"h"), ("empty", b""), ("sub/b", b"b\n")):
        (tmp_path / "in" / name).write_bytes(data)
    native = {os.path.basename(r["path"]): bytes(r["content"]) for r in session.binary_files(f"{tmp_path}/in").collect()}
    assert native == {"a": b"\x00\xff"}  # Spark's source leaves out hidden and empty files
    d = shared.binary_files(f"{tmp_path}/in")
    assert {os.path.basename(r["path"]): bytes(r["content"]) for r in d.collect()} == {"a": b"\x00\xff", ".hidden": b"h", "empty": b""}
    assert d.num_partitions == 3
    texts = shared.whole_text_files(f"{tmp_path}/in", recursive=True)
    assert {os.path.basename(r["path"]): r["value"] for r in texts.collect()}["b"] == "b\n"
    assert shared.binary_files(f"{tmp_path}/in/sub/b").count() == 1


def test_values_as_lines(session, tmp_path):
    d = session.parallelize([(4.0, [1, None], None, True)], "a double, b array<int>, c string, d boolean")
    d.save_as_text_file(f"{tmp_path}/d")
    assert session.text_file(f"{tmp_path}/d").values() == ["4,1,,,true"]
    session.parallelize([None, 0.5, 1e300], "x double").save_as_text_file(f"{tmp_path}/e")
    assert sorted(session.text_file(f"{tmp_path}/e").values()) == ["", "0.5", "1.0E300"]


def test_loader_choice(session, shared):
    assert session.get_file_loader("file:///x") is None
    assert isinstance(shared.get_file_loader("/x"), SharedFolder) and shared.get_file_loader("hdfs://x/y") is None


def test_empty_rows_survive_a_round_trip(session, tmp_path):
    session.parallelize(["a", "", "b", ""], "x string", 1).save_as_text_file(f"{tmp_path}/d")
    assert session.text_file(f"{tmp_path}/d").values() == ["a", "", "b", ""]


def test_compressor_needs_a_connector(session, tmp_path):
    with pytest.raises(ValueError):
        session.range(1).save_as_text_file(f"{tmp_path}/d", compressor=gzip.compress)

"""Text and binary files, in and out.

Spark's own sources read and write unless a connector is registered for the place. Spark leaves out files whose names begin
with . or _ and, as binary files, empty ones; a connector lists every file.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text, decoded, lines_of
from .loaders import FileLoader

_FILE = "path string, content binary"


def binary_files(spark: SparkSession, uri: str, recursive: bool = False, loader: FileLoader | None = None) -> DataFrame:
    """path and content, a row for each file; through a connector also a partition for each file."""
    if loader is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(uri).select("path", "content")
    names = loader.list_files(uri, recursive)
    if not names:
        return spark.createDataFrame([], _FILE)

    def load(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "content": pa.array([loader.load_file(name)], pa.binary())})

    listed = spark.createDataFrame(pa.table({"path": names, "at": pa.array(range(len(names)), pa.int32())}))
    return listed.repartitionById(len(names), "at").select("path").mapInArrow(load, _FILE)


def _unpacked(df: DataFrame, decompressor: Callable[[bytes, str], bytes] | None) -> DataFrame:
    if decompressor is None:
        return df

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "content": pa.array([decompressor(data, name)], pa.binary())})

    return df.mapInArrow(run, _FILE)


def whole_text_files(spark: SparkSession, uri: str, encoding: str = "utf8", recursive: bool = False, decompressor=None, loader: FileLoader | None = None) -> DataFrame:
    """path and value, a row for each file: its bytes, decompressed by decompressor(bytes, path) if there is one, as text."""
    files = _unpacked(binary_files(spark, uri, recursive, loader), decompressor)
    return files.select("path", decoded(F.col("content"), encoding).alias("value"))


def text_lines(spark: SparkSession, uri: str, encoding: str = "utf8", recursive: bool = False, decompressor=None, loader: FileLoader | None = None) -> DataFrame:
    """value, a row for each line. Lines end at \\n alone, a carriage return stays; one empty line at a file's end is dropped.

    UTF-8 without decompressor or connector goes through Spark's text source, which splits large files and unpacks .gz,
    .bz2 and the like by their names. Otherwise a file is one row before it is split.
    """
    if loader is None and decompressor is None and encoding.lower() in ("utf8", "utf-8"):
        lines = spark.read.text(uri, lineSep="\n", recursiveFileLookup=recursive)
        return lines.select(F.make_valid_utf8("value").alias("value"))
    return whole_text_files(spark, uri, encoding, recursive, decompressor, loader).select(F.explode(lines_of(F.col("value"))).alias("value"))


def line_of(df: DataFrame) -> DataFrame:
    """value: a row as a line of text; more than one column are comma-joined."""
    parts = [as_text(df[c], df.schema[c].dataType) for c in df.columns]
    return df.select((parts[0] if len(parts) == 1 else F.concat_ws(",", *parts)).alias("value"))


def save_text(df: DataFrame, uri: str, overwrite: bool = True, extension: str = "txt", compression: str | None = None, compressor: Callable[[bytes], bytes] | None = None, loader: FileLoader | None = None, encoding: str = "utf8") -> None:
    """Writes each row as a line.

    Spark's writer commits the parts of finished tasks alone, ends each line with \\n and compresses by name. With a
    compressor or a connector each partition is one file part-{i}.{extension}, empty ones too, its lines joined by \\n without one at the
    end; a task holds its partition's text.
    """
    if encoding.lower() not in ("utf8", "utf-8"):
        raise ValueError("text is written as UTF-8 alone")
    lines = line_of(df)
    if loader is None and compressor is None:
        out = lines.write.mode("overwrite" if overwrite else "errorifexists")
        (out.option("compression", compression) if compression else out).text(uri)
        return
    if loader is None:
        raise ValueError(f"a compressor needs a connector, and none handles {uri}")
    if compression:
        raise ValueError("a connector compresses by its compressor")
    loader.init_save(uri, overwrite)

    def write(batches):
        from pyspark import TaskContext

        body = "\n".join(x for b in batches for x in b.column(0).to_pylist()).encode()
        loader.save_file(uri, f"part-{TaskContext.get().partitionId()}.{extension}", compressor(body) if compressor else body)
        yield pa.RecordBatch.from_pydict({"written": pa.array([len(body)], pa.int64())})

    lines.mapInArrow(write, "written long").agg(F.sum("written")).collect()
    loader.mark_saved(uri)

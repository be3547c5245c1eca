"""The session: where datasets begin."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from math import ceil, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .dataset import Dataset
from .functions.order import Order, fresh, numbered
from .sources import files
from .sources.loaders import FileLoader, Loaders


class Session:
    """A SparkSession with the engine's options: the number of partitions of new datasets and the storage of cached ones."""

    def __init__(self, spark: SparkSession | None = None, default_partitions: int = 4, default_storage: str = "disk", show_progress: bool = False):
        self.spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", str(show_progress).lower()).getOrCreate()
        self.default_partitions, self.default_storage = default_partitions, default_storage
        self.loaders = Loaders()

    @property
    def options(self) -> dict:
        return {"default_partitions": self.default_partitions, "default_storage": self.default_storage}

    def close(self) -> None:
        self.spark.stop()

    def dataset(self, df: DataFrame, order: tuple[Order, ...] = ()) -> Dataset:
        """A dataset of the rows of df."""
        return Dataset(self, df, order)

    def table(self, path: str, kind: str = "parquet", **options) -> Dataset:
        """A dataset of a file or folder that one of Spark's sources reads; filters and columns reach the scan."""
        return self.dataset(self.spark.read.format(kind).options(**options).load(path))

    def empty(self, schema: str | StructType) -> Dataset:
        return self.dataset(self.spark.createDataFrame([], schema))

    def range(self, start, to=None, step=1, partitions: int | None = None) -> Dataset:
        """id: start, start + step, ... below to (above it, for a negative step). One argument alone is to. Step 0 gives no rows."""
        start, to = (0, start) if to is None else (start, to)
        n = ceil((to - start) / step) if step and isfinite((to - start) / step) else 0
        rows = self.spark.range(0, max(0, n), 1, partitions or self.default_partitions)
        name = fresh(rows, "ord")
        return self.dataset(rows.select((F.lit(start) + F.col("id") * F.lit(step)).alias("id"), F.col("id").alias(name)), (Order(name),))

    def parallelize(self, rows: Iterable, schema: str | StructType, partitions: int | None = None) -> Dataset:
        """Rows of the driver, in contiguous slices; the first slices are one longer where they don't divide. Single values are rows of one column."""
        rows, n = list(rows), partitions or self.default_partitions
        schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        each, more = divmod(len(rows), n)
        part = [p for p in range(n) for _ in range(each + (p < more))]
        one = len(schema) == 1
        df = self.spark.createDataFrame([r if not one or isinstance(r, (tuple, dict)) else (r,) for r in rows], schema)
        place = self.spark.createDataFrame(pa.table({"part": pa.array(part, pa.int32()), "at": pa.array(range(len(rows)), pa.int64())}))
        name = fresh(df, "ord")
        # both are numbered as they lie; rows of the driver are few
        both = df.coalesce(1).withColumn(name, F.monotonically_increasing_id()).join(place, F.col(name) == F.col("at"))
        return self.dataset(both.repartitionById(n, "part").sortWithinPartitions(name).drop("part", "at"), (Order(name),))

    def union(self, *datasets: Dataset) -> Dataset:
        if not datasets:
            raise ValueError("a union needs a dataset")
        return datasets[0].union(*datasets[1:])

    # files

    def register_file_loader(self, loader: FileLoader) -> None:
        self.loaders.register(loader)

    def get_file_loader(self, uri: str) -> FileLoader | None:
        return self.loaders.get(uri)

    def binary_files(self, uri: str, recursive: bool = False) -> Dataset:
        """path, content: a row for each file."""
        return self.dataset(files.binary_files(self.spark, uri, recursive, self.loaders.get(uri)))

    def whole_text_files(self, uri: str, encoding: str = "utf8", recursive: bool = False, decompressor: Callable[[bytes, str], bytes] | None = None) -> Dataset:
        """path, value: a row for each file, its text."""
        return self.dataset(files.whole_text_files(self.spark, uri, encoding, recursive, decompressor, self.loaders.get(uri)))

    def text_file(self, uri: str, encoding: str = "utf8", recursive: bool = False, decompressor: Callable[[bytes, str], bytes] | None = None) -> Dataset:
        """value: a row for each line, in the files' order."""
        return self.dataset(*numbered(files.text_lines(self.spark, uri, encoding, recursive, decompressor, self.loaders.get(uri))))

    # tasks

    def execute(self, n: int, task: Callable[[int], object], final: Callable[[list], object] = lambda results: results):
        """task(0) to task(n - 1), each a task of its own, then final over their results in order, here. An error of a task ends it all."""
        if n == 0:
            return final([])

        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "result": pa.array([pickle.dumps(task(i))], pa.binary())})

        results = self.spark.range(0, n, 1, n).mapInArrow(run, "i long, result binary").collect()
        return final([pickle.loads(r["result"]) for r in sorted(results, key=lambda r: r["i"])])


def create_session(master: str | None = None, **options) -> Session:
    """A session on a cluster, or on the one that is running."""
    if master is None:
        return Session(**options)
    return Session(SparkSession.builder.master(master).getOrCreate(), **options)

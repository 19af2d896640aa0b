"""A Parquet table whose batches become visible as a whole.

Spark's file commit renames the files of a job one by one, so a reader could see
half a batch. Here a batch is a folder of its own and counts only once its marker
stands; a crash before that leaves a folder that nobody reads and that the replay
of the batch overwrites. One writer for a table at a time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """Small files under a root that any Hadoop file system may hold; control data only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str) -> list[str]:
        """Names of the files in a folder, sorted; none if there is no folder."""
        if not self.fs.exists(self.at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)) if s.isFile() and not s.getPath().getName().startswith("."))

    def folders(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)) if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new; an existing one stays as it is."""
        try:
            out = self.fs.create(self.at(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes a file, also over one that is there."""
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def read(self, name: str) -> str:
        f = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode("utf-8")
        finally:
            f.close()

    def move(self, name: str, to: str) -> None:
        """Gives a file another place under the root."""
        self.fs.mkdirs(self.at(to).getParent())
        if not self.fs.rename(self.at(name), self.at(to)):
            raise OSError(f"{self.root}: {name} could not be moved to {to}")

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.at(name), True)


@contextlib.contextmanager
def set_for(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of Spark's for the jobs within, and what they were after."""
    names = {k: k.replace("__", ".") for k in conf}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, conf[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


class CommittedTable:
    """look_up: a column by which rows are looked up; its files get Parquet bloom filters, so that row groups without a value are skipped."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partitions: tuple[str, ...] = (), look_up: str | None = None):
        self.spark, self.root, self.partitions, self.look_up = spark, root.rstrip("/"), partitions, look_up
        inner = [f for f in schema.fields if f.name != "batch"]
        self.schema = T.StructType([*inner, T.StructField("batch", T.StringType())])
        self.files = Files(spark, self.root)

    def batches(self) -> list[str]:
        return self.files.names("batches")

    def holds(self, batch: str) -> bool:
        return self.files.exists(f"batches/{batch}")

    def unfinished(self) -> list[str]:
        """Batches that were begun and do not count: few, unlike those that do."""
        return sorted({f.removeprefix("batch=") for f in self.files.folders("data")} - set(self.batches()))

    def write(self, rows: DataFrame, batch: str, sort: tuple[str, ...] = (), spread: tuple[Column, ...] = ()) -> DataFrame:
        """Writes a batch without making it count, and reads it back. Files are sorted, and hold ranges of the sort columns or, with spread, what these expressions put together."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields if f.name != "batch"])
        if sort:
            names = [f"spread_{k}" for k in range(len(spread))]
            # rebalanced: adaptive execution cuts what would be a large task, as of several ranges that fall together
            rows = rows.withColumns(dict(zip(names, spread, strict=True))).hint("rebalance", *names) if spread else rows.repartitionByRange(*sort)
            rows = rows.sortWithinPartitions(*sort).drop(*names)
        out = rows.write.mode("overwrite").partitionBy(*self.partitions)
        if self.look_up:
            out = out.option(f"parquet.bloom.filter.enabled#{self.look_up}", "true")
        at = f"{self.root}/data/batch={batch}"
        out.parquet(at)
        return self.spark.read.schema(T.StructType([f for f in self.schema.fields if f.name != "batch"])).parquet(at)

    def commit(self, batch: str, text: str = "") -> bool:
        return self.files.create(f"batches/{batch}", text)

    def append(self, rows: DataFrame, batch: str, sort: tuple[str, ...] = ()) -> bool:
        """Whether the batch was new; one that stands already is left alone, so replays change nothing."""
        if self.holds(batch):
            return False
        self.write(rows, batch, sort)
        return self.commit(batch)

    def read(self) -> DataFrame:
        """Rows of the batches that stand; partition columns are read as the text they are."""
        if not self.batches():
            return self.spark.createDataFrame([], self.schema)
        rows, gone = self.spark.read.schema(self.schema).parquet(f"{self.root}/data"), self.unfinished()
        return rows.where(~F.col("batch").isin(gone)) if gone else rows

    def largest(self, column: str, where: Column | None = None, by_batch: bool = False) -> list[Row]:
        """The largest value of a column for each value of the partition columns (and each batch), from the statistics in the files' footers: no rows are read. where: of these, which."""
        if not self.batches():
            return []
        with set_for(self.spark, spark__sql__sources__useV1SourceList="", spark__sql__parquet__aggregatePushdown="true"):
            found = self.read().groupBy("batch", *self.partitions).agg(F.max(column).alias(column))
            if not by_batch:
                found = found.groupBy(*self.partitions).agg(F.max(column).alias(column))
            return (found if where is None else found.where(where)).collect()

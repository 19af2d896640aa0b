"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to one vectorised step hold about this many characters, whatever the Arrow batch holds.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set, on one machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Spark's own setting: the files of a query's shuffles go when it ends, as what it wrote replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that a writer holds until they make a row group of an intermediate table.
ROW_GROUP_BYTES = 16 << 20

#: Spark's own setting: how much text one Arrow batch may hold; and its default, which stands for not set.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors, prunes columns, frees shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote; nothing that is still to run may read them."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_id(kind: T.DataType, rest: str, name: str = "id") -> T.StructType:
    """A schema whose first field has a given type, which may be a struct with fields of any name; the rest as DDL."""
    return T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(rest).fields])


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def given_back() -> None:
    """Workers are used again for other tasks, so what a task's allocators still hold goes back to the system: Arrow's pool, and glibc's heap where there is one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What modules keep in a worker from task to task: how each forgets it.
FORGET: dict[str, Callable[[], None]] = {}
#: The module whose task a worker ran last.
LAST: list[str] = []


def turned_to(module: str) -> None:
    """Workers go from operator to operator: what the others keep is forgotten as one begins, or all would be held at once."""
    if LAST != [module]:
        LAST[:] = [module]
        for name, forget in FORGET.items():
            if name != module:
                forget()
        given_back()


def frugal(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned_to(function.__module__)
        try:
            yield from function(batches)
        finally:
            given_back()

    return run


def mapped(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of few megabytes: rows go to and fro several times over, so that large ones fill an executor."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        conf.set(BATCH_BYTES, "1m")
    return df.mapInArrow(frugal(function), schema)


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall in bucket of the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unit_hash(col: Column, seed: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for each value; used to draw bounded samples that do not depend on row order."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about `limit` characters; a longer text is a range of its own."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

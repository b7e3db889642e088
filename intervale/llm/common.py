"""Shared pieces of the training-data operators: table access, tables written to the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A batch that reaches Python is worked on in slices of at most this many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: The same for kernels that step through all texts of a slice together.
STEPPED_BYTES = 2 << 20
#: Short rows that one task takes at a time.
TINY = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Only a session in one process may do without: it gets a
    new temporary folder; executors elsewhere would not see that."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="intervale-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, and a lost executor costs nothing.

    narrow: rows are short, so a table of at most TINY of them comes back as one partition; joins and groupings among
    such tables then need no exchange. Rows are counted while they are written."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if narrow:
        # Spark estimates a join by the product of its sides' sizes, and would deal out anew what is one small partition.
        key, seen = "spark.sql.maxSinglePartitionBytes", Observation()
        before = spark.conf.get(key)
        spark.conf.set(key, str((1 << 63) - 1))
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(key, before)
    else:
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    tiny = narrow and seen.get["n"] <= TINY
    out = out.coalesce(1) if tiny else out
    out.written_path, out.tiny = path, tiny
    return out


def of_tiny(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, a join of the tables, in one partition if they all are tables that `written` gave back as one."""
    return df.coalesce(1) if all(getattr(x, "tiny", False) for x in tables) else df


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again; Spark's own file system reaches the shared folder."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Before a plan with Python: send the package, and bound Arrow batches by rows, since one text may be very long.
    A smaller setting of the session stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def text_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch, each with at most `most` bytes of text or one row."""
    n = batch.num_rows
    if not n:
        return
    array = text_of(batch.column(text))
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow, slice by slice; `work` makes one batch of rows from one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    by_text_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor: the folds of the held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def np_id_remainder(ids: list, divisor: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % divisor for x in ids], np.int64)

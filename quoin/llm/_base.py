"""Shared plumbing of the training-data operators: table reads and Arrow-batched maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes handled at once inside a Python worker; they bound memory whatever the Arrow batch holds.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in order in slices of at most ``rows`` rows and ``size`` bytes; a longer row stands alone."""
    for at in range(0, batch.num_rows, rows):
        left = [batch.slice(at, rows)]
        while left:
            part = left.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def release() -> None:
    """Give freed memory back at a task's end: Spark keeps Python workers, and what one stage held would add to the next one's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def arrow_map(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: T.StructType,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` over ``columns`` in slices of bounded size.

    ``make`` runs once in each task and gives the function from column lists to
    column lists, so that caches live as long as the task. Only the named
    columns leave the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, step = to_arrow_schema(schema), make()
        for batch in batches:
            for part in slices(batch, slice_rows):
                got = step({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        del step
        release()

    return df.select(*columns).mapInArrow(run, schema)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def crc_part(column: str, parts: int):
    """crc32 of a column as text, modulo ``parts``: the contracts' fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def sample_ids(df: DataFrame, column: str, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` values of an id column, chosen by hash: the bound of a training sample."""
    return df.select(column).orderBy(F.xxhash64(F.col(column), F.lit(salt)), F.col(column)).limit(rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a session on this machine alone, which has no other host to share a folder with,
    may leave it unset and gets a temporary one; on a cluster that is an error.
    """
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="quoin-checkpoint-")
    spark.sparkContext.setCheckpointDir(place)
    return spark.sparkContext.getCheckpointDir()


def drop_old_shuffles(spark: SparkSession) -> None:
    """Let the driver collect plans that nothing refers to: Spark deletes their shuffle files on all executors only then."""
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    drop_old_shuffles(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and read by column.

    Like checkpoints, these tables stay until the folder is emptied.
    """
    import uuid

    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    drop_old_shuffles(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)

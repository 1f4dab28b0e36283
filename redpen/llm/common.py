"""What the training-data operators share: working folders, text batches, hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker takes at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own
    only where that is unset and all run on this machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="redpen-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then the owner's to clear
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    atexit.register(_delete, spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage,
    survives lost executors, and is computed once. Removed when the driver ends, or by
    ``drop_written``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._redpen_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Removes what ``written`` wrote for these frames, once nothing is to read it any more."""
    for df in frames:
        _delete(df.sparkSession, df._redpen_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text gets a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with nulls as empty strings."""
    a = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(a.cast(pa.large_string()), "")


def _as(a: pa.Array, kind: pa.DataType) -> pa.Array:
    return a if a.type.equals(kind) else a.cast(kind)


def map_texts(
    docs: DataFrame, per_slice: Callable[[pa.RecordBatch, pa.Array], dict], schema: str | StructType, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """``per_slice(batch, texts)`` over slices of the id and text columns and those in
    ``also``; it returns the output columns. No other column is read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in slices(texts):
                cols = per_slice(batch.slice(a, b - a), texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else _as(cols[f.name], f.type) for f in out], schema=out)

    return docs.select(F.col(id_col), F.col(text_col), *also).mapInArrow(run, schema)


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, concatenated."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewops.session import ensure_checkpoint_dir

#: Separators of words: ASCII space, tab, line feed, vertical tab, form feed, carriage return.
WORD_CHARS = r"[^\x20\x09-\x0D]+"
#: Spark's setting that a job's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that a shuffle is read by one task per core at least, however little there is to read.
PARALLEL_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def written(df: DataFrame, name: str, rows_per_file: int = 0, few: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder, return the stored table.

    The folder is ``spark.checkpoint.dir``, which every executor sees, so a
    lost executor loses nothing.  Parquet keeps column pruning and gives the
    planner the true size.  Rows of some megabytes are better kept to a few per
    file (0: any number).  Hadoop removes the folder when the application ends.
    The shuffle files of the job go when it ends, as the stored table is all
    that is read of it; they would stay until the driver collects garbage.
    With ``few``, for short rows that cost little work, tasks read shuffles up
    to the advisory size, so a small table is a file and not one per core: on a
    local disk Hadoop starts processes for each file.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    held = {SHUFFLE_CLEANUP: "true"} | ({PARALLEL_FIRST: "false"} if few else {})
    was = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_of(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words: pieces between separators, less the empty ones at both ends."""
    pieces = F.split(text, r"[\x20\x09-\x0D]+")
    n = F.size(pieces)
    first = F.when(pieces[0] == "", 1).otherwise(0)
    last = F.when((n > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (n - first - last).cast("long")


def row_key(*cols: Column) -> Column:
    """128-bit key of a row's columns; null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8_column(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls count as empty.

    ``bytes[offsets[i]:offsets[i + 1]]`` is row i.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pc.fill_null(arr, "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Where the frames that `materialise` gave are written.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir. Where none
    is named, a folder beside the warehouse; on a cluster that must not be a machine's own."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a local folder")
    return f"{warehouse}/_scratch/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives the loss of
    executors, and gives the optimizer the real size, by which it chooses how to join. Afterwards
    the folders of `done` are deleted: frames from this function that nothing depends on any more."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    discard(*done)
    return out


def discard(*done: DataFrame) -> None:
    """Delete what `materialise` wrote for these frames; others are left alone."""
    for df in done:
        if path := _folders.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a key and a few numbers, some 50 bytes each, up to which they are sent to all tasks.
MOST_SENT = 500_000


def looked_up(rows: DataFrame, narrow: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Rows, texts and all, joined with a narrow written table: that is counted, and sent to all tasks
    if it is small, so that texts are not shuffled; beyond that both sides are."""
    return rows.join(F.broadcast(narrow) if narrow.count() <= MOST_SENT else narrow, keys, how)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a number of its own for every row, written once, and that column's name. The upper
    bits (from 33 on) are the number of the partition that the row was in."""
    name = unused(df, "row_key")
    return materialise(df.withColumn(name, F.monotonically_increasing_id())), name


#: Rows of a batch that are turned into Python objects at a time.
SLICE = 1024


#: Bytes of text that are turned into Python objects at a time; one longer text stands alone.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE rows and `most` bytes of the column `text`."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(text)), 0), pa.int64())).to_numpy(zero_copy_only=False)
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = min(max(a + 1, int(np.searchsorted(ends, before + most, "right"))), a + SLICE)
            yield batch.slice(a, b - a)
            a = min(b, batch.num_rows)


#: Rows of an Arrow batch of whole texts, of some kilobytes each.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger: batches of whole texts
    stand several times, in the executor and in the worker, at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def annotate(df: DataFrame, text: str, kind: T.StructType, make: Callable[[], Callable]) -> tuple[DataFrame, str]:
    """Add a struct column that is computed from `text` in Arrow batches; all columns of `df` stay.

    `make` runs once per task and returns a function from a list of texts (None where null) to a
    dict of lists, one per field of `kind`. Returns the frame and the name of the new column.
    """
    small_batches(df.sparkSession)
    name = unused(df, "result")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = pa.struct([(f.name, _ARROW[type(f.dataType)]) for f in kind.fields])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in slices(batches, at):  # bounds what is held beside the batch itself
            got = score(batch.column(at).to_pylist())
            column = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema), name


_ARROW = {
    T.StringType: pa.string(),
    T.DoubleType: pa.float64(),
    T.LongType: pa.int64(),
    T.BooleanType: pa.bool_(),
    T.IntegerType: pa.int32(),
}


def fraction(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def held_out(doc_id: Column | str) -> Column:
    """True for the documents that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0

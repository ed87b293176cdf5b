"""Shared plumbing of the training-data operators.

Conventions used by every operator of this subpackage:

* a null text counts as the empty text;
* an operator selects the columns it needs first, so further columns of the
  input never clash with its own, and are not returned;
* tables that are read more than once are written to the folder named by
  ``spark.checkpoint.dir`` (shared by all executors) and read back, which cuts
  the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch; long documents are bounded by bytes as well.
BATCH_ROWS = 2000
BATCH_BYTES = "32m"


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what it freed. Workers stay for later tasks and wait beside others; without this
    an executor pays for the largest moment of each of them at once."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only if that is unset and Spark runs in one process (tests) below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder takes over
        pass


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; used to size partitions only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, per_partition: int, least: int = 0) -> int:
    """Partitions of about ``per_partition`` bytes of input each, and at least the session's number."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, session, min(200_000, -(-size // per_partition)) if size < 1 << 60 else 0)


#: A key of more than one in HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of them, whatever the input.
HOT_SHARE, PLAIN_ROWS = 2000, 10_000


def join_spread(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int | None = None) -> DataFrame:
    """The inner join of ``left`` with the unique keys of ``right``, whose column ``weight`` counts the rows of a key.

    Hot keys (fewer than ``HOT_SHARE``, so their broadcast is bounded) meet their rows where these are; the rows then
    go through the exchange of the others under a salt, so no task gets all rows of a key."""
    total = total if total is not None else right.agg(F.sum(weight)).first()[0] or 0
    if total < PLAIN_ROWS:
        return left.join(right, on)
    columns = [c for c in right.columns if c not in on]
    hot, value = F.col(weight) > total // HOT_SHARE, F.struct(*columns)
    met = left.join(F.broadcast(right.where(hot).select(*on, value.alias("_hot"))), on, "left")
    met = met.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(4093)).cast("int")))
    # zero by a sum that is not folded: a literal would be moved out of the keys of the join, and the salt with it
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")
    met = met.join(right.where(~hot).select(*on, zero.alias("_salt"), value.alias("_rest")), [*on, "_salt"], "left")
    both = F.coalesce("_hot", "_rest")
    return met.where(both.isNotNull()).select(*left.columns, *[both[c].alias(c) for c in columns])


# ---- rows named by their place

_STEPS = {"Project", "Filter", "SubqueryAlias"}


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` reads files through deterministic projections and filters alone."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _STEPS:
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    files = df.inputFiles()
    import xxhash

    return 0 < len(files) == len({xxhash.xxh64_intdigest(f, 42) for f in files})


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows can be named by file and place, else a written copy of it: both read the same whenever they are read,
    however many executors there are."""
    return docs if is_scan(docs) else materialize(docs)


def pin_splits(spark: SparkSession) -> None:
    """Cut scans alike from now on: by default the size of splits follows the number of cores, which changes with the executors."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores, parts = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(cores, parts)))


def place(docs: DataFrame) -> list[Column]:
    """(file, at) of each row of a ``stable`` table: a hash of the file's path, and the row's number in the file."""
    meta = docs.metadataColumn("_metadata")
    return [F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")]


#: Rows of a file whose list is read at once.
PLACES = 1 << 20


def pick_rows(docs: DataFrame, places: DataFrame, keep: bool, value: str | None = None) -> DataFrame:
    """The rows of a ``stable`` table whose (file, at) is listed in ``places``, or isn't; with ``value`` that column is added.

    The lists are written to the shared folder by file, and each task reads those of the rows it meets: the rows
    themselves, with their texts, are never exchanged."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    listed = places.select("file", F.floor(F.col("at") / PLACES).alias("block"), "at", *([F.col(value).alias("value")] if value else []))
    listed.repartition("file", "block").write.partitionBy("file", "block").parquet(folder)
    name = f"place_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            last = b.num_columns - 1
            file, at = (c.to_numpy(zero_copy_only=False) for c in b.column(last).flatten())
            hit, values = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
            pairs = np.stack([file, at // PLACES], 1)
            for f, k in np.unique(pairs, axis=0).tolist():
                if (f, k) not in known:
                    known.clear()
                    known[f, k] = _places(folder, f, k, bool(value))
                held, more = known[f, k]
                here = np.flatnonzero((pairs[:, 0] == f) & (pairs[:, 1] == k))
                found = np.searchsorted(held, at[here])
                ok = found < len(held)
                ok[ok] = held[found[ok]] == at[here][ok]
                hit[here] = ok
                if value:
                    values[here[ok]] = more[found[ok]]
            out = b.select(range(last))
            if value:
                out = out.append_column(value, pa.array(values))
            yield out.filter(pa.array(hit if keep else ~hit))

    tune(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField(value, T.LongType())]) if value else docs.schema
    return docs.select("*", F.struct(*place(docs)).alias(name)).mapInArrow(run, schema)


def _places(folder: str, file: int, block: int, value: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted column ``at`` of a list, and column ``value`` with it; empty if there is no list."""
    t = read_parquet(f"{folder}/file={file}/block={block}", ["at", "value"] if value else ["at"])
    if t is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = t.column("at").to_numpy()
    order = np.argsort(at, kind="stable")
    return at[order], t.column("value").to_numpy()[order] if value else at[order]


def read_parquet(folder: str, columns: list[str]) -> pa.Table | None:
    """The Parquet files of a folder of the shared store, in a Python worker; nothing if there is no such folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = open_fs(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    found = []
    for f in store.get_file_info(fs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                found.append(pq.ParquetFile(source).read(columns=columns))
    return pa.concat_tables(found) if found else None


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    for x in column.to_pylist():
        yield x or ""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def open_fs(uri: str):
    """(filesystem, path) of a folder of the shared store, usable in a Python worker."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write a file under a temporary name and rename it: a reader sees all of it or nothing,
    and a task that runs again replaces its file by the same."""
    store, folder = open_fs(uri)
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft, compression=None) as f:
        f.write(data)
    try:
        store.move(draft, f"{folder}/{name}")
    except OSError:  # some stores don't replace on a move
        store.delete_file(f"{folder}/{name}")
        store.move(draft, f"{folder}/{name}")


def get_file(uri: str, name: str) -> bytes:
    store, folder = open_fs(uri)
    with store.open_input_file(f"{folder}/{name}") as f:
        return f.read()

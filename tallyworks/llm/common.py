"""Shared helpers: the shared working folder, materialised tables, input reading, worker-side caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a worker turns into Python objects at a time.
SLICE_ROWS = 256

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own on a local master, else an error."""
    context = spark.sparkContext
    held = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        own = f"file://{tempfile.mkdtemp(prefix='tallyworks-')}"
        context.setCheckpointDir(own)
        _own_dirs[context.applicationId] = own
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by materialize() once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this application has materialised; call it when the results have been written elsewhere."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)


def path_of(df: DataFrame) -> str:
    """The folder of a table made by materialize()."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; other columns, whatever their names, don't reach Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Names a text: 60 bits of its MD5; null of null."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that only a few rows are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows to record batches of bounded size."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_worker: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """One object for each Python worker process, kept while tasks come and go."""
    if key not in _worker:
        _worker[key] = make()
    return _worker[key]

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one slice of an Arrow batch holds at most (one longer text makes a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only (the path may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a scratch one only where it is unset (local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = "/tmp/checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor never recomputes what is above it."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into row ranges of about ``limit`` text bytes, so that a task's memory stays bounded."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(lengths):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start, n - start)


def utf8(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def to_ipc(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def cut_packed(df: DataFrame) -> DataFrame:
    """As ``cut``, for many small rows: the checkpoint holds compressed batches, which are opened again as they are read."""
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([to_ipc(batch)], pa.binary())], ["body"])

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                yield from from_ipc(body.as_py()).to_batches()

    return cut(df.mapInArrow(pack, "body binary")).mapInArrow(open_, schema)


def free_names(carry: list[str], taken: list[str]) -> list[str]:
    """The ``carry`` names; one that is among ``taken`` gets leading underscores until no other column has it."""
    held, out = {*taken, *carry}, []
    for n in carry:
        new = n
        while new in taken or (new != n and new in held):
            new = f"_{new}"
        held.add(new)
        out.append(new)
    return out


def row_hash(df: DataFrame, columns: list[str] | None = None):
    """A 64-bit hash of a whole row, nulls told from empty strings."""
    names = columns or df.columns
    parts = [c for n in names for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]
    return F.xxhash64(*parts)

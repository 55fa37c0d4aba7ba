"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.session import ship

#: Bytes up to which a side is sent to every executor, by its counted rows and the width of its columns; beyond it the join shuffles.
BROADCAST_BYTES = 64_000_000
#: Bytes that a value takes there: arrays of a few entries, text of an identifier; what a row takes beside its values.
WIDTHS = {"int": 8, "bigint": 8, "double": 8, "boolean": 8, "binary": 32, "string": 48}
ROW_WIDTH, ARRAY_WIDTH = 48, 96


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a new one where none is named and driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows, of the width of its columns, take few enough bytes, else as it is."""
    width = ROW_WIDTH + sum(WIDTHS.get(kind, ARRAY_WIDTH) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= most else df


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sampled(key, share: float) -> F.Column:
    """True for about a share of all keys, the same ones in every run; at least one in 2 to the 40."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < math.ceil(share * (1 << 40))


def pieces(weights, most: int):
    """Splits 0..len(weights) into runs of at most `most` total weight (a heavier item stands alone)."""
    start, total = 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(weights):
        yield start, len(weights)


def frugal(run):
    """run, a generator over batches, with freed memory given back to the system when its task ends: workers live on, and others need the room."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def add_columns(df: DataFrame, fields: list[tuple[str, str, object]], work, of: str) -> DataFrame:
    """df with columns made from Arrow batches of column `of`; a column of df that has a new one's name is replaced.

    fields: (name, Spark type, Arrow type) of each new column. work: gets a list of values, returns a list for each field.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [name for name, _, _ in fields]
    ship(df.sparkSession)
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), *([F.col(f"`{of}`").alias("_of")] if of in names else []))
    source = "_of" if of in names else of
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != "_of"), *(T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in fields)])
    arrow = [kind for _, _, kind in fields]

    def run(batches):
        for batch in batches:
            made = work(batch.column(batch.schema.get_field_index(source)).to_pylist()) if batch.num_rows else [[] for _ in names]
            old = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_of"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in old), *(pa.array(v, type=k) for v, k in zip(made, arrow, strict=True))], names=[*(n for n, _ in old), *names])

    return kept.mapInArrow(frugal(run), schema)

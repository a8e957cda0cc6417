"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts are long: fewer rows and bytes at once keep a Python worker's memory small. A caller's smaller values stay.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 16_777_216}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it, and bound the batches they are sent."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for k, most in ARROW.items():
        try:
            now = spark.conf.get(k).lower().removesuffix("b")
        except Exception as e:  # a setting that this version lacks
            if "SQL_CONF_NOT_FOUND" not in str(e):
                raise
            continue
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(k, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, as a cluster's machines share none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphbench-ckpt-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphbench/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphbench_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_graphbench_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder_is(col: str, modulus: int, value: int) -> Column:
    """crc32 of the id as text, modulo; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == value, F.lit(False))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def chunks(texts: list, limit: int = 2_000_000):
    """(start, end) of runs of texts of about `limit` bytes, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 64
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def judged(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[pa.Array]]], extra: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of df and, beside them, what the worker's function makes of the texts: rows are judged where they are read.

    make is called once a task; extra is the schema of the new columns, whose names must not be among keep.
    """
    extra_type = StructType.fromDDL(extra)
    shape = StructType([df.schema[c] for c in keep] + extra_type.fields)
    at = keep.index(text_col) if text_col in keep else len(keep)
    taken = df.select(*[df[c] for c in keep], *([df[text_col]] if at == len(keep) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *judge(byte_texts(b.column(at)))], names=shape.names)

    return taken.mapInArrow(run, shape)


def sampled_ids(rows: DataFrame, id_col: str, group: str, most: int, seed: int, max_broadcast: int = 100_000) -> DataFrame:
    """(id, group), distinct: at most `most` ids of each group, those whose hash is least.

    A bound on the hash, from the group's number of distinct ids (estimated within 2 %), leaves about twice as many ids as are wanted before
    they are ranked: the task that ranks a group sees those few, however many rows, repeats and partitions there are.
    """
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(id_col, 0.02).alias("n"))
    few = sizes.limit(max_broadcast + 1).collect()
    if len(few) <= max_broadcast:
        sizes = F.broadcast(rows.sparkSession.createDataFrame(few, sizes.schema))
    shares = sizes.select(group, (F.lit(2.0 * most + 64) / F.greatest("n", F.lit(1))).alias("__share"))
    mark = F.xxhash64(id_col, F.lit(seed))
    near = rows.select(id_col, group).join(shares, group).where(mark / 2.0**64 + 0.5 < F.col("__share")).select(id_col, group).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col))
    return near.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", least: int = 100_000, hot_keys: int = 20_000) -> DataFrame:
    """rows joined to a table of one row a key. A key with over `least` rows is dealt to parts by a hash of `by`, each with a copy of the table's row.

    rows must be a written table. A part has at most max(least, rows / hot_keys) rows, so at most hot_keys keys are hot: only they are broadcast.
    """
    n = rows.count()
    if n <= least:
        return rows.join(table, keys, how)
    most = max(least, -(-n // hot_keys))
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    a = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(by, F.lit(29)), parts).cast("int")).drop("__parts")
    b = table.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")


def require(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else df carries."""
    return df.select(*[df[n] for n in names])


def arrow_kind(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type in which a column reaches Python workers."""
    return to_arrow_type(df.schema[name].dataType)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; operators take any other path instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quiet_threads() -> None:
    """One thread a worker for tokenizers and BLAS."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


assert sys.byteorder == "little"

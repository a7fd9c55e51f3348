"""What several operators share: reading, row keys, worker caches, shared files."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import stage, staging_root

__all__ = ["table", "text_of", "row_key", "worker_cache", "shared_file", "bitmap_of", "stage", "bit_slots", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row by value: rows with the same id and text are one document."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), text_of(text_col))))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def worker_cache(kind: str, key, make):
    """A value kept by a Python worker from task to task; functions that travel by value have no globals that stay.

    A worker keeps one value of each kind: another key replaces it, so its memory does not grow with the calls.
    """
    module = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    held = module.__dict__.setdefault("held", {})
    if kind not in held or held[kind][0] != key:
        held.pop(kind, None)
        held[kind] = key, make()
    return held[kind][1]


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write bytes below the shared folder and let executors fetch them; returns the name for ``SparkFiles.get``."""
    name = f"{uuid.uuid4().hex[:12]}-{name}"
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/{sc.applicationId}/{name}")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(content), 1 << 20):
        stream.write(bytearray(content[at : at + (1 << 20)]))
    stream.close()
    sc.addFile(path.makeQualified(path.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), path).toString())
    return name


def bit_slots(hashes: Column, bits: int) -> list[Column]:
    """Two bit positions of a 64-bit hash in a bitmap of 2**bits bits."""
    mask = F.lit((1 << bits) - 1)
    return [hashes.bitwiseAND(mask), F.shiftrightunsigned(hashes, 32).bitwiseAND(mask)]


def bitmap_of(hashes: DataFrame, bits: int):
    """A Bloom bitmap of the column ``hash`` as numpy words.

    Its size is fixed: 2**bits bits, whatever the number of rows. A full bitmap passes more rows
    to the exact join behind it and loses none.
    """
    import numpy as np

    slots = hashes.select(F.explode(F.array(*bit_slots(F.col("hash"), bits))).alias("slot"))
    words = (
        slots.groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64).view(np.uint64)
    return out

"""Scratch tables in the cluster's shared folder, and bounded membership bitmaps."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may leave it unset: one machine then stands for the cluster, and a
    temporary folder is made and set. On a cluster an unset folder is an error, since a
    machine-local folder isn't seen by the other executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Scratch paths of the stages that are being watched, innermost last.
_WATCHED: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/lodeweave/{label}-{uuid.uuid4().hex}"
    for paths in _WATCHED:
        paths.append(path)
    return path


def written_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written; all other scratch tables that were made for it are deleted then."""
    _WATCHED.append(made := [])
    try:
        out = materialise(make(), label)
    finally:
        _WATCHED.remove(made)
    for path in made:
        if path != out.scratch:
            delete_scratch(out.sparkSession, path)
    return out


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables once all that was made from them is written itself."""
    for t in tables:
        delete_scratch(t.sparkSession, t.scratch)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have been written: it does so when the driver collects its garbage, which can
    be long after, with the files of all exchanges on the disks until then. The plan written last may be held until the next one is."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder that no returned DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim() -> None:
    """Give memory that a task has freed back to the system, before the worker waits for other work."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give_back is not None:
        give_back(0)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows made on the driver, as one literal that the JVM parses."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kinds = ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


#: Membership bitmaps have 2**BITMAP_BITS bits (4 MB): a fixed size, whatever the input's.
BITMAP_BITS = 25


def bitmap_slot(key: Column) -> Column:
    """The bitmap bit of a 64-bit hash."""
    return F.pmod(key, F.lit(1 << BITMAP_BITS))


def membership_bitmap(keys: DataFrame, key: str) -> bytes:
    """A bitmap of the hashes in ``keys[key]``: a fixed 4 MB, safe to broadcast at any input size.

    It lets scans drop most rows that a later exact join would drop; false positives stay.
    """
    slot = bitmap_slot(F.col(key))
    rows = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    # bucket b holds the positions 32768*(b-1) .. 32768*b-1, so (pmod) slot 0 counts to bucket 1 or 0
    out = np.zeros((1 << BITMAP_BITS) // 8 + 8192, dtype=np.uint8)
    for row in rows.toLocalIterator():  # at most 1,025 rows of 4 KB
        start = max(row["bucket"], 0) * 4096
        out[start : start + 4096] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out.tobytes()


def bitmap_has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes may be in the bitmap."""
    slot = keys.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    # mirrors bitmap_bucket_number / bitmap_bit_position for non-negative values
    bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    position = np.where(slot > 0, (slot - 1) % 32768, (-slot) % 32768)
    return (bitmap[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


#: The coarse form of a bitmap, which is tested by the JVM: 2**COARSE_BITS bits (32 KB), whatever the input's size.
COARSE_BITS = 18


def may_hold(bitmap: bytes, key: Column) -> Column:
    """Whether a 64-bit hash may be in a bitmap of ``membership_bitmap``, by a coarse form of it that is part of the expression.

    It spares Python the rows that few keys want; with very many keys it lets all pass.
    """
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little"))
    slots = np.where(at >= 32768, at - 32767, 0)  # the inverse of ``bitmap_has``
    coarse = np.zeros(1 << COARSE_BITS, dtype=np.uint8)
    coarse[slots & ((1 << COARSE_BITS) - 1)] = 1
    packed = np.packbits(coarse, bitorder="little").tobytes()
    slot = F.pmod(key, F.lit(1 << COARSE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.lit(packed), F.shiftright(slot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, slot.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1

"""Exact deduplication over an extendible-hash index kept as files in the shared folder.

Built from DataFrame functions only. Every row becomes an entry (key hash, size, text) in the shared
folder. A directory indexed by the leading bits of the key doubles until no bucket holds more bytes
than its capacity, or until it can't be split further because one key fills it. A bucket is a range of
keys. The entries are exchanged by bucket, so that each owner task has the whole of its key ranges; it
sorts them by key and text and walks each key's chain, in which texts are told apart byte for byte, not
by their hashes. The chains are written to the shared folder. Entries then find their group by key
alone, unless the key's chain has several texts (a collision): then by their bytes as well.

A key whose copies alone would overfill a bucket (a text that a third of all rows share) is summed up
before the exchange, so its owner gets a row for each task.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import materialise, release, small_table

#: The directory has at most 2**MAX_DEPTH slots, whatever the input's size; beyond that buckets grow.
MAX_DEPTH = 16
#: Unless a capacity is given, there are about so many buckets for each shuffle partition, within these bounds in bytes.
BUCKETS_EACH = 16
LEAST_CAPACITY, MOST_CAPACITY = 64 << 10, 64 << 20


def normalised(text: Column) -> Column:
    """A text with A-Z (and only these) in lower case; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # of a text whose characters are all one byte, lower() changes A-Z only, and does so byte by byte
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


@dataclass
class Index:
    """The files of an index: entries by row, chains by distinct text, and the directory."""

    entries: DataFrame  # row_id, id, key, n_bytes, and the text or all columns of the row
    chains: DataFrame  # bucket, key, chain (place in the key's chain), texts (length of the chain), text (if there are several), sha, keep_id, keep_row_id, group_size
    directory: np.ndarray  # slot -> bucket
    depth: int
    text: Column  # of an entry, normalised
    clashes: int  # keys with several texts


def split_buckets(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The directory (slot -> bucket) and its depth from the bytes below each of the finest slots.

    It starts with one bucket; while some bucket is overfull and can be split, the directory
    doubles and that bucket's slots are dealt to two new ones by the next bit.
    """
    finest = len(sizes).bit_length() - 1
    depth, local = 0, {(0, 0): int(sizes.sum())}  # (local depth, prefix) -> bytes
    todo = [(0, 0)]
    while todo:
        at, prefix = todo.pop()
        if local[at, prefix] <= capacity or at == finest:
            continue
        del local[at, prefix]
        width = 1 << (finest - at - 1)
        for bit in (0, 1):
            child = (prefix << 1) | bit
            local[at + 1, child] = int(sizes[child * width : (child + 1) * width].sum())
            todo.append((at + 1, child))
        depth = max(depth, at + 1)
    directory = np.zeros(1 << depth, dtype=np.int64)
    for bucket, (at, prefix) in enumerate(sorted(local, key=lambda x: x[1] << (finest - x[0]))):
        width = 1 << (depth - at)
        directory[prefix * width : (prefix + 1) * width] = bucket
    return directory, depth


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, whole_rows: bool = False, hashed: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Build the index over every row and whole text of ``docs``; ``capacity`` is a bucket's most bytes.

    Null texts count as empty; null ids sort before all others. Rows with the same id and text are
    copies like others. An empty table gives empty files. Other columns are ignored, unless the entries
    are to hold ``whole_rows``; their names can't clash. ``hashed`` gives the 64-bit key of a text; any
    function will do, a poor one makes longer chains.
    """
    spark = docs.sparkSession
    # the row's columns travel in a struct, so that no name can clash
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole_rows else normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), body.alias("body"))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "id", hashed(F.col("text")).cast("long").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), "body")
    seen = Observation()
    entries = materialise(rows.observe(seen, F.sum(F.col("n_bytes") + 1).alias("total")), "entries")
    text = normalised(F.col("body").getField(text_col)) if whole_rows else F.col("body")
    total = seen.get["total"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = capacity or min(MOST_CAPACITY, max(LEAST_CAPACITY, total // (BUCKETS_EACH * partitions)))
    finest = min(MAX_DEPTH, max(1, (total // capacity + 1).bit_length() + 4))

    keys = entries.groupBy("key").agg(F.sum(F.col("n_bytes") + 1).alias("n"), F.count("*").alias("rows"))
    keys = materialise(keys, "keys")
    sizes = np.zeros(1 << finest, dtype=np.int64)
    for row in keys.groupBy(_slot(F.col("key"), finest).alias("slot")).agg(F.sum("n").alias("n")).toLocalIterator():  # at most 2**MAX_DEPTH rows of two numbers
        sizes[row["slot"]] = row["n"]
    directory, depth = split_buckets(sizes, capacity)
    slots = small_table(spark, [(i, int(b)) for i, b in enumerate(directory)], "slot bigint, bucket bigint")

    # a row of a group so far: the row that stays (nulls are the least ids), and how many rows it has
    first = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("row_id")).alias("keep")
    single = entries.select("key", text.alias("text"), first, F.lit(1).cast("long").alias("n"))
    merged = [F.max("keep").alias("keep"), F.sum("n").alias("n")]
    full = keys.where((F.col("n") > capacity) & (F.col("rows") > 1)).select("key")
    if not full.isEmpty():
        # each of these keys has more than ``capacity`` bytes, so there are fewer than total / capacity of them: a bounded broadcast
        full = F.broadcast(full)
        heavy = single.join(full, "key", "left_semi").groupBy("key", "text").agg(*merged)
        single = single.join(full, "key", "left_anti").unionByName(heavy)
    # the directory's size is fixed (2**MAX_DEPTH slots at most), so it may be broadcast
    dealt = single.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(slots), "slot").drop("slot")
    # one exchange by bucket serves the grouping and the chains
    groups = dealt.repartition("bucket").groupBy("bucket", "key", "text").agg(*merged)
    own = Window.partitionBy("bucket", "key")
    walked = groups.select(
        "bucket", "key", F.row_number().over(own.orderBy("text")).alias("chain"), F.count("*").over(own).alias("texts"), F.sha2("text", 256).alias("sha"),
        "text", F.col("keep.id").alias("keep_id"), F.col("keep.row_id").alias("keep_row_id"), F.col("n").alias("group_size"),
    )
    clashes = Observation()
    walked = walked.withColumn("text", F.when(F.col("texts") > 1, F.col("text"))).observe(clashes, F.count_if((F.col("texts") > 1) & (F.col("chain") == 1)).alias("n"))
    chains = materialise(walked, "chains")
    release(keys)
    return Index(entries, chains, directory, depth, text, clashes.get["n"])


def resolve(index: Index) -> DataFrame:
    """One row per entry: row_id, id, keep_id, group_size, kept, sha. Exactly one row of each group is kept:
    that with the largest id and, among repeated rows with the same id, any one."""
    entries = index.entries.select("row_id", "id", "key")
    # the owner has compared the bytes of all entries of a key: where its chain has one text, they are equal
    found = entries.join(index.chains.where("texts = 1").select("key", "sha", "keep_id", "keep_row_id", "group_size"), "key")
    if index.clashes:
        chains = index.chains.where("texts > 1").select(F.col("key").alias("chained"), F.col("text").alias("same"), "sha", "keep_id", "keep_row_id", "group_size")
        told = index.entries.select("row_id", "id", "key", index.text.alias("text")).join(chains.select(F.col("chained").alias("key")).distinct(), "key", "left_semi")
        found = found.unionByName(told.join(chains, [F.col("key") == F.col("chained"), F.col("text") == F.col("same")]).drop("chained", "text", "same"))
    return found.select("row_id", "id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row_id")).alias("kept"), "sha")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id, with all its columns.

    Of rows that repeat an id and text any one stays, whatever their other columns hold. Texts are
    compared by their bytes and rows are named by their number, so no two can be mistaken for each other.
    """
    index = build(docs, id_col, text_col, whole_rows=True)
    keep = index.chains.select(F.col("keep_row_id").alias("row_id"))
    return index.entries.join(keep, "row_id", "left_semi").select("body.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return resolve(index).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

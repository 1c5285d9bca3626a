"""Sharding by histogram sort.

Rows are ordered by a hash of their text, then by a hash of their id: equal texts are neighbours and
yet can be told apart. The bytes below candidate boundaries are counted exactly across all
partitions; only the intervals in which a splitter still has to be found, or which are too large for
one task, get finer probes in the next round. Then the rows are exchanged once. Built from DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import materialise, small_table

#: Each round of probes splits an interval by so many bits.
BITS = 12
LEVELS = [("h1", 52), ("h1", 40), ("h1", 28), ("h1", 16), ("h1", 4), ("h1", 0), ("h2", 52), ("h2", 40), ("h2", 28), ("h2", 16), ("h2", 4), ("h2", 0)]


def digit(level: int) -> Column:
    """Which of a node's children a row falls into."""
    name, shift = LEVELS[level]
    return F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit((1 << BITS) - 1 if shift else (1 << 4) - 1))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``row`` (a struct of all columns, or those to ``keep``: no name can clash), ``id``, and the ``size`` and both halves of the sorting key.

    A null text has no bytes and is like an empty one; null ids have a hash like others. Repeated rows have the
    same key and are told apart by nothing: their slots are dealt as they come.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(keep or [F.col(f"`{c}`") for c in docs.columns]))
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("h1"), F.xxhash64(F.col(id_col)).alias("h2"))


@dataclass
class Node:
    """An interval of the key: its path, and the exact rows and bytes in it."""

    level: int  # of the digit that its children differ in
    rows: int
    size: int
    children: dict[int, Node] = field(default_factory=dict)
    number: int = -1  # of an opened node
    shard: int = 0
    part: int = 0
    offset: int = 0  # rows of the shard in earlier parts


@dataclass
class Plan:
    root: Node
    opened: list[Node]
    shards: int
    parts: int
    rounds: int
    sizes: list[int]


def _leaves(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.children:
            todo.extend(node.children[d] for d in sorted(node.children, reverse=True))
        else:
            out.append(node)
    return out


def plan(rows: DataFrame, shards: int, tolerance: float = 0.005, part_rows: int = 1_000_000) -> Plan:
    """Find splitters so that each shard's bytes differ from an even share by ``tolerance`` of it at most,
    as far as single rows allow. ``rows`` needs size, h1 and h2, and is read once a round.

    A text's copies stay together unless a splitter inside them can't move to their edge within the
    tolerance. An empty table has one empty part; a single row goes to a shard in the middle; rows that
    tie in both hashes can't be split from each other. What reaches the driver is the counts below the probes: 2**BITS for each of the few
    opened intervals.
    """
    root = Node(0, 0, 0)
    fresh, opened, rounds = [root], [], 0
    while fresh:
        for node in fresh:
            node.number = len(opened)
            opened.append(node)
        level = fresh[0].level
        by_number = {x.number: x for x in fresh}
        here = _descend(rows, opened, level)
        counted = here.where(F.col("node").isin(list(by_number))).groupBy("node", digit(level).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        for r in counted.toLocalIterator():
            by_number[r["node"]].children[r["digit"]] = Node(level + 1, r["rows"], r["size"])
        rounds += 1
        if level == 0:
            root.rows, root.size = sum(c.rows for c in root.children.values()), sum(c.size for c in root.children.values())
        share = root.size / shards
        most_rows = max(part_rows, root.rows // 1024)
        before, fresh, deepest = 0, [], level + 1
        for leaf in _leaves(root):
            first = int(before // share) + 1 if share else shards
            crossed = [k * share for k in range(first, shards) if before < k * share < before + leaf.size]
            off = any(min(t - before, before + leaf.size - t) > tolerance * share for t in crossed)
            if leaf.rows > 1 and (off or leaf.rows > most_rows) and leaf.level == deepest and deepest < len(LEVELS):
                fresh.append(leaf)
            before += leaf.size
    leaves = _leaves(root) if root.children else []
    edges = np.cumsum([0] + [x.size for x in leaves])
    share = root.size / shards
    cuts = [int(np.abs(edges - k * share).argmin()) for k in range(1, shards)] if leaves else []
    part, filled, offset, last, sizes = -1, 0, 0, -1, [0] * shards
    for i, leaf in enumerate(leaves):
        leaf.shard = int(np.searchsorted(cuts, i, side="right"))
        sizes[leaf.shard] += leaf.size
        if leaf.shard != last:
            offset = 0
        if leaf.shard != last or filled + leaf.rows > part_rows:
            part, filled, start = part + 1, 0, offset
        leaf.part, leaf.offset, last = part, start, leaf.shard
        filled += leaf.rows
        offset += leaf.rows
    return Plan(root, opened, shards, part + 1, rounds, sizes)


def _descend(rows: DataFrame, opened: list[Node], level: int) -> DataFrame:
    """``rows`` with the number of the opened node of ``level`` that each is in, or null."""
    out = rows.withColumn("node", F.lit(0).cast("long"))
    for at in range(level):
        steps = [(n.number, d, c.number) for n in opened if n.level == at for d, c in n.children.items() if c.number >= 0]
        table = small_table(rows.sparkSession, steps, "node bigint, digit bigint, next bigint")
        # a row for each opened node: few at any input size
        out = out.withColumn("digit", digit(at)).join(F.broadcast(table), ["node", "digit"]).drop("node", "digit").withColumnRenamed("next", "node")
    return out


def exchange(rows: DataFrame, how: Plan) -> DataFrame:
    """The ``keyed`` rows in their shards: adds ``shard`` and ``slot`` (gapless from 0), exchanging the rows once.

    Slots follow the key; rows that tie in it have slots in any order. No rows give no rows.
    """
    spark, out = rows.sparkSession, rows.withColumn("_node", F.lit(0).cast("long"))
    levels = sorted({n.level for n in how.opened})
    places = [F.lit(None).cast("struct<shard:int,part:int,offset:bigint>")]
    for at in levels:
        table = [
            (n.number, d, c.number if c.number >= 0 else None, c.shard, c.part, c.offset) for n in how.opened if n.level == at for d, c in n.children.items()
        ]
        frame = small_table(spark, table, f"_node bigint, _digit bigint, _next bigint, _shard{at} int, _part{at} int, _offset{at} bigint")
        # 2**BITS rows at most for each opened node: fixed by the tolerance, not by the rows
        out = out.withColumn("_digit", digit(at)).join(F.broadcast(frame), ["_node", "_digit"], "left").drop("_node", "_digit")
        # a row that has reached its leaf has no further node and so finds nothing below
        place = F.struct(F.col(f"_shard{at}").alias("shard"), F.col(f"_part{at}").alias("part"), F.col(f"_offset{at}").alias("offset"))
        places.append(F.when(F.col("_next").isNull() & F.col(f"_part{at}").isNotNull(), place))
        out = out.withColumn(f"_at{at}", places[-1]).withColumnRenamed("_next", "_node")
    out = out.withColumn("_at", F.coalesce(*[F.col(f"_at{at}") for at in levels])).drop("_node", *[f"_{x}{at}" for at in levels for x in ("shard", "part", "offset", "at")])
    out = out.withColumn("_part", F.col("_at.part")).repartition(max(1, how.parts), "_part")
    order = Window.partitionBy("_part").orderBy(F.col("h1").bitwiseXOR(F.lit(-(1 << 63))), F.col("h2").bitwiseXOR(F.lit(-(1 << 63))), F.col("id"))
    return out.select("*", F.col("_at.shard").alias("shard"), (F.row_number().over(order) - 1 + F.col("_at.offset")).alias("slot")).drop("_at", "_part")


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``size``, ``shard`` and ``slot`` of every row."""
    rows = keyed(docs, id_col, text_col)
    # the plan reads sizes and hashes only, and so does the scan below it
    return exchange(rows, plan(rows.select("size", "h1", "h2"), shards, tolerance)).select("row", "size", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = materialise(keyed(docs, keep=[F.col("doc_id"), crc.alias("text_crc32")]), "shard-keys")
    out = exchange(rows, plan(rows, 16))
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

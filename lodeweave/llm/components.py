"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeweave.llm.common import materialise, release


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their count and digest, taken while they are written."""
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("digest")), "edges")
    return out, tuple(seen.get.values())


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 200) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node of an edge but the smallest itself.

    Each round attaches nodes to smaller neighbours, so components of any shape collapse to stars in
    a number of rounds that grows with the logarithm of their size. Only counts reach the driver;
    a hub's smallest neighbour is found with partial sums, and its edges come back by a join that
    can be split. Edges are written to the shared folder each round. Should ``rounds`` not be enough,
    that is an error: labels that haven't settled are never returned.
    """
    pairs = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()
    now, state = _written(pairs)
    seen = None
    for _ in range(rounds):
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # repeated edges of this step go with those of the next one: there are no more of them than edges
        large = both.join(least, "u").where("v > u").select(F.col("v"), F.col("m")).where("v <> m")
        smaller = large.select(F.col("v").alias("u"), F.col("m").alias("v"))  # u > v
        least = smaller.groupBy("u").agg(F.min("v").alias("m"))
        joined = smaller.join(least, "u")
        small = joined.select(F.col("m").alias("u"), F.col("v")).where("u <> v").union(joined.select(F.col("m"), F.col("u"))).distinct()
        last = now
        now, state = _written(small)
        release(last)
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("label"))

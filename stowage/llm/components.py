"""Connected components of a graph of undirected edges, in rounds of joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import scratch_dir, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node reachable from it.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its smallest neighbour, then
    its smaller ones are. Paths halve in length from round to round. Every round aggregates before it joins and
    writes its edges to the shared folder, so a node with very many neighbours is split by adaptive execution and a lost
    executor costs no earlier round. Loops and repeated edges do no harm; no edges give no rows.
    """
    scratch = scratch_dir(edges.sparkSession, "components")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{scratch}/0")
    state = None
    for turn in itertools.count(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        larger = larger.distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("least"))
        smaller = larger.join(least, "a")
        tied = smaller.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        now = written(tied.where("a <> b").distinct(), f"{scratch}/{turn}")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            own = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
            roots = own.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return own.unionByName(roots)
        state = found
    raise AssertionError("unreachable")

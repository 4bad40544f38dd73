"""Dependency graphs as two DataFrames: ``nodes(key)`` and ``edges(key, requisite)``.

Both walks below first contract chains: a node with one requisite is only as far from the next node that has none or
several as its chain is long, which pointer doubling finds in as many rounds as the length has binary digits. The rest
goes round by round over the nodes with several requisites.

A round joins the edges with the keys found in the round before, and writes its state as a table in the scratch folder: the
plan never grows, an executor may be lost at any time, and Spark sees the true size of the small side and broadcasts it only
if it is small. Where it is not, adaptive execution splits a requisite that many nodes wait for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.errors import GraphError
from stowage.session import scratch_dir, written

SHRINK_FACTOR = 4


def _counted(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` and read it back; ``metrics`` are aggregates taken during the write."""
    seen = Observation(f"round-{uuid.uuid4().hex}")
    df = df.observe(seen, *[F.coalesce(metric, F.lit(0)).alias(name) for name, metric in metrics.items()])
    return written(df, path), seen.get


def dependency_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known nodes. A requisite that is no node counts as satisfied."""
    known = nodes.select("key")
    return (
        edges.select("key", "requisite")
        .distinct()
        .join(known, "key", "left_semi")
        .join(known.withColumnRenamed("key", "requisite"), "requisite", "left_semi")
        .select("key", "requisite")
    )


def external_requisites(nodes: DataFrame, edges: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Edges whose requisite lies outside the graph, or is listed in ``done(key)``."""
    waiting = nodes.select("key")
    if done is not None:
        waiting = waiting.join(done.select("key"), "key", "left_anti")
    return edges.select("key", "requisite").distinct().join(
        waiting.withColumnRenamed("key", "requisite"), "requisite", "left_anti"
    ).select("key", "requisite")


def ready_nodes(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes not done yet whose requisites are all done or external."""
    finished = done.select("key")
    remaining = nodes.select("key").join(finished, "key", "left_anti")
    pending = dependency_edges(nodes, edges).join(finished.withColumnRenamed("key", "requisite"), "requisite", "left_anti")
    return remaining.join(pending.select("key").distinct(), "key", "left_anti")


def _raise_cycle(stuck: DataFrame) -> None:
    some = [str(r.key) for r in stuck.select("key").orderBy("key").limit(5).collect()]
    raise GraphError(f"{stuck.count()} nodes wait for each other in a cycle, such as {', '.join(some)}")


def contracted(links: DataFrame, marks: DataFrame, scratch: str) -> DataFrame:
    """``(key, root, steps, mark)`` for every node with exactly one requisite in ``links(key, requisite)``.

    ``root`` is the first node on the way down that has none or several requisites, ``steps`` how far it is. ``mark`` is the
    smallest mark in ``marks(key, mark)`` on the way, its own included and the root's not. A way that leads back into
    itself has no root: its nodes keep pointing at each other, with ``root`` NULL.
    """
    single = links.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("requisite").alias("next")).where("n = 1").select("key", "next")
    # Open is who points at such a node, and so has further to go. Only open nodes are joined by whom they point at: in the end
    # all nodes may point at one root, which would take them to one task.
    further = single.select(F.col("key").alias("next"), F.lit(True).alias("open"))
    state = single.join(further, "next", "left").join(marks, "key", "left").select(
        "key", "next", F.lit(1).cast("bigint").alias("steps"), "mark", F.coalesce("open", F.lit(False)).alias("open")
    )
    open_nodes, found = _counted(state, f"{scratch}/chains-0", rows=F.count(F.lit(1)), open=F.count_if("open"))
    # A chain has no more steps than there are such nodes; whoever has made more goes round in a circle.
    nodes, turn, before = found["rows"], 0, found["open"]
    while before != 0 and 1 << turn <= 2 * nodes:
        turn += 1
        ahead = open_nodes.select(
            F.col("key").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"), F.col("mark").alias("there"), F.col("open").alias("on")
        )
        # Whoever reaches a node whose way has ended is at its root, and moves no more.
        moved = open_nodes.where("open").join(ahead, "next").select(
            "key", F.col("after").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.least("mark", "there").alias("mark"), F.col("on").alias("open")
        )
        both = moved.unionByName(open_nodes.where("NOT open"))
        open_nodes, found = _counted(both, f"{scratch}/chains-{turn}", open=F.count_if("open"))
        before = found["open"]
    return open_nodes.select("key", F.when(~F.col("open"), F.col("next")).alias("root"), "steps", "mark")


def _contracted_links(links: DataFrame, chains: DataFrame) -> DataFrame:
    """``(key, requisite, steps, mark)`` between the nodes that are left, for those with several requisites."""
    several = links.join(chains.select("key"), "key", "left_anti")
    through = chains.select(F.col("key").alias("requisite"), "root", F.col("steps").alias("more"), "mark")
    return several.join(through, "requisite", "left").select(
        "key", F.coalesce("root", "requisite").alias("requisite"), (F.coalesce("more", F.lit(0)) + 1).alias("steps"), "mark"
    )


def restore_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(key, wave)``: wave 0 has no requisites, every other node comes one wave after its last one.

    Nodes with one requisite follow their chain's root at a known distance. Each other node carries the number of requisites
    it still waits for and the latest wave among those that are ready; a round subtracts what became ready in the
    round before, and a node reaching zero is ready and leaves the state. Duplicate nodes and cycles raise.
    """
    spark: SparkSession = nodes.sparkSession
    base = scratch_dir(spark, "waves")
    copies, found = _counted(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), base + "/nodes", duplicates=F.count_if(F.col("copies") > 1))
    if found["duplicates"]:
        some = [str(r.key) for r in copies.filter("copies > 1").select("key").orderBy("key").limit(5).collect()]
        raise GraphError(f"duplicate nodes: {', '.join(some)}")
    links = written(dependency_edges(nodes, edges), base + "/edges")
    no_marks = links.limit(0).select("key", F.lit(None).cast("string").alias("mark"))
    chains = written(contracted(links, no_marks, base), base + "/chains")
    turning = chains.where("root IS NULL")
    if not turning.isEmpty():
        _raise_cycle(turning)
    links = written(_contracted_links(links, chains).select("key", "requisite", "steps"), base + "/contracted")

    waiting = links.groupBy("key").agg(F.count(F.lit(1)).alias("left"))
    state = copies.select("key").join(chains.select("key"), "key", "left_anti").join(waiting, "key", "left").select(
        "key", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).cast("bigint").alias("wave")
    )
    turn, kept = 0, 0
    while True:
        state, found = _counted(
            state, f"{base}/state/turn={turn}", ready=F.count_if(F.col("left") == 0), waiting=F.count_if(F.col("left") > 0)
        )
        if found["waiting"] == 0:
            break
        blocked = state.filter("left > 0").select("key", "left", "wave")
        if turn == 0:
            kept = found["waiting"]
        if found["ready"] == 0:
            behind = chains.join(blocked.select(F.col("key").alias("root")), "root", "left_semi").select("key")
            _raise_cycle(blocked.select("key").unionByName(behind))
        if found["waiting"] * SHRINK_FACTOR <= kept:
            # Edges of finished nodes are dead weight in every later round.
            kept = found["waiting"]
            links = written(links.join(blocked.select("key"), "key", "left_semi"), f"{base}/edges-{turn}")
        ready = state.filter("left = 0").select(F.col("key").alias("requisite"), F.col("wave").alias("of"))
        released = links.join(ready, "requisite").groupBy("key").agg(
            F.count(F.lit(1)).alias("released"), F.max(F.col("of") + F.col("steps")).alias("after")
        )
        state = blocked.join(released, "key", "left").select(
            "key", (F.col("left") - F.coalesce("released", F.lit(0))).alias("left"), F.greatest("wave", "after").alias("wave")
        )
        turn += 1
    own = spark.read.parquet(f"{base}/state").filter("left = 0").select("key", "wave")
    follow = chains.join(own.select(F.col("key").alias("root"), F.col("wave").alias("of")), "root")
    return own.unionByName(follow.select("key", (F.col("of") + F.col("steps")).alias("wave"))).select("key", F.col("wave").cast("int").alias("wave"))


def blocked_dependents(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """``(key, failed_requisite)``: nodes that can never become ready because an ancestor failed.

    Where several ancestors failed the smallest key is reported. Causes run down chains of single requisites at once; among
    the other nodes a round passes causes on from nodes whose cause is new or got smaller in the round before. What
    is known so far is one table of best causes in few pieces: pieces of like size are merged, so each cause is
    rewritten a number of times that grows with the logarithm of their number.
    """
    spark: SparkSession = nodes.sparkSession
    base = scratch_dir(spark, "blocked")
    links = written(dependency_edges(nodes, edges), base + "/edges")
    marks = written(failed.select("key", F.col("key").alias("mark")).distinct(), base + "/failed")
    chains = written(contracted(links, marks, base), base + "/chains")
    # A circle of single requisites is one class of its own: whatever failed in it blocks all of it.
    short = written(_contracted_links(links, chains), base + "/contracted")
    heads = written(
        marks.unionByName(short.where("mark IS NOT NULL").select("key", "mark")).groupBy("key").agg(F.min("mark").alias("mark")), base + "/heads"
    )
    fresh, found = _counted(heads, base + "/round-0", rows=F.count(F.lit(1)))
    pieces, step = [(fresh, found["rows"])], 0
    while found["rows"] > 0:
        step += 1
        passed = short.join(fresh.select(F.col("key").alias("requisite"), F.col("mark").alias("cause")), "requisite")
        passed = passed.groupBy("key").agg(F.min("cause").alias("mark"))
        known = _best([piece for piece, _ in pieces]).withColumnRenamed("mark", "known")
        better = passed.join(known, "key", "left").filter("known IS NULL OR mark < known").select("key", "mark")
        fresh, found = _counted(better, f"{base}/round-{step}", rows=F.count(F.lit(1)))
        pieces.append((fresh, found["rows"]))
        while len(pieces) > 1 and pieces[-2][1] <= 2 * pieces[-1][1]:
            last, other = pieces.pop(), pieces.pop()
            pieces.append((written(_best([other[0], last[0]]), f"{base}/merged-{step}-{len(pieces)}"), other[1] + last[1]))
    best = written(_best([piece for piece, _ in pieces]), base + "/best")
    # A chain's node is blocked by what failed on its way or blocks its root; a failed node's own mark blocks others only.
    below = chains.join(best.select(F.col("key").alias("root"), F.col("mark").alias("of_root")), "root", "left")
    below = below.select("key", F.least("mark", "of_root").alias("mark")).where("mark IS NOT NULL")
    every = best.unionByName(below).groupBy("key").agg(F.min("mark").alias("failed_requisite"))
    return every.join(failed.select("key"), "key", "left_anti")


def _best(pieces: list[DataFrame]) -> DataFrame:
    both = pieces[0]
    for piece in pieces[1:]:
        both = both.unionByName(piece)
    return both.groupBy("key").agg(F.min("mark").alias("mark"))

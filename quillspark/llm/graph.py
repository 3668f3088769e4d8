"""Connected components over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch


def _jumped(up: DataFrame, scratch: Scratch) -> DataFrame:
    """``up`` with each node under the end of its chain: pointers double their length until none moves."""
    moving = True
    while moving:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
        jumped = scratch.saved(up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "jumped")
        moving = not jumped.where("moved").isEmpty()
        up = jumped.select("node", "up")
    return up


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node that has a link; nodes are longs.

    Links are contracted until none is left. In a round every node that has a smaller neighbour hooks onto its least one,
    chains of hooks are followed to their ends by pointer jumping, and the links are carried over to those ends; links within
    a node and repeats go. Nodes of a link that have no smaller neighbour touch no other such node, and in the round after
    they hook unless one of the hooked led to them, so two rounds halve the nodes at least, however they are numbered.
    The rounds' hooks, each over the nodes that were left, are put together from the last (smallest) to the first. Rounds are
    written to the shared folder (into ``scratch`` if given), so lineage stays short and lost executors do no harm. Self-links
    and repeated links do no harm; rows with a null end are no links.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    live = scratch.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    alone = live.where("a = b").select(F.col("a").alias("node"))
    live, rounds = live.where("a < b"), []
    while not live.isEmpty():
        up = _jumped(scratch.saved(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooked"), scratch)
        rounds.append(up)
        of_b, of_a = up.select(F.col("node").alias("b"), F.col("up").alias("ub")), up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        ends = live.join(of_b, "b").join(of_a, "a", "left").select(F.coalesce("ua", "a").alias("x"), F.col("ub").alias("y")).where("x <> y")
        live = scratch.saved(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return scratch.saved(alone.select("node", F.col("node").alias("component")), "components")
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("up"), F.col("up").alias("end"))
        found = scratch.saved(rounds.pop().join(later, "up", "left").select("node", F.coalesce("end", "up").alias("up")).unionAll(found), "found")
    roots = found.select(F.col("up").alias("node"), "up").distinct()
    labels = found.unionAll(roots)
    single = alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("up"))
    return scratch.saved(labels.unionAll(single).select("node", F.col("up").alias("component")), "components")

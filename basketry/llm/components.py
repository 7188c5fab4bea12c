"""Connected components by randomised contraction, and groups dealt to tasks in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) from edges (a, b): each id that has an edge, with the smallest id it is connected with.

    In each round every node goes over to the neighbour, or itself, that comes
    first in a random order of that round; edges follow their ends, and edges
    inside a node go. A constant share of the nodes goes per round, whatever
    the graph, and a star or a group in which all are linked goes at once.
    Edges to oneself and repeated edges do nothing.
    """
    pairs = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not pairs.isEmpty():
        def place(x: str) -> Column:
            return F.struct(F.xxhash64(F.lit(len(steps)), F.col(x)).alias("h"), F.col(x).alias("to"))

        ends = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = (ends.groupBy("a").agg(F.min(place("b")).alias("first"))
                .select(F.col("a").alias("id"), F.least("first", place("a"))["to"].alias("to")))
        step = stored(step, "component-step")
        steps.append(step)
        for end in ("a", "b"):
            pairs = pairs.join(step, F.col(end) == F.col("id")).drop(end, "id").withColumnRenamed("to", end)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .where("a <> b").distinct(), "edges")
    if not steps:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    reached = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        reached = (reached.join(further, F.col("to") == F.col("_id"), "left")
                   .select("id", F.coalesce("_to", "to").alias("to")))
    reached = stored(reached, "component-ends")
    least = reached.groupBy(F.col("to").alias("_to")).agg(F.min("id").alias("component"))
    least = stored(least, "component-ids")
    return reached.join(least, F.col("to") == F.col("_to")).select("id", "component")


def in_blocks(members: DataFrame, group: str, members_col: str, id_col: str, most: int) -> DataFrame:
    """Deals the members of each group to blocks of about ``most``, once for each pair of blocks.

    ``members_col``: the size of a member's group. Adds ``lo`` and ``hi``, the
    two blocks that meet, and ``left``: whether the row's own is ``lo``. A
    group of one block meets itself (lo = hi, left true).
    """
    blocks = F.ceil(F.col(members_col) / most).cast("int")
    return (members.withColumn("_blocks", F.greatest(blocks, F.lit(1)))
            .withColumn("_own", F.pmod(F.xxhash64(id_col, group), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other"))
            .withColumn("left", F.col("_own") <= F.col("_other")).drop("_blocks", "_own", "_other"))


def block_rows(sizes: DataFrame, members_col: str, most: int) -> int:
    """Rows that ``in_blocks`` makes of groups of these sizes: each member once per block of its group."""
    n = F.col(members_col)
    return int(sizes.agg(F.sum(n * F.greatest(F.ceil(n / most), F.lit(1)))).first()[0] or 0)

"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import forget, staged


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Label every node of ``edges(a, b)`` with its component: ``(node, label)``.

    Each round hooks a node to the smallest of its neighbours and follows the
    pointers to their roots, doubling the steps, then replaces the edges by
    those between the roots: at least half of the linked nodes are gone after
    it.  Minima are pre-aggregated on the map side, so a hub costs one row per
    task.  Nulls and self-loops are ignored; an empty table gives an empty
    result.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return (
            df.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    live = staged(canonical(edges))
    first = staged(live.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    labels, held = first.withColumn("label", F.col("node")), first  # held: what stands on disk
    for _ in range(max_rounds):
        if live.isEmpty():
            forget(live)
            return labels
        both = live.union(live.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
        jump = staged(parent.select("x", F.least("x", "m").alias("to"), F.lit(True).alias("moved")))
        while True:
            ahead = jump.select(F.col("x").alias("to"), F.col("to").alias("next"))
            step = jump.drop("moved").join(ahead, "to")
            old, jump = jump, staged(step.select("x", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            forget(old)
            if jump.where("moved").isEmpty():
                break
        left = jump.select(F.col("x").alias("a"), F.col("to").alias("ta"))
        right = jump.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b")
        old, live = live, staged(canonical(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
        named = labels.join(jump.select(F.col("x").alias("label"), "to"), "label", "left")
        labels = staged(named.select("node", F.coalesce("to", "label").alias("label")))
        forget(old, jump, held)
        held = labels
    raise RuntimeError("components did not settle")

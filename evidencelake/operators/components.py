"""J-6: connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencelake.scratch import drop_table, join_per_key, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that occurs in ``edges(src, dst)``: columns ``node, component``.

    The component is the smallest node id in it. Each round takes the smallest label among
    the neighbours, then jumps to the label of the label until none is lower, in as many steps as
    the chain's length has digits in base 2. Edges are contracted to the labels after each round, which
    leaves half of the labels or fewer: a finished component leaves no edges, and the loop ends when none are left. Null endpoints and self loops are dropped; repeated
    edges count once; an empty table gives an empty result. A label that many nodes share is joined by
    broadcast (``join_per_key``); a round's tables are removed when the next round's are written.
    """
    clean = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    clean = materialize(clean.distinct(), "pairs")
    live = materialize(clean.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    labels = materialize(clean.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    drop_table(clean)
    rounds = 0
    while rounds < max_rounds:
        both = live.select("src", "dst").union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        jump = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("to")), "jump")
        while True:  # labels of labels, until every node has its hill's lowest
            up = jump.select(F.col("src").alias("to"), F.col("to").alias("lower"))
            low = F.coalesce("lower", "to")
            further = materialize(jump.join(up, "to", "left").select("src", low.alias("to"), (low != F.col("to")).alias("went")), "jump")
            drop_table(jump)
            jump = further
            if jump.where("went").isEmpty():
                break
        old = (labels, live, jump)
        moved = join_per_key(labels, jump.select(F.col("src").alias("component"), "to"), "component")
        labels = materialize(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        a = jump.select(F.col("src"), F.col("to").alias("a"))
        b = jump.select(F.col("src").alias("dst"), F.col("to").alias("b"))
        live = materialize(live.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        for table in old:
            drop_table(table)
        rounds += 1
        if live.isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")

"""Connected components by contraction, with DataFrame operations only (a distributed union-find).

Each round every vertex takes its smallest neighbour's name if that is smaller, looked up twice (pointers are jumped once),
and the edges are contracted: both ends are replaced by their new names, loops and repeats go. A star of any size is gone
after two rounds, a chain shrinks by a constant factor each round; nothing is gathered in the driver but how many edges are left.
Up to ``FEW`` edges are contracted in one partition, where rounds need no shuffle: that takes some 10 MB whatever the input, and
spares many short tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import cut

#: Edges up to which one partition does.
FEW = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the smallest id reachable. Null ends and loops are left out."""
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    left = e.count()
    labels = e.coalesce(1) if left <= FEW else e
    labels = labels.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id"))
    while left:
        e = e.coalesce(1) if left <= FEW else e
        hook = e.groupBy("u").agg(F.min("v").alias("to"))
        jump = hook.select(F.col("u").alias("to"), F.col("to").alias("far"))
        name = hook.join(jump, "to", "left").select(F.col("u").alias("old"), F.coalesce("far", "to").alias("new"))
        labels = labels.join(name, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
        ends = e.join(name.select(F.col("old").alias("u"), F.col("new").alias("x")), "u").join(name.select(F.col("old").alias("v"), F.col("new").alias("y")), "v", "left")
        ends = ends.select("x", F.coalesce("y", "v").alias("y")).where("x <> y")
        e = cut(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
        left = e.count()
    return cut(labels)

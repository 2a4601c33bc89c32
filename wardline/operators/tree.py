"""Hierarchies: parents, depth, subtree sums and descendants by pointer doubling, and the order of siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.lineage import cut


def rollup(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, value; ids are unique): depth, subtree value and number of descendants. A node whose parent is null or
    unknown is a root; nodes that no root reaches are left out. Each round doubles the distance that a node's pointer spans, so there
    are as many joins as the depth has binary digits, and no ancestor pairs are made."""
    known = nodes.select(F.col("id").alias("parent"))
    roots = nodes.join(known, "parent", "left_anti").withColumn("jump", F.lit(None).cast(nodes.schema["id"].dataType))
    inner = nodes.join(known, "parent", "left_semi").withColumn("jump", F.col("parent"))
    step = F.when(F.col("jump").isNull(), 0).otherwise(1)
    state = cut(roots.unionByName(inner).select("id", "jump", step.alias("depth"), F.col("value").alias("subtree"), F.lit(0).cast("long").alias("descendants")))
    total, span = state.count(), 1
    while span <= total and state.where("jump is not null").limit(1).count():
        below = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("subtree").alias("more"), F.sum(F.col("descendants") + 1).alias("count"))
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("further"))
        state = cut(
            state.join(below, "id", "left").join(above, "jump", "left").select(
                "id", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), (F.col("subtree") + F.coalesce("more", F.lit(0))).alias("subtree"), (F.col("descendants") + F.coalesce("count", F.lit(0))).alias("descendants")
            )
        )
        span *= 2
    return state.where("jump is null").drop("jump")


def parents(processes: DataFrame) -> DataFrame:
    """``parent``: null for pid 0, its own parent, an unknown one, or one that started later."""
    p = processes.select(F.col("pid").alias("_p"), F.col("started").alias("_s"))
    ok = (F.col("ppid") == F.col("_p")) & (F.col("pid") != 0) & (F.col("pid") != F.col("_p")) & ((F.col("_s") == 0) | (F.col("started") == 0) | (F.col("_s") <= F.col("started")))
    return processes.join(p, ok, "left").withColumn("parent", F.col("_p")).drop("_p", "_s")


def siblings(rows: DataFrame, cpu: str = "subtree_cpu", memory: str = "subtree_memory", pid: str = "pid") -> DataFrame:
    """``place`` of each node among its parent's children: more cpu first, then more memory, then the smaller pid."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc(cpu), F.desc(memory), pid)))

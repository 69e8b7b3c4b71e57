"""Connected components of a link table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``label`` (the smallest node linked with it), for
    each node of ``edges``; nulls and self links are ignored. Each round, nodes
    hook onto their smallest neighbour and the edges between the hooks are kept;
    the tables shrink until no edge is left. Nothing is brought to the driver
    but whether edges remain."""
    spark = edges.sparkSession
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    live, live_path = materialise(live, "edges")
    hooks: list[tuple[DataFrame, str]] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        hook, path = materialise(hook, "hooks")
        hooks.append((hook, path))
        jump = hook.select(F.col("u").alias("x"), F.col("to").alias("y"))
        left = live.join(jump, F.col("u") == F.col("x")).select(F.col("y").alias("u"), "v")
        new = left.join(jump, F.col("v") == F.col("x")).select("u", F.col("y").alias("v")).where("u <> v").distinct()
        # a node that hooked onto one that hooked onward stays linked with it
        chain = (hook.join(jump, F.col("to") == F.col("x")).where("to <> y")
                 .select(F.col("to").alias("u"), F.col("y").alias("v")))
        old_path = live_path
        live, live_path = materialise(new.union(chain).distinct(), "edges")
        drop_scratch(spark, old_path)
    if not hooks:
        return live.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = hooks[0][0].select(F.col("u").alias("node"), F.col("to").alias("label"))
    for hook, _ in hooks[1:]:
        step = hook.select(F.col("u").alias("x"), "to")
        out = (out.join(step, F.col("label") == F.col("x"), "left")
               .select("node", F.coalesce("to", "label").alias("label")))
    return out

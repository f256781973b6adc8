"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, component) of every node of ``edges``; component is the least id of the node's component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges form stars, so the number
    of rounds grows with the logarithm of the longest path.  Each round is a written table; only two numbers
    per round reach the driver.  Null ends, loops and repeated edges are ignored; nodes that have only loops are
    their own component; an empty edge table gives an empty result; an error where ``max_rounds`` are too few.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    lone = both.where("u = v").select("u").distinct()
    e = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every greater neighbour joins the least neighbour (or the node itself)
        two = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and the node join the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.where("u <> v").distinct(), "star")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == (state["n"], state["h"]):
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError(f"the components are not joined after {max_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    known = stars.unionByName(roots.join(stars.select("id"), "id", "left_anti"))
    return known.unionByName(lone.select(F.col("u").alias("id"), F.col("u").alias("component")).join(known.select("id"), "id", "left_anti"))

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(links: DataFrame) -> DataFrame:
    """(id, comp): for each end of a link the least id that links reach. links: (a, b), in any order and number.

    Large-star and small-star steps in turn, each written to the shared folder. A large star hangs every larger
    neighbour on the least one, a small star every smaller; both reduce a node's links to a minimum first (partial
    aggregation), and few rounds suffice, as paths halve.
    """
    e = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = durable(small)
        settled = small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty()
        release(e, large)
        e = small
        if settled:
            break
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    out = durable(nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    release(e)
    return out

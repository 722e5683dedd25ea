"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum over each vertex' links and a filter, so a vertex with very many is never collected; where one
has HOT_DEGREE or more, the minimum is found and joined in PARTS parts, so no task meets all of them.  The edges are written to the shared folder after each round, and only a few aggregates reach the driver.

Cases: self links and repeated links do not matter; rows with a null end are dropped; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloupe.llm.common import discard, stored


PARTS = 16
#: Links of one vertex from which its minimum is found in parts; a task holds as many without effort.
HOT_DEGREE = 200_000


def _star(edges: DataFrame, large: bool, hot: bool) -> DataFrame:
    """One step over undirected edges (a, b), a > b, returning edges of the same kind."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    if hot:
        both = both.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
        parts = both.groupBy("a", "part").agg(F.min("b").alias("m"))
        low = parts.groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"))
        near = both.join(parts.select("a", "part").join(low, "a"), ["a", "part"]).select("a", "b", "m")
    else:
        near = both.select("a", "b", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")).alias("m"))
    # no unions here: each would double all that is planned below it
    if large:
        out = near.select(F.greatest("a", "b").alias("a"), F.col("m").alias("b"))
    else:  # the smallest link would give a link to itself; the vertex' own stands in its place
        out = near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, label) of every vertex that has an edge; label is the smallest id it reaches."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)  # null ends go here
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        # a vertex has no more links than there are in all
        hot = new[0] >= HOT_DEGREE and now.groupBy("b").count().agg(F.max("count")).first()[0] >= HOT_DEGREE
        last, now = now, stored(_star(_star(now, True, hot), False, hot), name)
        discard(last)
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())

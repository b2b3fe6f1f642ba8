"""Connected components of an edge table by DataFrame joins alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.storage import removed, saved


#: Neighbours from which an id counts as hot, and the number of hot ids (16 bytes each) that are broadcast.
HOT, BROADCAST_ROWS = 500, 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of an edge table (a, b): root is the smallest id of its component.

    Alternating star contraction: large stars hang every larger neighbour on an id's smallest one, small
    stars do so with the smaller neighbours and the id itself; when nothing changes, every id hangs on its
    component's smallest. The number of rounds grows with the logarithm of the longest path; edges never
    become more. Lineage ends in the shared folder after each round, so lost executors cost one round at most.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = saved(now, "edges")
    before = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "v"), "least")
        # large star: u > v hangs on v's smallest neighbour; the edges of a v with many of them stay where they are
        hot = least.where(F.col("n") > HOT).drop("n")
        if before[0] // HOT <= BROADCAST_ROWS:  # each of them has more than HOT edges; beyond, Spark splits the join's large keys
            hot = F.broadcast(hot)
        star = now.select(F.col("b").alias("v"), F.col("a").alias("u"))
        cold = star.join(hot, "v", "left_anti").join(least.where(F.col("n") <= HOT).drop("n"), "v")
        large = star.join(hot, "v").unionByName(cold).select(F.col("u").alias("a"), F.col("root").alias("b"))
        # small star: v and its smaller neighbours hang on the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("root").alias("b")), F.struct(F.col("a"), F.col("root").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small, next_path = saved(small, "edges")
        after = _digest(small)
        removed(spark, path, least_path)
        now, path = small, next_path
        if after == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = after


def _digest(edges: DataFrame) -> tuple:
    """Tells if two rounds' edges are the same."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())

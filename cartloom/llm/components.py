"""Connected components of records that share a key, by alternating large and small stars.

Every key links its records to the smallest record that has it, so a key of n records makes n edges, never
n^2. All rounds keep their edges in the shared folder; nothing is gathered on the driver but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cartloom.session import cut, discard


def tie_edges(keys: DataFrame) -> DataFrame:
    """(node, key) -> (src, dst) with src > dst = the key's smallest node. Null keys tie nothing."""
    keys = keys.where("key is not null and node is not null").distinct()
    first = keys.groupBy("key").agg(F.min("node").alias("dst"))
    return keys.join(first, "key").where("node > dst").select(F.col("node").alias("src"), "dst").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges in the shared folder, with their number and a hash of them, taken while they are written."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(src, dst))").alias("h")))
    return out, dict(seen.get)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it is connected to.

    edges: (src, dst), src > dst. Nodes without an edge do not appear: they are their own component.
    """
    now, before = _kept(edges)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # read twice below, from one exchange: Spark runs equal stages of a plan once
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        then, after = _kept(small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct())
        discard(now)
        now, same, before = then, after == before, after
        if same:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def with_component(records: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """records plus `component` (replaced if there). keys: columns whose equal values tie records; null ties nothing.

    A record whose node is null is tied to nothing and has a null component. Rows that repeat a node are tied by it.
    """
    records = records.drop("component")
    pairs = records.select(F.col(node).alias("node"), F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])).alias("key"))
    found = components(tie_edges(pairs))
    return records.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", F.col(node)))

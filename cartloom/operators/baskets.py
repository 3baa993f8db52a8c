"""Basket histories, item neighbours, recommenders as long tables (user, product, score, rank), and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, order: list[Column], user: str = "user_id") -> DataFrame:
    """scored plus rank, the first k per user. The order should end in a unique column."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("rank") <= k)


def popularity(lines: DataFrame) -> DataFrame:
    """(product_id, support): distinct baskets. lines are distinct (order_id, product_id) rows."""
    return lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("support"))


def neighbours(lines: DataFrame, least: int = 10, shrink: float = 20.0, top: int = 50) -> DataFrame:
    """(product_id, neighbour, n_both, lift, rank): shrunk lift of items bought together in at least `least` baskets.

    Items in fewer baskets are dropped before the self-join (no such pair is lost), pairs are made once (a < b) and mirrored.
    """
    n = lines.select("order_id").distinct().count()
    support = popularity(lines).where(F.col("support") >= least)
    kept = lines.join(support.select("product_id"), "product_id", "left_semi")
    pairs = kept.select("order_id", F.col("product_id").alias("a")).join(kept.select("order_id", F.col("product_id").alias("b")), "order_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least)
    pairs = pairs.join(support.select(F.col("product_id").alias("a"), F.col("support").alias("na")), "a").join(support.select(F.col("product_id").alias("b"), F.col("support").alias("nb")), "b")
    lift = F.col("n_both") * F.lit(float(n)) / (F.col("na") * F.col("nb")) * F.col("n_both") / (F.col("n_both") + F.lit(shrink))
    both = pairs.withColumn("lift", lift).select(F.explode(F.array(F.struct(F.col("a").alias("product_id"), F.col("b").alias("neighbour"), "n_both", "lift"), F.struct(F.col("b").alias("product_id"), F.col("a").alias("neighbour"), "n_both", "lift"))).alias("p")).select("p.*")
    return top_k(both, top, [F.desc(F.round("lift", 9)), F.col("neighbour")], "product_id")


def from_popularity(users: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """The k most popular products for every user: a literal of k rows, not a cross join."""
    best = [r[0] for r in support.orderBy(F.desc("support"), "product_id").limit(k).select("product_id").collect()]
    if not best:
        return users.select("user_id", F.lit(None).cast("int").alias("product_id"), F.lit(0).alias("rank")).where(F.lit(False))
    listed = F.posexplode(F.array(*[F.lit(p) for p in best])).alias("at", "product_id")
    return users.select("user_id", listed).select("user_id", "product_id", (F.col("at") + 1).alias("rank"))


def backfilled(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The k best of `first`, filled up from `second` (user_id, product_id, rank) with products that `first` does not have."""
    rest = second.join(first.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti").withColumn("tier", F.lit(2))
    both = first.select("user_id", "product_id", "rank").withColumn("tier", F.lit(1)).unionByName(rest.select("user_id", "product_id", "rank", "tier"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("tier", "rank", "product_id"))
    return both.withColumn("place", place).where(F.col("place") <= k).select("user_id", "product_id", F.col("place").alias("rank"), "tier")


def ranking_metrics(listed: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, precision, recall, hit, ndcg, ap, f1) at k for every user with a truth; users without a list get zeros.

    precision divides by the length of the list, not by k.
    """
    marks = listed.where(F.col("rank") <= k).join(truth.withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left").na.fill(0, ["hit"])
    running = F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank"))
    marks = marks.withColumn("found", running)
    per = marks.groupBy("user_id").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("length"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("hit") * F.col("found") / F.col("rank")).alias("precisions"))
    rows = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("wanted")).join(per, "user_id", "left").na.fill(0)
    few = F.least("wanted", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), few.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    hits = F.col("hits")
    return rows.select("user_id", ratio(hits, F.col("length")).alias("precision"), ratio(hits, F.col("wanted")).alias("recall"), (hits > 0).cast("double").alias("hit"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("precisions") / few).alias("ap"), ratio(2 * hits, F.col("length") + F.col("wanted")).alias("f1"))

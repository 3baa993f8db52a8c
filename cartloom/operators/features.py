"""Feature tables: what is known of an order when it is placed, and of its seller, lane and destination before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators import windows as W
from cartloom.session import cut


def product_features(items: DataFrame, products: DataFrame) -> DataFrame:
    """(order_id, weight_g, volume_cm3, mean_weight_g, mean_length_cm, mean_height_cm, mean_width_cm, n_categories) of the products of each order's items.

    items: (order_id, product_id); products: (product_id, category, weight_g, length_cm, height_cm, width_cm), a row per product. A
    product that is missing or has no measure adds nothing; an order none of whose products has one has nulls, and 0 categories.
    """
    both = items.select("order_id", "product_id").join(products, "product_id", "left")
    volume = F.col("length_cm") * F.col("height_cm") * F.col("width_cm")
    means = [F.avg(f"{c}").alias(f"mean_{c}") for c in ("weight_g", "length_cm", "height_cm", "width_cm")]
    return both.groupBy("order_id").agg(F.sum("weight_g").alias("weight_g"), F.sum(volume).alias("volume_cm3"), *means, F.countDistinct("category").alias("n_categories"))


def seller_frames(df: DataFrame, cuts: DataFrame, key: str, at: str, tie: str, late: str, days: str) -> DataFrame:
    """df plus late_30d, late_90d, days_30d (shifted trailing means), late_30 (of the last 30 rows, with 3 at least) and load_7d of each row's key.

    `tie` tells a row. A key that one task can hold takes the windows; the others take running sums and joins by place.
    """

    def plain(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_us", W.micros(at))
        out = W.shifted_trailing_mean(rows, [key], "_us", tie, late, 30, "late_30d")
        out = W.shifted_trailing_mean(out, [key], "_us", tie, late, 90, "late_90d")
        out = W.shifted_trailing_mean(out, [key], "_us", tie, days, 30, "days_30d")
        out = out.withColumn("late_30", W.prior_rows(F.avg(late), [key], ["_us", tie], 30, 3)).withColumn("load_7d", W.trailing_load([key], "_us", tie, 7))
        return out.drop("_us").select(*df.columns, "late_30d", "late_90d", "days_30d", "late_30", F.col("load_7d").cast("bigint").alias("load_7d"))

    def split(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        frame = lambda value, span: cut(W.split_trailing(rows.select(tie, key, at, value), key, at, tie, value, 30, 3, span, 7))
        short = frame(late, 30).select(tie, F.col("mean_rows").alias("late_30"), F.col("mean_days").alias("late_30d"), F.col("load").cast("bigint").alias("load_7d"))
        long = frame(late, 90).select(tie, F.col("mean_days").alias("late_90d"))
        out = rows.join(short, tie).join(long, tie).join(frame(days, 30).select(tie, F.col("mean_days").alias("days_30d")), tie)
        return out.select(*df.columns, "late_30d", "late_90d", "days_30d", "late_30", "load_7d")

    return W.by_weight(df, key, cuts, plain, split)

"""The tables of a data folder, their records, and the schemas they must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id, one_record

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "olist_orders_dataset olist_order_items_dataset olist_order_payments_dataset olist_customers_dataset "
    "olist_sellers_dataset olist_geolocation_dataset seller_history prediction_log order_products__prior "
    "basket_orders user_partitions split_assignments mix_targets"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def as_views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def item_records(spark: SparkSession, folder: str, carry: list[str]) -> DataFrame:
    """One row per (order_id, order_item_id) of the items, ids cleaned."""
    items = table(spark, folder, "olist_order_items_dataset").withColumn("order_id", clean_id("order_id"))
    if "seller_id" in carry:
        items = items.withColumn("seller_id", clean_id("seller_id"))
    return one_record(items, ["order_id", "order_item_id"], carry)


def purchase_times(spark: SparkSession, folder: str) -> DataFrame:
    """order_id (cleaned), purchased_at: one row per order that has a purchase time."""
    orders = table(spark, folder, "olist_orders_dataset")
    return (
        orders.select(clean_id("order_id").alias("order_id"), F.col("order_purchase_timestamp").cast("timestamp").alias("purchased_at"))
        .where("order_id is not null and purchased_at is not null")
        .groupBy("order_id").agg(F.min("purchased_at").alias("purchased_at"))
    )

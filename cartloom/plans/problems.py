"""Queries p2, p3, p4 and p6 over the marketplace and basket tables, with the SQL they are compared with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id, one_record, zip_code
from cartloom.operators.asof import as_known, changes_in_force
from cartloom.operators.heavykeys import heavy_keys, per_key_stats
from cartloom.operators.orphans import key_runs, orphan_references
from cartloom.operators.rolling import daily_amounts, trailing
from cartloom.session import cut
from cartloom.sources.tables import item_records, purchase_times, table

LAST_DAY = dt.date(2022, 12, 31)
HEAVY_SHARE = 0.02
ATTRIBUTES = ["seller_tier", "handoff_days", "seller_state"]


def seller_stats(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "olist_order_items_dataset").select(clean_id("seller_id").alias("seller_id"), clean_id("order_id").alias("order_id"), "order_item_id", "price", "freight_value")
    return per_key_stats(items, "seller_id", "order_id", {"price": "price", "freight": "freight_value"}, record=["order_item_id"])


def product_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "order_products__prior").select("product_id", "order_id", "reordered")
    return per_key_stats(rows, "product_id", "order_id", {"reordered": "reordered"}, record=[])


def p2_sellers(spark: SparkSession, d: str) -> DataFrame:
    return seller_stats(spark, d).select("seller_id", "n_records", "n_entities", F.round("price", 2).alias("price"), F.round("freight", 2).alias("freight"))


def p2_products(spark: SparkSession, d: str) -> DataFrame:
    return product_stats(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, stats, key in (("olist_order_items_dataset", seller_stats, "seller_id"), ("order_products__prior", product_stats, "product_id")):
        rows = heavy_keys(cut(stats(spark, d).select(key, "n_records")), key, HEAVY_SHARE).select(F.lit(name).alias("table_name"), "key_value")
        out = rows if out is None else out.unionByName(rows)
    return out


def seller_changes(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "seller_history").withColumn("seller_id", clean_id("seller_id"))
    return changes_in_force(history, "seller_id", "valid_from", "recorded_at", "history_id", ATTRIBUTES)


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item of an order with a purchase time, with its seller's attributes as known then."""
    items = item_records(spark, d, ["seller_id"]).join(purchase_times(spark, d), "order_id")
    return as_known(items, "seller_id", "purchased_at", seller_changes(spark, d), ATTRIBUTES).drop("version_number")


def iso_time(col: str):
    """ISO text in any notation as an instant; no zone means UTC; what can't be read is null."""
    return F.expr(f"try_cast({col} AS timestamp)")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "prediction_log").select("prediction_id", clean_id("seller_id").alias("seller_id"), iso_time("features_as_of").alias("features_as_of"), "raw_features")
    return one_record(log, ["prediction_id"], ["seller_id", "features_as_of", "raw_features"])


def p3_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every prediction with its seller's attributes as known at features_as_of."""
    return as_known(predictions(spark, d).drop("raw_features"), "seller_id", "features_as_of", seller_changes(spark, d), ATTRIBUTES).drop("version_number")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    judged = cut(predictions(spark, d).where("features_as_of is not null and raw_features is not null"))
    known = as_known(judged, "seller_id", "features_as_of", seller_changes(spark, d), ATTRIBUTES, key=["prediction_id"])
    same = F.lit(True)
    for a in ATTRIBUTES:
        same = same & F.col(a).eqNullSafe(F.col(f"raw_features.{a}"))
    return known.where((F.col("version_number") == 0) | ~same).select("prediction_id").distinct()


def seller_days(spark: SparkSession, d: str) -> DataFrame:
    items = item_records(spark, d, ["seller_id", "price"]).where("seller_id is not null")
    sold = items.join(purchase_times(spark, d), "order_id").select("seller_id", F.to_date("purchased_at").alias("day"), "price")
    return trailing(daily_amounts(sold, "seller_id", "day", "price"), [7, 30], LAST_DAY)


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    rows = seller_days(spark, d)
    return rows.select(F.col("entity").alias("seller_id"), F.col("day").alias("sale_day"), "items_7", F.round("total_7", 2).alias("total_7"), F.round("avg_7", 8).alias("avg_7"), "items_30", F.round("total_30", 2).alias("total_30"), F.round("avg_30", 8).alias("avg_30"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = seller_days(spark, d).where((F.col("items_7") >= 5) & (F.col("items_7") == F.col("items_30")) & (F.col("first_day") <= F.date_sub("day", 30)))
    return rows.select(F.col("entity").alias("seller_id"), F.date_format("day", "yyyy-MM-dd").alias("sale_day"))


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """child_table, child_key, period, reason: one row per delivered row that refers to nothing."""
    order_of = table(spark, d, "olist_orders_dataset").select(clean_id("order_id").alias("k"), "loaded_at", "deleted_at")
    place_of = table(spark, d, "olist_geolocation_dataset").select(zip_code("geolocation_zip_code_prefix").alias("k"), "loaded_at")
    out = []
    for parents, deleted, refs in (
        (order_of, F.col("deleted_at"), [(n, clean_id("order_id"), clean_id("order_id")) for n in ("olist_order_items_dataset", "olist_order_payments_dataset")]),
        (place_of, None, [("olist_customers_dataset", zip_code("customer_zip_code_prefix"), F.col("customer_id")), ("olist_sellers_dataset", zip_code("seller_zip_code_prefix"), F.col("seller_id"))]),
    ):
        children = None
        for name, ref, key in refs:
            rows = table(spark, d, name).select(F.lit(name).alias("child_table"), key.alias("child_key"), ref.alias("ref"), "loaded_at")
            children = rows if children is None else children.unionByName(rows)
        out.append(orphan_references(children, parents, F.col("ref"), F.col("loaded_at"), F.col("k"), F.col("loaded_at"), deleted, ["child_table", "child_key", "loaded_at"]))
    return out[0].unionByName(out[1]).select("child_table", "child_key", F.date_format("loaded_at", "yyyy-MM").alias("period"), "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Delivered rows and distinct child keys per table, month and reason."""
    return orphan_rows(spark, d).groupBy("child_table", "period", "reason", "child_key").agg(F.count(F.lit(1)).alias("n")).groupBy("child_table", "period", "reason").agg(F.sum("n").alias("n_rows"), F.count("child_key").alias("n_keys"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """How far the sorted keys of each parent table are compressed into contiguous runs."""
    orders = key_runs(table(spark, d, "olist_orders_dataset"), clean_id("order_id")).select(F.lit("olist_orders_dataset").alias("parent_table"), "n_keys", "n_runs")
    places = key_runs(table(spark, d, "olist_geolocation_dataset"), zip_code("geolocation_zip_code_prefix"))
    return orders.unionByName(places.select(F.lit("olist_geolocation_dataset").alias("parent_table"), "n_keys", "n_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(spark, d).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_sellers, p2_products, p3_found, p3_items, p3_predictions, p4_found, p4_days, p6_found, p6_report, p6_runs)}

_ITEMS = """items AS (SELECT nullif(lower(trim(order_id)), '') AS order_id, order_item_id, any_value(nullif(lower(trim(seller_id)), '')) AS seller_id,
  any_value(price) AS price, any_value(freight_value) AS freight_value FROM olist_order_items_dataset GROUP BY 1, 2)"""
_PURCHASES = """purchases AS (SELECT lower(trim(order_id)) AS order_id, min(order_purchase_timestamp) AS moment FROM olist_orders_dataset
  WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1)"""
_SELLERS = f"""WITH {_ITEMS} SELECT seller_id, count(*) AS n_records, count(DISTINCT order_id) AS n_entities, round(sum(price), 2) AS price,
  round(sum(freight_value), 2) AS freight FROM items WHERE seller_id IS NOT NULL GROUP BY 1"""
_PRODUCTS = """SELECT product_id, count(*) AS n_records, count(DISTINCT order_id) AS n_entities, CAST(sum(reordered) AS BIGINT) AS reordered
  FROM (SELECT order_id, product_id, any_value(reordered) AS reordered FROM order_products__prior WHERE product_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
_IN_FORCE = """SELECT e.*, (SELECT struct_pack(t := h.seller_tier, d := h.handoff_days, s := h.seller_state) FROM seller_history h
  WHERE lower(trim(h.seller_id)) = e.seller_id AND h.valid_from <= e.moment AND h.recorded_at <= e.moment
  ORDER BY h.valid_from DESC, h.recorded_at DESC, h.history_id DESC LIMIT 1) AS a FROM e"""
_PREDICTIONS = """e AS (SELECT DISTINCT prediction_id, lower(trim(seller_id)) AS seller_id, CAST(CAST(CASE WHEN regexp_matches(features_as_of, '(Z|[+-][0-9]{2}:[0-9]{2})$')
  THEN features_as_of ELSE features_as_of || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS moment, raw_features AS r FROM prediction_log)"""
_DAYS = f"""WITH {_ITEMS}, {_PURCHASES},
  daily AS (SELECT seller_id, CAST(moment AS DATE) AS day, count(*) AS n, count(price) AS p, sum(price) AS s FROM items JOIN purchases USING (order_id) WHERE seller_id IS NOT NULL GROUP BY 1, 2),
  grid AS (SELECT seller_id, first_day, CAST(unnest(generate_series(first_day, DATE '2022-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT seller_id, min(day) AS first_day FROM daily GROUP BY 1)),
  full_days AS (SELECT g.seller_id, g.first_day, g.day, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM grid g LEFT JOIN daily USING (seller_id, day)),
  t AS (SELECT seller_id, first_day, day, CAST(sum(n) OVER w7 AS BIGINT) AS items_7, sum(s) OVER w7 AS s7, sum(p) OVER w7 AS p7, CAST(sum(n) OVER w30 AS BIGINT) AS items_30, sum(s) OVER w30 AS s30, sum(p) OVER w30 AS p30 FROM full_days
    WINDOW w7 AS (PARTITION BY seller_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY seller_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_ORPHANS = """WITH o AS (SELECT lower(trim(order_id)) AS k, min(loaded_at) AS first, min(deleted_at) AS gone FROM olist_orders_dataset GROUP BY 1),
  g AS (SELECT lpad(trim(geolocation_zip_code_prefix), 5, '0') AS k, min(loaded_at) AS first FROM olist_geolocation_dataset GROUP BY 1),
  c AS (SELECT 'olist_order_items_dataset' AS child_table, lower(trim(order_id)) AS ref, lower(trim(order_id)) AS child_key, loaded_at AS moment FROM olist_order_items_dataset
    UNION ALL SELECT 'olist_order_payments_dataset', lower(trim(order_id)), lower(trim(order_id)), loaded_at FROM olist_order_payments_dataset),
  z AS (SELECT 'olist_customers_dataset' AS child_table, trim(customer_zip_code_prefix) AS ref, customer_id AS child_key, loaded_at AS moment FROM olist_customers_dataset
    UNION ALL SELECT 'olist_sellers_dataset', trim(seller_zip_code_prefix), seller_id, loaded_at FROM olist_sellers_dataset),
  f AS (SELECT child_table, child_key, moment, CASE WHEN o.k IS NULL THEN 'missing' WHEN o.first > moment THEN 'late' WHEN o.gone <= moment THEN 'deleted' END AS reason FROM c LEFT JOIN o ON c.ref = o.k WHERE c.ref <> ''
    UNION ALL SELECT child_table, child_key, moment, CASE WHEN g.k IS NULL THEN 'missing' WHEN g.first > moment THEN 'late' END FROM z LEFT JOIN g ON lpad(z.ref, 5, '0') = g.k WHERE z.ref <> '')"""

SQL = {
    "p2_sellers": _SELLERS,
    "p2_products": _PRODUCTS,
    "p2_found": f"""WITH s AS ({_SELLERS}), p AS ({_PRODUCTS})
      SELECT 'olist_order_items_dataset' AS table_name, seller_id AS key_value FROM s WHERE n_records >= 0.02 * (SELECT sum(n_records) FROM s)
      UNION ALL SELECT 'order_products__prior', CAST(product_id AS VARCHAR) FROM p WHERE n_records >= 0.02 * (SELECT sum(n_records) FROM p)""",
    "p3_found": f"""WITH {_PREDICTIONS}, f AS ({_IN_FORCE}) SELECT DISTINCT prediction_id FROM f WHERE moment IS NOT NULL AND r IS NOT NULL
      AND (a IS NULL OR a.t IS DISTINCT FROM r.seller_tier OR a.d IS DISTINCT FROM r.handoff_days OR a.s IS DISTINCT FROM r.seller_state)""",
    "p3_items": f"""WITH {_ITEMS}, {_PURCHASES}, e AS (SELECT order_id, order_item_id, seller_id, moment FROM items JOIN purchases USING (order_id)), f AS ({_IN_FORCE})
      SELECT order_id, order_item_id, seller_id, moment AS purchased_at, a.t AS seller_tier, a.d AS handoff_days, a.s AS seller_state FROM f""",
    "p3_predictions": f"""WITH {_PREDICTIONS}, f AS ({_IN_FORCE}) SELECT DISTINCT prediction_id, seller_id, moment AS features_as_of, a.t AS seller_tier, a.d AS handoff_days, a.s AS seller_state FROM f""",
    "p4_found": f"""{_DAYS} SELECT seller_id, strftime(day, '%Y-%m-%d') AS sale_day FROM t WHERE items_7 >= 5 AND items_7 = items_30 AND first_day <= day - INTERVAL 30 DAY""",
    "p4_days": f"""{_DAYS} SELECT seller_id, day AS sale_day, items_7, round(s7, 2) AS total_7, round(CASE WHEN p7 > 0 THEN round(s7, 4) / p7 END, 8) AS avg_7,
      items_30, round(s30, 2) AS total_30, round(CASE WHEN p30 > 0 THEN round(s30, 4) / p30 END, 8) AS avg_30 FROM t""",
    "p6_found": f"{_ORPHANS} SELECT DISTINCT child_table, child_key, strftime(moment, '%Y-%m') AS period, reason FROM f WHERE reason IS NOT NULL",
    "p6_report": f"{_ORPHANS} SELECT child_table, strftime(moment, '%Y-%m') AS period, reason, count(*) AS n_rows, count(DISTINCT child_key) AS n_keys FROM f WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}

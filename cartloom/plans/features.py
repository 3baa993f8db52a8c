"""Composed feature tables (FQ02, FQ04 to FQ06, FQ08) over the marketplace tables.

The marketplace data has no table of products, so weights, volumes and categories are not in these queries: they come from
`product_features` and are joined by order_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions.keys import clean_id, one_record, zip_code
from cartloom.operators import windows as W
from cartloom.operators.features import seller_frames
from cartloom.plans.pipelines import _CENTRE, centroids
from cartloom.plans.registry import Registry
from cartloom.plans.relational import ITEMS, ORDERS, PAYMENTS, items, orders, payments
from cartloom.session import cut
from cartloom.sources.tables import table

R = Registry()
NONE = -1.0


def N():
    return F.count(F.lit(1))


_ELIGIBLE = "status = 'delivered' AND approved IS NOT NULL AND bought IS NOT NULL AND delivered IS NOT NULL AND due IS NOT NULL AND approved >= bought AND delivered >= bought AND due >= approved AND (shipped IS NULL OR shipped >= approved) AND (shipped IS NULL OR delivered >= shipped)"


@R.query(f"""WITH {ORDERS}, {ITEMS}, {PAYMENTS}, pay AS (SELECT order_id, count(*) AS payment_record_count, max(installments) AS max_payment_installments, round(sum(value), 2) AS total_payment_value FROM p GROUP BY 1),
  a AS (SELECT order_id, count(*) AS item_count, count(DISTINCT product_id) AS unique_product_count, count(DISTINCT seller_id) AS unique_seller_count, round(sum(price), 2) AS total_item_price, round(sum(freight), 2) AS total_freight_value, round(avg(freight), 6) AS mean_freight_value, max(freight) AS max_freight_value FROM i GROUP BY 1)
  SELECT o.order_id, approved AS approved_at, CAST(delivered > due AS INT) AS late_delivery, year(bought) AS purchase_year, month(bought) AS purchase_month, dayofweek(bought) AS purchase_day_of_week, hour(bought) AS purchase_hour, year(approved) AS approval_year, month(approved) AS approval_month, dayofweek(approved) AS approval_day_of_week, hour(approved) AS approval_hour,
    date_diff('second', bought, approved) AS purchase_to_approval_seconds, pay.* EXCLUDE (order_id), a.* EXCLUDE (order_id) FROM o LEFT JOIN pay USING (order_id) LEFT JOIN a USING (order_id) WHERE {_ELIGIBLE}""")
def fq02_expanded(spark, d):
    """The nine strict features and the expanded ones of payments and items, which are aggregated before they are joined."""
    pay = payments(spark, d).groupBy("order_id").agg(N().alias("payment_record_count"), F.max("installments").alias("max_payment_installments"), F.round(F.sum("value"), 2).alias("total_payment_value"))
    a = items(spark, d).groupBy("order_id").agg(
        N().alias("item_count"), F.countDistinct("product_id").alias("unique_product_count"), F.countDistinct("seller_id").alias("unique_seller_count"), F.round(F.sum("price"), 2).alias("total_item_price"),
        F.round(F.sum("freight"), 2).alias("total_freight_value"), F.round(F.avg("freight"), 6).alias("mean_freight_value"), F.max("freight").alias("max_freight_value"),
    )
    calendar = [f(c).alias(f"{name}_{part}") for name, c in (("purchase", "bought"), ("approval", "approved")) for part, f in (("year", F.year), ("month", F.month), ("day_of_week", S.sunday_weekday), ("hour", F.hour))]
    o = orders(spark, d).where(_ELIGIBLE).select("order_id", F.col("approved").alias("approved_at"), (F.col("delivered") > F.col("due")).cast("int").alias("late_delivery"), *calendar, S.seconds_between("bought", "approved").alias("purchase_to_approval_seconds"))
    return o.join(pay, "order_id", "left").join(a, "order_id", "left")


_PLACES = f"""{_CENTRE}, c AS (SELECT customer_id, any_value(customer_unique_id) AS person, any_value(lpad(nullif(trim(customer_zip_code_prefix), ''), 5, '0')) AS zip, any_value(customer_state) AS customer_state FROM olist_customers_dataset GROUP BY 1),
  s AS (SELECT lower(trim(seller_id)) AS seller_id, any_value(lpad(nullif(trim(seller_zip_code_prefix), ''), 5, '0')) AS zip, any_value(seller_state) AS seller_state FROM olist_sellers_dataset GROUP BY 1)"""
_KM = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


def customers(spark, d):
    rows = one_record(table(spark, d, "olist_customers_dataset"), ["customer_id"], ["customer_unique_id", "customer_zip_code_prefix", "customer_state"])
    return rows.select("customer_id", F.col("customer_unique_id").alias("person"), zip_code("customer_zip_code_prefix").alias("zip_c"), "customer_state")


def sellers(spark, d):
    rows = one_record(table(spark, d, "olist_sellers_dataset").withColumn("seller_id", clean_id("seller_id")), ["seller_id"], ["seller_zip_code_prefix", "seller_state"])
    return rows.select(F.col("seller_id").alias("seller"), zip_code("seller_zip_code_prefix").alias("zip_s"), "seller_state")


def with_places(rows: DataFrame, spark, d) -> DataFrame:
    """rows (customer_id, seller) plus person, states, coordinates of both sides (lat_c, lng_c, lat_s, lng_s) and distance_km."""
    z = centroids(spark, d)
    at = lambda side: z.select(F.col("zip").alias(f"zip_{side}"), F.col("lat").alias(f"lat_{side}"), F.col("lng").alias(f"lng_{side}"))
    rows = rows.join(customers(spark, d), "customer_id", "left").join(sellers(spark, d), "seller", "left").join(at("c"), "zip_c", "left").join(at("s"), "zip_s", "left")
    return rows.withColumn("distance_km", S.haversine_km(F.col("lat_c"), F.col("lng_c"), F.col("lat_s"), F.col("lng_s"))).drop("zip_c", "zip_s")


def by_order(spark, d):
    """The items of each order: first seller, number of sellers and products, price, freight."""
    return items(spark, d).withColumn("seller_id", clean_id("seller_id")).groupBy("order_id").agg(
        F.min_by("seller_id", F.when(F.col("seller_id").isNotNull(), F.col("order_item_id"))).alias("seller"), F.countDistinct("seller_id").alias("n_sellers"), F.countDistinct("deadline").alias("n_deadlines"), F.min("deadline").alias("deadline"),
        N().alias("n_items"), F.countDistinct("product_id").alias("n_products"), F.sum("price").alias("price"), F.sum("freight").alias("freight"), F.avg("price").alias("price_mean"), F.max("price").alias("price_max"), F.stddev_samp("price").alias("price_std"), F.avg("freight").alias("freight_mean"),
    )


_BY_ORDER = "g AS (SELECT order_id, arg_min(seller_id, order_item_id) FILTER (WHERE seller_id IS NOT NULL) AS seller, count(DISTINCT seller_id) AS n_sellers, count(DISTINCT deadline) AS n_deadlines, min(deadline) AS deadline, count(*) AS n_items, count(DISTINCT product_id) AS n_products, sum(price) AS price, sum(freight) AS freight, avg(price) AS price_mean, max(price) AS price_max, stddev_samp(price) AS price_std, avg(freight) AS freight_mean FROM (SELECT * REPLACE (nullif(lower(trim(seller_id)), '') AS seller_id) FROM i) GROUP BY 1)"
_BEFORE = "(PARTITION BY {k} ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@R.query(f"""WITH {ORDERS}, {ITEMS}, {_PLACES}, {_BY_ORDER}, k AS (SELECT order_id AS id, seller, bought AS ts, CAST(delivered > due AS INT) AS late, date_diff('second', due, delivered) AS delay, seller_state, customer_state, coalesce(seller_state, '') || '->' || coalesce(customer_state, '') AS lane, {_KM} AS km, price, freight, n_sellers, (epoch_us(due) - epoch_us(bought)) / 86400000000.0::DOUBLE AS promise
    FROM o JOIN g USING (order_id) LEFT JOIN c USING (customer_id) LEFT JOIN s ON s.seller_id = g.seller LEFT JOIN z a ON a.zip = c.zip LEFT JOIN z b ON b.zip = s.zip WHERE bought IS NOT NULL AND delivered IS NOT NULL AND due IS NOT NULL AND seller IS NOT NULL)
  SELECT id, late, row_number() OVER (PARTITION BY seller ORDER BY ts, id) - 1 AS seller_n, round(avg(late) OVER s1, 8) AS seller_late, round(avg(delay) OVER s1 / 86400, 8) AS seller_delay, round(stddev_samp(delay) OVER s1 / 86400, 4) AS seller_delay_std, round(CASE WHEN count(*) OVER r >= 3 THEN avg(late) OVER r END, 8) AS seller_late_30,
    row_number() OVER (PARTITION BY lane ORDER BY ts, id) - 1 AS lane_n, round(avg(late) OVER l1, 8) AS lane_late, round(avg(delay) OVER l1 / 86400, 8) AS lane_delay, row_number() OVER (PARTITION BY coalesce(customer_state, '') ORDER BY ts, id) - 1 AS dest_n, round(avg(late) OVER d1, 8) AS dest_late,
    round(km, 4) AS distance_km, CAST(coalesce(customer_state = seller_state, false) AS INT) AS same_state, round(freight / greatest(price, 1e-6), 6) AS freight_ratio, CAST(n_sellers > 1 AS INT) AS several_sellers, hour(ts) AS purchase_hour, isodow(ts) - 1 AS purchase_weekday, month(ts) AS purchase_month, weekofyear(ts) AS purchase_week, CAST(month(ts) = 11 AS INT) AS is_november,
    round(promise, 8) AS promise_days, round(km * promise, 4) AS distance_x_promise FROM k WINDOW s1 AS {_BEFORE.format(k="seller")}, l1 AS {_BEFORE.format(k="lane")}, d1 AS {_BEFORE.format(k="coalesce(customer_state, '')")}, r AS (PARTITION BY seller ORDER BY ts, id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def fq04_causal_history(spark, d):
    """History of each order's seller, lane and destination before it, with what the order itself tells. Lanes and destinations are few and
    large: all three histories come from running sums that split a key.
    """
    rows = orders(spark, d).where("bought is not null and delivered is not null and due is not null").join(by_order(spark, d).where("seller is not null"), "order_id")
    rows = with_places(rows.withColumnRenamed("order_id", "id").withColumnRenamed("bought", "ts"), spark, d)
    empty = lambda c: F.coalesce(c, F.lit(""))
    rows = cut(rows.select(
        "id", "seller", "ts", (F.col("delivered") > F.col("due")).cast("int").alias("late"), S.seconds_between("due", "delivered").alias("delay"), F.concat(empty("seller_state"), F.lit("->"), empty("customer_state")).alias("lane"), empty("customer_state").alias("dest"),
        "distance_km", F.coalesce(F.col("customer_state") == F.col("seller_state"), F.lit(False)).cast("int").alias("same_state"), "price", "freight", "n_sellers", S.days_between("ts", "due").alias("promise"),
    ))
    frames = rows
    for name, values in (("seller", ["late", "delay"]), ("lane", ["late", "delay"]), ("dest", ["late"])):
        frames = W.prior_stats(frames, name, "ts", "id", values, W.cuts_of(rows, name, "ts")).withColumnsRenamed({"prior_n": f"{name}_n", **{f"{m}_{v}": f"{name}_{m}_{v}" for m in ("mean", "std") for v in values}})
    last = W.by_weight(
        rows.select("id", "seller", "ts", "late"), "seller", W.cuts_of(rows, "seller", "ts"),
        lambda r: r.select("id", W.prior_rows(F.avg("late"), ["seller"], ["ts", "id"], 30, 3).alias("late_30")),
        lambda r: W.split_trailing(r, "seller", "ts", "id", "late", 30, 3, 30, 7).select("id", F.col("mean_rows").alias("late_30")),
    )
    t = F.col("ts")
    return frames.join(last, "id").select(
        "id", "late", F.col("seller_n").cast("bigint").alias("seller_n"), F.round("seller_mean_late", 8).alias("seller_late"), F.round(F.col("seller_mean_delay") / 86400, 8).alias("seller_delay"), F.round(F.col("seller_std_delay") / 86400, 4).alias("seller_delay_std"), F.round("late_30", 8).alias("seller_late_30"),
        F.col("lane_n").cast("bigint").alias("lane_n"), F.round("lane_mean_late", 8).alias("lane_late"), F.round(F.col("lane_mean_delay") / 86400, 8).alias("lane_delay"), F.col("dest_n").cast("bigint").alias("dest_n"), F.round("dest_mean_late", 8).alias("dest_late"),
        F.round("distance_km", 4).alias("distance_km"), "same_state", F.round(F.col("freight") / F.greatest("price", F.lit(1e-6)), 6).alias("freight_ratio"), (F.col("n_sellers") > 1).cast("int").alias("several_sellers"),
        F.hour(t).alias("purchase_hour"), F.weekday(t).alias("purchase_weekday"), F.month(t).alias("purchase_month"), F.weekofyear(t).alias("purchase_week"), (F.month(t) == 11).cast("int").alias("is_november"),
        F.round("promise", 8).alias("promise_days"), F.round(F.col("distance_km") * F.col("promise"), 4).alias("distance_x_promise"),
    )


_SLA = f"""{ORDERS}, {ITEMS}, {PAYMENTS}, {_PLACES}, {_BY_ORDER}, q AS (SELECT order_id, sum(value) AS payment_value, max(installments) AS n_installments FROM p GROUP BY 1),
  k AS (SELECT order_id AS id, seller, bought AS ts, shipped, due, deadline, CAST(shipped > deadline AS INT) AS y, date_diff('second', bought, shipped) AS h, n_items, n_products, price, freight, payment_value, n_installments, CAST(coalesce(customer_state = seller_state, false) AS INT) AS same_state
    FROM o JOIN g USING (order_id) LEFT JOIN q USING (order_id) LEFT JOIN c USING (customer_id) LEFT JOIN s ON s.seller_id = g.seller WHERE n_sellers = 1 AND n_deadlines = 1 AND shipped IS NOT NULL AND bought IS NOT NULL),
  v AS (SELECT *, lag(y) OVER (PARTITION BY seller ORDER BY ts, id) AS vy, lag(h) OVER (PARTITION BY seller ORDER BY ts, id) AS vh FROM k),
  w AS (SELECT a.id, avg(b.vy) FILTER (WHERE b.ts > a.ts - INTERVAL 30 DAY) AS y30, avg(b.vy) AS y90, avg(b.vh) FILTER (WHERE b.ts > a.ts - INTERVAL 30 DAY) AS h30, count(*) FILTER (WHERE b.ts >= a.ts - INTERVAL 7 DAY) - 1 AS load FROM v a JOIN v b ON b.seller = a.seller AND b.ts > a.ts - INTERVAL 90 DAY AND (b.ts, b.id) <= (a.ts, a.id) GROUP BY 1)"""
_HISTORY = "round(coalesce(avg(y) OVER n1, -1), 8) AS seller_past_breach_rate_expanding, round(coalesce(y30, -1), 8) AS seller_breach_rate_30d, round(coalesce(h30 / 86400, -1), 8) AS seller_handling_mean_30d"


def handoffs(spark, d) -> DataFrame:
    """Orders of one seller and one deadline that reached the carrier: id, seller, ts, y (breach), h (seconds until then), and what is known of each; in the shared folder."""
    pay = payments(spark, d).groupBy("order_id").agg(F.sum("value").alias("payment_value"), F.max("installments").alias("n_installments"))
    rows = orders(spark, d).where("bought is not null and shipped is not null").join(by_order(spark, d).where("n_sellers = 1 and n_deadlines = 1"), "order_id").join(pay, "order_id", "left")
    rows = rows.join(customers(spark, d).select("customer_id", "customer_state"), "customer_id", "left").join(sellers(spark, d).select("seller", "seller_state"), "seller", "left")
    return cut(rows.select(
        F.col("order_id").alias("id"), "seller", F.col("bought").alias("ts"), "shipped", "due", "deadline", (F.col("shipped") > F.col("deadline")).cast("int").alias("y"), S.seconds_between("bought", "shipped").alias("h"), "n_items", "n_products", "price", "freight",
        "payment_value", "n_installments", F.coalesce(F.col("customer_state") == F.col("seller_state"), F.lit(False)).cast("int").alias("same_state"),
    ))


def seller_history(rows: DataFrame) -> DataFrame:
    """(id, prior_n, mean_y, std_h, median_h, late_30d, late_90d, days_30d, load_7d) of handoffs; a large seller is split over tasks."""
    narrow = rows.select("id", "seller", "ts", "y", "h")
    cuts = W.cuts_of(narrow, "seller", "ts")
    past = W.prior_stats(narrow, "seller", "ts", "id", ["y", "h"], cuts).drop("std_y", "mean_h")
    median = W.prior_medians(narrow, "seller", "ts", "id", "h", "median_h", cuts).select("id", "median_h")
    frames = seller_frames(narrow, cuts, "seller", "ts", "id", "y", "h").select("id", "late_30d", "late_90d", "days_30d", "load_7d")
    return past.drop("seller", "ts", "y", "h").join(median, "id").join(frames, "id")


def _or_none(name, alias: str, digits: int = 8):
    return F.round(F.coalesce(name, F.lit(NONE)), digits).alias(alias)


@R.query(f"""WITH {_SLA} SELECT id, seller, y AS breach, round((epoch_us(deadline) - epoch_us(ts)) / 86400000000.0::DOUBLE, 8) AS days_to_shipping_deadline, isodow(ts) - 1 AS purchase_weekday, hour(ts) AS purchase_hour, month(ts) AS purchase_month, same_state, n_items, n_products AS n_distinct_products, round(price, 2) AS total_price, round(freight, 2) AS total_freight, round(payment_value, 2) AS payment_value, n_installments,
    row_number() OVER (PARTITION BY seller ORDER BY ts, id) - 1 AS seller_past_order_count, round(coalesce(quantile_cont(h, 0.5) OVER n1 / 86400, -1), 8) AS seller_past_handling_median_expanding, round(coalesce(stddev_samp(h) OVER n1 / 86400, -1), 4) AS seller_past_handling_std_expanding, {_HISTORY}, round(coalesce(y90, -1), 8) AS seller_breach_rate_90d, load AS seller_recent_load_7d, round(freight / nullif(price, 0), 6) AS total_freight_over_price
  FROM k JOIN w USING (id) WINDOW n1 AS {_BEFORE.format(k="seller")}""")
def fq05_seller_sla(spark, d):
    """The handoff-deadline data set: breach and 20 features (the three of the product table apart). -1: no history."""
    rows = handoffs(spark, d)
    t = F.col("ts")
    return rows.join(seller_history(rows), "id").select(
        "id", "seller", F.col("y").alias("breach"), F.round(S.days_between("ts", "deadline"), 8).alias("days_to_shipping_deadline"), F.weekday(t).alias("purchase_weekday"), F.hour(t).alias("purchase_hour"), F.month(t).alias("purchase_month"), "same_state", "n_items", F.col("n_products").alias("n_distinct_products"),
        F.round("price", 2).alias("total_price"), F.round("freight", 2).alias("total_freight"), F.round("payment_value", 2).alias("payment_value"), "n_installments", F.col("prior_n").cast("bigint").alias("seller_past_order_count"),
        _or_none("mean_y", "seller_past_breach_rate_expanding"), _or_none(F.col("median_h") / 86400, "seller_past_handling_median_expanding"), _or_none(F.col("std_h") / 86400, "seller_past_handling_std_expanding", 4), _or_none("late_30d", "seller_breach_rate_30d"), _or_none("late_90d", "seller_breach_rate_90d"), _or_none(F.col("days_30d") / 86400, "seller_handling_mean_30d"),
        F.col("load_7d").alias("seller_recent_load_7d"), F.round(F.try_divide("freight", "price"), 6).alias("total_freight_over_price"),
    )


@R.query(f"""WITH {_SLA} SELECT id, round(h / 86400.0::DOUBLE, 8) AS handling_duration_days, round((epoch_us(due) - epoch_us(shipped)) / 86400000000.0::DOUBLE, 8) AS remaining_promise_slack_days, isodow(shipped) - 1 AS handoff_weekday, hour(shipped) AS handoff_hour, same_state, round(price, 2) AS total_price, round(freight, 2) AS total_freight, n_items, {_HISTORY} FROM k JOIN w USING (id) WINDOW n1 AS {_BEFORE.format(k="seller")}""")
def fq06_handoff(spark, d):
    """What is known once the carrier has the parcel."""
    rows = handoffs(spark, d)
    return rows.join(seller_history(rows), "id").select(
        "id", F.round(F.col("h") / 86400, 8).alias("handling_duration_days"), F.round(S.days_between("shipped", "due"), 8).alias("remaining_promise_slack_days"), F.weekday("shipped").alias("handoff_weekday"), F.hour("shipped").alias("handoff_hour"), "same_state", F.round("price", 2).alias("total_price"), F.round("freight", 2).alias("total_freight"), "n_items",
        _or_none("mean_y", "seller_past_breach_rate_expanding"), _or_none("late_30d", "seller_breach_rate_30d"), _or_none(F.col("days_30d") / 86400, "seller_handling_mean_30d"),
    )


@R.query(f"""WITH {ORDERS}, {ITEMS}, {_PLACES}, {_BY_ORDER}, x AS (SELECT order_id AS id, person, bought AS ts, delivered, CAST(delivered > due AS INT) AS late, {_KM} AS km, abs(b.lat - a.lat) AS dlat, abs(b.lng - a.lng) AS dlng, price_mean, price_max, price_std, freight_mean FROM o JOIN g USING (order_id) LEFT JOIN c USING (customer_id) LEFT JOIN s ON s.seller_id = g.seller LEFT JOIN z a ON a.zip = c.zip LEFT JOIN z b ON b.zip = s.zip WHERE bought IS NOT NULL AND person IS NOT NULL),
  y AS (SELECT person, delivered, CAST(delivered > due AS INT) AS late FROM o JOIN c USING (customer_id) WHERE delivered IS NOT NULL AND person IS NOT NULL), h AS (SELECT x.id, count(y.delivered) AS n, coalesce(sum(y.late), 0) AS s FROM x LEFT JOIN y ON y.person = x.person AND y.delivered < x.ts GROUP BY 1)
  SELECT id, round(coalesce(km, -1), 4) AS geo_dist_km, round(coalesce(dlat, -1), 8) AS geo_lat_diff, round(coalesce(dlng, -1), 8) AS geo_lng_diff, row_number() OVER (PARTITION BY person ORDER BY ts, id) - 1 AS cust_prior_orders, CAST(row_number() OVER (PARTITION BY person ORDER BY ts, id) > 1 AS INT) AS cust_is_repeat, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY person)) / 86400000000.0::DOUBLE, 8) AS cust_tenure_days,
    round(CASE WHEN n > 0 THEN s / CAST(n AS DOUBLE) ELSE -1 END, 8) AS cust_prior_late_rate, n AS cust_prior_observed_orders, round(price_mean, 6) AS item_price_mean, price_max AS item_price_max, round(price_std, 6) AS item_price_std, round(freight_mean, 6) AS freight_per_item FROM x JOIN h USING (id)""")
def fq08_context(spark, d):
    """Geography, the customer's history as known at the order, and the prices of the basket. -1: not known. An outcome without a due time counts as not late."""
    rows = orders(spark, d).where("bought is not null").join(by_order(spark, d), "order_id").withColumnsRenamed({"order_id": "id", "bought": "ts"})
    rows = cut(with_places(rows, spark, d).where("person is not null").select("id", "person", "ts", "distance_km", F.abs(F.col("lat_s") - F.col("lat_c")).alias("dlat"), F.abs(F.col("lng_s") - F.col("lng_c")).alias("dlng"), "price_mean", "price_max", "price_std", "freight_mean"))
    told = orders(spark, d).where("delivered is not null").join(customers(spark, d), "customer_id").where("person is not null").select("person", "delivered", (F.col("delivered") > F.col("due")).cast("int").alias("late"))
    seen = W.asof_totals(rows.select("id", "person", "ts"), told, "person", "ts", "delivered", "late").select("id", F.col("prior_n").alias("known"), "prior_sum")
    past = W.prior_stats(rows.select("id", "person", "ts"), "person", "ts", "id", []).select("id", "prior_n")
    first = rows.groupBy("person").agg(F.min("ts").alias("first"))  # combined on the map side
    out = rows.join(first, "person").join(past, "id").join(seen, "id")
    n = F.col("prior_n").cast("bigint")
    return out.select(
        "id", _or_none("distance_km", "geo_dist_km", 4), _or_none("dlat", "geo_lat_diff"), _or_none("dlng", "geo_lng_diff"), n.alias("cust_prior_orders"), (n > 0).cast("int").alias("cust_is_repeat"), F.round(S.days_between("first", "ts"), 8).alias("cust_tenure_days"),
        F.round(F.when(F.col("known") > 0, F.col("prior_sum") / F.col("known")).otherwise(NONE), 8).alias("cust_prior_late_rate"), F.col("known").alias("cust_prior_observed_orders"), F.round("price_mean", 6).alias("item_price_mean"), F.col("price_max").alias("item_price_max"), F.round("price_std", 6).alias("item_price_std"), F.round("freight_mean", 6).alias("freight_per_item"),
    )

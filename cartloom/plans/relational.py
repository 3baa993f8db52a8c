"""Projections and filters (PF), joins (JN), aggregations (AG), top-k (TK) and set operations (SO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id, one_record
from cartloom.operators import contracts as C
from cartloom.operators import profile as P
from cartloom.operators import windows as W
from cartloom.plans.problems import _PREDICTIONS, iso_time
from cartloom.plans.registry import Registry
from cartloom.session import cut
from cartloom.sources.tables import table, tables

R = Registry()


def N():
    return F.count(F.lit(1))


def order_records(spark: SparkSession, d: str) -> DataFrame:
    times = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
    rows = table(spark, d, "olist_orders_dataset").withColumn("order_id", clean_id("order_id"))
    return one_record(rows, ["order_id"], ["customer_id", "order_status", *times, "deleted_at"])


ORDERS = """o AS (SELECT lower(trim(order_id)) AS order_id, any_value(customer_id) AS customer_id, any_value(order_status) AS status, any_value(order_purchase_timestamp) AS bought, any_value(order_approved_at) AS approved,
  any_value(order_delivered_carrier_date) AS shipped, any_value(order_delivered_customer_date) AS delivered, any_value(order_estimated_delivery_date) AS due, any_value(deleted_at) AS deleted FROM olist_orders_dataset GROUP BY 1)"""
ITEMS = """i AS (SELECT lower(trim(order_id)) AS order_id, order_item_id, any_value(product_id) AS product_id, any_value(seller_id) AS seller_id, any_value(shipping_limit_date) AS deadline, any_value(price) AS price, any_value(freight_value) AS freight FROM olist_order_items_dataset GROUP BY 1, 2)"""
PAYMENTS = """p AS (SELECT nullif(lower(trim(order_id)), '') AS order_id, payment_sequential, any_value(payment_type) AS payment_type, any_value(payment_installments) AS installments, any_value(payment_value) AS value FROM olist_order_payments_dataset WHERE nullif(trim(order_id), '') IS NOT NULL GROUP BY 1, 2)"""


def orders(spark, d):
    return order_records(spark, d).withColumnsRenamed({"order_status": "status", "order_purchase_timestamp": "bought", "order_approved_at": "approved", "order_delivered_carrier_date": "shipped", "order_delivered_customer_date": "delivered", "order_estimated_delivery_date": "due", "deleted_at": "deleted"})


def items(spark, d):
    rows = table(spark, d, "olist_order_items_dataset").withColumn("order_id", clean_id("order_id"))
    return one_record(rows, ["order_id", "order_item_id"], ["product_id", "seller_id", "shipping_limit_date", "price", "freight_value"]).withColumnsRenamed({"shipping_limit_date": "deadline", "freight_value": "freight"})


def payments(spark, d):
    rows = table(spark, d, "olist_order_payments_dataset").withColumn("order_id", clean_id("order_id")).where("order_id is not null")
    return one_record(rows, ["order_id", "payment_sequential"], ["payment_type", "payment_installments", "payment_value"]).withColumnsRenamed({"payment_installments": "installments", "payment_value": "value"})


# --- projections and filters


@R.query("SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS total FROM orders")
def pf01_adapter(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return C.adapt(rows, {"o_orderkey": "id", "o_custkey": "customer", "o_totalprice": "total"})


@R.query("SELECT * EXCLUDE (o_orderpriority, o_totalprice) FROM orders")
def pf02_exclude(spark, d):
    return table(spark, d, "orders").drop("o_orderpriority", "o_totalprice")


@R.query("SELECT doc_id, coalesce(length(trim(text)) > 0, false) AS has_text, coalesce(length(trim(sku)) > 0, false) AS has_sku FROM documents")
def pf03_has_text(spark, d):
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return table(spark, d, "documents").select("doc_id", has("text").alias("has_text"), has("sku").alias("has_sku"))


@R.query(f"""WITH {ORDERS} SELECT order_id, bought FROM o WHERE status = 'delivered' AND bought >= TIMESTAMP '2021-06-01' AND bought < TIMESTAMP '2022-06-01' AND delivered IS NOT NULL AND due IS NOT NULL
  AND approved >= bought AND (shipped IS NULL OR shipped >= approved) AND delivered >= bought""")
def pf04_05_07_eligible(spark, d):
    rows = orders(spark, d).na.drop(subset=["delivered", "due"])
    return rows.where((F.col("status") == "delivered") & (F.col("bought") >= "2021-06-01") & (F.col("bought") < "2022-06-01") & (F.col("approved") >= F.col("bought")) & (F.col("shipped").isNull() | (F.col("shipped") >= F.col("approved"))) & (F.col("delivered") >= F.col("bought"))).select("order_id", "bought")


@R.query("SELECT max(o_orderdate) AS last_date, count(*) AS n_rows FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def pf06_boundary(spark, d):
    """Rows before a boundary, with a check that none lies at or after it."""
    rows = table(spark, d, "orders").where("o_orderdate < timestamp '1999-01-01'")
    C.require(rows, {"before the boundary": F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")})
    return rows.agg(F.max("o_orderdate").alias("last_date"), N().alias("n_rows"))


@R.query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount NOT BETWEEN 0.02 AND 0.06 GROUP BY 1")
def pf08_09_in_between(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & ~F.col("l_discount").between(0.02, 0.06)).groupBy("l_returnflag").agg(N().alias("n"))


@R.query("SELECT l_returnflag, count(*) AS n_rows, round(avg(l_discount), 8) AS mean_discount FROM lineitem GROUP BY 1")
def pf10_11_output_contract(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(N().alias("n_rows"), F.round(F.avg("l_discount"), 8).alias("mean_discount"))
    C.require_columns(rows, ["l_returnflag", "n_rows", "mean_discount"])
    return C.require(rows, {"share": F.col("mean_discount").between(0, 1), "finite": ~F.isnan("mean_discount"), "rows": F.col("n_rows") > 0})


@R.query("SELECT p_partkey, p_brand, -1 AS p_size, CAST(NULL AS DOUBLE) AS p_retailprice FROM part")
def pf12_override(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.lit(-1).alias("p_size"), F.lit(None).cast("double").alias("p_retailprice"))


@R.query(f"""WITH {ITEMS} SELECT order_id, order_item_id, least(greatest(price, 1e-6), 500) AS clipped, round(freight / nullif(price, 0), 6) AS ratio, round(CASE WHEN price > 0 THEN freight / price ELSE 0.0 END, 6) AS ratio_zero,
  CASE WHEN seller_id IS NULL THEN NULL ELSE price END AS masked, CASE WHEN price < 50 THEN 'low' WHEN price < 200 THEN 'mid' ELSE 'high' END AS band FROM i""")
def pf13_17_safe_math(spark, d):
    price = F.col("price")
    return items(spark, d).select(
        "order_id", "order_item_id", F.least(F.greatest(price, F.lit(1e-6)), F.lit(500.0)).alias("clipped"), F.round(F.try_divide("freight", "price"), 6).alias("ratio"),
        F.round(F.when(price > 0, F.col("freight") / price).otherwise(0.0), 6).alias("ratio_zero"), F.when(F.col("seller_id").isNotNull(), price).alias("masked"), F.when(price < 50, "low").when(price < 200, "mid").otherwise("high").alias("band"),
    )


@R.query("SELECT row_index, customer_rating, CASE WHEN customer_rating <= 2 THEN 0 WHEN customer_rating >= 4 THEN 1 END AS label FROM split_assignments")
def pf18_rating_label(spark, d):
    rows = table(spark, d, "split_assignments")
    return rows.select("row_index", "customer_rating", C.mapped(F.col("customer_rating"), {1: 0, 2: 0, 3: None, 4: 1, 5: 1}).cast("int").alias("label"))


@R.query("SELECT * FROM (VALUES ('doc_id', 'key'), ('text', 'content'), ('lang', 'label'), ('source', 'label'), ('n_chars', 'content'), ('sku', 'key'), ('user_id', 'key'), ('created_at', 'time')) AS t(column_name, tier)")
def pf19_20_tiers(spark, d):
    df = table(spark, d, "documents")
    tiers = {"key": ["doc_id", "sku", "user_id"], "content": ["text", "n_chars"], "label": ["lang", "source"], "time": ["created_at"]}
    return spark.createDataFrame(sorted(C.require_tiers(df.columns, tiers).items()), "column_name string, tier string")


# --- joins


@R.query(f"""WITH {ORDERS}, {ITEMS}, {PAYMENTS}, a AS (SELECT order_id, count(*) AS n_items, round(sum(price), 2) AS price FROM i GROUP BY 1), b AS (SELECT order_id, count(*) AS n_payments, round(sum(value), 2) AS paid FROM p GROUP BY 1),
  c AS (SELECT customer_id, any_value(customer_state) AS state FROM olist_customers_dataset GROUP BY 1)
  SELECT order_id, state, n_items, price, n_payments, paid FROM o JOIN a USING (order_id) LEFT JOIN b USING (order_id) LEFT JOIN c USING (customer_id)""")
def jn01_03_order_lookup(spark, d):
    a = items(spark, d).groupBy("order_id").agg(N().alias("n_items"), F.round(F.sum("price"), 2).alias("price"))
    b = payments(spark, d).groupBy("order_id").agg(N().alias("n_payments"), F.round(F.sum("value"), 2).alias("paid"))
    c = one_record(table(spark, d, "olist_customers_dataset"), ["customer_id"], ["customer_state"]).withColumnRenamed("customer_state", "state")
    return orders(spark, d).select("order_id", "customer_id").join(a, "order_id").join(b, "order_id", "left").join(c, "customer_id", "left").drop("customer_id")


@R.query("""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT o_orderkey, l_suppkey, a.n_name AS customer_nation, b.n_name AS supplier_nation, concat(a.n_name, '->', b.n_name) AS lane FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN n a ON a.k = c_nationkey JOIN n b ON b.k = s_nationkey""")
def jn04_role_played(spark, d):
    o, c, li, s, n = tables(spark, d, "orders", "customer", "lineitem", "supplier", "nation")
    nation = lambda key, name: F.broadcast(n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))  # noqa: E731  25 rows by definition
    pairs = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    rows = o.select("o_orderkey", "o_custkey").join(pairs, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(nation("c_nationkey", "customer_nation"), "c_nationkey").join(nation("s_nationkey", "supplier_nation"), "s_nationkey")
    return rows.select("o_orderkey", "l_suppkey", "customer_nation", "supplier_nation", F.concat("customer_nation", F.lit("->"), "supplier_nation").alias("lane"))


@R.query("SELECT user_id, count(*) AS n_lines, count(DISTINCT product_id) AS n_products FROM (SELECT DISTINCT order_id, product_id FROM order_products__prior) JOIN (SELECT DISTINCT order_id, user_id, eval_set FROM basket_orders) b USING (order_id) WHERE b.eval_set = 'prior' GROUP BY 1")
def jn05_extra_predicate(spark, d):
    lines = table(spark, d, "order_products__prior").select("order_id", "product_id").distinct()
    b = table(spark, d, "basket_orders").where("eval_set = 'prior'").select("order_id", "user_id").distinct()
    return lines.join(b, "order_id").groupBy("user_id").agg(N().alias("n_lines"), F.countDistinct("product_id").alias("n_products"))


@R.query("SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 5")
def jn06_theta_self_join(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s1")).distinct()
    return a.join(a.withColumnRenamed("s1", "s2"), "l_orderkey").where("s1 < s2").groupBy("s1", "s2").agg(N().alias("n")).where("n >= 5")


@R.query("""WITH t AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), v AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
  SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM v) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_partkey = x.l_partkey)) AS cold_parts, (SELECT count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_suppkey = v.l_suppkey AND t.l_partkey = v.l_partkey)) AS cold_pairs""")
def jn07_ag23_cold_entities(spark, d):
    """Parts and (supplier, part) pairs of the later period that the earlier one has never seen."""
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    seen = F.col("first") < F.lit("1998-01-01").cast("timestamp")
    later = F.col("last") >= F.lit("1998-01-01").cast("timestamp")
    parts = pairs.groupBy("l_partkey").agg(F.max(seen).alias("seen"), F.max(later).alias("later"), F.count_if(later & ~seen).alias("cold"))
    return parts.agg(F.count_if(F.col("later") & ~F.col("seen")).alias("cold_parts"), F.sum("cold").alias("cold_pairs"))


@R.query(f"WITH {ORDERS}, {ITEMS} SELECT i.order_id, i.order_item_id FROM i WHERE i.order_id IN (SELECT order_id FROM o WHERE status <> 'delivered')")
def jn08_semi(spark, d):
    undelivered = orders(spark, d).where("status <> 'delivered'").select("order_id")
    return items(spark, d).join(undelivered, "order_id", "left_semi").select("order_id", "order_item_id")


@R.query(f"WITH {ITEMS} SELECT seller_id FROM (SELECT seller_id FROM i GROUP BY 1 HAVING count(*) >= 50 INTERSECT SELECT seller_id FROM i GROUP BY 1 HAVING avg(price) > 60) WHERE seller_id IS NOT NULL")
def jn09_two_havings(spark, d):
    return items(spark, d).where("seller_id is not null").groupBy("seller_id").agg(N().alias("n"), F.avg("price").alias("p")).where("n >= 50 and p > 60").select("seller_id")


@R.query("""WITH e AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem), g AS (SELECT s_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL), e),
  x AS (SELECT l_suppkey AS s_suppkey, CAST(unnest(generate_series(CAST(l_shipdate AS DATE) - 13, CAST(l_shipdate AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM lineitem WHERE l_shipdate IS NOT NULL), n AS (SELECT s_suppkey, day, count(*) AS n FROM x GROUP BY 1, 2)
  SELECT s_suppkey, day, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (s_suppkey, day)""")
def jn11_12_interval_grid(spark, d):
    """(s_suppkey, day, n): lines shipped in the 14 days from each day between the first and the last ship date, for every supplier.

    Lines are counted per day first and summed over a dense calendar, so a large supplier has no more rows than there are days.
    """
    lines = table(spark, d, "lineitem")
    first, last = lines.agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    nodes = table(spark, d, "supplier").select("s_suppkey").where("s_suppkey is not null").distinct()
    per = lines.select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("day")).where("s_suppkey is not null and day is not null").groupBy("s_suppkey", "day").agg(N().alias("n"))
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    dense = nodes.select("s_suppkey", F.explode(F.sequence(start, F.date_add(end, 13))).alias("day")).join(per, ["s_suppkey", "day"], "left")
    w = Window.partitionBy("s_suppkey").orderBy("day").rowsBetween(0, 13)
    return dense.select("s_suppkey", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n")).where(F.col("day") <= end)


@R.query(f"""WITH {_PREDICTIONS}, p AS (SELECT DISTINCT prediction_id, nullif(seller_id, '') AS seller_id, moment FROM e) SELECT count(*) AS n_predictions, count(*) FILTER (WHERE moment IS NULL) AS n_no_time, count(*) FILTER (WHERE v.first IS NULL) AS n_without, count(*) FILTER (WHERE v.first > moment) AS n_before FROM p
  LEFT JOIN (SELECT lower(trim(seller_id)) AS seller_id, min(recorded_at) AS first FROM seller_history GROUP BY 1) v USING (seller_id)""")
def jn13_point_in_time_audit(spark, d):
    """Every prediction, its time in any notation: how many have no readable time, no history, a history recorded only later."""
    p = table(spark, d, "prediction_log").select("prediction_id", clean_id("seller_id").alias("seller_id"), iso_time("features_as_of").alias("at")).distinct()
    v = table(spark, d, "seller_history").groupBy(clean_id("seller_id").alias("seller_id")).agg(F.min("recorded_at").cast("timestamp").alias("first"))
    return p.join(v, "seller_id", "left").agg(N().alias("n_predictions"), F.count_if(F.col("at").isNull()).alias("n_no_time"), F.count_if(F.col("first").isNull()).alias("n_without"), F.count_if(F.col("first") > F.col("at")).alias("n_before"))


@R.query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def jn14_validated_merge(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    C.require_unique(c, ["c_custkey"])
    C.one_to_one(o.select("o_orderkey"), o.select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).agg(N().alias("n"))


_BOTH = "WITH a AS (SELECT DISTINCT order_id, score FROM prediction_log WHERE prediction_type = 'late_delivery'), b AS (SELECT DISTINCT order_id, score FROM prediction_log WHERE prediction_type = 'seller_sla')"


@R.query(f"{_BOTH} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a.order_id IS NULL) AS only_right, count(*) FILTER (WHERE b.order_id IS NULL) AS only_left, count(*) FILTER (WHERE (a.score >= 0.15) = (b.score >= 0.15)) AS n_agree FROM a FULL JOIN b ON lower(trim(a.order_id)) = lower(trim(b.order_id))")
def jn15_16_paired_alignment(spark, d):
    side = lambda kind, name: table(spark, d, "prediction_log").where(F.col("prediction_type") == kind).select("order_id", "score").distinct().select(clean_id("order_id").alias("k"), F.col("score").alias(name))
    both = side("late_delivery", "a").join(side("seller_sla", "b"), "k", "full")
    return both.agg(N().alias("n_pairs"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if((F.col("a") >= 0.15) == (F.col("b") >= 0.15)).alias("n_agree"))


@R.query(f"WITH {ORDERS}, q AS (SELECT DISTINCT prediction_id, order_id, score FROM prediction_log) SELECT prediction_id, score, delivered > due AS late FROM q LEFT JOIN o ON o.order_id = lower(trim(q.order_id))")
def jn17_reconcile(spark, d):
    q = table(spark, d, "prediction_log").select("prediction_id", clean_id("order_id").alias("order_id"), "score").distinct()
    return q.join(orders(spark, d).select("order_id", (F.col("delivered") > F.col("due")).alias("late")), "order_id", "left").drop("order_id")


@R.query("SELECT band, count(*) AS n_lines, count(DISTINCT product_id) AS n_products FROM (SELECT product_id, CASE WHEN n < 20 THEN 'rare' WHEN n < 100 THEN 'medium' ELSE 'frequent' END AS band FROM (SELECT product_id, count(*) OVER (PARTITION BY product_id) AS n FROM order_products__prior WHERE product_id IS NOT NULL)) GROUP BY 1")
def jn18_ag26_group_band(spark, d):
    """Per-band totals from one aggregation per product; no join back, no window over a hot product."""
    n = table(spark, d, "order_products__prior").where("product_id is not null").groupBy("product_id").agg(N().alias("n"))
    band = F.when(F.col("n") < 20, "rare").when(F.col("n") < 100, "medium").otherwise("frequent")
    return n.groupBy(band.alias("band")).agg(F.sum("n").alias("n_lines"), N().alias("n_products"))


_SIDES = "s AS (SELECT DISTINCT lower(trim(split)) AS split, lower(trim(sku)) AS sku FROM split_assignments WHERE split IS NOT NULL AND trim(sku) <> '')"


@R.query(f"WITH {_SIDES} SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.sku = b.sku AND a.split < b.split GROUP BY 1, 2")
def jn19_20_split_overlap(spark, d):
    """Items that two splits share, from the set of splits of each item."""
    s = table(spark, d, "split_assignments").select(clean_id("split").alias("split"), clean_id("sku").alias("sku")).where("split is not null and sku is not null")
    sets = s.groupBy("sku").agg(F.array_sort(F.collect_set("split")).alias("x"))  # at most the number of splits
    pairs = sets.select(F.explode(F.expr("flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> struct(a as split_a, b as split_b))))")).alias("p"))
    return pairs.groupBy("p.split_a", "p.split_b").agg(N().alias("n_shared"))


@R.query("""WITH h AS (SELECT DISTINCT seller_id, history_id, valid_from, seller_tier, seller_state FROM seller_history), v AS (SELECT *, lag(history_id) OVER w AS p, lag(seller_tier) OVER w AS t, lag(seller_state) OVER w AS s FROM h WINDOW w AS (PARTITION BY seller_id ORDER BY valid_from, history_id))
  SELECT seller_id, history_id, t AS old_tier, seller_tier AS new_tier, s AS old_state, seller_state AS new_state FROM v WHERE p IS NOT NULL AND (t IS DISTINCT FROM seller_tier OR s IS DISTINCT FROM seller_state)""")
def jn21_version_diff(spark, d):
    """Versions of a seller that differ from the one before; a seller with many versions is split over tasks."""
    h = cut(table(spark, d, "seller_history").select("seller_id", "history_id", "valid_from", "seller_tier", "seller_state").distinct())
    v = W.previous_rows(h, "seller_id", "valid_from", "history_id", ["history_id", "seller_tier", "seller_state"])
    changed = ~F.col("prev_seller_tier").eqNullSafe(F.col("seller_tier")) | ~F.col("prev_seller_state").eqNullSafe(F.col("seller_state"))
    return v.where(F.col("prev_history_id").isNotNull() & changed).select("seller_id", "history_id", F.col("prev_seller_tier").alias("old_tier"), F.col("seller_tier").alias("new_tier"), F.col("prev_seller_state").alias("old_state"), F.col("seller_state").alias("new_state"))


# --- aggregations


@R.query("SELECT count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, min(o_totalprice) AS least_price, max(o_totalprice) AS most_price FROM orders")
def ag01_global(spark, d):
    return table(spark, d, "orders").agg(N().alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.min("o_totalprice").alias("least_price"), F.max("o_totalprice").alias("most_price"))


_NULLS = "order_id customer_id order_status order_purchase_timestamp order_approved_at order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date loaded_at deleted_at".split()


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM olist_orders_dataset" for c in _NULLS))
def ag02_null_profile(spark, d):
    return P.null_profile(table(spark, d, "olist_orders_dataset"))


@R.query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_surplus FROM lineitem")
def ag03_key_duplicates(spark, d):
    return P.key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.query("SELECT order_status, count(*) AS n FROM olist_orders_dataset GROUP BY 1")
def ag04_status_counts(spark, d):
    return table(spark, d, "olist_orders_dataset").groupBy("order_status").agg(N().alias("n")).orderBy(F.desc("n"), "order_status")


@R.query(f"""WITH {ITEMS} SELECT order_id, count(*) AS n_items, count(DISTINCT product_id) AS n_products, count(DISTINCT seller_id) AS n_sellers, count(DISTINCT deadline) AS n_deadlines, round(sum(price), 2) AS price, round(sum(freight), 2) AS freight, round(avg(price), 6) AS mean_price, min(price) AS least_price, max(price) AS most_price, min(deadline) AS first_deadline FROM i GROUP BY 1""")
def ag05_06_item_aggregates(spark, d):
    return items(spark, d).groupBy("order_id").agg(N().alias("n_items"), F.countDistinct("product_id").alias("n_products"), F.countDistinct("seller_id").alias("n_sellers"), F.countDistinct("deadline").alias("n_deadlines"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("freight"), 2).alias("freight"), F.round(F.avg("price"), 6).alias("mean_price"), F.min("price").alias("least_price"), F.max("price").alias("most_price"), F.min("deadline").alias("first_deadline"))


@R.query(f"WITH {PAYMENTS} SELECT order_id, count(*) AS n_payments, max(installments) AS most_installments, round(sum(value), 2) AS paid, count(*) FILTER (WHERE payment_type = 'credit_card') AS n_card, max_by(payment_type, (value, payment_sequential)) AS main_type FROM p WHERE value IS NOT NULL GROUP BY 1")
def ag07_08_payment_aggregates(spark, d):
    return payments(spark, d).where("value is not null").groupBy("order_id").agg(N().alias("n_payments"), F.max("installments").alias("most_installments"), F.round(F.sum("value"), 2).alias("paid"), F.count_if(F.col("payment_type") == "credit_card").alias("n_card"), F.max_by("payment_type", F.struct("value", "payment_sequential")).alias("main_type"))


@R.query("SELECT l_shipmonth, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned, round(avg(CAST(l_returnflag = 'R' AS INT)), 8) AS rate FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1 HAVING count(*) >= 10")
def ag09_10_conditional(spark, d):
    back = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(F.round(F.sum(F.when(back, F.col("l_quantity")).otherwise(0)), 2).alias("returned"), F.round(F.avg(back.cast("int")), 8).alias("rate"), N().alias("n"))
    return rows.where("n >= 10").drop("n")


@R.query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def ag11_distinct_support(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"))


@R.query(f"WITH {ITEMS} SELECT order_id, first_product, first_price FROM (SELECT order_id, product_id AS first_product, price AS first_price, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id) AS rn FROM i) WHERE rn = 1")
def ag12_first_row(spark, d):
    first = F.min_by(F.struct(F.col("product_id").alias("first_product"), F.col("price").alias("first_price")), "order_item_id")
    return items(spark, d).groupBy("order_id").agg(first.alias("f")).select("order_id", "f.*")


@R.query("SELECT lpad(trim(geolocation_zip_code_prefix), 5, '0') AS zip, round(avg(geolocation_lat), 8) AS lat, round(avg(geolocation_lng), 8) AS lng, count(*) AS n FROM (SELECT DISTINCT * FROM olist_geolocation_dataset) WHERE geolocation_lat <> 0 GROUP BY 1")
def ag13_centroids(spark, d):
    from cartloom.functions.keys import zip_code

    rows = table(spark, d, "olist_geolocation_dataset").distinct().where("geolocation_lat <> 0")
    return rows.groupBy(zip_code("geolocation_zip_code_prefix").alias("zip")).agg(F.round(F.avg("geolocation_lat"), 8).alias("lat"), F.round(F.avg("geolocation_lng"), 8).alias("lng"), N().alias("n"))


@R.query(f"WITH {ITEMS}, c AS (SELECT order_id, sum(price) AS v, count(DISTINCT seller_id) = 1 AND count(DISTINCT deadline) = 1 AND count(seller_id) = count(*) AS single FROM i GROUP BY 1) SELECT count(*) AS n_orders, count(*) FILTER (WHERE single) AS n_single, round(sum(CASE WHEN single THEN v END) / sum(v), 6) AS value_share FROM c")
def ag14_15_single_cohort(spark, d):
    """Orders with one seller and one deadline, and their share of the value: min = max instead of distinct counts."""
    one = (F.min("seller_id") == F.max("seller_id")) & (F.min("deadline") == F.max("deadline")) & (F.count("seller_id") == N())
    c = items(spark, d).groupBy("order_id").agg(F.sum("price").alias("v"), F.coalesce(one, F.lit(False)).alias("single"))
    return c.agg(N().alias("n_orders"), F.count_if("single").alias("n_single"), F.round(F.sum(F.when(F.col("single"), F.col("v"))) / F.sum("v"), 6).alias("value_share"))


_RULES = [("not delivered", "status <> 'delivered'"), ("no purchase time", "bought IS NULL"), ("withdrawn", "deleted IS NOT NULL"), ("approved before purchase", "approved < bought"), ("shipped before approval", "shipped < approved"), ("no due date", "due IS NULL")]


def _waterfall_sql() -> str:
    steps, keep = [], "TRUE"
    for i, (name, rule) in enumerate([("all rows", "FALSE"), *_RULES]):
        out = f"{keep} AND {rule}"
        keep = keep if i == 0 else f"{keep} AND NOT ({rule})"
        steps.append(f"SELECT {i} AS step, '{name}' AS rule, count(*) FILTER (WHERE {out}) AS n_excluded, count(*) FILTER (WHERE {keep}) AS n_left, count(*) FILTER (WHERE ({keep}) AND delivered > due) AS n_positive, count(*) FILTER (WHERE ({keep}) AND delivered <= due) AS n_negative, count(*) FILTER (WHERE ({keep}) AND (delivered > due) IS NULL) AS n_unlabelled FROM o")
    return f"WITH {ORDERS} " + " UNION ALL ".join(steps)


@R.query(_waterfall_sql())
def ag16_waterfall(spark, d):
    return P.waterfall(orders(spark, d), [(n, F.expr(r)) for n, r in _RULES], (F.col("delivered") > F.col("due")).cast("int"))


@R.query(f"WITH w AS ({_waterfall_sql()}) SELECT step, rule, n_left, lag(n_left) OVER (ORDER BY step) - n_left AS n_dropped FROM w")
def ag17_waterfall_drops(spark, d):
    rows = ag16_waterfall(spark, d)
    return rows.select("step", "rule", "n_left", (F.lag("n_left").over(Window.partitionBy(F.lit(0)).orderBy("step")) - F.col("n_left")).alias("n_dropped"))


_ANOMALIES = {"approved before purchase": "approved < bought", "shipped before approval": "shipped < approved", "delivered before shipping": "delivered < shipped", "delivered before purchase": "delivered < bought", "due before purchase": "due < bought", "delivered without date": "status = 'delivered' AND delivered IS NULL", "date without delivery": "status <> 'delivered' AND delivered IS NOT NULL", "withdrawn before purchase": "deleted < bought", "no purchase time": "bought IS NULL"}


@R.query(f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {r}) AS n FROM o" for n, r in _ANOMALIES.items()))
def ag18_anomalies(spark, d):
    return P.counts_of(orders(spark, d), {n: F.expr(r) for n, r in _ANOMALIES.items()})


@R.query(f"WITH {ORDERS} SELECT strftime(bought, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE delivered > due) AS n_late, round(avg(CAST(delivered > due AS INT)), 8) AS rate, round(avg(date_diff('second', bought, approved) / 3600.0::DOUBLE), 4) AS approval_hours FROM o WHERE bought IS NOT NULL AND delivered IS NOT NULL GROUP BY 1")
def ag19_20_monthly(spark, d):
    late = F.col("delivered") > F.col("due")
    hours = (F.unix_timestamp("approved") - F.unix_timestamp("bought")) / F.lit(3600.0)
    return orders(spark, d).where("bought is not null and delivered is not null").groupBy(F.date_format("bought", "yyyy-MM").alias("month")).agg(N().alias("n"), F.count_if(late).alias("n_late"), F.round(F.avg(late.cast("int")), 8).alias("rate"), F.round(F.avg(hours), 4).alias("approval_hours"))


@R.query(f"WITH {ORDERS}, m AS (SELECT strftime(bought, '%Y-%m') AS month, avg(CAST(delivered > due AS INT)) AS rate FROM o WHERE bought IS NOT NULL AND delivered IS NOT NULL GROUP BY 1) SELECT max_by(month, (rate, month)) AS peak_month, round(max(rate) - min(rate), 8) AS spread, max(rate) - min(rate) > 0.10 AS shifted FROM m")
def ag20_drift(spark, d):
    m = ag19_20_monthly(spark, d)
    return m.agg(F.max_by("month", F.struct("rate", "month")).alias("peak_month"), F.round(F.max("rate") - F.min("rate"), 8).alias("spread"), (F.max("rate") - F.min("rate") > 0.10).alias("shifted"))


@R.query("SELECT round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' THEN value END), 6) AS inside, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10' THEN value END), 6) AS before_it, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-20' THEN value END), 6) AS after_it FROM events")
def ag21_event_window(spark, d):
    mean = lambda a, b: F.round(F.avg(F.when((F.col("ts") >= a) & (F.col("ts") < b), F.col("value"))), 6)
    return table(spark, d, "events").agg(mean("2024-01-10", "2024-01-15").alias("inside"), mean("2024-01-05", "2024-01-10").alias("before_it"), mean("2024-01-15", "2024-01-20").alias("after_it"))


@R.query(f"WITH {ORDERS} SELECT CASE WHEN bought < TIMESTAMP '2022-01-01' THEN 'train' WHEN bought < TIMESTAMP '2022-07-01' THEN 'validation' WHEN bought < TIMESTAMP '2023-01-01' THEN 'test' ELSE 'rest' END AS part, count(*) AS n, count(*) FILTER (WHERE delivered > due) AS n_late, min(bought) AS first_time, max(bought) AS last_time FROM o GROUP BY 1")
def ag22_split_stats(spark, d):
    b = F.col("bought")
    part = F.when(b < "2022-01-01", "train").when(b < "2022-07-01", "validation").when(b < "2023-01-01", "test").otherwise("rest")
    return orders(spark, d).groupBy(part.alias("part")).agg(N().alias("n"), F.count_if(F.col("delivered") > F.col("due")).alias("n_late"), F.min(b).alias("first_time"), F.max(b).alias("last_time"))


@R.query(f"WITH {ORDERS}, {ITEMS}, {PAYMENTS}, j AS (SELECT order_id FROM o JOIN (SELECT DISTINCT order_id FROM i) USING (order_id) LEFT JOIN (SELECT DISTINCT order_id FROM p) USING (order_id)) SELECT count(*) AS n_rows, count(DISTINCT order_id) AS n_orders FROM j")
def ag24_join_cardinality(spark, d):
    j = orders(spark, d).select("order_id").join(items(spark, d).select("order_id").distinct(), "order_id").join(payments(spark, d).select("order_id").distinct(), "order_id", "left")
    return j.agg(N().alias("n_rows"), F.countDistinct("order_id").alias("n_orders"))


@R.query(f"WITH {ORDERS} SELECT year(bought) AS year, count(*) AS n, count(*) FILTER (WHERE delivered > due) AS n_late FROM o WHERE bought IS NOT NULL GROUP BY 1")
def ag25_per_year(spark, d):
    return orders(spark, d).where("bought is not null").groupBy(F.year("bought").cast("long").alias("year")).agg(N().alias("n"), F.count_if(F.col("delivered") > F.col("due")).alias("n_late"))


@R.query("SELECT flagged, excluded, count(*) FILTER (WHERE customer_rating <= 2) AS low, count(*) FILTER (WHERE customer_rating = 3) AS middle, count(*) FILTER (WHERE customer_rating >= 4) AS high FROM split_assignments GROUP BY 1, 2")
def ag27_scope_matrix(spark, d):
    r = F.col("customer_rating")
    return table(spark, d, "split_assignments").groupBy("flagged", "excluded").agg(F.count_if(r <= 2).alias("low"), F.count_if(r == 3).alias("middle"), F.count_if(r >= 4).alias("high"))


@R.query("SELECT sku, count(*) AS n, round(avg(customer_rating), 6) AS mean, round(stddev_samp(customer_rating), 6) AS std FROM (SELECT lower(trim(sku)) AS sku, customer_rating FROM split_assignments WHERE trim(sku) <> '') GROUP BY 1 HAVING count(*) >= 3")
def ag28_supported_stats(spark, d):
    rows = table(spark, d, "split_assignments").select(clean_id("sku").alias("sku"), "customer_rating").where("sku is not null")
    return rows.groupBy("sku").agg(N().alias("n"), F.round(F.avg("customer_rating"), 6).alias("mean"), F.round(F.stddev_samp("customer_rating"), 6).alias("std")).where("n >= 3")


@R.query("SELECT round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS p100, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM documents")
def ag29_30_length_stats(spark, d):
    docs = table(spark, d, "documents")
    at = dict(zip(("p50", "p90", "p99"), W.percentiles(docs, "n_chars", [0.5, 0.9, 0.99])))
    return docs.agg(*[F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in at.items()], F.max("n_chars").alias("p100"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("std"))


@R.query("WITH p AS (SELECT lower(trim(sku)) AS sku, count(*) AS n, avg(customer_rating) AS m FROM split_assignments WHERE trim(sku) <> '' GROUP BY 1) SELECT round(corr(n, m), 6) AS corr, count(*) FILTER (WHERE n >= 10) AS n_ten, count(*) FILTER (WHERE n = 1) AS n_one FROM p WHERE m IS NOT NULL")
def ag31_32_correlation(spark, d):
    rows = table(spark, d, "split_assignments").select(clean_id("sku").alias("sku"), "customer_rating").where("sku is not null")
    p = rows.groupBy("sku").agg(N().alias("n"), F.avg("customer_rating").alias("m")).where("m is not null")
    return p.agg(F.round(F.corr("n", "m"), 6).alias("corr"), F.count_if(F.col("n") >= 10).alias("n_ten"), F.count_if(F.col("n") == 1).alias("n_one"))


@R.query("SELECT customer_rating, round(avg(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))), 6) AS mean_tokens FROM (SELECT DISTINCT row_index, customer_rating FROM split_assignments) JOIN documents ON doc_id = row_index WHERE text IS NOT NULL GROUP BY 1")
def ag33_tokens_by_rating(spark, d):
    s = table(spark, d, "split_assignments").select(F.col("row_index").alias("doc_id"), "customer_rating").distinct()
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != ""))
    return table(spark, d, "documents").where("text is not null").select("doc_id", words.alias("w")).join(s, "doc_id").groupBy("customer_rating").agg(F.round(F.avg("w"), 6).alias("mean_tokens"))


@R.query("WITH l AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS value), n AS (SELECT customer_rating AS value, count(*) AS n FROM split_assignments GROUP BY 1) SELECT value, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE), 8) AS share FROM l LEFT JOIN n USING (value)")
def ag34_value_counts(spark, d):
    return P.value_counts(table(spark, d, "split_assignments"), "customer_rating", [0, 1, 2, 3, 4, 5, 6]).withColumn("share", F.round("share", 8))


@R.query("WITH n AS (SELECT order_status, count(*) AS n FROM olist_orders_dataset GROUP BY 1) SELECT order_status AS mode, round(n / CAST((SELECT sum(n) FROM n) AS DOUBLE), 8) AS share FROM n ORDER BY n DESC, order_status LIMIT 1")
def ag35_mode(spark, d):
    n = table(spark, d, "olist_orders_dataset").groupBy("order_status").agg(N().alias("n"))
    return n.agg(F.min_by("order_status", F.struct(-F.col("n"), "order_status")).alias("mode"), F.round(F.max("n") / F.sum("n"), 8).alias("share"))


@R.query("WITH r AS (SELECT model_version AS seed, avg(score) AS m FROM prediction_log GROUP BY 1), a AS (SELECT avg(m) AS mean FROM r) SELECT round(mean, 8) AS mean, round(coalesce((SELECT stddev_samp(m) FROM r), 0), 8) AS std, round((SELECT min(m) FROM r), 8) AS low, round((SELECT max(m) FROM r), 8) AS high, (SELECT arg_min(seed, (abs(m - mean), seed)) FROM r, a) AS representative FROM a")
def ag36_multi_seed(spark, d):
    r = table(spark, d, "prediction_log").groupBy(F.col("model_version").alias("seed")).agg(F.avg("score").alias("m"))
    r = r.withColumn("mean", F.avg("m").over(Window.partitionBy(F.lit(0))))  # a row per seed
    return r.agg(F.round(F.first("mean"), 8).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 8).alias("std"), F.round(F.min("m"), 8).alias("low"), F.round(F.max("m"), 8).alias("high"), F.min_by("seed", F.struct(F.abs(F.col("m") - F.col("mean")), "seed")).alias("representative"))


@R.query("""WITH q AS (SELECT quantile_cont(n_chars, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS c FROM documents) SELECT CASE WHEN n_chars <= c[1] THEN 'short' WHEN n_chars <= c[2] THEN 'middle' ELSE 'long' END AS third, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents, q GROUP BY 1""")
def ag37_tertile_slices(spark, d):
    docs = table(spark, d, "documents")
    low, high = W.percentiles(docs, "n_chars", [1 / 3, 2 / 3])
    third = F.when(F.col("n_chars") <= low, "short").when(F.col("n_chars") <= high, "middle").otherwise("long")
    return docs.groupBy(third.alias("third")).agg(N().alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@R.query("""WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, count(DISTINCT l_partkey) AS parts, count(DISTINCT p_brand) AS brands, sum(p_size * l_quantity) AS volume FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT o_orderkey, coalesce(q, 0) AS quantity, greatest(coalesce(parts, 0), 1) AS n_parts, greatest(coalesce(brands, 0), 1) AS n_brands, coalesce(volume, 0) AS volume FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def ag38_order_header(spark, d):
    li, p, o = tables(spark, d, "lineitem", "part", "orders")
    per = li.join(p, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("p_brand").alias("n_brands"), F.sum(F.col("p_size") * F.col("l_quantity")).alias("volume"))
    rows = o.select("o_orderkey").join(per, "o_orderkey", "left").na.fill(0)
    return rows.select("o_orderkey", "quantity", F.greatest("n_parts", F.lit(1)).alias("n_parts"), F.greatest("n_brands", F.lit(1)).alias("n_brands"), "volume")


@R.query("WITH l AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS label), n AS (SELECT customer_rating AS label, count(*) AS n FROM split_assignments WHERE customer_rating IS NOT NULL GROUP BY 1) SELECT label, round((SELECT sum(n) FROM n) / CAST(6 * coalesce(n, 1) AS DOUBLE), 6) AS weight FROM l LEFT JOIN n USING (label)")
def ag39_class_weights(spark, d):
    n = P.value_counts(table(spark, d, "split_assignments").where("customer_rating is not null"), "customer_rating", [1, 2, 3, 4, 5, 6])
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select(F.col("value").alias("label"), F.round(total / (6 * F.greatest("n", F.lit(1))).cast("double"), 6).alias("weight"))


@R.query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS final_n FROM lineitem GROUP BY 1")
def ag40_pivot(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(N())
    return p.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open_n"), F.coalesce("F", F.lit(0)).alias("final_n"))


# --- top-k, order, pages


@R.query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def tk01_02_sorted(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(100)


@R.query("SELECT user_id, product_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, product_id) AS rank FROM (SELECT user_id, product_id, count(*) AS n FROM (SELECT DISTINCT order_id, product_id FROM order_products__prior WHERE product_id IS NOT NULL) JOIN (SELECT DISTINCT order_id, user_id FROM basket_orders) USING (order_id) GROUP BY 1, 2)) WHERE rank <= 3")
def tk03_top_per_user(spark, d):
    lines = table(spark, d, "order_products__prior").where("product_id is not null").select("order_id", "product_id").distinct()
    n = lines.join(table(spark, d, "basket_orders").select("order_id", "user_id").distinct(), "order_id").groupBy("user_id", "product_id").agg(N().alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "product_id"))).where("rank <= 3")


@R.query("SELECT doc_id FROM documents ORDER BY sha256(concat('s1:', doc_id)), doc_id LIMIT 50")
def tk04_hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("s1:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@R.query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT rn <= 200 AS newest, count(*) AS n, min(o_orderkey) AS least_key, max(o_orderkey) AS most_key FROM r GROUP BY 1")
def tk05_newest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    newest = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey")
    rest = o.join(newest, "o_orderkey", "left_anti").select("o_orderkey", F.lit(False).alias("newest"))
    both = newest.select("o_orderkey", F.lit(True).alias("newest")).unionByName(rest)
    return both.groupBy("newest").agg(N().alias("n"), F.min("o_orderkey").alias("least_key"), F.max("o_orderkey").alias("most_key"))


@R.query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def tk06_most_common(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(N().alias("n")).orderBy(F.desc("n"), "word").limit(20)


@R.query("WITH s AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT count(*) FILTER (WHERE rn <= greatest(1, ceil(n * 0.033))) AS n_ceil, count(*) FILTER (WHERE rn <= greatest(1, floor(n * 0.033))) AS n_floor, CAST(sum(event_id) FILTER (WHERE rn <= ceil(n * 0.033)) AS BIGINT) AS id_sum FROM s")
def tk07_08_top_share(spark, d):
    import math

    rows, n = W.positions(table(spark, d, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")])
    up, down = max(1, math.ceil(n * 0.033)), max(1, math.floor(n * 0.033))
    return rows.where(F.col("position") < up).agg(N().alias("n_ceil"), F.count_if(F.col("position") < down).alias("n_floor"), F.sum("event_id").alias("id_sum"))


@R.query("SELECT p_partkey, least_price FROM (SELECT p_partkey, min(coalesce(l_extendedprice, 0)) AS least_price FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) ORDER BY least_price, p_partkey LIMIT 12 OFFSET 24")
def tk09_10_page(spark, d):
    """The third page of twelve of a listing by least price."""
    li, p = tables(spark, d, "lineitem", "part")
    least = li.groupBy("l_partkey").agg(F.min(F.coalesce("l_extendedprice", F.lit(0.0))).alias("least_price"))
    rows = p.select("p_partkey").join(least, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("least_price", F.lit(0.0)).alias("least_price"))
    return rows.orderBy("least_price", "p_partkey").offset(24).limit(12)


@R.query("WITH c AS (SELECT l_orderkey, l_partkey, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS rn, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) SELECT l_orderkey, l_partkey, price, round((top - price) / top * 100, 4) AS discount FROM c WHERE rn = 1")
def tk11_cheapest(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(F.col("l_extendedprice").alias("price"), "l_partkey")).alias("b"), F.max("l_extendedprice").alias("top"))
    return best.select("l_orderkey", "b.l_partkey", "b.price", F.round((F.col("top") - F.col("b.price")) / F.col("top") * 100, 4).alias("discount"))


@R.query("SELECT user_id, coalesce(min(ts) FILTER (WHERE event_type = 'purchase'), min(ts)) AS first_time, count(*) AS n_lines, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def tk12_13_earliest(spark, d):
    bought = F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(bought, F.min("ts")).alias("first_time"), N().alias("n_lines"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


@R.query("SELECT order_id, approved FROM (WITH {o} SELECT order_id, approved FROM o) ORDER BY approved DESC NULLS LAST, order_id LIMIT 50".replace("{o}", ORDERS))
def tk14_newest_first(spark, d):
    return orders(spark, d).select("order_id", "approved").orderBy(F.desc_nulls_last("approved"), "order_id").limit(50)


@R.query("SELECT a.p_partkey, count(*) AS n_related FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1")
def tk16_related(spark, d):
    """How many other parts share brand and size: the group's size less one; no pair is made."""
    part = table(spark, d, "part")
    n = part.groupBy("p_brand", "p_size").agg(N().alias("n"))
    return part.join(n, ["p_brand", "p_size"]).where("n > 1").select("p_partkey", (F.col("n") - 1).alias("n_related"))


# --- sets


@R.query("SELECT a, b FROM (SELECT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey) UNION ALL SELECT s_nationkey, c_nationkey FROM customer JOIN supplier ON c_custkey = s_suppkey")
def so01_02_symmetrized(spark, d):
    c, s = tables(spark, d, "customer", "supplier")
    pairs = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y"))
    return pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.*")


@R.query("SELECT DISTINCT event_type, user_id FROM events")
def so03_distinct(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@R.query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def so04_keep_first(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_HALVES = "a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15')"


@R.query(f"WITH {_HALVES}, i AS (SELECT * FROM a INTERSECT SELECT * FROM b), e AS (SELECT * FROM b EXCEPT SELECT * FROM a), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT (SELECT count(*) FROM i) AS n_repeat, (SELECT count(*) FROM e) AS n_new, (SELECT count(*) FROM e) = 0 AS is_subset, round((SELECT count(*) FROM i) / CAST((SELECT count(*) FROM u) AS DOUBLE), 8) AS jaccard")
def so05_07_set_algebra(spark, d):
    """Intersection, difference, subset and Jaccard of two sets, from one aggregation over their members."""
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    m = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max(~late).alias("a"), F.max(late).alias("b"))
    both = F.col("a") & F.col("b")
    new = F.col("b") & ~F.col("a")
    return m.agg(F.count_if(both).alias("n_repeat"), F.count_if(new).alias("n_new"), (F.count_if(new) == 0).alias("is_subset"), F.round(F.count_if(both) / N(), 8).alias("jaccard"))

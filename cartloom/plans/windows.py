"""Window queries (WN) and the as-of join (JN10) over orders and their sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.operators import windows as W
from cartloom.plans.registry import Registry
from cartloom.session import cut
from cartloom.sources.tables import table, tables

R = Registry()

SELLER_ORDERS = """so AS (SELECT l_suppkey AS seller, o_orderkey AS id, o_orderdate AS ts, CAST(max(l_shipdate) > o_orderdate + INTERVAL 30 DAY AS INT) AS y,
  max(l_shipdate) AS known, o_custkey AS customer, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_suppkey, o_orderkey, o_orderdate, o_custkey)"""


def seller_orders(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and seller: y says whether its last line ships more than 30 days after the order."""
    orders, lines = tables(spark, d, "orders", "lineitem")
    lines = lines.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("known"), F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_suppkey").alias("seller"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("known") > F.expr("o_orderdate + interval 30 days")).cast("int").alias("y"), "known", F.col("o_custkey").alias("customer"), "n_lines", "qty", W.micros("o_orderdate").alias("us"))


_PART = "PARTITION BY seller ORDER BY ts, id"


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem")
def wn01_key_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))


@R.query("SELECT l_suppkey, l_partkey, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 5")
def wn02_top_per_group(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey"))).where("rank <= 5")


@R.query("SELECT user_id, order_id, order_number FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_number DESC, order_id) AS rn FROM (SELECT DISTINCT user_id, order_id, order_number FROM basket_orders WHERE eval_set = 'prior')) WHERE rn = 1")
def wn03_latest_per_user(spark, d):
    rows = table(spark, d, "basket_orders").where("eval_set = 'prior'")
    best = rows.groupBy("user_id").agg(F.min_by(F.struct("order_id", "order_number"), F.struct(-F.col("order_number"), "order_id")).alias("b"))
    return best.select("user_id", "b.*")


@R.query(f"WITH {SELLER_ORDERS} SELECT seller, id, row_number() OVER ({_PART}) - 1 AS prior_n, round(avg(y) OVER w, 8) AS prior_mean, round(stddev_samp(y) OVER w, 8) AS prior_std, quantile_cont(qty, 0.5) OVER w AS prior_median FROM so WINDOW w AS ({_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def wn04_07_seller_prior(spark, d):
    """Counts, means, deviations and medians of what came before; a large seller is split over tasks."""
    rows = cut(seller_orders(spark, d).select("seller", "id", "ts", "y", "qty"))
    cuts = W.cuts_of(rows, "seller", "ts")
    rows = W.prior_medians(W.prior_stats(rows, "seller", "ts", "id", ["y"], cuts), "seller", "ts", "id", "qty", "prior_median", cuts)
    return rows.select("seller", "id", F.col("prior_n").cast("bigint").alias("prior_n"), F.round("mean_y", 8).alias("prior_mean"), F.round("std_y", 8).alias("prior_std"), "prior_median")


@R.query(f"WITH {SELLER_ORDERS} SELECT seller, id, CAST(row_number() OVER ({_PART}) - 1 AS INT) AS prior_n, round(avg(y) OVER w, 8) AS prior_mean, round(stddev_samp(y) OVER w, 8) AS prior_std FROM so WINDOW w AS ({_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def wn04_06_prior_totals(spark, d):
    """The same counts, means and deviations from running sums that split a large seller over tasks."""
    rows = W.prior_totals(seller_orders(spark, d).select("seller", "id", "ts", "y"), "seller", "ts", "id", "y")
    return rows.select("seller", "id", "prior_n", F.round("prior_mean", 8).alias("prior_mean"), F.round("prior_std", 8).alias("prior_std"))


@R.query(f"WITH {SELLER_ORDERS} SELECT seller, id, round(CASE WHEN count(*) OVER w >= 3 THEN avg(y) OVER w END, 8) AS mean_30 FROM so WINDOW w AS ({_PART} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def wn08_rolling_30(spark, d):
    return seller_orders(spark, d).select("seller", "id", F.round(W.prior_rows(F.avg("y"), ["seller"], ["ts", "id"], 30, 3), 8).alias("mean_30"))


@R.query(f"""WITH {SELLER_ORDERS}, s AS (SELECT *, lag(y) OVER ({_PART}) AS v FROM so)
  SELECT a.seller, a.id, round(avg(b.v), 8) AS mean_30d, round(avg(c.v), 8) AS mean_90d FROM s a
  LEFT JOIN s c ON c.seller = a.seller AND c.ts > a.ts - INTERVAL 90 DAY AND (c.ts, c.id) <= (a.ts, a.id)
  LEFT JOIN s b ON b.seller = c.seller AND b.id = c.id AND b.ts > a.ts - INTERVAL 30 DAY GROUP BY 1, 2""")
def wn09_shifted_30d_90d(spark, d):
    rows = W.shifted_trailing_mean(seller_orders(spark, d), ["seller"], "us", "id", "y", 30, "m30")
    rows = W.shifted_trailing_mean(rows, ["seller"], "us", "id", "y", 90, "m90")
    return rows.select("seller", "id", F.round("m30", 8).alias("mean_30d"), F.round("m90", 8).alias("mean_90d"))


@R.query(f"WITH {SELLER_ORDERS} SELECT a.seller, a.id, count(b.id) AS load_7d FROM so a LEFT JOIN so b ON b.seller = a.seller AND b.ts >= a.ts - INTERVAL 7 DAY AND (b.ts, b.id) < (a.ts, a.id) GROUP BY 1, 2")
def wn10_load_7d(spark, d):
    return seller_orders(spark, d).select("seller", "id", W.trailing_load(["seller"], "us", "id", 7).alias("load_7d"))


@R.query(f"""WITH {SELLER_ORDERS}, s AS (SELECT *, lag(y) OVER ({_PART}) AS v FROM so), r AS (SELECT seller, id, CASE WHEN count(*) OVER w >= 3 THEN avg(y) OVER w END AS mean_rows FROM so WINDOW w AS ({_PART} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT a.seller, a.id, avg(b.v) AS mean_days FROM s a LEFT JOIN s b ON b.seller = a.seller AND b.ts > a.ts - INTERVAL 30 DAY AND (b.ts, b.id) <= (a.ts, a.id) GROUP BY 1, 2), l AS (SELECT a.seller, a.id, count(b.id) AS load FROM so a LEFT JOIN so b ON b.seller = a.seller AND b.ts >= a.ts - INTERVAL 7 DAY AND (b.ts, b.id) < (a.ts, a.id) GROUP BY 1, 2)
  SELECT seller, id, round(mean_rows, 8) AS mean_rows, round(mean_days, 8) AS mean_days, load FROM r JOIN m USING (seller, id) JOIN l USING (seller, id)""")
def wn08_10_split_windows(spark, d):
    """The same three frames from running sums and equi-joins on places, which split a large seller over tasks."""
    rows = W.split_trailing(seller_orders(spark, d).select("seller", "id", "ts", "y"), "seller", "ts", "id", "y", 30, 3, 30, 7)
    return rows.select("seller", "id", F.round("mean_rows", 8).alias("mean_rows"), F.round("mean_days", 8).alias("mean_days"), "load")


@R.query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS y FROM orders GROUP BY 1)
  SELECT a.day, CAST(sum(CASE WHEN b.day = a.day - 1 THEN b.n END) AS BIGINT) AS n_1d, CAST(sum(CASE WHEN b.day >= a.day - 7 THEN b.n END) AS BIGINT) AS n_7d, round(sum(CASE WHEN b.day >= a.day - 30 THEN b.y END) / CAST(sum(CASE WHEN b.day >= a.day - 30 THEN b.n END) AS DOUBLE), 8) AS rate_30d,
  round(sum(CASE WHEN b.day >= a.day - 90 THEN b.y END) / CAST(sum(CASE WHEN b.day >= a.day - 90 THEN b.n END) AS DOUBLE), 8) AS rate_90d, round(sum(b.y) / CAST(sum(b.n) AS DOUBLE), 8) AS rate_all FROM d a LEFT JOIN d b ON b.day < a.day GROUP BY 1""")
def wn11_store_wide(spark, d):
    """Store-wide history per day over the days before: aggregated per day first, so the one window partition has a row per day."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("y"))
    days = days.withColumn("k", F.datediff("day", F.lit("1970-01-01")))
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    total = lambda c, a: F.sum(c).over(w.rangeBetween(a, -1))
    rate = lambda a: F.round(total("y", a) / total("n", a), 8)
    return days.select("day", total("n", -1).alias("n_1d"), total("n", -7).alias("n_7d"), rate(-30).alias("rate_30d"), rate(-90).alias("rate_90d"), rate(Window.unboundedPreceding).alias("rate_all"))


@R.query(f"WITH {SELLER_ORDERS} SELECT seller, id, date_diff('day', min(ts) OVER (PARTITION BY seller), ts) AS tenure_days, date_diff('day', lag(ts) OVER ({_PART}), ts) AS gap_days FROM so")
def wn12_13_tenure_gap(spark, d):
    """Days since the seller's first order and since the one before; a large seller is split over tasks."""
    rows = cut(seller_orders(spark, d).select("seller", "id", "ts"))
    first = rows.groupBy("seller").agg(F.min("ts").alias("first"))
    both = W.previous_rows(rows, "seller", "ts", "id", ["ts"]).join(first, "seller")
    return both.select("seller", "id", F.datediff("ts", "first").cast("long").alias("tenure_days"), F.datediff("ts", "prev_ts").cast("long").alias("gap_days"))


@R.query("""WITH p AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY support DESC, item) AS rank, count(*) OVER () AS n FROM p)
  SELECT item, support, rank, round(1 - (rank - 1) / CAST(greatest(n - 1, 1) AS DOUBLE), 8) AS percentile FROM r""")
def wn14_popularity_rank(spark, d):
    p = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("support"))
    rows, n = W.positions(p, [F.desc("support"), F.col("item")])
    return rows.select("item", "support", (F.col("position") + 1).alias("rank"), F.round(1 - F.col("position") / F.lit(float(max(n - 1, 1))), 8).alias("percentile"))


@R.query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, ntile(7) OVER (ORDER BY month) AS period FROM m WHERE n >= 5""")
def wn15_ntile_periods(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return m.withColumn("period", F.ntile(7).over(Window.partitionBy(F.lit(0)).orderBy("month")).cast("long"))


_POS = "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders"


@R.query(f"WITH o AS ({_POS}) SELECT o_orderkey, CASE WHEN p < floor(n * 0.5) THEN 'fold0' WHEN p < floor(n * 0.65) THEN 'fold1' WHEN p < floor(n * 0.8) THEN 'fold2' ELSE 'last' END AS fold, p < floor(n * 0.85) AS development FROM o")
def wn16_chronological_folds(spark, d):
    rows, n = W.positions(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")])
    cut = lambda share: F.col("position") < int(n * share)
    return rows.select("o_orderkey", F.when(cut(0.5), "fold0").when(cut(0.65), "fold1").when(cut(0.8), "fold2").otherwise("last").alias("fold"), cut(0.85).alias("development"))


@R.query(f"WITH o AS ({_POS}) SELECT block, count(*) AS n_rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM (SELECT *, CASE WHEN p < n // 2 THEN 0 ELSE 1 + least(5, CAST(floor((p - n // 2) * 6 / CAST(n - n // 2 AS DOUBLE)) AS BIGINT)) END AS block FROM o) GROUP BY 1")
def wn17_prequential_blocks(spark, d):
    """The first half trains; the rest is cut into six blocks of equal size, each tested after the ones before it."""
    rows, n = W.positions(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")])
    half = n // 2
    late = F.floor((F.col("position") - half) * 6 / F.lit(float(max(n - half, 1))))
    block = F.when(F.col("position") < half, F.lit(0)).otherwise(1 + F.least(F.lit(5), late))
    return rows.groupBy(block.cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@R.query(f"WITH o AS ({_POS}) SELECT o_orderkey, round(pow(0.5, (n - 1 - p) / 5000.0::DOUBLE), 8) AS weight FROM o WHERE n - p <= 3000")
def wn18_19_recency_weights(spark, d):
    """The newest 3,000 orders, each weighted by half for every 5,000 orders of age."""
    rows, n = W.positions(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")])
    age = F.lit(n - 1) - F.col("position")
    return rows.where(age < 3000).select("o_orderkey", F.round(F.pow(F.lit(0.5), age / F.lit(5000.0)), 8).alias("weight"))


@R.query("SELECT p_partkey, CASE WHEN p_brand IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY p_brand) - 1 END AS brand_code FROM part")
def wn20_category_codes(spark, d):
    """0-based codes in the order of the sorted categories: ranked over the distinct values, then joined."""
    part = table(spark, d, "part")
    codes = W.positions(part.select("p_brand").where("p_brand is not null").distinct(), [F.col("p_brand")])[0].withColumnRenamed("position", "c")
    return part.join(codes, "p_brand", "left").select("p_partkey", F.coalesce(F.col("c"), F.lit(-1)).cast("long").alias("brand_code"))


@R.query("""WITH w AS (SELECT l_suppkey AS seller, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT seller, month, list(n) OVER w7 AS last_7 FROM w WINDOW w7 AS (PARTITION BY seller ORDER BY month ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT seller, month, array_to_string(last_7, ',') AS last_7 FROM s WHERE len(last_7) = 7""")
def wn21_trailing_sequence(spark, d):
    """The seven monthly counts before each month; months without seven before them are left out."""
    w = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seller"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    frame = Window.partitionBy("seller").orderBy("month").rowsBetween(-7, -1)
    return w.withColumn("s", F.collect_list("n").over(frame)).where(F.size("s") == 7).select("seller", "month", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("last_7"))


@R.query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents WHERE source IS NOT NULL)
  SELECT size, source, count(*) AS n, min(doc_id) AS least_id FROM r, (VALUES (5), (20), (80)) AS s(size) WHERE rn <= size GROUP BY ALL""")
def wn22_nested_subsets(spark, d):
    """Nested subsets of 5, 20 and 80 documents of each source, in hash order: a smaller one is part of every larger."""
    order = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    rows = table(spark, d, "documents").where("source is not null").select("doc_id", "source").withColumn("rn", F.row_number().over(order)).where("rn <= 80")
    sizes = rows.select("*", F.explode(F.filter(F.array(F.lit(5), F.lit(20), F.lit(80)), lambda s: s >= F.col("rn"))).alias("size"))
    return sizes.groupBy("size", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id"))


@R.query("SELECT text, doc_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY source NULLS LAST, doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def wn23_survivors(spark, d):
    best = F.struct(F.col("source").isNull(), "source", "doc_id")
    return table(spark, d, "documents").where("text is not null").groupBy("text").agg(F.min_by("doc_id", best).alias("doc_id"))


@R.query(f"WITH {SELLER_ORDERS} SELECT a.seller, a.id, count(b.id) AS prior_n, CAST(coalesce(sum(b.y), 0) AS DOUBLE) AS prior_sum FROM so a LEFT JOIN so b ON b.seller = a.seller AND b.known < a.ts GROUP BY 1, 2")
def jn10_asof_outcomes(spark, d):
    """Each order's seller history of outcomes that were known strictly before it."""
    so = seller_orders(spark, d)
    return W.asof_totals(so.select("seller", "id", "ts"), so, "seller", "ts", "known", "y").select("seller", "id", "prior_n", "prior_sum")

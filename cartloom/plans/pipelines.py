"""Sources and sinks (IO), reference splits (SP), composed feature queries (FQ), streams and rules (ST)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions.keys import clean_id, one_record, zip_code
from cartloom.operators import contracts as C
from cartloom.operators import preparation as D
from cartloom.operators import profile as P
from cartloom.operators import windows as W
from cartloom.plans.registry import Registry
from cartloom.plans.relational import ITEMS, ORDERS, PAYMENTS, items, orders, payments
from cartloom.session import cut
from cartloom.sources import io
from cartloom.sources.tables import TABLES, table
from cartloom.streaming import events as E

R = Registry()
#: The data sets that are described, and their keys.
FQ12 = {"olist_orders_dataset": "order_id", "olist_order_items_dataset": "order_id", "olist_order_payments_dataset": "order_id", "olist_customers_dataset": "customer_id", "basket_orders": "order_id", "order_products__prior": "product_id", "documents": "doc_id", "split_assignments": "group_key", "prediction_log": "prediction_id"}


def N():
    return F.count(F.lit(1))


# --- sources and sinks: written to the shared folder and read again


def _folder(spark: SparkSession, name: str) -> str:
    return E.new_folder(spark, name)


@R.query("SELECT * FROM part")
def io01_csv(spark, d):
    rows, path = table(spark, d, "part"), _folder(spark, "csv")
    rows.write.option("header", True).csv(path)
    return io.read_csv(spark, path, rows.schema)


@R.query("SELECT o_orderkey, o_orderdate, strptime('01/02/2003 04:05', '%m/%d/%Y %H:%M') AS fixed_time, CAST(NULL AS TIMESTAMP) AS bad_time FROM orders")
def io02_04_csv_times(spark, d):
    """Times as text in an ISO-8859-1 file; a pattern, and text that is no time."""
    path = _folder(spark, "latin1")
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.lit("01/02/2003 04:05").alias("fixed_time"), F.lit("não é").alias("bad_time"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = io.read_csv(spark, path, rows.schema, encoding="ISO-8859-1", multiLine="false")
    return io.parsed_times(io.parsed_times(back, ["o_orderdate", "bad_time"]), ["fixed_time"], "MM/dd/yyyy HH:mm")


@R.query("SELECT event_id, user_id, event_type, value FROM events")
def io05_14_15_jsonl(spark, d):
    """Compressed JSON lines, appended in two steps."""
    rows, path = table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), _folder(spark, "jsonl")
    for half in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        half.write.mode("append").option("compression", "gzip").json(path)
    return io.read_jsonl(spark, path, rows.schema, 8)


@R.query("SELECT p_partkey, p_name, concat('\"', p_brand) AS quoted FROM part")
def io06_tsv(spark, d):
    rows, path = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit('"'), "p_brand").alias("quoted")), _folder(spark, "tsv")
    rows.select(F.concat_ws("\t", *rows.columns)).write.text(path)
    return io.read_tsv(spark, path, rows.schema)


@R.query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def io07_tsv_strict(spark, d):
    path = _folder(spark, "strict")
    table(spark, d, "part").select(F.concat_ws("\t", "p_partkey", "p_brand")).write.text(path)
    return io.read_tsv_strict(spark, path, ["p_partkey", "p_brand"])


@R.query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def io09_12_16_parquet(spark, d):
    """Published as zstd Parquet and queried by its bare path."""
    path = _folder(spark, "published")
    io.publish(table(spark, d, "customer"), path)
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM parquet.`{path}` GROUP BY 1")


@R.query("SELECT column_name FROM (DESCRIBE SELECT * FROM documents)")
def io19_describe(spark, d):
    return spark.createDataFrame([(c,) for c, _ in table(spark, d, "documents").dtypes], "column_name string")


@R.query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def io21_json_keys(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(N().alias("n"))


@R.query()
def io21_file_facts(spark, d):
    """Bytes and SHA-256 of the files of all tables."""
    facts = [io.file_facts(spark, table(spark, d, t).inputFiles()).select(F.lit(t).alias("table_name"), "bytes", "sha256") for t in TABLES]
    return reduce(DataFrame.unionByName, facts)


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS n_columns FROM {t}" for t in TABLES))
def io20_footers(spark, d):
    """Rows and columns of every table from the footers of its files; no data is read."""
    facts = [io.footer_facts(table(spark, d, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_columns") for t in TABLES]
    return reduce(DataFrame.unionByName, facts).groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


@R.query(f"WITH {ORDERS}, {ITEMS}, {PAYMENTS} SELECT o.order_id, status, order_item_id, product_id, payment_type FROM o LEFT JOIN i USING (order_id) LEFT JOIN (SELECT order_id, payment_type FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY payment_sequential) AS rn FROM p) WHERE rn = 1) q USING (order_id)")
def io24_graph(spark, d):
    """Order, its items and its first payment, as one relation."""
    first = payments(spark, d).groupBy("order_id").agg(F.min_by("payment_type", "payment_sequential").alias("payment_type"))
    lines = items(spark, d).select("order_id", "order_item_id", "product_id")
    return orders(spark, d).select("order_id", "status").join(lines, "order_id", "left").join(first, "order_id", "left")


# --- splits of the reference


@R.query(f"WITH {ORDERS}, m AS (SELECT strftime(bought, '%Y-%m') AS month FROM o WHERE bought IS NOT NULL), f AS (SELECT unnest([1, 2, 3]) AS fold) SELECT fold, count(*) FILTER (WHERE month < CASE fold WHEN 1 THEN '2021-10' WHEN 2 THEN '2022-01' ELSE '2022-04' END) AS n_train, count(*) FILTER (WHERE month >= CASE fold WHEN 1 THEN '2021-10' WHEN 2 THEN '2022-01' ELSE '2022-04' END AND month < CASE fold WHEN 1 THEN '2022-01' WHEN 2 THEN '2022-04' ELSE '2022-07' END) AS n_valid FROM m, f GROUP BY 1")
def sp02_03_expanding_folds(spark, d):
    """Expanding training windows, each followed by a quarter of validation; one pass for all folds."""
    folds = [("2021-10", "2022-01"), ("2022-01", "2022-04"), ("2022-04", "2022-07")]
    month = F.date_format("bought", "yyyy-MM")
    row = orders(spark, d).where("bought is not null").agg(*[c for i, (a, b) in enumerate(folds) for c in (F.count_if(month < a).alias(f"t{i}"), F.count_if((month >= a) & (month < b)).alias(f"v{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.col(f"t{i}").alias("n_train"), F.col(f"v{i}").alias("n_valid")) for i in range(len(folds))])).alias("x")).select("x.*")


@R.query(f"WITH {ORDERS}, m AS (SELECT strftime(bought, '%Y-%m') AS month, count(*) AS n FROM o WHERE bought IS NOT NULL GROUP BY 1 HAVING count(*) >= 100), p AS (SELECT *, ntile(7) OVER (ORDER BY month) AS period FROM m) SELECT a.period AS test_period, CAST(sum(b.n) FILTER (WHERE b.period < a.period) AS BIGINT) AS n_train, CAST(sum(b.n) FILTER (WHERE b.period = a.period) AS BIGINT) AS n_test, a.period = 7 AS held_out FROM (SELECT DISTINCT period FROM p) a, p b WHERE a.period > 1 GROUP BY 1")
def sp04_rolling_origin(spark, d):
    m = orders(spark, d).where("bought is not null").groupBy(F.date_format("bought", "yyyy-MM").alias("month")).agg(N().alias("n")).where("n >= 100")
    p = m.withColumn("period", F.ntile(7).over(Window.partitionBy(F.lit(0)).orderBy("month"))).groupBy("period").agg(F.sum("n").alias("n_test"))
    before = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return p.select(F.col("period").cast("long").alias("test_period"), F.sum("n_test").over(before).alias("n_train"), "n_test", (F.col("period") == 7).alias("held_out")).where("test_period > 1")


_G = "g AS (SELECT lower(trim(sku)) AS item, count(*) AS n, sum(CAST(customer_rating <= 2 AS INT)) AS low FROM split_assignments WHERE trim(sku) <> '' GROUP BY 1), h AS (SELECT *, sha256(concat('h1:', item)) AS k, CASE WHEN low * 2 > n THEN 'low' ELSE 'high' END AS stratum FROM g)"


def rated_groups(spark, d):
    rows = table(spark, d, "split_assignments").select(clean_id("sku").alias("item"), "customer_rating").where("item is not null")
    g = rows.groupBy("item").agg(N().alias("n"), F.coalesce(F.sum((F.col("customer_rating") <= 2).cast("int")), F.lit(0)).alias("low"))
    return g.select("*", F.sha2(F.concat(F.lit("h1:"), "item"), 256).alias("k"), F.when(F.col("low") * 2 > F.col("n"), "low").otherwise("high").alias("stratum"))


@R.query(f"WITH {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k) - 1 AS p, count(*) OVER (PARTITION BY stratum) AS m FROM h) SELECT item, stratum, CASE WHEN p < floor(m * 0.7) THEN 'train' WHEN p < floor(m * 0.85) THEN 'validation' ELSE 'test' END AS part FROM r")
def sp05_stratified_groups(spark, d):
    """Whole items in 70/15/15, by their hash order within each stratum."""
    rows, m = W.positions_within(rated_groups(spark, d), ["stratum"], [F.col("k")]), F.col("n_rows").cast("double")
    part = F.when(F.col("position") < F.floor(m * 0.7), "train").when(F.col("position") < F.floor(m * 0.85), "validation").otherwise("test")
    return rows.select("item", "stratum", part.alias("part"))


_SP06 = "c AS (SELECT group_key, count(*) AS n, count(DISTINCT customer_rating) > 1 AS conflict FROM split_assignments WHERE group_key IS NOT NULL GROUP BY 1)"


@R.query(f"WITH {_SP06} SELECT policy, CASE policy WHEN 'remove' THEN count(*) FILTER (WHERE NOT conflict) ELSE count(*) END AS n_kept, count(*) FILTER (WHERE conflict) AS n_conflicting, CAST(sum(n - 1) FILTER (WHERE NOT conflict) AS BIGINT) AS n_repeats, CASE policy WHEN 'keep in train' THEN count(*) FILTER (WHERE conflict) ELSE 0 END AS n_flagged, policy = 'fail' AND count(*) FILTER (WHERE conflict) > 0 AS stopped FROM c, (VALUES ('remove'), ('keep in train'), ('fail')) AS p(policy) GROUP BY policy")
def sp06_policies(spark, d):
    """What each policy for texts with conflicting labels would keep, flag or stop: one aggregation, a row per policy."""
    c = table(spark, d, "split_assignments").where("group_key is not null").groupBy("group_key").agg(N().alias("n"), (F.min("customer_rating") != F.max("customer_rating")).alias("conflict"))
    a = c.agg(N().alias("all"), F.count_if("conflict").alias("x"), F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("n") - 1)), F.lit(0)).alias("r"))
    rows = a.select("*", F.explode(F.array(*[F.lit(p) for p in ("remove", "keep in train", "fail")])).alias("policy"))
    p = F.col("policy")
    return rows.select("policy", F.when(p == "remove", F.col("all") - F.col("x")).otherwise(F.col("all")).alias("n_kept"), F.col("x").alias("n_conflicting"), F.col("r").alias("n_repeats"), F.when(p == "keep in train", F.col("x")).otherwise(0).alias("n_flagged"), ((p == "fail") & (F.col("x") > 0)).alias("stopped"))


_PREPARED = """r AS (SELECT row_index, group_key, coalesce(CAST(customer_rating AS VARCHAR), '-') AS label FROM split_assignments WHERE group_key IS NOT NULL), g AS (SELECT group_key, min(row_index) AS first, min(label) <> max(label) AS conflict, min(label) AS label FROM r GROUP BY 1),
  q AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY sha256(concat('prepare:', group_key)), group_key) - 1) * 100 AS place, count(*) OVER (PARTITION BY label) AS n FROM g WHERE NOT conflict), f AS (SELECT group_key, first, conflict, CASE WHEN place < n * 70 THEN 'train' WHEN place < n * 85 THEN 'validation' ELSE 'internal_test' END AS split FROM q UNION ALL SELECT group_key, first, conflict, NULL FROM g WHERE conflict)"""


@R.query(f"""WITH {_PREPARED}, a AS (SELECT unnest(['REMOVE_FROM_ALL_SPLITS', 'KEEP_IN_TRAIN_ONLY_WITH_FLAG']) AS policy) SELECT policy, row_index, group_key, CASE WHEN conflict THEN CASE WHEN policy LIKE 'KEEP%' THEN 'train' END WHEN row_index = first THEN split END AS split, CASE WHEN conflict THEN policy NOT LIKE 'KEEP%' ELSE row_index <> first END AS excluded,
  CASE WHEN conflict AND policy NOT LIKE 'KEEP%' THEN 'CONFLICTING_LABEL_GROUP_REMOVED' WHEN NOT conflict AND row_index <> first THEN 'SAME_LABEL_DUPLICATE_REMOVED' END AS exclusion_reason, conflict AND policy LIKE 'KEEP%' AS flagged, CASE WHEN conflict AND policy LIKE 'KEEP%' THEN 'KEEP_IN_TRAIN_ONLY_WITH_FLAG_CONFLICT' END AS flag_reason FROM r JOIN f USING (group_key), a""")
def sp06_prepared_rows(spark, d):
    """What becomes of every row under either policy for texts with conflicting labels."""
    rows = table(spark, d, "split_assignments")
    parts = [D.prepared_rows(rows, "row_index", "group_key", "customer_rating", action).withColumn("policy", F.lit(action)) for action in (D.REMOVE, D.KEEP)]
    return parts[0].unionByName(parts[1])


@R.query(f"WITH {_PREPARED}, p AS (SELECT * FROM r JOIN f USING (group_key)) SELECT count(*) AS total_input_rows, count(DISTINCT group_key) AS unique_normalized_groups, count(DISTINCT group_key) FILTER (WHERE NOT conflict AND row_index <> first) AS same_label_duplicate_groups, count(*) FILTER (WHERE NOT conflict AND row_index <> first) AS same_label_duplicate_rows_removed, count(DISTINCT group_key) FILTER (WHERE conflict) AS conflicting_label_groups, count(*) FILTER (WHERE conflict) AS conflicting_label_rows_removed, CAST(0 AS BIGINT) AS conflicting_label_rows_flagged, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{x}' AND row_index = first) AS n_{x}" for x in ("train", "validation", "internal_test")) + " FROM p")
def sp06_audit(spark, d):
    return D.preparation_audit(D.prepared_rows(table(spark, d, "split_assignments"), "row_index", "group_key", "customer_rating", D.REMOVE))


@R.query()
def sp09_deficit_quotas(spark, d):
    """Items, smallest first, to the bucket that lacks most of what they have: four buckets of (low, high) ratings, and a fifth that changes nothing."""
    rows = table(spark, d, "split_assignments").select(clean_id("sku").alias("item"), (F.col("customer_rating") <= 2).alias("low")).where("item is not null and low is not null")
    groups = rows.groupBy("item").agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high"))
    return D.deficit_quotas(groups, {"val": (50, 50), "test_balanced": (100, 100), "test_representative": (60, 190), "train": (500, 500)}, {"val_natural": (12, 38)})


def quota_groups(groups: DataFrame, order: list, quotas: dict[str, float]) -> DataFrame:
    """groups (with n, their rows) plus bucket: whole groups in the given order until a bucket has its rows, then the next.

    A later bucket never changes an earlier one. Quotas are numbers of rows; groups beyond them have no bucket.
    """
    rows, _ = W.running_totals(groups, order, {"n": "n"})
    before, out, edge = F.col("cum_n") - F.col("n"), F.lit(None).cast("string"), 0.0
    for name, quota in quotas.items():
        out = F.when((before >= edge) & (before < edge + quota), name).otherwise(out)
        edge += quota
    return rows.withColumn("bucket", out).drop("cum_n")


@R.query(f"WITH {_G}, r AS (SELECT *, sum(n) OVER (ORDER BY k) - n AS before_n, sum(n) OVER () AS total FROM h) SELECT item, n, CASE WHEN before_n < 400 THEN 'a' WHEN before_n < 600 THEN 'b' WHEN before_n < 700 THEN 'c' WHEN before_n < 800 THEN 'd' WHEN before_n < 850 THEN 'extra' END AS bucket FROM r")
def sp07_09_quota_groups(spark, d):
    """Items dealt whole to buckets of 400, 200, 100 and 100 rows and a later fifth of 50."""
    return quota_groups(rated_groups(spark, d), [F.col("k")], {"a": 400, "b": 200, "c": 100, "d": 100, "extra": 50}).select("item", "n", "bucket")


@R.query(f"WITH {_G}, e AS (SELECT *, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS m FROM h WHERE n BETWEEN 3 AND 60) SELECT item FROM e WHERE rn <= ceil(m * 0.03)")
def sp11_item_sample(spark, d):
    """A sampling operator: 3 % of the items with 3 to 60 rows, in hash order."""
    rows, n = W.positions(rated_groups(spark, d).where("n between 3 and 60"), [F.col("k")])
    return rows.where(F.col("position") < -(-n * 3 // 100)).select("item")


_DOCS = "x AS (SELECT DISTINCT row_index AS id, customer_rating AS label, sha256(concat('s2:', row_index)) AS k FROM split_assignments WHERE customer_rating IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) - 1 AS p, count(*) OVER (PARTITION BY label) AS m FROM x)"


def labelled(spark, d):
    x = table(spark, d, "split_assignments").where("customer_rating is not null").select(F.col("row_index").alias("id"), F.col("customer_rating").alias("label")).distinct().withColumn("k", F.sha2(F.concat(F.lit("s2:"), F.col("id").cast("string")), 256))
    return W.positions_within(x, ["label"], [F.col("k"), F.col("id")]).withColumnsRenamed({"position": "p", "n_rows": "m"})


@R.query(f"WITH {_DOCS} SELECT id, label, CASE WHEN p < floor(m * 0.8) THEN 'train' WHEN p < floor(m * 0.9) THEN 'validation' ELSE 'test' END AS part, p < (SELECT min(m) FROM r) AS balanced FROM r")
def sp12_stratified(spark, d):
    """80/10/10 within each label, and the subset with as many rows of each label as the rarest has."""
    rows = labelled(spark, d)
    least = rows.agg(F.min("m")).first()[0] or 0
    m = F.col("m").cast("double")
    return rows.select("id", "label", F.when(F.col("p") < F.floor(m * 0.8), "train").when(F.col("p") < F.floor(m * 0.9), "validation").otherwise("test").alias("part"), (F.col("p") < least).alias("balanced"))


@R.query(f"WITH {_DOCS}, s AS (SELECT id, label, p < 12 AS own, row_number() OVER (ORDER BY p < 12 DESC, k, id) AS rn FROM r) SELECT id, label FROM s WHERE rn <= 80")
def sp14_stratified_sample(spark, d):
    """A sampling operator: 12 rows of each label, topped up to 80 with the next in hash order."""
    return labelled(spark, d).orderBy((F.col("p") < 12).desc(), "k", "id").limit(80).select("id", "label")


@R.query("WITH h AS (SELECT source, user_id, sha256(concat('g1:', user_id)) AS k FROM (SELECT DISTINCT source, lower(trim(user_id)) AS user_id FROM documents WHERE trim(user_id) <> '' AND source IS NOT NULL)), u AS (SELECT DISTINCT user_id, k FROM h), r AS (SELECT user_id, row_number() OVER (ORDER BY k) - 1 < floor((SELECT count(*) FROM u) * 0.85) AS train FROM u) SELECT source, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_test FROM h JOIN r USING (user_id) GROUP BY 1")
def sp17_group_shuffle(spark, d):
    """85/15 by user: each user on one side only."""
    h = table(spark, d, "documents").select("source", clean_id("user_id").alias("user_id")).where("user_id is not null and source is not null").distinct()
    u, n = W.positions(h.select("user_id").distinct().withColumn("k", F.sha2(F.concat(F.lit("g1:"), "user_id"), 256)), [F.col("k")])
    rows = h.join(u.select("user_id", (F.col("position") < int(n * 0.85 + 1e-9)).alias("train")), "user_id")
    return rows.groupBy("source").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))


# --- features


_STRICT = "year(bought) AS year, month(bought) AS month, dayofweek(bought) AS weekday, hour(bought) AS hour, CAST(dayofweek(bought) IN (0, 6) AS INT) AS weekend, date_diff('second', bought, approved) AS approval_seconds, CAST(delivered > due AS INT) AS late"


@R.query(f"WITH {ORDERS}, {ITEMS}, {PAYMENTS}, a AS (SELECT order_id, count(*) AS n_items, count(DISTINCT seller_id) AS n_sellers, round(sum(price), 2) AS price, round(sum(freight) / nullif(sum(price), 0), 6) AS freight_ratio FROM i GROUP BY 1), b AS (SELECT order_id, max(installments) AS installments FROM p GROUP BY 1) SELECT order_id, {_STRICT}, n_items, n_sellers, price, freight_ratio, installments FROM o LEFT JOIN a USING (order_id) LEFT JOIN b USING (order_id) WHERE status = 'delivered' AND bought IS NOT NULL AND delivered IS NOT NULL AND due IS NOT NULL AND approved >= bought")
def fq01_02_order_features(spark, d):
    """Calendar features at purchase, and item and payment aggregates (aggregated before they are joined)."""
    o = orders(spark, d).where("status = 'delivered' and bought is not null and delivered is not null and due is not null and approved >= bought")
    day = S.sunday_weekday("bought")
    strict = o.select("order_id", F.year("bought").alias("year"), F.month("bought").alias("month"), day.alias("weekday"), F.hour("bought").alias("hour"), day.isin(0, 6).cast("int").alias("weekend"), S.seconds_between("bought", "approved").alias("approval_seconds"), (F.col("delivered") > F.col("due")).cast("int").alias("late"))
    a = items(spark, d).groupBy("order_id").agg(N().alias("n_items"), F.countDistinct("seller_id").alias("n_sellers"), F.round(F.sum("price"), 2).alias("price"), F.round(F.try_divide(F.sum("freight"), F.sum("price")), 6).alias("freight_ratio"))
    b = payments(spark, d).groupBy("order_id").agg(F.max("installments").alias("installments"))
    rows = strict.join(a, "order_id", "left").join(b, "order_id", "left")
    return rows


_CENTRE = "z AS (SELECT lpad(trim(geolocation_zip_code_prefix), 5, '0') AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng FROM (SELECT DISTINCT * FROM olist_geolocation_dataset) WHERE geolocation_lat <> 0 GROUP BY 1)"


def centroids(spark, d):
    rows = table(spark, d, "olist_geolocation_dataset").distinct().where("geolocation_lat <> 0")
    return rows.groupBy(zip_code("geolocation_zip_code_prefix").alias("zip")).agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))


@R.query(f"""WITH {ORDERS}, {ITEMS}, {_CENTRE}, f AS (SELECT order_id, arg_min(seller_id, order_item_id) AS seller_id, min(deadline) AS deadline FROM i WHERE seller_id IS NOT NULL GROUP BY 1), c AS (SELECT customer_id, any_value(lpad(nullif(trim(customer_zip_code_prefix), ''), 5, '0')) AS zip, any_value(customer_state) AS customer_state FROM olist_customers_dataset GROUP BY 1), s AS (SELECT seller_id, any_value(lpad(nullif(trim(seller_zip_code_prefix), ''), 5, '0')) AS zip, any_value(seller_state) AS seller_state FROM olist_sellers_dataset GROUP BY 1)
  SELECT o.order_id, f.seller_id, concat_ws('->', seller_state, customer_state) AS lane, round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))), 4) AS km, round((epoch_us(deadline) - epoch_us(shipped)) / 86400000000.0::DOUBLE, 9) AS slack_days FROM o JOIN f USING (order_id) LEFT JOIN c USING (customer_id) LEFT JOIN s ON s.seller_id = f.seller_id LEFT JOIN z a ON a.zip = s.zip LEFT JOIN z b ON b.zip = c.zip""")
def fq03_06_08_canonical(spark, d):
    """One row per order: first seller, lane, distance between the zip centroids, days left at the handoff."""
    f = items(spark, d).where("seller_id is not null").groupBy("order_id").agg(F.min_by("seller_id", "order_item_id").alias("seller_id"), F.min("deadline").alias("deadline"))
    c = one_record(table(spark, d, "olist_customers_dataset"), ["customer_id"], ["customer_zip_code_prefix", "customer_state"]).select("customer_id", zip_code("customer_zip_code_prefix").alias("zip_b"), "customer_state")
    s = one_record(table(spark, d, "olist_sellers_dataset"), ["seller_id"], ["seller_zip_code_prefix", "seller_state"]).select("seller_id", zip_code("seller_zip_code_prefix").alias("zip_a"), "seller_state")
    z = centroids(spark, d)
    at = lambda side: z.select(F.col("zip").alias(f"zip_{side}"), F.col("lat").alias(f"lat_{side}"), F.col("lng").alias(f"lng_{side}"))
    rows = orders(spark, d).select("order_id", "customer_id", "shipped").join(f, "order_id").join(c, "customer_id", "left").join(s, "seller_id", "left").join(at("a"), "zip_a", "left").join(at("b"), "zip_b", "left")
    km = S.haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return rows.select("order_id", "seller_id", F.concat_ws("->", "seller_state", "customer_state").alias("lane"), F.round(km, 4).alias("km"), F.round(S.days_between("shipped", "deadline"), 9).alias("slack_days"))


_BREACH = "c AS (SELECT order_id, min(seller_id) AS seller, min(deadline) AS deadline, sum(price) AS price, sum(freight) AS freight FROM i GROUP BY 1 HAVING count(DISTINCT seller_id) = 1 AND count(seller_id) = count(*) AND count(DISTINCT deadline) = 1), k AS (SELECT order_id AS id, seller, bought AS ts, CAST(shipped > deadline AS INT) AS y, price, freight, delivered FROM o JOIN c USING (order_id) WHERE bought IS NOT NULL AND shipped IS NOT NULL)"


def breaches(spark, d) -> DataFrame:
    one = (F.min("seller_id") == F.max("seller_id")) & (F.min("deadline") == F.max("deadline")) & (F.count("seller_id") == N())
    c = items(spark, d).groupBy("order_id").agg(F.min("seller_id").alias("seller"), F.min("deadline").alias("deadline"), F.sum("price").alias("price"), F.sum("freight").alias("freight"), one.alias("one")).where("one")
    rows = orders(spark, d).where("bought is not null and shipped is not null").join(c, "order_id")
    return rows.select(F.col("order_id").alias("id"), "seller", F.col("bought").alias("ts"), (F.col("shipped") > F.col("deadline")).cast("int").alias("y"), "price", "freight", "delivered", W.micros("bought").alias("us"))


@R.query(f"""WITH {ORDERS}, {ITEMS}, {_BREACH}, dd AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(y) AS y FROM k GROUP BY 1) SELECT a.day, CAST(coalesce(sum(b.n) FILTER (WHERE b.day >= a.day - 7), 0) AS BIGINT) AS n_7d, round(sum(b.y) FILTER (WHERE b.day >= a.day - 30) / CAST(sum(b.n) FILTER (WHERE b.day >= a.day - 30) AS DOUBLE), 8) AS rate_30d FROM dd a LEFT JOIN dd b ON b.day < a.day GROUP BY 1""")
def fq07_store_days(spark, d):
    dd = breaches(spark, d).groupBy(F.to_date("ts").alias("day")).agg(N().alias("n"), F.sum("y").alias("y")).withColumn("k", F.datediff("day", F.lit("1970-01-01")))
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    total = lambda c, a: F.sum(c).over(w.rangeBetween(-a, -1))
    return dd.select("day", F.coalesce(total("n", 7), F.lit(0)).alias("n_7d"), F.round(total("y", 30) / total("n", 30), 8).alias("rate_30d"))


@R.query(f"""WITH {ORDERS}, u AS (SELECT customer_id, any_value(customer_unique_id) AS person FROM olist_customers_dataset GROUP BY 1), x AS (SELECT order_id, person, bought, delivered, CAST(delivered > due AS INT) AS late FROM o JOIN u USING (customer_id) WHERE bought IS NOT NULL AND person IS NOT NULL) SELECT a.order_id, count(b.order_id) AS prior_n, CAST(coalesce(sum(b.late), 0) AS DOUBLE) AS prior_sum FROM x a LEFT JOIN x b ON b.person = a.person AND b.delivered < a.bought AND b.late IS NOT NULL GROUP BY 1""")
def fq08_customer_history(spark, d):
    """A person's late deliveries that were known before each order."""
    u = one_record(table(spark, d, "olist_customers_dataset"), ["customer_id"], ["customer_unique_id"])
    x = orders(spark, d).where("bought is not null").join(u, "customer_id").where("customer_unique_id is not null").select("order_id", F.col("customer_unique_id").alias("person"), "bought", "delivered", (F.col("delivered") > F.col("due")).cast("int").alias("late"))
    return W.asof_totals(x.select("order_id", "person", "bought"), x.where("late is not null"), "person", "bought", "delivered", "late").select("order_id", "prior_n", "prior_sum")


@R.query("""WITH v AS (SELECT seller_id, min(recorded_at) AS won, arg_min(seller_tier, (recorded_at, history_id)) AS tier FROM (SELECT DISTINCT * FROM seller_history) GROUP BY 1), e AS (SELECT lower(trim(order_id)) AS order_id, any_value(order_purchase_timestamp) AS bought FROM olist_orders_dataset GROUP BY 1), f AS (SELECT lower(trim(order_id)) AS order_id, min(seller_id) AS seller_id FROM olist_order_items_dataset WHERE seller_id IS NOT NULL GROUP BY 1)
  SELECT order_id, CASE WHEN won <= bought THEN tier END AS tier, CASE WHEN won <= bought THEN date_diff('second', won, bought) ELSE -1 END AS age_seconds FROM e JOIN f USING (order_id) LEFT JOIN v USING (seller_id) WHERE bought IS NOT NULL""")
def fq09_known_tier(spark, d):
    """A seller's first recorded tier, masked where it was not yet known at the order."""
    v = table(spark, d, "seller_history").groupBy("seller_id").agg(F.min("recorded_at").alias("won"), F.min_by("seller_tier", F.struct("recorded_at", "history_id")).alias("tier"))
    f = items(spark, d).where("seller_id is not null").groupBy("order_id").agg(F.min("seller_id").alias("seller_id"))
    known = F.col("won") <= F.col("bought")
    rows = orders(spark, d).where("bought is not null").select("order_id", "bought").join(f, "order_id").join(v, "seller_id", "left")
    return rows.select("order_id", F.when(known, F.col("tier")).alias("tier"), F.when(known, S.seconds_between("won", "bought")).otherwise(-1).alias("age_seconds"))


def node_days(spark, d):
    """node (state), day, n, s: delivered orders bought on that day and their days to delivery; n_late, late: those that had a due time and their seconds of delay."""
    n = one_record(table(spark, d, "olist_customers_dataset"), ["customer_id"], ["customer_state"]).withColumnRenamed("customer_state", "node")
    x = orders(spark, d).where("bought is not null and delivered is not null").join(n, "customer_id").where("node is not null")
    return x.groupBy("node", F.to_date("bought").alias("day")).agg(N().alias("n"), F.sum(S.seconds_between("bought", "delivered") / F.lit(86400.0)).alias("s"), F.count("due").alias("n_late"), F.sum(S.seconds_between("due", "delivered")).alias("late"))


def _windows_of(per, first, last):
    """For each node and start day from first to last, the 14 days from it and the 14 after, over a dense grid of days; delays in seconds."""
    days = F.sequence(F.lit(first), F.lit(last + dt.timedelta(27)))
    grid = per.select("node").distinct().select("node", F.explode(days).alias("day"))
    dense = grid.join(per, ["node", "day"], "left")
    w = Window.partitionBy("node").orderBy("day")
    total = lambda c, a, b: F.sum(c).over(w.rowsBetween(a, b))
    mean = lambda a, b: F.round(F.try_divide(total("s", a, b), total("n", a, b)), 9)
    delay = lambda a, b: F.try_divide(total("late", a, b).cast("double"), total("n_late", a, b))
    out = dense.select("node", F.col("day").alias("start"), F.coalesce(total("n", 0, 13), F.lit(0)).alias("n_before"), mean(0, 13).alias("mean_before"), F.coalesce(total("n", 14, 27), F.lit(0)).alias("n_after"), mean(14, 27).alias("mean_after"), delay(0, 13).alias("delay_before"), delay(14, 27).alias("delay_after"))
    return out.where(F.col("start") <= last)


@R.query(f"""WITH {ORDERS}, c AS (SELECT customer_id, any_value(customer_state) AS node FROM olist_customers_dataset GROUP BY 1), x AS (SELECT node, CAST(bought AS DATE) AS day, date_diff('second', bought, delivered) / 86400.0::DOUBLE AS days, date_diff('second', due, delivered) AS late FROM o JOIN c USING (customer_id) WHERE bought IS NOT NULL AND delivered IS NOT NULL AND node IS NOT NULL),
  e AS (SELECT min(day) AS a, max(day) - 28 AS b, date_diff('day', min(day), max(day)) - 27 AS n FROM x), g AS (SELECT node, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS start FROM (SELECT DISTINCT node FROM x), e),
  u AS (SELECT node, late FROM x, e WHERE late IS NOT NULL AND day < a + CAST(round(0.70 * n) AS INT) + 27), m AS (SELECT node, sum(late) / CAST(count(*) AS DOUBLE) AS mu FROM u GROUP BY 1),
  w AS (SELECT g.node, g.start, count(x.day) FILTER (WHERE x.day < g.start + 14) AS n_before, round(avg(days) FILTER (WHERE x.day < g.start + 14), 9) AS mean_before, count(x.day) FILTER (WHERE x.day >= g.start + 14) AS n_after, round(avg(days) FILTER (WHERE x.day >= g.start + 14), 9) AS mean_after,
    sum(late) FILTER (WHERE x.day < g.start + 14) / CAST(count(late) FILTER (WHERE x.day < g.start + 14) AS DOUBLE) AS db, sum(late) FILTER (WHERE x.day >= g.start + 14) / CAST(count(late) FILTER (WHERE x.day >= g.start + 14) AS DOUBLE) AS da FROM g LEFT JOIN x ON x.node = g.node AND x.day >= g.start AND x.day < g.start + 28 GROUP BY 1, 2),
  y AS (SELECT w.*, coalesce(m.mu, (SELECT sum(late) / CAST(count(*) AS DOUBLE) FROM u)) AS own, date_diff('day', (SELECT a FROM e), start) AS at_day FROM w LEFT JOIN m USING (node))
  SELECT node, start, n_before, mean_before, n_after, mean_after, round(db / 86400, 9) AS delay_before, round(da / 86400, 9) AS delay_after, round(own / 86400, 9) AS mu, CAST(da > own AS INT) AS worse,
    CASE WHEN at_day < (SELECT CAST(round(0.70 * n) AS INT) FROM e) THEN 'train' WHEN at_day < (SELECT CAST(round(0.70 * n) AS INT) + CAST(round(0.15 * n) AS INT) FROM e) THEN 'val' ELSE 'test' END AS part FROM y""")
def fq10_node_windows(spark, d):
    """Every state and start day up to 28 days before the last order, in parts of 70/15/15 % of the starts.

    mu is the state's mean delay (delivered less due, in days) over the orders of the train part's windows, that of all states
    where it has none; worse: whether the 14 days after have a larger mean, null where no delay is known.
    """
    per = cut(node_days(spark, d))
    first, end = per.agg(F.min("day"), F.max("day")).first()
    if first is None or end - first < dt.timedelta(28):  # no whole window
        first, last, n = dt.date(1970, 1, 2), dt.date(1970, 1, 1), 0
    else:
        last = end - dt.timedelta(28)
        n = (last - first).days + 1
    n_train, n_val = round(0.70 * n), round(0.15 * n)
    pool = per.where(F.col("day") < first + dt.timedelta(n_train - 1 + 28))
    late = F.try_divide(F.sum("late").cast("double"), F.sum("n_late"))
    everywhere = pool.agg(late).first()[0]
    mu = pool.groupBy("node").agg(late.alias("own"))
    rows = _windows_of(per, first, last).join(mu, "node", "left").withColumn("mu", F.coalesce("own", F.lit(everywhere).cast("double")))
    at = F.datediff("start", F.lit(first))
    days = lambda c: F.round(F.col(c) / 86400.0, 9).alias(c)
    return rows.select(
        "node", "start", "n_before", "mean_before", "n_after", "mean_after", days("delay_before"), days("delay_after"), days("mu"), (F.col("delay_after") > F.col("mu")).cast("int").alias("worse"),
        F.when(at < n_train, "train").when(at < n_train + n_val, "val").otherwise("test").alias("part"),
    )


@R.query("SELECT order_status, count(*) AS n, count(*) - count(order_approved_at) AS no_approval, count(*) - count(order_delivered_carrier_date) AS no_carrier, count(*) - count(order_delivered_customer_date) AS no_delivery FROM olist_orders_dataset GROUP BY 1")
def fq11_event_audit(spark, d):
    miss = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, d, "olist_orders_dataset").groupBy("order_status").agg(N().alias("n"), miss("order_approved_at").alias("no_approval"), miss("order_delivered_carrier_date").alias("no_carrier"), miss("order_delivered_customer_date").alias("no_delivery"))


@R.query("SELECT (SELECT count(DISTINCT order_id) FROM order_products__prior) AS n_baskets, (SELECT count(*) FROM (SELECT DISTINCT order_id FROM order_products__prior) p WHERE NOT EXISTS (SELECT 1 FROM basket_orders b WHERE b.order_id = p.order_id)) AS n_orphans, (SELECT count(*) FILTER (WHERE days_since_prior_order IS NULL) FROM basket_orders) AS n_first")
def fq12_observations(spark, d):
    p = table(spark, d, "order_products__prior").select("order_id").where("order_id is not null").distinct()
    b = table(spark, d, "basket_orders")
    marked = p.join(b.select("order_id").distinct().withColumn("known", F.lit(1)), "order_id", "left").agg(N().alias("n_baskets"), F.count_if(F.col("known").isNull()).alias("n_orphans"))
    first = b.where("days_since_prior_order is null").count()
    return marked.withColumn("n_first", F.lit(first).cast("bigint"))


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys, count(*) - count({k}) AS n_null_keys FROM {t}" for t, k in FQ12.items()))
def fq12_datasets(spark, d):
    """Rows, keys and null keys of every data set of the reference's kinds: orders, baskets, texts, predictions."""
    parts = [table(spark, d, t).agg(F.lit(t).alias("dataset"), N().alias("n_rows"), F.countDistinct(k).alias("n_keys"), F.count_if(F.col(k).isNull()).alias("n_null_keys")) for t, k in FQ12.items()]
    return reduce(DataFrame.unionByName, parts)


@R.query("WITH s AS (SELECT order_status, count(*) AS n FROM olist_orders_dataset GROUP BY 1), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT customer_rating, count(*) AS n FROM split_assignments GROUP BY 1) SELECT 'orders' AS dataset, order_status AS value, n FROM s UNION ALL SELECT 'texts', lang, n FROM c UNION ALL SELECT 'ratings', CAST(customer_rating AS VARCHAR), n FROM r")
def fq12_values(spark, d):
    """How often each status, language label and rating occurs."""
    parts = [table(spark, d, t).groupBy(F.col(c).cast("string").alias("value")).agg(N().alias("n")).select(F.lit(name).alias("dataset"), "value", "n") for name, t, c in (("orders", "olist_orders_dataset", "order_status"), ("texts", "documents", "lang"), ("ratings", "split_assignments", "customer_rating"))]
    return reduce(DataFrame.unionByName, parts)


# --- events and rules


@R.query("SELECT lower(trim(order_id)) AS order_id, min(loaded_at) AS loaded_at FROM olist_orders_dataset WHERE trim(order_id) <> '' GROUP BY 1")
def st01_02_events_once(spark, d):
    """Placed orders as a stream of files; an order that is delivered again changes nothing."""
    stream = E.file_stream(spark, f"{d}/olist_orders_dataset.parquet").select(clean_id("order_id").alias("order_id"), "loaded_at")
    return E.handle_once(stream, "order_id", ["loaded_at"], _folder(spark, "log"), _folder(spark, "offsets"))


@R.query(f"WITH {ORDERS}, f AS (SELECT lower(trim(order_id)) AS order_id, min(seller_id) AS seller_id FROM olist_order_items_dataset GROUP BY 1) SELECT order_id, CASE WHEN bought IS NULL THEN 'NO_TIME' WHEN f.order_id IS NULL THEN 'NO_ITEMS' WHEN f.seller_id IS NULL THEN 'INSUFFICIENT_FEATURES' ELSE 'READY' END AS status FROM o LEFT JOIN f USING (order_id)")
def st03_05_feature_status(spark, d):
    f = items(spark, d).groupBy("order_id").agg(F.min("seller_id").alias("seller_id"), F.lit(True).alias("has"))
    rows = orders(spark, d).select("order_id", "bought").join(f, "order_id", "left")
    status = C.first_match([(F.col("bought").isNull(), {"status": "NO_TIME"}), (F.col("has").isNull(), {"status": "NO_ITEMS"}), (F.col("seller_id").isNull(), {"status": "INSUFFICIENT_FEATURES"})], {"status": "READY"})
    return rows.select("order_id", *status)


@R.query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'urgent' WHEN event_type = 'error' THEN 'look' WHEN value > 90 THEN 'note' ELSE 'none' END AS action, CASE WHEN event_type = 'error' AND value > 50 THEN 0 WHEN event_type = 'error' THEN 1 WHEN value > 90 THEN 2 ELSE 3 END AS priority, concat_ws(',', CASE WHEN event_type = 'error' THEN 'ERROR' END, CASE WHEN value > 50 THEN 'LARGE' END) AS reasons, CASE WHEN value >= 66 THEN 'HIGH' WHEN value >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events")
def st06_07_first_match(spark, d):
    """Ordered rules: the first that holds gives the action; reasons and a band beside it. The rules are settings, not the engine's."""
    error, value = F.col("event_type") == "error", F.col("value")
    chosen = C.first_match([(error & (value > 50), {"action": "urgent", "priority": 0}), (error, {"action": "look", "priority": 1}), (value > 90, {"action": "note", "priority": 2})], {"action": "none", "priority": 3})
    reasons = F.array_compact(F.array(F.when(error, F.lit("ERROR")), F.when(value > 50, F.lit("LARGE"))))
    return table(spark, d, "events").select("event_id", *chosen, F.array_join(reasons, ",").alias("reasons"), F.when(value >= 66, "HIGH").when(value >= 33, "MEDIUM").otherwise("LOW").alias("band"))


@R.query("SELECT 'score in [0, 1]' AS rule, count(*) FILTER (WHERE NOT (score BETWEEN 0 AND 1)) AS n FROM prediction_log UNION ALL SELECT 'has a time', count(*) FILTER (WHERE features_as_of IS NULL) FROM prediction_log UNION ALL SELECT 'digest of 64 characters', count(*) FILTER (WHERE length(artifact_sha256) <> 64) FROM prediction_log")
def st08_bounds(spark, d):
    return P.counts_of(table(spark, d, "prediction_log"), {"score in [0, 1]": ~F.col("score").between(0, 1), "has a time": F.col("features_as_of").isNull(), "digest of 64 characters": F.length("artifact_sha256") != 64})


@R.query("SELECT prediction_id, min(score) AS score, min(decision) AS outcome FROM prediction_log GROUP BY 1")
def st09_append_log(spark, d):
    """Predictions and outcomes appended as JSON lines by two writers, read again and joined by the prediction."""
    log, path = table(spark, d, "prediction_log"), _folder(spark, "predictions")
    one = log.groupBy("prediction_id").agg(F.min("score").alias("score"), F.min("decision").alias("outcome"))
    io.append_jsonl(one.select("prediction_id", "score"), path)
    io.append_jsonl(one.select("prediction_id", "outcome"), path)
    rows = io.read_jsonl(spark, path, "prediction_id string, score double, outcome string")
    return rows.groupBy("prediction_id").agg(F.max("score").alias("score"), F.max("outcome").alias("outcome"))


@R.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st11_windowed(spark, d):
    """An extension: daily counts of a stream with a watermark."""
    stream = E.file_stream(spark, f"{d}/events.parquet")
    return E.windowed_counts(stream, "ts", "1 day", "2 days", ["event_type"], _folder(spark, "windows"), _folder(spark, "offsets"))

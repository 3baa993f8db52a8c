"""Recommendation queries (RC): each user's last basket is the truth, all before it the history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.operators import baskets as B
from cartloom.operators import windows as W
from cartloom.plans.registry import Registry
from cartloom.session import cut
from cartloom.sources.tables import table

R = Registry()
K = 5


def N():
    return F.count(F.lit(1))


BASE = """b AS (SELECT DISTINCT order_id, user_id, order_number FROM basket_orders WHERE eval_set = 'prior' AND user_id IS NOT NULL), l AS (SELECT order_id, product_id, min(add_to_cart_order) AS pos, max(reordered) AS re FROM order_products__prior WHERE product_id IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT user_id, order_id, order_number, product_id, pos, re, max(order_number) OVER (PARTITION BY user_id) AS last_no FROM l JOIN b USING (order_id)), old AS (SELECT * FROM j WHERE order_number < last_no), truth AS (SELECT DISTINCT user_id, product_id FROM j WHERE order_number = last_no),
  hist AS (SELECT user_id, product_id, count(*) AS freq, CAST(sum(re) AS BIGINT) AS re, max(order_number) AS seen, max(last_no) - max(order_number) AS gap FROM old GROUP BY 1, 2), pop AS (SELECT product_id, count(DISTINCT order_id) AS support FROM old GROUP BY 1),
  best AS (SELECT product_id, row_number() OVER (ORDER BY support DESC, product_id) AS rank FROM pop)"""


@dataclass
class Baskets:
    """What the recommenders share, made once and kept: lines of all baskets but the last of each user, and those of the last."""

    old: DataFrame
    truth: DataFrame
    history: DataFrame

    @property
    def support(self) -> DataFrame:
        return B.popularity(self.old.select("order_id", "product_id").distinct())


def baskets(spark: SparkSession, d: str) -> Baskets:
    b = table(spark, d, "basket_orders").where("eval_set = 'prior' and user_id is not null").select("order_id", "user_id", "order_number").distinct()
    lines = table(spark, d, "order_products__prior").where("product_id is not null").groupBy("order_id", "product_id").agg(F.min("add_to_cart_order").alias("pos"), F.max("reordered").alias("re"))
    joined = lines.join(b, "order_id")
    last = joined.groupBy("user_id").agg(F.max("order_number").alias("last_no"))
    joined = cut(joined.join(last, "user_id"))
    old = joined.where("order_number < last_no")
    truth = joined.where("order_number = last_no").select("user_id", "product_id").distinct()
    history = old.groupBy("user_id", "product_id").agg(N().alias("freq"), F.sum("re").alias("re"), F.max("order_number").alias("seen"), (F.max("last_no") - F.max("order_number")).alias("gap"))
    return Baskets(old, truth, cut(history))


@R.query(f"WITH {BASE} SELECT product_id, support, rank, round(1 - (rank - 1) / CAST(greatest((SELECT count(*) FROM pop) - 1, 1) AS DOUBLE), 8) AS percentile FROM pop JOIN best USING (product_id)")
def rc01_popularity(spark, d):
    rows, n = W.positions(baskets(spark, d).support, [F.desc("support"), F.col("product_id")])
    return rows.select("product_id", "support", (F.col("position") + 1).alias("rank"), F.round(1 - F.col("position") / F.lit(float(max(n - 1, 1))), 8).alias("percentile"))


@R.query(f"WITH {BASE} SELECT user_id, product_id, freq, re, seen, gap FROM hist")
def rc02_03_history(spark, d):
    return baskets(spark, d).history


@R.query(f"WITH {BASE} SELECT user_id, product_id, pos FROM old WHERE order_number = (SELECT max(order_number) FROM old o WHERE o.user_id = old.user_id)")
def rc04_latest_order(spark, d):
    rows = baskets(spark, d).old
    last = rows.groupBy("user_id").agg(F.max("order_number").alias("order_number"))
    return rows.join(last, ["user_id", "order_number"]).select("user_id", "product_id", "pos")


_NB = "n AS (SELECT count(DISTINCT order_id) AS n FROM old), p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n_both FROM old x JOIN old y ON x.order_id = y.order_id AND x.product_id <> y.product_id GROUP BY 1, 2 HAVING count(*) >= 10), nb AS (SELECT * FROM (SELECT a AS product_id, b AS neighbour, n_both, n_both * CAST(n AS DOUBLE) / (sa.support * sb.support) * n_both / (n_both + 20.0::DOUBLE) AS lift, row_number() OVER (PARTITION BY a ORDER BY round(n_both * CAST(n AS DOUBLE) / (sa.support * sb.support) * n_both / (n_both + 20.0::DOUBLE), 9) DESC, b) AS rank FROM p JOIN pop sa ON sa.product_id = a JOIN pop sb ON sb.product_id = b, n) WHERE rank <= 50)"


@R.query(f"WITH {BASE}, {_NB} SELECT product_id, neighbour, n_both, round(lift, 6) AS lift, rank FROM nb")
def rc05_neighbours(spark, d):
    return B.neighbours(baskets(spark, d).old.select("order_id", "product_id").distinct()).withColumn("lift", F.round("lift", 6))


@R.query(f"WITH {BASE}, u AS (SELECT DISTINCT user_id FROM hist) SELECT user_id, product_id, rank FROM u, best WHERE rank <= {K}")
def rc06_global(spark, d):
    b = baskets(spark, d)
    return B.from_popularity(b.history.select("user_id").distinct(), b.support, K)


def ranked_history(b: Baskets, order):
    return B.top_k(b.history, K, order).select("user_id", "product_id", "rank")


def _by(order: str) -> str:
    return f"WITH {BASE} SELECT user_id, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, product_id) AS rank FROM hist) WHERE rank <= {K}"


@R.query(_by("freq DESC"))
def rc07_frequency(spark, d):
    return ranked_history(baskets(spark, d), [F.desc("freq"), F.col("product_id")])


@R.query(_by("CASE WHEN re > 0 THEN 0 ELSE 1 END, CASE WHEN re > 0 THEN re ELSE freq END DESC"))
def rc08_reorders(spark, d):
    again = F.col("re") > 0
    return ranked_history(baskets(spark, d), [F.when(again, 0).otherwise(1), F.when(again, F.col("re")).otherwise(F.col("freq")).desc(), F.col("product_id")])


@R.query(f"WITH {BASE}, x AS (SELECT h.user_id, h.product_id, freq, o.pos FROM hist h LEFT JOIN old o ON o.user_id = h.user_id AND o.product_id = h.product_id AND o.order_number = (SELECT max(order_number) FROM old z WHERE z.user_id = h.user_id)) SELECT user_id, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN pos IS NULL THEN 1 ELSE 0 END, CASE WHEN pos IS NULL THEN -freq ELSE pos END, product_id) AS rank FROM x) WHERE rank <= {K}")
def rc09_latest_filled(spark, d):
    """The latest basket in cart order, filled up by frequency."""
    rows = baskets(spark, d).old
    own = rows.groupBy("user_id", "product_id").agg(N().alias("freq"), F.max(F.struct("order_number", "pos")).alias("l"))
    own = own.withColumn("top", F.max("l.order_number").over(Window.partitionBy("user_id")))
    last = F.col("l.order_number") == F.col("top")
    return B.top_k(own, K, [F.when(last, 0).otherwise(1), F.when(last, F.col("l.pos")).otherwise(-F.col("freq")), F.col("product_id")]).select("user_id", "product_id", "rank")


@R.query(f"WITH {BASE}, {_NB}, s AS (SELECT user_id, neighbour AS product_id, sum(lift * ln(1 + freq)) AS score FROM hist JOIN nb USING (product_id) GROUP BY 1, 2) SELECT user_id, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM s) WHERE rank <= {K}")
def rc10_cooccurrence(spark, d):
    b = baskets(spark, d)
    nb = B.neighbours(b.old.select("order_id", "product_id").distinct()).select("product_id", "neighbour", "lift")
    s = b.history.join(nb, "product_id").groupBy("user_id", F.col("neighbour").alias("product_id")).agg(F.sum(F.col("lift") * F.log1p("freq")).alias("score"))
    return B.top_k(s, K, [F.desc(F.round("score", 9)), F.col("product_id")]).select("user_id", "product_id", "rank")


_RF = "rf AS (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY round(freq * exp(-gap / 5.0::DOUBLE), 9) DESC, product_id) AS rank FROM hist)"


def recency():
    return [F.desc(F.round(F.col("freq") * F.exp(-F.col("gap") / F.lit(5.0)), 9)), F.col("product_id")]


@R.query(f"WITH {BASE}, {_RF} SELECT user_id, product_id, rank FROM rf WHERE rank <= {K}")
def rc11_recency_frequency(spark, d):
    return ranked_history(baskets(spark, d), recency())


_FILL = f"""{_RF}, f AS (SELECT user_id, product_id, rank, 1 AS tier FROM rf WHERE rank <= {K} UNION ALL SELECT user_id, product_id, rank, 2 FROM (SELECT DISTINCT user_id FROM hist), best WHERE rank <= {3 * K} AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = user_id AND FALSE)),
  g AS (SELECT f.* FROM f LEFT JOIN hist h ON f.tier = 2 AND h.user_id = f.user_id AND h.product_id = f.product_id WHERE h.user_id IS NULL), hybrid AS (SELECT * FROM (SELECT user_id, product_id, tier, row_number() OVER (PARTITION BY user_id ORDER BY tier, rank, product_id) AS rank FROM g) WHERE rank <= {2 * K})"""
_FILL = _FILL.replace(" AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = user_id AND FALSE)", "")


def hybrid(b: Baskets) -> DataFrame:
    first = ranked_history(b, recency())
    popular = B.from_popularity(b.history.select("user_id").distinct(), b.support, 3 * K)
    unseen = popular.join(b.history.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    return B.backfilled(first, unseen, 2 * K)


@R.query(f"WITH {BASE}, {_FILL} SELECT user_id, product_id, rank, CASE tier WHEN 1 THEN 'bought before' ELSE 'popular' END AS reason FROM hybrid")
def rc12_13_hybrid(spark, d):
    """Recency-frequency, filled up with popular products never bought, with the reason for each."""
    return hybrid(baskets(spark, d)).select("user_id", "product_id", "rank", F.when(F.col("tier") == 1, "bought before").otherwise("popular").alias("reason"))


_MET = """m AS (SELECT x.user_id, x.rank, CAST(t.user_id IS NOT NULL AS INT) AS hit, sum(CAST(t.user_id IS NOT NULL AS INT)) OVER (PARTITION BY x.user_id ORDER BY x.rank) AS found FROM hybrid x LEFT JOIN {t} t ON t.user_id = x.user_id AND t.product_id = x.product_id WHERE x.rank <= 5),
  q AS (SELECT user_id, sum(hit) AS hits, count(*) AS length, sum(hit / log2(rank + 1)) AS dcg, sum(hit * found / CAST(rank AS DOUBLE)) AS pr FROM m GROUP BY 1), w AS (SELECT user_id, count(*) AS wanted FROM {t} GROUP BY 1),
  r AS (SELECT user_id, wanted, coalesce(hits, 0) AS hits, coalesce(length, 0) AS length, coalesce(dcg, 0) AS dcg, coalesce(pr, 0) AS pr, list_sum([1 / log2(i + 1) for i in range(1, least(wanted, 5) + 1)]) AS ideal FROM w LEFT JOIN q USING (user_id))"""
_COLS = "coalesce(hits / nullif(CAST(length AS DOUBLE), 0), 0) AS precision, hits / CAST(wanted AS DOUBLE) AS recall, CAST(hits > 0 AS INT)::DOUBLE AS hit, dcg / ideal AS ndcg, pr / least(wanted, 5) AS ap, 2 * hits / CAST(length + wanted AS DOUBLE) AS f1"


@R.query(f"WITH {BASE}, {_FILL}, {_MET.format(t='truth')} SELECT user_id, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("precision", "recall", "hit", "ndcg", "ap", "f1")) + f" FROM (SELECT user_id, {_COLS} FROM r)")
def rc14_metrics_per_user(spark, d):
    b = baskets(spark, d)
    rows = B.ranking_metrics(hybrid(b), b.truth, 5)
    return rows.select("user_id", *[F.round(c, 8).alias(c) for c in rows.columns[1:]])


@R.query(f"WITH {BASE}, {_FILL}, {_MET.format(t='truth')} SELECT count(*) AS n_users, " + ", ".join(f"round(avg({c}), 8) AS {c}" for c in ("precision", "recall", "hit", "ndcg", "ap", "f1")) + f", (SELECT count(DISTINCT product_id) FROM hybrid WHERE rank <= 5) AS n_products FROM (SELECT user_id, {_COLS} FROM r)")
def rc15_mean_metrics(spark, d):
    b = baskets(spark, d)
    listed = cut(hybrid(b))
    rows = B.ranking_metrics(listed, b.truth, 5)
    means = rows.agg(N().alias("n_users"), *[F.round(F.avg(c), 8).alias(c) for c in rows.columns[1:]])
    n = listed.where("rank <= 5").select("product_id").distinct().count()
    return means.withColumn("n_products", F.lit(n).cast("bigint"))


@R.query(f"""WITH {BASE}, {_FILL}, z AS (SELECT product_id, rank AS r, row_number() OVER (ORDER BY rank) AS rn, count(*) OVER () AS n FROM best), y AS (SELECT h.product_id, count(*) AS c FROM hybrid h WHERE h.rank <= 5 GROUP BY 1)
  SELECT round(count(*) / CAST(max(n) AS DOUBLE), 8) AS coverage, round(sum(c * (1 - (r - 1) / CAST(greatest(n - 1, 1) AS DOUBLE))) / sum(c), 8) AS mean_percentile, round(sum(c) FILTER (WHERE r <= ceil(n * 0.2)) / CAST(sum(c) AS DOUBLE), 8) AS top_fifth_share FROM y JOIN z USING (product_id)""")
def rc16_popularity_bias(spark, d):
    b = baskets(spark, d)
    pop, n = W.positions(b.support, [F.desc("support"), F.col("product_id")])
    y = hybrid(b).where("rank <= 5").groupBy("product_id").agg(N().alias("c")).join(pop.select("product_id", "position"), "product_id")
    c, p = F.col("c"), F.col("position")
    return y.agg(F.round(N() / F.lit(float(n)), 8).alias("coverage"), F.round(F.sum(c * (1 - p / F.lit(float(max(n - 1, 1))))) / F.sum(c), 8).alias("mean_percentile"), F.round(F.sum(F.when(p < -(-n // 5), c)) / F.sum(c), 8).alias("top_fifth_share"))


@R.query(f"WITH {BASE} SELECT count(*) AS n, round(avg(CAST(h.user_id IS NOT NULL AS INT)), 8) AS repeat_share, round(1 - avg(CAST(h.user_id IS NOT NULL AS INT)), 8) AS novel_share FROM truth t LEFT JOIN hist h ON h.user_id = t.user_id AND h.product_id = t.product_id")
def rc17_repeat_novel(spark, d):
    b = baskets(spark, d)
    seen = b.history.select("user_id", "product_id").withColumn("seen", F.lit(1))
    rows = b.truth.join(seen, ["user_id", "product_id"], "left").na.fill(0, ["seen"])
    return rows.agg(N().alias("n"), F.round(F.avg("seen"), 8).alias("repeat_share"), F.round(1 - F.avg("seen"), 8).alias("novel_share"))


_NEW = "tn AS (SELECT t.* FROM truth t WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = t.user_id AND h.product_id = t.product_id))"


def _means(rows: DataFrame) -> DataFrame:
    return rows.agg(N().alias("n_users"), F.round(F.avg("recall"), 8).alias("recall"), F.round(F.avg("ndcg"), 8).alias("ndcg"))


@R.query(f"WITH {BASE}, {_FILL}, {_NEW}, {_MET.format(t='tn')} SELECT count(*) AS n_users, round(avg(recall), 8) AS recall, round(avg(ndcg), 8) AS ndcg FROM (SELECT user_id, {_COLS} FROM r)")
def rc18_novel_metrics(spark, d):
    b = baskets(spark, d)
    new = b.truth.join(b.history.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    return _means(B.ranking_metrics(hybrid(b), new, 5))


@R.query(f"WITH {BASE}, {_FILL}, tr AS (SELECT t.* FROM truth t WHERE EXISTS (SELECT 1 FROM hist h WHERE h.user_id = t.user_id AND h.product_id = t.product_id)), {_MET.format(t='tr')} SELECT count(*) AS n_users, round(avg(recall), 8) AS recall, round(avg(ndcg), 8) AS ndcg FROM (SELECT user_id, {_COLS} FROM r)")
def rc18_repeat_metrics(spark, d):
    b = baskets(spark, d)
    again = b.truth.join(b.history.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi")
    return _means(B.ranking_metrics(hybrid(b), again, 5))

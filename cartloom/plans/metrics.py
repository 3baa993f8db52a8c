"""Metric queries (MT) over the prediction log, joined with what happened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id
from cartloom.operators import metrics as M
from cartloom.operators import windows as W
from cartloom.plans import features as features_plans
from cartloom.plans.features import fq02_expanded
from cartloom.plans.registry import Registry
from cartloom.plans.relational import ORDERS, orders
from cartloom.session import cut
from cartloom.sources.tables import table

R = Registry()
FEATURES_SQL = features_plans.R.sql["fq02_expanded"]

SCORED = f"""{ORDERS}, t AS (SELECT DISTINCT p.prediction_id AS id, model_version AS g, score AS s, CAST(delivered > due AS INT) AS y, risk_level, strftime(bought, '%Y-%m') AS month FROM prediction_log p JOIN o ON o.order_id = lower(trim(p.order_id)) WHERE delivered IS NOT NULL AND due IS NOT NULL AND score IS NOT NULL)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """id, g (model version), s (score), y (late), risk_level, month: one row per prediction whose outcome is known."""
    log = table(spark, d, "prediction_log").select(F.col("prediction_id").alias("id"), clean_id("order_id").alias("order_id"), F.col("model_version").alias("g"), F.col("score").alias("s"), "risk_level").distinct().where("s is not null")
    o = orders(spark, d).where("delivered is not null and due is not null").select("order_id", (F.col("delivered") > F.col("due")).cast("int").alias("y"), F.date_format("bought", "yyyy-MM").alias("month"))
    return log.join(o, "order_id").drop("order_id")


def N():
    return F.count(F.lit(1))


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 8).alias(c) for c in df.columns if c not in keys])


_AUC = "SELECT g, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS r FROM t) GROUP BY 1"


@R.query(f"WITH {SCORED} SELECT g, round(auc, 8) AS auc FROM ({_AUC})")
def mt01_roc_auc(spark, d):
    return rounded(M.roc_auc(scored(spark, d), ["g"]), "g")


@R.query(f"WITH {SCORED.replace('model_version AS g', '1 AS g')} SELECT round(auc, 8) AS auc FROM ({_AUC})")
def mt01_roc_auc_global(spark, d):
    auc = M.roc_auc_global(scored(spark, d).select("y", "s"))
    return spark.createDataFrame([(auc,)], "auc double").select(F.round("auc", 8).alias("auc"))


_CUM = "c AS (SELECT g, s, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY g) AS pos, sum(q) OVER (PARTITION BY g) AS neg FROM (SELECT g, s, sum(y) AS p, sum(1 - y) AS q FROM t GROUP BY 1, 2) WINDOW w AS (PARTITION BY g ORDER BY s DESC))"


@R.query(f"WITH {SCORED}, {_CUM} SELECT g, round(sum(p * tp / CAST(tp + fp AS DOUBLE)) / max(pos), 8) AS ap FROM c GROUP BY 1")
def mt02_average_precision(spark, d):
    return rounded(M.average_precision(scored(spark, d), ["g"]), "g")


@R.query(f"WITH {SCORED} SELECT g, round(avg((s - y) * (s - y)), 8) AS brier, round(avg(-(y * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)))), 8) AS log_loss FROM t GROUP BY 1")
def mt03_brier_log_loss(spark, d):
    s, y = F.least(F.greatest("s", F.lit(1e-15)), F.lit(1 - 1e-15)), F.col("y")
    loss = -(y * F.log(s) + (1 - y) * F.log(1 - s))
    return rounded(scored(spark, d).groupBy("g").agg(F.avg((F.col("s") - y) * (F.col("s") - y)).alias("brier"), F.avg(loss).alias("log_loss")), "g")


@R.query(f"WITH {SCORED}, {_CUM}, f AS (SELECT g, s, 2.0::DOUBLE * tp / (tp + fp + pos) AS f1, tp / CAST(pos AS DOUBLE) AS recall FROM c) SELECT g, round(f1, 8) AS f1, round(recall, 8) AS recall, round(s, 8) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, recall DESC, s) AS rn FROM f) WHERE rn = 1")
def mt04_best_f1(spark, d):
    return rounded(M.best_f1(scored(spark, d), ["g"]), "g")


_CM = "count(*) FILTER (WHERE y = 1 AND s >= {t}) AS tp, count(*) FILTER (WHERE y = 0 AND s >= {t}) AS fp, count(*) FILTER (WHERE y = 1 AND s < {t}) AS fn, count(*) FILTER (WHERE y = 0 AND s < {t}) AS tn"
_RATES = "coalesce(round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 8), 0) AS precision, coalesce(round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 8), 0) AS recall, coalesce(round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 8), 0) AS f1, coalesce(round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 8), 0) AS specificity, round((coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) + coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0)) / 2, 8) AS balanced_accuracy, round((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 8) AS flag_rate"


@R.query(f"WITH {SCORED}, c AS (SELECT g, {_CM.format(t='0.2')} FROM t GROUP BY 1) SELECT g, tp, fp, fn, tn, {_RATES} FROM c")
def mt05_threshold(spark, d):
    c = scored(spark, d).groupBy("g").agg(*[v.alias(k) for k, v in M.confusion(F.col("y"), F.col("s") >= 0.2).items()])
    return rounded(c.select("*", *[v.alias(k) for k, v in M.rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()]), "g", "tp", "fp", "fn", "tn")


_TOP = "k AS (SELECT g, y, s, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS rn, count(*) OVER (PARTITION BY g) AS n, sum(y) OVER (PARTITION BY g) AS pos FROM t), c(c) AS (VALUES (1), (5), (10), (20))"


@R.query(f"WITH {SCORED}, {_TOP} SELECT g, c AS capacity, round(avg(y), 8) AS precision, round(sum(y) / CAST(max(pos) AS DOUBLE), 8) AS recall, round(avg(y) / (max(pos) / CAST(max(n) AS DOUBLE)), 8) AS lift FROM k, c WHERE rn <= greatest(1, ceil(n * c / 100.0)) GROUP BY 1, 2")
def mt06_capacity(spark, d):
    k = W.running_within(scored(spark, d).select("g", "id", "y", "s", F.lit(1).alias("one")), ["g"], [F.desc("s"), F.col("id")], {"n": "one", "y": "y"})
    rows = k.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in (1, 5, 10, 20)]))).where(F.col("cum_n") <= F.greatest(F.lit(1), F.ceil(F.col("all_n") * F.col("capacity") / 100)))
    return rounded(rows.groupBy("g", "capacity").agg(F.avg("y").alias("precision"), (F.sum("y") / F.max("all_y")).alias("recall"), (F.avg("y") / (F.max("all_y") / F.max("all_n"))).alias("lift")), "g", "capacity")


@R.query(f"WITH {SCORED}, h AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3]) AS h), c AS (SELECT h AS threshold, {_CM.format(t='h')} FROM t, h GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, {_RATES} FROM c")
def mt07_sweep(spark, d):
    """One pass: each row falls between two thresholds; the table of a threshold sums what lies at or above it."""
    hs = [0.05, 0.1, 0.15, 0.2, 0.3]
    met = F.size(F.filter(F.array(*[F.lit(h) for h in hs]), lambda h: F.col("s") >= h))
    steps = scored(spark, d).groupBy(met.alias("met")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    rows = steps.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("threshold")) for i, h in enumerate(hs, 1)])).alias("h"))
    above = F.col("met") >= F.col("h.i")
    take = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    c = rows.groupBy("h.threshold").agg(take("p", above).alias("tp"), take("q", above).alias("fp"), take("p", ~above).alias("fn"), take("q", ~above).alias("tn"))
    return rounded(c.select("*", *[v.alias(k) for k, v in M.rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()]), "threshold", "tp", "fp", "fn", "tn")


@R.query(f"WITH {SCORED}, e AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM t) SELECT len(list_filter(e, lambda x: x < s)) AS bin, count(*) AS n, round(avg(s), 8) AS mean_score, round(avg(y), 8) AS mean_y FROM t, e GROUP BY 1")
def mt08_quantile_bins(spark, d):
    rows = scored(spark, d)
    edges = [e for e in W.percentiles(rows, "s", [i / 10 for i in range(1, 10)]) if e is not None]
    place = sum((F.when(F.col("s") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return rounded(rows.groupBy(place.alias("bin")).agg(N().alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("mean_y")), "bin", "n")


_BINS = "b AS (SELECT g, least(CAST(floor(s * 10) AS INT), 9) AS bin, count(*) AS n, avg(s) AS mean_score, avg(y) AS mean_y FROM t GROUP BY 1, 2)"


@R.query(f"WITH {SCORED}, {_BINS} SELECT g, bin, n, round(mean_score, 8) AS mean_score, round(mean_y, 8) AS mean_y FROM b")
def mt09_reliability(spark, d):
    return rounded(M.reliability(scored(spark, d), ["g"]), "g", "bin", "n")


@R.query(f"WITH {SCORED}, {_BINS} SELECT g, round(sum(n * abs(mean_score - mean_y)) / sum(n), 8) AS ece, round(sum(n * abs(mean_score - mean_y)) / sum(n) / count(*), 8) AS ece_per_bin FROM b GROUP BY 1")
def mt10_11_ece(spark, d):
    return rounded(M.calibration_errors(M.reliability(scored(spark, d), ["g"]), ["g"]), "g")


_PAIRS = f"{SCORED}, x AS (SELECT CASE WHEN y = 1 THEN 'high' WHEN s >= 0.15 THEN 'medium' ELSE 'low' END AS truth, risk_level AS guess FROM t WHERE risk_level IS NOT NULL)"
LEVELS = ["low", "medium", "high", "extreme"]


def label_pairs(spark, d):
    truth = F.when(F.col("y") == 1, "high").when(F.col("s") >= 0.15, "medium").otherwise("low")
    return scored(spark, d).where("risk_level is not null").select(truth.alias("truth"), F.col("risk_level").alias("guess"))


@R.query(f"WITH {SCORED}, z AS (SELECT y, [1 - s, s * 0.6, s * 0.4] AS p FROM t) SELECT round(avg((p[1] - CAST(y = 0 AS INT)) * (p[1] - CAST(y = 0 AS INT)) + (p[2] - CAST(y = 1 AS INT)) * (p[2] - CAST(y = 1 AS INT)) + p[3] * p[3]), 8) AS brier, round((SELECT sum(abs(c - a) * n) / sum(n) FROM (SELECT least(floor(list_max(p) * 10), 9) AS b, avg(list_max(p)) AS c, avg(CAST(list_position(p, list_max(p)) - 1 = y AS INT)) AS a, count(*) AS n FROM z GROUP BY 1)), 8) AS top_ece FROM z")
def mt12_multiclass_calibration(spark, d):
    """Multiclass Brier score and the calibration error of the most likely class, over arrays of probabilities."""
    z = scored(spark, d).select("y", F.array(1 - F.col("s"), F.col("s") * 0.6, F.col("s") * 0.4).alias("p"))
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("y")).cast("int"), 2)), F.lit(0.0), lambda a, x: a + x)
    top = F.array_max("p")
    hit = (F.array_position("p", top) - 1 == F.col("y")).cast("int")
    bins = z.groupBy(F.least(F.floor(top * 10), F.lit(9)).alias("b")).agg(N().alias("n"), F.sum(top).alias("c"), F.sum(hit).alias("a"), F.sum(brier).alias("brier"))
    return bins.agg(F.round(F.sum("brier") / F.sum("n"), 8).alias("brier"), F.round(F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 8).alias("top_ece"))


_REPORT = "SELECT label, support, predicted, hits, round(coalesce(hits / nullif(CAST(predicted AS DOUBLE), 0), 0), 8) AS precision, round(coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0), 8) AS recall, round(coalesce(2 * hits / nullif(CAST(predicted + support AS DOUBLE), 0), 0), 8) AS f1 FROM (SELECT label, (SELECT count(*) FROM x WHERE truth = label) AS support, (SELECT count(*) FROM x WHERE guess = label) AS predicted, (SELECT count(*) FROM x WHERE truth = label AND guess = label) AS hits FROM l)"


@R.query(f"WITH {_PAIRS}, l AS (SELECT truth AS label FROM x UNION SELECT guess FROM x) {_REPORT}")
def mt13_class_report(spark, d):
    return rounded(M.class_report(label_pairs(spark, d)), "label", "support", "predicted", "hits")


@R.query(f"WITH {_PAIRS}, l AS (SELECT unnest({LEVELS}) AS label), r AS ({_REPORT}) SELECT round(avg(f1), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1, round(sum(hits) / CAST(sum(support) AS DOUBLE), 8) AS accuracy FROM r")
def mt13_14_averages(spark, d):
    """Averages over a fixed list of labels, one of which never occurs."""
    r = M.class_report(label_pairs(spark, d), LEVELS)
    return r.agg(F.round(F.avg("f1"), 8).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 8).alias("weighted_f1"), F.round(F.sum("hits") / F.sum("support"), 8).alias("accuracy"))


@R.query(f"WITH {_PAIRS} SELECT truth, guess, count(*) AS n FROM x WHERE truth <> guess GROUP BY 1, 2 ORDER BY n DESC, truth, guess LIMIT 5")
def mt15_confused(spark, d):
    return label_pairs(spark, d).where("truth <> guess").groupBy("truth", "guess").agg(N().alias("n")).orderBy(F.desc("n"), "truth", "guess").limit(5)


@R.query(f"WITH {_PAIRS}, r AS (SELECT CASE truth WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS a, CASE guess WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS b FROM x) SELECT round(avg(abs(a - b)), 8) AS mae, round(avg(CAST(abs(a - b) <= 1 AS INT)), 8) AS within_1, round(avg(CAST(abs(a - b) >= 2 AS INT)), 8) AS severe FROM r")
def mt16_ordinal(spark, d):
    rank = lambda c: F.when(F.col(c) == "low", 0).when(F.col(c) == "medium", 1).otherwise(2)
    gap = F.abs(rank("truth") - rank("guess"))
    return label_pairs(spark, d).agg(F.round(F.avg(gap), 8).alias("mae"), F.round(F.avg((gap <= 1).cast("int")), 8).alias("within_1"), F.round(F.avg((gap >= 2).cast("int")), 8).alias("severe"))


@R.query(f"WITH {_PAIRS}, l AS (SELECT truth AS label FROM x UNION SELECT guess FROM x), r AS ({_REPORT}), m AS (SELECT sum(support)::DOUBLE AS s, sum(hits)::DOUBLE AS c, sum(support * predicted)::DOUBLE AS tp, sum(support * support)::DOUBLE AS tt, sum(predicted * predicted)::DOUBLE AS pp, avg(hits / nullif(CAST(support AS DOUBLE), 0)) AS ba, avg(coalesce(2 * hits / nullif(CAST(predicted + support AS DOUBLE), 0), 0)) AS mf, sum(support * coalesce(2 * hits / nullif(CAST(predicted + support AS DOUBLE), 0), 0)) AS wf FROM r) SELECT round(c / s, 8) AS accuracy, round(ba, 8) AS balanced_accuracy, round(mf, 8) AS macro_f1, round(wf / s, 8) AS weighted_f1, round(coalesce((c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0), 8) AS mcc FROM m")
def mt13_summary(spark, d):
    """Accuracy, balanced accuracy, F1 averages and Matthews' coefficient over all classes."""
    return rounded(M.class_summary(label_pairs(spark, d).groupBy("truth", "guess").agg(N().alias("n"))))


@R.query()
def mt17_bootstrap(spark, d):
    """Percentile intervals of the Brier score, the rate of late orders and the AUC over 200 Poisson resamples; those of one class are rejected."""
    rows = cut(scored(spark, d).select("id", "s", "y"))
    gap = F.col("s") - F.col("y")
    sums = M.bootstrap_sums(rows, {"brier": gap * gap, "late": F.col("y")}, 200, 1, "id")
    valid = cut(sums.where("late > 0 and late < w").select("replicate", (F.col("brier") / F.col("w")).alias("brier"), (F.col("late") / F.col("w")).alias("rate")).join(M.bootstrap_auc(rows, "s", 200, 1, "id"), "replicate"))
    n = valid.count()
    return reduce(DataFrame.unionByName, [M.interval(valid, m).select(F.lit(m).alias("metric"), "low", "high", F.lit(n).cast("bigint").alias("n_valid")) for m in ("brier", "rate", "auc")])


_SETS = ["late_delivery", "seller_sla"]


def two_guesses(spark, d) -> DataFrame:
    """id, kind, y, s, truth, old, new: the outcome of each prediction and the classes of two rules on it (by score, by risk level)."""
    kinds = table(spark, d, "prediction_log").select(F.col("prediction_id").alias("id"), F.col("prediction_type").alias("kind")).distinct()
    name = lambda c: F.when(c, "late").otherwise("in time")
    return scored(spark, d).where("risk_level is not null").join(kinds, "id").select("id", "kind", "y", "s", name(F.col("y") == 1).alias("truth"), name(F.col("s") >= 0.2).alias("old"), name(F.col("risk_level") == "high").alias("new"))


def paired(rows: DataFrame, replicates: int = 200) -> DataFrame:
    """(delta, low, high, weak_new, weak_old): macro-F1 of `new` less that of `old` on the same resamples, and the late class's F1 of both."""
    labels = ["in time", "late"]
    sums = M.class_sums(labels, F.col("truth"), {"a": F.col("new"), "b": F.col("old")})
    gain = M.macro_f1_of_sums(labels, "a") - M.macro_f1_of_sums(labels, "b")
    whole = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(n) for n, c in sums.items()])
    f1 = lambda side: F.coalesce(F.try_divide(2 * F.col(f"{side}h1"), F.col("t1") + F.col(f"{side}p1")), F.lit(0.0))
    reps = M.bootstrap_sums(rows, sums, replicates, 1, "id").where("t0 > 0 and t1 > 0").select(gain.alias("d"))
    low, high = M.interval(reps, "d").first()
    return whole.select(gain.alias("delta"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), f1("a").alias("weak_new"), f1("b").alias("weak_old"))


@R.query()
def mt18_paired_bootstrap(spark, d):
    """Intervals of the differences of two rules on the same resamples: macro-F1 per set, and Brier score and AUC of the score and of one half of it squared."""
    rows = cut(two_guesses(spark, d))
    out = [paired(rows.where(F.col("kind") == kind)).select(F.lit(f"macro_f1 {kind}").alias("difference"), "low", "high") for kind in _SETS]
    gap, other = F.col("s") - F.col("y"), F.col("s") * F.col("s") / 2 - F.col("y")
    brier = M.bootstrap_sums(rows, {"d": other * other - gap * gap}, 200, 1, "id").select((F.col("d") / F.col("w")).alias("d"))
    level = M.bootstrap_auc(rows.withColumn("level", (F.col("new") == "late").cast("int")), "level", 200, 1, "id").select("replicate", F.col("auc").alias("b"))
    auc = M.bootstrap_auc(rows, "s", 200, 1, "id").join(level, "replicate").select((F.col("auc") - F.col("b")).alias("d"))
    out += [M.interval(brier, "d").select(F.lit("brier").alias("difference"), "low", "high"), M.interval(auc, "d").select(F.lit("auc").alias("difference"), "low", "high")]
    return reduce(DataFrame.unionByName, out).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@R.query()
def mt28_challenger(spark, d):
    """Whether the rule by risk level replaces the rule by score: on both kinds of prediction its macro-F1 is better beyond chance, and the late class's F1 not worse."""
    rows = cut(two_guesses(spark, d))
    return M.challenger_wins(reduce(DataFrame.unionByName, [paired(rows.where(F.col("kind") == kind)) for kind in _SETS]))


_AP_MONTH = "c AS (SELECT g, month, s, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY g, month) AS pos FROM (SELECT g, month, s, sum(y) AS p, sum(1 - y) AS q FROM t WHERE month IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY g, month ORDER BY s DESC)), ap AS (SELECT g, month, sum(p * tp / CAST(tp + fp AS DOUBLE)) / nullif(max(pos), 0) AS ap FROM c GROUP BY 1, 2)"


@R.query(f"""WITH {SCORED}, {_AP_MONTH}, d AS (SELECT a.g AS old, b.g AS new, b.ap - a.ap AS d FROM ap a JOIN ap b USING (month) WHERE a.g < b.g AND a.ap IS NOT NULL AND b.ap IS NOT NULL), k AS (SELECT old, new, count(*) AS n, avg(d) AS delta, avg(d) - 1.96::DOUBLE * coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS low, count(*) FILTER (WHERE d > 0) AS better FROM d GROUP BY 1, 2)
  SELECT old, new, n, round(delta, 8) AS delta, round(low, 8) AS low, better, CASE WHEN delta < -0.005 THEN 'DEGRADED_PERFORMANCE' WHEN delta > 0 AND (low > 0 OR better > 0) THEN 'SUPPORTED_INCREMENTAL_SIGNAL' ELSE 'NO_INCREMENTAL_SIGNAL' END AS evidence FROM k""")
def mt22_evidence(spark, d):
    """What each pair of models' gain in average precision, month by month, is evidence of."""
    ap = M.average_precision(scored(spark, d).where("month is not null"), ["g", "month"]).where("ap is not null")
    per = ap.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("g", "ap"))).alias("v"))  # the models of a month: versions, not data
    older = per.select("v", F.posexplode("v").alias("at", "o"))
    pairs = older.select("o", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("n")).select(F.col("o.g").alias("old"), F.col("n.g").alias("new"), (F.col("n.ap") - F.col("o.ap")).alias("d"))
    k = pairs.groupBy("old", "new").agg(N().alias("n"), F.avg("d").alias("delta"), (F.avg("d") - 1.96 * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(N())).alias("low"), F.count_if(F.col("d") > 0).alias("better"))
    label = M.evidence_label(F.col("delta"), F.col("low"), F.col("better"), F.lit(True), F.lit(False), F.col("delta") < -0.005)
    return k.select("old", "new", "n", F.round("delta", 8).alias("delta"), F.round("low", 8).alias("low"), "better", label.alias("evidence"))


@R.query(f"""WITH {SCORED}, v AS (SELECT id, y, s, (ascii(substr(sha256(id), 1, 1)) + 1) * 1.0::DOUBLE AS v FROM t), k AS (SELECT y, v, row_number() OVER (ORDER BY s DESC, id) AS by_risk, row_number() OVER (ORDER BY v DESC, id) AS by_value, row_number() OVER (ORDER BY s * v DESC, id) AS by_both, count(*) OVER () AS n FROM v),
  u AS (SELECT 'risk' AS policy, y, v, by_risk AS rn, n FROM k UNION ALL SELECT 'value', y, v, by_value, n FROM k UNION ALL SELECT 'both', y, v, by_both, n FROM k) SELECT policy, round(sum(y) FILTER (WHERE rn <= ceil(n * 0.1)) / CAST(sum(y) AS DOUBLE), 8) AS recall, round(avg(y) FILTER (WHERE rn <= ceil(n * 0.1)), 8) AS precision, round(sum(v * y) FILTER (WHERE rn <= ceil(n * 0.1)) / sum(v * y), 8) AS value_share FROM u GROUP BY 1""")
def mt19_budget(spark, d):
    """What checking the first tenth finds, ordered by risk, by value, and by both."""
    rows = cut(scored(spark, d).select("id", "y", "s", ((F.ascii(F.substring(F.sha2("id", 256), 1, 1)) + 1) * F.lit(1.0)).alias("v")))
    out = None
    for policy, score in (("risk", F.col("s")), ("value", F.col("v")), ("both", F.col("s") * F.col("v"))):
        k, n = W.positions(rows.withColumn("k", score), [F.desc("k"), F.col("id")])
        top = F.col("position") < -(-n // 10)
        got = k.agg(F.lit(policy).alias("policy"), F.round(F.sum(F.when(top, F.col("y"))) / F.sum("y"), 8).alias("recall"), F.round(F.avg(F.when(top, F.col("y"))), 8).alias("precision"), F.round(F.sum(F.when(top, F.col("v") * F.col("y"))) / F.sum(F.col("v") * F.col("y")), 8).alias("value_share"))
        out = got if out is None else out.unionByName(got)
    return out


def _auc_features():
    """The numeric features of the expanded table (FQ02), one by one."""
    return [c for c in "purchase_year purchase_month purchase_day_of_week purchase_hour approval_year approval_month approval_day_of_week approval_hour purchase_to_approval_seconds payment_record_count max_payment_installments total_payment_value item_count unique_product_count unique_seller_count total_item_price total_freight_value mean_freight_value max_freight_value".split()]


@R.query(f"""WITH f AS ({FEATURES_SQL}), t2 AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS g, late_delivery AS y, CAST({c} AS DOUBLE) AS s FROM f WHERE {c} IS NOT NULL" for c in _auc_features()) + f""") SELECT feature, round(auc, 8) AS auc, round(greatest(auc, 1 - auc), 8) AS flipped_auc FROM (SELECT g AS feature, auc FROM ({_AUC.replace('FROM t)', 'FROM t2)')}))""")
def mt20_univariate_auc(spark, d):
    """Each feature of the expanded table alone as a score: unpivoted, then one AUC per feature."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("s")) for c in _auc_features()])
    rows = fq02_expanded(spark, d).select(F.col("late_delivery").alias("y"), F.explode(pairs).alias("f")).select("y", "f.feature", "f.s")
    auc = M.roc_auc(rows, ["feature"])
    return rounded(auc.withColumn("flipped_auc", F.greatest(F.col("auc"), 1 - F.col("auc"))), "feature")


_MONTHLY = "m AS (SELECT g, month, avg((s - y) * (s - y)) AS brier FROM t WHERE month IS NOT NULL GROUP BY 1, 2)"


@R.query(f"WITH {SCORED}, {_MONTHLY} SELECT a.g AS old, b.g AS new, a.month, round(a.brier - b.brier, 8) AS delta FROM m a JOIN m b ON a.month = b.month AND a.g < b.g")
def mt21_period_deltas(spark, d):
    """Every two models' Brier scores of the same month compared: a row per month and pair of models."""
    gap = F.col("s") - F.col("y")
    m = scored(spark, d).where("month is not null").groupBy("g", "month").agg(F.avg(gap * gap).alias("b"))
    per = m.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("g", "b"))).alias("v"))  # the models of a month: versions, not data
    older = per.select("month", "v", F.posexplode("v").alias("at", "o"))
    pairs = older.select("month", "o", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("n"))
    return pairs.select(F.col("o.g").alias("old"), F.col("n.g").alias("new"), "month", F.round(F.col("o.b") - F.col("n.b"), 8).alias("delta"))


@R.query(f"WITH {SCORED}, {_MONTHLY}, k AS (SELECT g, avg(brier) AS mean, max(brier) AS worst, coalesce(stddev_samp(brier), 0) AS std, count(*) AS n FROM m GROUP BY 1) SELECT g, round(mean, 8) AS mean, round(worst, 8) AS worst, round(std, 8) AS std, n, row_number() OVER (ORDER BY mean, worst, g) AS rank, row_number() OVER (ORDER BY mean, worst, g) = 1 AS winner FROM k")
def mt23_24_strategies(spark, d):
    gap = F.col("s") - F.col("y")
    m = scored(spark, d).where("month is not null").groupBy("g", "month").agg(F.avg(gap * gap).alias("brier"))
    k = m.groupBy("g").agg(F.avg("brier").alias("mean"), F.max("brier").alias("worst"), F.coalesce(F.stddev_samp("brier"), F.lit(0.0)).alias("std"), N().alias("n"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean", "worst", "g"))
    return k.select("g", F.round("mean", 8).alias("mean"), F.round("worst", 8).alias("worst"), F.round("std", 8).alias("std"), "n", rank.alias("rank"), (rank == 1).alias("winner"))


@R.query(f"WITH {SCORED}, v AS (SELECT y, s AS a, (s + 0.1) / 1.2 AS b, CAST(length(risk_level) AS DOUBLE) / 10 AS c FROM t WHERE risk_level IS NOT NULL), w AS (SELECT y, (a + b + c) / 3 AS m, CAST(a >= 0.2 AS INT) AS pa, CAST(b >= 0.25 AS INT) AS pb, CAST(c >= 0.5 AS INT) AS pc FROM v) SELECT round(avg(CAST(CAST(m >= 0.3 AS INT) = y AS INT)), 8) AS vote_accuracy, round(avg(CAST(pa = y OR pb = y OR pc = y AS INT)), 8) AS oracle_accuracy, round(avg(CAST(pa = pb AS INT)), 8) AS agree_ab, round(avg(CAST(pa = pc AS INT)), 8) AS agree_ac FROM w")
def mt25_votes(spark, d):
    """Soft vote of three scores, the accuracy of the best of them per row, and how often two agree."""
    v = scored(spark, d).where("risk_level is not null").select("y", F.col("s").alias("a"), ((F.col("s") + 0.1) / 1.2).alias("b"), (F.length("risk_level").cast("double") / 10).alias("c"))
    w = v.select("y", ((F.col("a") + F.col("b") + F.col("c")) / 3 >= 0.3).cast("int").alias("m"), (F.col("a") >= 0.2).cast("int").alias("pa"), (F.col("b") >= 0.25).cast("int").alias("pb"), (F.col("c") >= 0.5).cast("int").alias("pc"))
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    y = F.col("y")
    return w.agg(share(F.col("m") == y).alias("vote_accuracy"), share((F.col("pa") == y) | (F.col("pb") == y) | (F.col("pc") == y)).alias("oracle_accuracy"), share(F.col("pa") == F.col("pb")).alias("agree_ab"), share(F.col("pa") == F.col("pc")).alias("agree_ac"))


@R.query(f"WITH {SCORED}, m AS (SELECT g, count(*) AS n, avg((s - y) * (s - y)) AS brier FROM t GROUP BY 1) SELECT min(n) FILTER (WHERE brier <= (SELECT min(brier) FROM m) + 0.005) AS plateau_size, arg_min(g, (brier, g)) AS best FROM m")
def mt27_plateau(spark, d):
    """The smallest model size within 0.005 of the best, and the best: the tolerance rules of model choice."""
    gap = F.col("s") - F.col("y")
    m = scored(spark, d).groupBy("g").agg(N().alias("n"), F.avg(gap * gap).alias("brier"))
    m = m.withColumn("least", F.min("brier").over(Window.partitionBy(F.lit(0))))
    return m.agg(F.min(F.when(F.col("brier") <= F.col("least") + 0.005, F.col("n"))).alias("plateau_size"), F.min_by("g", F.struct("brier", "g")).alias("best"))


@R.query()
def mt26_29_calibration(spark, d):
    """Three scores of the same predictions (raw, shrunk, one for all): AUC, Brier score and calibration error, and both rules of taking one instead of raw."""
    scores = F.array(*[F.struct(F.lit(n).alias("candidate"), c.alias("s")) for n, c in (("raw", F.col("s")), ("shrunk", (F.col("s") + 0.1) / 1.2), ("flat", F.lit(0.1)))])
    rows = cut(scored(spark, d).select("y", F.explode(scores).alias("c")).select("y", "c.candidate", "c.s"))
    gap = F.col("s") - F.col("y")
    ece = M.calibration_errors(M.reliability(rows, ["candidate"]), ["candidate"]).select("candidate", "ece")
    m = M.roc_auc(rows, ["candidate"]).join(rows.groupBy("candidate").agg(F.avg(gap * gap).alias("brier")), "candidate").join(ece, "candidate")
    return rounded(M.calibration_choice(m, "raw"), "candidate", "allowed", "accepted", "chosen")

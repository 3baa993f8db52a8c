"""Metrics as queries over (group, y, s) with y in 0/1 and a score, and over (truth, guess) labels.

Rows are first reduced to one per group and distinct score, so ties are exact, and cumulated in a range-partitioned order, so
no task has to hold a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators.windows import running_totals, running_within
from cartloom.session import shuffle_width


def by_score(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per group and score: p (positives), q (negatives). Null labels or scores are left out."""
    return rows.where("y is not null and s is not null").groupBy(*group, "s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """by_score with tp and fp: positives and negatives at this score or above; all_p, all_q: the group's totals."""
    run = running_within(by_score(rows, group), group, [F.desc("s")], {"p": "p", "q": "q"})
    return run.withColumnsRenamed({"cum_p": "tp", "cum_q": "fp"})


def roc_auc(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, auc): ties count half; null with only one class."""
    wins = F.sum((F.col("p") * (F.col("all_q") - F.col("fp")) + F.col("p") * F.col("q") / F.lit(2.0)).cast("double"))
    return ranked(rows, group).groupBy(*group).agg(F.try_divide(wins, F.first("all_p").cast("double") * F.first("all_q")).alias("auc"))


def roc_auc_global(rows: DataFrame) -> float | None:
    """The same for all rows as one group, by a range-partitioned running total."""
    scores, total = running_totals(by_score(rows, []), [F.desc("s")], {"p": "p", "q": "q"})
    if not total["p"] or not total["q"]:
        return None
    wins = F.sum(F.col("p") * (total["q"] - F.col("cum_q")) + F.col("p") * F.col("q") / F.lit(2.0))
    return scores.agg(wins).first()[0] / (float(total["p"]) * total["q"])


def average_precision(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, ap): the step sum over distinct scores."""
    step = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    return ranked(rows, group).groupBy(*group).agg(F.try_divide(F.sum(step), F.first("all_p").cast("double")).alias("ap"))


def best_f1(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, f1, recall, threshold); of equal F1 the higher recall, then the lower threshold."""
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("all_p"))
    best = F.max(F.struct(f1.alias("f1"), recall.alias("recall"), (-F.col("s")).alias("t")))
    return ranked(rows, group).groupBy(*group).agg(best.alias("b")).select(*group, "b.f1", "b.recall", (-F.col("b.t")).alias("threshold"))


def confusion(y: Column, flag: Column) -> dict[str, Column]:
    return {"tp": F.count_if((y == 1) & flag), "fp": F.count_if((y == 0) & flag), "fn": F.count_if((y == 1) & ~flag), "tn": F.count_if((y == 0) & ~flag)}


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """precision, recall, f1, specificity, balanced accuracy, flag rate; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {"precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2, "flag_rate": ratio(tp + fp, tp + fp + fn + tn)}


def reliability(rows: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """(group, bin, n, mean_score, mean_y): equal-width bins, the last closed, empty ones absent."""
    place = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("int")
    return rows.where("y is not null and s is not null").groupBy(*group, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("mean_y"))


def calibration_errors(bins: DataFrame, group: list[str]) -> DataFrame:
    """(group, ece, ece_per_bin): the weighted sum of the bins' gaps, and the same divided by the number of bins."""
    gap = F.abs(F.col("mean_score") - F.col("mean_y")) * F.col("n")
    per = bins.groupBy(*group).agg(F.sum(gap).alias("_gap"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return per.select(*group, (F.col("_gap") / F.col("_n")).alias("ece"), (F.col("_gap") / F.col("_n") / F.col("_k")).alias("ece_per_bin"))


def class_report(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) from (truth, guess); labels: a fixed list, else those observed."""
    cells = pairs.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("g")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("g")))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    per = cells.select(F.explode(sides).alias("x"), hit.alias("h")).groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.g").alias("predicted"), (F.sum("h") / 2).cast("bigint").alias("hits"))
    if labels is not None:
        fixed = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        per = fixed.join(per, "label", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return per.select("label", "support", "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"))


def class_summary(cells: DataFrame) -> DataFrame:
    """(accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc) from counted pairs (truth, guess, n), for any number of classes.

    balanced_accuracy: mean recall of the classes that occur; macro_f1: over all observed labels; mcc: 0 where it has no denominator.
    """
    sides = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")))
    per = cells.select(F.explode(sides).alias("x"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("h")).groupBy("x.label").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), (F.sum("h") / 2).alias("h"))
    t, p, h = (F.col(c).cast("double") for c in ("t", "p", "h"))
    f1 = F.coalesce(F.try_divide(2 * h, t + p), F.lit(0.0))
    per = per.agg(F.sum(t).alias("s"), F.sum(h).alias("c"), F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"), F.avg(F.try_divide(h, t)).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), F.sum(f1 * t).alias("wf"))
    s, root = F.col("s"), F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return per.select(F.try_divide(F.col("c"), s).alias("accuracy"), "balanced_accuracy", "macro_f1", F.try_divide(F.col("wf"), s).alias("weighted_f1"), F.when(s > 0, F.coalesce(F.try_divide(F.col("c") * s - F.col("tp"), root), F.lit(0.0))).alias("mcc"))


def poisson_weights(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """rows x replicates: how often each row is drawn in each replicate, a Poisson number with mean 1 from a hash of the row's key."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    chances = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 20.0))]))
    return np.searchsorted(chances, u / float(1 << 53), side="right")


def bootstrap_sums(rows: DataFrame, sums: dict[str, Column], replicates: int, seed: int, key: str) -> DataFrame:
    """(replicate, w, sums): Poisson bootstrap of sums: each row counts as often as the hash of its key says; w is the resample's size.

    One pass: a task keeps the sums of all its replicates and gives a row for each; null values add nothing.
    """
    names = [*sums]
    narrow = rows.select(F.xxhash64(key).alias("_h"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, len(names) + 1))
        for pdf in batches:
            values = np.column_stack([np.ones(len(pdf)), *[pdf[n].to_numpy(dtype=float) for n in names]])
            for at in range(0, len(pdf), 4096):
                total += poisson_weights(pdf["_h"].to_numpy()[at : at + 4096], replicates, seed).T @ values[at : at + 4096]
        yield pd.DataFrame(total, columns=["w", *names]).assign(replicate=np.arange(1, replicates + 1))[["replicate", "w", *names]]

    parts = narrow.mapInPandas(draw, "replicate int, w double, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in ["w", *names]])


def bootstrap_auc(rows: DataFrame, score: str, replicates: int, seed: int, key: str) -> DataFrame:
    """(replicate, auc): ROC-AUC (ties half) of Poisson resamples of rows (y, score, key); null where a resample has one class only.

    Rows are range-partitioned by the score; a task adds up its pairs for all replicates, and the pairs between tasks follow from
    their numbers of each class. Equal scores are one task's.
    """
    narrow = rows.where(F.col("y").isNotNull() & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col("y").cast("int").alias("y"), F.xxhash64(key).alias("_h"))
    ordered = narrow.repartitionByRange(shuffle_width(rows.sparkSession), "s").sortWithinPartitions("s")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.zeros(replicates)  # negatives below the current score
        tie_p, tie_q, pairs, positives = (np.zeros(replicates) for _ in range(4))
        at = None
        for pdf in batches:
            s, y = pdf["s"].to_numpy(), pdf["y"].to_numpy()
            for a in range(0, len(pdf), 4096):
                w = poisson_weights(pdf["_h"].to_numpy()[a : a + 4096], replicates, seed).astype(float)
                part, label = s[a : a + 4096], y[a : a + 4096, None]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                p, q = np.add.reduceat(w * (label == 1), starts, axis=0), np.add.reduceat(w * (label == 0), starts, axis=0)
                if part[0] == at:  # the tie goes on from the batch before
                    p[0] += tie_p
                    q[0] += tie_q
                elif at is not None:
                    p, q = np.vstack([tie_p, p]), np.vstack([tie_q, q])
                below = low + np.cumsum(q, axis=0) - q
                pairs += (p[:-1] * (below[:-1] + q[:-1] / 2)).sum(axis=0)
                positives += p[:-1].sum(axis=0)
                low, tie_p, tie_q, at = below[-1], p[-1], q[-1], part[-1]
        pairs += tie_p * (low + tie_q / 2)
        first = TaskContext.get().partitionId()
        yield pd.DataFrame({"part": first, "replicate": np.arange(1, replicates + 1), "pairs": pairs, "p": positives + tie_p, "q": low + tie_q})

    parts = ordered.mapInPandas(count, "part int, replicate int, pairs double, p double, q double")
    before = F.coalesce(F.sum("q").over(Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wins = parts.withColumn("wins", F.col("pairs") + F.col("p") * before).groupBy("replicate").agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return wins.select("replicate", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))


def macro_f1_of_sums(labels: list[str], side: str = "") -> Column:
    """Macro-F1 over the labels from the sums t_i (truth), p_i (guess) and h_i (hits) of each; `side` is put before their names."""
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"{side}h{i}"), F.col(f"t{i}") + F.col(f"{side}p{i}")), F.lit(0.0)) for i in range(len(labels))]
    return sum(f1[1:], f1[0]) / len(labels)


def class_sums(labels: list[str], truth: Column, guesses: dict[str, Column]) -> dict[str, Column]:
    """The indicators that macro_f1_of_sums needs, for several guesses of the same rows: side -> guess."""
    out = {f"t{i}": (truth == v).cast("int") for i, v in enumerate(labels)}
    for side, guess in guesses.items():
        out |= {f"{side}p{i}": (guess == v).cast("int") for i, v in enumerate(labels)} | {f"{side}h{i}": ((guess == v) & (truth == v)).cast("int") for i, v in enumerate(labels)}
    return out


def interval(replicates: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """(low, high): percentile interval over replicates, a few hundred rows; null ones (of rejected resamples) are left out."""
    low = (1 - level) / 2
    return replicates.agg(F.percentile(column, F.lit(low)).alias("low"), F.percentile(column, F.lit(1 - low)).alias("high"))


def calibration_choice(metrics: DataFrame, raw: str, tolerance: float = 0.005) -> DataFrame:
    """metrics (candidate, auc, brier, ece; a row each) with the two rules of taking a calibrated score.

    chosen: the lowest Brier score of raw and those whose AUC is at most `tolerance` below raw's. accepted: Brier score and
    calibration error are both below raw's.
    """
    w = Window.partitionBy(F.lit(0))
    is_raw = F.col("candidate") == raw
    of_raw = lambda c: F.max(F.when(is_raw, F.col(c))).over(w)
    allowed = is_raw | F.coalesce(F.col("auc") >= of_raw("auc") - tolerance, F.lit(False))
    accepted = (F.col("brier") < of_raw("brier")) & (F.col("ece") < of_raw("ece"))
    rows = metrics.withColumn("allowed", allowed).withColumn("accepted", accepted)
    best = F.min(F.when(F.col("allowed"), F.struct("brier", (~is_raw).alias("other"), "candidate"))).over(w)
    return rows.withColumn("_best", best).withColumn("chosen", F.col("candidate") == F.col("_best.candidate")).drop("_best")


def evidence_label(delta: Column, ci_low: Column, folds_improved: Column, proven: Column, identical: Column, degraded: Column) -> Column:
    """What a gain in average precision is evidence of; `proven`: the features were known at the time."""
    none = F.lit("NO_INCREMENTAL_SIGNAL")
    gain = (delta > 0) & ((ci_low > 0) | (folds_improved > 0))
    return F.when(identical, none).when(degraded, "DEGRADED_PERFORMANCE").when(gain & proven, "SUPPORTED_INCREMENTAL_SIGNAL").when(gain, "INCONCLUSIVE_INCREMENTAL_SIGNAL").otherwise(none)


def challenger_wins(sets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(replaces): from a row per validation set with delta (challenger less champion), low, high of its interval and the weak
    class's F1 of both (weak_new, weak_old): every set's interval excludes zero and favours the challenger, no weak F1 is worse
    by more than `tolerance`. At least two sets are needed."""
    better = ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("delta") > 0)
    kept = F.col("weak_new") >= F.col("weak_old") - tolerance
    return sets.agg((F.coalesce(F.every(F.coalesce(better & kept, F.lit(False))), F.lit(False)) & (F.count(F.lit(1)) >= 2)).alias("replaces"))

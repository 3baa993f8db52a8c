"""Mixing sources to target weights.

Method: Poisson replication. Each document has a number in (0, 1) from a seeded hash; the Poisson distribution with its
source's mean repetition rate, inverted at that number, says how often it is used (at most max_repeats times); documents
are exploded by it and put in a global order by another hash. The mean is the one at which the tokens drawn are nearest to
the target. It is found in two passes: the tokens of a source by BINS values of the number bound the mean from both
sides; between the bounds, the documents whose use is still open are counted at STEPS means. Both are solved source by
source by the executors; the driver sees a row per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.session import cut, discard, shuffle_width

BINS = STEPS = 4096
#: Rows of the targets (one per source, a setting, not data) that may be broadcast.
MAX_SOURCES = 10_000


def poisson_cdf(mean: float, upto: int) -> np.ndarray:
    """P(X <= j) for j = 0 .. upto - 1, for any mean."""
    if mean <= 0:
        return np.ones(upto)
    j = np.arange(upto)
    logs = j * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, upto)))])
    return np.minimum(np.exp(np.logaddexp.accumulate(logs)), 1.0)


def _least(meets, low: float = 0.0) -> float:
    """The least mean above `low`, to the precision of a double, that `meets`, a condition that holds from some mean on."""
    high = low + 1.0
    while not meets(high):
        low, high = high, high * 2
    while (mid := (low + high) / 2) not in (low, high):
        low, high = (low, mid) if meets(mid) else (mid, high)
    return high


def bounds(tokens: np.ndarray, wanted: float, cap: int) -> tuple[float, float] | None:
    """Two means between which `wanted` tokens are drawn, by the tokens of each bin; None if even `cap` uses of all give fewer."""
    above = np.r_[np.cumsum(tokens[::-1])[::-1], 0.0, 0.0]
    if above[0] * cap <= wanted:
        return None
    place = lambda mean: (poisson_cdf(mean, cap) * BINS).astype(int)
    # a bin that a use's chance lies in counts whole for the low bound, and not for the high one; at last no number is below a chance
    all_drawn = lambda mean: poisson_cdf(mean, cap)[-1] < 2.0**-54
    low = _least(lambda mean: above[place(mean)].sum() > wanted)
    high = _least(lambda mean: above[place(mean) + 1].sum() >= wanted or all_drawn(mean), 0.0)
    return low * (1 - 1e-12), high


def draw(items: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, uses, wanted) for items (doc_id, source, tokens), a table or `cut`; only documents used at least once; wanted: the tokens their source should give.

    targets: (source, target_share, max_repeats), a source once (the largest share and repeats count if repeated).
    total: the tokens the mix should have; default: those of all documents of named sources. Where max_repeats uses of
    everything fall short of a target, all documents are used max_repeats times; else the tokens of a source differ from
    `wanted` by less than the tokens at one step of the mean: a document, or a few of a large source. Sources that are not named,
    null ones included, and documents without tokens are not used. No items or targets give no rows.
    """
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("int").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    spark = items.sparkSession
    goal = spark.createDataFrame([tuple(r) for r in rows], "source string, share double, cap int")
    number = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    pool = items.select("doc_id", "source", "tokens").where("tokens > 0").join(F.broadcast(goal.select("source")), "source").withColumn("_u", number)
    bins = cut(pool.groupBy("source", F.floor(F.col("_u") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("t")))  # at most BINS rows per source
    total = total or bins.agg(F.sum("t")).first()[0] or 0
    scale = total / (sum(r["share"] for r in rows) or 1.0)

    def enclose(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.zeros(BINS)
        np.add.at(tokens, pdf["bin"].to_numpy(), pdf["t"].to_numpy(dtype=float))
        cap, wanted = int(pdf["cap"].iloc[0]), float(pdf["share"].iloc[0]) * scale
        found = bounds(tokens, wanted, cap)
        if found is None:
            return pd.DataFrame([(pdf["source"].iloc[0], wanted, cap, None, None, None, None, None)], columns=encl)
        low, high = found
        above = np.r_[np.cumsum(tokens[::-1])[::-1], 0.0]
        first, last = (poisson_cdf(high, cap) * BINS).astype(int), np.minimum((poisson_cdf(low, cap) * BINS).astype(int) + 1, BINS)
        return pd.DataFrame([(pdf["source"].iloc[0], wanted, cap, low, high, first.tolist(), last.tolist(), float(above[last].sum()))], columns=encl)

    # of each use the bins that a number must be in to be still open, and the tokens that are drawn in any case
    encl = ["source", "wanted", "cap", "low", "high", "first", "last", "sure"]
    enclosed = cut(bins.join(F.broadcast(goal), "source").groupBy("source").applyInPandas(enclose, "source string, wanted double, cap int, low double, high double, first array<int>, last array<int>, sure double"))
    at = F.floor(F.col("_u") * BINS).cast("int")
    uses = F.posexplode(F.arrays_zip("first", "last")).alias("use", "z")
    still = pool.join(F.broadcast(enclosed.where("low is not null")), "source").select("source", "_u", "tokens", "low", "high", "cap", uses).where((at >= F.col("z.first")) & (at < F.col("z.last")))

    def steps_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chances: dict[str, np.ndarray] = {}
        for pdf in batches:
            for source, part in pdf.groupby("source"):
                if source not in chances:
                    low, high, cap = part[["low", "high", "cap"]].iloc[0]
                    chances[source] = np.array([poisson_cdf(m, int(cap)) for m in np.linspace(low, high, STEPS)])
                for use, some in part.groupby("use"):
                    # the chance of a use falls with the mean: the first step at which it is below the number
                    step = np.searchsorted(-chances[source][:, use], -some["_u"].to_numpy(), side="right")
                    weight = np.bincount(step, weights=some["tokens"].to_numpy(dtype=float), minlength=STEPS + 1)
                    hit = np.flatnonzero(weight)
                    yield pd.DataFrame({"source": source, "step": hit.astype(np.int32), "t": weight[hit]})

    counted = still.select("source", "_u", "tokens", "low", "high", "cap", "use").mapInPandas(steps_of, "source string, step int, t double").groupBy("source", "step").agg(F.sum("t").alias("t"))

    def settle(key, of_source: pd.DataFrame, of_steps: pd.DataFrame) -> pd.DataFrame:
        _, wanted, cap, low, high, _, _, sure = of_source.iloc[0]
        if low is None or np.isnan(low):
            return pd.DataFrame([(key[0], wanted, [0.0] * int(cap))], columns=["source", "wanted", "_chances"])
        weight = np.zeros(STEPS + 1)
        np.add.at(weight, of_steps["step"].to_numpy(), of_steps["t"].to_numpy())
        drawn = sure + np.cumsum(weight)[:STEPS]
        best = int(np.argmin(np.abs(drawn - wanted)))
        return pd.DataFrame([(key[0], wanted, poisson_cdf(np.linspace(low, high, STEPS)[best], int(cap)).tolist())], columns=["source", "wanted", "_chances"])

    means = cut(enclosed.groupBy("source").cogroup(counted.groupBy("source")).applyInPandas(settle, "source string, wanted double, _chances array<double>"))  # a row per source
    discard(bins)
    discard(enclosed)
    used = pool.join(F.broadcast(means), "source")
    return used.select("doc_id", "source", "tokens", F.size(F.filter("_chances", lambda p: p < F.col("_u"))).alias("uses"), "wanted").where("uses > 0")


def mixed(drawn: DataFrame, seed: int = 1) -> DataFrame:
    """(place, doc_id, source, use, tokens) in a global random order: each use of a document is a row, sorted by `place`."""
    rows = drawn.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "uses")).alias("use"))
    rows = rows.select(F.xxhash64("doc_id", "use", F.lit(seed + 1)).alias("place"), "doc_id", "source", "use", "tokens")
    return rows.repartitionByRange(shuffle_width(drawn.sparkSession), "place").sortWithinPartitions("place")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, n_uses, tokens, wanted, actual_share, tokens_met, share_met, limit) for each target.

    actual_share: of all tokens drawn, so where a source falls short the others' shares rise in proportion. tokens_met: the tokens are
    within 1 % of those wanted, or half a document of them; share_met: the actual share is within 1 % of the target's part of all targets.
    limit: why a source gives too little: `no documents`, or `max_repeats` where all are used as often as they may be.
    """
    per = cut(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_uses"), F.max("tokens").alias("_longest"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("wanted").alias("wanted")))
    total = per.agg(F.sum("tokens")).first()[0] or 0
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    part = goal.agg(F.sum(F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share")))).first()[0] or 1.0
    out = goal.join(per, "source", "left").na.fill(0, ["n_documents", "n_uses", "tokens"])
    actual, aim = F.col("tokens") / F.lit(float(max(total, 1))), F.col("target_share") / F.lit(float(part))
    gap = F.abs(F.col("tokens") - F.col("wanted"))
    met = F.coalesce(gap <= F.greatest(0.01 * F.col("wanted"), F.col("_longest") / 2), F.lit(False))
    limit = F.when(F.col("n_documents") == 0, "no documents").when((F.col("n_uses") == F.col("n_documents") * F.col("max_repeats")) & (F.col("tokens") < F.col("wanted")), "max_repeats")
    return out.select("source", "target_share", "max_repeats", "n_documents", "n_uses", "tokens", F.round("wanted").cast("bigint").alias("wanted"), actual.alias("actual_share"), met.alias("tokens_met"), (F.abs(actual - aim) <= 0.01 * aim).alias("share_met"), limit.alias("limit"))

"""Items that appear together.

Method: external sort of packed 64-bit pair codes. A pair of 32-bit item ids is one integer; each task sorts
runs of codes and counts their lengths, the runs are shuffled by code, sorted (spilled and merged where they
exceed memory) and run-length counted again. Pairs come from an equi-join of the baskets' rows on the basket,
which adaptive execution splits where one basket is very large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.session import shuffle_width

#: Codes sorted and counted at once by a task (8 bytes each).
RUN = 1 << 20


def _runs(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of sorted codes (weighted by counts)."""
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    if counts is None:
        return codes[starts], np.diff(np.r_[starts, len(codes)])
    return codes[starts], np.add.reduceat(counts, starts)


def _table(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size >= RUN:
            yield _table(*_runs(np.sort(np.concatenate(held)), None))
            held, size = [], 0
    if size:
        yield _table(*_runs(np.sort(np.concatenate(held)), None))


def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by code; the last run of a batch may go on in the next."""
    code, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = _runs(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        if code is not None:
            if codes[0] == code:
                counts[0] += n
            else:
                codes, counts = np.r_[code, codes], np.r_[n, counts]
        code, n = codes[-1], counts[-1]
        if len(codes) > 1:
            yield _table(codes[:-1], counts[:-1])
    if code is not None:
        yield _table(np.array([code]), np.array([n]))


def pair_counts(lines: DataFrame) -> DataFrame:
    """(a, b, n_both): lines are distinct (basket, item) rows, item a 32-bit integer; a < b; n_both baskets have both."""
    left = lines.select("basket", F.col("item").alias("a"))
    right = lines.select("basket", F.col("item").alias("b"))
    codes = left.join(right, "basket").where("a < b").select(F.expr("shiftleft(cast(a as bigint), 32) | (cast(b as bigint) & 4294967295L)").alias("code"))
    runs = codes.mapInArrow(sorted_runs, "code bigint, n bigint")
    merged = runs.repartition(shuffle_width(lines.sparkSession), "code").sortWithinPartitions("code").mapInArrow(merged_runs, "code bigint, n bigint")
    return merged.select(F.expr("cast(shiftright(code, 32) as int)").alias("a"), F.expr("cast(shiftright(shiftleft(code, 32), 32) as int)").alias("b"), F.col("n").alias("n_both"))


def together(rows: DataFrame, basket: str, item: str, min_both: int = 1, min_share: float = 0.0) -> DataFrame:
    """a, b, n_both, n_a, n_b, n_baskets, expected, lift, odds_ratio for every pair in at least min_both baskets and min_share of all.

    An item counts once per basket; null items and null baskets don't count, but a basket of only null items is a
    basket. Items in fewer baskets than a wanted pair needs are left out before pairs are made, which loses no pair.
    odds_ratio has 0.5 added to each cell (continuity correction). An empty input gives no rows. Ids must be 32-bit integers.
    """
    if dict(rows.dtypes)[item] not in ("int", "smallint", "tinyint"):
        raise TypeError(f"{item} must be a 32-bit integer; number the items first")
    n_baskets = rows.select(basket).where(F.col(basket).isNotNull()).distinct().count()
    least = max(min_both, int(np.ceil(min_share * n_baskets - 1e-9)))
    lines = rows.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).cast("int").alias("item")).distinct()
    support = lines.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if least > 1:
        lines = lines.join(support.select("item"), "item", "left_semi")
    pairs = pair_counts(lines).where(F.col("n_both") >= least)
    pairs = pairs.join(support.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(support.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    n = F.lit(float(n_baskets))
    one = F.col("n_a") - F.col("n_both")
    two = F.col("n_b") - F.col("n_both")
    none = F.lit(n_baskets) - F.col("n_a") - F.col("n_b") + F.col("n_both")
    return pairs.select(
        "a", "b", "n_both", "n_a", "n_b", F.lit(n_baskets).alias("n_baskets"),
        (F.col("n_a") * F.col("n_b") / n).alias("expected"),
        (F.col("n_both") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        ((F.col("n_both") + 0.5) * (none + 0.5) / ((one + 0.5) * (two + 0.5))).alias("odds_ratio"),
    )

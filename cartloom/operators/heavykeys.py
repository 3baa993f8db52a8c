"""Per-key results when a few keys hold most records.

Method: rows are put in order of the composite (key, secondary order) and cut at sampled quantiles of
that order (`repartitionByRange`), so a heavy key is spread over as many partitions as its size needs.
This is the only shuffle of the rows: copies, entities and partial states of a key are all made within a
partition, as equal composite keys never straddle a boundary. Only the states, one per key and partition,
are shuffled again, and the states of a key that crosses a boundary are stitched by adding them. The
secondary order is the entity whose distinct number is wanted, so distinct entities add up exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.session import shuffle_width


def per_key_stats(rows: DataFrame, key: str, entity: str, sums: dict[str, str], parts: int | None = None, record: list[str] | None = None) -> DataFrame:
    """key, n_records, n_entities (distinct) and one column per entry of `sums` (output name -> column).

    record: the columns that, with key and entity, tell a record; rows that agree in them are copies of one and should agree in the
    amounts (the largest counts). Default: every row is a record. Rows whose key is null are left out; a null entity counts as no
    entity; null amounts add nothing (a key with only nulls sums to null). An empty input gives an empty result.
    """
    parts = parts or shuffle_width(rows.sparkSession)
    amounts = [F.col(c).alias(f"_a{i}") for i, c in enumerate(sums.values())]
    own = [F.col(c).alias(f"_r{i}") for i, c in enumerate(record or [])]
    # rows without an entity have no secondary order: theirs is a hash, so that they can be spread too
    salt = F.when(F.col(entity).isNull(), F.pmod(F.xxhash64(*(record or [c for c in sums.values()] or [key])), F.lit(1 << 20)))
    narrow = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(entity).alias("_e"), salt.alias("_salt"), *own, *amounts)
    place = ["_k", "_e", "_salt"]
    pairs = narrow.repartitionByRange(parts, *place)
    names = [f"_a{i}" for i in range(len(amounts))]
    if record is not None:
        pairs = pairs.groupBy(*place, *[f"_r{i}" for i in range(len(own))]).agg(*[F.max(n).alias(n) for n in names] or [F.lit(1).alias("_one")])
    pairs = pairs.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in names])
    stitched = pairs.groupBy("_k").agg(F.sum("_n").alias("n_records"), F.count("_e").alias("n_entities"), *[F.sum(n).alias(out) for n, out in zip(names, sums)])
    return stitched.withColumnRenamed("_k", key)


def heavy_keys(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least `share` of all records of `stats` (made by per_key_stats): key_value, n_records."""
    total = stats.agg(F.sum("n_records")).first()[0] or 0
    return stats.where(F.col("n_records") >= F.lit(share) * F.lit(total)).select(F.col(key).cast("string").alias("key_value"), "n_records")

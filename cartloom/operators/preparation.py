"""Preparing labelled texts for training: copies, conflicting labels, splits by key, quotas of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators import windows as W
from cartloom.operators.contracts import ContractError

# The actions on a group of equal texts with different labels, and the reasons given in the rows.
REMOVE, KEEP, FAIL = "REMOVE_FROM_ALL_SPLITS", "KEEP_IN_TRAIN_ONLY_WITH_FLAG", "FAIL"
CONFLICT_REMOVED, COPY_REMOVED, CONFLICT_KEPT = "CONFLICTING_LABEL_GROUP_REMOVED", "SAME_LABEL_DUPLICATE_REMOVED", "KEEP_IN_TRAIN_ONLY_WITH_FLAG_CONFLICT"


def prepared_rows(rows: DataFrame, row: str, key: str, label: str, action: str, shares: tuple[int, int, int] = (70, 15, 15), salt: str = "prepare") -> DataFrame:
    """(row_index, group_key, split, excluded, exclusion_reason, flagged, flag_reason): what becomes of every row.

    Rows of one key are one group. If its labels differ, `action` says what happens to all its rows (FAIL stops); of a group with
    one label the row with the smallest `row` survives and the others are excluded. Survivors are split in the order of a salted hash
    of the key within each label, in whole percent. A null label is a label of its own; rows without a key are left out.
    """
    rows = rows.where(F.col(key).isNotNull()).select(F.col(row).alias("row_index"), F.col(key).alias("group_key"), F.col(label).alias("_label"))
    marked = F.coalesce(F.col("_label").cast("string"), F.lit("-"))
    groups = rows.groupBy("group_key").agg(F.min("row_index").alias("_first"), (F.min(marked) != F.max(marked)).alias("_conflict"), F.min(marked).alias("_label"))
    if action == FAIL and (n := groups.where("_conflict").count()):
        raise ContractError(f"{n} groups have conflicting labels")
    order = F.sha2(F.concat_ws(":", F.lit(salt), F.col("group_key").cast("string")), 256)
    placed = W.positions_within(groups.where("not _conflict").withColumn("_order", order), ["_label"], [F.col("_order"), F.col("group_key")])
    at, n = F.col("position") * 100, F.col("n_rows")
    split = F.when(at < n * shares[0], "train").when(at < n * (shares[0] + shares[1]), "validation").otherwise("internal_test")
    kept = placed.select("group_key", "_first", F.lit(False).alias("_conflict"), split.alias("_split"))
    fate = kept.unionByName(groups.where("_conflict").select("group_key", "_first", "_conflict", F.lit("train" if action == KEEP else None).alias("_split")))
    out = rows.drop("_label").join(fate, "group_key")
    copy = ~F.col("_conflict") & (F.col("row_index") != F.col("_first"))
    gone = F.col("_conflict") if action == REMOVE else F.lit(False)
    flagged = F.col("_conflict") if action == KEEP else F.lit(False)
    return out.select(
        "row_index", "group_key", F.when(~copy, F.col("_split")).alias("split"), (copy | gone).alias("excluded"), F.when(copy, COPY_REMOVED).when(gone, CONFLICT_REMOVED).alias("exclusion_reason"),
        flagged.alias("flagged"), F.when(flagged, CONFLICT_KEPT).alias("flag_reason"),
    )


def preparation_audit(prepared: DataFrame) -> DataFrame:
    """One row of counts of prepared_rows: rows, groups, copies and conflicting groups' rows removed or flagged, rows of each split."""
    count = lambda c: F.count_if(c)
    reason = F.col("exclusion_reason")
    return prepared.agg(
        F.count(F.lit(1)).alias("total_input_rows"), F.countDistinct("group_key").alias("unique_normalized_groups"), F.countDistinct(F.when(reason == COPY_REMOVED, F.col("group_key"))).alias("same_label_duplicate_groups"),
        count(reason == COPY_REMOVED).alias("same_label_duplicate_rows_removed"), F.countDistinct(F.when((reason == CONFLICT_REMOVED) | F.col("flagged"), F.col("group_key"))).alias("conflicting_label_groups"),
        count(reason == CONFLICT_REMOVED).alias("conflicting_label_rows_removed"), count(F.col("flagged")).alias("conflicting_label_rows_flagged"), *[count(~F.col("excluded") & (F.col("split") == s)).alias(f"n_{s}") for s in ("train", "validation", "internal_test")],
    )


def take_by_deficit(groups: Iterator[tuple], targets: dict[str, tuple[int, int]], later: dict[str, tuple[int, int]] | None = None) -> Iterator[tuple]:
    """(group, bucket, negatives, positives) for groups (name, negatives, positives) in the order given.

    A group goes to the bucket that still lacks most of what it has, the first named of equals, which takes no more of a class than it
    lacks. `later` buckets take, in the same way, from groups that no other bucket has touched, after all others are served, so they
    change nothing. It stops once nothing is lacking.
    """
    lack = {name: list(t) for name, t in targets.items()}
    rest: dict[str, list[int]] = {name: list(t) for name, t in (later or {}).items()}
    spare: list[tuple] = []
    wanted = [sum(t[c] for t in rest.values()) for c in (0, 1)]

    def give(group: tuple, to: dict[str, list[int]]) -> tuple | None:
        parts = {name: (min(d[0], group[1]), min(d[1], group[2])) for name, d in to.items()}
        name = max(parts, key=lambda x: sum(parts[x]), default=None)
        if name is None or not sum(parts[name]):
            return None
        to[name][0] -= parts[name][0]
        to[name][1] -= parts[name][1]
        return (group[0], name, *parts[name])

    for group in groups:
        if got := give(group, lack):
            yield got
        elif any(w > 0 and n for w, n in zip(wanted, group[1:3])):  # untouched: kept for a later bucket as long as one could need it
            spare.append(group)
            wanted = [w - n for w, n in zip(wanted, group[1:3])]
        if not any(map(sum, lack.values())) and max(wanted) <= 0:
            break
    for group in spare:
        if got := give(group, rest):
            yield got


def deficit_quotas(groups: DataFrame, targets: dict[str, tuple[int, int]], later: dict[str, tuple[int, int]] | None = None, seed: str = "quota") -> DataFrame:
    """(item, bucket, n_low, n_high): which groups (item, low, high: their rows of two classes) fill buckets of wanted rows, smallest groups first.

    The assignment is sequential by nature. It runs on the driver over a stream of the groups in order, one partition at a time, and
    ends as soon as nothing is lacking; it keeps a row per group taken, and a group taken gives a row at least, so their number is
    bounded by the sum of the targets, which are settings.
    """
    spark = groups.sparkSession
    order = [F.col("low") + F.col("high"), F.sha2(F.concat_ws(":", F.lit(seed), F.col("item").cast("string")), 256), F.col("item")]
    ordered = groups.where("low + high > 0").select("item", "low", "high").orderBy(*order)
    found = take_by_deficit((tuple(r) for r in ordered.toLocalIterator()), targets, later)
    kind = groups.schema["item"].dataType.simpleString()
    return spark.createDataFrame(list(found), f"item {kind}, bucket string, n_low bigint, n_high bigint")

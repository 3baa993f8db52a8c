"""Profiles, cohorts and audits as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null): one aggregation for all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, n_surplus): null keys count as a key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def waterfall(df: DataFrame, rules: list[tuple[str, Column]], target: Column) -> DataFrame:
    """(step, rule, n_excluded, n_left, n_positive, n_negative, n_unlabelled): ordered exclusion rules in one pass.

    A row falls at the first rule that is not false: if true it is excluded there, if null it silently leaves too, as
    `keep AND NOT rule` has it. Step 0 is the whole table.
    """
    first, counted = F.lit(len(rules) + 1), F.lit(False)
    for i, (_, rule) in reversed(list(enumerate(rules, 1))):
        first = F.when(rule.isNull() | rule, F.lit(i)).otherwise(first)
        counted = F.when(rule.isNull(), F.lit(False)).when(rule, F.lit(True)).otherwise(counted)
    fallen = df.select(first.alias("step"), counted.alias("hit"), target.alias("y")).groupBy("step").agg(
        F.count_if("hit").alias("n_excluded"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"), F.count_if(F.col("y").isNull()).alias("u")
    )
    names = F.create_map(*[x for i, (name, _) in enumerate([("all rows", None), *rules]) for x in (F.lit(i), F.lit(name))])
    steps = df.sparkSession.range(len(rules) + 2).select(F.col("id").cast("int").alias("step"))
    rest = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)  # a row per rule
    left = lambda c: F.coalesce(F.sum(c).over(rest), F.lit(0))
    out = steps.join(fallen, "step", "left").select("step", names[F.col("step")].alias("rule"), F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"), left("n").alias("n_left"), left("p").alias("n_positive"), left("q").alias("n_negative"), left("u").alias("n_unlabelled"))
    return out.where(F.col("step") <= len(rules))


def counts_of(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows for which each of several independent rules is true, in one pass."""
    row = df.agg(*[F.count_if(rule).alias(f"n{i}") for i, rule in enumerate(rules.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n")) for i, name in enumerate(rules)])).alias("p")).select("p.*")


def value_counts(df: DataFrame, column: str, labels: list | None = None) -> DataFrame:
    """(value, n, share): with `labels`, exactly these, absent ones with 0 (share of the labelled rows)."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        all_labels = df.sparkSession.createDataFrame([(x,) for x in labels], n.select("value").schema)
        n = all_labels.join(n, "value", "left").na.fill(0, ["n"])
    return n.select("value", "n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))

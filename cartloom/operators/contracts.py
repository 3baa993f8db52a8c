"""Contracts that stop a pipeline: schemas, keys, ranges, column lists, one-to-one joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A frame does not hold what it promises."""


def require_columns(df: DataFrame, expected: list[str], exact: bool = True) -> DataFrame:
    """df, if its columns are `expected` in this order (exact) or among them (an allow list)."""
    if exact and df.columns != expected:
        raise ContractError(f"Schema mismatch: expected {expected}, found {df.columns}")
    if not exact and (extra := [c for c in df.columns if c not in expected]):
        raise ContractError(f"Columns that are not allowed: {extra}")
    return df


def adapt(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Physical to canonical names; stops on a missing column or on two that would get one name."""
    if missing := [c for c in names if c not in df.columns]:
        raise ContractError(f"Missing columns: {missing}")
    targets = list(names.values())
    if len(set(targets)) < len(targets) or any(t in df.columns and t not in names for t in targets):
        raise ContractError(f"Colliding columns: {targets}")
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, if no row breaks a rule (a null rule counts as broken); one aggregation for all rules."""
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"n{i}") for i, rule in enumerate(rules.values())]).first()
    if broken := {name: n for name, n in zip(rules, row) if n}:
        raise ContractError(f"Rows that break a rule: {broken}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if surplus := df.groupBy(*keys).count().agg(F.sum(F.col("count") - 1)).first()[0]:
        raise ContractError(f"{surplus} repeated rows by {keys}")
    return df


def require_tiers(columns: list[str], tiers: dict[str, list[str]]) -> dict[str, str]:
    """column -> tier; every column in exactly one tier and no tier names an unknown column."""
    found: dict[str, str] = {}
    for tier, names in tiers.items():
        for name in names:
            if name in found:
                raise ContractError(f"{name} is in tiers {found[name]} and {tier}")
            found[name] = tier
    if set(found) != set(columns):
        raise ContractError(f"Columns and tiers differ: {sorted(set(found) ^ set(columns))}")
    return found


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def mapped(column: Column, mapping: dict, strict: bool = True) -> Column:
    """A dictionary as an expression; outside its domain null, or an error if strict (null stays null)."""
    out = F.lit(None)
    if strict:
        out = F.when(column.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("outside the domain: "), column.cast("string"))))
    for key, value in reversed(list(mapping.items())):
        out = F.when(column == F.lit(key), F.lit(value)).otherwise(out)
    return out


def first_match(rules: list[tuple[Column, dict[str, object]]], otherwise: dict[str, object]) -> list[Column]:
    """Ordered rules as columns: the first rule that is true gives the values; a null rule does not match."""
    out = []
    for name, value in otherwise.items():
        column = F.lit(value)
        for rule, values in reversed(rules):
            column = F.when(rule, F.lit(values[name])).otherwise(column)
        out.append(column.alias(name))
    return out

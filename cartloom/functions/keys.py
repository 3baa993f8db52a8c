"""Key spellings: how ids and codes compare, and one record per delivered copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_id(col: Column | str) -> Column:
    """Trimmed, lower case; blank becomes null (refers to nothing)."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text != "", text)


def zip_code(col: Column | str) -> Column:
    """Five-digit code with its leading zeros restored; blank becomes null."""
    text = clean_id(col)
    return F.when(text.rlike("^[0-9]{1,5}$"), F.lpad(text, 5, "0")).otherwise(text)


def one_record(df: DataFrame, keys: list[str], carry: list[str], newest: str | None = None) -> DataFrame:
    """One row per key; the copy with the latest `newest` gives `carry`. Nulls in a key form a key of their own.

    One hash aggregation, combined on the map side, so that copies never travel twice.
    """
    if newest:
        best = F.max_by(F.struct(*carry), F.struct(F.col(newest).isNotNull(), F.col(newest), *carry))
    else:
        best = F.max(F.struct(*carry))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in carry])

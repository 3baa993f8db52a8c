"""Rolling totals over trailing periods, one row per entity and calendar day.

Method: event-contribution deltas. A daily amount is added on its day and subtracted once it leaves the
window; the running sum of the deltas is the trailing total. Between two days with a delta nothing changes,
so days without activity are filled from the interval they lie in. Amounts are summed in integer units (a
parameter: 1/10000 unless said otherwise), so what was added is subtracted without a rounding rest.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Integer units in an amount of 1: amounts are rounded to so many parts.
UNITS = 10_000


def daily_amounts(records: DataFrame, entity: str, day: str, amount: str, parts: int = UNITS) -> DataFrame:
    """entity, day, n (records), units (sum of the amount in parts of 1/parts): combined on the map side, so no entity is too large."""
    units = F.round(F.col(amount) * parts).cast("bigint")
    return records.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(units), F.lit(0)).alias("units"), F.count(amount).alias("priced"))


def trailing(daily: DataFrame, windows: list[int], last_day: dt.date, parts: int = UNITS) -> DataFrame:
    """entity, day, first_day and for each window w: items_w, total_w, avg_w (per record with an amount; null without one).

    parts: as given to daily_amounts. One row for each day from the entity's first to `last_day`. Days after last_day are not used. The rows of an
    entity are at most (1 + windows) x days of the calendar, whatever its number of records.
    """
    cols = [c for w in windows for c in (f"n{w}", f"u{w}", f"p{w}")]
    def delta(w_out: int | None):
        signs = {w: (1 if w_out is None else -1 if w == w_out else 0) for w in windows}
        fields = [(F.col(src) * s).alias(f"{short}{w}") for w, s in signs.items() for short, src in (("n", "n"), ("u", "units"), ("p", "priced"))]
        return F.struct(F.date_add("day", w_out or 0).alias("at"), *fields)
    daily = daily.where(F.col("day") <= F.lit(last_day)).repartition("entity")
    deltas = daily.select("entity", F.explode(F.array(delta(None), *[delta(w) for w in windows])).alias("d")).select("entity", "d.*").where(F.col("at") <= F.lit(last_day))
    deltas = deltas.groupBy("entity", "at").agg(*[F.sum(c).alias(c) for c in cols])
    order = Window.partitionBy("entity").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = deltas.select("entity", "at", F.lead("at").over(order).alias("_next"), F.min("at").over(running).alias("first_day"), *[F.sum(c).over(running).alias(c) for c in cols])
    until = F.coalesce(F.date_sub("_next", 1), F.lit(last_day))
    days = steps.select("entity", F.explode(F.sequence("at", until)).alias("day"), "first_day", *cols)
    out = []
    for w in windows:
        out += [
            F.col(f"n{w}").alias(f"items_{w}"),
            (F.col(f"u{w}") / F.lit(float(parts))).alias(f"total_{w}"),
            F.when(F.col(f"p{w}") > 0, F.col(f"u{w}") / F.lit(float(parts)) / F.col(f"p{w}")).alias(f"avg_{w}"),
        ]
    return days.select("entity", "day", "first_day", *out)

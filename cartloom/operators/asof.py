"""Attributes as known at event time.

Method: the versions of an entity become, in order of the moment each was both true and known, a list of
changes of the version in force. Changes and events form one timeline of narrow rows (entity, time, and a key
of the event); the cumulative number of changes is an event's version number, and the wide attributes are
equi-joined on (entity, number). An entity with a large share of the rows, of versions or of events, is cut at
sampled quantiles of its times, each piece counts for itself, and the pieces' totals (a few rows per cut) are
added as offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cartloom.session import cut, shuffle_width

#: Sampled times per piece, of which the cuts are quantiles (balance only).
SAMPLED = 50


def time_cuts(timeline: DataFrame, pieces: int) -> DataFrame:
    """_entity -> _cuts array<timestamp in microseconds>, only for entities above 1/pieces of all rows: at most `pieces` rows and
    2 x pieces cuts, a share of all rows between two of them.
    """
    all_rows = Observation()
    counts = timeline.groupBy("_entity").agg(F.count(F.lit(1)).alias("_n")).observe(all_rows, F.sum("_n").alias("n"))
    largest = counts.orderBy(F.desc("_n")).limit(pieces).collect()  # no more than `pieces` entities can be above 1/pieces
    total = all_rows.get["n"] or 0
    heavy = {r[0]: r[1] for r in largest if r[1] > total / pieces}
    out = []
    if heavy:
        share = min(1.0, SAMPLED * pieces / sum(heavy.values()))
        times: dict[str, list[int]] = {}
        for entity, us in timeline.where(F.col("_entity").isin([*heavy])).select("_entity", "_us").sample(share, 1).collect():  # about SAMPLED x pieces rows
            times.setdefault(entity, []).append(us)
        for entity, found in times.items():
            found.sort()
            want = -(-heavy[entity] * pieces // total)
            out.append((entity, sorted({found[i * len(found) // want] for i in range(1, want)})))
    cuts = timeline.sparkSession.createDataFrame(out, "_entity string, _cuts array<bigint>")
    cuts._cartloom_none = not out
    return cuts


def none_cut(cuts: DataFrame) -> bool:
    """Whether time_cuts found no large entity, so that the steps for these can be left out of the plan."""
    return getattr(cuts, "_cartloom_none", False)


def _piece():
    return F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_us"))), F.lit(0))


def in_pieces(timeline: DataFrame, cuts: DataFrame) -> DataFrame:
    """timeline plus _piece: 0, or the part of a cut entity that a row's time lies in."""
    if none_cut(cuts):
        return timeline.withColumn("_piece", F.lit(0))
    # `cuts` has at most `pieces` rows: an entity is in it only above 1/pieces of all rows
    return timeline.join(F.broadcast(cuts), "_entity", "left").withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(_piece())).drop("_cuts")


def before_pieces(rows: DataFrame, cuts: DataFrame, total: Callable[[str], Column], name: str) -> DataFrame:
    """(_entity, _piece, name): for every piece of a cut entity the aggregate over the pieces before it; as many rows as pieces.

    total is an aggregate that may be taken of parts again under `name` (a sum or a maximum of a column).
    """
    parts = rows.join(F.broadcast(cuts.select("_entity")), "_entity", "left_semi").groupBy("_entity", "_piece").agg(total(name).alias(name))
    grid = cuts.select("_entity", F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_piece")).join(parts, ["_entity", "_piece"], "left")
    earlier = Window.partitionBy("_entity").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select("_entity", "_piece", total(name).over(earlier).alias(name))


def with_earlier(rows: DataFrame, totals: DataFrame, cuts: DataFrame, total: Callable[[str], Column], name: str, out: str) -> DataFrame:
    """rows plus `out`: before_pieces of `totals` for the piece of each row; null for a first piece and for entities that are not cut."""
    if none_cut(cuts):
        return rows.withColumn(out, F.lit(None).cast(totals.schema[name].dataType))
    return rows.join(F.broadcast(before_pieces(totals, cuts, total, name).withColumnRenamed(name, out)), ["_entity", "_piece"], "left")


def changes_in_force(versions: DataFrame, entity: str, valid_from: str, known_at: str, tie: str, attributes: list[str], pieces: int | None = None) -> DataFrame:
    """The changes of the version in force: _entity, _us (when), number (1, 2, ...), attributes; in the shared folder.

    A version counts from greatest(valid_from, known_at). Of the versions that count, the one with the latest
    valid_from, then latest known_at, then highest `tie` is in force, so a change is a version that beats all
    that counted before it. Versions without an entity or a time are left out; copies are one version.
    """
    pieces = pieces or shuffle_width(versions.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = versions.select(
        F.col(entity).cast("string").alias("_entity"),
        F.greatest(us(valid_from), us(known_at)).alias("_us"),
        F.struct(us(valid_from).alias("v"), us(known_at).alias("k"), F.col(tie).alias("t")).alias("_rank"),
        F.struct(*attributes).alias("_attributes"),
    ).where(F.col("_entity").isNotNull() & F.col("_rank.v").isNotNull() & F.col("_rank.k").isNotNull())
    moments = rows.groupBy("_entity", "_us").agg(F.max(F.struct("_rank", "_attributes")).alias("_top")).select("_entity", "_us", F.col("_top._rank").alias("_rank"), F.col("_top._attributes").alias("_attributes"))
    cuts = time_cuts(rows.select("_entity", "_us"), pieces)
    moments = in_pieces(moments, cuts)
    per_piece = Window.partitionBy("_entity", "_piece").orderBy("_us")
    beaten = F.max("_rank").over(per_piece.rowsBetween(Window.unboundedPreceding, -1))
    ranked = with_earlier(moments.withColumn("_beaten", beaten), moments, cuts, F.max, "_rank", "_earlier").withColumn("_beaten", F.greatest("_beaten", "_earlier"))
    won = ranked.where(F.col("_beaten").isNull() | (F.col("_rank") > F.col("_beaten")))
    won = cut(won.select("_entity", "_piece", "_us", F.row_number().over(per_piece).alias("_place"), F.lit(1).alias("_one"), *[F.col(f"_attributes.{a}").alias(a) for a in attributes]))
    numbered = with_earlier(won, won, cuts, F.sum, "_one", "_offset")
    return numbered.select("_entity", "_us", (F.col("_place") + F.coalesce("_offset", F.lit(0))).cast("int").alias("number"), *attributes)


def as_known(events: DataFrame, entity: str, at: str, changes: DataFrame, attributes: list[str], key: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """events with `attributes` of the version in force at each event's time, and `version_number`.

    changes: from changes_in_force. version_number is 0 and the attributes are null where no version counted yet, and
    for events without an entity or time. Columns of events named like an attribute are replaced. A change at the microsecond
    of an event counts. Repeated events each get their row.
    key: columns that tell an event (rows that agree in them have the same entity and time): only they go on the timeline, and
    the other columns are joined back by them, so events should be a table or `cut`. Without a key all columns travel: for narrow events.
    """
    kept = [c for c in events.columns if c not in attributes]
    pieces = pieces or shuffle_width(events.sparkSession)
    keyed = events.select(F.struct(*(key or kept)).alias("_row"), F.col(entity).cast("string").alias("_entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    whole = F.col("_entity").isNotNull() & F.col("_us").isNotNull()
    narrow, without = keyed.where(whole), keyed.where(~whole)
    if key:
        narrow = narrow.distinct()
    cuts = time_cuts(narrow.select("_entity", "_us"), pieces)
    timeline = narrow.withColumn("_change", F.lit(0)).unionByName(changes.select("_entity", "_us", F.lit(1).alias("_change")), allowMissingColumns=True)
    timeline = in_pieces(timeline, cuts)
    local = Window.partitionBy("_entity", "_piece").orderBy("_us", F.desc("_change")).rowsBetween(Window.unboundedPreceding, 0)
    counted = timeline.withColumn("_local", F.sum("_change").over(local)).where("_change = 0")
    of_changes = in_pieces(changes.select("_entity", "_us", F.lit(1).alias("_change")), cuts)
    numbered = with_earlier(counted, of_changes, cuts, F.sum, "_change", "_offset").select("_row", "_entity", (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("int").alias("version_number"))
    wide = changes.select("_entity", F.col("number").alias("version_number"), F.struct(*attributes).alias("_attributes"))
    found = numbered.join(wide, ["_entity", "version_number"], "left").drop("_entity")
    told = [*[F.col(f"_attributes.{a}").alias(a) for a in attributes], F.coalesce("version_number", F.lit(0)).alias("version_number")]
    if key:
        back = events.select(F.struct(*key).alias("_row"), F.struct(*kept).alias("_event")).join(found, "_row", "left")
        return back.select(*[F.col("_event")[c].alias(c) for c in kept], *told)
    found = found.unionByName(without.select("_row", F.lit(0).alias("version_number")), allowMissingColumns=True)
    return found.select(*[F.col("_row")[c].alias(c) for c in kept], *told)

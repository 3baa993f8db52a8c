"""Windows over what came before: counts, means, rolling and trailing frames, as-of totals, global positions.

"Prior" means strictly before the current row in (time, id) order; nulls in the value are skipped, as by the aggregates.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cartloom.operators.asof import in_pieces, none_cut, time_cuts, with_earlier
from cartloom.session import cut, shuffle_width

DAY_US = 86_400_000_000
#: Ranges of values by which prior_medians counts a large key.
RANGES = 256


def micros(col: Column | str) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def before(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def prior_count(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def prior_rows(agg: Column, keys: list[str], order: list[str], rows: int, least: int) -> Column:
    """An aggregate over the last `rows` prior rows, null with fewer than `least`."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    return F.when(F.count(F.lit(1)).over(frame) >= least, agg.over(frame))


def _trailing(value: Column, keys: list[str], us: str, tie: str, span: int) -> Column:
    """Sum of value over (t - span, t] by time, up to the current row in (time, tie) order."""
    by_time = Window.partitionBy(*keys).orderBy(us)
    peers_after = Window.partitionBy(*keys, us).orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    return F.sum(value).over(by_time.rangeBetween(-span, 0)) - F.coalesce(F.sum(value).over(peers_after), F.lit(0))


def shifted_trailing_mean(df: DataFrame, keys: list[str], us: str, tie: str, value: str, days: int, out: str) -> DataFrame:
    """Mean of the previous rows' values, each stamped with the time of the row after it, over (t - days, t].

    The immediately previous value always counts, however old it is.
    """
    df = df.withColumn("_v", F.lag(value).over(Window.partitionBy(*keys).orderBy(us, tie)))
    span = days * DAY_US - 1
    total = _trailing(F.col("_v").cast("double"), keys, us, tie, span)
    number = _trailing(F.col("_v").isNotNull().cast("long"), keys, us, tie, span)
    return df.withColumn(out, F.try_divide(total, number)).drop("_v")


def trailing_load(keys: list[str], us: str, tie: str, days: int) -> Column:
    """Prior rows with time in [t - days, t]: the lower bound belongs to the frame."""
    return _trailing(F.lit(1), keys, us, tie, days * DAY_US) - 1


def running_by_time(df: DataFrame, ties: list[str], amounts: dict[str, str], pieces: int | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """df plus cum_<name> for each amount, summed per _entity in (_us, ties) order up to and with the row.

    df has _entity (text) and _us. An entity above 1/pieces of all rows is cut at quantiles of its times (cuts: those of time_cuts if
    they are known); each piece is summed for itself and the totals of the pieces before it are added, so no entity is one task's.
    """
    pieces = pieces or shuffle_width(df.sparkSession)
    cuts = time_cuts(df.select("_entity", "_us"), pieces) if cuts is None else cuts
    rows = in_pieces(df, cuts)
    local = Window.partitionBy("_entity", "_piece").orderBy("_us", *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in amounts.items()})
    if none_cut(cuts):
        return out.select(*df.columns, *[F.coalesce(f"_l_{n}", F.lit(0)).alias(f"cum_{n}") for n in amounts])
    totals = rows.join(F.broadcast(cuts.select("_entity")), "_entity", "left_semi").groupBy("_entity", "_piece").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in amounts.items()])
    earlier = Window.partitionBy("_entity").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_entity", "_piece", *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in amounts])
    out = out.join(F.broadcast(offsets), ["_entity", "_piece"], "left")
    return out.select(*df.columns, *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0))).alias(f"cum_{n}") for n in amounts])


def prior_stats(df: DataFrame, key: str, at: str, tie: str, values: list[str], cuts: DataFrame | None = None) -> DataFrame:
    """df plus prior_n and, for each value v, mean_v and std_v (sample) over the rows of the key before each, in (at, tie) order.

    By running_by_time, so a large key is split. Null values are skipped by mean and std but are rows for prior_n. Rows without a key
    or time are left out.
    """
    per, amounts = {}, {"one": "_one"}
    for i, name in enumerate(values):
        v = F.col(name).cast("double")
        per |= {f"_has{i}": v.isNotNull().cast("int"), f"_v{i}": F.coalesce(v, F.lit(0.0)), f"_q{i}": F.coalesce(v * v, F.lit(0.0))}
        amounts |= {c[1:]: c for c in (f"_has{i}", f"_v{i}", f"_q{i}")}
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("string").alias("_entity"), micros(at).alias("_us"), F.col(tie).alias("_tie"), F.lit(1).alias("_one"), *[c.alias(n) for n, c in per.items()])
    run = running_by_time(rows.where("_entity is not null and _us is not null"), ["_tie"], amounts, cuts=cuts)
    out = [(F.col("cum_one") - 1).cast("int").alias("prior_n")]
    for i, name in enumerate(values):
        n, s, q = (F.col(f"cum_{c}{i}") - F.col(f"_{c}{i}") for c in ("has", "v", "q"))
        spread = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
        out += [F.try_divide(s, n).alias(f"mean_{name}"), spread.alias(f"std_{name}")]
    return run.select("_row.*", *out)


def prior_totals(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """df plus prior_n, prior_mean, prior_std (sample) of `value` over the rows of the key before each, in (at, tie) order; as prior_stats."""
    out = prior_stats(df, key, at, tie, [value])
    return out.select(*df.columns, "prior_n", F.col(f"mean_{value}").alias("prior_mean"), F.col(f"std_{value}").alias("prior_std"))


def _with_earlier_values(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of prior_medians, and for the pieces of cut keys (_own false) the earlier values that their medians may be, with how many
    values there are below these and in all before the piece."""
    heavy = rows.join(F.broadcast(cuts.select("_entity")), "_entity", "left_semi").where("_v is not null").select("_entity", "_piece", "_v")
    ranges = heavy.groupBy("_entity").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], F.lit(20 * RANGES)).alias("_edges"))
    ranged = heavy.join(F.broadcast(ranges), "_entity").withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    counts = ranged.groupBy("_entity", "_piece", "_range").agg(F.count(F.lit(1)).alias("_n"))  # RANGES rows per piece
    sizes = rows.join(F.broadcast(cuts.select("_entity")), "_entity", "left_semi").groupBy("_entity", "_piece").agg(F.count(F.lit(1)).alias("_m"))
    grid = sizes.select("_entity", "_piece", "_m", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("_range")).join(counts, ["_entity", "_piece", "_range"], "left")
    earlier = Window.partitionBy("_entity", "_range").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_entity", "_piece").orderBy("_range")
    grid = grid.withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_cum", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_entity", "_piece")))
    low, high = F.floor((F.col("_all") - 1) / 2) - F.col("_m"), F.ceil((F.col("_all") + F.col("_m")) / 2)
    needed = grid.where((F.col("_cum") > low) & (F.col("_cum") - F.col("_n") <= high))
    needs = cut(needed.groupBy("_entity", "_piece").agg(F.min("_range").alias("_a"), F.max("_range").alias("_b"), F.min(F.col("_cum") - F.col("_n")).alias("_below"), F.max("_all").alias("_before")))  # a row per piece
    lists = needs.groupBy("_entity").agg(F.collect_list(F.struct(F.col("_piece").alias("p"), "_a", "_b")).alias("_needs"))
    to = F.filter("_needs", lambda x: (x["p"] > F.col("_piece")) & (x["_a"] <= F.col("_range")) & (x["_b"] >= F.col("_range")))
    sent = ranged.join(F.broadcast(lists), "_entity").select("_entity", F.explode(to).alias("_to"), "_v").select("_entity", F.col("_to.p").alias("_piece"), "_v", F.lit(False).alias("_own"))
    return rows.withColumn("_own", F.lit(True)).unionByName(sent, allowMissingColumns=True).join(F.broadcast(needs.select("_entity", "_piece", "_below", "_before")), ["_entity", "_piece"], "left")


def prior_medians(df: DataFrame, key: str, at: str, tie: str, value: str, out: str, cuts: DataFrame | None = None) -> DataFrame:
    """df plus `out`: the median of `value` over the rows of the key before each, in (at, tie) order; null with none; nulls are skipped.

    A task goes through a piece of a key in order with its values so far in a sorted list. A large key is cut at quantiles of its
    times. Of n values before a piece and m in it, the medians within the piece are among the earlier values of rank n / 2 - m to
    (n + m) / 2: these are sent to it, found by counts per piece and range of values, and how many are below them. So a piece
    handles a few times its own rows, whatever the key has. Rows without a key or time are left out.
    """
    pieces = shuffle_width(df.sparkSession)
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("string").alias("_entity"), micros(at).alias("_us"), F.col(tie).alias("_tie"), F.col(value).cast("double").alias("_v")).where("_entity is not null and _us is not null")
    cuts = time_cuts(rows.select("_entity", "_us"), pieces) if cuts is None else cuts
    rows = in_pieces(rows, cuts)
    both = rows.withColumns({"_own": F.lit(True), "_below": F.lit(0), "_before": F.lit(0)}) if none_cut(cuts) else _with_earlier_values(rows, cuts)
    order = ["_entity", "_piece", "_own", "_us", "_tie"]
    ready = both.repartition(pieces, "_entity", "_piece").sortWithinPartitions(*order).select("_entity", "_piece", "_own", "_v", F.coalesce("_below", F.lit(0)).alias("_below"), F.coalesce("_before", F.lit(0)).alias("_before"), "_row")

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_piece, values, n = None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_entity", "_piece", "_own", "_v", "_below", "_before")]
            keep, found = [], []
            for i, (entity, piece, own, v, below, before) in enumerate(zip(*columns)):
                if (entity, piece) != at_piece:
                    at_piece, values, n = (entity, piece), [], before
                if own:
                    keep.append(i)
                    found.append((values[(n - 1) // 2 - below] + values[n // 2 - below]) / 2 if n else None)
                    n += v is not None
                if v is not None:
                    bisect.insort(values, v)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(keep, pa.int64())), pa.array(found, pa.float64())], ["_row", "_m"])

    done = ready.mapInArrow(medians, f"_row {ready.schema['_row'].dataType.simpleString()}, _m double")
    return done.select("_row.*", F.col("_m").alias(out))


def previous_rows(df: DataFrame, key: str, at: str, tie: str, columns: list[str], cuts: DataFrame | None = None) -> DataFrame:
    """df plus prev_<c> for each of `columns`: the values of the key's row before, in (at, tie) order; null for a key's first row.

    A large key is cut at quantiles of its times; a piece's first row takes the last row of the pieces before it. Rows without a key
    or time are left out.
    """
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("string").alias("_entity"), micros(at).alias("_us"), F.col(tie).alias("_tie"), F.struct(*columns).alias("_c")).where("_entity is not null and _us is not null")
    cuts = time_cuts(rows.select("_entity", "_us"), shuffle_width(df.sparkSession)) if cuts is None else cuts
    rows = in_pieces(rows, cuts)
    ends = rows.select("_entity", "_piece", F.struct("_us", "_tie", "_c").alias("_last"))
    before = F.lag("_c").over(Window.partitionBy("_entity", "_piece").orderBy("_us", "_tie"))
    rows = with_earlier(rows.withColumn("_before", before), ends, cuts, F.max, "_last", "_end").withColumn("_before", F.coalesce("_before", "_end._c"))
    return rows.select("_row.*", *[F.col(f"_before.{c}").alias(f"prev_{c}") for c in columns])


def cuts_of(df: DataFrame, key: str, at: str) -> DataFrame:
    """The cuts of df's large keys (time_cuts), for several of the functions here; df should be a table or `cut`."""
    rows = df.select(F.col(key).cast("string").alias("_entity"), micros(at).alias("_us")).where("_entity is not null and _us is not null")
    return time_cuts(rows, shuffle_width(df.sparkSession))


def by_weight(df: DataFrame, key: str, cuts: DataFrame, plain: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`plain` for the keys that a task can hold, `split` for those of `cuts` (time_cuts); both must give the same columns and results."""
    large = [r[0] for r in cuts.select("_entity").collect()]  # at most as many as pieces
    if not large:
        return plain(df)
    is_large = F.col(key).cast("string").isin(large)
    return plain(df.where(~is_large)).unionByName(split(df.where(is_large)))


def split_trailing(df: DataFrame, key: str, at: str, tie: str, value: str, rows_back: int, least: int, days_back: int, load_days: int) -> DataFrame:
    """df plus mean_rows, mean_days and load: prior_rows, shifted_trailing_mean and trailing_load for keys too large for one task.

    Each row gets its place and the running sum of its key (running_by_time). A frame is the difference of two running sums, and
    the row where it begins is found by its place: for a number of rows by counting back, for a number of days by counting the
    rows before that time (asof_totals); then an equi-join on (key, place). Rows without a key or time are left out.
    """
    kept = df.columns
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*kept).alias("_row"), F.col(key).cast("string").alias("_entity"), micros(at).alias("_us"), F.col(tie).alias("_tie"), F.lit(1).alias("_one"), v.isNotNull().cast("int").alias("_has"), F.coalesce(v, F.lit(0.0)).alias("_v")).where("_entity is not null and _us is not null")
    run = cut(running_by_time(rows, ["_tie"], {"one": "_one", "has": "_has", "v": "_v"}))
    for name, us in (("_n_days", F.col("_us") - days_back * DAY_US + 1), ("_n_load", F.col("_us") - load_days * DAY_US)):
        run = run.withColumn("_probe", F.timestamp_micros(us)).drop("prior_n", "prior_sum")
        run = asof_totals(run, rows.select("_entity", F.timestamp_micros("_us").alias("_t"), "_one"), "_entity", "_probe", "_t", "_one").withColumnRenamed("prior_n", name).drop("prior_sum", "_probe")
    marks = [F.col("_entity"), F.col("cum_one").alias("_place"), F.col("cum_has").alias("_has_at"), F.col("cum_v").alias("_v_at")]
    starts = cut(run).select(*marks)

    def less(frame: DataFrame, place, name: str) -> DataFrame:
        begin = starts.withColumnsRenamed({"_has_at": f"_has_{name}", "_v_at": f"_v_{name}", "_place": f"_place_{name}"})
        return frame.withColumn(f"_place_{name}", place).join(begin, ["_entity", f"_place_{name}"], "left").na.fill(0, [f"_has_{name}", f"_v_{name}"])

    run = less(run, F.col("cum_one") - 1, "end")
    run = less(run, F.col("cum_one") - 1 - rows_back, "rows")
    run = less(run, F.col("_n_days") - 1, "days")
    mean = lambda name: F.try_divide(F.col("_v_end") - F.col(f"_v_{name}"), F.col("_has_end") - F.col(f"_has_{name}"))
    return run.select("_row.*", F.when(F.col("cum_one") - 1 >= least, mean("rows")).alias("mean_rows"), mean("days").alias("mean_days"), (F.col("cum_one") - 1 - F.col("_n_load")).alias("load"))


def asof_totals(probes: DataFrame, facts: DataFrame, key: str, at: str, known: str, value: str, pieces: int | None = None) -> DataFrame:
    """probes plus prior_n and prior_sum over the facts of the key known strictly before the probe's time.

    Both sides go on one timeline; a fact at the probe's very time comes after it. Probes without a key or time have no facts.
    """
    kept = probes.columns
    p = probes.select(F.struct(*kept).alias("_row"), F.col(key).cast("string").alias("_entity"), micros(at).alias("_us"), F.lit(0).alias("_fact"), F.lit(0.0).alias("_v"))
    whole = F.col("_entity").isNotNull() & F.col("_us").isNotNull()
    f = facts.select(F.col(key).cast("string").alias("_entity"), micros(known).alias("_us"), F.lit(1).alias("_fact"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")).where(whole)
    run = running_by_time(p.where(whole).unionByName(f, allowMissingColumns=True), ["_fact"], {"n": "_fact", "s": "_v"}, pieces)
    found = run.where("_fact = 0").select("_row", F.col("cum_n").alias("prior_n"), F.col("cum_s").alias("prior_sum"))
    none = p.where(~whole).select("_row", F.lit(0).cast("bigint").alias("prior_n"), F.lit(0.0).alias("prior_sum"))
    return found.unionByName(none).select("_row.*", "prior_n", "prior_sum")


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """df range-partitioned and sorted, kept in the shared folder, with _part and _row (0-based place within the part).

    A global position or running total then needs one number per part instead of one task for all rows.
    """
    parts = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    marked = parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return cut(marked)


def _with_offsets(ordered: DataFrame, amounts: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """Joins each part's totals of the parts before it (a row per part, as many as shuffle partitions); and the grand totals."""
    rows = ordered.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in amounts.items()]).orderBy("_part").collect()
    run, out = {n: 0 for n in amounts}, []
    for r in rows:
        out.append((r["_part"], *[run[n] for n in amounts]))
        run = {n: run[n] + (r[n] or 0) for n in amounts}
    types = {f.name: f.dataType.simpleString() for f in ordered.select(*[F.sum(c).alias(n) for n, c in amounts.items()]).schema}
    schema = "_part int, " + ", ".join(f"_before_{n} {types[n]}" for n in amounts)
    return ordered.join(F.broadcast(ordered.sparkSession.createDataFrame(out, schema)), "_part"), run


def positions(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """df with `position` (0-based in the global order) and the number of rows. The order should be total."""
    joined, totals = _with_offsets(in_order(df, order), {"n": F.lit(1)})
    return joined.withColumn("position", F.col("_row") + F.col("_before_n")).drop("_part", "_row", "_before_n"), int(totals["n"])


def running_totals(df: DataFrame, order: list[Column], amounts: dict[str, str]) -> tuple[DataFrame, dict[str, float]]:
    """df with cum_<name> for each amount (name -> column), summed in the global order up to and with the row; and the grand totals."""
    joined, totals = _with_offsets(in_order(df, order), {n: F.col(c) for n, c in amounts.items()})
    local = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    for n, c in amounts.items():
        joined = joined.withColumn(f"cum_{n}", F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_before_{n}"))
    return joined.drop("_part", "_row", *[f"_before_{n}" for n in amounts]), totals


def running_within(df: DataFrame, keys: list[str], order: list[Column], amounts: dict[str, str]) -> DataFrame:
    """df plus cum_<name> within each key's rows in the given order and all_<name>, the key's total.

    Rows are ordered by (keys, order) and summed as in running_totals; what lies before a key's first row is taken off. Keys may
    be few and large: no task has a whole key.
    """
    run, totals = running_totals(df, [*[F.col(k) for k in keys], *order], amounts)
    if not keys:
        return run.withColumns({f"all_{n}": F.lit(totals[n]) for n in amounts})
    first = run.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[a for n, c in amounts.items() for a in (F.min(F.col(f"cum_{n}") - F.coalesce(c, F.lit(0))).alias(f"_first_{n}"), F.max(f"cum_{n}").alias(f"_last_{n}"))])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = run.join(first, match)
    return both.select(*df.columns, *[x for n in amounts for x in ((F.col(f"cum_{n}") - F.col(f"_first_{n}")).alias(f"cum_{n}"), (F.col(f"_last_{n}") - F.col(f"_first_{n}")).alias(f"all_{n}"))])


def positions_within(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df plus position (0-based) within its key in the given order, and n_rows of the key."""
    out = running_within(df.withColumn("_one", F.lit(1)), keys, order, {"one": "_one"})
    return out.withColumn("position", F.col("cum_one") - 1).withColumn("n_rows", F.col("all_one")).drop("_one", "cum_one", "all_one")


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation; nulls are skipped, no values give None.

    Distinct values are counted and their counts cumulated in range-partitioned order; only the values at the wanted places (two
    per share) come to the driver. The built-in exact percentile would hold every distinct value in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    run, totals = running_totals(counts, [F.col("x")], {"n": "n"})
    last = (totals["n"] or 0) - 1
    if last < 0:
        return [None] * len(shares)
    places = sorted({p for q in shares for p in (math.floor(q * last), math.ceil(q * last))})
    wanted = F.lit(False)
    for p in places:
        wanted = wanted | ((F.col("cum_n") - F.col("n") <= p) & (F.col("cum_n") > p))
    rows = run.where(wanted).select("x", "n", "cum_n").collect()
    at = {p: r.x for r in rows for p in places if r.cum_n - r.n <= p < r.cum_n}
    return [at[math.floor(q * last)] + (at[math.ceil(q * last)] - at[math.floor(q * last)]) * (q * last - math.floor(q * last)) for q in shares]

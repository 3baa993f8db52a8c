"""References to records that do not exist, at the moment each was delivered.

Method: every key is an integer in its domain: whole numbers of one length by value, hexadecimal ids of one length as
128-bit integers (a high and a low half), any other key by its 128-bit hash. Parent keys and references are
range-partitioned and sorted by it. A task reads its stretch in order, compresses the parent keys into contiguous runs,
matches each reference as of the preceding run start, and reports it if its key lies beyond the run's end, or if the
parent at its place in the run was loaded later or withdrawn before. Only the last parent key of a stretch can be
needed by the next stretch's first references; it is one row per task, so a key that a third of all references name is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.session import cut, shuffle_width

NEVER = np.iinfo(np.int64).max


def key_number(key: Column) -> Column:
    """17 bytes that order cleaned keys: the domain (number of digits of a whole number, 64 + length of a hexadecimal id, 255), then the integer."""
    length = F.length(key)
    whole, hexed = key.rlike("^[0-9]{1,18}$"), key.rlike("^[0-9a-f]{1,32}$")
    number = F.lpad(F.hex(key.try_cast("bigint")), 32, "0")
    domain = F.when(whole, length).when(hexed, length + 64).otherwise(255)
    text = F.when(whole, number).when(hexed, F.lpad(key, 32, "0")).otherwise(F.md5(key))
    return F.when(key.isNotNull(), F.unhex(F.concat(F.lpad(F.hex(domain), 2, "0"), text)))


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(domain, high, low) of an Arrow column of key numbers."""
    first = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]) if len(column) else 0
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=17 * len(column), offset=first).reshape(-1, 17) if len(column) else np.empty((0, 17), dtype=np.uint8)
    halves = np.ascontiguousarray(raw[:, 1:]).view(">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0].astype(np.int64), halves[:, 0], halves[:, 1]


def run_starts(domain: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of sorted different keys begin a run: those that are not the key before plus one."""
    follows = (domain[1:] == domain[:-1]) & (low[1:] == low[:-1] + np.uint64(1)) & (high[1:] == high[:-1] + (low[1:] == 0))
    return np.r_[np.ones(min(len(low), 1), dtype=bool), ~follows]


def matched(keys: DataFrame) -> DataFrame:
    """(_row, _seen, _key, _reason, task, first, gone, n_keys, n_runs) of sorted rows: orphans with their reason; references that come before any
    parent of their task, with no reason; and per task its last parent key, with its marks and the number of its keys and runs.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last = None  # (domain, high, low, first, gone) of the last parent key
        n_keys = n_runs = 0
        names = ["_row", "_seen", "_key", "_reason", "task", "first", "gone", "n_keys", "n_runs"]
        row_type = None

        def out(rows, seen, key, reason, marks=(None, None), counts=(None, None)):
            n = len(rows)
            wide = lambda v, t: pa.array([v] * n, t)
            return pa.RecordBatch.from_arrays([rows, pa.array(seen, pa.int64()), key, pa.array(reason, pa.string()), wide(task, pa.int32()), wide(marks[0], pa.int64()), wide(marks[1], pa.int64()), wide(counts[0], pa.int64()), wide(counts[1], pa.int64())], names)

        last_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, keys_column = batch.column("_row"), batch.column("_key")
            row_type = rows.type
            domain, high, low = _halves(keys_column)
            child = batch.column("_child").to_numpy(zero_copy_only=False)
            seen, gone = (batch.column(c).fill_null(NEVER).to_numpy() for c in ("_seen", "_gone"))
            unseen = np.asarray(batch.column("_seen").is_null())
            # parents, one per key: copies follow each other, also over batches
            at = np.flatnonzero(~child)
            pd_, ph, pl, pf, pg = domain[at], high[at], low[at], seen[at], gone[at]
            if last is not None:
                pd_, ph, pl, pf, pg = (np.r_[np.array([x], dtype=v.dtype), v] for x, v in zip(last, (pd_, ph, pl, pf, pg)))
                at = np.r_[-1, at]
            if len(at):
                new = np.r_[True, (pd_[1:] != pd_[:-1]) | (ph[1:] != ph[:-1]) | (pl[1:] != pl[:-1])]
                heads = np.flatnonzero(new)
                pd_, ph, pl = pd_[heads], ph[heads], pl[heads]
                pf, pg = np.minimum.reduceat(pf, heads), np.minimum.reduceat(pg, heads)
                starts = run_starts(pd_, ph, pl)
                n_keys += len(heads) - (last is not None)
                n_runs += int(starts.sum()) - (last is not None)
            refs = np.flatnonzero(child)
            if len(refs):
                # as of the preceding run start: the run, and the reference's place in it
                key_at = np.searchsorted(at[heads], refs, side="right") - 1 if len(at) else np.full(len(refs), -1)
                known = key_at >= 0
                reason = np.full(len(refs), None, dtype=object)
                if known.any():
                    run = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))[np.maximum(key_at, 0)]
                    step = low[refs] - pl[run]
                    same = (domain[refs] == pd_[run]) & (high[refs] - ph[run] == (low[refs] < pl[run]))
                    inside = known & same & (step <= (key_at - run).astype(np.uint64))
                    mark = np.where(inside, run + np.minimum(step, np.uint64(len(starts) - 1)).astype(np.int64), 0)
                    mark = np.minimum(mark, len(starts) - 1)
                    late = inside & ~unseen[refs] & (pf[mark] != NEVER) & (pf[mark] > seen[refs])
                    deleted = inside & ~unseen[refs] & ~late & (pg[mark] <= seen[refs])
                    reason[known & ~inside], reason[late], reason[deleted] = "missing", "late", "deleted"
                open_ = ~known
                take = np.flatnonzero(open_ | (reason != None))  # noqa: E711
                if len(take):
                    idx = pa.array(refs[take])
                    yield out(rows.take(idx), np.where(unseen[refs[take]], NEVER, seen[refs[take]]), keys_column.take(idx), reason[take])
            if len(at):
                last = (pd_[-1], ph[-1], pl[-1], pf[-1], pg[-1])
                parents = np.flatnonzero(~child)
                if len(parents):
                    last_key = keys_column.slice(int(parents[-1]), 1)
        if last is not None:
            yield out(pa.nulls(1, row_type), [None], last_key, [None], (int(last[3]), int(last[4])), (n_keys, n_runs))

    schema = f"_row {keys.schema['_row'].dataType.simpleString()}, _seen bigint, _key binary, _reason string, task int, first bigint, gone bigint, n_keys bigint, n_runs bigint"
    return keys.mapInArrow(match, schema)


def _sorted_keys(children: DataFrame, parents: DataFrame, ref: Column, seen: Column, parent_key: Column, loaded: Column, gone: Column | None, carry: list[str]) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    refs = children.select(F.struct(*carry).alias("_row"), key_number(ref).alias("_key"), us(seen).alias("_seen"), F.lit(None).cast("bigint").alias("_gone"), F.lit(True).alias("_child"))
    gone = us(gone) if gone is not None else F.lit(None).cast("bigint")
    keys = parents.select(key_number(parent_key).alias("_key"), us(loaded).alias("_seen"), gone.alias("_gone")).where("_key is not null")
    keys = keys.groupBy("_key").agg(F.min("_seen").alias("_seen"), F.min("_gone").alias("_gone"))  # copies are combined before they travel
    keys = keys.select(F.lit(None).cast(refs.schema["_row"].dataType).alias("_row"), "_key", "_seen", "_gone", F.lit(False).alias("_child"))
    # references of one key are told apart by the time they were seen, so that they can lie in several stretches
    order = ["_key", "_child", "_seen"]
    both = refs.where("_key is not null").unionByName(keys)
    return both.repartitionByRange(shuffle_width(children.sparkSession), *order).sortWithinPartitions(*order)


def orphan_references(children: DataFrame, parents: DataFrame, ref: Column, seen: Column, parent_key: Column, parent_loaded: Column, parent_deleted: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of children (default: all) and `reason`: missing, late or deleted; only rows with one.

    ref/parent_key: cleaned key columns (null: refers to nothing, never an orphan). seen: when the child row was
    delivered; null gives only `missing`. late: the parent's first delivery is after `seen`; deleted: it was
    withdrawn at or before `seen`; a parent without times is neither. Repeated child rows are judged one by one; a column
    `reason` of the children is replaced. With no parents all are missing.
    """
    kept = carry or [c for c in children.columns if c != "reason"]
    ordered = _sorted_keys(children, parents, ref, seen, parent_key, parent_loaded, parent_deleted, kept)
    found = cut(matched(ordered))
    known = found.where("_reason is not null").select("_row", F.col("_reason").alias("reason"))
    # the last parent key of each task, and so the last before each task: a row per task
    tasks = found.groupBy("task").agg(F.max(F.when(F.col("n_keys").isNotNull(), F.struct("_key", "first", "gone"))).alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    prior = tasks.select("task", F.last("_last", ignorenulls=True).over(before).alias("_p"))
    open_rows = found.where("_reason is null and n_keys is null").join(F.broadcast(prior), "task")
    here, told = F.coalesce(F.col("_p._key") == F.col("_key"), F.lit(False)), F.col("_seen") != NEVER
    late = told & (F.col("_p.first") != NEVER) & (F.col("_p.first") > F.col("_seen"))
    reason = F.when(~here, "missing").when(late, "late").when(told & (F.col("_p.gone") <= F.col("_seen")), "deleted")
    rest = open_rows.select("_row", reason.alias("reason")).where("reason is not null")
    return known.unionByName(rest).select(*[F.col("_row")[c].alias(c) for c in kept], "reason")


def key_runs(parents: DataFrame, parent_key: Column) -> DataFrame:
    """(n_keys, n_runs): how far the parent keys are compressed: different keys, and contiguous runs of them."""
    nothing = F.lit(None).cast("timestamp")
    nobody = parents.select(F.lit(None).cast("string").alias("_nobody")).limit(0)
    found = matched(_sorted_keys(nobody, parents, F.col("_nobody"), nothing, parent_key, nothing, None, ["_nobody"]))
    # a run that goes on in the next task counts once for each
    return found.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum("n_runs"), F.lit(0)).alias("n_runs"))

"""Operators of problems 2, 3, 4 and 6 against plain Python on random and on awkward rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartloom.functions.keys import clean_id, one_record, zip_code
from cartloom.operators.asof import as_known, changes_in_force, time_cuts
from cartloom.operators.heavykeys import heavy_keys, per_key_stats
from cartloom.operators.orphans import key_runs, orphan_references
from cartloom.operators.rolling import daily_amounts, trailing

T0 = dt.datetime(2021, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


# --- keys


def test_key_spellings(spark):
    rows = spark.createDataFrame([(" AbC ", "1037"), ("", " 01037 "), (None, "x1"), ("  ", None), ("b", "123456")], "a string, z string")
    assert [tuple(r) for r in rows.select(clean_id("a"), zip_code("z")).collect()] == [("abc", "01037"), (None, "01037"), (None, "x1"), (None, None), ("b", "123456")]


def test_one_record_takes_the_newest(spark):
    rows = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(3)), ("a", 2, at(3)), (None, 5, None), ("b", None, at(0))], "k string, v int, t timestamp")
    assert sorted(map(tuple, one_record(rows, ["k"], ["v"], "t").collect()), key=str) == sorted([("a", 2), (None, 5), ("b", None)], key=str)


# --- problem 2


def test_per_key_stats_random(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abcdef"), rng.choice([None, *range(40)]), rng.choice([None, 1.5, 2.0])) for _ in range(2000)] + [(None, 1, 1.0)] * 50
    want = defaultdict(lambda: [0, set(), None])
    for k, e, v in rows:
        if k is not None:
            w = want[k]
            w[0] += 1
            w[1] |= {e} - {None}
            w[2] = w[2] if v is None else (w[2] or 0) + v
    df = spark.createDataFrame(rows, "k string, e int, _k double").withColumnRenamed("_k", "v")
    got = {r.k: (r.n_records, r.n_entities, r.total) for r in per_key_stats(df, "k", "e", {"total": "v"}, parts=7).collect()}
    assert got == {k: (n, len(e), s) for k, (n, e, s) in want.items()}


def test_per_key_stats_edges(spark):
    empty = spark.createDataFrame([], "k string, e int, v double")
    stats = per_key_stats(empty, "k", "e", {"total": "v"})
    assert stats.collect() == [] and heavy_keys(stats, "k", 0.02).collect() == []
    nulls = spark.createDataFrame([("a", None, None), ("a", None, None)], "k string, e int, v double")
    assert [tuple(r) for r in per_key_stats(nulls, "k", "e", {"total": "v"}).collect()] == [("a", 2, 0, None)]


def test_per_key_stats_of_copies(spark):
    rng = random.Random(2)
    records = [(rng.choice("aab"), rng.choice([None, *range(9)]), i, rng.choice([None, 1.0, 2.5])) for i in range(300)]
    df = spark.createDataFrame([r for r in records for _ in range(rng.randrange(1, 4))], "k string, e int, number int, v double")
    got = {r.k: (r.n_records, r.n_entities, r.total) for r in per_key_stats(df, "k", "e", {"total": "v"}, parts=5, record=["number"]).collect()}
    assert got == {k: (len(own := [r for r in records if r[0] == k]), len({e for _, e, *_ in own} - {None}), sum(v or 0 for *_, v in own)) for k in "ab"}
    assert {tuple(r) for r in per_key_stats(df, "k", "e", {}, record=[]).collect()} == {(k, len({r[1] for r in records if r[0] == k}), len({r[1] for r in records if r[0] == k} - {None})) for k in "ab"}
    plan = per_key_stats(df, "k", "e", {"total": "v"}, record=["number"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_a_hot_key_is_spread(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("e"))
    parts = df.repartitionByRange(6, "k", "e").withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 12_000
    hot = per_key_stats(df, "k", "e", {}, parts=6).where("k = 'hot'").first()
    assert (hot.n_records, hot.n_entities) == (26_666, 26_666)


# --- problem 3


def brute_version(versions, entity, moment):
    able = [v for v in versions if v[0] == entity and v[1] is not None and v[2] is not None and v[1] <= moment and v[2] <= moment]
    return max(able, key=lambda v: (v[1], v[2], v[3]))[4] if able else None


@pytest.mark.parametrize("pieces", [1, 5])
def test_as_known_random(spark, pieces):
    rng = random.Random(pieces)
    versions = [(rng.choice("abhhhhh"), at(rng.randrange(60)), at(rng.randrange(60)), i, f"v{i}") for i in range(160)]
    versions += versions[:10] + [(None, at(1), at(1), 900, "x"), ("a", None, at(1), 901, "x"), ("a", at(1), None, 902, "x")]
    events = [(i, "h" if rng.random() < 0.6 else rng.choice(["a", "b", "new", None]), at(rng.randrange(70)) if rng.random() < 0.95 else None) for i in range(400)]
    changes = changes_in_force(spark.createDataFrame(versions, "e string, f timestamp, r timestamp, id int, attr string"), "e", "f", "r", "id", ["attr"], pieces)
    number: dict = {}
    for e, _, n in sorted(map(tuple, changes.select("_entity", "_us", "number").collect())):
        assert n == number.setdefault(e, 0) + 1
        number[e] = n
    df = spark.createDataFrame(events, "_us int, e string, t timestamp")
    got = {r._us: r.attr for r in as_known(df, "e", "t", changes, ["attr"], pieces=pieces).collect()}
    want = {i: (brute_version(versions, e, t) if e and t else None) for i, e, t in events}
    assert got == want
    twice = df.unionByName(df).withColumn("wide", F.lit("w"))
    by_key = as_known(twice, "e", "t", changes, ["attr"], key=["_us"], pieces=pieces).collect()
    assert len(by_key) == 2 * len(events) and {(r._us, r.attr, r.wide) for r in by_key} == {(i, a, "w") for i, a in want.items()}


def test_a_hot_entity_is_cut(spark):
    line = spark.range(1000).select(F.when(F.col("id") < 800, "hot").otherwise(F.col("id").cast("string")).alias("_entity"), F.col("id").alias("_us"))
    cuts = {r[0]: r[1] for r in time_cuts(line, 10).collect()}
    assert list(cuts) == ["hot"] and 5 <= len(cuts["hot"]) <= 10


def test_as_known_empty(spark):
    no_versions = changes_in_force(spark.createDataFrame([], "e string, f timestamp, r timestamp, id int, attr string"), "e", "f", "r", "id", ["attr"])
    events = spark.createDataFrame([(1, "a", at(1), "own")], "id int, e string, t timestamp, attr string")
    assert [tuple(r) for r in as_known(events, "e", "t", no_versions, ["attr"]).collect()] == [(1, "a", at(1), None, 0)]
    assert as_known(events.limit(0), "e", "t", no_versions, ["attr"]).collect() == []


# --- problem 4


def test_trailing_random(spark):
    rng = random.Random(4)
    day = lambda i: dt.date(2022, 1, 1) + dt.timedelta(days=i)
    rows = [(rng.choice(["a", "b", None]), day(rng.randrange(80)) if rng.random() < 0.95 else None, rng.choice([None, 0.0, 0.1, 19.99])) for _ in range(200)]
    last = day(70)
    daily = daily_amounts(spark.createDataFrame(rows, "s string, d date, p double"), "s", "d", "p")
    got = {(r.entity, r.day): r for r in trailing(daily, [7, 30], last).collect()}
    keys = set()
    for s in "ab":
        own = [(d, p) for k, d, p in rows if k == s and d and d <= last]
        for i in range((last - min(d for d, _ in own)).days + 1):
            today = min(d for d, _ in own) + dt.timedelta(days=i)
            keys.add((s, today))
            for w in (7, 30):
                inside = [p for d, p in own if 0 <= (today - d).days < w]
                priced = [p for p in inside if p is not None]
                r = got[s, today]
                assert r[f"items_{w}"] == len(inside) and r[f"total_{w}"] == pytest.approx(sum(priced), abs=1e-9)
                assert r[f"avg_{w}"] == (pytest.approx(sum(priced) / len(priced)) if priced else None)
    assert set(got) == keys


def test_trailing_empty(spark):
    empty = spark.createDataFrame([], "s string, d date, p double")
    assert trailing(daily_amounts(empty, "s", "d", "p"), [7], dt.date(2022, 1, 1)).collect() == []


# --- problem 6


def judge(parents, ref, seen):
    own = [p for p in parents if p[0] == ref]
    if not own:
        return "missing"
    first = min((p[1] for p in own if p[1]), default=None)
    gone = min((p[2] for p in own if p[2]), default=None)
    if seen and first and first > seen:
        return "late"
    return "deleted" if seen and gone and gone <= seen else None


def test_orphans_random(spark):
    rng = random.Random(6)
    keys = [f"{i:05d}" for i in range(0, 3000, 7)] + [f"{i}" for i in range(20)] + [f"{rng.getrandbits(128):032x}" for _ in range(80)] + ["odd key", "x", "zz", "0a"]
    parents = [(k, at(rng.randrange(50)) if rng.random() < 0.9 else None, at(rng.randrange(90)) if rng.random() < 0.3 else None) for k in keys if rng.random() < 0.7 for _ in range(rng.choice([1, 1, 2]))]
    refs = [(i, rng.choice([*keys, None, "00001", "99999", "never"]), at(rng.randrange(90)) if rng.random() < 0.95 else None) for i in range(1500)]
    children = spark.createDataFrame(refs, "runs int, ref string, block timestamp").withColumn("reason", F.lit("old"))
    parent_rows = spark.createDataFrame(parents, "k string, l timestamp, d timestamp")
    got = {r.runs: r.reason for r in orphan_references(children, parent_rows, F.col("ref"), F.col("block"), F.col("k"), F.col("l"), F.col("d")).collect()}
    assert got == {i: why for i, ref, seen in refs if ref is not None and (why := judge(parents, ref, seen))}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_orphans_of_a_hot_parent(spark, batch):
    """Runs, copies and a parent of most references, over the borders of batches and tasks."""
    rng = random.Random(7)
    hexed = [f"{(1 << 64) - 40 + i:032x}" for i in range(80)]  # a run over the border of the two halves
    keys = [f"{i:05d}" for i in range(100, 160)] + hexed
    parents = [(k, at(rng.randrange(40)), at(rng.randrange(40, 90)) if rng.random() < 0.3 else None) for k in keys if k == hexed[40] or rng.random() < 0.9]
    refs = [(i, hexed[40] if rng.random() < 0.7 else rng.choice([*keys, "00099", "00160", f"{(1 << 64) + 41:032x}"]), at(rng.randrange(90))) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        children = spark.createDataFrame(refs, "id int, ref string, t timestamp")
        parent_rows = spark.createDataFrame(parents, "k string, l timestamp, d timestamp")
        got = {r.id: r.reason for r in orphan_references(children, parent_rows, F.col("ref"), F.col("t"), F.col("k"), F.col("l"), F.col("d"), ["id"]).collect()}
        runs = key_runs(parent_rows, F.col("k")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: why for i, ref, seen in refs if (why := judge(parents, ref, seen))} and set(got.values()) == {"missing", "late", "deleted"}
    have = {k for k, _, _ in parents}
    broken = sum(a in have and b not in have for part in (keys[:60] + ["x"], hexed + ["x"]) for a, b in zip(part, part[1:]))
    assert runs.n_keys == len(have) and broken <= runs.n_runs < broken + 4


def test_orphans_empty(spark):
    none = spark.createDataFrame([], "k string, l timestamp, d timestamp")
    child = spark.createDataFrame([(1, "a", at(1)), (2, None, at(1))], "id int, ref string, t timestamp")
    args = (F.col("ref"), F.col("t"), F.col("k"), F.col("l"), F.col("d"))
    assert [(r.id, r.reason) for r in orphan_references(child, none, *args).collect()] == [(1, "missing")]
    assert orphan_references(child.limit(0), none, *args).collect() == []

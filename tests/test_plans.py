"""Queries against plain Python on small tables with awkward rows."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cartloom.operators import metrics as M
from cartloom.plans import catalogue

DAY = dt.timedelta(days=1)


def run(spark, folder, name, **tables):
    """The rows of a query over the given tables: name -> (rows, schema)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return catalogue.QUERIES[name](spark, str(folder)).collect()


def test_all_windows_of_all_suppliers(spark, tmp_path):
    t0 = dt.datetime(1995, 11, 20, 13)
    hot = [(700, t0 + DAY * (i * i % 1200)) for i in range(900)]
    lines = [*hot, (1, t0), (1, t0 + DAY * 1203), (25, t0 + DAY * 500), (25, None), (None, t0), (99, t0 + DAY * 20)]
    suppliers = [700, 1, 25, 3000]
    got = run(spark, tmp_path, "jn11_12_interval_grid", supplier=([(k,) for k in suppliers], "s_suppkey bigint"), lineitem=(lines, "l_suppkey bigint, l_shipdate timestamp"))
    shipped = {k: [t.date() for kk, t in lines if kk == k and t] for k in suppliers}
    starts = [t0.date() + DAY * i for i in range(1204)]
    assert len(got) == len(suppliers) * len(starts)
    assert {(r.s_suppkey, r.day): r.n for r in got} == {(k, s): sum(s <= x < s + 14 * DAY for x in shipped[k]) for k in suppliers for s in starts}


def test_all_windows_of_no_lines(spark, tmp_path):
    assert run(spark, tmp_path, "jn11_12_interval_grid", supplier=([(1,)], "s_suppkey bigint"), lineitem=([], "l_suppkey bigint, l_shipdate timestamp")) == []


TEXTS = ["Olá, Ação!", "ola acao", "l ao", "Olá, Ação!", "شكرا", "شكراً", "شكرا", "Straße 7", "STRASSE 7", "strae 7", "İzmir \u212aelvin", "izmir kelvin", "a  b\tc", "a bc", "", None, None, "none", "Ünï", "12", "\u0661\u0662"]
SCHEMA = "doc_id bigint, text string"


def normal(text):
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]", "", str(text).lower())).strip()


def test_stages_over_all_texts(spark, tmp_path):
    (got,) = run(spark, tmp_path, "tx19_staged_dedup", documents=(list(enumerate(TEXTS)), SCHEMA))
    exact = list(dict.fromkeys(TEXTS))
    left = {normal(t) for t in exact}
    assert got.asDict() == {"n_rows": len(TEXTS), "n_exact": len(TEXTS) - len(exact), "n_near": len(exact) - len(left), "n_left": len(left), "n_no_letters": sum(normal(t) == "" for t in exact) - 1}


def test_stages_over_no_texts(spark, tmp_path):
    (got,) = run(spark, tmp_path, "tx19_staged_dedup", documents=([], SCHEMA))
    assert set(got) == {0}


def test_keys_of_all_texts(spark, tmp_path):
    got = run(spark, tmp_path, "tx03_04_keys", documents=(list(enumerate(TEXTS)), SCHEMA))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: (r.raw_key, r.normal_key) for r in got} == {i: (sha(t or ""), sha(normal(t or ""))) for i, t in enumerate(TEXTS)}
    keys = {r.doc_id: r.normal_key for r in got}
    assert (keys[0], keys[4], keys[10]) == (sha("ol ao"), sha(""), sha("izmir kelvin"))


def test_audit_of_all_notations(spark, tmp_path):
    known = dt.datetime(2022, 1, 1, 12)
    times = {"2022-01-01T11:59:59Z": 1, "2022-01-01T13:00:00+02:00": 1, "2022-01-01T08:59:59.5-03:00": 1, "2022-01-01 11:00:00": 1, "2022-01-01T13:59:59.25+02:00": 1, "2022-01-01T12:00:00": 0, "2022-01-01T14:00:00+02:00": 0, "2022-01-01T09:30:00.125-03:00": 0, "2022-01-01T12:00:00Z": 0, "soon": 0, None: 0}
    log = [(f"p{i}", " S1 " if i % 2 else "s1", t) for i, t in enumerate(times)] + [("q", "s2", "2022-01-01T00:00:00+00:00"), ("r", None, "2022-01-01T00:00:00")]
    (got,) = run(spark, tmp_path, "jn13_point_in_time_audit", prediction_log=(log + log[:4], "prediction_id string, seller_id string, features_as_of string"), seller_history=([("s1", known), ("S1", known + DAY)], "seller_id string, recorded_at timestamp"))
    assert got.asDict() == {"n_predictions": len(log), "n_no_time": 2, "n_without": 2, "n_before": sum(times.values())}


def shop(rows):
    """Tables of orders (state, bought, delivered, due), one customer each."""
    o = [(f"o{i}", f"c{i}", "delivered", b, b, b, x, due, None) for i, (_, b, x, due) in enumerate(rows)]
    times = ", ".join(f"{c} timestamp" for c in ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date", "deleted_at"))
    return {"olist_orders_dataset": (o, f"order_id string, customer_id string, order_status string, {times}"), "olist_customers_dataset": ([(f"c{i}", r[0]) for i, r in enumerate(rows)], "customer_id string, customer_state string")}


def test_all_node_windows(spark, tmp_path):
    rng = random.Random(4)
    t0 = dt.datetime(2020, 12, 20, 15)
    ends = [("A", t0, t0 + 2 * DAY, t0 + DAY), ("A", t0 + 90 * DAY, t0 + 93 * DAY, t0 + 95 * DAY)]
    some = [(rng.choice("AAAB"), b := t0 + DAY * rng.randrange(1, 90), b + DAY * rng.randrange(1, 9), b + DAY * rng.randrange(1, 9)) for _ in range(120)]
    new = [("N", t0 + 85 * DAY, t0 + 89 * DAY, t0 + 85 * DAY), ("N", t0 + 70 * DAY, None, t0 + 85 * DAY), ("B", t0 + 30 * DAY, t0 + 33 * DAY, None)]
    rows = ends + some + new
    got = run(spark, tmp_path, "fq10_node_windows", **shop(rows))
    known = [(k, b.date(), (x - b) / DAY, (x - due) / DAY if due else None) for k, b, x, due in rows if x]
    starts = [t0.date() + DAY * i for i in range(63)]  # the last order is on day 90
    n_train, n_val = round(0.7 * 63), round(0.15 * 63)
    assert len(got) == 3 * len(starts)
    mean = lambda v: sum(v) / len(v) if v else None
    near = lambda v: None if v is None else pytest.approx(v, abs=1e-8)
    pool = [(k, late) for k, day, _, late in known if day < starts[n_train - 1] + 28 * DAY and late is not None]
    for r in got:
        a, b = ([(x, late) for k, day, x, late in known if k == r.node and r.start + DAY * at <= day < r.start + DAY * (at + 14)] for at in (0, 14))
        own = [late for k, late in pool if k == r.node]
        mu, after = mean(own or [late for _, late in pool]), mean([late for _, late in b if late is not None])
        assert (r.n_before, r.mean_before, r.n_after, r.mean_after) == (len(a), near(mean([x for x, _ in a])), len(b), near(mean([x for x, _ in b])))
        assert (r.delay_before, r.delay_after, r.mu) == (near(mean([late for _, late in a if late is not None])), near(after), near(mu))
        assert r.worse == (None if after is None else int(after > mu + 1e-9))
        i = starts.index(r.start)
        assert r.part == ("train" if i < n_train else "val" if i < n_train + n_val else "test")


def test_node_windows_of_a_short_table(spark, tmp_path):
    t0 = dt.datetime(2021, 1, 1)
    assert run(spark, tmp_path, "fq10_node_windows", **shop([("A", t0, t0, t0), ("A", t0 + 27 * DAY, t0 + 28 * DAY, None)])) == []


@pytest.mark.parametrize("candidates, chosen, accepted", [
    ([("raw", 0.8, 0.2, 0.1), ("a", 0.5, 0.1, 0.05), ("b", 0.796, 0.15, 0.2)], "b", {"a"}),  # a has the least Brier, but its AUC collapses
    ([("raw", 0.8, 0.2, 0.1), ("a", 0.5, 0.1, 0.2)], "raw", set()),
    ([("raw", 0.8, 0.2, 0.1), ("a", 0.9, 0.2, 0.05)], "raw", set()),
    ([("raw", 0.8, 0.2, 0.1), ("a", 0.8, 0.19, 0.09)], "a", {"a"}),
])
def test_calibration_choice(spark, candidates, chosen, accepted):
    got = M.calibration_choice(spark.createDataFrame(candidates, "candidate string, auc double, brier double, ece double"), "raw").collect()
    assert [r.candidate for r in got if r.chosen] == [chosen] and {r.candidate for r in got if r.accepted} == accepted


def test_evidence_label(spark):
    cases = [(0.1, 0.01, 3, False, False, False, "INCONCLUSIVE_INCREMENTAL_SIGNAL"), (0.1, 0.01, 3, True, False, False, "SUPPORTED_INCREMENTAL_SIGNAL"), (0.1, -0.01, 1, True, False, False, "SUPPORTED_INCREMENTAL_SIGNAL"), (0.1, -0.01, 0, True, False, False, "NO_INCREMENTAL_SIGNAL"), (0.0, 0.0, 0, False, True, False, "NO_INCREMENTAL_SIGNAL"), (-0.1, -0.2, 0, False, False, True, "DEGRADED_PERFORMANCE"), (0.0, 0.0, 0, False, False, False, "NO_INCREMENTAL_SIGNAL")]
    df = spark.createDataFrame(cases, "a double, b double, c int, d boolean, e boolean, f boolean, want string")
    assert all(r.got == r.want for r in df.select("want", M.evidence_label(*map(F.col, "abcdef")).alias("got")).collect())


@pytest.mark.parametrize("sets, wins", [
    ([(0.1, 0.01, 0.2, 0.5, 0.505), (0.1, 0.02, 0.2, 0.6, 0.5)], True),
    ([(-0.1, -0.2, -0.01, 0.5, 0.5), (0.1, 0.02, 0.2, 0.5, 0.5)], False),  # excludes zero, but favours the champion
    ([(0.1, -0.01, 0.2, 0.5, 0.5), (0.1, 0.02, 0.2, 0.5, 0.5)], False),
    ([(0.1, 0.01, 0.2, 0.4, 0.5), (0.1, 0.02, 0.2, 0.5, 0.5)], False),
    ([(0.1, 0.01, 0.2, 0.5, 0.5)], False),
])
def test_challenger_wins(spark, sets, wins):
    assert M.challenger_wins(spark.createDataFrame(sets, "delta double, low double, high double, weak_new double, weak_old double")).first()[0] is wins

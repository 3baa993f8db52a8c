"""Feature operators against plain Python."""

import datetime as dt
import random

import pytest

from cartloom.operators import windows as W
from cartloom.operators.features import product_features, seller_frames

T0 = dt.datetime(2022, 1, 1)


def test_product_features(spark):
    items = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "q"), ("b", "q"), ("c", "none"), ("d", None)], "order_id string, product_id string")
    products = spark.createDataFrame([("p", "x", 2.0, 1.0, 2.0, 3.0), ("q", None, 4.0, None, 1.0, 1.0)], "product_id string, category string, weight_g double, length_cm double, height_cm double, width_cm double")
    got = {r.order_id: r for r in product_features(items, products).collect()}
    assert (got["a"].weight_g, got["a"].volume_cm3, got["a"].mean_length_cm, got["a"].n_categories) == (8.0, 12.0, 1.0, 1)
    assert (got["b"].weight_g, got["b"].volume_cm3, got["b"].n_categories) == (4.0, None, 0)
    assert (got["c"].weight_g, got["c"].n_categories) == (None, 0) == (got["d"].weight_g, got["d"].n_categories)


def test_frames_of_a_large_seller_are_those_of_the_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([*["hot"] * 7, *"abcdefghij"]), i, T0 + dt.timedelta(hours=rng.randrange(24 * 120)), rng.randrange(2), rng.gauss(3, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id int, t timestamp, y int, h double")
    cuts = W.cuts_of(df, "k", "t")
    assert [r[0] for r in cuts.collect()] == ["hot"]
    near = lambda x: None if x is None else pytest.approx(x)
    values = lambda r: (near(r.late_30d), near(r.late_90d), near(r.days_30d), near(r.late_30), r.load_7d)
    split = {r.id: r for r in seller_frames(df, cuts, "k", "t", "id", "y", "h").collect()}
    plain = {r.id: values(r) for r in seller_frames(df, cuts.limit(0), "k", "t", "id", "y", "h").collect()}
    assert {i: (r.late_30d, r.late_90d, r.days_30d, r.late_30, r.load_7d) for i, r in split.items()} == plain and len(plain) == 500

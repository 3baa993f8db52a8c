"""Scalar functions whose meaning differs between engines, fixed here once."""

from __future__ import annotations

import hashlib
import json
import struct
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
EARTH_KM = 6371.0
#: 2^32 modulo 1,000,000.
WORD_MOD = (1 << 32) % 1_000_000


def sunday_weekday(ts: Column | str) -> Column:
    """0 on Sunday to 6 on Saturday."""
    return F.dayofweek(ts) - 1


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Second boundaries crossed from a to b."""
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def days_between(a: Column | str, b: Column | str) -> Column:
    """Fractional days from a to b."""
    us = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (us(b) - us(a)) / F.lit(86_400_000_000.0)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a))) * (2 * EARTH_KM)


def hash_millionth(text: Column) -> Column:
    """The SHA-256 of a text as a whole number modulo 1,000,000, as a fraction: folded from eight 32-bit words."""
    digest = F.sha2(text, 256)
    words = [F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    rest = F.lit(0).cast("bigint")
    for word in words:
        rest = (rest * WORD_MOD + word) % 1_000_000
    return rest / F.lit(1_000_000.0)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array of doubles; null for a null or empty one."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top) / F.lit(float(temperature))))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _loss(logits: str, label: str, scale: float) -> Column:
    """Negative log-likelihood of the label by the softmax of the scaled logits."""
    top, by = F.array_max(logits), F.lit(scale)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top) * by))
    return F.log(total) - (F.get(logits, F.col(label)) - top) * by


def fit_temperature(rows: DataFrame, logits: str, label: str, passes: int = 4, steps: int = 32) -> float:
    """The temperature at which the softmax of the logits gives the labels (0-based) the least mean negative log-likelihood.

    The likelihood is convex in 1/temperature: each pass tries `steps` values at once, one aggregation over all rows, and the next
    goes between the best one's neighbours. From 1/1000 to 1000; rows with a null label or logits are left out; 1.0 without rows.
    """
    rows = rows.where(F.col(logits).isNotNull() & F.col(label).isNotNull())
    low, high = log(1e-3), log(1e3)
    for _ in range(passes):
        tried = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        found = rows.agg(*[F.avg(_loss(logits, label, exp(-t))) for t in tried]).first()
        if found[0] is None:
            return 1.0
        best = min(range(steps), key=lambda i: found[i])
        low, high = tried[max(best - 1, 0)], tried[min(best + 1, steps - 1)]
    return exp((low + high) / 2)


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def vector_digest(values: list[float]) -> str:
    """SHA-256 of a vector of predictions as little-endian doubles. For the driver: small vectors."""
    return hashlib.sha256(struct.pack(f"<{len(values)}d", *values)).hexdigest()


def json_digest(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

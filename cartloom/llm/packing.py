"""Filling fixed-capacity containers with items.

Method: space-filling-curve order. Each document's hashed tokens are projected to three dimensions, their place on a
Hilbert curve is its key, documents are range-sorted by it and neighbours along the curve are packed together. A task
fills one container after the other along its stretch of the curve: the next items in order while they fit, then of the
LOOK items from the first unpacked one on the largest that still fit. So no container holds items more than LOOK places
apart. An item larger than the capacity is split into full containers and a rest.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tokens import TOKENIZERS, encode
from cartloom.session import cut, shuffle_width

CAPACITY = 2048
#: Places on the curve, from the first unpacked item on, of which the last items of a container are taken.
LOOK = 256
#: Containers that a task should fill at least, so that its last, which is not full, counts for little.
PER_TASK = 64
DIMENSIONS, BITS = 3, 10
#: Seed and size of the hashed token directions.
DIRECTIONS = np.random.default_rng(7).standard_normal((1 << 12, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of `points` (whole numbers below 2^bits), after Skilling's transpose."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sized(docs: DataFrame, folder: str = TOKENIZERS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, tokens, curve) and the columns of `carry`: the number of tokens and the Hilbert key; a text without tokens has 0
    and the middle's key.
    """
    carry = carry or []

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sizes, middles = np.zeros(len(part), dtype=np.int64), np.zeros((len(part), DIMENSIONS))
                for i, text in enumerate(part["text"]):
                    ids = np.asarray(encode(text, folder), dtype=np.int64)
                    sizes[i] = len(ids)
                    if len(ids):
                        middles[i] = DIRECTIONS[(ids * 2654435761 >> 7) & 0xFFF].mean(axis=0)
                grid = np.clip((np.tanh(2 * middles) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                yield part[["doc_id", *carry]].assign(tokens=sizes, curve=hilbert(grid))

    extra = "".join(f"{c} {t}, " for c, t in docs.select(*carry).dtypes)
    return docs.select("doc_id", *carry, "text").mapInPandas(measure, f"doc_id bigint, {extra}tokens bigint, curve bigint")


def fill_along(sizes: Iterator[int], capacity: int, look: int = LOOK) -> Iterator[list[int]]:
    """The places (0, 1, ...) of the items of one container after the other, for items in order of the curve.

    No size is above `capacity` or below 1. All places of a container are within `look` of its first.
    """
    waiting: dict[int, int] = {}  # place -> size, in order
    by_size: list[tuple[int, int]] = []
    coming = enumerate(sizes)
    upto, more = 0, True
    while True:
        first = next(iter(waiting), upto)
        while more and upto < first + look:
            item = next(coming, None)
            if item is None:
                more = False
                break
            waiting[item[0]] = item[1]
            bisect.insort(by_size, (item[1], item[0]))
            upto = item[0] + 1
        if not waiting:
            return
        room, places = capacity, []
        while waiting:
            place = next(iter(waiting))
            size = waiting[place]
            if size > room:  # the next in order does not fit: the largest that does
                at = bisect.bisect_right(by_size, (room, upto)) - 1
                if at < 0:
                    break
                size, place = by_size[at]
            del waiting[place]
            by_size.pop(bisect.bisect_left(by_size, (size, place)))
            places.append(place)
            room -= size
        yield places


def pack(items: DataFrame, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """(container, doc_id, piece, first_token, tokens, place): every document's pieces, one unless it is larger than a container.

    items: (doc_id, tokens, curve), a table or `cut`. No container holds more than `capacity`; documents without tokens (null or 0)
    are in none; copies are packed one by one; no items give no rows. place: along the curve, within a task's stretch. Only the last
    container of a task may have much room left; parts is by default as many tasks as can fill PER_TASK containers each.
    """
    if parts is None:
        total = items.agg(F.sum("tokens")).first()[0] or 0
        parts = max(1, min(shuffle_width(items.sparkSession), total // (capacity * PER_TASK)))
    whole = F.floor(F.col("tokens") / capacity)
    pieces = items.where("tokens > 0").select("doc_id", "curve", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)))).alias("piece"), F.col("tokens").alias("_all"), whole.alias("_whole"))
    pieces = pieces.select("doc_id", "curve", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), F.when(F.col("piece") < F.col("_whole"), F.lit(capacity)).otherwise(F.col("_all") % capacity).alias("tokens"))
    along = pieces.repartitionByRange(parts, "curve", "doc_id", "piece").sortWithinPartitions("curve", "doc_id", "piece")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        rows: dict[int, tuple[int, int, int, int]] = {}  # items that are read and not yet packed

        def read() -> Iterator[int]:
            n = 0
            for pdf in batches:
                for row in zip(*[pdf[c].tolist() for c in ("doc_id", "piece", "first_token", "tokens")]):
                    rows[n] = row
                    n += 1
                    yield row[3]

        out: list[tuple[int, ...]] = []
        columns = ["container", "doc_id", "piece", "first_token", "tokens", "place"]
        for places in fill_along(read(), capacity):
            out += [(number, *rows.pop(p), p) for p in places]
            number += 1
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    return along.mapInPandas(fill, "container bigint, doc_id bigint, piece int, first_token bigint, tokens bigint, place bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, fullest, median_span, widest): how well the containers are used, and over how many places along
    the curve the items of one are spread (at most LOOK, so the median is over few different values).
    """
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("t"), (F.max("place") - F.min("place") + 1).alias("span"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("fill"), F.max("t").alias("fullest"),
        F.median("span").alias("median_span"), F.max("span").alias("widest"),
    )


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    return pack(cut(sized(docs, folder)), capacity)

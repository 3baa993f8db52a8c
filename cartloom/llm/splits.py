"""Splits that keep tied records together.

Method: component swap search. Components start with a hashed split, or with that of an earlier run where it gave all
their records one; whole components are moved or exchanged between splits to bring the sizes and the label counts of the
splits nearer to their targets, by simulated annealing in parallel chains, and the best state found is kept. Components
are placed by levels of size, the large first: a level's components are dealt into blocks of about BLOCK, each block is
annealed by CHAINS tasks toward its share of what the targets still lack, and the best chain of each block counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cartloom.session import cut, discard

SPLITS = ("train", "validation", "test")
SHARES = (0.70, 0.15, 0.15)
#: The first level has the components above 1/LARGE of all records (fewer than LARGE), the second all others: next to the sum of a block any of these is small.
LARGE = 2048
BLOCK, CHAINS = 4096, 3
#: Moves tried per component.
MOVES = 40


def anneal(weights: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int | list[int]) -> tuple[np.ndarray, float]:
    """The split of each component, and how far the sums are off. weights: components x (size, label counts); target: splits x the same."""
    n, k = weights.shape[0], target.shape[0]
    scale = 1.0 / np.maximum(target.sum(axis=0), 1.0)
    scale[0] *= 3.0  # sizes count more than labels
    target, weights = target * scale, weights * scale
    gaps = np.zeros_like(target)
    np.add.at(gaps, start, weights)
    gaps -= target
    cost = float((gaps * gaps).sum())
    best, best_cost = start.tolist(), cost
    if n == 0:
        return start, cost
    steps = MOVES * n + 400
    rng = np.random.default_rng(seed)
    a, b = rng.integers(n, size=steps).tolist(), rng.integers(n, size=steps).tolist()
    to, luck = rng.integers(k, size=steps).tolist(), rng.random(steps)
    swap = (rng.random(steps) < 0.5).tolist()
    heat = max(cost, 1e-12) * 0.05 + float((weights * weights).sum()) / n
    # a worse state is taken if it is worse by less than this, which falls with the heat
    bear = (-np.log(np.maximum(luck, 1e-300)) * heat * 1e-4 ** (np.arange(1, steps + 1) / steps)).tolist()
    off, rows, state = gaps.tolist(), weights.tolist(), start.tolist()
    moved: list[int] = []  # moves since the best state
    for i in range(steps):
        x, y = a[i], b[i]
        p, q = state[x], state[y] if swap[i] else to[i]
        if p == q:
            continue
        w = [u - v for u, v in zip(rows[x], rows[y])] if swap[i] else rows[x]
        from_, into = off[p], off[q]
        change = 0.0
        for u, v, d in zip(from_, into, w):
            change += (v - u + d) * d
        change *= 2.0
        if change < bear[i]:
            off[p], off[q] = [u - d for u, d in zip(from_, w)], [v + d for v, d in zip(into, w)]
            state[x] = q
            moved.append(x)
            if swap[i]:
                state[y] = p
                moved.append(y)
            cost += change
            if cost < best_cost - 1e-15:
                best_cost = cost
                for z in moved:
                    best[z] = state[z]
                moved = []
    return np.array(best), best_cost


def split_groups(records: DataFrame, label: str | None, labels: list, shares: tuple[float, ...] = SHARES, names: tuple[str, ...] = SPLITS, seed: int = 1, before: str | None = None) -> DataFrame:
    """(component, split, mixed) for records with a `component`: all records of a component get one split; in the shared folder.

    label/labels: a column and the values whose shares should be alike in all splits (rows with other values, null
    included, count for the size only). before: a column with the split of an earlier run; a component whose records have one of
    `names` there starts from it, and one whose records have several (of any name) is `mixed`: it can't keep them. Components are
    atoms: one larger than a split's target makes that split larger. Records without a component are left out. No records give no rows.
    """
    counts = [F.count_if(F.col(label) == F.lit(v)).alias(f"c{i}") for i, v in enumerate(labels)] if label else []
    old = F.col(before) if before else F.lit(None).cast("string")
    known = F.col("_low") == F.col("_high")
    place = F.when(known, F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_low")) - 1).otherwise(-1)
    atoms = records.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(old).alias("_low"), F.max(old).alias("_high"), *counts)
    columns = ["size", *[f"c{i}" for i in range(len(counts))]]
    atoms = atoms.select("component", *columns, F.coalesce(place, F.lit(-1)).cast("int").alias("_before"), F.coalesce(~known, F.lit(False)).alias("mixed"))
    seen = Observation()  # the sums are taken while the atoms are written
    atoms = cut(atoms.observe(seen, *[F.sum(c).alias(c) for c in columns]))
    sums = np.array([seen.get[c] or 0 for c in columns], dtype=float)
    share = np.array(shares, dtype=float) / sum(shares)
    levels = [F.col("size") > sums[0] / LARGE, F.col("size") <= sums[0] / LARGE]
    per_level = atoms.agg(*[F.count_if(level) for level in levels]).first()
    lacking = np.outer(share, sums)
    out, used = None, [atoms]
    for level, number in zip(levels, per_level):
        if out is not None and number:
            placed = out.join(atoms, "component").groupBy("split").agg(*[F.sum(c) for c in columns]).collect()  # a row per split
            for row in placed:
                lacking[names.index(row[0])] -= np.array(row[1:], dtype=float)
        if number:
            found, chains = _anneal_level(atoms.where(level), columns, np.maximum(lacking, 0.0), names, share, seed, -(-number // BLOCK))
            used.append(chains)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return atoms.select("component", F.lit(None).cast("string").alias("split"), "mixed")
    out = cut(out.join(atoms.select("component", "mixed"), "component"))
    for kept in used:
        discard(kept)
    return out


def _anneal_level(atoms: DataFrame, columns: list[str], lacking: np.ndarray, names: tuple[str, ...], share: np.ndarray, seed: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(component, split) of the best of CHAINS chains of each block, each toward its part of what is lacking; and the kept table of all chains."""
    portion = lacking / np.maximum(lacking.sum(axis=0), 1e-9)
    steps = np.cumsum(share)[:-1]

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", ignore_index=True)
        mixed = pd.util.hash_pandas_object(pdf["component"], index=False).to_numpy() ^ np.uint64(seed)
        hashed = np.searchsorted(steps, pd.util.hash_array(mixed).astype(np.uint64) / 2.0**64, side="right")
        start = np.where(pdf["_before"] >= 0, pdf["_before"], hashed).astype(int)
        weights = pdf[columns].to_numpy(dtype=float)
        state, cost = anneal(weights, start, portion * weights.sum(axis=0), [seed, *map(int, key)])
        return pd.DataFrame({"component": pdf["component"], "_block": key[0], "_chain": key[1], "split": [names[i] for i in state], "_cost": cost})

    kind = atoms.schema["component"].dataType.simpleString()
    dealt = atoms.withColumn("_block", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(blocks)).cast("int"))
    chains = dealt.withColumn("_chain", F.explode(F.array(*[F.lit(c) for c in range(CHAINS)])))
    found = cut(chains.groupBy("_block", "_chain").applyInPandas(search, f"component {kind}, _block int, _chain int, split string, _cost double"))
    best = found.groupBy("_block").agg(F.min_by("_chain", F.struct("_cost", "_chain")).alias("_chain"))
    return found.join(best, ["_block", "_chain"]).select("component", "split"), found

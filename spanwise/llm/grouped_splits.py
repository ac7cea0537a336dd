"""Splits that keep related records together: component swap search.

Whole components (all records of one group) are assigned to splits with given
shares. Starting from a hashed assignment, annealing moves or exchanges whole
components to reduce the deviation of sizes and of label counts from the
shares, from several starts, and keeps the best.

It runs in parallel: components are put into tiers by size, each tier spanning a
factor of a thousand, and hashed within their tier into blocks of bounded
number. A full block's largest component then is at most a twentieth of it, so
blocks can be balanced on their own. Tiers are taken from the largest
components down, and each aims at what those before it left over. Every
component, however large, goes through the search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.text import plain, unify_split
from spanwise.session import cut

SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}

#: How often at least each component of a block is tried from one start.
TRIES = 8
#: Components of one tier differ in size by less than this factor.
TIER = 1_000


def anneal(sizes: np.ndarray, labels: np.ndarray, aim: np.ndarray, start: np.ndarray, seed: int, steps: int, batch: int = 128) -> tuple[float, np.ndarray]:
    """(energy, split of each component). `aim`: wanted (splits, 1 + labels) totals, size first.

    Proposals are judged in batches of different components: those that pass on
    their own are applied together up to the number that serves best.
    """
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(aim)
    load = np.concatenate([sizes[:, None], labels], axis=1).astype(float)
    scale = np.maximum(load.sum(0), 1.0)
    weight = np.append(1.0, np.full(labels.shape[1], 0.25 / max(1, labels.shape[1])))
    at = start.copy()
    gap = -aim.astype(float)
    np.add.at(gap, at, load)
    cost = lambda g: (weight * np.abs(g) / scale).sum((-2, -1))
    energy = float(cost(gap))
    best, best_at = energy, at.copy()
    if n == 0 or k < 2:
        return best, best_at
    batch = max(1, min(batch, n // 4))
    rounds = math.ceil(max(steps, n) / batch)
    heat, order = max(energy, 1e-6) / 4, np.empty(0, np.int64)
    for r in range(rounds):
        if len(order) < 2 * batch:  # whole permutations, so that each component is tried
            order = np.append(order, rng.permutation(n))
        i, order = order[:batch], order[batch:]
        j = None
        if rng.random() < 0.5 and n > 1:
            j = rng.permutation(n)[: len(i)] if n < 2 * batch + 2 else order[:batch]
            apart = (at[i] != at[j]) & (i != j)
            i, j = i[apart], j[apart]
            _, one = np.unique(np.sort(np.stack([i, j]), axis=0)[0], return_index=True)
            used, keep = set(), []
            for x in one.tolist():  # no component twice in a batch
                if i[x] not in used and j[x] not in used:
                    used.update((int(i[x]), int(j[x])))
                    keep.append(x)
            i, j = i[keep], j[keep]
            a, b, moved = at[i], at[j], load[i] - load[j]
        else:
            i = np.unique(i)
            a, moved = at[i], load[i]
            b = (a + rng.integers(1, k, size=len(i))) % k
        if not len(i):
            continue
        change = np.zeros((len(i), *gap.shape))
        rows = np.arange(len(i))
        change[rows, a] -= moved
        change[rows, b] += moved
        own = cost(gap + change) - energy
        warm = heat * (1 - r / rounds) / len(i) + 1e-12
        picked = np.flatnonzero((own <= 0) | (rng.random(len(i)) < np.exp(-np.maximum(own, 0) / warm)))
        if not len(picked):
            continue
        picked = picked[np.argsort(own[picked], kind="stable")]
        after = np.cumsum(change[picked], axis=0)
        energies = cost(gap + after)
        m = int(np.argmin(energies))
        if energies[m] > energy and rng.random() >= math.exp(-(energies[m] - energy) / warm):
            continue
        taken = picked[: m + 1]
        at[i[taken]] = b[taken]
        if j is not None:
            at[j[taken]] = a[taken]
        gap += after[m]
        energy = float(energies[m])
        if energy < best - 1e-15:
            best, best_at = energy, at.copy()
    return best, best_at


def _search(sizes, labels, aim, hashed, seeds: int, steps: int) -> np.ndarray:
    """The best of several seeds, with `steps` or more, growing with the components; the first starts from the hash, each other from a draw of its own."""
    n, steps = len(sizes), max(steps, TRIES * len(sizes))
    edges = np.cumsum(aim[:, 0]) / max(aim[:, 0].sum(), 1e-9)
    draw = lambda seed: np.minimum(np.searchsorted(edges, np.random.default_rng(1_000 + seed).random(n), "right"), len(aim) - 1)
    runs = [anneal(sizes, labels, aim, draw(seed) if seed else hashed, seed, steps) for seed in range(seeds)]
    return min(runs, key=lambda r: r[0])[1]


def component_table(records: DataFrame, group: Column, record: Column, labels: list[Column], split: Column | None = None) -> DataFrame:
    """(component, grouped, size, labels, present_splits): records without a group are components of their own."""
    split = F.lit(None).cast("string") if split is None else split
    named = F.when(F.coalesce(group != "", F.lit(False)), group)
    rows = records.select(
        F.coalesce(F.concat(F.lit("g:"), named), F.concat(F.lit("r:"), record.cast("string"))).alias("component"),
        named.isNotNull().alias("grouped"), split.alias("split"), *(c.cast("bigint").alias(f"l{i}") for i, c in enumerate(labels)),
    )
    totals = [F.coalesce(F.sum(f"l{i}"), F.lit(0)) for i in range(len(labels))]
    return rows.groupBy("component").agg(
        F.first("grouped").alias("grouped"),
        F.count("*").alias("size"),
        F.array(*totals).cast("array<bigint>").alias("labels"),
        F.array_sort(F.collect_set("split")).alias("present_splits"),
    )


def assign_components(parts: DataFrame, shares: dict[str, float] | None = None, block: int = 20_000, seeds: int = 4, steps: int = 2_000) -> DataFrame:
    """Adds `split` to a component table. Every component gets exactly one split; an empty table stays empty."""
    shares = shares or SHARES
    names = list(shares)
    part = np.array([shares[n] for n in names]) / sum(shares.values())
    parts = cut(parts)
    width = parts.select(F.max(F.size("labels"))).first()[0] or 0
    totals = [F.sum("size").alias("size"), F.count("*").alias("n"), *(F.sum(F.col("labels")[i]).alias(f"l{i}") for i in range(width))]
    vector = lambda r: np.array([float(r["size"]), *(float(r[f"l{i}"] or 0) for i in range(width))])
    total = parts.agg(F.sum("size")).first()[0] or 1
    tier = F.floor(F.log(F.lit(float(total)) / F.greatest("size", F.lit(1))) / math.log(TIER)).cast("int")
    h = F.xxhash64("component")
    drawn = parts.select("component", "size", "labels", tier.alias("tier"), h.alias("h"))
    # One row for each tier: as many as the total has groups of three digits.
    tiers = sorted(drawn.groupBy("tier").agg(*totals).collect(), key=lambda r: r.tier)
    aim = part[:, None] * sum((vector(r) for r in tiers), np.zeros(1 + width))[None, :]
    have = np.zeros_like(aim)
    kind = "component string, size long, labels array<long>, split string"
    placed = parts.sparkSession.createDataFrame([], kind)
    for r in tiers:
        need = np.maximum(aim - have, 0)
        goal = need / np.maximum(need.sum(0), 1e-9)[None, :]
        blocks = max(1, math.ceil(r.n / block))
        own = drawn.where(F.col("tier") == r.tier).select("component", "size", "labels", F.pmod("h", F.lit(blocks)).alias("block"), F.pmod(F.shiftright("h", 20), F.lit(1_000_000)).alias("lot"))
        moved = cut(own.repartition(blocks, "block").groupBy("block").applyInPandas(_solver(goal, names, width, seeds, steps), kind))
        for x in moved.groupBy("split").agg(*totals).collect():
            have[names.index(x.split)] += vector(x)
        placed = placed.unionByName(moved)
    return parts.join(placed.select("component", "split"), "component")


def _solver(goal: np.ndarray, names: list[str], width: int, seeds: int, steps: int):
    edges = np.cumsum(goal[:, 0])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        sizes = pdf["size"].to_numpy(np.int64)
        labels = np.array(pdf["labels"].tolist(), dtype=float).reshape(len(pdf), width)
        hashed = np.minimum(np.searchsorted(edges, pdf["lot"].to_numpy() / 1e6, "right"), len(names) - 1)
        aim = goal * np.append(sizes.sum(), labels.sum(0))[None, :]
        at = _search(sizes, labels, aim, hashed, seeds, steps)
        return pdf[["component", "size", "labels"]].assign(split=[names[a] for a in at])

    return solve


def split_balance(assigned: DataFrame) -> DataFrame:
    """(split, label, records, share): the share that each split has of all records ('size') and of each label's records."""
    long = assigned.select("split", F.posexplode(F.concat(F.array("size"), "labels")).alias("i", "n"))
    label = F.when(F.col("i") == 0, "size").otherwise(F.concat(F.lit("label_"), (F.col("i") - 1).cast("string")))
    sums = long.groupBy("split", label.alias("label")).agg(F.sum("n").alias("records"))
    whole = sums.groupBy("label").agg(F.sum("records").alias("all"))  # one row for each label
    return sums.join(F.broadcast(whole), "label").select("split", "label", "records", F.try_divide("records", "all").alias("share"))


def image_labels(width: int = 6) -> list[Column]:
    """Whether an image record has each of the classes, from its JSON list; malformed lists have none."""
    ids = F.from_json(F.col("class_ids"), "array<int>")
    return [F.coalesce(F.array_contains(ids, i), F.lit(False)).cast("int") for i in range(width)]


def image_components(records: DataFrame) -> DataFrame:
    """Components of image records by leakage_group_id, compared plainly and given trimmed in lower case."""
    return component_table(records, plain(F.col("leakage_group_id")), F.col("record_id"), image_labels(), unify_split(F.col("processed_split")))


def image_splits(records: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(component, grouped, size, labels, present_splits, split) of image records; see component_table and assign_components."""
    return assign_components(image_components(records), shares)


def record_splits(records: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(record_id, component, split): one row for each record."""
    own = plain(F.col("leakage_group_id"))
    name = F.coalesce(F.concat(F.lit("g:"), F.when(own != "", own)), F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    return records.select("record_id", name.alias("component")).join(image_splits(records, shares).select("component", "split"), "component").select("record_id", "component", "split")

"""Complete radius joins of points: Voronoi cells around pivots, then vantage-point trees.

Every point belongs to the cell of its nearest pivot. A point x of cell p can
have a neighbour within r in cell q only if d(x, q) - d(x, p) <= 2 r and
d(x, q) <= reach(q) + r, both by the triangle inequality; x is then repeated
there, and only where q has the larger number, so a pair meets in exactly one
cell. Inside a cell a vantage-point tree prunes by the same inequality.

Nearest pivots are found in two levels: pivots are themselves grouped around
fewer centres, and a block of points of one centre measures only the pivots that the
triangle inequality leaves possible. One pass finds both the cell of a point
and the cells it may be repeated in. Cells with more points than a task should
hold are cut into chunks, and each pair of chunks meets in one task.

Pivots are drawn from a sample of bounded size; they decide where points meet, never
whether they do. Their number has a bound, which is what makes them safe
to broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanwise.session import cut

EARTH_RADIUS_M = 6_371_008.8


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between (latitude, longitude) in degrees, by haversines."""
    a, b = np.radians(a), np.radians(b)
    s = np.sin((a[..., 0] - b[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((a[..., 1] - b[..., 1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(s, 0, 1)))


METRICS = {"euclidean": euclidean, "great_circle": great_circle}


def tree_join(points: np.ndarray, queries: np.ndarray, radius: float, metric, leaf: int = 48):
    """Yields (query, point) index arrays of all pairs within radius, by a vantage-point tree over points."""
    slack = radius * (1 + 1e-9) + 1e-9
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        own, asking = stack.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) <= leaf:
            for i in range(0, len(asking), 16384):
                q = asking[i : i + 16384]
                hit = metric(queries[q][:, None, :], points[own][None, :, :]) <= radius
                a, b = np.nonzero(hit)
                if len(a):
                    yield q[a], own[b]
            continue
        spread = metric(points[own], points[own[len(own) // 2]])
        vantage = points[own[int(np.argmax(spread))]]  # from the rim, distances vary most
        mine, theirs = metric(points[own], vantage), metric(queries[asking], vantage)
        middle = float(np.median(mine))
        inner = mine <= middle
        if inner.all():  # many points as far as the farthest: split them evenly, both halves are asked
            middle_at = len(own) // 2
            low, high = float(mine.min()), float(mine.max())
            near = asking[(theirs >= low - slack) & (theirs <= high + slack)]
            stack += [(own[:middle_at], near), (own[middle_at:], near)]
            continue
        low, high = float(mine.min()), float(mine.max())
        stack.append((own[inner], asking[(theirs <= middle + slack) & (theirs >= low - slack)]))
        stack.append((own[~inner], asking[(theirs >= float(mine[~inner].min()) - slack) & (theirs <= high + slack)]))


class _Pivots:
    """Pivots of one group, grouped around centres."""

    def __init__(self, places: np.ndarray, first: int, metric) -> None:
        self.places, self.first, self.metric = places, first, metric
        self.centres = places[:: max(1, round(len(places) ** 0.5))]
        to = metric(places[:, None, :], self.centres[None, :, :])
        self.home = to.argmin(1)
        self.away = to[np.arange(len(places)), self.home]

    @classmethod
    def of(cls, parts: dict, metric) -> _Pivots:
        """From the plain arrays of `parts`; broadcasts carry those, so that workers need no installed package to read them."""
        out = cls.__new__(cls)
        out.__dict__.update(parts, metric=metric)
        return out

    def parts(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "metric"}

    def cells(self, points: np.ndarray, radius: float, block: int = 2_048):
        """(cell, gap, place, other cell, distance): nearest pivot of each point, and the larger-numbered cells within gap + 2 r of some."""
        cell, gap, at, other, apart = np.zeros(len(points), np.int64), np.zeros(len(points)), [], [], []
        centre = np.concatenate([self.metric(points[i : i + block, None, :], self.centres[None, :, :]).argmin(1) for i in range(0, len(points), block)])
        order = np.argsort(centre, kind="stable")
        starts = np.flatnonzero(np.diff(centre[order], prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], len(order))):
            for i in range(s, e, block):
                rows = order[i : min(i + block, e)]
                own, c = points[rows], self.centres[centre[rows[0]]]
                mine = np.flatnonzero(self.home == centre[rows[0]])
                best = self.metric(own[:, None, :], self.places[mine][None, :, :]).min(1) if len(mine) else np.full(len(own), np.inf)
                # A pivot that matters lies no farther from this centre than its point does, plus what the point may reach.
                reach = float((self.metric(own, c) + best).max() + 2 * radius) * (1 + 1e-9) + 1e-9
                few = np.flatnonzero(self.metric(self.places, c) <= reach)
                for j in range(0, len(rows), step := max(1, 1_000_000 // len(few))):
                    part = rows[j : j + step]
                    d = self.metric(points[part][:, None, :], self.places[few][None, :, :])
                    k = d.argmin(1)
                    near = d[np.arange(len(part)), k]
                    cell[part], gap[part] = self.first + few[k], near
                    slack = 1e-9 * (1 + np.abs(d))
                    a, b = np.nonzero((d - near[:, None] <= 2 * radius + slack) & (few[None, :] > few[k][:, None]))
                    at.append(part[a])
                    other.append(self.first + few[b])
                    apart.append(d[a, b])
        return cell, gap, *(np.concatenate(x) for x in (at, other, apart))


def radius_join(
    points: DataFrame, key: str, group: str, coordinates: tuple[str, ...], radius: float, metric: str = "euclidean", cell_points: int = 4_000, max_pivots: int = 65_536, sample_rows: int = 400_000, task_points: int = 200_000
) -> DataFrame:
    """(key_a, key_b, group, distance): all pairs of one group within radius (inclusive), key_a < key_b.

    Rows with a null key, group or coordinate, or a coordinate that is NaN or
    infinite, have no neighbours; rows that repeat a key of the group count
    once, by the smallest coordinates; points on one spot are neighbours; an
    empty table gives no row. `sample_rows` is the size of the random sample that pivots are
    drawn from, `max_pivots` bounds their number (24 bytes each, broadcast); cells with more than
    `task_points` points are cut into chunks.
    """
    if radius < 0:
        raise ValueError("a radius of at least 0")
    spark, distance, dims = points.sparkSession, METRICS[metric], len(coordinates)
    if metric == "great_circle" and dims != 2:
        raise ValueError("latitude and longitude")
    kinds = dict(points.dtypes)
    xs = [f"x{i}" for i in range(dims)]
    sound = [F.col(key).isNotNull(), F.col(group).isNotNull()] + [F.abs(F.col(c).cast("double")) < float("inf") for c in coordinates]
    clean = points.where(_all(sound)).select(F.col(key).alias("k"), F.col(group).alias("g"), F.struct(*(F.col(c).cast("double").alias(x) for c, x in zip(coordinates, xs))).alias("p"))
    clean = cut(clean.groupBy("g", "k").agg(F.min("p").alias("p")).select("g", "k", "p.*"))
    n = clean.count()
    if n == 0:
        return spark.createDataFrame([], f"{key}_a {kinds[key]}, {key}_b {kinds[key]}, {group} {kinds[group]}, distance double")
    wanted = min(max_pivots, max(1, n // cell_points))
    drawn = clean.sample(min(1.0, sample_rows / n), seed=11).select("g", *xs).toPandas()  # sample_rows on average
    drawn = drawn.sort_values(["g", *xs]).sample(frac=1.0, random_state=7)
    pivots, at = {}, 1  # a group that the sample missed is small and has one cell, 0
    for g, rows in drawn.groupby("g"):
        places = np.unique(rows[xs].to_numpy()[: max(1, round(wanted * len(rows) / len(drawn)))], axis=0)
        pivots[g] = _Pivots(places, at, distance)
        at += len(places)
    shared = spark.sparkContext.broadcast({g: p.parts() for g, p in pivots.items()})

    def place(batches):
        known = {g: _Pivots.of(p, distance) for g, p in shared.value.items()}
        for pdf in batches:
            cells, gaps = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            others = [[] for _ in range(len(pdf))]
            for g, index in pdf.groupby("g").indices.items():
                if g in known:
                    cells[index], gaps[index], who, other, apart = known[g].cells(pdf[xs].to_numpy()[index], radius)
                    for i, c, d in zip(index[who].tolist(), other.tolist(), apart.tolist()):
                        others[i].append({"cell": c, "apart": d})
            yield pdf.assign(cell=cells, gap=gaps, others=others)

    kind = f"g {kinds[group]}, k {kinds[key]}, {', '.join(f'{x} double' for x in xs)}"
    placed = cut(clean.mapInPandas(place, f"{kind}, cell long, gap double, others array<struct<cell: long, apart: double>>"))
    # One row for each cell: no more than max_pivots and the groups that the sample missed.
    census = placed.groupBy("g", "cell").agg(F.max("gap").alias("reach"), F.count("*").alias("n"))
    census = cut(census.select("g", "cell", "reach", F.ceil(F.col("n") / task_points).cast("int").alias("chunks")))
    guests = placed.select("g", "k", *xs, F.explode("others").alias("o")).select("g", "k", *xs, F.col("o.cell").alias("cell"), F.col("o.apart").alias("apart"))
    guests = guests.join(census, ["g", "cell"]).where(F.col("apart") <= (F.col("reach") + radius) * (1 + 1e-9) + 1e-9)
    rows = placed.join(census, ["g", "cell"]).select("g", "k", *xs, "cell", "chunks", F.lit(False).alias("guest"))
    rows = rows.unionByName(guests.select("g", "k", *xs, "cell", "chunks", F.lit(True).alias("guest")))
    # Chunks a <= b meet in the task (a, b); a guest goes along with all chunks of the cell's own points.
    own = F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    mine = F.transform(every, lambda b: F.struct(F.least(F.col("chunk"), b).alias("a"), F.greatest(F.col("chunk"), b).alias("b")))
    along = F.transform(every, lambda b: F.struct(b.alias("a"), b.alias("b")))
    rows = rows.withColumn("chunk", own).select("g", "k", *xs, "cell", "guest", "chunk", F.explode(F.when(F.col("guest"), along).otherwise(mine)).alias("m")).select("g", "k", *xs, "cell", "guest", "chunk", "m.*")

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, g = [], pdf["g"].iloc[0]
        a_chunk, b_chunk = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        p, keys, guest, chunk = pdf[xs].to_numpy(), pdf["k"].to_numpy(), pdf["guest"].to_numpy(bool), pdf["chunk"].to_numpy()
        own = np.flatnonzero(~guest & (chunk == a_chunk))
        asking = np.arange(len(p)) if a_chunk == b_chunk else np.flatnonzero(chunk == b_chunk)
        for q, i in tree_join(p[own], p[asking], radius, distance):
            q, i = asking[q], own[i]
            if a_chunk == b_chunk:
                keep = guest[q] | (q < i)  # own pairs are met from both ends
                q, i = q[keep], i[keep]
            x, y = keys[q], keys[i]
            flip = x > y
            parts.append(pd.DataFrame({f"{key}_a": np.where(flip, y, x), f"{key}_b": np.where(flip, x, y), group: g, "distance": distance(p[q], p[i])}))
        names = [f"{key}_a", f"{key}_b", group, "distance"]
        return pd.concat(parts)[names] if parts else pd.DataFrame({c: [] for c in names}).astype({"distance": float})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(at, math.ceil(n / (4 * cell_points))))
    found = rows.repartition(tasks, "g", "cell", "a", "b").groupBy("g", "cell", "a", "b").applyInPandas(join_cell, f"{key}_a {kinds[key]}, {key}_b {kinds[key]}, {group} {kinds[group]}, distance double")
    return found


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & F.coalesce(c, F.lit(False))
    return out


def near_defects(defects: DataFrame, inspections: DataFrame, radius: float = 0.25) -> DataFrame:
    """(defect_id_a, defect_id_b, structure_id, distance): located defects of one structure within radius metres.

    A defect counts once, if its inspection exists and its position is given in
    the frame 'map', without null or NaN and not at (0, 0, 0), which stands for
    no position.
    """
    located = defects.where("coordinate_frame = 'map' and not (x_m = 0 and y_m = 0 and z_m = 0)").select("defect_id", F.col("inspection_id").alias("i"), "x_m", "y_m", "z_m")
    owners = inspections.groupBy(F.col("inspection_id").alias("i")).agg(F.min("structure_id").alias("structure_id"))
    return radius_join(located.join(owners, "i"), "defect_id", "structure_id", ("x_m", "y_m", "z_m"), radius)

"""Ordered, stateful fusion of spatial observations into persistent defects, with idempotent replay."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions.scalars import finite
from spanwise.operators.graph import linked_groups
from spanwise.session import cut

COLUMNS = ("seq", "inspection_id", "observation_id", "class_id", "track_id", "confidence", "x_m", "y_m", "z_m", "ts")


class ReplayConflict(ValueError):
    """An observation id came again with other content."""


def fingerprint() -> Column:
    """SHA-256 of an observation's canonical text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in COLUMNS if c != "seq"]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


@dataclass(frozen=True)
class Naming:
    """How defects are named: prefix and version-5 UUID of urn:inspection:observation."""

    prefix: str = "D-"
    urn: str = "urn:spanwise:defect:v1"

    def of(self, inspection_id: int, observation_id: str) -> str:
        return self.prefix + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.urn}:{inspection_id}:{observation_id}"))


@dataclass
class Defect:
    """One persistent defect; sums are kept exactly so that order of arrival can't blur a mean."""

    defect_id: str
    n: int = 0
    parts: dict = field(default_factory=lambda: {"confidence": [], "x": [], "y": [], "z": []})
    tracks: dict = field(default_factory=dict)
    first: object = None
    last: object = None

    def __post_init__(self) -> None:
        self.centre = self._mean() if self.n else None

    def _mean(self) -> tuple[float, ...]:
        return tuple(sum(self.parts[k]) / self.n + 0.0 for k in "xyz")

    def add(self, o: dict) -> None:
        self.n += 1
        for k, v in (("confidence", o["confidence"]), ("x", o["x_m"]), ("y", o["y_m"]), ("z", o["z_m"])):
            self.parts[k] = _partials(self.parts[k], float(v))
        self.centre = self._mean()
        if o["track_id"] is not None:
            self.tracks[o["track_id"]] = self.tracks.get(o["track_id"], 0) + 1
        self.first = o["ts"] if self.first is None else min(self.first, o["ts"])
        self.last = o["ts"] if self.last is None else max(self.last, o["ts"])

    def body(self) -> dict:
        """What to_json keeps of it."""
        return {"n": self.n, "parts": self.parts, "tracks": self.tracks, "first": pd.Timestamp(self.first).isoformat(), "last": pd.Timestamp(self.last).isoformat()}

    @classmethod
    def of(cls, defect_id: str, body: dict) -> Defect:
        if set(body) != {"n", "parts", "tracks", "first", "last"}:
            raise ValueError(f"inconsistent defect {defect_id}")
        return cls(defect_id, body["n"], body["parts"], body["tracks"], pd.Timestamp(body["first"]), pd.Timestamp(body["last"]))

    def track(self) -> str | None:
        """The most frequent track, ties to the smaller name."""
        return min(self.tracks, key=lambda t: (-self.tracks[t], t)) if self.tracks else None


def _partials(partials: list[float], x: float) -> list[float]:
    """Non-overlapping partial sums that hold an exact total in bounded space."""
    out = []
    for y in partials:
        if abs(x) < abs(y):
            x, y = y, x
        high = x + y
        low = y - (high - x)
        if low:
            out.append(low)
        x = high
    return [*out, x]


@dataclass
class State:
    """Defects and known observations of one inspection and class."""

    defects: dict[str, Defect] = field(default_factory=dict)
    seen: dict[str, tuple[str, str]] = field(default_factory=dict)  # observation: fingerprint, defect
    naming: Naming = field(default_factory=Naming)
    cells: dict[tuple[int, ...], set[str]] | None = None  # defects by cell of a grid as wide as the radius

    def _cell(self, at: tuple[float, ...], radius: float) -> tuple[int, ...]:
        width = max(radius, 1e-9) * (1 + 1e-9)
        return tuple(math.floor(x / width) for x in at)

    def _near(self, at: tuple[float, ...], radius: float) -> list[Defect]:
        """Defects in the cells around a place; none within the radius lies elsewhere."""
        if self.cells is None:
            self.cells = {}
            for d in self.defects.values():
                self.cells.setdefault(self._cell(d.centre, radius), set()).add(d.defect_id)
        x, y, z = self._cell(at, radius)
        around = ((x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
        return [self.defects.get(k) for c in around for k in self.cells.get(c, ())]

    def ingest(self, o: dict, radius: float) -> tuple[str, str]:
        """(decision, defect_id): REPLAY of a known observation, ASSOCIATED with a defect within radius, or CREATED. One state has one radius."""
        known = self.seen.get(o["observation_id"])
        if known:
            if known[0] != o["fingerprint"]:
                raise ReplayConflict(o["observation_id"])
            return "REPLAY", known[1]
        best, at = None, (o["x_m"], o["y_m"], o["z_m"])
        for d in self._near(at, radius):
            gap = math.dist(d.centre, at)
            if gap <= radius:
                rank = (not (o["track_id"] is not None and o["track_id"] in d.tracks), gap, d.defect_id)
                best = min(best, (rank, d), key=lambda x: x[0]) if best else (rank, d)
        if best:
            decision, defect = "ASSOCIATED", best[1]
        else:
            decision, defect = "CREATED", Defect(self.naming.of(o["inspection_id"], o["observation_id"]))
        if defect.centre is not None:
            self.cells[self._cell(defect.centre, radius)].discard(defect.defect_id)
        defect.add(o)
        self.defects[defect.defect_id] = defect
        self.cells.setdefault(self._cell(defect.centre, radius), set()).add(defect.defect_id)
        self.seen[o["observation_id"]] = (o["fingerprint"], defect.defect_id)
        return decision, defect.defect_id

    def to_json(self) -> str:
        """Canonical text of the state: sorted keys, stamps in ISO form, exact partial sums."""
        return json.dumps({"defects": {k: d.body() for k, d in self.defects.items()}, "seen": self.seen}, sort_keys=True, separators=(",", ":"), allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> State:
        """The state of to_json; other keys, a count that isn't its observations' or an unknown defect are errors."""
        raw = json.loads(text)
        if set(raw) != {"defects", "seen"}:
            raise ValueError("unknown or missing keys")
        state = cls(seen={k: (f, d) for k, (f, d) in raw["seen"].items()})
        for k, d in raw["defects"].items():
            state.defects[k] = Defect.of(k, d)
            if d["n"] != sum(own == k for _, own in state.seen.values()):
                raise ValueError(f"inconsistent defect {k}")
        if any(own not in state.defects for _, own in state.seen.values()):
            raise ValueError("observations of unknown defects")
        return state


def rows_of(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.sort_values("seq", kind="stable").to_dict("records")
    for r in rows:
        r["track_id"] = None if pd.isna(r["track_id"]) else r["track_id"]
    return rows


def usable() -> Column:
    """Whether an observation can be fused: its ids, class, place in the order and time are known, position and confidence finite numbers."""
    out = F.lit(True)
    for c in ("seq", "inspection_id", "observation_id", "class_id", "ts"):
        out = out & F.col(c).isNotNull()
    for c in ("confidence", "x_m", "y_m", "z_m"):
        out = out & finite(F.col(c))
    return out


def refused(keyed: DataFrame) -> DataFrame:
    """The decisions on observations that can't be fused: REJECTED, of no defect."""
    return keyed.where(~usable()).select("seq", "inspection_id", "class_id", "observation_id", F.lit("REJECTED").alias("decision"), F.lit(None).cast("string").alias("defect_id"))


def conflicts(observations: DataFrame) -> DataFrame:
    """Observation ids of an inspection that come with different content."""
    f = observations.withColumn("fingerprint", fingerprint())
    return f.groupBy("inspection_id", "observation_id").agg(F.count_distinct("fingerprint").alias("forms")).where("forms > 1")


def independent_units(observations: DataFrame, radius: float) -> DataFrame:
    """Adds `unit`: observations of one inspection and class that may come to depend on each other.

    An observation joins a defect within the radius of its mean. By induction
    the mean squared distance of a defect's members to their mean is at most the radius
    squared, so some member lies within the radius of the mean, and within twice
    the radius of the new one. Observations that no chain of such steps links never meet;
    chains are found over the cells of a grid twice the radius wide.
    """
    width = max(2 * radius, 1e-9) * (1 + 1e-6)
    axes = [F.floor(F.col(c) / width).cast("bigint") for c in ("x_m", "y_m", "z_m")]
    name = lambda cells: F.concat_ws("/", F.col("inspection_id").cast("string"), F.col("class_id").cast("string"), *(c.cast("string") for c in cells))
    celled = observations.select("*", *(a.alias(f"__{i}") for i, a in enumerate(axes))).withColumn("__cell", name([F.col(f"__{i}") for i in range(3)]))
    cells = cut(celled.select("inspection_id", "class_id", "__0", "__1", "__2", "__cell").distinct())
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    beside = F.array(*(name([F.col("__0") + i, F.col("__1") + j, F.col("__2") + k]) for i, j, k in half))
    links = cells.select(F.col("__cell").alias("a"), F.explode(beside).alias("b")).join(cells.select(F.col("__cell").alias("b")), "b", "left_semi")
    groups = linked_groups(links, "a", "b").select(F.col("id").alias("__cell"), F.col("group_id").alias("__group"))
    units = cells.select("__cell").join(groups, "__cell", "left").select("__cell", F.coalesce("__group", "__cell").alias("unit"))
    return celled.join(units, "__cell").drop("__cell", "__0", "__1", "__2")


def fuse(observations: DataFrame, radius: float = 0.25, naming: Naming = Naming(), unit_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(decisions, defects) of observations taken in order of `seq`.

    Observations that aren't `usable` are REJECTED and have no defect. Replays are
    found by a shuffle first and don't enter the fold; a replay with other content fails the batch. The fold runs for each inspection and class;
    where some hold more than `unit_rows` observations, they are cut into independent_units,
    which changes no result: later observations depend on earlier ones of their unit only.
    """
    given = observations.select(*COLUMNS)
    keyed = given.where(usable()).withColumn("fingerprint", fingerprint())
    w = Window.partitionBy("inspection_id", "observation_id")
    order = w.orderBy("seq")
    marked = keyed.withColumn("nth", F.row_number().over(order)).withColumn("same", F.min("fingerprint").over(w) == F.max("fingerprint").over(w))
    marked = marked.withColumn("nth", F.when(F.col("same"), F.col("nth")).otherwise(F.raise_error(F.lit("an observation id came again with other content"))))
    first = marked.where("nth = 1").drop("nth", "same")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(naming=naming), []
        for o in rows_of(pdf):
            decision, defect = state.ingest(o, radius)
            out.append((o["seq"], o["inspection_id"], o["class_id"], o["observation_id"], decision, defect))
        return pd.DataFrame(out, columns=["seq", "inspection_id", "class_id", "observation_id", "decision", "defect_id"])

    keys = ["inspection_id", "class_id"]
    if not first.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > unit_rows).isEmpty():
        first, keys = independent_units(first, radius), [*keys, "unit"]
    decided = cut(first.groupBy(*keys).applyInPandas(fold, "seq long, inspection_id long, class_id int, observation_id string, decision string, defect_id string"))
    replays = marked.where("nth > 1").select("seq", "inspection_id", "observation_id")
    again = replays.join(decided.select("inspection_id", "observation_id", "class_id", "defect_id"), ["inspection_id", "observation_id"]).withColumn("decision", F.lit("REPLAY"))
    decisions = decided.unionByName(again.select(*decided.columns)).unionByName(refused(given).select(*(F.col(c).cast(t).alias(c) for c, t in decided.dtypes)))
    members = first.join(decided.select("inspection_id", "observation_id", "defect_id"), ["inspection_id", "observation_id"])
    return decisions, defect_table(members)


def defect_table(members: DataFrame) -> DataFrame:
    """Aggregates of observations by defect_id: means, extent in time, count, canonical track (most frequent, ties to the smaller name)."""
    exact = lambda c: (F.sum(F.col(c).cast("decimal(24,9)")).cast("double") / F.count("*")).alias(c)
    base = members.groupBy("defect_id").agg(
        F.first("inspection_id").alias("inspection_id"), F.first("class_id").alias("class_id"), F.count("*").alias("observation_count"),
        exact("confidence"), exact("x_m"), exact("y_m"), exact("z_m"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    tracks = members.where("track_id is not null").groupBy("defect_id", "track_id").agg(F.count("*").alias("n"))
    canonical = tracks.groupBy("defect_id").agg(F.min_by("track_id", F.struct(-F.col("n"), F.col("track_id"))).alias("track_id"))
    return base.join(canonical, "defect_id", "left")

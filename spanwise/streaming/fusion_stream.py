"""Fusion over a stream, the same step as the batch fold, and stamp-synchronised inputs."""

from __future__ import annotations

import json
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanwise.operators.fusion import COLUMNS, Defect, Naming, State, fingerprint, refused, rows_of, usable

_OUT = "seq long, inspection_id long, class_id int, observation_id string, decision string, defect_id string"


class _Backed(dict):
    """A dictionary over a map state: values are read when asked for, changed ones are written by `flush`."""

    def __init__(self, state, load, dump) -> None:
        super().__init__()
        self.state, self.load, self.dump, self.changed, self.asked = state, load, dump, set(), set()

    def _fetch(self, key) -> None:
        if key not in self.asked:
            self.asked.add(key)
            if self.state.containsKey((self._name(key),)):
                super().__setitem__(key, self.load(self.state.getValue((self._name(key),))[0], key))

    @staticmethod
    def _name(key) -> str:
        return key if isinstance(key, str) else ",".join(map(str, key))

    def get(self, key, default=None):
        self._fetch(key)
        return super().get(key, default)

    def __getitem__(self, key):
        self._fetch(key)
        self.changed.add(key)
        return super().__getitem__(key)

    def __setitem__(self, key, value) -> None:
        self.asked.add(key)
        self.changed.add(key)
        super().__setitem__(key, value)

    def setdefault(self, key, default=None):
        if self.get(key) is None:
            self[key] = default
        self.changed.add(key)
        return super().__getitem__(key)

    def flush(self) -> None:
        for key in self.changed:
            self.state.updateValue((self._name(key),), (self.dump(super(_Backed, self).__getitem__(key)),))


class Fusion(StatefulProcessor):
    """The batch fold's step over state that stays in the store: observations, defects and grid cells are looked up one by one, never all at once."""

    def __init__(self, radius: float, naming: Naming) -> None:
        self.radius, self.naming = radius, naming

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen, self.defects, self.cells = (handle.getMapState(n, "name string", "body string") for n in ("seen", "defects", "cells"))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen = _Backed(self.seen, lambda text, _: tuple(json.loads(text)), json.dumps)
        defects = _Backed(self.defects, lambda text, k: Defect.of(k, json.loads(text)), lambda d: json.dumps(d.body(), allow_nan=False))
        cells = _Backed(self.cells, lambda text, _: set(json.loads(text)), lambda c: json.dumps(sorted(c)))
        held, out = State(defects, seen, self.naming, cells), []
        for o in rows_of(pd.concat(list(rows))):
            decision, defect = held.ingest(o, self.radius)
            out.append((o["seq"], o["inspection_id"], o["class_id"], o["observation_id"], decision, defect))
        for part in (seen, defects, cells):
            part.flush()
        yield pd.DataFrame(out, columns=["seq", "inspection_id", "class_id", "observation_id", "decision", "defect_id"])

    def close(self) -> None:
        pass


def fuse_stream(observations: DataFrame, radius: float = 0.25, naming: Naming = Naming()) -> DataFrame:
    """Decisions on a stream of observations, in order of arrival and of `seq` within a batch.

    State lives by inspection and class in map states and survives restarts through the
    query's checkpoint; a batch reads and writes what its observations touch. It
    needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    Nothing is late: stamps only move first and last seen. Equal replays are told REPLAY; others fail the query. Observations that can't be fused are REJECTED.
    """
    given = observations.select(*COLUMNS)
    keyed = given.where(usable()).withColumn("fingerprint", fingerprint())
    fused = keyed.groupBy("inspection_id", "class_id").transformWithStateInPandas(Fusion(radius, naming), _OUT, "append", "None")
    return fused.unionByName(refused(given).select(*(F.col(c).cast(t).alias(c) for c, t in fused.dtypes)))


def synchronise(requests: DataFrame, depth: DataFrame, info: DataFrame, key: str = "stamp", time: str = "ts", bound_seconds: int = 5) -> DataFrame:
    """Inner join of three streams (or tables) on equal stamps whose times lie at most `bound_seconds` apart.

    On streams the watermarks and the time bound together let old rows leave the
    state; partners that come later than that are lost. Columns of depth and
    info other than key and time keep their names, their times become depth_ts and info_ts.
    """

    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.withWatermark(name, f"{bound_seconds} seconds") if df.isStreaming else df

    out, at = marked(requests, time), F.col(time)
    for name, side in (("depth", depth), ("info", info)):
        own = side.withColumnRenamed(time, f"{name}_{time}").withColumnRenamed(key, f"{name}_{key}")
        gap = F.expr(f"interval {bound_seconds} seconds")
        near = (F.col(f"{name}_{time}") >= at - gap) & (F.col(f"{name}_{time}") <= at + gap)
        out = out.join(marked(own, f"{name}_{time}"), (F.col(key) == F.col(f"{name}_{key}")) & near).drop(f"{name}_{key}")
    return out


class StampBuffer:
    """The last `size` values by stamp; an evicted or unknown stamp is a mismatch, and may be asked for again later."""

    def __init__(self, size: int = 30) -> None:
        self.size, self.held = size, OrderedDict()

    def put(self, stamp: int, value) -> None:
        self.held[stamp] = value
        self.held.move_to_end(stamp)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def get(self, stamp: int):
        return self.held.get(stamp)


def lookup_buffered(messages: DataFrame, size: int = 30) -> DataFrame:
    """(camera, seq, stamp, status, value): requests answered from a buffer of the last `size` values of a camera.

    messages: (camera, seq, kind 'put' or 'get', stamp long, value double), in
    order of seq; status is SUCCESS or TIMESTAMP_MISMATCH. For tables and streams.
    """

    def serve(rows: pd.DataFrame, buffer: StampBuffer) -> list[tuple]:
        out = []
        for m in rows.sort_values("seq", kind="stable").itertuples():
            if m.kind == "put":
                buffer.put(m.stamp, m.value)
            else:
                v = buffer.get(m.stamp)
                out.append((m.camera, m.seq, m.stamp, "TIMESTAMP_MISMATCH" if v is None else "SUCCESS", v))
        return out

    names = ["camera", "seq", "stamp", "status", "value"]
    schema = "camera string, seq long, stamp long, status string, value double"
    if not messages.isStreaming:
        return messages.groupBy("camera").applyInPandas(lambda pdf: pd.DataFrame(serve(pdf, StampBuffer(size)), columns=names), schema)

    def step(key, batches, state):
        buffer = StampBuffer(size)
        for stamp, value in json.loads(state.get[0]) if state.exists else []:
            buffer.put(stamp, value)
        out = serve(pd.concat(list(batches)), buffer)
        state.update((json.dumps(list(buffer.held.items())),))
        yield pd.DataFrame(out, columns=names)

    return messages.groupBy("camera").applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def sampled(samples: DataFrame, key: str, stamp: str, period: int) -> DataFrame:
    """The first sample of each period, missed periods left out."""
    tick = F.expr(f"{stamp} div {period}L")
    return samples.groupBy(key, tick.alias("tick")).agg(F.min_by(F.struct(*[c for c in samples.columns if c != key]), F.col(stamp)).alias("s")).select(key, "s.*")


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """Running counts by decision; in a stream, use output mode 'complete'."""
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))

"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear
between knots; at every time the weights of all sources sum to 1, and each
schedule's integral is its source's target share. The integral, times the
whole budget, is the source's cumulative token demand. Each document copy
starts where its source's tokens so far, in a seeded random order that differs
from pass to pass, meet that demand: inverting the demand gives its position,
and the mixture is range-sorted by it.

Cumulative tokens come from two levels: sums of hashed buckets, accumulated
over the small table of buckets, then sums inside one bucket. No source,
however large, is ordered in one task.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from spanwise.functions.text import unify_source
from spanwise.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_LOADED: dict[str, object] = {}


def _encoding(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text under a public byte-level vocabulary; 0 for null and empty."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


Schedule = list[tuple[float, float]]


def schedule_weights(targets: np.ndarray, schedules: list[Schedule]) -> tuple[np.ndarray, np.ndarray]:
    """(times, weights[source, time]) of piecewise linear weights that sum to 1 at each time and whose integrals are the targets.

    `schedules`: each source's emphasis as (time, value > 0) knots, flat where
    empty. Rows and columns are scaled in turn until both sums hold
    (iterative proportional fitting); the weights are linear between the knots
    of all sources, so what holds at the knots holds between them.
    """
    times = np.unique([0.0, 1.0, *(min(max(t, 0.0), 1.0) for s in schedules for t, _ in s)])
    shape = np.array([np.interp(times, *zip(*sorted(s))) if s else np.ones(len(times)) for s in schedules]).reshape(len(schedules), len(times))
    if (shape <= 0).any():
        raise ValueError("emphasis must be over 0")
    step = np.diff(times)
    area = (np.append(step, 0) + np.append(0, step)) / 2
    weights = shape * targets[:, None]
    for _ in range(2_000):
        sums = weights.sum(0)
        weights = weights / np.where(sums > 0, sums, 1.0)
        got = weights @ area
        weights = weights * np.where(got > 0, targets / np.where(got > 0, got, 1.0), 0.0)[:, None]
        if np.abs(weights.sum(0) - 1).max() < 1e-12:
            break
    return times, weights


def _demand_inverse(demand: Column, times: Column, weights: Column, reached: Column) -> Column:
    """Time at which the integral of the weights meets `demand`; `reached`: the integral at each knot."""
    k = F.least(F.greatest(F.size(F.filter(reached, lambda x: x <= demand)), F.lit(1)), F.size(times) - 1)
    t0, t1, w0, w1 = (F.element_at(c, k + i) for c, i in ((times, 0), (times, 1), (weights, 0), (weights, 1)))
    rest = F.greatest(demand - F.element_at(reached, k), F.lit(0.0))
    # w0 u + (w1 - w0) u^2 / (2 length) = rest, by the form of the root that never cancels.
    root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) * rest / (t1 - t0), F.lit(0.0)))
    return F.least(t0 + F.coalesce(F.try_divide(2 * rest, root), F.lit(0.0)), t1)


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, slopes: dict[str, float] | None = None, schedules: dict[str, Schedule] | None = None, seed: int = 17, tokenizer: str = TOKENIZER, bucket_rows: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """(plan, shares) of a mixture.

    plan: (position, source, doc_id, pass, tokens), sorted by position: each
    row one use of a document. shares: one row for each target source with its
    target and actual share, tokens, uses, and the most often any document is used.

    Sources are unified in spelling. The budget is `total_tokens`, or else the
    largest at which every source with tokens and repeats can meet its share
    within max_repeats; with a larger one, short sources stop where they run out and the actual shares say so.
    Null and empty texts have no tokens and are not used; sources without a
    target, with a null or negative one, without tokens or repeats contribute nothing
    and leave the others' shares in proportion;
    repeated rows are documents of their own. `schedules` gives a source's
    emphasis over time as (time, value) knots, `slopes` from 1 - slope at the
    start to 1 + slope at the end; see schedule_weights for how they become weights.
    """
    sized = cut(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), unify_source(F.col("source")).alias("source"), token_count(F.col("text"), tokenizer).alias("tokens"))
        .where("tokens > 0 and source is not null")
    )
    wanted = targets.select(unify_source(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("target").alias("target"), F.max("repeats").alias("repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    # One row for each target source: the targets are a table of settings.
    supply = wanted.join(have, "source", "left").fillna(0, ["have", "docs"]).orderBy("source").collect()
    scale = sum(r["target"] for r in supply) or 1.0
    limits = [r["repeats"] * r["have"] / (r["target"] / scale) for r in supply if r["target"] > 0 and r["have"] > 0 and r["repeats"] > 0]
    budget = int(total_tokens if total_tokens is not None else min(limits, default=0))
    given = {s: [(0.0, 1 - x), (1.0, 1 + x)] for s, x in (slopes or {}).items()} | (schedules or {})
    live = [r for r in supply if r["target"] > 0 and r["have"] > 0 and r["repeats"] > 0]
    alive = sum(r["target"] for r in live) or 1.0
    portion = {r["source"]: r["target"] / alive for r in live}
    times, weights = schedule_weights(np.array(list(portion.values())), [given.get(s, []) for s in portion])
    reached = np.concatenate([np.zeros((len(live), 1)), np.cumsum((weights[:, 1:] + weights[:, :-1]) / 2 * np.diff(times), axis=1)], axis=1)
    curves = {s: (weights[i].tolist(), reached[i].tolist()) for i, s in enumerate(portion)}
    rows = []
    for r in supply:
        share, source = r["target"] / scale, r["source"]
        demand = share * budget if source in portion else 0.0
        passes = math.ceil(min(demand, float(r["repeats"] * r["have"])) / r["have"]) if r["have"] else 0
        rows.append((source, share, float(demand), int(passes), int(r["have"]), max(1, math.ceil(r["docs"] / bucket_rows)), portion.get(source, 0.0), *curves.get(source, ([], []))))
    spark = documents.sparkSession
    # One row for each target source.
    plan_of = F.broadcast(spark.createDataFrame(rows, "source string, target double, demand double, passes int, have long, buckets int, portion double, weights array<double>, reached array<double>"))

    drawn = sized.join(plan_of, "source").where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    drawn = drawn.withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "tokens", "pass")).withColumn("bucket", F.pmod("lot", F.col("buckets")).cast("int"))
    sums = drawn.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "pass", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("lot", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "pass", "bucket"])
    starts = placed.withColumn("start", F.col("offset") + F.col("own") + F.col("pass") * F.col("have")).where("start < demand")
    met = F.col("start") / F.col("demand") * F.col("portion")
    used = starts.select(_demand_inverse(met, F.array(*map(F.lit, times.tolist())), F.col("weights"), F.col("reached")).alias("position"), "source", "doc_id", "pass", "tokens")

    uses = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("most_repeats"))
    shares = plan_of.select("source", F.col("target").alias("target_share")).join(uses, "source", "left").fillna(0, ["tokens", "uses", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row for each target source
    shares = shares.select("source", "target_share", (F.col("tokens") / F.nullif(whole, F.lit(0))).alias("actual_share"), "tokens", "uses", "most_repeats")
    return used.orderBy("position", "source", "doc_id", "pass"), shares

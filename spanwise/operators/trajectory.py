"""Trajectories: windows, association by interpolation, rigid alignment, absolute and relative errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions import geometry as G
from spanwise.functions.scalars import finite, once
from spanwise.functions.text import plain
from spanwise.operators.stats import exact_quantiles
from spanwise.operators.validate import require_empty
from spanwise.session import cut

XYZ, QUAT = ("x_m", "y_m", "z_m"), ("qx", "qy", "qz", "qw")


def poses(samples: DataFrame) -> DataFrame:
    """(run, sample_id, t, x_m.., qx..) of usable samples: known run and stamp, finite pose, unit quaternion; one for each run and stamp (smallest id)."""
    q = G.unit([F.col(c) for c in QUAT])
    ok = finite(sum(F.col(c) for c in XYZ)) & finite(sum(F.col(c) * F.col(c) for c in QUAT))
    rows = samples.where("run_id is not null and timestamp_ns is not null and timestamp_ns <> 0").where(ok)
    rows = rows.select(plain(F.col("run_id")).alias("run"), F.col("timestamp_ns").alias("t"), F.struct("sample_id", *XYZ, *(c.alias(n) for c, n in zip(q, QUAT))).alias("p")).where("p.qw is not null")
    return rows.groupBy("run", "t").agg(F.min("p").alias("p")).select("run", "t", "p.*")


def window(samples: DataFrame, start: float, end: float) -> DataFrame:
    """Samples from start to end seconds, both included, after their run's first."""
    first = samples.groupBy("run").agg(F.min("t").alias("t0"))
    return samples.join(first, "run").where((F.col("t") - F.col("t0")).between(int(start * 1e9), int(end * 1e9))).drop("t0")


def associate(estimates: DataFrame, truth: DataFrame, max_span: int = 50_000_000, slot: int = 4_000_000_000) -> DataFrame:
    """Each estimate with the truth at its stamp: the exact sample, or one interpolated between its two neighbours.

    Neighbours more than `max_span` ns apart, or one only, give no row. Runs are
    cut into slots of `slot` ns, truths repeat into the slot beside them if
    within max_span, so a long run never is one task; frames run by window functions.
    """
    if slot < 2 * max_span:
        raise ValueError("slots of at least twice the span")
    at = lambda d: F.expr(f"(t + {d}L - pmod(t + {d}L, {slot}L)) div {slot}L")
    values = F.struct("t", *XYZ, *QUAT)
    e = estimates.select("run", at(0).alias("slot"), "t", F.lit(1).alias("kind"), "sample_id", values.alias("v"))
    g = truth.select("run", F.explode(F.array_distinct(F.array(at(-max_span), at(0), at(max_span)))).alias("slot"), "t", F.lit(0).alias("kind"), "sample_id", values.alias("v"))
    w = Window.partitionBy("run", "slot").orderBy("t", "kind")
    known = F.when(F.col("kind") == 0, F.col("v"))
    back = Window.partitionBy("run", "slot").orderBy(F.col("t").desc(), F.col("kind").asc())
    both = e.unionByName(g).withColumn("prev", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next", F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    met = both.where("kind = 1 and prev is not null and next is not null")
    exact = F.col("prev.t") == F.col("t")
    span = F.col("next.t") - F.col("prev.t")
    met = met.where(exact | (span <= max_span))
    met = met.withColumn("part", F.when(exact, F.lit(0.0)).otherwise((F.col("t") - F.col("prev.t")) / span))
    a, b = ([F.col(f"{s}.{c}") for c in XYZ] for s in ("prev", "next"))
    qa, qb = ([F.col(f"{s}.{c}") for c in QUAT] for s in ("prev", "next"))
    met = once(met, "w", F.struct(*(w.alias(n) for n, w in zip("ab", G.slerp_weights(qa, qb, F.col("part"))))))
    mixed = [F.col("w.a") * x + F.col("w.b") * y for x, y in zip(qa, qb)]
    pos = [F.when(exact, x).otherwise(y).alias(f"gt_{c}") for x, y, c in zip(a, G.lerp(a, b, F.col("part")), XYZ)]
    rot = [F.when(exact, x).otherwise(y).alias(f"gt_{c}") for x, y, c in zip(qa, G.unit(mixed), QUAT)]
    return met.select("run", "t", "sample_id", *(F.col(f"v.{c}").alias(c) for c in XYZ + QUAT), *pos, *rot, exact.alias("exact"))


def coverage(estimates: DataFrame, aligned: DataFrame) -> DataFrame:
    """(run, samples, matched, coverage, seconds) of each run."""
    n = estimates.groupBy("run").agg(F.count("*").alias("samples"))
    m = aligned.groupBy("run").agg(F.count("*").alias("matched"), ((F.max("t") - F.min("t")) / 1e9).alias("seconds"))
    return n.join(m, "run", "left").fillna(0, ["matched", "seconds"]).select("run", "samples", "matched", (F.col("matched") / F.col("samples")).alias("coverage"), "seconds")


def rigid_fit(aligned: DataFrame) -> DataFrame:
    """(run, n, r array<double> row by row, t array<double>): the rotation and shift that carry estimates onto truth best, scale 1.

    Sums are aggregated in the JVM, one row for each run; only the 3 x 3
    decomposition runs in NumPy. Fewer than three or collinear points give null r and t.
    """
    e, g = XYZ, tuple(f"gt_{c}" for c in XYZ)
    sums = [F.count("*").alias("n")] + [F.avg(c).alias(f"m_{c}") for c in e + g] + [F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(e) for j, b in enumerate(g)] + [F.covar_pop(a, b).alias(f"s{i}{j}") for i, a in enumerate(e) for j, b in enumerate(e)]
    table = aligned.groupBy("run").agg(*sums)

    def fit(batches):
        for pdf in batches:
            out = []
            for _, x in pdf.iterrows():
                h = np.array([[x[f"c{i}{j}"] for j in range(3)] for i in range(3)], float)
                spread = np.linalg.eigvalsh(np.array([[x[f"s{i}{j}"] for j in range(3)] for i in range(3)], float))
                if x["n"] < 3 or not np.isfinite(h).all() or spread[1] <= 1e-12 * max(spread[2], 1e-12):
                    out.append((x["run"], int(x["n"]), None, None))
                    continue
                u, _, vt = np.linalg.svd(h)
                d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
                r = vt.T @ d @ u.T
                t = np.array([x[f"m_{c}"] for c in g]) - r @ np.array([x[f"m_{c}"] for c in e])
                out.append((x["run"], int(x["n"]), r.ravel().tolist(), t.tolist()))
            yield pd.DataFrame(out, columns=["run", "n", "r", "t"])

    return table.mapInPandas(fit, "run string, n long, r array<double>, t array<double>")


def absolute_errors(aligned: DataFrame, fits: DataFrame) -> DataFrame:
    """(run, t, sample_id, error): metres between truth and the aligned estimate."""
    rows = aligned.join(fits.select("run", "r", F.col("t").alias("shift")).where("r is not null"), "run")
    v = [F.col(c) for c in XYZ]
    moved = [sum((F.col("r")[3 * i + j] * v[j] for j in range(3)), F.col("shift")[i]) for i in range(3)]
    return rows.select("run", "t", "sample_id", G.euclid(moved, [F.col(f"gt_{c}") for c in XYZ]).alias("error"))


def error_summary(errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """count, mean, median, rmse and linear 95th percentile; nulls for no errors. Keys are not null."""
    points = exact_quantiles(errors, keys, error, {"median": 0.5, "p95": 0.95})
    return points.select(*keys, "count", "mean", "median", F.col("rms").alias("rmse"), "p95")


def relative_errors(aligned: DataFrame, delta: int = 1_000_000_000, tolerance: int = 50_000_000) -> DataFrame:
    """(run, t, end_t, translation, rotation): errors of motion over `delta` ns.

    Each sample pairs with the later one nearest to t + delta within tolerance,
    ties to the earlier. Candidates meet in buckets twice the tolerance wide.
    """
    width = 2 * tolerance
    aligned = cut(aligned)
    # Times alone find their partners; poses join afterwards.
    bucket = lambda e: F.expr(f"({e} - pmod({e}, {width}L)) div {width}L")
    a = aligned.select("run", "t", bucket(f"(t + {delta}L)").alias("b0")).select("run", "t", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1)).alias("bucket"))
    b = aligned.select("run", F.col("t").alias("end_t"), bucket("t").alias("bucket"))
    gap = F.abs(F.col("end_t") - F.col("t") - delta)
    met = a.join(b, ["run", "bucket"]).where((gap <= tolerance) & (F.col("end_t") > F.col("t")))
    pairs = met.groupBy("run", "t").agg(F.min(F.struct(gap.alias("gap"), "end_t")).alias("m")).select("run", "t", "m.end_t")
    cols = [*XYZ, *QUAT, *(f"gt_{c}" for c in XYZ + QUAT)]
    own = lambda t, s: aligned.select("run", F.col("t").alias(t), F.struct(*cols).alias(s))
    best = pairs.join(own("t", "a"), ["run", "t"]).join(own("end_t", "b"), ["run", "end_t"])
    motion = {}
    for p in ("", "gt_"):
        q0, q1 = ([F.col(f"{s}.{p}{c}") for c in QUAT] for s in "ab")
        x0, x1 = ([F.col(f"{s}.{p}{c}") for c in XYZ] for s in "ab")
        motion[p] = G.rotate(G.conjugate(q0), [y - x for x, y in zip(x0, x1)]), G.multiply(G.conjugate(q0), q1)
    (de, qe), (dg, qg) = motion[""], motion["gt_"]
    rot = F.degrees(G.rotation_angle(G.multiply(G.conjugate(qg), qe)))
    off = G.euclid(de, dg)
    return best.select("run", "t", "end_t", off.alias("translation"), rot.alias("rotation"))


def link_issues(estimates: DataFrame, truths: DataFrame, links: DataFrame) -> DataFrame:
    """(estimated_id, truth_id, code) of links that break the rules: unknown_estimate, unknown_truth, class_differs, estimate_repeats, truth_repeats.

    Every estimate and truth has at most one link, both ends exist, and their classes agree.
    """
    e = estimates.select("estimated_id", F.col("class_name").alias("ec")).dropDuplicates(["estimated_id"])
    t = truths.select("truth_id", F.col("class_name").alias("tc")).dropDuplicates(["truth_id"])
    many = lambda key: links.groupBy(key).agg(F.count("*").alias(f"n_{key}"))
    rows = links.join(e, "estimated_id", "left").join(t, "truth_id", "left").join(many("estimated_id"), "estimated_id").join(many("truth_id"), "truth_id")
    codes = {
        "unknown_estimate": F.col("ec").isNull(), "unknown_truth": F.col("tc").isNull(), "class_differs": F.col("ec") != F.col("tc"),
        "estimate_repeats": F.col("n_estimated_id") > 1, "truth_repeats": F.col("n_truth_id") > 1,
    }
    return rows.select("estimated_id", "truth_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items())))).alias("code"))


def locate_errors(estimates: DataFrame, truths: DataFrame, links: DataFrame, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """(estimated_id, truth_id, dx, dy, dz, error): corresponding defects, truth carried into the map by R and t.

    estimates: (estimated_id, class_name, x, y, z); truths: (truth_id, ...);
    links: (estimated_id, truth_id). Links that `link_issues` names, and rotations that are none, are errors.
    """
    require_rotation(rotation)
    require_empty(link_issues(estimates, truths, links), "links")
    e = estimates.select("estimated_id", *(F.col(c).alias(f"e{c}") for c in "xyz"))
    t = truths.select("truth_id", *(c.alias(f"t{n}") for n, c in zip("xyz", G.apply_rigid(rotation, shift, [F.col(c) for c in "xyz"]))))
    rows = links.join(e, "estimated_id").join(t, "truth_id")
    d = [F.col(f"e{c}") - F.col(f"t{c}") for c in "xyz"]
    return rows.select("estimated_id", "truth_id", *(x.alias(f"d{c}") for x, c in zip(d, "xyz")), G.norm(d).alias("error"))


def localisation_summary(errors: DataFrame, estimates: DataFrame, truths: DataFrame, links: DataFrame) -> DataFrame:
    """One row: matched, mean, median, rmse and p95 of the distance, mean signed and absolute errors by axis, and unmatched on both sides; nulls without a match."""
    one = error_summary(errors.withColumn("g", F.lit(1)), ["g"]).drop("g")
    axes = errors.agg(*(F.avg(f"d{c}").alias(f"mean_d{c}") for c in "xyz"), *(F.avg(F.abs(f"d{c}")).alias(f"mean_abs_d{c}") for c in "xyz"), F.count("*").alias("matched"))
    missing = unlinked(estimates, links, "estimated_id").agg(F.count("*").alias("unmatched_estimates")).crossJoin(unlinked(truths, links, "truth_id").agg(F.count("*").alias("unmatched_truths")))  # one row each
    return axes.join(F.broadcast(one.drop("count")), F.lit(True), "left").crossJoin(missing)


def unlinked(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows of one side that no link names."""
    return rows.join(links.select(key).distinct(), key, "left_anti")


def require_rotation(matrix: list[list[float]], tolerance: float = 1e-9) -> np.ndarray:
    """The matrix if it is a proper rotation, else ValueError."""
    r = np.array(matrix, float)
    if r.shape != (3, 3) or not np.isfinite(r).all() or np.abs(r @ r.T - np.eye(3)).max() > tolerance or abs(np.linalg.det(r) - 1) > tolerance:
        raise ValueError("no proper rotation")
    return r


def require_rigid(matrix: list[list[float]], tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift) of a 4 x 4 rigid motion, else ValueError."""
    m = np.array(matrix, float)
    if m.shape != (4, 4) or not np.isfinite(m).all() or np.abs(m[3] - [0, 0, 0, 1]).max() > tolerance:
        raise ValueError("no rigid motion")
    return require_rotation(m[:3, :3].tolist(), tolerance), m[:3, 3]


def metric_rows(coverage_rows: DataFrame, absolute: DataFrame, relative: DataFrame) -> DataFrame:
    """(run, metric, value): the named measures of each run, one to a row; runs without a measure have null.

    coverage_rows: (run, matched, coverage, seconds); absolute: (run, rmse); relative: (run, rmse_translation, rmse_rotation).
    """
    wide = coverage_rows.join(absolute.select("run", "rmse"), "run", "left").join(relative.select("run", "rmse_translation", "rmse_rotation"), "run", "left")
    names = {
        "ate_translation_rmse_m": "rmse", "rpe_translation_rmse_m_1s": "rmse_translation", "rpe_rotation_rmse_deg_1s": "rmse_rotation",
        "aligned_sample_count": "matched", "timestamp_alignment_coverage": "coverage", "evaluated_duration_s": "seconds",
    }
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()))
    return wide.select("run", F.explode(cells).alias("x")).select("run", "x.*")


def plane_check(depths: DataFrame, expected: float, tolerance: float) -> DataFrame:
    """Depth samples (key, depth_m) that aren't finite or lie off the expected plane by more than the tolerance."""
    return depths.where(~finite(F.col("depth_m")) | (F.abs(F.col("depth_m") - expected) > tolerance))


def common_stamps(*streams: DataFrame) -> DataFrame:
    """Stamps that occur in every stream (column stamp), each once."""
    out = streams[0].select("stamp").distinct()
    for s in streams[1:]:
        out = out.join(s.select("stamp").distinct(), "stamp", "left_semi")
    return out

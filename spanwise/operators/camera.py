"""Projection of image places into the camera's frame: depth decoding, robust depth of a region, camera checks, status codes.

Everything but the decoding of bytes is column expressions over one row for
each request with its depth image and camera model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.scalars import back_project, finite, once, or_nan

FRAME = "camera_optical_frame"

#: Outcome codes, in order.
STATUSES = (
    "SUCCESS", "NO_VALID_DEPTH", "INSUFFICIENT_DEPTH", "INVALID_CAMERA_MODEL", "OUT_OF_BOUNDS",
    "TIMESTAMP_MISMATCH", "FRAME_MISMATCH", "INVALID_DEPTH_IMAGE", "INVALID_REQUEST", "NUMERICAL_ERROR",
)


def decode_depth(data: Column, width: Column, height: Column, step: Column, big_endian: Column, encoding: Column) -> Column:
    """Row-major 32-bit floats of an image with padded rows; null unless size, stride and payload agree."""

    @F.pandas_udf("array<float>")
    def decode(data: pd.Series, width: pd.Series, height: pd.Series, step: pd.Series, big: pd.Series, encoding: pd.Series) -> pd.Series:
        out = []
        for d, w, h, s, b, e in zip(data, width, height, step, big, encoding):
            sound = d is not None and e == "32FC1" and w > 0 and h > 0 and s >= 4 * w and len(d) == s * h and b in (0, 1)
            rows = np.frombuffer(d, np.uint8).reshape(h, s)[:, : 4 * w].tobytes() if sound else b""
            out.append(np.frombuffer(rows, ">f4" if b else "<f4").astype(np.float32) if sound else None)
        return pd.Series(out)

    return decode(data, width, height, step, big_endian, encoding)


def region_depth(df: DataFrame, depth: str, width: str, box: list[Column], fraction: float = 0.5) -> DataFrame:
    """Adds __median and __share: the median and the valid share of the positive finite depths in the middle of a region.

    depth: row-major; box: left, top, right, bottom, half open, inside the image, or null.
    The middle takes `fraction` of each side, rounded up; ties of centring favour top and left. The median is null without a valid depth.
    """
    left, top, right, bottom = box
    w, h = F.ceil((right - left) * fraction).cast("int"), F.ceil((bottom - top) * fraction).cast("int")
    df = once(df, "__size", F.struct(left.alias("left"), top.alias("top"), (right - left).alias("across"), (bottom - top).alias("down"), w.alias("w"), h.alias("h")))
    c = lambda n: F.col(f"__size.{n}")
    x0 = c("left") + F.floor((c("across") - c("w")) / 2).cast("int")
    y0 = c("top") + F.floor((c("down") - c("h")) / 2).cast("int")
    rows = F.transform(F.sequence(y0, y0 + c("h") - 1), lambda y: F.slice(depth, y * F.col(width).cast("int") + x0 + 1, c("w")))
    df = once(df, "__valid", F.array_sort(F.filter(F.flatten(rows), lambda z: finite(z) & (z > 0))))
    n = F.size("__valid")
    at = lambda i: F.try_element_at("__valid", i.cast("int")).cast("double")
    high, low = at(F.floor(n / 2) + 1), at(F.floor(n / 2))
    median = F.when(n % 2 == 1, high).when(n > 0, low + (high - low) / 2)
    out = once(df, "__depth", F.struct(median.alias("median"), (n / (c("w") * c("h"))).alias("share")))
    return out.select("*", F.col("__depth.median").alias("__median"), F.col("__depth.share").alias("__share")).drop("__size", "__valid", "__depth")


def camera_ok() -> Column:
    """A pinhole model that fits its depth image: sizes agree, K is one, no distortion, binning or crop. Columns: width, height, info_width, info_height, k (9), d, binning_x, binning_y."""
    k = lambda i: F.get("k", F.lit(i))
    shape = (F.size("k") == 9) & F.forall("k", finite) & (k(0) > 0) & (k(4) > 0) & (k(1) == 0) & (k(3) == 0) & (k(6) == 0) & (k(7) == 0) & (k(8) == 1)
    sizes = (F.col("info_width") > 0) & (F.col("info_height") > 0) & (F.col("info_width") == F.col("width")) & (F.col("info_height") == F.col("height"))
    plain = F.forall("d", lambda x: F.coalesce(x == 0, F.lit(False))) & F.col("binning_x").isin(0, 1) & F.col("binning_y").isin(0, 1)
    return F.coalesce(sizes & shape & plain, F.lit(False))


def project(requests: DataFrame, fraction: float = 0.5, least_valid: float = 0.5) -> DataFrame:
    """Adds status, status_name, x, y, z, sample_u, sample_v: the first check that fails decides; every failure has NaN places.

    Columns: stamp, depth_stamp, info_stamp, frame, depth_frame, info_frame, mode (0 pixel, 1 region), u, v, left, top, right, bottom,
    depth (row-major array, null if undecodable), and those of camera_ok. A region stands for its geometric centre.
    """
    if not 0 < fraction <= 1 or not 0 <= least_valid <= 1:
        raise ValueError("fractions from 0 to 1")
    c = F.col
    sure = lambda x: F.coalesce(x, F.lit(False))
    region = sure(c("mode") == 1)
    ordered = sure((c("left") < c("right")) & (c("top") < c("bottom")))
    inside = sure((c("left") >= 0) & (c("right") <= c("width")) & (c("top") >= 0) & (c("bottom") <= c("height")))
    pixel_in = sure((c("u") >= 0) & (c("u") < c("width")) & (c("v") >= 0) & (c("v") < c("height")))
    decoded = sure((c("width") > 0) & (c("height") > 0) & (F.size("depth") == c("width") * c("height")))
    usable = region & ordered & inside & decoded
    box = [F.when(usable, c(n).cast("int")) for n in ("left", "top", "right", "bottom")]
    at = F.get("depth", F.when(decoded & pixel_in, (c("v") * c("width") + c("u")).cast("int"))).cast("double")
    rows = once(region_depth(requests, "depth", "width", box, fraction), "__p", at)
    pixel_ok = sure(finite(c("__p")) & (c("__p") > 0))
    k = lambda i: F.get("k", F.lit(i))
    name = (
        F.when(~sure((c("stamp") == c("depth_stamp")) & (c("stamp") == c("info_stamp"))), "TIMESTAMP_MISMATCH")
        .when(~sure((c("frame") == FRAME) & (c("depth_frame") == FRAME) & (c("info_frame") == FRAME)), "FRAME_MISMATCH")
        .when(~camera_ok(), "INVALID_CAMERA_MODEL").when(~decoded, "INVALID_DEPTH_IMAGE")
        .when(~sure(c("mode").isin(0, 1)), "INVALID_REQUEST")
        .when(~region & ~pixel_in, "OUT_OF_BOUNDS").when(~region & ~pixel_ok, "NO_VALID_DEPTH")
        .when(region & ~ordered, "INVALID_REQUEST").when(region & ~inside, "OUT_OF_BOUNDS")
        .when(region & c("__median").isNull(), "NO_VALID_DEPTH").when(region & (c("__share") < least_valid), "INSUFFICIENT_DEPTH")
    )
    rows = once(rows, "__name", F.coalesce(name, F.lit("SUCCESS")))
    z = F.when(region, c("__median")).otherwise(c("__p"))
    u = F.when(region, (c("left") + c("right") - 1) / 2).otherwise(c("u").cast("double"))
    v = F.when(region, (c("top") + c("bottom") - 1) / 2).otherwise(c("v").cast("double"))
    place = back_project(u, v, z, k(0), k(4), k(2), k(5))
    good = c("__name") == "SUCCESS"
    rows = once(rows, "__at", F.when(good, F.struct(*(p.alias(n) for n, p in zip(("x", "y", "z", "u", "v"), (*place, u, v))))))
    sound = sure(finite(c("__at.x")) & finite(c("__at.y")))
    rows = rows.withColumn("status_name", F.when(good & ~sound, "NUMERICAL_ERROR").otherwise(c("__name")))
    status = F.array_position(F.array(*map(F.lit, STATUSES)), c("status_name")) - 1
    rows = rows.withColumn("status", status.cast("int"))
    cells = [or_nan(c("status"), c(f"__at.{n}")).alias(to) for n, to in zip(("x", "y", "z", "u", "v"), ("x", "y", "z", "sample_u", "sample_v"))]
    return rows.select("*", *cells).drop("__median", "__share", "__p", "__name", "__at")


def detection_requests(detections: DataFrame) -> DataFrame:
    """Region requests of detections (stamp, x1, y1, x2, y2, width, height): the whole pixels that a box touches, clamped to the picture."""
    from spanwise.functions.scalars import pixel_roi

    box = pixel_roi([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"))
    return detections.select("*", F.lit(1).alias("mode"), *(b.cast("int").alias(n) for n, b in zip(("left", "top", "right", "bottom"), box)))


def outcomes(projected: DataFrame) -> DataFrame:
    """(status_name, n) of every status, zeros kept; only SUCCESS with finite places goes on."""
    from spanwise.operators.stats import category_counts

    return category_counts(projected.select(F.array("status_name").alias("s")), "s", list(STATUSES)).withColumnRenamed("category", "status_name")

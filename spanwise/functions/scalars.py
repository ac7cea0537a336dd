"""Scalar column builders: names, paths, hashes, bins, boxes, exact decimals, time text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the URL namespace of version-5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def pairing_key(filename: Column) -> Column:
    """Trimmed stem of a file name, trimmed again, case folded (ß as ss)."""
    stem = F.regexp_replace(F.trim(filename), r"(?<=.)\.[^.]*$", "")
    return F.replace(F.lower(F.trim(stem)), F.lit("ß"), F.lit("ss"))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def numeric_stem(filename: Column) -> Column:
    """The stem as a number if it is ASCII digits only, else null; beyond 38 digits null."""
    stem = F.regexp_replace(F.trim(filename), r"\.[^.]*$", "")
    return F.when(stem.rlike(r"^[0-9]+\z"), stem.try_cast("decimal(38,0)"))


def safe_relative_path(path: Column) -> Column:
    """True for a non-empty relative path without parent steps, drive letters or back slashes."""
    bad = path.rlike(r"^/") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:") | F.contains(path, F.lit("\\"))
    return F.coalesce((F.trim(path) != "") & ~bad, F.lit(False))


def label_path(image_path: Column) -> Column:
    """The label file beside an image: the last folder 'images' becomes 'labels', the suffix '.txt'."""
    return F.regexp_replace(F.regexp_replace(image_path, r"^(.*)/images/([^/]*)$", "$1/labels/$2"), r"\.[^./]*$", ".txt")


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "valid", 1).when(split == "test", 2).otherwise(3)


def split_pair(a: Column, b: Column) -> Column:
    """Both splits in the order train, valid, test."""
    swap = split_rank(b) < split_rank(a)
    return F.concat(F.when(swap, b).otherwise(a), F.lit("/"), F.when(swap, a).otherwise(b))


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def distance_severity(distance: Column) -> Column:
    """Severity of a Hamming distance."""
    return F.when(distance == 0, "identical_perceptual_hash").when(distance <= 4, "very_strong_near_duplicate").when(distance <= 8, "probable_near_duplicate").otherwise("weaker_candidate")


def _bits(grid: Column, pairs: list[tuple[int, int]]) -> Column:
    return F.concat(*((F.get(grid, F.lit(b)) > F.get(grid, F.lit(a))).cast("int").cast("string") for a, b in pairs))


def difference_bits(grid: Column, width: int, height: int, down: bool = False) -> Column:
    """Bits of a row-major grid, 1 where a value exceeds its left neighbour (or, with `down`, the one above)."""
    if down:
        return _bits(grid, [(y * width + x, (y + 1) * width + x) for y in range(height - 1) for x in range(width)])
    return _bits(grid, [(y * width + x, y * width + x + 1) for y in range(height) for x in range(width - 1)])


def difference_hash(wide: Column, tall: Column) -> Column:
    """128 bits as hex: a 9 x 8 grid compared to the right, then an 8 x 9 grid compared downwards."""
    both = F.concat(difference_bits(wide, 9, 8), difference_bits(tall, 8, 9, True))
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(both, i * 32 + 1, 32), 2, 16), 8, "0") for i in range(4))))


def low_information(ones: Column, deviation: Column | None = None) -> Column:
    flat = (ones <= 8) | (ones >= 120)
    return flat if deviation is None else flat | (deviation < 5)


def content_group_id(members: Column) -> Column:
    """A group's id from its sorted members."""
    return F.concat(F.lit("LG_"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 16))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID text of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def binned(value: Column, edges: list[float], names: list[str]) -> Column:
    """Half-open bins: names[i] up to but without edges[i], the last name beyond; null stays null."""
    out = reduce(lambda acc, x: acc.when(value < x[0], x[1]), zip(edges[1:], names[1:]), F.when(value < edges[0], names[0]))
    return F.when(value.isNotNull(), out.otherwise(names[-1]))


def size_category(area: Column) -> Column:
    return binned(area, [0.001, 0.01, 0.1], ["tiny", "small", "medium", "large"])


def annotation_bin(count: Column) -> Column:
    return F.when(count < 0, None).when(count == 0, "0").when(count == 1, "1").when(count <= 5, "2-5").when(count <= 10, "6-10").when(count <= 20, "11-20").when(count > 20, ">20")


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(width < height, "portrait").when(width == height, "square")


def iou(a: list[Column], b: list[Column], epsilon: float = 0.0) -> Column:
    """Overlap of two boxes x1, y1, x2, y2; 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = w * h
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter + F.lit(epsilon)), F.lit(0.0))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def boundary_excess(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """How far a normalised box reaches beyond the picture."""
    x1, y1, x2, y2 = corners(cx, cy, w, h)
    return F.greatest(-x1, -y1, x2 - 1, y2 - 1, F.lit(0.0))


def pixel_roi(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Whole pixels that a box touches, half open, clamped to the picture."""
    return [F.greatest(F.floor(box[0]), F.lit(0)), F.greatest(F.floor(box[1]), F.lit(0)), F.least(F.ceil(box[2]), width), F.least(F.ceil(box[3]), height)]


def back_project(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Pinhole camera: metres of a pixel at depth z."""
    return [F.try_divide(u - cx, fx) * z, F.try_divide(v - cy, fy) * z, z]


def canonical_decimal(text: Column) -> Column:
    """Exact decimal text without trailing zeros; null for anything that isn't a plain decimal of 38 digits, 18 after the point."""
    value = F.when(F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.trim(text)).try_cast("decimal(38,18)")
    bare = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(bare == "-0", "0").otherwise(bare)


def utc_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def identifier_ok(c: Column) -> Column:
    """Not null, trimmed, 1 to 256 characters, without control characters."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 256) & (F.trim(c) == c) & ~c.rlike(r"\p{Cc}"), F.lit(False))


def digest_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def exif_size(width: Column, height: Column, orientation_tag: Column) -> list[Column]:
    """Width and height as shown: tags 6 and 8 swap them."""
    turned = F.coalesce(orientation_tag.isin(6, 8), F.lit(False))
    return [F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)]


def annotation_rows(text: Column) -> Column:
    """The rows of a label text as exact decimal tokens without trailing zeros; null for null text, blank lines left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), canonical_decimal))


def integral_text(number: Column) -> Column:
    """Text of a number, whole ones without a fraction (2.0 as 2); null unless finite."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(finite(number), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")))


def stamps_in(text: Column) -> Column:
    """Nanoseconds of each 'sec: S nanosec: N' of a message text; a missing nanosec counts 0."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![a-z])sec:\s*(\d+)(?:\s+nanosec:\s*(\d+))?"), F.lit(0))
    number = lambda x, p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("bigint"), F.lit(0))
    return F.transform(found, lambda x: number(x, r"(?<![a-z])sec:\s*(\d+)") * 1_000_000_000 + number(x, r"nanosec:\s*(\d+)"))


def batch_ranges(total: Column, size: int) -> Column:
    """[start, stop) of the batches of `total` rows; empty for none."""
    starts = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), total.cast("bigint") - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, total.cast("bigint")).alias("stop")))


def shown_if(status: Column, value: Column, accepted: str = "ACCEPTED") -> Column:
    """The value where its status is accepted, else null."""
    return F.when(status == accepted, value)


def or_nan(status: Column, value: Column) -> Column:
    """The value of a success (status 0), NaN of anything else."""
    return F.when(status == 0, value.cast("double")).otherwise(F.lit(float("nan")))


def minimum_jerk(part: Column) -> Column:
    """Smooth progress from 0 to 1 with still ends: 10 t^3 - 15 t^4 + 6 t^5, clamped."""
    t = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    return t * t * t * (10 + t * (6 * t - 15))


def magnitude_bucket(value: Column, per_factor: int = 4_096) -> Column:
    """A whole number that never falls as the value grows, about `per_factor` for each factor e of size, so values near 0 get buckets of their own; NaN last."""
    top = 800 * per_factor
    size = lambda x: F.floor(F.ln(x) * per_factor).cast("bigint") + top
    big = F.lit(2 * top).cast("bigint")
    out = F.when(F.isnan(value), big + 1).when(value == float("inf"), big).when(value == float("-inf"), -big)
    return out.when(value > 0, size(value)).when(value < 0, -size(-value)).when(value == 0, F.lit(0).cast("bigint"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once: explode(array(x)) keeps the optimizer from copying x into every place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))

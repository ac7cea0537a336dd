"""Descriptive statistics of annotated image sets: distributions, summaries, histograms, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions import scalars as X
from spanwise.functions.scalars import magnitude_bucket

SUMMARY = ("count", "mean", "min", "p01", "p05", "p25", "median", "p75", "p95", "p99", "max")


def box_metrics(boxes: DataFrame, width: Column, height: Column, edge: float = 0.01) -> DataFrame:
    """Adds areas, pixel sizes, aspect, size category, border and rounding flags to normalised boxes (x, y, width, height).

    `width`, `height`: the picture in pixels. A box within `edge` of a side is
    near the border; an excess up to 1e-6 is rounding; aspects under 0.1 or
    over 10 are extreme. Null sizes give null metrics.
    """
    w, h = F.col("width"), F.col("height")
    x1, y1, x2, y2 = X.corners(F.col("x"), F.col("y"), w, h)
    excess = X.boundary_excess(F.col("x"), F.col("y"), w, h)
    aspect = F.try_divide(w * width, h * height)
    return boxes.select(
        "*", (w * h).alias("normalized_area"), (w * width).alias("pixel_width"), (h * height).alias("pixel_height"), (w * width * h * height).alias("pixel_area"),
        aspect.alias("aspect_ratio"), X.size_category(w * h).alias("size_category"), (F.least(x1, y1, 1 - x2, 1 - y2) <= edge).alias("near_border"),
        excess.alias("boundary_excess"), ((excess > 0) & (excess <= 1e-6)).alias("rounding_warning"), ((aspect < 0.1) | (aspect > 10)).alias("extreme_aspect_ratio"),
    )


def class_distribution(boxes: DataFrame, split: str = "split", cls: str = "class_id", image: str = "image") -> DataFrame:
    """Per split ('all' for the whole) and class: instances, share in percent, images, and ratios to the largest and smallest class."""
    sets = boxes.select(F.explode(F.array(F.col(split), F.lit("all"))).alias("split"), F.col(cls).alias("class_id"), F.col(image).alias("image"))
    counts = sets.groupBy("split", "class_id").agg(F.count("*").alias("instances"), F.count_distinct("image").alias("images"))
    w = Window.partitionBy("split")
    n = F.col("instances")
    return counts.select(
        "split", "class_id", "instances", "images", (100.0 * n / F.sum(n).over(w)).alias("share_percent"),
        (F.max(n).over(w) / n).alias("ratio_to_largest"), (n / F.min(n).over(w)).alias("ratio_to_smallest"),
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], per_factor: int = 4_096) -> DataFrame:
    """keys, count, mean, rms, min, max and a column for each point: linear percentiles, exact, with no group sorted in one task.

    Equal values are counted first; their buckets (see magnitude_bucket) are
    counted and added up, which tells the bucket that holds each wanted rank; only those
    buckets are looked into. Rows with a null key and null values are left out; a
    group of nulls only has count 0 and nulls; no rows give no row.
    """
    v = F.col(value).cast("double")
    # This shuffle is read twice, by the sums of buckets and by the look into some of them.
    # Both readers ask for the same rows (no filter on one side only), or it couldn't be reused.
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    bucket = F.coalesce(magnitude_bucket(F.col("__v"), per_factor), F.lit(-(1 << 62)))
    counts = df.groupBy(*keys, v.alias("__v")).agg(F.count("*").alias("__c")).withColumn("__bucket", bucket)
    some = F.col("__v").isNotNull()
    part = counts.groupBy(*keys, "__bucket").agg(F.sum(F.when(some, F.col("__c")).otherwise(0)).alias("__c"), F.sum(F.col("__v") * F.col("__c")).alias("__s"), F.sum(F.col("__v") * F.col("__v") * F.col("__c")).alias("__ss"), F.min("__v").alias("__low"), F.max("__v").alias("__top"))
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first())
    n = F.sum("__c").over(whole)
    ranked = part.select(
        *keys, "__bucket", "__c", n.alias("count"), F.try_divide(F.sum("__s").over(whole), n).alias("mean"), F.sqrt(F.try_divide(F.sum("__ss").over(whole), n)).alias("rms"),
        F.min("__low").over(whole).alias("min"), F.max("__top").over(whole).alias("max"), F.coalesce(F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.row_number().over(order).alias("__k"),
    )
    place = lambda p: F.greatest(F.col("count") - 1, F.lit(0)) * p
    # Places of the wanted ranks: twice for each point, the last where no value is.
    ends = [F.struct(F.lit(i).alias("i"), F.lit(h).alias("high"), (F.ceil if h else F.floor)(place(p)).cast("bigint").alias("rank")) for i, p in enumerate(points.values()) for h in (False, True)]
    here = F.filter(F.array(*ends), lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__c")))
    # The first bucket of a group goes on in any case, with what describes the group.
    held = ranked.withColumn("__ends", here).where((F.size("__ends") > 0) | (F.col("__k") == 1))
    inside = counts.select(*keys, "__bucket", F.struct(F.col("__v").alias("v"), F.when(some, F.col("__c")).otherwise(0).alias("vc")).alias("__x"))
    upto = F.sum("__x.vc").over(Window.partitionBy(*keys, "__bucket").orderBy("__x.v").rowsBetween(Window.unboundedPreceding, 0))
    met = held.join(inside, [*keys, "__bucket"], "left").withColumn("__upto", F.col("__before") + upto)
    found = F.filter("__ends", lambda r: (r["rank"] < F.col("__upto")) & (r["rank"] >= F.col("__upto") - F.col("__x.vc")))
    one = met.select(*keys, "count", "mean", "rms", "min", "max", F.explode_outer(F.transform(found, lambda r: F.struct(r["i"].alias("i"), r["high"].alias("high"), F.col("__x.v").alias("v")))).alias("__e"))
    pick = lambda i, h: F.max(F.when((F.col("__e.i") == i) & (F.col("__e.high") == h), F.col("__e.v")))
    out = one.groupBy(*keys, "count", "mean", "rms", "min", "max").agg(*(pick(i, h).alias(f"__{'h' if h else 'l'}{i}") for i in range(len(points)) for h in (False, True)))

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"__l{i}"), F.col(f"__h{i}")
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return out.select(*keys, "count", "mean", "rms", "min", "max", *(between(i, p).alias(name) for i, (name, p) in enumerate(points.items())))


def eleven_numbers(df: DataFrame, groupings: list[list[str]], metrics: list[str]) -> DataFrame:
    """Count, mean, extremes and linear percentiles of each metric at each grain, one row for each grain, group and metric.

    Columns: grain, the grouping columns as text (null where summed over),
    metric and SUMMARY. Null values are left out; a group without values has
    count 0 and nulls. The table is read once for all grains.
    """
    names = sorted({c for g in groupings for c in g})
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    grains = F.array(*(F.struct(F.lit("+".join(g) or "all").alias("grain"), *((text(c) if c in g else F.lit("\x01")).alias(c) for c in names)) for g in groupings))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    keys = ["grain", *names, "metric"]
    long = df.select(F.explode(grains).alias("g"), cells.alias("m")).select("g.*", F.explode("m").alias("m")).select("grain", *names, "m.*")
    out = exact_quantiles(long, keys, "value", {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})
    shown = [F.when(~F.col(c).isin("\x00", "\x01"), F.col(c)).alias(c) for c in names]
    return out.select("grain", *shown, "metric", "count", "mean", "min", "max", "p01", "p05", "p25", "median", "p75", "p95", "p99")


def split_comparison(images: DataFrame, boxes: DataFrame, classes: list[int]) -> DataFrame:
    """Per split: images, annotations, mean annotations an image, median box area, share of images with several classes, and each class's share of the annotations in percent.

    images: (split, image); boxes: (split, image, class_id, area). Images without boxes count; shares without a base are 0.
    """
    own = boxes.groupBy("split", "image").agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("kinds"))
    per = images.select("split", "image").distinct().join(own, ["split", "image"], "left").fillna(0, ["n", "kinds"])
    base = per.groupBy("split").agg(F.count("*").alias("images"), F.sum("n").alias("annotations"), F.avg("n").alias("mean_annotations"), (100 * F.avg((F.col("kinds") > 1).cast("int"))).alias("multi_class_percent"))
    shares = boxes.groupBy("split").agg(*((100.0 * F.count_if(F.col("class_id") == c) / F.count("*")).alias(f"class_{c}_percent") for c in classes))
    area = exact_quantiles(boxes.where("split is not null"), ["split"], "area", {"median_area": 0.5}).select("split", "median_area")
    return base.join(shares, "split", "left").join(area, "split", "left").fillna(0.0, [f"class_{c}_percent" for c in classes])


def overview(images: DataFrame, split: str, paired: Column, annotations: Column, kinds: Column) -> DataFrame:
    """(view, split, ...) of two views, 'raw' (all images) and 'baseline' (pairs only), each for every split and 'all'.

    `annotations`: how many an image has, null or negative if unknown; `kinds`: how many classes. images, exact_pairs, unlabelled, annotations,
    one_class_images and multi_class_images of the pairs, and mean and median annotations of a pair (null without pairs of known number).
    """
    known = F.when(annotations >= 0, annotations.cast("double"))
    rows = images.select(F.coalesce(split, F.lit("unknown")).alias("own"), F.coalesce(paired, F.lit(False)).alias("paired"), known.alias("n"), F.coalesce(kinds, F.lit(0)).alias("kinds"))
    views = F.array_compact(F.array(F.lit("raw"), F.when(F.col("paired"), F.lit("baseline"))))
    long = rows.select(F.explode(views).alias("view"), F.array("own", F.lit("all")).alias("s"), "paired", "n", "kinds").select("view", F.explode("s").alias("split"), "paired", F.when(F.col("paired"), F.col("n")).alias("n"), "kinds")
    base = long.groupBy("view", "split").agg(
        F.count("*").alias("images"), F.count_if("paired").alias("exact_pairs"), F.count_if(~F.col("paired")).alias("unlabelled"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("annotations"),
        F.count_if(F.col("paired") & (F.col("kinds") == 1)).alias("one_class_images"), F.count_if(F.col("paired") & (F.col("kinds") > 1)).alias("multi_class_images"), F.avg("n").alias("mean_annotations"),
    )
    middle = exact_quantiles(long, ["view", "split"], "n", {"median_annotations": 0.5}).select("view", "split", "median_annotations")
    return base.join(middle, ["view", "split"], "left")


def category_counts(rows: DataFrame, tags: str, categories: list[str]) -> DataFrame:
    """(category, n) for every category, zeros kept; `tags`: an array of any number of them, a tag that repeats in a row counts once."""
    got = rows.select(F.explode(F.array_distinct(tags)).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return all_.join(got, "category", "left").fillna(0, ["n"])


def extreme_examples(rows: DataFrame, value: str, key: str, top: int = 20, flags: dict[str, Column] | None = None) -> DataFrame:
    """(example, key, value): the `top` smallest and largest rows, and up to `top` of each flag, as one bag with a tag; ties by key."""
    out = rows.orderBy(F.col(value), key).limit(top).select(F.lit("smallest").alias("example"), key, value)
    out = out.unionByName(rows.orderBy(F.col(value).desc(), key).limit(top).select(F.lit("largest").alias("example"), key, value))
    for name, flag in (flags or {}).items():
        out = out.unionByName(rows.where(flag).orderBy(key).limit(top).select(F.lit(name).alias("example"), key, value))
    return out


def count_issues(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, n, expected) of names whose number differs from what is expected, or that are missing or unknown; counts: (name, n)."""
    want = counts.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return counts.select("name", F.col("n").cast("bigint").alias("n")).join(want, "name", "full_outer").where(~F.col("n").eqNullSafe(F.col("expected")))


def dense_histogram(df: DataFrame, by: list[str], value: Column, bins: list[str]) -> DataFrame:
    """Counts of every bin in every group, zeros kept, with the share of the group in percent (null for an empty group)."""
    counted = df.select(*by, value.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = counted.select(*by).distinct().select("*", F.explode(F.array(*map(F.lit, bins))).alias("bin"))
    full = grid.join(counted, [*by, "bin"], "left").fillna(0, ["n"])
    return full.withColumn("share_percent", F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def resolutions(images: DataFrame, rare: int = 10) -> DataFrame:
    """Per width and height: images, and flags for tiny, huge, odd-shaped and rare sizes."""
    n = images.where("width is not null and height is not null").groupBy("width", "height").agg(F.count("*").alias("images"))
    aspect = F.try_divide(F.col("width"), F.col("height"))
    flags = {"small": F.least("width", "height") < 256, "large": F.greatest("width", "height") > 10000, "aspect": ~((aspect >= 0.2) & (aspect <= 5)), "rare": F.col("images") < rare}
    return n.select("*", F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for name, c in flags.items()))), ",").alias("flags"))


def cooccurrence(pairs: DataFrame, image: str = "image", cls: str = "class_id") -> DataFrame:
    """(class_a, class_b, images, share_of_a): images in which both classes occur; the diagonal holds a class's own images.

    Each image's distinct classes meet as one array, bounded by the number of classes.
    """
    sets = pairs.groupBy(image).agg(F.collect_set(cls).alias("c"))
    both = sets.select(F.explode("c").alias("class_a"), "c").select("class_a", F.explode("c").alias("class_b"))
    n = both.groupBy("class_a", "class_b").agg(F.count("*").alias("images"))
    own = F.max(F.when(F.col("class_a") == F.col("class_b"), F.col("images"))).over(Window.partitionBy("class_a"))
    return n.withColumn("share_of_a", F.col("images") / own)


def combinations(pairs: DataFrame, image: str = "image", cls: str = "class_id") -> DataFrame:
    """(classes, images): how many images hold exactly each set of classes."""
    sets = pairs.groupBy(image).agg(F.array_join(F.array_sort(F.collect_set(F.col(cls))), "|").alias("classes"))
    return sets.groupBy("classes").agg(F.count("*").alias("images"))


def drift(shares: DataFrame, key: str, share: str, points: float = 5.0, ratio: float = 1.25) -> DataFrame:
    """Per key over the splits: range and ratio of shares and whether either passes its limit."""
    out = shares.groupBy(key).agg((F.max(share) - F.min(share)).alias("share_range"), F.try_divide(F.max(share), F.min(share)).alias("share_ratio"))
    return out.withColumn("flagged", (F.col("share_range") >= points) | F.coalesce(F.col("share_ratio") >= ratio, F.lit(True)))


def rollup_metrics(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(metric, value): one conditional count each, in one pass, unpivoted."""
    one = df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*(F.col(f"`{n}`") for n in conditions)))).alias("metric", "value"))


def stratified_recall(rows: DataFrame, keys: list[str], matched: str = "matched", at_floor: str = "matched_at_floor") -> DataFrame:
    """Per stratum: instances, tp, fn, recall, miss rate, tp at the confidence floor and share of all misses."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("instances"), F.count_if(F.col(matched)).alias("tp"), F.count_if(F.col(at_floor)).alias("tp_at_floor")).withColumn("fn", F.col("instances") - F.col("tp"))
    whole = out.agg(F.sum("fn").alias("all_fn"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.select(*keys, "instances", "tp", "fn", F.try_divide("tp", "instances").alias("recall"), F.try_divide("fn", "instances").alias("fn_rate"), "tp_at_floor", F.try_divide("fn", "all_fn").alias("share_of_all_fn"))


def hash_sample(df: DataFrame, key: Column, seed: int, size: int) -> DataFrame:
    """A repeatable sample: the `size` rows with the smallest SHA-256 of seed and key."""
    return df.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)).orderBy("draw").limit(size)

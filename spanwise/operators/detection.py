"""Scoring of detections: overlaps, greedy matching, precision-recall, calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions.scalars import iou, magnitude_bucket

CORNERS = ("x1", "y1", "x2", "y2")


def overlaps(predictions: DataFrame, regions: DataFrame, same_class: bool = True, least: float = 0.0) -> DataFrame:
    """(image_id, class_id, prediction_id, confidence, region_id, iou) of pairs in one image with iou over `least`."""
    keys = ["image_id", "class_id"] if same_class else ["image_id"]
    p = predictions.select("image_id", F.col("class_id").alias("class_id"), F.col("id").alias("prediction_id"), "confidence", *(F.col(c).alias(f"p_{c}") for c in CORNERS))
    r = regions.select("image_id", F.col("class_id").alias("class_id" if same_class else "region_class"), F.col("id").alias("region_id"), *(F.col(c).alias(f"r_{c}") for c in CORNERS))
    value = iou([F.col(f"p_{c}") for c in CORNERS], [F.col(f"r_{c}") for c in CORNERS])
    met = p.join(r, keys).withColumn("iou", value).where(F.col("iou") > least)
    return met.select("image_id", "class_id", *([] if same_class else ["region_class"]), "prediction_id", "confidence", "region_id", "iou")


def greedy_match(predictions: DataFrame, regions: DataFrame, thresholds: list[float], order: str = "confidence") -> DataFrame:
    """(threshold, image_id, class_id, prediction_id, confidence, region_id, iou): one-to-one matches within image and class.

    order 'confidence': predictions choose in turn (highest confidence, then
    smallest id) the unused region of largest iou (then smallest id) and match if
    it reaches the threshold. order 'iou': pairs are taken by iou, then region,
    then prediction. Overlaps are joined once for all thresholds; a prediction
    competes within its own image only, so images are matched independently.
    """
    steps = sorted(thresholds)
    pairs = overlaps(predictions, regions, least=0.0).where(F.col("iou") >= steps[0])
    turns = [F.col("confidence").desc(), "prediction_id", F.col("iou").desc(), "region_id"] if order == "confidence" else [F.col("iou").desc(), "region_id", "prediction_id"]
    pairs = pairs.repartition("image_id", "class_id").sortWithinPartitions("image_id", "class_id", *turns)

    def match(batches):
        key, used = None, []
        for pdf in batches:
            taken = [[] for _ in steps]
            cells = zip(*(pdf[c].tolist() for c in ("image_id", "class_id", "prediction_id", "region_id", "iou")))
            for i, (image, cls, p, r, v) in enumerate(cells):
                if (image, cls) != key:
                    key, used = (image, cls), [(set(), set()) for _ in steps]
                for t, at_least in enumerate(steps):
                    if v < at_least:
                        break
                    if p not in used[t][0] and r not in used[t][1]:
                        used[t][0].add(p)
                        used[t][1].add(r)
                        taken[t].append(i)
            yield pd.concat([pdf.iloc[rows].assign(threshold=t) for t, rows in zip(steps, taken)])[["threshold", *pdf.columns]]

    kinds = dict(pairs.dtypes)
    schema = "threshold double, " + ", ".join(f"{c} {kinds[c]}" for c in pairs.columns)
    return pairs.mapInPandas(match, schema)


def ranked(predictions: DataFrame, matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """Every prediction at every threshold with `correct`."""
    grid = predictions.select("class_id", "image_id", F.col("id").alias("prediction_id"), "confidence", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hits = matches.select("threshold", "prediction_id", F.lit(True).alias("correct"))
    return grid.join(hits, ["threshold", "prediction_id"], "left").fillna(False, ["correct"])


def _ranks(rows: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Adds the place of each row among those of its keys, from 1, counted within buckets with carried counts; `bucket` rises along the order."""
    b = rows.withColumn("__bucket", bucket)
    sums = b.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    above = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    return b.withColumn("__own", own).join(carried, [*keys, "__bucket"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__bucket", "__own", "__before")


def _falling(confidence: Column) -> Column:
    """Buckets in the order of falling confidence, fine near 0, where most detections lie."""
    return -magnitude_bucket(F.coalesce(confidence, F.lit(0.0)), 256)


def _interpolated(points: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, truths, ap from the ranks of correct predictions: points: keys, rank, tp (the how manieth correct one it is)."""
    curve = points.join(truths, keys).where("truths > 0")
    curve = curve.select(*keys, (F.col("tp") / F.col("rank")).alias("precision"), F.floor(F.lit(100) * F.col("tp") / F.col("truths")).cast("int").alias("reach"))
    best = curve.groupBy(*keys, "reach").agg(F.max("precision").alias("precision"))
    # At most 101 recall steps for each key.
    steps = best.groupBy(*keys).agg(F.collect_list(F.struct("reach", "precision")).alias("s"))
    at = lambda k: F.coalesce(F.array_max(F.transform(F.filter("s", lambda x: x["reach"] >= k), lambda x: x["precision"])), F.lit(0.0))
    ap = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda acc, k: acc + at(k)) / 101
    scored = steps.select(*keys, ap.alias("ap"))
    return truths.join(scored, keys, "left").select(*keys, "truths", F.when(F.col("truths") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def average_precision(rows: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, truths, ap: 101-point interpolated average precision.

    rows: keys, image_id, prediction_id, confidence, correct; truths: keys and
    `truths`. Predictions rank by confidence, image, id; precision at a recall is
    the best at that recall or beyond. No truths gives null, no predictions 0.
    A class is ranked within buckets of confidence with carried counts, so that no
    class is sorted in one task.
    """
    order = [F.col("confidence").desc(), F.col("image_id"), F.col("prediction_id")]
    ranked_ = _ranks(rows, keys, order, _falling(F.col("confidence")), "rank").where("correct")
    return _interpolated(_ranks(ranked_, keys, order, _falling(F.col("confidence")), "tp"), truths, keys)


def average_precisions(predictions: DataFrame, matches: DataFrame, truths: DataFrame) -> DataFrame:
    """(class_id, threshold, truths, ap) as average_precision, from the predictions, their matches and (class_id, threshold, truths).

    A prediction's rank within its class holds for every threshold, so predictions
    are ranked once, and only the matches are repeated by threshold.
    """
    order = [F.col("confidence").desc(), F.col("image_id"), F.col("prediction_id")]
    p = predictions.select("class_id", "image_id", F.col("id").alias("prediction_id"), "confidence")
    places = _ranks(p, ["class_id"], order, _falling(F.col("confidence")), "rank").select("prediction_id", "rank", "confidence")
    hit = matches.groupBy("prediction_id", "class_id").agg(F.collect_list("threshold").alias("t"))  # as many as there are thresholds
    hits = hit.join(places, "prediction_id").select("class_id", F.explode("t").alias("threshold"), "rank", "confidence")
    return _interpolated(_ranks(hits, ["class_id", "threshold"], [F.col("rank")], _falling(F.col("confidence")), "tp"), truths, ["class_id", "threshold"])


def class_scores(rows: DataFrame, truths: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, false positives an image; a rate without a base is 0.

    `images`: (image_id) of all images, those without predictions or regions included; repeated ids count once.
    """
    got = rows.groupBy(*keys).agg(F.count_if("correct").alias("tp"), F.count_if(~F.col("correct")).alias("fp"))
    count = images.agg(F.count_distinct("image_id").alias("images"))  # one row
    out = truths.join(got, keys, "left").fillna(0, ["tp", "fp"]).withColumn("fn", F.col("truths") - F.col("tp")).crossJoin(F.broadcast(count))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(*keys, "tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(fp, F.col("images")).alias("fp_per_image"))


def reliability(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per key and confidence bin, empty bins included: predictions, mean confidence, accuracy (null if empty) and the bin's part of the expected calibration error.

    A confidence outside 0 to 1, NaN or null, or an unknown `correct`, is an error.
    """
    sound = F.coalesce((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & F.col("correct").isNotNull(), F.lit(False))
    confidence = F.when(sound, F.col("confidence")).otherwise(F.raise_error(F.lit("a calibration row without a confidence from 0 to 1 or a known outcome")))
    bin_ = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    full = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    grid = full.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(full, [*keys, "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*keys))
    part = F.coalesce(F.col("n") / total * F.abs(F.col("mean_confidence") - F.col("accuracy")), F.lit(0.0))
    return out.withColumn("ece_part", part)


def best_overlaps(predictions: DataFrame, regions: DataFrame, floor: float = 0.0) -> DataFrame:
    """Per region the largest overlap with predictions of its own and of other classes, 0 without any."""
    near = overlaps(predictions.where(F.col("confidence") >= floor), regions, same_class=False)
    own = F.col("class_id") == F.col("region_class")
    best = near.groupBy("region_id").agg(F.max(F.when(own, F.col("iou"))).alias("same_class"), F.max(F.when(~own, F.col("iou"))).alias("other_class"))
    return regions.select(F.col("id").alias("region_id"), "class_id").join(best, "region_id", "left").fillna(0.0, ["same_class", "other_class"])


def confusion(predictions: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(truth, predicted, n): matches across classes by falling overlap; misses and false alarms against 'background'."""
    p = predictions.select("image_id", F.col("class_id").cast("string").alias("predicted"), F.lit(0).alias("class_id"), "id", "confidence", *CORNERS)
    r = regions.select("image_id", F.col("class_id").cast("string").alias("truth"), F.lit(0).alias("class_id"), "id", *CORNERS)
    hits = greedy_match(p, r, [threshold], "iou").select("prediction_id", "region_id")
    named_p, named_r = p.select(F.col("id").alias("prediction_id"), "predicted"), r.select(F.col("id").alias("region_id"), "truth")
    both = named_p.join(hits, "prediction_id", "left").join(named_r, "region_id", "full_outer")
    return both.groupBy(F.coalesce("truth", F.lit("background")).alias("truth"), F.coalesce("predicted", F.lit("background")).alias("predicted")).agg(F.count("*").alias("n"))


def curve_at_confidence(rows: DataFrame, truths: DataFrame, keys: list[str], grid: int = 1000) -> DataFrame:
    """(keys, point, confidence, precision, recall): the curves read at `grid` + 1 confidences, exactly, from binned sums."""
    at = F.floor(F.col("confidence") * grid).cast("int")
    sums = rows.groupBy(*keys, at.alias("point")).agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"))
    full = truths.select(*keys, "truths", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("point")).join(sums, [*keys, "point"], "left").fillna(0, ["n", "hits"])
    down = Window.partitionBy(*keys).orderBy(F.col("point").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum("hits").over(down), F.sum("n").over(down)
    return full.select(*keys, "point", (F.col("point") / grid).alias("confidence"), F.coalesce(F.try_divide(tp, n), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(tp, F.col("truths")), F.lit(0.0)).alias("recall"))


def map_over(aps: DataFrame) -> DataFrame:
    """(map50, map50_95): means over classes, and over classes and thresholds, of (class_id, threshold, ap); nulls left out."""
    return aps.agg(F.avg(F.when(F.abs(F.col("threshold") - 0.5) < 1e-9, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))


IOU_THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def evaluate(predictions: DataFrame, regions: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(class_id, threshold, truths, ap) of every class with truths."""
    thresholds = thresholds or IOU_THRESHOLDS
    truths = regions.groupBy("class_id").agg(F.count("*").alias("truths")).select("class_id", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "truths")
    return average_precisions(predictions, greedy_match(predictions, regions, thresholds), truths)


def interpolated_curves(rows: DataFrame, truths: DataFrame, keys: list[str], grid: int = 1000) -> DataFrame:
    """(keys, point, confidence, precision, recall) at `grid` even confidences from 0 to 1, linear between the neighbouring predictions.

    Predictions rank by falling confidence, image, id. Above the highest one precision is 1
    and recall 0, below the lowest they keep its values; classes without predictions or truths have 0 throughout.
    Predictions are summed by the grid interval that they lie in, so no class is sorted in one task.
    """
    last = grid - 1
    near = F.floor(F.col("confidence") * last).cast("int")
    at = F.when(near / last > F.col("confidence"), near - 1).when((near + 1) / last <= F.col("confidence"), near + 1).otherwise(near)
    first = F.struct(-F.col("confidence"), F.col("image_id"), F.col("prediction_id"))
    sums = rows.groupBy(*keys, at.alias("point")).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("hits"), F.min("confidence").alias("low"),
        F.min_by(F.struct("confidence", F.col("correct").cast("int").alias("hit")), first).alias("top"),
    )
    full = truths.select(*keys, "truths", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("point")).join(sums, [*keys, "point"], "left").fillna(0, ["n", "hits"])
    down = Window.partitionBy(*keys).orderBy(F.col("point").desc())  # a grid's points for each key
    here = down.rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*keys).orderBy(F.col("point")).rowsBetween(Window.unboundedPreceding, -1)
    full = full.select(
        *keys, "truths", "point", (F.col("point") / last).alias("confidence"), F.sum("n").over(here).alias("n"), F.sum("hits").over(here).alias("tp"),
        F.last("low", ignorenulls=True).over(here).alias("upper"), F.last("top", ignorenulls=True).over(below).alias("next"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"),
    )
    part = F.try_divide(F.col("upper") - F.col("confidence"), F.col("upper") - F.col("next.confidence"))

    def read(value, beyond: float) -> Column:
        now, then = value(F.col("tp"), F.col("n")), value(F.col("tp") + F.col("next.hit"), F.col("n") + 1)
        inside = F.when(F.col("n") == 0, F.lit(beyond)).when(F.col("next").isNull(), now).otherwise(now + (then - now) * part)
        return F.when((F.col("all") == 0) | (F.col("truths") == 0), F.lit(0.0)).otherwise(inside)

    return full.select(
        *keys, "point", "confidence", read(lambda tp, n: F.try_divide(tp, n), 1.0).alias("precision"), read(lambda tp, n: F.try_divide(tp, F.col("truths")), 0.0).alias("recall")
    )


def nearest_points(curves: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """The curve's rows nearest to each wanted confidence (ties to the lower), with column `wanted`."""
    asked = curves.withColumn("wanted", F.explode(F.array(*map(F.lit, wanted))))
    cells = [c for c in curves.columns if c not in keys]
    best = asked.groupBy(*keys, "wanted").agg(F.min_by(F.struct(*cells), F.struct(F.abs(F.col("confidence") - F.col("wanted")), F.col("point"))).alias("x"))
    return best.select(*keys, "wanted", "x.*")


def confusion_summary(matrix: DataFrame) -> DataFrame:
    """(class_name, truths, correct, missed, confused, false_alarms, missed_share) of a long (truth, predicted, n) matrix with 'background'."""
    named = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(True).alias("row")), F.struct(F.col("predicted").alias("c"), F.lit(False).alias("row")))).alias("x"), "*").select("x.*", "truth", "predicted", "n").where("c <> 'background'")
    own = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    row, t, p = F.col("row"), F.col("truth"), F.col("predicted")
    out = named.groupBy(F.col("c").alias("class_name")).agg(
        own(row).alias("truths"), own(row & (t == p)).alias("correct"), own(row & (p == "background")).alias("missed"),
        own(row & (t != p) & (p != "background")).alias("confused"), own(~row & (t == "background")).alias("false_alarms"),
    )
    return out.withColumn("missed_share", F.try_divide("missed", "truths"))


def top_confusions(matrix: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent pairs of different classes, background aside, with their share of the truths; ties by names."""
    truths = matrix.where("truth <> 'background'").groupBy("truth").agg(F.sum("n").alias("truths"))
    off = matrix.where("truth <> predicted and truth <> 'background' and predicted <> 'background'")
    return off.join(F.broadcast(truths), "truth").orderBy(F.col("n").desc(), "truth", "predicted").limit(top).select("truth", "predicted", "n", F.try_divide("n", "truths").alias("share"))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two (metric, value) tables; a metric of one side only has nulls."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    return both.withColumn("delta", F.col("after") - F.col("before"))

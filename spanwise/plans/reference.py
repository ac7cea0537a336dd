"""Queries of the inspection engine over whole tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanwise.functions import scalars as X
from spanwise.functions.text import hex_long, hex_text, plain, unify_split
from spanwise.operators import detection, fusion, graph, inventory, quarantine, stats, store, trajectory, validate
from spanwise.plans.core import P7_BOXES_SQL, P7_RESULTS_SQL
from spanwise.session import cut, table
from spanwise.streaming import fusion_stream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


# Annotated boxes: the valid label rows, their split from the path, on pictures of 1000 x 800.
def boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = quarantine.load_boxes(table(spark, sf, "raw_lines"))
    return rows.withColumn("split", F.regexp_extract("file_name", "labels/([a-z]+)/", 1)).withColumn("image", F.col("file_name"))


BOXES = f"b AS (SELECT *, regexp_extract(file_name, 'labels/([a-z]+)/', 1) AS split, file_name AS image FROM ({P7_BOXES_SQL}))"


@query(f"""
WITH {BOXES}, s AS (SELECT unnest([split, 'all']) split, class_id, image FROM b),
n AS (SELECT split, class_id, count(*) instances, count(DISTINCT image) images FROM s GROUP BY ALL)
SELECT split, class_id, instances, images, round(100.0 * instances / sum(instances) OVER w, 9) AS share_percent,
  round(max(instances) OVER w / instances, 9) AS ratio_to_largest, round(instances / min(instances) OVER w, 9) AS ratio_to_smallest
FROM n WINDOW w AS (PARTITION BY split)""")
def class_distribution(spark, sf):
    d = stats.class_distribution(boxes(spark, sf))
    return d.select("split", "class_id", "instances", "images", *(r9(c).alias(c) for c in ("share_percent", "ratio_to_largest", "ratio_to_smallest")))


@query(f"""
WITH {BOXES}, l AS (SELECT split, class_id::VARCHAR class_id, unnest(['height', 'width']) metric, unnest([height, width]) v FROM b)
SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(class_id) = 0 THEN 'class_id' ELSE 'all' END AS grain, class_id, split, metric, count(v) AS count,
  round(avg(v), 9) AS mean, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.01), 9) AS p01, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.25), 9) AS p25,
  round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.75), 9) AS p75, round(quantile_cont(v, 0.95), 9) AS p95, round(quantile_cont(v, 0.99), 9) AS p99
FROM l GROUP BY GROUPING SETS ((metric), (metric, split), (metric, class_id))""")
def box_summary(spark, sf):
    d = stats.eleven_numbers(boxes(spark, sf), [[], ["split"], ["class_id"]], ["width", "height"])
    return d.select(*(r9(c).alias(c) if c in ("mean", "p01", "p05", "p25", "median", "p75", "p95", "p99") else F.col(c) for c in d.columns))


@query(f"""
WITH {BOXES}, m AS (SELECT *, width * height AS a, (width * 1000) / nullif(height * 800, 0) AS r,
  greatest(-(x - width / 2), -(y - height / 2), x + width / 2 - 1, y + height / 2 - 1, 0.0) AS e, least(x - width / 2, y - height / 2, 1 - (x + width / 2), 1 - (y + height / 2)) AS edge FROM b)
SELECT line_id, round(a, 9) AS normalized_area, round(width * 1000 * height * 800, 9) AS pixel_area, round(r, 9) AS aspect_ratio,
  CASE WHEN a < 0.001 THEN 'tiny' WHEN a < 0.01 THEN 'small' WHEN a < 0.1 THEN 'medium' ELSE 'large' END AS size_category,
  edge <= 0.01 AS near_border, e > 0 AND e <= 1e-6 AS rounding_warning, r < 0.1 OR r > 10 AS extreme_aspect_ratio FROM m""")
def box_metrics(spark, sf):
    d = stats.box_metrics(boxes(spark, sf), F.lit(1000), F.lit(800))
    return d.select("line_id", F.round("normalized_area", 9).alias("normalized_area"), r9("pixel_area").alias("pixel_area"), r9("aspect_ratio").alias("aspect_ratio"), "size_category", "near_border", "rounding_warning", "extreme_aspect_ratio")


@query("""
WITH h AS (SELECT raw_split, CASE WHEN annotation_count < 0 THEN NULL WHEN annotation_count = 0 THEN '0' WHEN annotation_count = 1 THEN '1' WHEN annotation_count <= 5 THEN '2-5' WHEN annotation_count <= 10 THEN '6-10' WHEN annotation_count <= 20 THEN '11-20' WHEN annotation_count > 20 THEN '>20' END AS bin FROM gyu_det_v3_baseline_v1),
g AS (SELECT DISTINCT raw_split, unnest(['0', '1', '2-5', '6-10', '11-20', '>20']) bin FROM h),
c AS (SELECT g.raw_split, g.bin, count(h.bin) n FROM g LEFT JOIN h ON h.raw_split = g.raw_split AND h.bin = g.bin GROUP BY ALL)
SELECT raw_split, bin, n, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY raw_split), 0), 9) AS share_percent FROM c""")
def annotation_histogram(spark, sf):
    d = stats.dense_histogram(table(spark, sf, "gyu_det_v3_baseline_v1"), ["raw_split"], X.annotation_bin(F.col("annotation_count")), ["0", "1", "2-5", "6-10", "11-20", ">20"])
    return d.withColumn("share_percent", r9("share_percent"))


@query("""
WITH n AS (SELECT width, height, count(*) images FROM manifest WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY ALL)
SELECT width, height, images, array_to_string(list_filter([CASE WHEN least(width, height) < 256 THEN 'small' END, CASE WHEN greatest(width, height) > 10000 THEN 'large' END,
  CASE WHEN NOT coalesce(width / nullif(height, 0) BETWEEN 0.2 AND 5, false) THEN 'aspect' END, CASE WHEN images < 10 THEN 'rare' END], lambda x: x IS NOT NULL), ',') AS flags FROM n""")
def resolution_frequency(spark, sf):
    return stats.resolutions(table(spark, sf, "manifest"))


@query(f"""
WITH {BOXES}, d AS (SELECT DISTINCT image, class_id FROM b),
n AS (SELECT p.class_id class_a, q.class_id class_b, count(*) images FROM d p JOIN d q USING (image) GROUP BY ALL)
SELECT class_a, class_b, images, round(images / max(CASE WHEN class_a = class_b THEN images END) OVER (PARTITION BY class_a), 9) AS share_of_a FROM n""")
def class_cooccurrence(spark, sf):
    return stats.cooccurrence(boxes(spark, sf)).withColumn("share_of_a", r9("share_of_a"))


@query(f"""
WITH {BOXES}, s AS (SELECT image, array_to_string(list_sort(list(DISTINCT class_id)), '|') classes FROM b GROUP BY image)
SELECT classes, count(*) AS images FROM s GROUP BY classes""")
def class_combinations(spark, sf):
    return stats.combinations(boxes(spark, sf))


@query(f"""
WITH {BOXES}, n AS (SELECT split, class_id, count(*) n FROM b GROUP BY ALL), s AS (SELECT split, class_id, 100.0 * n / sum(n) OVER (PARTITION BY split) share FROM n)
SELECT class_id, round(max(share) - min(share), 9) AS share_range, round(max(share) / nullif(min(share), 0), 9) AS share_ratio,
  max(share) - min(share) >= 5 OR coalesce(max(share) / nullif(min(share), 0) >= 1.25, true) AS flagged FROM s GROUP BY class_id""")
def class_drift(spark, sf):
    shares = stats.class_distribution(boxes(spark, sf)).where("split <> 'all'")
    d = stats.drift(shares, "class_id", "share_percent")
    return d.select("class_id", r9("share_range").alias("share_range"), r9("share_ratio").alias("share_ratio"), "flagged")


_SPLIT = "CASE WHEN lower(trim({0})) IN ('train','training') THEN 'train' WHEN lower(trim({0})) IN ('valid','val','validation') THEN 'valid' WHEN lower(trim({0})) IN ('test','testing') THEN 'test' END"


@query(f"""
SELECT coalesce({_SPLIT.format("split")}, 'all') AS split, count(*) AS images, count(*) FILTER (pairing_status = 'exact_pair') AS paired, count(*) FILTER (pairing_status = 'image_without_label') AS unlabelled,
  count(*) FILTER (image_sha256 IS NULL) AS without_hash, count(DISTINCT source) AS sources, sum(file_size_bytes)::BIGINT AS bytes
FROM manifest GROUP BY ROLLUP ({_SPLIT.format("split")})""")
def dataset_overview(spark, sf):
    m = table(spark, sf, "manifest").withColumn("s", unify_split(F.col("split")))
    d = m.rollup("s").agg(F.count("*").alias("images"), F.count_if(F.col("pairing_status") == "exact_pair").alias("paired"), F.count_if(F.col("pairing_status") == "image_without_label").alias("unlabelled"), F.count_if(F.col("image_sha256").isNull()).alias("without_hash"), F.count_distinct("source").alias("sources"), F.sum("file_size_bytes").alias("bytes"))
    return d.withColumn("split", F.coalesce("s", F.lit("all"))).drop("s")


@query("""
WITH a AS (SELECT count(*) FILTER (mpo_warning) mpo, count(*) FILTER (boundary_rounding_warning_count > 0) rounding, count(*) FILTER (annotation_count < 0) negative_counts,
  count(*) FILTER (width < 1 OR height < 1) bad_sizes, count(*) FILTER (image_sha256 IS NULL) no_hash, count(*) FILTER (trim(exclusion_reason) <> '') excluded FROM gyu_det_v3_baseline_v1)
UNPIVOT a ON mpo, rounding, negative_counts, bad_sizes, no_hash, excluded INTO NAME metric VALUE value""")
def validation_rollup(spark, sf):
    c = F.col
    return stats.rollup_metrics(table(spark, sf, "gyu_det_v3_baseline_v1"), {"mpo": c("mpo_warning"), "rounding": c("boundary_rounding_warning_count") > 0, "negative_counts": c("annotation_count") < 0, "bad_sizes": (c("width") < 1) | (c("height") < 1), "no_hash": c("image_sha256").isNull(), "excluded": F.trim("exclusion_reason") != ""})


@query("SELECT raw_split, trim(exclusion_reason) AS reason, count(*) AS records FROM gyu_det_v3_baseline_v1 WHERE trim(exclusion_reason) <> '' GROUP BY ALL")
def exclusion_summary(spark, sf):
    return table(spark, sf, "gyu_det_v3_baseline_v1").where("trim(exclusion_reason) <> ''").groupBy("raw_split", F.trim("exclusion_reason").alias("reason")).agg(F.count("*").alias("records"))


@query("""
WITH g AS (SELECT raw_split, annotation_count, width, height FROM gyu_det_v3_baseline_v1),
q AS (SELECT raw_split, width || 'x' || height AS size, count(*) n FROM g WHERE width >= 1 AND height >= 1 GROUP BY ALL),
r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY raw_split ORDER BY n DESC, size) <= 5),
t AS (SELECT raw_split, array_to_string(list(size || ':' || n ORDER BY n DESC, size), ',') top_sizes FROM r GROUP BY raw_split)
SELECT g.raw_split, count(*) AS records, median(CASE WHEN annotation_count >= 0 THEN annotation_count END) AS median_annotations, sum(CASE WHEN annotation_count >= 0 THEN annotation_count END)::BIGINT AS annotations, any_value(top_sizes) AS top_sizes
FROM g LEFT JOIN t USING (raw_split) GROUP BY g.raw_split""")
def split_statistics(spark, sf):
    g = table(spark, sf, "gyu_det_v3_baseline_v1")
    known = F.when(F.col("annotation_count") >= 0, F.col("annotation_count"))
    sizes = g.where("width >= 1 and height >= 1").groupBy("raw_split", F.concat_ws("x", "width", "height").alias("size")).agg(F.count("*").alias("n"))
    top = sizes.withColumn("k", F.row_number().over(Window.partitionBy("raw_split").orderBy(F.col("n").desc(), "size"))).where("k <= 5")
    tops = top.groupBy("raw_split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "size", "n"))), lambda x: F.concat(x["size"], F.lit(":"), x["n"].cast("string"))), ",").alias("top_sizes"))
    return g.groupBy("raw_split").agg(F.count("*").alias("records"), F.median(known).alias("median_annotations"), F.sum(known).alias("annotations")).join(tops, "raw_split", "left")


@query(f"WITH {BOXES} SELECT line_id, class_id, round(width * height, 9) AS area FROM b ORDER BY width * height DESC, line_id LIMIT 20")
def largest_boxes(spark, sf):
    d = boxes(spark, sf).select("line_id", "class_id", (F.col("width") * F.col("height")).alias("a")).orderBy(F.col("a").desc(), "line_id").limit(20)
    return d.select("line_id", "class_id", F.round("a", 9).alias("area"))


@query("SELECT image_id FROM manifest ORDER BY sha256('42:' || split || ':' || image_relative_path), image_id LIMIT 100")
def hash_sample(spark, sf):
    return stats.hash_sample(table(spark, sf, "manifest"), F.concat_ws(":", "split", "image_relative_path"), 42, 100).select("image_id")


PAIRS = f"""i AS (SELECT {_SPLIT.format("split")} s, replace(lower(trim(regexp_replace(trim(image_filename), '\\.[^.]*$', ''))), 'ß', 'ss') k, image_relative_path image, image_filename name FROM manifest WHERE {_SPLIT.format("split")} IS NOT NULL AND image_filename IS NOT NULL),
l AS (SELECT raw_split s, replace(lower(trim(regexp_replace(trim(regexp_extract(label_relative_path, '[^/]*$')), '\\.[^.]*$', ''))), 'ß', 'ss') k, record_id::VARCHAR label, regexp_extract(label_relative_path, '[^/]*$') name FROM gyu_det_v3_baseline_v1 WHERE contains(label_relative_path, '/')),
ni AS (SELECT *, count(*) OVER (PARTITION BY s, k) n FROM i), nl AS (SELECT *, count(*) OVER (PARTITION BY s, k) n FROM l),
ci AS (SELECT s, k, count(*) n FROM i GROUP BY ALL), cl AS (SELECT s, k, count(*) n FROM l GROUP BY ALL),
pairs AS (
  SELECT s, k, image, label, 'exact_pair' AS status FROM ni JOIN nl USING (s, k) WHERE ni.n = 1 AND nl.n = 1
  UNION ALL SELECT ni.s, ni.k, image, NULL, CASE WHEN cl.n IS NULL THEN 'image_without_label' ELSE 'ambiguous' END FROM ni LEFT JOIN cl ON cl.s = ni.s AND cl.k = ni.k WHERE NOT (ni.n = 1 AND coalesce(cl.n, 0) = 1)
  UNION ALL SELECT nl.s, nl.k, NULL, label, CASE WHEN ci.n IS NULL THEN 'label_without_image' ELSE 'ambiguous' END FROM nl LEFT JOIN ci ON ci.s = nl.s AND ci.k = nl.k WHERE NOT (nl.n = 1 AND coalesce(ci.n, 0) = 1))"""


def pair_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    images = table(spark, sf, "manifest").select(unify_split(F.col("split")).alias("split"), X.pairing_key(F.col("image_filename")).alias("key"), F.col("image_relative_path").alias("image"), F.col("image_filename").alias("name")).where("split is not null and key is not null")
    labels = table(spark, sf, "gyu_det_v3_baseline_v1").where(F.contains("label_relative_path", F.lit("/"))).withColumn("name", F.regexp_extract("label_relative_path", "[^/]*$", 0))
    return images, labels.select(F.col("raw_split").alias("split"), X.pairing_key(F.col("name")).alias("key"), F.col("record_id").cast("string").alias("label"), "name")


@query(f"WITH {PAIRS} SELECT s AS split, k AS key, image, label, status FROM pairs")
def pair_inventory(spark, sf):
    images, labels = pair_sides(spark, sf)
    return inventory.pair_unique(images.drop("name"), labels.drop("name"), ["split", "key"])


@query("""
WITH l AS (SELECT structure_id left_id, lower(trim(name)) ln, ['train', 'valid', 'test'][structure_id % 3 + 1] ls FROM structures), p AS (SELECT p_partkey right_id, lower(p_name) rn, ['train', 'valid', 'test'][p_partkey % 3 + 1] rs FROM part),
c AS (SELECT *, levenshtein(ln, rn) distance, 1 - levenshtein(ln, rn) / greatest(length(ln), length(rn), 1) similarity FROM l, p),
u AS (SELECT *, 'all_splits' scope FROM c UNION ALL SELECT *, 'same_split' FROM c WHERE ls = rs)
SELECT left_id, scope, right_id, distance, round(similarity, 8) AS similarity, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, left_id ORDER BY distance, similarity DESC, list_position(['train', 'valid', 'test'], rs), rn, right_id) rank FROM u) WHERE rank <= 10""")
def fuzzy_candidates(spark, sf):
    """The structure names (a stated query set) against every part name, in their own split and in all."""
    split = lambda c: F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), (F.col(c) % 3 + 1).cast("int"))
    left = table(spark, sf, "structures").select(F.col("structure_id").alias("left_id"), split("structure_id").alias("left_split"), plain(F.col("name")).alias("left_name"))
    right = table(spark, sf, "part").select(F.col("p_partkey").alias("right_id"), split("p_partkey").alias("right_split"), F.lower("p_name").alias("right_name"))
    d = inventory.fuzzy_candidates(left, right)
    return d.select("left_id", "scope", "right_id", F.col("distance").cast("bigint").alias("distance"), F.round("similarity", 8).alias("similarity"), "rank")


@query(f"""
SELECT lower(trim(image_sha256)) AS content, count(*) AS members, count(DISTINCT {_SPLIT.format("split")}) AS splits, min(image_id) AS representative, count(DISTINCT {_SPLIT.format("split")}) > 1 AS cross_split
FROM manifest WHERE image_sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf):
    return inventory.duplicate_classes(table(spark, sf, "manifest"), hex_text(F.col("image_sha256"), 64), "image_id", unify_split(F.col("split")))


def telling_hashes(spark, sf) -> DataFrame:
    h = table(spark, sf, "manifest").select("image_id", hex_text(F.col("perceptual_hash"), 32).alias("h")).where("h is not null").groupBy("h").agg(F.min("image_id").alias("id"))
    return h.select("id", hex_long(F.col("h"), 1).alias("hi"), hex_long(F.col("h"), 17).alias("lo")).where("bit_count(hi) + bit_count(lo) between 9 and 119")


@query("""
WITH h AS (SELECT regexp_replace(lower(trim(perceptual_hash)), '^0x', '') h, min(image_id) id FROM manifest WHERE perceptual_hash IS NOT NULL GROUP BY 1),
b AS (SELECT id, ('0x' || h[1:16])::UBIGINT hi, ('0x' || h[17:32])::UBIGINT lo FROM h),
c AS (SELECT *, bit_count(hi::BIT) + bit_count(lo::BIT) n FROM b)
SELECT a.id AS id_a, z.id AS id_b, (bit_count(xor(a.hi, z.hi)::BIT) + bit_count(xor(a.lo, z.lo)::BIT))::INT AS distance
FROM c a JOIN c z ON a.id < z.id WHERE a.n BETWEEN 9 AND 119 AND z.n BETWEEN 9 AND 119 AND bit_count(xor(a.hi, z.hi)::BIT) + bit_count(xor(a.lo, z.lo)::BIT) <= 4""")
def near_hashes(spark, sf):
    """Distinct hashes, each standing for its smallest image id, within 4 bits."""
    return inventory.hamming_neighbours(telling_hashes(spark, sf), 4, 5)


@query(_SQL["near_hashes"].replace("<= 4", "<= 12"))
def near_hashes_12(spark, sf):
    """Distinct hashes, each standing for its smallest image id, within the 12 bits of the reference's search."""
    return inventory.near_pairs(telling_hashes(spark, sf), 12)


@query(f"""
WITH n AS (SELECT image_id id, {_SPLIT.format("split")} s, regexp_replace(trim(image_filename), '\\.[^.]*$', '') t FROM manifest), m AS (SELECT id, s, t::BIGINT n FROM n WHERE regexp_full_match(t, '[0-9]+') AND s IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b, abs(a.n - b.n) AS gap FROM m a JOIN m b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id < b.id AND a.s <> b.s""")
def numeric_neighbours(spark, sf):
    m = table(spark, sf, "manifest").select(F.col("image_id").alias("id"), unify_split(F.col("split")).alias("split"), X.numeric_stem(F.col("image_filename")).alias("number"))
    return inventory.numeric_neighbours(m)


@query("SELECT review_id FROM leakage_review ORDER BY NOT coalesce(sha256_equal, false), hamming_distance NULLS LAST, review_id LIMIT 24")
def review_queue(spark, sf):
    return table(spark, sf, "leakage_review").orderBy(~F.coalesce("sha256_equal", F.lit(False)), F.col("hamming_distance").asc_nulls_last(), "review_id").limit(24).select("review_id")


@query("""
WITH a AS (SELECT image_id, width, height FROM manifest), b AS (SELECT image_id, min(width) width, min(height) height FROM gyu_det_v3_baseline_v1 GROUP BY image_id),
j AS (SELECT image_id, a.image_id IS NULL na, b.image_id IS NULL nb, a.width IS DISTINCT FROM b.width w, a.height IS DISTINCT FROM b.height h FROM a FULL JOIN b USING (image_id))
SELECT image_id, CASE WHEN na THEN 'added' WHEN nb THEN 'removed' ELSE 'changed' END AS change, CASE WHEN na OR nb THEN '' WHEN w AND h THEN 'width,height' WHEN w THEN 'width' ELSE 'height' END AS changed FROM j WHERE na OR nb OR w OR h""")
def snapshot_diff(spark, sf):
    b = table(spark, sf, "gyu_det_v3_baseline_v1").groupBy("image_id").agg(F.min("width").alias("width"), F.min("height").alias("height"))
    return inventory.snapshot_diff(table(spark, sf, "manifest").select("image_id", "width", "height"), b, "image_id", ["width", "height"])


# Detections: odd order lines are predictions, even ones regions; whole-number boxes.
_BOX = ["CAST(l_partkey % 7 AS DOUBLE) AS x1", "CAST(l_suppkey % 5 AS DOUBLE) AS y1", "CAST(l_partkey % 7 + 4 + l_quantity % 8 AS DOUBLE) AS x2", "CAST(l_suppkey % 5 + 4 + l_quantity % 6 AS DOUBLE) AS y2"]
_DET = ["l_orderkey * 10 + l_linenumber AS id", "CAST(floor(l_orderkey / 40) AS BIGINT) AS image_id", "CAST(l_suppkey % 3 AS INT) AS class_id", *_BOX]
# An order line that comes twice is one detection, with the outer corners of both.
_ONE = ["min(class_id) AS class_id", "min(x1) AS x1", "min(y1) AS y1", "max(x2) AS x2", "max(y2) AS y2"]
DETECTIONS = f"""p AS (SELECT id, image_id, {", ".join(_ONE)}, max(confidence) AS confidence FROM (SELECT {", ".join(_DET)}, (l_partkey % 1000) / 1000.0::DOUBLE AS confidence FROM lineitem WHERE l_linenumber % 2 = 1) GROUP BY id, image_id),
r AS (SELECT id, image_id, {", ".join(_ONE)} FROM (SELECT {", ".join(_DET)} FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY id, image_id),
o AS (SELECT p.image_id, p.class_id, p.id pid, p.confidence, r.id rid, greatest(least(p.x2, r.x2) - greatest(p.x1, r.x1), 0.0) * greatest(least(p.y2, r.y2) - greatest(p.y1, r.y1), 0.0) AS i,
  (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (r.x2 - r.x1) * (r.y2 - r.y1) AS ar FROM p JOIN r USING (image_id, class_id)),
u AS (SELECT image_id, class_id, pid, confidence, rid, i / (ap + ar - i) AS iou FROM o WHERE i > 0)"""


def matches_sql(to: str = "", extra: str = "true") -> str:
    """The greedy matches m (their names end in `to`) of the pairs that meet `extra`."""
    t, c0, c, w = (f"{n}{to}" for n in ("t", "c0", "c", "w"))
    free = f"list_filter({c}.rs, lambda x: NOT list_contains({w}.used, x))[1]"
    return f"""{t} AS (SELECT unnest([0.5, 0.75]::DOUBLE[]) threshold),
{c0} AS (SELECT threshold, image_id, class_id, pid, confidence, list(rid ORDER BY iou DESC, rid) rs FROM u, {t} WHERE iou >= threshold AND {extra} GROUP BY ALL),
{c} AS (SELECT *, row_number() OVER (PARTITION BY threshold, image_id, class_id ORDER BY confidence DESC, pid) k FROM {c0}),
{w}(threshold, image_id, class_id, k, pid, rid, used) AS (
  SELECT threshold, image_id, class_id, k, pid, rs[1], [rs[1]] FROM {c} WHERE k = 1
  UNION ALL
  SELECT {c}.threshold, {c}.image_id, {c}.class_id, {c}.k, {c}.pid, {free}, list_append({w}.used, {free})
  FROM {w} JOIN {c} ON {c}.threshold = {w}.threshold AND {c}.image_id = {w}.image_id AND {c}.class_id = {w}.class_id AND {c}.k = {w}.k + 1),
m{to} AS (SELECT threshold, pid, rid FROM {w} WHERE rid IS NOT NULL)"""


MATCHES = matches_sql()
RANKED = "a AS (SELECT t.threshold, p.class_id, p.image_id, p.id, p.confidence, m.pid IS NOT NULL AS correct FROM p CROSS JOIN t LEFT JOIN m ON m.threshold = t.threshold AND m.pid = p.id), n AS (SELECT class_id, count(*) truths FROM r GROUP BY class_id)"
THRESHOLDS = [0.5, 0.75]
TEN = str(detection.IOU_THRESHOLDS)


def detections(spark, sf) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")
    one = [F.expr(x) for x in _ONE]
    p = l.where("l_linenumber % 2 = 1").selectExpr(*_DET, "CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS confidence")
    return p.groupBy("id", "image_id").agg(*one, F.max("confidence").alias("confidence")), l.where("l_linenumber % 2 = 0").selectExpr(*_DET).groupBy("id", "image_id").agg(*one)


def ranked_detections(spark, sf) -> tuple[DataFrame, DataFrame]:
    p, r = detections(spark, sf)
    rows = detection.ranked(p, detection.greedy_match(p, r, THRESHOLDS), THRESHOLDS)
    truths = r.groupBy("class_id").agg(F.count("*").alias("truths")).select("class_id", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"), "truths")
    return rows, truths


@query(f"WITH RECURSIVE {DETECTIONS}, {MATCHES} SELECT threshold, pid AS prediction_id, rid AS region_id FROM m")
def greedy_matches(spark, sf):
    return detection.greedy_match(*detections(spark, sf), THRESHOLDS).select("threshold", "prediction_id", "region_id")


@query(f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {RANKED},
s AS (SELECT threshold, class_id, correct, row_number() OVER z AS k, sum(correct::INT) OVER z AS tp FROM a WINDOW z AS (PARTITION BY threshold, class_id ORDER BY confidence DESC, image_id, id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT s.threshold, s.class_id, truths, tp / k AS precision, tp / truths AS recall FROM s JOIN n USING (class_id) WHERE correct),
g AS (SELECT threshold, class_id, x, max(precision) p FROM q, range(0, 101) y(x) WHERE floor(100 * recall + 1e-9) >= x GROUP BY ALL)
SELECT class_id, threshold, truths, round(coalesce((SELECT sum(p) FROM g WHERE g.class_id = n.class_id AND g.threshold = t.threshold), 0) / 101, 9) AS ap FROM n, t""")
def average_precision(spark, sf):
    return detection.evaluate(*detections(spark, sf), THRESHOLDS).withColumn("ap", r9("ap"))


@query(_SQL["average_precision"].replace(str(THRESHOLDS), TEN))
def average_precision_50_95(spark, sf):
    """Average precision at the reference's ten thresholds."""
    return detection.evaluate(*detections(spark, sf)).withColumn("ap", r9("ap"))


@query(f"""WITH aps AS ({_SQL["average_precision_50_95"]})
SELECT round(avg(ap) FILTER (threshold = 0.5::DOUBLE), 8) AS map50, round(avg(ap), 8) AS map50_95 FROM aps""")
def mean_average_precision(spark, sf):
    d = detection.map_over(average_precision_50_95(spark, sf))
    return d.select(*(F.round(c, 8).alias(c) for c in ("map50", "map50_95")))


@query(f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {RANKED}, z AS (SELECT count(*) images FROM (SELECT image_id FROM p UNION SELECT image_id FROM r)),
g AS (SELECT class_id, threshold, truths, count(*) FILTER (correct) tp, count(*) FILTER (NOT correct) fp FROM a JOIN n USING (class_id) GROUP BY ALL)
SELECT class_id, threshold, tp, fp, truths - tp AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / truths, 9) AS recall, round(2 * tp / (tp + fp + truths), 9) AS f1, round(fp / images, 9) AS fp_per_image FROM g, z""")
def class_scores(spark, sf):
    """False positives are divided by the images that have a prediction or a region."""
    rows, truths = ranked_detections(spark, sf)
    p, r = detections(spark, sf)
    d = detection.class_scores(rows, truths, p.select("image_id").unionByName(r.select("image_id")), ["class_id", "threshold"])
    return d.select("class_id", "threshold", "tp", "fp", "fn", *(r9(c).alias(c) for c in ("precision", "recall", "f1", "fp_per_image")))


@query(f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {RANKED},
g AS (SELECT threshold, least(floor(confidence * 10), 9)::INT bin, count(*) m, avg(confidence) c, avg(correct::INT) y FROM a GROUP BY ALL),
d AS (SELECT threshold, x::INT bin FROM t, range(0, 10) y(x))
SELECT d.threshold, d.bin, coalesce(m, 0) AS n, round(c, 9) AS mean_confidence, round(y, 9) AS accuracy, round(coalesce(m / sum(m) OVER (PARTITION BY d.threshold) * abs(c - y), 0), 9) AS ece_part
FROM d LEFT JOIN g ON g.threshold = d.threshold AND g.bin = d.bin""")
def reliability(spark, sf):
    rows, _ = ranked_detections(spark, sf)
    d = detection.reliability(rows, ["threshold"])
    return d.select("threshold", "bin", "n", *(r9(c).alias(c) for c in ("mean_confidence", "accuracy", "ece_part")))


@query(f"""WITH {DETECTIONS},
x AS (SELECT r.id rid, r.class_id rc, p.class_id pc, greatest(least(p.x2, r.x2) - greatest(p.x1, r.x1), 0.0) * greatest(least(p.y2, r.y2) - greatest(p.y1, r.y1), 0.0) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (r.x2 - r.x1) * (r.y2 - r.y1) AS ar FROM r JOIN p USING (image_id) WHERE p.confidence >= 0.25)
SELECT r.id AS region_id, r.class_id, coalesce(max(CASE WHEN rc = pc THEN i / (ap + ar - i) END), 0) AS same_class, coalesce(max(CASE WHEN rc <> pc THEN i / (ap + ar - i) END), 0) AS other_class FROM r LEFT JOIN x ON x.rid = r.id GROUP BY ALL""")
def best_overlaps(spark, sf):
    return detection.best_overlaps(*detections(spark, sf), 0.25)


@query(f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {matches_sql("_", "confidence >= 0.5")},
g AS (SELECT r.class_id, CASE WHEN (r.x2 - r.x1) * (r.y2 - r.y1) < 60 THEN 'small' ELSE 'large' END AS size, m_.rid IS NOT NULL matched, m.rid IS NOT NULL at_floor
  FROM r LEFT JOIN m ON m.rid = r.id AND m.threshold = 0.5 LEFT JOIN m_ ON m_.rid = r.id AND m_.threshold = 0.5),
s AS (SELECT class_id, size, count(*) instances, count(*) FILTER (matched) tp, count(*) FILTER (at_floor) fl FROM g GROUP BY ALL)
SELECT class_id, size, instances, tp, instances - tp AS fn, round(tp / instances, 9) AS recall, round((instances - tp) / instances, 9) AS fn_rate, fl AS tp_at_floor, round((instances - tp) / sum(instances - tp) OVER (), 9) AS share_of_all_fn FROM s""")
def stratified_recall(spark, sf):
    """Matches of predictions of confidence 0.5 and more, beside those of all predictions."""
    p, r = detections(spark, sf)
    hit = lambda q, name: detection.greedy_match(q, r, [0.5]).select(F.col("region_id").alias("id"), F.lit(True).alias(name))
    size = F.when((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < 60, "small").otherwise("large")
    rows = r.join(hit(p.where("confidence >= 0.5"), "matched"), "id", "left").join(hit(p, "matched_at_floor"), "id", "left").fillna(False, ["matched", "matched_at_floor"]).withColumn("size", size)
    d = stats.stratified_recall(rows, ["class_id", "size"])
    return d.select("class_id", "size", "instances", "tp", "fn", *(r9(c).alias(c) for c in ("recall", "fn_rate")), "tp_at_floor", r9("share_of_all_fn").alias("share_of_all_fn"))


# One-to-one matches across classes: pairs by falling overlap, then region, then prediction; each is taken if both its ends are free.
_ANY = DETECTIONS.replace("FROM p JOIN r USING (image_id, class_id))", "FROM p JOIN r USING (image_id))")
_FREE = "NOT list_contains(w.ps, x.pid) AND NOT list_contains(w.rs, x.rid)"
CONFUSION = f"""{_ANY},
x AS (SELECT image_id, pid, rid, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, rid, pid) k FROM u WHERE iou >= 0.5),
w(image_id, k, ps, rs) AS (
  SELECT image_id, k, [pid], [rid] FROM x WHERE k = 1
  UNION ALL
  SELECT x.image_id, x.k, CASE WHEN {_FREE} THEN list_append(w.ps, x.pid) ELSE w.ps END, CASE WHEN {_FREE} THEN list_append(w.rs, x.rid) ELSE w.rs END FROM w JOIN x ON x.image_id = w.image_id AND x.k = w.k + 1),
f AS (SELECT unnest(ps) pid, unnest(rs) rid FROM (SELECT * FROM w QUALIFY k = max(k) OVER (PARTITION BY image_id))),
q AS (SELECT p.class_id::VARCHAR AS predicted, f.rid FROM p LEFT JOIN f ON f.pid = p.id),
cm AS (SELECT coalesce(r.class_id::VARCHAR, 'background') AS truth, coalesce(q.predicted, 'background') AS predicted, count(*) AS n FROM q FULL JOIN r ON r.id = q.rid GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CONFUSION} SELECT truth, predicted, n FROM cm")
def confusion_matrix(spark, sf):
    return detection.confusion(*detections(spark, sf))


@query(f"""WITH RECURSIVE {CONFUSION}, c AS (SELECT truth AS class_name FROM cm UNION SELECT predicted FROM cm),
s AS (SELECT class_name, coalesce(sum(n) FILTER (truth = class_name), 0)::BIGINT AS truths, coalesce(sum(n) FILTER (truth = class_name AND predicted = class_name), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (truth = class_name AND predicted = 'background'), 0)::BIGINT AS missed,
  coalesce(sum(n) FILTER (truth = class_name AND predicted NOT IN (class_name, 'background')), 0)::BIGINT AS confused, coalesce(sum(n) FILTER (predicted = class_name AND truth = 'background'), 0)::BIGINT AS false_alarms FROM c, cm WHERE class_name <> 'background' GROUP BY class_name)
SELECT *, round(missed / truths, 9) AS missed_share FROM s""")
def confusion_summary(spark, sf):
    """Per class: truths, those found, missed and confused, false alarms."""
    return detection.confusion_summary(detection.confusion(*detections(spark, sf))).withColumn("missed_share", r9("missed_share"))


@query(f"""WITH RECURSIVE {CONFUSION}, s AS (SELECT truth, sum(n) t FROM cm GROUP BY truth)
SELECT truth, predicted, n, round(n / t, 9) AS share FROM cm JOIN s USING (truth) WHERE truth <> predicted AND truth <> 'background' AND predicted <> 'background' ORDER BY n DESC, truth, predicted LIMIT 10""")
def top_confusions(spark, sf):
    return detection.top_confusions(detection.confusion(*detections(spark, sf))).withColumn("share", r9("share"))


@query(f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {RANKED},
d AS (SELECT threshold, class_id, x::INT AS point FROM t, (SELECT DISTINCT class_id FROM n), range(0, 1001) y(x)),
b AS (SELECT threshold, class_id, floor(confidence * 1000)::INT AS point, count(*) c, count(*) FILTER (correct) h FROM a GROUP BY ALL),
s AS (SELECT d.*, sum(coalesce(c, 0)) OVER w AS seen, sum(coalesce(h, 0)) OVER w AS tp FROM d LEFT JOIN b ON b.threshold = d.threshold AND b.class_id = d.class_id AND b.point = d.point WINDOW w AS (PARTITION BY d.threshold, d.class_id ORDER BY d.point DESC))
SELECT s.class_id, s.threshold, s.point, s.point / 1000 AS confidence, round(CASE WHEN seen > 0 THEN tp / seen ELSE 1 END, 9) AS precision, round(coalesce(tp / truths, 0), 9) AS recall FROM s JOIN n USING (class_id)""")
def confidence_curves(spark, sf):
    d = detection.curve_at_confidence(*ranked_detections(spark, sf), ["class_id", "threshold"])
    return d.select("class_id", "threshold", "point", "confidence", r9("precision").alias("precision"), r9("recall").alias("recall"))


CURVES = f"""WITH RECURSIVE {DETECTIONS}, {MATCHES}, {RANKED},
s AS (SELECT threshold, class_id, confidence, row_number() OVER z AS k, sum(correct::INT) OVER z AS tp FROM a WINDOW z AS (PARTITION BY threshold, class_id ORDER BY confidence DESC, image_id, id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT threshold, class_id, truths, x AS point, x / 999 AS gx FROM t, n, range(0, 1000) y(x)),
e AS (SELECT d.*, lo.k AS k0, lo.confidence AS c0, lo.tp AS t0, hi.k AS k1, hi.confidence AS c1, hi.tp AS t1 FROM d
  LEFT JOIN (SELECT threshold, class_id, confidence, max(k) AS k, max(tp) AS tp FROM s GROUP BY ALL) lo ON lo.threshold = d.threshold AND lo.class_id = d.class_id AND lo.confidence = (SELECT min(confidence) FROM s WHERE s.threshold = d.threshold AND s.class_id = d.class_id AND s.confidence >= d.gx)
  LEFT JOIN s hi ON hi.threshold = d.threshold AND hi.class_id = d.class_id AND hi.k = coalesce(lo.k, 0) + 1)
SELECT class_id, threshold, point::INT AS point, round(gx, 12) AS confidence,
  round(CASE WHEN k0 IS NULL THEN 1 WHEN k1 IS NULL THEN t0 / k0 ELSE t0 / k0 + (t1 / k1 - t0 / k0) * (c0 - gx) / (c0 - c1) END, 9) AS precision,
  round(CASE WHEN k0 IS NULL THEN 0 WHEN k1 IS NULL THEN t0 / truths ELSE t0 / truths + (t1 - t0) / truths * (c0 - gx) / (c0 - c1) END, 9) AS recall FROM e"""


@query(CURVES)
def interpolated_curves(spark, sf):
    """Precision and recall at 1,000 even confidences, linear between the neighbouring predictions."""
    d = detection.interpolated_curves(*ranked_detections(spark, sf), ["class_id", "threshold"])
    return d.select("class_id", "threshold", "point", F.round("confidence", 12).alias("confidence"), r9("precision").alias("precision"), r9("recall").alias("recall"))


@query(f"""WITH q AS ({CURVES}), w AS (SELECT unnest([0.05, 0.25, 0.5]::DOUBLE[]) wanted)
SELECT class_id, threshold, wanted, point, confidence, precision, recall FROM q, w QUALIFY row_number() OVER (PARTITION BY class_id, threshold, wanted ORDER BY abs(point / 999 - wanted), point) = 1""")
def curve_points(spark, sf):
    """The grid points nearest to three confidences."""
    d = detection.nearest_points(detection.interpolated_curves(*ranked_detections(spark, sf), ["class_id", "threshold"]), ["class_id", "threshold"], [0.05, 0.25, 0.5])
    return d.select("class_id", "threshold", "wanted", "point", F.round("confidence", 12).alias("confidence"), r9("precision").alias("precision"), r9("recall").alias("recall"))


# Trajectories.
POSES = """{0} AS (SELECT r, t, arg_min(struct_pack(sample_id, x := x_m, y := y_m, z := z_m), sample_id) p FROM (
  SELECT lower(trim(run_id)) r, timestamp_ns t, * FROM {1} WHERE run_id IS NOT NULL AND timestamp_ns <> 0 AND isfinite(x_m + y_m + z_m) AND isfinite(qx * qx + qy * qy + qz * qz + qw * qw) AND qx * qx + qy * qy + qz * qz + qw * qw > 0) GROUP BY r, t)"""
ALIGNED = f"""{POSES.format("e", "trajectory_est")}, {POSES.format("g", "trajectory_gt")},
lo AS (SELECT e.r, e.t, e.p, g.t t0, g.p p0 FROM e ASOF JOIN g ON e.r = g.r AND e.t >= g.t),
hi AS (SELECT lo.*, g.t t1, g.p p1 FROM lo ASOF JOIN g ON lo.r = g.r AND lo.t <= g.t),
al AS (SELECT r, t, p.sample_id sid, t0 = t AS exact, CASE WHEN t0 = t THEN 0.0 ELSE (t - t0) / (t1 - t0) END f, p0, p1 FROM hi WHERE t0 = t OR t1 - t0 <= 50000000)"""


def aligned(spark, sf) -> tuple[DataFrame, DataFrame]:
    e, g = (trajectory.poses(table(spark, sf, f"trajectory_{k}")) for k in ("est", "gt"))
    return e, trajectory.associate(e, g)


@query(f"WITH {ALIGNED} SELECT r AS run, t, sid AS sample_id, exact, round(p0.x + (p1.x - p0.x) * f, 9) AS gt_x, round(p0.y + (p1.y - p0.y) * f, 9) AS gt_y, round(p0.z + (p1.z - p0.z) * f, 9) AS gt_z FROM al")
def trajectory_association(spark, sf):
    _, a = aligned(spark, sf)
    return a.select("run", "t", "sample_id", "exact", *(r9(f"gt_{c}_m").alias(f"gt_{c}") for c in "xyz"))


@query(f"""WITH {ALIGNED}, n AS (SELECT r, count(*) c FROM e GROUP BY r), m AS (SELECT r, count(*) c, (max(t) - min(t)) / 1e9 s FROM al GROUP BY r)
SELECT n.r AS run, n.c AS samples, coalesce(m.c, 0) AS matched, round(coalesce(m.c, 0) / n.c, 9) AS coverage, round(coalesce(s, 0), 9) AS seconds FROM n LEFT JOIN m ON m.r = n.r""")
def trajectory_coverage(spark, sf):
    d = trajectory.coverage(*aligned(spark, sf))
    return d.select("run", "samples", "matched", r9("coverage").alias("coverage"), r9("seconds").alias("seconds"))


@query(f"""WITH {POSES.format("e", "trajectory_est")}, f AS (SELECT r, min(t) t0 FROM e GROUP BY r)
SELECT r AS run, count(*) AS samples FROM e JOIN f USING (r) WHERE t - t0 BETWEEN 3000000000 AND 18000000000 GROUP BY r""")
def trajectory_window(spark, sf):
    e = trajectory.poses(table(spark, sf, "trajectory_est"))
    return trajectory.window(e, 3, 18).groupBy("run").agg(F.count("*").alias("samples"))


@query()
def absolute_trajectory_error(spark, sf):
    """Per run, after the rigid fit."""
    a = cut(aligned(spark, sf)[1].select("run", "t", "sample_id", *trajectory.XYZ, *(f"gt_{c}" for c in trajectory.XYZ)))
    return trajectory.error_summary(trajectory.absolute_errors(a, trajectory.rigid_fit(a)), ["run"])


def _times(a: list[str], b: list[str]) -> list[str]:
    """The product of two quaternions (x, y, z, w) as SQL."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [f"({aw} * {bx} + {ax} * {bw} + {ay} * {bz} - {az} * {by})", f"({aw} * {by} - {ax} * {bz} + {ay} * {bw} + {az} * {bx})", f"({aw} * {bz} + {ax} * {by} - {ay} * {bx} + {az} * {bw})", f"({aw} * {bw} - {ax} * {bx} - {ay} * {by} - {az} * {bz})"]


def _back(q: list[str]) -> list[str]:
    return [f"(-{c})" for c in q[:3]] + [q[3]]


_FULL = ALIGNED.replace("z := z_m)", "z := z_m, qx := qx / sqrt(qx * qx + qy * qy + qz * qz + qw * qw), qy := qy / sqrt(qx * qx + qy * qy + qz * qz + qw * qw), qz := qz / sqrt(qx * qx + qy * qy + qz * qz + qw * qw), qw := qw / sqrt(qx * qx + qy * qy + qz * qz + qw * qw))").replace(" f, p0, p1 FROM hi", " f, p0, p1, p FROM hi")
_Q = ("qx", "qy", "qz", "qw")
_MOTION = lambda p: (
    _times(_times(_back([f"a.{p}{c}" for c in _Q]), [f"(b.{p}{c} - a.{p}{c})" for c in "xyz"] + ["0.0"]), [f"a.{p}{c}" for c in _Q])[:3],
    _times(_back([f"a.{p}{c}" for c in _Q]), [f"b.{p}{c}" for c in _Q]),
)
_TURN = _times(_back([f"g{c}" for c in _Q]), [f"e{c}" for c in _Q])


@query(f"""WITH {_FULL},
d AS (SELECT *, {" + ".join(f"p0.{c} * p1.{c}" for c in _Q)} AS d FROM al), h AS (SELECT *, least(abs(d), 1.0) AS c, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sg, acos(least(abs(d), 1.0)) AS th FROM d),
v AS (SELECT *, CASE WHEN c > 0.9995 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS wa, sg * CASE WHEN c > 0.9995 THEN f ELSE sin(f * th) / sin(th) END AS wb FROM h),
i AS (SELECT *, {", ".join(f"wa * p0.{c} + wb * p1.{c} AS r{c}" for c in _Q)} FROM v),
n AS (SELECT r, t, {", ".join(f"p.{c} AS e{c}" for c in ("x", "y", "z", *_Q))}, {", ".join(f"p0.{c} + (p1.{c} - p0.{c}) * f AS g{c}" for c in "xyz")},
  {", ".join(f"CASE WHEN exact THEN p0.{c} ELSE r{c} / sqrt({' + '.join(f'r{x} * r{x}' for x in _Q)}) END AS g{c}" for c in _Q)} FROM i),
c AS (SELECT a.r, a.t, arg_min(b.t, (abs(b.t - a.t - 1000000000), b.t)) AS t1 FROM n a JOIN n b ON a.r = b.r AND b.t > a.t AND b.t BETWEEN a.t + 950000000 AND a.t + 1050000000 GROUP BY a.r, a.t),
m AS (SELECT c.r, {", ".join(f"{x} AS e{n}" for n, x in zip("xyz", _MOTION("e")[0]))}, {", ".join(f"{x} AS g{n}" for n, x in zip("xyz", _MOTION("g")[0]))}, {", ".join(f"{x} AS e{n}" for n, x in zip(_Q, _MOTION("e")[1]))}, {", ".join(f"{x} AS g{n}" for n, x in zip(_Q, _MOTION("g")[1]))}
  FROM c JOIN n a ON a.r = c.r AND a.t = c.t JOIN n b ON b.r = c.r AND b.t = c.t1),
z AS (SELECT r, (ex - gx) ** 2 + (ey - gy) ** 2 + (ez - gz) ** 2 AS tt, degrees(2 * atan2(sqrt({" + ".join(f"{x} ** 2" for x in _TURN[:3])}), abs({_TURN[3]}))) AS a FROM m)
SELECT r AS run, count(*) AS pairs, round(sqrt(avg(tt)), 7) AS rmse_translation, round(sqrt(avg(a * a)), 5) AS rmse_rotation FROM z GROUP BY r""")
def relative_pose_error(spark, sf):
    _, a = aligned(spark, sf)
    d = trajectory.relative_errors(a)
    return d.groupBy("run").agg(F.count("*").alias("pairs"), F.round(F.sqrt(F.avg(F.col("translation") ** 2)), 7).alias("rmse_translation"), F.round(F.sqrt(F.avg(F.col("rotation") ** 2)), 5).alias("rmse_rotation"))


@query(f"""WITH {ALIGNED}, c AS (SELECT a.r, a.t, b.t AS e, abs(b.t - a.t - 1000000000) AS gap FROM al a JOIN al b ON a.r = b.r AND b.t > a.t AND b.t BETWEEN a.t + 950000000 AND a.t + 1050000000)
SELECT r AS run, t, arg_min(e, (gap, e)) AS end_t FROM c GROUP BY r, t""")
def motion_pairs(spark, sf):
    """Each sample with the later one nearest to a second on, within 50 ms."""
    _, a = aligned(spark, sf)
    return trajectory.relative_errors(a).select("run", "t", "end_t")


@query()
def trajectory_metrics(spark, sf):
    """The six named measures of each run, one to a row."""
    e, a = aligned(spark, sf)
    a = cut(a)
    absolute = trajectory.error_summary(trajectory.absolute_errors(a, trajectory.rigid_fit(a)), ["run"])
    d = trajectory.relative_errors(a)
    relative = d.groupBy("run").agg(F.sqrt(F.avg(F.col("translation") ** 2)).alias("rmse_translation"), F.sqrt(F.avg(F.col("rotation") ** 2)).alias("rmse_rotation"))
    return trajectory.metric_rows(trajectory.coverage(e, a), absolute, relative)


@query(f"""WITH s AS (SELECT sample_id, run_id, timestamp_ns t, x_m, y_m, z_m, qx * qx + qy * qy + qz * qz + qw * qw AS q, lag(timestamp_ns) OVER w AS before, min(coalesce(frame_id, '')) OVER (PARTITION BY run_id) AS f0, max(coalesce(frame_id, '')) OVER (PARTITION BY run_id) AS f1
  FROM trajectory_est WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns NULLS FIRST, sample_id)),
c AS (SELECT unnest([CASE WHEN NOT coalesce(t > 0, false) THEN 'stamp' END, CASE WHEN NOT coalesce(isfinite(x_m) AND isfinite(y_m) AND isfinite(z_m), false) THEN 'position' END,
  CASE WHEN NOT coalesce(isfinite(q) AND q > 1e-24, false) THEN 'quaternion' END, CASE WHEN NOT coalesce(t > before, true) THEN 'increasing' END, CASE WHEN f0 <> f1 THEN 'one_frame' END]) AS code FROM s)
SELECT code, count(*) AS samples FROM c WHERE code IS NOT NULL GROUP BY code""")
def trajectory_issues(spark, sf):
    """Samples that break each rule of a trajectory."""
    coded = validate.with_codes(table(spark, sf, "trajectory_est"), validate.trajectory_rules(["run_id"]))
    return coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("samples"))


@query("""
WITH e AS (SELECT lower(trim(run_id)) AS r, timestamp_ns t, min(sample_id) id FROM trajectory_gt WHERE run_id IS NOT NULL AND timestamp_ns > 0 GROUP BY ALL)
SELECT r AS run, t // 100000000 AS tick, arg_min(id, t) AS sample_id FROM e GROUP BY ALL""")
def trajectory_samples(spark, sf):
    """Ground truth at a fixed period of 100 ms: the first sample of each, missed periods left out."""
    g = table(spark, sf, "trajectory_gt").where("run_id is not null and timestamp_ns > 0").groupBy(plain(F.col("run_id")).alias("run"), F.col("timestamp_ns").alias("t")).agg(F.min("sample_id").alias("sample_id"))
    return fusion_stream.sampled(g, "run", "t", 100_000_000).select("run", F.expr("t div 100000000").alias("tick"), "sample_id")


# Graph and splits.
@query("""
WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(split_a)) || ':' || lower(trim(image_a)) a, lower(trim(split_b)) || ':' || lower(trim(image_b)) b FROM leakage_review WHERE human_outcome = 'CONFIRMED_EXACT_CROSS_SPLIT_LEAKAGE'),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
w(id, l) AS (SELECT a, a FROM u UNION SELECT u.b, w.l FROM w JOIN u ON u.a = w.id WHERE w.l < u.b)
SELECT id, min(l) AS group_id FROM w GROUP BY id""")
def linked_groups(spark, sf):
    r = table(spark, sf, "leakage_review").where("human_outcome = 'CONFIRMED_EXACT_CROSS_SPLIT_LEAKAGE'")
    name = lambda s: F.concat(plain(F.col(f"split_{s}")), F.lit(":"), plain(F.col(f"image_{s}"))).alias(s)
    return graph.linked_groups(r.select(name("a"), name("b")), "a", "b")


_VERDICT = """CASE WHEN count(c) = 0 THEN 'NO_LABELS' WHEN count(c) = 1 AND count(*) > 1 THEN 'ONLY_ONE_LABELED_COPY' WHEN count(DISTINCT c) = 1 THEN 'IDENTICAL_ANNOTATIONS'
  WHEN count(DISTINCT list_sort(string_split(replace(trim(c, '[]'), ' ', ''), ','))::VARCHAR) = 1 THEN 'REORDERED_EQUIVALENT_ANNOTATIONS' ELSE 'CONFLICTING_ANNOTATIONS' END"""
GYU = """g AS (SELECT record_id id, raw_split s, image_relative_path p, coalesce(annotation_count >= 0, false) el, nullif(upper(trim(duplicate_group_id)), '') d, nullif(lower(trim(leakage_group_id)), '') l,
  CASE WHEN class_ids LIKE '[%' THEN class_ids END c, CASE raw_split WHEN 'test' THEN 0 WHEN 'valid' THEN 1 WHEN 'train' THEN 2 END o FROM gyu_det_v3_baseline_v1)"""


@query(f"""
WITH RECURSIVE {GYU}, v AS (SELECT d, {_VERDICT} AS verdict FROM g WHERE d IS NOT NULL GROUP BY d),
k AS (SELECT g.*, verdict, row_number() OVER (PARTITION BY g.d, el AND o IS NOT NULL ORDER BY o, lower(p), p, id) k FROM g LEFT JOIN v ON v.d = g.d),
r AS (SELECT *, CASE WHEN NOT (el AND o IS NOT NULL) THEN NULL WHEN verdict = 'CONFLICTING_ANNOTATIONS' THEN 'ANNOTATION_CONFLICT_HUMAN_REVIEW_REQUIRED' WHEN d IS NOT NULL AND k > 1 THEN 'EQUIVALENT_EXACT_DUPLICATE_REDUNDANT' END AS reason FROM k),
e AS (SELECT min(id) OVER (PARTITION BY d) a, id b FROM g WHERE d IS NOT NULL UNION SELECT min(id) OVER (PARTITION BY l), id FROM g WHERE l IS NOT NULL),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
w(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.id WHERE w.c < u.b),
m AS (SELECT id, min(c) AS component FROM w GROUP BY id),
q AS (SELECT r.*, m.component, el AND o IS NOT NULL AND reason IS NULL AS kept FROM r LEFT JOIN m ON m.id = r.id),
t AS (SELECT *, kept AND component IS NOT NULL AND min(o) FILTER (kept) OVER (PARTITION BY component) <> o AS moved FROM q)
SELECT id AS record_id, coalesce(component::VARCHAR, '') AS component, kept AND NOT moved AS included, CASE WHEN kept AND NOT moved THEN s END AS proposed_split, CASE WHEN moved THEN 'APPROVED_LEAKAGE_GROUP_OTHER_SPLIT_RETAINED' ELSE reason END AS reason FROM t""")
def split_proposal(spark, sf):
    """Copies by duplicate group, links by leakage group; records with a known annotation count are eligible."""
    g = table(spark, sf, "gyu_det_v3_baseline_v1")
    named = lambda c, f: F.nullif(f(F.trim(c)), F.lit(""))
    rows = g.select(F.col("record_id").alias("record"), F.col("raw_split").alias("split"), F.col("image_relative_path").alias("path"), F.coalesce(F.col("annotation_count") >= 0, F.lit(False)).alias("eligible"), named("duplicate_group_id", F.upper).alias("duplicate"), F.when(F.startswith("class_ids", F.lit("[")), F.from_json("class_ids", "array<int>")).alias("ids"))
    leaks = g.select("record_id", named("leakage_group_id", F.lower).alias("l")).where("l is not null")
    links = leaks.join(leaks.groupBy("l").agg(F.min("record_id").alias("a")), "l").select("a", F.col("record_id").alias("b"))
    d = graph.propose_split(rows, links, F.col("ids"))
    return d.select(F.col("record").alias("record_id"), F.coalesce(F.col("component").cast("string"), F.lit("")).alias("component"), "included", "proposed_split", "reason")


@query(f"WITH {GYU} SELECT d AS group_id, count(*) AS members, {_VERDICT} AS verdict FROM g WHERE d IS NOT NULL GROUP BY d")
def annotation_consistency(spark, sf):
    g = table(spark, sf, "gyu_det_v3_baseline_v1").where("trim(duplicate_group_id) <> ''").select(F.upper(F.trim("duplicate_group_id")).alias("group_id"), F.when(F.startswith("class_ids", F.lit("[")), F.from_json("class_ids", "array<int>")).alias("c"))
    return graph.annotation_consistency(g, "group_id", F.col("c"))


# Stored records.
@query("SELECT DISTINCT defect_id, inspection_id, class_name, confidence FROM defects WHERE class_name = 'Seepage' AND confidence >= 0.6 AND review_status = 'CONFIRMED' ORDER BY defect_id")
def filter_defects(spark, sf):
    d = store.find_defects(table(spark, sf, "defects"), class_name="Seepage", review_status="CONFIRMED", min_confidence=0.6)
    return d.select("defect_id", "inspection_id", "class_name", "confidence").distinct().orderBy("defect_id")


@query("SELECT inspection_id, started_at FROM inspections ORDER BY started_at DESC, inspection_id DESC")
def recent_inspections(spark, sf):
    return store.recent_inspections(table(spark, sf, "inspections")).select("inspection_id", "started_at")


@query("""
WITH d AS (SELECT defect_id, any_value(inspection_id) inspection_id, any_value(review_status) s, any_value(confidence) c, any_value(model_version) v FROM defects GROUP BY defect_id),
n AS (SELECT inspection_id, count(*) defects, count(*) FILTER (s = 'UNREVIEWED') unreviewed, count(*) FILTER (s = 'CONFIRMED') confirmed, count(*) FILTER (s = 'REJECTED') rejected, count(*) FILTER (s = 'NEEDS_INVESTIGATION') needs_investigation, max(c) mc, array_to_string(list_sort(list(DISTINCT v)), ', ') vs FROM d GROUP BY inspection_id)
SELECT i.inspection_id, trim(s.name) AS structure, i.status, coalesce(defects, 0) AS defects, coalesce(unreviewed, 0) AS unreviewed, coalesce(confirmed, 0) AS confirmed, coalesce(rejected, 0) AS rejected, coalesce(needs_investigation, 0) AS needs_investigation, mc AS max_confidence, coalesce(vs, 'Unavailable') AS model_versions
FROM inspections i JOIN structures s USING (structure_id) LEFT JOIN n ON n.inspection_id = i.inspection_id""")
def inspection_report(spark, sf):
    return store.inspection_report(*(table(spark, sf, t) for t in ("structures", "inspections", "defects")))


@query("SELECT DISTINCT d.defect_id FROM defects d WHERE NOT EXISTS (SELECT 1 FROM inspections i WHERE i.inspection_id = d.inspection_id)")
def orphan_defects(spark, sf):
    return validate.orphans(table(spark, sf, "defects"), table(spark, sf, "inspections"), "inspection_id").select("defect_id").distinct()


@query("""
SELECT defect_id, array_to_string(list_filter([CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN NOT coalesce(isfinite(x_m) AND isfinite(y_m) AND isfinite(z_m), false) THEN 'position' END, CASE WHEN coalesce(coordinate_frame <> 'map', true) THEN 'frame' END,
  CASE WHEN observation_count < 1 THEN 'observation_count' END, CASE WHEN first_seen > last_seen THEN 'seen_order' END, CASE WHEN created_at > updated_at THEN 'audit_order' END], lambda x: x IS NOT NULL), ',') AS codes
FROM defects WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false) OR NOT coalesce(isfinite(x_m) AND isfinite(y_m) AND isfinite(z_m), false) OR coalesce(coordinate_frame <> 'map', true) OR observation_count < 1 OR first_seen > last_seen OR created_at > updated_at""")
def rejected_defects(spark, sf):
    _, bad = validate.split_valid(table(spark, sf, "defects"), validate.defect_rules())
    return bad.select("defect_id", F.array_join("codes", ",").alias("codes"))


@query("""
WITH d AS (SELECT DISTINCT defect_id, inspection_id, class_name, track_id, confidence, x_m, observation_count, first_seen FROM defects WHERE track_id IS NOT NULL),
t AS (SELECT inspection_id, track_id, count(*) n FROM d GROUP BY ALL),
m AS (SELECT inspection_id, track_id FROM t QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY n DESC, track_id) = 1)
SELECT d.inspection_id, any_value(m.track_id) AS track_id, count(*) AS observation_count, round(avg(confidence), 9) AS confidence, min(first_seen) AS first_seen FROM d JOIN m USING (inspection_id) GROUP BY d.inspection_id""")
def defect_aggregate(spark, sf):
    d = table(spark, sf, "defects").where("track_id is not null").select(F.col("inspection_id").cast("string").alias("defect_id"), "inspection_id", F.lit(0).alias("class_id"), F.col("defect_id").alias("o"), "track_id", "confidence", "observation_count", F.lit(0.0).alias("x_m"), F.lit(0.0).alias("y_m"), F.lit(0.0).alias("z_m"), F.col("first_seen").alias("ts")).dropDuplicates(["o"])
    return fusion.defect_table(d).select("inspection_id", "track_id", "observation_count", r9("confidence").alias("confidence"), "first_seen")


def observations(spark, sf) -> DataFrame:
    """Events as observations: eight inspections, whole centimetres."""
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    cm = lambda k: (F.pmod(F.col("event_id") * k, F.lit(400)) / 100).cast("double")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 8 + 1).alias("inspection_id"), F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("observation_id"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("class_id"), F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("track_id"),
        F.least(F.lit(1.0), F.coalesce(F.col("value"), F.lit(0.0)) / 500).alias("confidence"), cm(7919).alias("x_m"), cm(104729).alias("y_m"), cm(1299709).alias("z_m"), "ts",
    )


@query()
def fusion_decisions(spark, sf):
    return fusion.fuse(observations(spark, sf))[0].select("seq", "inspection_id", "observation_id", "decision", "defect_id")


RESULTS = f"({P7_RESULTS_SQL})"


@query(f"""WITH r AS (SELECT * FROM {RESULTS}), w AS (SELECT *, time - coalesce(lag(time) OVER (PARTITION BY file_name ORDER BY epoch, line_id), 0) AS pause, max(epoch) OVER (PARTITION BY file_name) AS last FROM r)
SELECT file_name, count(*) AS epochs, max(map50_95) AS best, arg_max(epoch, (map50_95, -epoch)) AS best_epoch, round(avg(train_box_loss) FILTER (epoch > last - 10), 9) AS late_box_loss, max(pause) AS longest_pause FROM w GROUP BY file_name""")
def learning_curve(spark, sf):
    """Per run file: epochs, best mAP50-95 and its epoch, mean box loss over the last ten epochs, longest pause between epochs."""
    r = quarantine.load_results(table(spark, sf, "raw_lines"))
    w = Window.partitionBy("file_name")
    lag = F.col("time") - F.coalesce(F.lag("time").over(w.orderBy("epoch", "line_id")), F.lit(0.0))
    rows = r.withColumn("pause", lag).withColumn("last", F.max("epoch").over(w))
    return rows.groupBy("file_name").agg(F.count("*").alias("epochs"), F.max("map50_95").alias("best"), F.max_by("epoch", F.struct("map50_95", -F.col("epoch"))).alias("best_epoch"), r9(F.avg(F.when(F.col("epoch") > F.col("last") - 10, F.col("train_box_loss")))).alias("late_box_loss"), F.max("pause").alias("longest_pause"))


#: Ranges of epochs that a curve is averaged over.
EPOCH_WINDOWS = ((1, 10), (11, 20), (21, 30), (31, 60), (61, 100))


@query(f"""WITH r AS (SELECT * FROM {RESULTS}), w AS (SELECT unnest({[a for a, _ in EPOCH_WINDOWS]}) lo, unnest({[b for _, b in EPOCH_WINDOWS]}) hi),
m AS (SELECT file_name, lo, hi, count(*) n, avg(map50_95) v, avg(val_box_loss) l FROM r, w WHERE epoch BETWEEN lo AND hi GROUP BY ALL)
SELECT file_name, lo::INT AS first_epoch, hi::INT AS last_epoch, n AS epochs, round(v, 9) AS map50_95, round(l, 9) AS val_box_loss, round(v - lag(v) OVER (PARTITION BY file_name ORDER BY lo), 9) AS gain FROM m""")
def epoch_windows(spark, sf):
    """Means over ranges of epochs, and the gain over the range before."""
    r = quarantine.load_results(table(spark, sf, "raw_lines"))
    ranges = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in EPOCH_WINDOWS))
    met = r.withColumn("w", F.explode(F.filter(ranges, lambda x: F.col("epoch").between(x["lo"], x["hi"])))).groupBy("file_name", F.col("w.lo").alias("first_epoch"), F.col("w.hi").alias("last_epoch"))
    m = met.agg(F.count("*").alias("epochs"), F.avg("map50_95").alias("v"), F.avg("val_box_loss").alias("l"))
    gain = F.col("v") - F.lag("v").over(Window.partitionBy("file_name").orderBy("first_epoch"))
    return m.select("file_name", "first_epoch", "last_epoch", "epochs", r9("v").alias("map50_95"), r9("l").alias("val_box_loss"), r9(gain).alias("gain"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

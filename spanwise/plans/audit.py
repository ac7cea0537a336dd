"""Further queries over whole tables: pairing audits, validators and guards, joins with assertions, camera projection, stored reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanwise.functions import scalars as X
from spanwise.functions.text import hex_text, unify_split
from spanwise.operators import camera, detection, fusion, inventory, stats, store, validate
from spanwise.plans import reference as R
from spanwise.session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The six classes.
CLASSES = {0: "Crack", 1: "Breakage", 2: "Comb", 3: "Hole", 4: "Reinforcement", 5: "Seepage"}
#: States of an inspection.
INSPECTION_STATES = ("PLANNED", "RUNNING", "PROCESSING", "REVIEW", "COMPLETED", "FAILED")


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def codes_sql(rules: dict[str, str]) -> str:
    """A list of the codes whose condition doesn't hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL)"


# Pairing audits.
@query(f"WITH {R.PAIRS} SELECT 'images' AS kind, s AS split, k AS key, image AS file, n AS duplicate_count FROM ni WHERE n > 1 UNION ALL SELECT 'labels', s, k, label, n FROM nl WHERE n > 1")
def duplicate_names(spark, sf):
    images, labels = R.pair_sides(spark, sf)
    own = lambda df, kind, c: inventory.duplicate_names(df, ["split", "key"]).select(F.lit(kind).alias("kind"), "split", "key", F.col(c).alias("file"), "duplicate_count")
    return own(images, "images", "image").unionByName(own(labels, "labels", "label"))


@query(f"""WITH {R.PAIRS}, um AS (SELECT DISTINCT i.s, i.k, i.name FROM i JOIN (SELECT DISTINCT s, k FROM pairs WHERE status = 'image_without_label') q USING (s, k)),
o AS (SELECT um.s, um.k, array_to_string(list_sort(list(DISTINCT l.s || '/' || l.name)), ',') AS e FROM um JOIN l ON l.k = um.k AND l.s <> um.s GROUP BY ALL),
x AS (SELECT DISTINCT {R._SPLIT.format("split")} s, replace(lower(trim(regexp_replace(trim(image_filename), '\\.[^.]*$', ''))), 'ß', 'ss') k FROM manifest WHERE pairing_status = 'image_without_label')
SELECT um.s AS split, um.k AS key, um.name, coalesce(o.e, '') AS elsewhere, CASE WHEN x.k IS NULL THEN 'unexplained_missing_label' ELSE 'expected_negative_external_evidence' END AS classification
FROM um LEFT JOIN o ON o.s = um.s AND o.k = um.k LEFT JOIN x ON x.s = um.s AND x.k = um.k""")
def unmatched_images(spark, sf):
    """Images without a label, the labels of that name in other splits, and whether the manifest expects none."""
    images, labels = R.pair_sides(spark, sf)
    free = inventory.pair_unique(images.drop("name"), labels.drop("name"), ["split", "key"]).where("status = 'image_without_label'").select("split", "key").distinct()
    names = images.join(free, ["split", "key"]).select("split", "key", "name").distinct()
    told = inventory.found_elsewhere(names, labels.select("split", "key", "name"))
    m = table(spark, sf, "manifest").where("pairing_status = 'image_without_label'")
    return inventory.classify_unmatched(told, m.select(unify_split(F.col("split")).alias("split"), X.pairing_key(F.col("image_filename")).alias("key")).where("split is not null and key is not null"))


@query(f"""WITH {R.PAIRS} SELECT s AS split, count(image) AS images, count(label) AS labels, count(*) FILTER (status = 'exact_pair') AS exact_pairs, count(*) FILTER (status = 'image_without_label') AS images_without_labels,
  count(*) FILTER (status = 'label_without_image') AS labels_without_images, count(image) FILTER (status = 'ambiguous') AS ambiguous_images, count(label) FILTER (status = 'ambiguous') AS ambiguous_labels FROM pairs GROUP BY s""")
def pairing_summary(spark, sf):
    images, labels = R.pair_sides(spark, sf)
    return inventory.pairing_summary(inventory.pair_unique(images.drop("name"), labels.drop("name"), ["split", "key"]))


_SPLIT3 = "['train', 'valid', 'test'][{0} % 3 + 1]"


@query(f"""
WITH l AS (SELECT structure_id left_id, lower(trim(name)) ln, {_SPLIT3.format("structure_id")} ls FROM structures),
p AS (SELECT p_partkey id, p_type, lower(p_name) || ' ' || p_size rn, {_SPLIT3.format("p_partkey")} rs, lower(p_name) || ' ' || p_size k FROM part),
m AS (SELECT DISTINCT rs, k FROM p WHERE p_type = 'ECONOMY'), f AS (SELECT rs, rn, min(id) right_id FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rs = p.rs AND m.k = p.k) GROUP BY ALL),
c AS (SELECT *, levenshtein(ln, rn)::BIGINT distance FROM l JOIN f ON ls = rs)
SELECT left_id, right_id, distance, round(similarity, 8) AS similarity, k::INT AS rank FROM (
  SELECT *, 1 - distance / greatest(length(ln), length(rn), 1) similarity, row_number() OVER (PARTITION BY left_id ORDER BY distance, 1 - distance / greatest(length(ln), length(rn), 1) DESC, rn, right_id) k FROM c) WHERE k <= 5""")
def unmatched_candidates(spark, sf):
    """Structure names against the part names of their split that no pairing occupies (the economy parts are paired), with known distances reused."""
    split = lambda c: F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), (F.col(c) % 3 + 1).cast("int"))
    left = table(spark, sf, "structures").select(F.col("structure_id").alias("left_id"), split("structure_id").alias("left_split"), F.lower(F.trim("name")).alias("left_name"))
    right = table(spark, sf, "part").select(F.col("p_partkey").alias("right_id"), split("p_partkey").alias("right_split"), F.concat_ws(" ", F.lower("p_name"), F.col("p_size").cast("string")).alias("right_name"), "p_type")
    matched = right.where("p_type = 'ECONOMY'").select(F.col("right_split").alias("split"), X.pairing_key(F.col("right_name")).alias("key"))
    known = inventory.fuzzy_candidates(left, right).where("scope = 'same_split'").join(right.select("right_id", "right_name"), "right_id").select("left_id", "right_split", "right_name", "distance")
    d = inventory.rerank_unmatched(left, right, matched, known)
    return d.select("left_id", "right_id", F.col("distance").cast("bigint").alias("distance"), F.round("similarity", 8).alias("similarity"), "rank")


@query(f"""WITH h AS (SELECT image_id, {R._SPLIT.format("split")} s, regexp_replace(lower(trim(perceptual_hash)), '^0x', '') h FROM manifest WHERE perceptual_hash IS NOT NULL),
u AS ({R._SQL["near_hashes"]}),
i AS (SELECT image_id, {R._SPLIT.format("split")} s, lower(trim(image_sha256)) sha, width, height, CASE WHEN regexp_full_match(regexp_replace(trim(image_filename), '\\.[^.]*$', ''), '[0-9]+') THEN regexp_replace(trim(image_filename), '\\.[^.]*$', '')::HUGEINT END n,
  nullif(trim(camera_make), '') mk, nullif(trim(camera_model), '') md, coalesce(nullif(trim(exif_datetime_original), ''), nullif(trim(exif_datetime), '')) tm FROM manifest WHERE {R._SPLIT.format("split")} IS NOT NULL),
r AS (SELECT unnest(['train', 'valid', 'test']) s, unnest([0, 1, 2]) o)
SELECT id_a, id_b, distance, CASE WHEN ra.o <= rb.o THEN a.s || '/' || b.s ELSE b.s || '/' || a.s END AS split_pair, coalesce(a.sha = b.sha, false) AS sha256_equal, coalesce(a.width = b.width AND a.height = b.height, false) AS dimensions_match,
  CASE WHEN distance = 0 THEN 'identical_perceptual_hash' WHEN distance <= 4 THEN 'very_strong_near_duplicate' WHEN distance <= 8 THEN 'probable_near_duplicate' ELSE 'weaker_candidate' END AS severity,
  coalesce(abs(a.n - b.n)::VARCHAR, '') AS numeric_gap, (a.mk IS NOT NULL OR a.md IS NOT NULL) AND a.mk IS NOT DISTINCT FROM b.mk AND a.md IS NOT DISTINCT FROM b.md AS same_camera, coalesce(a.tm = b.tm, false) AS same_capture_time
FROM u JOIN i a ON a.image_id = id_a JOIN i b ON b.image_id = id_b JOIN r ra ON ra.s = a.s JOIN r rb ON rb.s = b.s""")
def pair_features(spark, sf):
    """What the images of each near pair have in common."""
    m = table(spark, sf, "manifest")
    images = m.select(
        F.col("image_id").alias("id"), unify_split(F.col("split")).alias("split"), F.col("image_filename").alias("filename"), hex_text(F.col("image_sha256"), 64).alias("sha"), "width", "height",
        F.col("camera_make").alias("make"), F.col("camera_model").alias("model"), F.col("exif_datetime_original").alias("taken"), F.col("exif_datetime").alias("digitised"), F.lit(True).alias("telling"),
    ).where("split is not null")
    d = inventory.pair_features(inventory.hamming_neighbours(R.telling_hashes(spark, sf), 4, 5), images)
    return d.withColumn("numeric_gap", F.coalesce(F.col("numeric_gap").cast("string"), F.lit(""))).drop("low_information")


# Joins with assertions.
@query(f"""WITH m AS (SELECT image_id, count(*) n, any_value({R._SPLIT.format("split")}) s, any_value(width) w, any_value(height) h FROM manifest GROUP BY image_id),
g AS (SELECT image_id, count(*) n, min({R._SPLIT.format("raw_split")}) s, min(width) w, min(height) h FROM gyu_det_v3_baseline_v1 GROUP BY image_id),
j AS (SELECT image_id, m.n nm, g.n ng, m.s sm, g.s sg, m.w wm, g.w wg, m.h hm, g.h hg FROM m FULL JOIN g USING (image_id)),
c AS (SELECT nm, ng, unnest([CASE WHEN nm IS NULL THEN 'left_missing' END, CASE WHEN ng IS NULL THEN 'right_missing' END, CASE WHEN ng > 1 THEN 'right_repeats' END,
  CASE WHEN nm = 1 AND ng = 1 AND sm IS DISTINCT FROM sg THEN 'differs:split' END, CASE WHEN nm = 1 AND ng = 1 AND wm IS DISTINCT FROM wg THEN 'differs:width' END, CASE WHEN nm = 1 AND ng = 1 AND hm IS DISTINCT FROM hg THEN 'differs:height' END]) code FROM j)
SELECT code, count(*) AS images FROM c WHERE code IS NOT NULL GROUP BY code""")
def one_to_one_issues(spark, sf):
    """Manifest against records, one to one by image: what keeps them from it; fields are compared where both sides have one row."""
    m = table(spark, sf, "manifest").select("image_id", unify_split(F.col("split")).alias("split"), "width", "height")
    g = table(spark, sf, "gyu_det_v3_baseline_v1").select("image_id", unify_split(F.col("raw_split")).alias("split"), "width", "height")
    _, issues = inventory.join_once(m, g, ["image_id"], ["split", "width", "height"])
    single = g.groupBy("image_id").agg(F.count("*").alias("n")).where("n = 1").select("image_id")
    differs = issues.where("code like 'differs:%'").join(single, "image_id", "left_semi")
    return issues.where("code not like 'differs:%'").unionByName(differs).groupBy("code").agg(F.count("*").alias("images"))


@query("""WITH l AS (SELECT record_id position, image_relative_path path FROM gyu_det_v3_baseline_v1 WHERE trim(inclusion_reason) <> ''),
m AS (SELECT image_relative_path path, lower(trim(image_sha256)) sha FROM manifest WHERE image_relative_path IS NOT NULL), x AS (SELECT DISTINCT image_relative_path path FROM gyu_det_v3_baseline_v1 WHERE trim(exclusion_reason) <> ''),
h AS (SELECT path, count(*) n FROM m GROUP BY path), t AS (SELECT path, count(*) n FROM l GROUP BY path),
q AS (SELECT unnest([CASE WHEN h.n IS NULL THEN 'unknown' END, CASE WHEN h.n > 1 THEN 'several' END, CASE WHEN x.path IS NOT NULL THEN 'excluded' END, CASE WHEN t.n > 1 THEN 'listed_twice' END]) code FROM l LEFT JOIN h USING (path) LEFT JOIN x USING (path) JOIN t USING (path)
  UNION ALL SELECT 'repeats:sha' FROM l JOIN m USING (path) WHERE sha IN (SELECT sha FROM l JOIN m USING (path) WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT path) > 1))
SELECT code, count(*) AS entries FROM q WHERE code IS NOT NULL GROUP BY code""")
def list_issues(spark, sf):
    """The included records as an ordered list against the manifest: unknown, excluded and repeated entries and contents."""
    g = table(spark, sf, "gyu_det_v3_baseline_v1").select(F.col("record_id").alias("position"), F.col("image_relative_path").alias("path"), "inclusion_reason", "exclusion_reason")
    m = table(spark, sf, "manifest").select(F.col("image_relative_path").alias("path"), hex_text(F.col("image_sha256"), 64).alias("sha")).where("path is not null")
    _, issues = inventory.listed_rows(g.where("trim(inclusion_reason) <> ''").select("position", "path"), m, g.where("trim(exclusion_reason) <> ''").select("path"), ["sha"])
    return issues.groupBy("code").agg(F.count("*").alias("entries"))


@query(f"""WITH w AS (SELECT DISTINCT image_id FROM manifest), p AS (SELECT DISTINCT image_id, {R._SPLIT.format("processed_split")} s FROM gyu_det_v3_baseline_v1 WHERE {R._SPLIT.format("processed_split")} IS NOT NULL),
n AS (SELECT image_id, count(*) n FROM p GROUP BY image_id), j AS (SELECT CASE WHEN w.image_id IS NULL THEN 'foreign' WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'overlap' END code FROM w FULL JOIN n ON n.image_id = w.image_id)
SELECT code, count(*) AS images FROM j WHERE code IS NOT NULL GROUP BY code""")
def partition_issues(spark, sf):
    """Whether the processed splits part the manifest's images."""
    g = table(spark, sf, "gyu_det_v3_baseline_v1").select("image_id", unify_split(F.col("processed_split")).alias("s"))
    parts = [g.where(F.col("s") == s) for s in ("train", "valid", "test")]
    return inventory.partition_issues(table(spark, sf, "manifest"), parts, "image_id").groupBy("code").agg(F.count("*").alias("images"))


@query("""WITH c AS (SELECT unnest([CASE WHEN i.inspection_id IS NULL THEN 'missing' END, CASE WHEN i.inspection_id IS NOT NULL AND d.structure_id IS DISTINCT FROM i.structure_id THEN 'structure_id' END]) code
  FROM documents d LEFT JOIN inspections i USING (inspection_id) WHERE d.inspection_id IS NOT NULL)
SELECT code, count(*) AS documents FROM c WHERE code IS NOT NULL GROUP BY code""")
def document_consistency(spark, sf):
    """Documents whose inspection is missing or belongs to another structure."""
    d = table(spark, sf, "documents").where("inspection_id is not null").select("inspection_id", "structure_id")
    return validate.consistency_issues(d, table(spark, sf, "inspections"), "inspection_id", ["structure_id"]).groupBy("code").agg(F.count("*").alias("documents"))


@query(f"SELECT image_id, {R._SPLIT.format('split')} AS split FROM manifest WHERE {R._SPLIT.format('split')} IS NOT NULL ORDER BY list_position(['train', 'valid', 'test'], {R._SPLIT.format('split')}), lower(image_filename), image_filename, image_id")
def canonical_manifest(spark, sf):
    m = table(spark, sf, "manifest").select("image_id", unify_split(F.col("split")).alias("split"), "image_filename").where("split is not null")
    return inventory.canonical_order(m, "split", "image_filename").select("image_id", "split")


# Statistics.
@query(f"""WITH {R.BOXES}, i AS (SELECT DISTINCT regexp_extract(file_name, 'labels/([a-z]+)/', 1) AS split, file_name AS image FROM raw_lines WHERE feed = 'boxes'),
n AS (SELECT split, image, count(*) n, count(DISTINCT class_id) k FROM b GROUP BY ALL),
p AS (SELECT i.split, count(*) images, sum(coalesce(n.n, 0))::BIGINT annotations, avg(coalesce(n.n, 0)) mean, 100 * avg((coalesce(k, 0) > 1)::INT) multi FROM i LEFT JOIN n ON n.split = i.split AND n.image = i.image GROUP BY i.split),
s AS (SELECT split, median(width * height) AS area, {", ".join(f"100.0 * count(*) FILTER (class_id = {c}) / count(*) AS c{c}" for c in CLASSES)} FROM b GROUP BY split)
SELECT split, images, annotations, round(mean, 9) AS mean_annotations, round(multi, 9) AS multi_class_percent, {", ".join(f"round(coalesce(c{c}, 0), 9) AS class_{c}_percent" for c in CLASSES)}, round(area, 9) AS median_area FROM p LEFT JOIN s USING (split)""")
def split_comparison(spark, sf):
    """Splits side by side, files without a valid box included."""
    b = R.boxes(spark, sf).withColumn("area", F.col("width") * F.col("height"))
    files = table(spark, sf, "raw_lines").where("feed = 'boxes'").select(F.regexp_extract("file_name", "labels/([a-z]+)/", 1).alias("split"), F.col("file_name").alias("image"))
    d = stats.split_comparison(files, b, list(CLASSES))
    return d.select("split", "images", "annotations", *(R.r9(c).alias(c) for c in ("mean_annotations", "multi_class_percent", *(f"class_{c}_percent" for c in CLASSES), "median_area")))


@query(f"""WITH i AS (SELECT raw_split s, coalesce(m.pairing_status = 'exact_pair', false) p, CASE WHEN annotation_count >= 0 THEN annotation_count END n, CASE WHEN class_ids LIKE '[%' THEN len(list_distinct(from_json(class_ids, '["INTEGER"]'))) ELSE 0 END k
  FROM gyu_det_v3_baseline_v1 g LEFT JOIN manifest m USING (image_id)),
v AS (SELECT 'raw' AS view, s, p, n, k FROM i UNION ALL SELECT 'baseline', s, p, n, k FROM i WHERE p), a AS (SELECT view, s AS split, p, n, k FROM v UNION ALL SELECT view, 'all', p, n, k FROM v)
SELECT view, split, count(*) AS images, count(*) FILTER (p) AS exact_pairs, count(*) FILTER (NOT p) AS unlabelled, coalesce(sum(n) FILTER (p), 0)::BIGINT AS annotations, count(*) FILTER (p AND k = 1) AS one_class_images, count(*) FILTER (p AND k > 1) AS multi_class_images,
  round(avg(n) FILTER (p), 9) AS mean_annotations, median(n) FILTER (p) AS median_annotations FROM a GROUP BY ALL""")
def overview(spark, sf):
    """Both views of the records: all images, and exact pairs only."""
    g = table(spark, sf, "gyu_det_v3_baseline_v1").join(table(spark, sf, "manifest").select("image_id", "pairing_status"), "image_id", "left")
    ids = F.when(F.startswith("class_ids", F.lit("[")), F.size(F.array_distinct(F.from_json("class_ids", "array<int>"))))
    d = stats.overview(g, "raw_split", F.col("pairing_status") == "exact_pair", F.col("annotation_count"), ids)
    return d.withColumn("mean_annotations", R.r9("mean_annotations"))


_ROLLUP = {
    "images": "true", "exact_pairs": "pairing_status = 'exact_pair'", "images_without_label": "pairing_status = 'image_without_label'", "empty_files": "file_size_bytes = 0",
    "missing_hashes": "image_sha256 IS NULL", "missing_fingerprints": "perceptual_hash IS NULL", "missing_sizes": "width IS NULL OR height IS NULL", "small_images": "least(width, height) < 256",
    "large_images": "greatest(width, height) > 10000", "portrait_images": "height > width", "landscape_images": "width > height", "square_images": "width = height",
    "with_camera": "trim(camera_make) <> '' OR trim(camera_model) <> ''", "with_capture_time": "trim(exif_datetime_original) <> '' OR trim(exif_datetime) <> ''", "train_images": "lower(trim(split)) IN ('train', 'training')",
}


@query("WITH a AS (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _ROLLUP.items()) + f" FROM manifest) UNPIVOT a ON {', '.join(_ROLLUP)} INTO NAME metric VALUE value")
def inventory_rollup(spark, sf):
    """Counts over the manifest, one to a row."""
    return stats.rollup_metrics(table(spark, sf, "manifest"), {n: F.expr(c) for n, c in _ROLLUP.items()})


@query("""WITH d AS (SELECT DISTINCT ON (defect_id) defect_id, review_status FROM defects), s AS (SELECT unnest(['UNREVIEWED', 'CONFIRMED', 'REJECTED', 'NEEDS_INVESTIGATION']) status)
SELECT status, count(defect_id) AS defects FROM s LEFT JOIN (SELECT defect_id, min(review_status) r FROM defects GROUP BY defect_id) ON r = status GROUP BY status""")
def review_counts(spark, sf):
    """Every review status with its number of defects, zeros kept."""
    d = table(spark, sf, "defects").groupBy("defect_id").agg(F.min("review_status").alias("review_status"))
    return store.review_counts(d)


@query(f"""WITH {R.BOXES}, e AS (SELECT line_id, class_id, width * height AS area FROM b)
SELECT * FROM (SELECT 'smallest' AS example, line_id, round(area, 9) AS area FROM e ORDER BY e.area, line_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'largest', line_id, round(area, 9) FROM e ORDER BY e.area DESC, line_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'seepage', line_id, round(area, 9) FROM e WHERE class_id = 5 ORDER BY line_id LIMIT 20)""")
def box_examples(spark, sf):
    b = R.boxes(spark, sf).withColumn("area", F.col("width") * F.col("height"))
    return stats.extreme_examples(b, "area", "line_id", 20, {"seepage": F.col("class_id") == 5}).withColumn("area", R.r9("area"))


@query(f"""WITH {R.BOXES} SELECT split, image, count(*) AS boxes FROM b GROUP BY ALL ORDER BY boxes DESC, split, image LIMIT 30""")
def fullest_images(spark, sf):
    return R.boxes(spark, sf).groupBy("split", "image").agg(F.count("*").alias("boxes")).orderBy(F.col("boxes").desc(), "split", "image").limit(30)


@query("""WITH n AS (SELECT status AS name, count(*) n FROM inspections GROUP BY status), e AS (SELECT unnest(['COMPLETED', 'ARCHIVED', 'FAILED']) name, unnest([10, 0, 15]) expected)
SELECT coalesce(n.name, e.name) AS name, coalesce(n::VARCHAR, '') AS n, coalesce(expected::VARCHAR, '') AS expected FROM n FULL JOIN e ON e.name = n.name WHERE n IS DISTINCT FROM expected""")
def count_issues(spark, sf):
    """Inspections by status against stated numbers."""
    n = table(spark, sf, "inspections").groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))
    d = stats.count_issues(n, {"COMPLETED": 10, "ARCHIVED": 0, "FAILED": 15})
    return d.select("name", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("n", "expected")))


# Detections.
_REGION_LABELS = "[class_id] || CASE WHEN id % 7 = 0 THEN [class_id] WHEN id % 11 = 0 THEN [9] ELSE [] END"


@query(f"""WITH {R.DETECTIONS}, ok AS (SELECT DISTINCT image_id FROM r),
x AS (SELECT 'prediction' AS record, unnest({codes_sql({"unknown_image": "p.image_id IN (SELECT image_id FROM ok)", "box": "x1 >= 0 AND x1 < x2 AND y1 >= 0 AND y1 < y2", "class": "class_id IN (0, 1)", "confidence": "confidence BETWEEN 0 AND 1"})}) AS code FROM p
  UNION ALL SELECT 'region', unnest({codes_sql({"unknown_image": "r.image_id IN (SELECT image_id FROM ok)", "box": "x1 >= 0 AND x1 < x2 AND y1 >= 0 AND y1 < y2", "labels": f"len(list_distinct({_REGION_LABELS})) = len({_REGION_LABELS}) AND NOT list_contains({_REGION_LABELS}, 9) AND NOT list_contains({_REGION_LABELS}, 2)"})}) FROM r)
SELECT record, code, count(*) AS records FROM x GROUP BY ALL""")
def detection_issues(spark, sf):
    """Detections whose images, boxes, classes or labels break the rules; known are images with a region and the first two classes."""
    p, r = R.detections(spark, sf)
    images = r.select("image_id").distinct()
    labels = F.concat(F.array("class_id"), F.when(F.col("id") % 7 == 0, F.array("class_id")).when(F.col("id") % 11 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")))
    return validate.detection_issues(images, p, r.withColumn("labels", labels), [0, 1]).groupBy("record", "code").agg(F.count("*").alias("records"))


@query(f"""WITH {R.DETECTIONS}, q AS (SELECT *, 12 AS original_width, CASE WHEN id % 13 = 0 THEN 9 ELSE 14 END AS original_height, ['a', 'b', 'x'][class_id + 1] AS class_name, image_id IN (SELECT image_id FROM r) AS own FROM p),
x AS (SELECT unnest({codes_sql({"unknown_image": "own", "size_differs": "NOT own OR original_height = 14", "beyond_image": "x2 <= original_width AND y2 <= original_height", "class_name": "class_name = ['a', 'b', 'c'][class_id + 1]", "below_floor": "confidence >= 0.05"})}) AS code FROM q
  UNION ALL SELECT 'too_many' FROM (SELECT image_id FROM q GROUP BY image_id HAVING count(*) > 85))
SELECT code, count(*) AS records FROM x GROUP BY code""")
def export_issues(spark, sf):
    """Exported predictions against their image's size, class names, a confidence floor and a most number an image."""
    p, r = R.detections(spark, sf)
    names = F.element_at(F.array(*map(F.lit, ("a", "b", "x"))), F.col("class_id") + 1)
    q = p.select("*", F.lit(12).alias("original_width"), F.when(F.col("id") % 13 == 0, 9).otherwise(14).alias("original_height"), names.alias("class_name"))
    meta = r.select("image_id").distinct().select("image_id", F.lit(12).alias("original_width"), F.lit(14).alias("original_height"))
    return validate.export_issues(q, meta, {0: "a", 1: "b", 2: "c"}, 85, 0.05).groupBy("code").agg(F.count("*").alias("records"))


_MAPPING = [("view", 0, "approved"), ("click", 1, "approved"), ("purchase", 1, "approved"), ("signup", 2, "rejected")]


@query("""WITH l AS (SELECT user_id, list(DISTINCT event_type) ls FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(ls, lambda x: CASE x WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 END), lambda x: x IS NOT NULL))), ',') AS class_ids,
  array_to_string(list_sort(list_filter(ls, lambda x: x IN ('signup', 'error'))), ',') AS excluded, array_to_string(list_sort(list_filter(ls, lambda x: x NOT IN ('view', 'click', 'purchase', 'signup', 'error'))), ',') AS unknown FROM l""")
def mapped_labels(spark, sf):
    """Label names of a user's events mapped to classes: approved ones, excluded ones, unknown ones."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    d = validate.mapped_labels(rows, spark.createDataFrame(_MAPPING, "label string, class_id int, status string"), ["error"])
    return d.select("user_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("class_ids", "excluded", "unknown")))


@query(f"""WITH a AS ({R._SQL["average_precision"]}), s AS (SELECT threshold::VARCHAR || '/' || class_id AS metric, ap FROM a)
SELECT x.class_id::VARCHAR AS metric, x.ap AS before, y.ap AS after, round(y.ap - x.ap, 9) AS delta FROM a x JOIN a y ON y.class_id = x.class_id AND y.threshold = 0.75 WHERE x.threshold = 0.5""")
def metric_deltas(spark, sf):
    """Average precision by class, at 0.75 against 0.5."""
    ap = R.average_precision(spark, sf)
    one = lambda t: ap.where(F.col("threshold") == t).select(F.col("class_id").cast("string").alias("metric"), F.col("ap").alias("value"))
    return detection.metric_deltas(one(0.5), one(0.75)).withColumn("delta", R.r9("delta"))


# Camera: each vector is a depth image of 8 x 8.
_REQUEST = {
    "stamp": "vec_id * 10", "depth_stamp": "CASE WHEN vec_id % 41 = 0 THEN vec_id ELSE vec_id * 10 END", "info_stamp": "vec_id * 10", "mode": "CAST(vec_id % 3 AS INT)",
    "u": "CAST(vec_id % 9 AS INT)", "v": "CAST(vec_id % 7 AS INT)", "left": "CAST(vec_id % 4 AS INT)", "top": "CAST(vec_id % 5 AS INT)",
    "right": "CAST(vec_id % 4 + vec_id % 6 AS INT)", "bottom": "CAST(vec_id % 5 + 2 + vec_id % 3 AS INT)", "fx": "CASE WHEN vec_id % 47 = 0 THEN 0.0 ELSE 100.0 END",
}


def camera_requests(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    frame = F.lit(camera.FRAME)
    cells = [F.expr(x).alias(f"`{c}`".strip("`")) for c, x in _REQUEST.items()]
    rows = e.select("vec_id", F.col("embedding").alias("depth"), *cells)
    k = F.array(F.col("fx").cast("double"), F.lit(0.0), F.lit(3.5), F.lit(0.0), F.lit(120.0), F.lit(3.5), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.select(
        "*", F.when(F.col("vec_id") % 43 == 0, "map").otherwise(frame).alias("frame"), frame.alias("depth_frame"), frame.alias("info_frame"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(8).alias("info_width"), F.lit(8).alias("info_height"), k.alias("k"), F.array().cast("array<double>").alias("d"), F.lit(0).alias("binning_x"), F.lit(0).alias("binning_y"),
    )


PROJECTED = f"""q AS (SELECT vec_id, embedding AS depth, {", ".join(f'{x} AS "{c}"' for c, x in _REQUEST.items())} FROM embeddings),
b AS (SELECT *, ceil(("right" - "left") * 0.5)::INT AS w, ceil((bottom - top) * 0.5)::INT AS h FROM q),
m AS (SELECT *, "left" + floor(("right" - "left" - w) / 2)::INT AS x0, top + floor((bottom - top - h) / 2)::INT AS y0 FROM b),
z AS (SELECT *, CASE WHEN "left" < "right" AND top < bottom AND "right" <= 8 AND bottom <= 8 THEN list_sort(list_filter(flatten([depth[y * 8 + x0 + 1 : y * 8 + x0 + w] FOR y IN range(y0, y0 + h)]), lambda d: d > 0)) END AS ok FROM m),
d AS (SELECT *, CASE WHEN len(ok) = 0 THEN NULL WHEN len(ok) % 2 = 1 THEN ok[len(ok) // 2 + 1]::DOUBLE ELSE ok[len(ok) // 2]::DOUBLE + (ok[len(ok) // 2 + 1]::DOUBLE - ok[len(ok) // 2]::DOUBLE) / 2 END AS med, depth[v * 8 + u + 1]::DOUBLE AS pix FROM z),
s AS (SELECT *, CASE WHEN stamp <> depth_stamp THEN 'TIMESTAMP_MISMATCH' WHEN vec_id % 43 = 0 THEN 'FRAME_MISMATCH' WHEN fx <= 0 THEN 'INVALID_CAMERA_MODEL' WHEN mode NOT IN (0, 1) THEN 'INVALID_REQUEST'
  WHEN mode = 0 AND (u >= 8 OR v >= 8) THEN 'OUT_OF_BOUNDS' WHEN mode = 0 AND NOT pix > 0 THEN 'NO_VALID_DEPTH' WHEN mode = 1 AND ("left" >= "right" OR top >= bottom) THEN 'INVALID_REQUEST'
  WHEN mode = 1 AND ("right" > 8 OR bottom > 8) THEN 'OUT_OF_BOUNDS' WHEN mode = 1 AND med IS NULL THEN 'NO_VALID_DEPTH' WHEN mode = 1 AND len(ok) / (w * h) < 0.5 THEN 'INSUFFICIENT_DEPTH' ELSE 'SUCCESS' END AS status FROM d)"""


@query(f"""WITH {PROJECTED}, p AS (SELECT *, CASE WHEN mode = 1 THEN med ELSE pix END AS dz, CASE WHEN mode = 1 THEN ("left" + "right" - 1) / 2 ELSE u END AS su, CASE WHEN mode = 1 THEN (top + bottom - 1) / 2 ELSE v END AS sv FROM s WHERE status = 'SUCCESS')
SELECT vec_id, round((su - 3.5) / fx * dz, 9) AS x, round((sv - 3.5) / 120 * dz, 9) AS y, round(dz, 9) AS z, su::DOUBLE AS sample_u, sv::DOUBLE AS sample_v FROM p""")
def camera_points(spark, sf):
    """The places of the requests that succeed."""
    d = camera.project(camera_requests(spark, sf)).where("status = 0")
    return d.select("vec_id", *(F.round(c, 9).alias(c) for c in "xyz"), "sample_u", "sample_v")


@query(f"WITH {PROJECTED}, n AS (SELECT status, count(*) n FROM s GROUP BY status) SELECT x AS status_name, coalesce(n, 0) AS n FROM (SELECT unnest({list(camera.STATUSES)}) x) LEFT JOIN n ON status = x")
def camera_outcomes(spark, sf):
    """Every outcome with its number."""
    return camera.outcomes(camera.project(camera_requests(spark, sf)))


# Stored records.
@query("SELECT inspection_id, structure_id, status FROM inspections WHERE inspection_id = 7")
def inspection_by_id(spark, sf):
    return store.get(table(spark, sf, "inspections"), "inspection_id", 7).select("inspection_id", "structure_id", "status")


EVIDENCE = """ev AS (SELECT defect_id, 'f' || k AS frame_id, ts, confidence, defect_id || '#' || k AS evidence_id FROM (
  SELECT defect_id, min(first_seen) AS first_seen, min(confidence) AS confidence, min(observation_count) AS n FROM defects GROUP BY defect_id) d, range(1, 4) r(k), (SELECT 1), LATERAL (SELECT first_seen + to_seconds(k) AS ts) WHERE k <= n)"""


def evidence(spark, sf) -> DataFrame:
    """Up to three pieces of evidence for each defect, a second apart."""
    d = table(spark, sf, "defects").groupBy("defect_id").agg(F.min("first_seen").alias("first_seen"), F.min("confidence").alias("confidence"), F.min("observation_count").alias("n"))
    rows = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.greatest("n", F.lit(1)), F.lit(3))))).where("k <= n")
    return rows.select("defect_id", F.concat(F.lit("f"), F.col("k").cast("string")).alias("frame_id"), F.timestamp_seconds(F.unix_micros("first_seen") / 1_000_000 + F.col("k")).alias("timestamp"), "confidence", F.concat_ws("#", "defect_id", F.col("k").cast("string")).alias("evidence_id"))


@query(f"""WITH {EVIDENCE}, e AS (SELECT defect_id, string_agg(evidence_id, ' ' ORDER BY ts, evidence_id) AS es, count(*) n FROM ev GROUP BY defect_id),
d AS (SELECT DISTINCT defect_id, inspection_id FROM defects), r AS (SELECT inspection_id, string_agg(d.defect_id || '[' || coalesce(es, '') || ']', ',' ORDER BY d.defect_id) AS ds, count(*) c, sum(coalesce(n, 0))::BIGINT AS n FROM d LEFT JOIN e ON e.defect_id = d.defect_id GROUP BY inspection_id)
SELECT i.inspection_id, trim(s.name) AS structure, coalesce(nullif(trim(s.location_text), ''), 'Unavailable') AS location, coalesce(r.c, 0)::INT AS defects, coalesce(r.n, 0) AS evidence, coalesce(ds, '') AS listing FROM inspections i JOIN structures s USING (structure_id) LEFT JOIN r USING (inspection_id)""")
def full_report(spark, sf):
    """Reports with nested defects and evidence, shown as text."""
    rows, _ = store.full_report(*(table(spark, sf, t) for t in ("structures", "inspections", "defects")), evidence(spark, sf))
    one = lambda d: F.concat(d["defect_id"], F.lit("["), F.array_join(F.transform(d["evidence"], lambda e: e["evidence_id"]), " "), F.lit("]"))
    n = F.aggregate("defects", F.lit(0).cast("bigint"), lambda acc, d: acc + F.size(d["evidence"]))
    return rows.select("inspection_id", F.col("structure.name").alias("structure"), F.col("structure.location").alias("location"), F.size("defects").alias("defects"), n.alias("evidence"), F.array_join(F.transform("defects", one), ",").alias("listing"))


@query(f"""WITH {EVIDENCE}, x AS (SELECT 'defects' AS "table", 'unknown_inspection' AS code, count(*) n FROM defects d WHERE NOT EXISTS (SELECT 1 FROM inspections i WHERE i.inspection_id = d.inspection_id)
  UNION ALL SELECT 'defects', 'id_repeats', count(*) FROM (SELECT defect_id FROM defects GROUP BY defect_id HAVING count(*) > 1))
SELECT * FROM x WHERE n > 0""")
def report_issues(spark, sf):
    """What a report can't be built from: records without their parents, repeated ids."""
    _, issues = store.full_report(*(table(spark, sf, t) for t in ("structures", "inspections", "defects")), evidence(spark, sf))
    return issues.groupBy("table", "code").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT defect_id, inspection_id, coalesce(nullif(trim(track_id), ''), 'N/A') AS track_id, coalesce(nullif(trim(class_name), ''), 'N/A') AS class_name, observation_count, coalesce(nullif(trim(review_status), ''), 'N/A') AS review_status FROM defects)
SELECT * FROM d""")
def dashboard(spark, sf):
    """The dashboard's columns but for those whose text of a number differs between engines."""
    return store.dashboard_rows(table(spark, sf, "defects")).drop("confidence", "x_m", "y_m", "z_m").distinct()


@query(f"""SELECT 'structures' AS "table", unnest({codes_sql({"name": "trim(name) <> ''", "description": "description IS NOT NULL", "location_text": "location_text IS NULL OR trim(location_text) <> ''"})}) AS code, structure_id AS id FROM structures
UNION ALL SELECT 'inspections', unnest({codes_sql({"structure_id": "structure_id > 0", "started_at": "started_at IS NOT NULL", "completed_order": "completed_at IS NULL OR completed_at >= started_at", "status": f"status IN {INSPECTION_STATES}", "system_version": "trim(system_version) <> ''", "notes": "notes IS NULL OR trim(notes) <> ''"})}), inspection_id FROM inspections""")
def storage_issues(spark, sf):
    """Structures and inspections that break the rules of stored records."""
    own = lambda name, key, rules: validate.with_codes(table(spark, sf, name), rules).select(F.lit(name).alias("table"), F.explode("codes").alias("code"), F.col(key).alias("id"))
    return own("structures", "structure_id", validate.structure_rules()).unionByName(own("inspections", "inspection_id", validate.inspection_rules(INSPECTION_STATES)))


def mapped_observations(spark, sf) -> DataFrame:
    """Events as mapped observations, some of them faulty."""
    o = R.observations(spark, sf)
    n = F.col("seq")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), F.col("class_id"))
    return o.select(
        "*", F.when(n % 17 == 0, "other").otherwise(F.col("observation_id")).alias("detection_id"), F.when(n % 19 == 0, "Moss").otherwise(name).alias("class_name"), F.when(n % 23 == 0, "odom").otherwise("map").alias("coordinate_frame"),
        F.lit(20).alias("image_width"), F.lit(20).alias("image_height"), (n % 10).cast("double").alias("x1"), (n % 10 + n % 13).cast("double").alias("x2"), F.lit(1.0).alias("y1"), F.lit(2.0).alias("y2"), F.when(n % 29 == 0, "old").otherwise("m1").alias("model_version"),
    )


@query(f"""WITH o AS (SELECT event_id n, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS c FROM events),
x AS (SELECT unnest({codes_sql({"detection_id": "n % 17 <> 0", "class_id": "c IS NOT NULL AND c > 0", "class_name": "n % 19 <> 0 AND c > 0", "frame": "n % 23 <> 0", "box_x": "n % 13 > 0 AND n % 10 + n % 13 <= 20", "model_version": "n % 29 <> 0"})}) AS code FROM o)
SELECT code, count(*) AS observations FROM x GROUP BY code""")
def observation_issues(spark, sf):
    """Observations that may not be fused, by rule."""
    coded = validate.with_codes(mapped_observations(spark, sf), validate.observation_rules(CLASSES, "m1"))
    return coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("observations"))


@query()
def fused_records(spark, sf):
    """Defect records of the fusion with the pieces of evidence that each has."""
    o = R.observations(spark, sf)
    decisions, defects = fusion.fuse(o)
    records, proof = store.fused_records(decisions, defects, o, CLASSES)
    return records.join(proof.groupBy("defect_id").agg(F.count("*").alias("evidence")), "defect_id").select("defect_id", "inspection_id", "class_name", "observation_count", "evidence")


@query("SELECT 0 AS x WHERE false")
def fusion_disagreements(spark, sf):
    """Fused defects that don't agree with their observations; none may come out."""
    o = R.observations(spark, sf)
    decisions, defects = fusion.fuse(o)
    new = decisions.where("decision in ('CREATED', 'ASSOCIATED')").select("seq", "inspection_id", "observation_id", "defect_id")
    members = o.dropDuplicates(["seq", "inspection_id", "observation_id"]).join(new, ["seq", "inspection_id", "observation_id"])
    return validate.aggregate_issues(defects, members).select(F.lit(0).alias("x"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

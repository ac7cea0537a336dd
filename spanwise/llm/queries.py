"""Queries of the problems tagged llm, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanwise.llm import components, cross_split, eval_leaks, grouped_splits, mixture, nearest_time, survivors, truncation
from spanwise.functions.text import unify_source
from spanwise.session import table


#: Equivalents for queries that SQL can express on whole tables.
P3_SQL = """
WITH e AS (SELECT sample_id, lower(trim(run_id)) r, timestamp_ns t FROM trajectory_est WHERE run_id IS NOT NULL AND timestamp_ns IS NOT NULL AND timestamp_ns <> 0),
g AS (SELECT lower(trim(run_id)) r, timestamp_ns t, min(sample_id) id FROM trajectory_gt WHERE run_id IS NOT NULL AND timestamp_ns IS NOT NULL AND timestamp_ns <> 0 GROUP BY 1, 2),
lo AS (SELECT e.sample_id, e.t et, g.t, g.id FROM e ASOF JOIN g ON e.r = g.r AND e.t >= g.t),
hi AS (SELECT e.sample_id, e.t et, g.t, g.id FROM e ASOF JOIN g ON e.r = g.r AND e.t <= g.t),
c AS (SELECT *, abs(et - t) d FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi))
SELECT sample_id AS est_sample_id, arg_min(id, (d, t, id)) AS gt_sample_id FROM c WHERE d <= 50000000 GROUP BY sample_id
"""

_UNKNOWN = "('null','none','nil','n/a','na','nan','nat','unknown','unk','undefined','unset','missing','not available','tbd','tba','?','??','???','-','--','---','.','_','#n/a')"
P4_SQL = f"""
WITH g AS (
  SELECT upper(trim(duplicate_group_id)) k, record_id, recorded_at, coalesce(trim(inclusion_reason), '') <> '' AND coalesce(trim(exclusion_reason), '') = '' AS inc,
    coalesce(trim(label_relative_path) <> '' AND lower(trim(label_relative_path)) NOT IN {_UNKNOWN}, false) AS label_relative_path,
    coalesce(annotation_count >= 0, false) AS annotation_count,
    coalesce(trim(class_ids) <> '' AND lower(trim(class_ids)) NOT IN {_UNKNOWN}, false) AS class_ids,
    coalesce(width >= 1, false) AS width, coalesce(height >= 1, false) AS height
  FROM gyu_det_v3_baseline_v1 WHERE trim(duplicate_group_id) <> ''),
m AS (SELECT *, label_relative_path::int + annotation_count::int + class_ids::int + width::int + height::int AS n FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
l AS (
  SELECT k, record_id, recorded_at, inc, n, unnest(['record','label_relative_path','annotation_count','class_ids','width','height']) AS field_name,
    unnest([true, label_relative_path, annotation_count, class_ids, width, height]) AS ok FROM m)
SELECT k AS duplicate_group_id, field_name, record_id FROM l WHERE ok
QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY inc DESC, n DESC, recorded_at DESC NULLS LAST, record_id) = 1
"""

_SPLIT = "CASE WHEN lower(trim({0})) IN ('train','training') THEN 'train' WHEN lower(trim({0})) IN ('valid','val','validation') THEN 'valid' WHEN lower(trim({0})) IN ('test','testing') THEN 'test' END"
P5_SQL = f"""
WITH RECURSIVE m AS (SELECT {_SPLIT.format("split")} s, lower(trim(image_filename)) n, min(image_id) id FROM manifest GROUP BY 1, 2),
e AS (
  SELECT DISTINCT a.id a, b.id b FROM leakage_review r
  JOIN m a ON a.s = {_SPLIT.format("r.split_a")} AND a.n = lower(trim(r.image_a))
  JOIN m b ON b.s = {_SPLIT.format("r.split_b")} AND b.n = lower(trim(r.image_b))
  WHERE r.human_outcome <> 'REJECT_LEAKAGE_CANDIDATE' AND r.review_authorized AND a.id <> b.id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, l) AS (SELECT a, a FROM u UNION SELECT u.b, w.l FROM w JOIN u ON u.a = w.id WHERE w.l < u.b)
SELECT id AS image_id, min(l) AS group_id FROM w GROUP BY id
"""

P6_SQL = f"""
SELECT lower(trim(leakage_group_id)) AS leakage_group_id FROM gyu_det_v3_baseline_v1
WHERE trim(leakage_group_id) <> '' GROUP BY 1 HAVING count(DISTINCT {_SPLIT.format("processed_split")}) > 1
"""

P1_SQL = f"""
WITH m AS (
  SELECT image_id, {_SPLIT.format("split")} s, lower(trim(image_sha256)) sha, regexp_replace(lower(trim(perceptual_hash)), '^0x', '') h
  FROM manifest WHERE file_size_bytes > 0),
b AS (
  SELECT *, CASE WHEN regexp_full_match(h, '[0-9a-f]{{32}}') THEN ('0x' || h[1:16])::UBIGINT END hi, CASE WHEN regexp_full_match(h, '[0-9a-f]{{32}}') THEN ('0x' || h[17:32])::UBIGINT END lo FROM m),
c AS (SELECT *, bit_count(hi::BIT) + bit_count(lo::BIT) n FROM b),
p AS (
  SELECT t.image_id t, e.image_id e FROM c t JOIN c e ON t.sha = e.sha WHERE t.s = 'train' AND e.s IN ('valid', 'test')
  UNION
  SELECT t.image_id, e.image_id FROM c t, c e WHERE t.s = 'train' AND e.s IN ('valid', 'test') AND t.n BETWEEN 9 AND 119 AND e.n BETWEEN 9 AND 119
    AND bit_count(xor(t.hi, e.hi)::BIT) + bit_count(xor(t.lo, e.lo)::BIT) <= 12)
SELECT least(t, e) AS image_id_a, greatest(t, e) AS image_id_b FROM p
"""

P8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM eval_items),
dw AS (SELECT doc_id, unnest([array_to_string(w[k:k+12], ' ') FOR k IN range(1, len(w) - 11)]) x FROM d WHERE len(w) >= 13),
iw AS (SELECT item_id, unnest([array_to_string(w[k:k+12], ' ') FOR k IN range(1, len(w) - 11)]) x FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)
"""


P1_REPORT_SQL = P1_SQL.split("SELECT least")[0] + f"""
SELECT 'train/' || e.s AS split_pair, lower(trim(f.source)) AS eval_source, count(*) AS pairs, count(*) FILTER (coalesce(t.sha = e.sha, false)) AS equal_pairs,
  count(*) FILTER (NOT coalesce(t.sha = e.sha, false)) AS near_pairs, count(DISTINCT e.image_id)::BIGINT AS eval_images
FROM p JOIN c t ON t.image_id = p.t JOIN c e ON e.image_id = p.e JOIN manifest f ON f.image_id = e.image_id GROUP BY ALL"""


def _coverage_sql(radius: int) -> str:
    """Coverage by brute force; the bands are those of the plan."""
    xor = {0: "xor(t.hi, e.hi)", 1: "xor(t.lo, e.lo)"}
    bands = cross_split.plan_bands(radius)
    hit = [" + ".join(f"bit_count((({xor[h]} >> {s}) & {(1 << w) - 1})::BIT)" for h, s, w in b.pieces) + f" <= {b.slack}" for b in bands]
    bits = " + ".join(f"CASE WHEN ({h}) THEN {1 << i} ELSE 0 END" for i, h in enumerate(hit))
    width = " + ".join(f"CASE WHEN bands & {1 << i} > 0 THEN {b.width} ELSE 0 END" for i, b in enumerate(bands))
    return P1_SQL.split("p AS (")[0].rstrip().rstrip(",") + f""",
h AS (SELECT DISTINCT s = 'train' AS train, hi, lo FROM c WHERE s IS NOT NULL AND n BETWEEN 9 AND 119),
o AS (SELECT e.hi, e.lo, bit_count(xor(t.hi, e.hi)::BIT) + bit_count(xor(t.lo, e.lo)::BIT) AS d, {bits} AS b FROM h t JOIN h e ON t.train AND NOT e.train
  WHERE bit_count(xor(t.hi, e.hi)::BIT) + bit_count(xor(t.lo, e.lo)::BIT) <= {radius}),
g AS (SELECT hi, lo, count(*) AS n, min(d) AS d, bit_or(b) AS bands FROM o GROUP BY hi, lo)
SELECT DISTINCT image_id, s AS split, g.n AS training_hashes, d::INT AS nearest, ({width})::INT AS covered_bits FROM c JOIN g USING (hi, lo) WHERE s IN ('valid', 'test')"""


P4_RECORDS_SQL = f"""WITH f AS ({P4_SQL}), r AS (SELECT * FROM f WHERE field_name = 'record'), b AS (SELECT * FROM gyu_det_v3_baseline_v1)
SELECT r.duplicate_group_id, r.record_id, l.label_relative_path, a.annotation_count::VARCHAR AS annotation_count, c.class_ids, w.width::VARCHAR AS width, h.height::VARCHAR AS height FROM r
""" + "\n".join(
    f"LEFT JOIN (SELECT f.duplicate_group_id, b.{c} FROM f JOIN b USING (record_id) WHERE field_name = '{c}') {n} ON {n}.duplicate_group_id = r.duplicate_group_id"
    for n, c in (("l", "label_relative_path"), ("a", "annotation_count"), ("c", "class_ids"), ("w", "width"), ("h", "height"))
)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(table(spark, sf, "manifest"))
    return pairs.select("image_id_a", "image_id_b")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, sf, "manifest"))


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.coverage(table(spark, sf, "manifest"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nearest_time.nearest_in_time(table(spark, sf, "trajectory_est"), table(spark, sf, "trajectory_gt"), "run_id", "timestamp_ns", "sample_id", 50_000_000)
    return pairs.select(F.col("left_id").alias("est_sample_id"), F.col("right_id").alias("gt_sample_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    chosen = survivors.image_survivors(table(spark, sf, "gyu_det_v3_baseline_v1"))
    return chosen.select(F.col("group_id").alias("duplicate_group_id"), "field_name", "record_id")


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """One built record a group, by the stated order; numbers as text, as some are missing."""
    d = survivors.surviving_records(table(spark, sf, "gyu_det_v3_baseline_v1"))
    return d.select(*(F.col(c).cast("string").alias(c) if c in ("annotation_count", "width", "height") else F.col(c) for c in d.columns))


def p4_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Values by weighted consensus of all records of a group, not by the stated order."""
    chosen = survivors.image_consensus(table(spark, sf, "gyu_det_v3_baseline_v1"))
    return chosen.select(F.col("group_id").alias("duplicate_group_id"), "field_name", "value", "record_id", "voters")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    links = components.upheld_links(table(spark, sf, "leakage_review"), table(spark, sf, "manifest"))
    return components.components(links).select(F.col("id").alias("image_id"), "group_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = grouped_splits.image_splits(table(spark, sf, "gyu_det_v3_baseline_v1"))
    divided = parts.where(F.col("grouped") & (F.size("present_splits") > 1))
    return divided.select(F.expr("substring(component, 3)").alias("leakage_group_id"))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_splits.record_splits(table(spark, sf, "gyu_det_v3_baseline_v1"))


def p6_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of records and of each label that the splits came to."""
    return grouped_splits.split_balance(grouped_splits.image_splits(table(spark, sf, "gyu_det_v3_baseline_v1")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    leaks = eval_leaks.eval_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return leaks.where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per item: documents that hold a passage of it word for word."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return eval_leaks.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def curriculum(targets: DataFrame) -> dict[str, mixture.Schedule]:
    """The schedules of p9: small sources (under the median share) gain weight towards the end, fourfold, large ones lose as much; a settings table of few rows."""
    rows = targets.select(unify_source(F.col("source")).alias("source"), "target_share").where("source is not null and target_share > 0").orderBy("target_share", "source").collect()
    late, early = [(0.0, 0.5), (0.5, 1.0), (1.0, 2.0)], [(0.0, 2.0), (0.5, 1.0), (1.0, 0.5)]
    return {r.source: late if 2 * i < len(rows) - 1 else early for i, r in enumerate(rows)}


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    return mixture.mixture(table(spark, sf, "documents"), targets, schedules=curriculum(targets))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_report, p1_coverage, p3_found, p4_found, p4_records, p4_consensus, p5_found, p6_found, p6_splits, p6_balance,
        p8_found, p8_items, p8_report, p9_mixture, p9_shares, p10_found, p10_rates,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL, "p1_report": P1_REPORT_SQL, "p1_coverage": _coverage_sql(12), "p3_found": P3_SQL, "p4_found": P4_SQL, "p4_records": P4_RECORDS_SQL,
        "p5_found": P5_SQL, "p6_found": P6_SQL, "p8_found": P8_SQL, "p8_items": f"SELECT item_id, count(*) AS documents FROM ({P8_SQL}) GROUP BY item_id",
    }

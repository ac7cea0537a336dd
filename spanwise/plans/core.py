"""Queries of the core problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwise.operators import proximity, quarantine
from spanwise.session import table

P2_SQL = """
WITH d AS (
  SELECT d.defect_id, i.structure_id, min(d.x_m) x, min(d.y_m) y, min(d.z_m) z
  FROM defects d JOIN inspections i USING (inspection_id)
  WHERE d.coordinate_frame = 'map' AND NOT (d.x_m = 0 AND d.y_m = 0 AND d.z_m = 0)
    AND NOT isnan(d.x_m) AND NOT isnan(d.y_m) AND NOT isnan(d.z_m)
  GROUP BY d.defect_id, i.structure_id)
SELECT a.defect_id AS defect_id_a, b.defect_id AS defect_id_b
FROM d a JOIN d b ON a.structure_id = b.structure_id AND a.defect_id < b.defect_id
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.25
"""

P7_BOXES_SQL = r"""
WITH r AS (
  SELECT line_id, file_name, line_no, string_split_regex(trim(regexp_replace(line, '\r$', ''), ' ' || chr(9)), '[ \t]+') AS f
  FROM raw_lines WHERE feed = 'boxes'),
v AS (
  SELECT line_id, file_name, line_no, f[1] AS c,
    [CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(s AS DOUBLE) END FOR s IN f[2:5]] AS n
  FROM r WHERE len(f) = 5)
SELECT line_id, file_name, line_no, CAST(c AS INTEGER) AS class_id, n[1] AS x, n[2] AS y, n[3] AS width, n[4] AS height
FROM v WHERE regexp_full_match(c, '[0-5]') AND n[1] BETWEEN 0 AND 1 AND n[2] BETWEEN 0 AND 1 AND n[3] > 0 AND n[3] <= 1 AND n[4] > 0 AND n[4] <= 1
""".replace("\\\\", "\\")


#: Training log lines: fields of well quoted lines, numbers where they are plain.
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_NAMES = ", ".join(f"n[{i}] AS {c}" for i, c in enumerate(quarantine.RESULT_COLUMNS[1:15], 1))
_RATES = [i for i, c in enumerate(quarantine.RESULT_COLUMNS[1:15], 1) if c in quarantine.RATES]
P7_PARSED = rf"""
raw AS (SELECT line_id, feed, file_name, line_no, regexp_replace(line, '\r$', '') AS x FROM raw_lines WHERE feed IN ('results', 'boxes') AND line IS NOT NULL AND NOT (feed = 'results' AND coalesce(line_no, 0) = 1)),
rec AS (SELECT * FROM raw WHERE regexp_matches(x, '[^ \t\r\n\x0b\x0c]')),
res AS (SELECT *, regexp_full_match(x, '{_FIELD}(,{_FIELD})*') AS quoted, list_transform(regexp_extract_all(',' || x, ',{_FIELD}', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM rec WHERE feed = 'results'),
val AS (SELECT *, trim(f[1], ' ' || chr(9)) AS e, [CASE WHEN regexp_full_match(trim(s, ' ' || chr(9)), '{_NUMBER}') THEN TRY_CAST(trim(s, ' ' || chr(9)) AS DOUBLE) END FOR s IN f[2:15]] AS n FROM res),
ok AS (SELECT *, quoted AND len(f) = 16 AS whole, coalesce(regexp_full_match(e, '\+?0*[1-9][0-9]*'), false) AND len(list_filter(n, lambda v: v IS NOT NULL AND isfinite(v) AND v >= 0)) = 14
  AND {" AND ".join(f"coalesce(n[{i}] <= 1, false)" for i in _RATES)} AS fits FROM val)"""
P7_RESULTS_SQL = f"""WITH {P7_PARSED} SELECT line_id, file_name, line_no, TRY_CAST(e AS BIGINT) AS epoch, {_NAMES}, f[16] AS remark FROM ok WHERE whole AND fits"""
P7_SQL = f"""WITH {P7_PARSED}, good AS ({P7_BOXES_SQL}), box AS (SELECT line_id, len(string_split_regex(trim(x, ' ' || chr(9)), '[ \\t]+')) AS n FROM rec WHERE feed = 'boxes')
SELECT line_id, CASE WHEN NOT quoted THEN 'broken_quoting' WHEN NOT whole THEN 'column_count' ELSE 'invalid_value' END AS reason FROM ok WHERE NOT (whole AND fits)
UNION ALL SELECT line_id, CASE WHEN n <> 5 THEN 'column_count' ELSE 'invalid_value' END FROM box WHERE line_id NOT IN (SELECT line_id FROM good)"""


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = proximity.near_defects(table(spark, sf, "defects"), table(spark, sf, "inspections"))
    return pairs.select("defect_id_a", "defect_id_b")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.rejected(table(spark, sf, "raw_lines")).select("line_id", "reason")


def p7_results(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.load_results(table(spark, sf, "raw_lines"))


def p7_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.load_boxes(table(spark, sf, "raw_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p7_found, p7_results, p7_boxes)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p7_found": P7_SQL, "p7_results": P7_RESULTS_SQL, "p7_boxes": P7_BOXES_SQL}

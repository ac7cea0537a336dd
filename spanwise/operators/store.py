"""Inspection records as tables: filters, lookups, keyed inserts and updates, cascades, report assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spanwise.operators.stats import category_counts
from spanwise.operators.validate import require_empty

REVIEW_STATUSES = ("UNREVIEWED", "CONFIRMED", "REJECTED", "NEEDS_INVESTIGATION")


def find_defects(defects: DataFrame, inspection_id: int | None = None, class_name: str | None = None, review_status: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Defects that meet every given condition, by defect_id; conditions reach the scan."""
    out = defects
    for column, value in (("inspection_id", inspection_id), ("class_name", class_name), ("review_status", review_status)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)
    return out.orderBy("defect_id")


def get(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, no row if there is none; a text key is trimmed. The condition reaches the scan."""
    return rows.where(F.col(key) == (value.strip() if isinstance(value, str) else value))


def evidence_of(evidence: DataFrame, defect_id: str | None = None) -> DataFrame:
    """Evidence by defect, time and id."""
    rows = evidence if defect_id is None else get(evidence, "defect_id", defect_id)
    return rows.orderBy("defect_id", "timestamp", "evidence_id")


def recent_inspections(inspections: DataFrame) -> DataFrame:
    return inspections.orderBy(F.col("started_at").desc(), F.col("inspection_id").desc())


def insert(table: DataFrame, new: DataFrame, key: str, parent: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """The table with new rows; fails if a key exists or repeats, or a parent is missing."""
    require_empty(new.groupBy(key).count().where("count > 1"), "repeated keys")
    require_empty(new.join(table.select(key), key, "left_semi"), "existing keys")
    if parent is not None:
        require_empty(new.join(parent.select(parent_key), parent_key, "left_anti"), "missing parents")
    return table.unionByName(new)


def upsert_machine_fields(table: DataFrame, new: DataFrame, key: str, machine: list[str]) -> DataFrame:
    """Rows of `new` replace the machine fields of known keys and keep all others (human review); unknown keys are left out."""
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in machine), F.lit(True).alias("__hit"))
    both = table.join(n, key, "left")
    return both.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in machine else F.col(c) for c in table.columns))


def set_review(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """(defect_id, status, notes) applied: the status always, notes only where given."""
    d = decisions.select("defect_id", F.col("status").alias("__s"), F.col("notes").alias("__n"))
    both = table.join(d, "defect_id", "left")
    cells = {"review_status": F.coalesce("__s", "review_status"), "review_notes": F.coalesce("__n", "review_notes")}
    return both.select(*(cells.get(c, F.col(c)).alias(c) for c in table.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parents.join(doomed.select(key).distinct(), key, "left_anti"), children.join(doomed.select(key).distinct(), key, "left_anti")


def delete_restrict(parents: DataFrame, children: DataFrame, key: str, doomed: DataFrame) -> DataFrame:
    require_empty(children.join(doomed.select(key), key, "left_semi"), "children exist")
    return parents.join(doomed.select(key).distinct(), key, "left_anti")


def inspection_report(structures: DataFrame, inspections: DataFrame, defects: DataFrame) -> DataFrame:
    """One row for each inspection with its structure and the numbers of its defects; inspections without defects count 0."""
    own = defects.dropDuplicates(["defect_id"])
    counts = own.groupBy("inspection_id").agg(
        F.count("*").alias("defects"), *(F.count_if(F.col("review_status") == s).alias(s.lower()) for s in REVIEW_STATUSES),
        F.max("confidence").alias("max_confidence"), F.array_join(F.array_sort(F.collect_set("model_version")), ", ").alias("model_versions"),
    )
    zero = ["defects", *(s.lower() for s in REVIEW_STATUSES)]
    rows = inspections.join(structures.select("structure_id", F.trim("name").alias("structure")), "structure_id").join(counts, "inspection_id", "left").fillna(0, zero)
    return rows.select("inspection_id", "structure", "status", *zero, "max_confidence", F.coalesce("model_versions", F.lit("Unavailable")).alias("model_versions"))


def full_report(structures: DataFrame, inspections: DataFrame, defects: DataFrame, evidence: DataFrame, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(reports, issues): one row for each inspection with its structure and nested defects, each with its evidence by time and id.

    Rows: inspection_id, structure (struct), started_at, status, defects (array by defect_id), rest. A row nests at most
    `most` defects and as many pieces of evidence of each; `rest` counts the defects beyond, which are all in `defects` and
    `evidence` themselves. issues: (table, id, code): unknown_structure,
    unknown_inspection, unknown_defect, id_repeats.
    """
    many = lambda df, k, name: df.groupBy(F.col(k).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table"), "id", F.lit("id_repeats").alias("code"))
    lost = lambda df, k, parent, pk, name, code: df.join(parent.select(F.col(pk).alias("__p")).distinct(), F.col(pk) == F.col("__p"), "left_anti").select(F.lit(name).alias("table"), F.col(k).cast("string").alias("id"), F.lit(code).alias("code"))
    issues = (
        lost(inspections, "inspection_id", structures, "structure_id", "inspections", "unknown_structure")
        .unionByName(lost(defects, "defect_id", inspections, "inspection_id", "defects", "unknown_inspection"))
        .unionByName(lost(evidence, "evidence_id", defects, "defect_id", "evidence", "unknown_defect"))
        .unionByName(many(structures, "structure_id", "structures")).unionByName(many(inspections, "inspection_id", "inspections"))
        .unionByName(many(defects, "defect_id", "defects")).unionByName(many(evidence, "evidence_id", "evidence"))
    )
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    proof = evidence.withColumn("k", nth("defect_id", "timestamp", "evidence_id")).where(F.col("k") <= most)
    proof = proof.groupBy("defect_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence_id", "frame_id", "timestamp", "confidence"))), lambda x: x.dropFields("k")).alias("evidence"))
    own = defects.dropDuplicates(["defect_id"])
    ranked = own.withColumn("k", nth("inspection_id", "defect_id"))
    nested = ranked.where(F.col("k") <= most).join(proof, "defect_id", "left")
    cell = F.struct("defect_id", "class_name", "confidence", "review_status", F.coalesce("evidence", F.array().cast(dict(proof.dtypes)["evidence"])).alias("evidence"))
    per = nested.groupBy("inspection_id").agg(F.array_sort(F.collect_list(cell), lambda a, b: F.when(a["defect_id"] < b["defect_id"], -1).when(a["defect_id"] > b["defect_id"], 1).otherwise(0)).alias("defects"))
    beyond = own.groupBy("inspection_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("rest"))
    s = structures.select("structure_id", F.struct("structure_id", F.trim("name").alias("name"), F.coalesce(F.nullif(F.trim("location_text"), F.lit("")), F.lit("Unavailable")).alias("location")).alias("structure"))
    rows = inspections.join(s, "structure_id").join(per, "inspection_id", "left").join(beyond, "inspection_id", "left")
    return rows.select("inspection_id", "structure", "started_at", "status", F.coalesce("defects", F.array().cast(dict(per.dtypes)["defects"])).alias("defects"), F.coalesce("rest", F.lit(0)).alias("rest")), issues


def dashboard_rows(defects: DataFrame) -> DataFrame:
    """Ten columns to show, by defect_id: three decimals of confidence, N/A for what is missing."""
    shown = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("N/A")).alias(c)
    number = lambda c, n: F.when(F.isnan(c) | F.col(c).isNull(), "N/A").otherwise(F.format_string(f"%.{n}f", F.col(c))).alias(c)
    return defects.select("defect_id", "inspection_id", shown("track_id"), shown("class_name"), number("confidence", 3), number("x_m", 2), number("y_m", 2), number("z_m", 2), "observation_count", shown("review_status")).orderBy("defect_id")


def review_counts(defects: DataFrame) -> DataFrame:
    """(status, defects) of every status, zeros kept."""
    return category_counts(defects.dropDuplicates(["defect_id"]).select(F.array("review_status").alias("s")), "s", list(REVIEW_STATUSES)).select(F.col("category").alias("status"), F.col("n").alias("defects"))


def fused_records(decisions: DataFrame, defects: DataFrame, observations: DataFrame, classes: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(defect records, evidence rows) of a fusion: machine fields of each defect, and one piece of evidence for each observation that was no replay."""
    name = F.element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), F.col("class_id"))
    records = defects.select("defect_id", "inspection_id", "track_id", name.alias("class_name"), "confidence", "x_m", "y_m", "z_m", F.lit("map").alias("coordinate_frame"), "observation_count", "first_seen", "last_seen", F.lit("UNREVIEWED").alias("review_status"))
    new = decisions.where("decision in ('CREATED', 'ASSOCIATED')").select("seq", "inspection_id", "observation_id", "defect_id")
    proof = new.join(observations.select("seq", "inspection_id", "observation_id", "confidence", "ts").dropDuplicates(["seq", "inspection_id", "observation_id"]), ["seq", "inspection_id", "observation_id"])
    return records, proof.select("defect_id", F.col("observation_id").alias("frame_id"), F.col("ts").alias("timestamp"), "confidence")

"""Row validators: rule codes for every row, accepted and rejected rows, fail-closed assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions.scalars import finite, identifier_ok


class ValidationError(ValueError):
    """Rows break rules that the caller declared binding."""


def with_codes(df: DataFrame, rules: dict[str, Column], column: str = "codes") -> DataFrame:
    """Adds the codes of the rules (conditions that must hold) each row breaks; an unknown condition counts as broken."""
    return df.withColumn(column, F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()))))


def split_valid(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with codes); strict raises if any row is rejected."""
    coded = with_codes(df, rules)
    rejected = coded.where(F.size("codes") > 0)
    if strict and not rejected.isEmpty():
        raise ValidationError(f"rejected rows: {rejected.limit(3).collect()}")
    return coded.where(F.size("codes") == 0).drop("codes"), rejected


def issue_status(issues: Column) -> Column:
    """invalid if any issue is an error, warning if any is a warning, else valid. `issues`: array of structs with severity."""
    has = lambda s: F.exists(issues, lambda x: x["severity"] == s)
    return F.when(has("error"), "invalid").when(has("warning"), "warning").otherwise("valid")


def defect_rules() -> dict[str, Column]:
    """What a stored defect must satisfy."""
    c = F.col
    return {
        "defect_id": identifier_ok(c("defect_id")),
        "inspection_id": c("inspection_id") > 0,
        "confidence": (c("confidence") >= 0) & (c("confidence") <= 1),
        "position": finite(c("x_m")) & finite(c("y_m")) & finite(c("z_m")),
        "frame": c("coordinate_frame") == "map",
        "observation_count": c("observation_count") >= 1,
        "seen_order": c("first_seen") <= c("last_seen"),
        "audit_order": c("created_at") <= c("updated_at"),
        "class_name": identifier_ok(c("class_name")),
        "model_version": identifier_ok(c("model_version")),
    }


def _text(c: str, optional: bool = False) -> Column:
    """Not blank; or, if optional, null too."""
    ok = F.coalesce(F.trim(c) != "", F.lit(False))
    return F.col(c).isNull() | ok if optional else ok


def structure_rules() -> dict[str, Column]:
    return {"name": _text("name"), "description": F.col("description").isNotNull(), "location_text": _text("location_text", True)}


def inspection_rules(statuses: tuple[str, ...]) -> dict[str, Column]:
    """What a stored inspection must satisfy; a run that isn't over has no end."""
    c = F.col
    return {
        "structure_id": c("structure_id") > 0, "started_at": c("started_at").isNotNull(), "completed_order": c("completed_at").isNull() | (c("completed_at") >= c("started_at")),
        "status": c("status").isin(*statuses), "system_version": _text("system_version"), "notes": _text("notes", True),
    }


def evidence_rules() -> dict[str, Column]:
    """What a piece of evidence must satisfy: ids, a time, a confidence and an ordered box from 0 up."""
    c = F.col
    return {
        "defect_id": _text("defect_id"), "frame_id": _text("frame_id"), "timestamp": c("timestamp").isNotNull(), "confidence": c("confidence").between(0, 1) & ~F.isnan("confidence"),
        "box": finite(c("x1")) & finite(c("y1")) & finite(c("x2")) & finite(c("y2")) & (c("x1") >= 0) & (c("y1") >= 0) & (c("x2") > c("x1")) & (c("y2") > c("y1")),
    }


def observation_rules(classes: dict[int, str], model_version: str) -> dict[str, Column]:
    """What a mapped observation must satisfy before it may be fused."""
    c = F.col
    name = F.element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), c("class_id"))
    return {
        "inspection_id": c("inspection_id") > 0,
        "observation_id": identifier_ok(c("observation_id")),
        "detection_id": c("detection_id") == c("observation_id"),
        "track_id": c("track_id").isNull() | identifier_ok(c("track_id")),
        "class_id": c("class_id").isin(*classes),
        "class_name": c("class_name") == name,
        "confidence": c("confidence").between(0, 1) & ~F.isnan("confidence"),
        "position": finite(c("x_m")) & finite(c("y_m")) & finite(c("z_m")),
        "frame": c("coordinate_frame") == "map",
        "timestamp": c("ts").isNotNull(),
        "image_size": (c("image_width") > 0) & (c("image_height") > 0),
        "box_x": (c("x1") >= 0) & (c("x1") < c("x2")) & (c("x2") <= c("image_width")),
        "box_y": (c("y1") >= 0) & (c("y1") < c("y2")) & (c("y2") <= c("image_height")),
        "model_version": c("model_version") == model_version,
    }


def aggregate_issues(defects: DataFrame, members: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(defect_id, code) of fused defects that don't agree with their observations: observation_count, first_seen, last_seen, track_id, position, or no_observations.

    defects and members as fusion.fuse and fusion.defect_table give and take them.
    """
    from spanwise.operators.fusion import defect_table

    want = defect_table(members)
    w = want.select("defect_id", *(F.col(c).alias(f"w_{c}") for c in want.columns if c != "defect_id"))
    both = defects.join(w, "defect_id", "left")
    near = lambda c: F.abs(F.col(c) - F.col(f"w_{c}")) <= tolerance
    known = F.col("w_observation_count").isNotNull()
    codes = {
        "no_observations": ~known, "observation_count": known & (F.col("observation_count") != F.col("w_observation_count")), "first_seen": known & (F.col("first_seen") != F.col("w_first_seen")),
        "last_seen": known & (F.col("last_seen") != F.col("w_last_seen")), "track_id": known & ~F.col("track_id").eqNullSafe(F.col("w_track_id")), "position": known & ~(near("x_m") & near("y_m") & near("z_m")),
    }
    return both.select("defect_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items())))).alias("code"))


def registry_issues(defects: DataFrame, registry: DataFrame) -> DataFrame:
    """(observation_id, defect_id, code) of a registry of seen observations: unknown_defect, fingerprint (not 64 hex digits), repeats."""
    from spanwise.functions.scalars import digest_ok

    many = registry.groupBy("inspection_id", "observation_id").agg(F.count("*").alias("times"))
    known = defects.select("defect_id", F.lit(True).alias("known")).distinct()
    rows = registry.join(many, ["inspection_id", "observation_id"]).join(known, "defect_id", "left")
    codes = {"unknown_defect": F.col("known").isNull(), "fingerprint": ~digest_ok(F.col("fingerprint")), "repeats": F.col("times") > 1}
    return rows.select("observation_id", "defect_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items())))).alias("code"))


def detection_issues(images: DataFrame, predictions: DataFrame, regions: DataFrame, classes: list[int]) -> DataFrame:
    """(record, id, code) of detection records that break the rules.

    images: (image_id); predictions: (id, image_id, class_id, confidence, x1, y1, x2, y2);
    regions: (id, image_id, labels, x1, ...). Codes: id_repeats, unknown_image, box, class, confidence, labels
    (none, a repeated or an unknown one); record is 'prediction' or 'region'.
    """
    known = images.select("image_id", F.lit(True).alias("known")).distinct()
    c = F.col
    box = finite(c("x1")) & finite(c("y1")) & finite(c("x2")) & finite(c("y2")) & (c("x1") >= 0) & (c("x1") < c("x2")) & (c("y1") >= 0) & (c("y1") < c("y2"))
    named = F.array(*map(F.lit, classes))
    own = {
        "prediction": {"class": c("class_id").isin(*classes), "confidence": c("confidence").between(0, 1) & ~F.isnan("confidence")},
        "region": {"labels": (F.size("labels") > 0) & (F.size(F.array_distinct("labels")) == F.size("labels")) & (F.size(F.array_except("labels", named)) == 0)},
    }
    out = None
    for record, rows in (("prediction", predictions), ("region", regions)):
        many = rows.groupBy("id").agg(F.count("*").alias("times"))
        rows = rows.join(many, "id", "left").join(known, "image_id", "left")
        rules = {"id_repeats": F.coalesce(c("times"), F.lit(1)) == 1, "id": c("id").isNotNull(), "unknown_image": c("known").isNotNull(), "box": box, **own[record]}
        coded = with_codes(rows, rules).select(F.lit(record).alias("record"), "id", F.explode("codes").alias("code"))
        out = coded if out is None else out.unionByName(coded)
    return out


def export_issues(predictions: DataFrame, metadata: DataFrame, classes: dict[int, str], most: int, floor: float) -> DataFrame:
    """(image_id, id, code) of exported predictions: unknown_image, size_differs, beyond_image, class_name, below_floor; and too_many (id null) for images with over `most`.

    predictions also hold class_name, original_width and original_height; metadata: (image_id, original_width, original_height).
    """
    c = F.col
    m = metadata.select("image_id", c("original_width").alias("mw"), c("original_height").alias("mh")).dropDuplicates(["image_id"])
    name = F.element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), c("class_id"))
    rules = {
        "unknown_image": c("mw").isNotNull(), "size_differs": c("mw").isNull() | ((c("original_width") == c("mw")) & (c("original_height") == c("mh"))),
        "beyond_image": (c("x2") <= c("original_width")) & (c("y2") <= c("original_height")), "class_name": c("class_name") == name, "below_floor": c("confidence") >= floor,
    }
    rows = with_codes(predictions.join(m, "image_id", "left"), rules).select("image_id", c("id").cast("string").alias("id"), F.explode("codes").alias("code"))
    many = predictions.groupBy("image_id").agg(F.count("*").alias("n")).where(c("n") > most)
    return rows.unionByName(many.select("image_id", F.lit(None).cast("string").alias("id"), F.lit("too_many").alias("code")))


def consistency_issues(rows: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, code) of rows whose fields differ from their reference row's (code is the field; null equals null) or that have none (missing)."""
    r = reference.select(key, F.struct(*fields).alias("__r")).dropDuplicates([key])
    both = rows.join(r, key, "left")
    codes = [F.when(F.col("__r").isNull(), "missing")] + [F.when(F.col("__r").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__r.{f}")), f) for f in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def mapped_labels(rows: DataFrame, mapping: DataFrame, external_only: list[str]) -> DataFrame:
    """Adds class_ids (sorted, each once), excluded (sorted labels without an approved class) and unknown (labels that no table names).

    rows: with `labels`, an array of names; mapping: (label, class_id, status), a
    settings table; only 'approved' rows map. It is read into the plan.
    """
    table = mapping.select("label", "class_id", "status").collect()  # the ontology: one row for each label
    approved = [(r.label, r.class_id) for r in table if r.status == "approved" and r.label is not None]
    known = F.array(*(F.lit(x) for x in sorted({r.label for r in table if r.label is not None} | set(external_only))))
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in approved)), F.array(*(F.lit(v).cast("int") for _, v in approved)))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("labels", lambda x: F.try_element_at(pairs, x)))))
    without = F.filter(F.array_distinct("labels"), lambda x: F.try_element_at(pairs, x).isNull())
    return rows.select("*", ids.alias("class_ids"), F.array_sort(F.array_intersect(without, known)).alias("excluded"), F.array_sort(F.array_except(without, known)).alias("unknown"))


def trajectory_rules(keys: list[str]) -> dict[str, Column]:
    """Finite pose, usable quaternion, known stamp; within `keys` stamps strictly increase and the frame is one."""
    c, w = F.col, Window.partitionBy(*keys)
    by_time = w.orderBy("timestamp_ns", "sample_id")
    square = sum(c(q) * c(q) for q in ("qx", "qy", "qz", "qw"))
    return {
        "stamp": c("timestamp_ns") > 0,
        "position": finite(c("x_m")) & finite(c("y_m")) & finite(c("z_m")),
        "quaternion": finite(square) & (square > 1e-24),
        "increasing": F.coalesce(c("timestamp_ns") > F.lag("timestamp_ns").over(by_time), F.lit(True)),
        "one_frame": F.min(F.coalesce("frame_id", F.lit(""))).over(w) == F.max(F.coalesce("frame_id", F.lit(""))).over(w),
    }


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number; must be empty for a unique key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables cover each other as bags."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def require_empty(df: DataFrame, what: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise ValidationError(f"{what}: {found}")


def contract_issues(record: dict, contract: dict) -> list[str]:
    """What a settings record breaks of its contract: missing and unknown keys, values that differ; a type as value stands for any of it (a bool is no int)."""
    out = [f"missing:{k}" for k in contract if k not in record] + [f"unknown:{k}" for k in record if k not in contract]
    for k in contract.keys() & record.keys():
        want, got = contract[k], record[k]
        fits = type(got) is want if isinstance(want, type) else type(got) is type(want) and got == want
        out += [] if fits else [f"differs:{k}"]
    return sorted(out)


def gates(rows: DataFrame, section: str, ok: Column) -> DataFrame:
    """(section, checks, passed): a section passes if all its checks do, 'all' if all sections do; an unknown outcome fails."""
    sure = F.coalesce(ok, F.lit(False))
    sets = rows.select(F.explode(F.array(F.col(section), F.lit("all"))).alias("section"), sure.alias("ok"))
    return sets.groupBy("section").agg(F.count("*").alias("checks"), F.bool_and("ok").alias("passed"))


def scored_classes(mapping: DataFrame) -> DataFrame:
    """(class_id): the classes that an approved label maps to, each once, in order."""
    return mapping.where("status = 'approved' and class_id is not null").select("class_id").distinct().orderBy("class_id")

"""Sources and sinks: CSV, JSON, Parquet, label and binary files, write-once outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanwise.functions.scalars import corners, finite
from spanwise.session import cut

_NESTED = ("array", "map", "struct")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV as text columns with an explicit schema; a byte order mark is dropped."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), encoding="UTF-8")


def write_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One ordered CSV file with LF ends, nested cells as JSON; an empty table is an error.

    A single file is for reports; whatever is large goes to Parquet.
    """
    if df.isEmpty():
        raise ValueError("no rows to write")
    cells = [F.to_json(c).alias(c) if kind.startswith(_NESTED) else F.col(c) for c, kind in df.dtypes]
    df.orderBy(*order).select(*cells).coalesce(1).write.mode(mode).option("lineSep", "\n").csv(path, header=True)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def write_manifest(df: DataFrame, path: str, split: str = "processed_split") -> None:
    """Parquet by split, sorted by path within each file."""
    df.repartition(split).sortWithinPartitions(split, "image_relative_path").write.partitionBy(split).mode("errorifexists").parquet(path)


def read_json_with_hash(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, sha256, document): content and hash of one and the same read."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), schema).alias("document"))


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Compact JSON text with sorted keys, nulls kept; NaN and infinity anywhere at the top level are an error."""
    kinds = dict(df.dtypes)
    odd = F.lit(False)
    for c in columns:
        if kinds[c] in ("double", "float"):
            odd = odd | F.coalesce(~finite(F.col(c)) & F.col(c).isNotNull(), F.lit(False))
        elif kinds[c] in ("array<double>", "array<float>"):
            odd = odd | F.coalesce(F.exists(c, lambda x: x.isNotNull() & ~finite(x)), F.lit(False))
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.when(odd, F.raise_error(F.lit("NaN and infinity have no JSON text"))).otherwise(text)


def directory(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(split, kind, filename, size, modified) of root/split/kind/file, by folded name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    rows = files.select(part(3).alias("split"), part(2).alias("kind"), part(1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(F.lower("filename").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + r")$")).orderBy("split", "kind", F.lower("filename"), "filename")


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, line): lines of label files, numbered from 1, blank ones left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where("trim(line) <> ''").select("file", (F.col("row") + 1).alias("row"), "line")


def parse_labels(rows: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """(boxes, issues) of label rows, leniently.

    Issue codes for each row: field_count, class_id, number, range, duplicate (equal tokens
    as an earlier row, a warning). `strict_files` then keeps files without errors.
    """
    f = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    x = rows.withColumn("f", f)
    num = lambda i: F.when(F.get("f", F.lit(i)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.get("f", F.lit(i)).try_cast("double"))
    x = x.select("file", "row", F.col("f"), F.when(F.get("f", F.lit(0)).rlike(r"^[0-9]+\z"), F.get("f", F.lit(0)).try_cast("int")).alias("class_id"), *(num(i + 1).alias(n) for i, n in enumerate(("x", "y", "width", "height"))))
    first = x.groupBy("file", "f").agg(F.min("row").alias("first"))
    x = x.join(first, ["file", "f"])
    ok_n = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    x1, y1, x2, y2 = corners(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    inside = (F.col("width") > 0) & (F.col("height") > 0) & (F.least(x1, y1) >= -1e-6) & (F.greatest(x2, y2) <= 1 + 1e-6)
    code = (
        F.when(F.size("f") != 5, "field_count").when(~F.coalesce(F.col("class_id") < classes, F.lit(False)), "class_id")
        .when(~ok_n, "number").when(~F.coalesce(inside, F.lit(False)), "range")
    )
    issues = F.array_compact(F.array(F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit("error").alias("severity"))), F.when(F.col("row") > F.col("first"), F.struct(F.lit("duplicate").alias("code"), F.lit("warning").alias("severity")))))
    x = x.withColumn("issues", issues)
    found = x.where(F.size("issues") > 0).select("file", "row", F.explode("issues").alias("i")).select("file", "row", "i.*")
    return x.where(code.isNull()).select("file", "row", "class_id", "x", "y", "width", "height"), found


def strict_files(boxes: DataFrame, issues: DataFrame) -> DataFrame:
    """Boxes of files in which no row is in error."""
    return boxes.join(issues.where("severity = 'error'").select("file").distinct(), "file", "left_anti")


def annotated_regions(documents: DataFrame) -> DataFrame:
    """(image_id, position, category, x1, y1, x2, y2) of documents (image_id, annotations array<struct<category:int, bbox:array<double>>>) with x, y, w, h boxes."""
    a = documents.select("image_id", F.posexplode("annotations").alias("position", "a"))
    b = lambda i: F.col("a.bbox")[i]
    return a.select("image_id", "position", F.col("a.category").alias("category"), b(0).alias("x1"), b(1).alias("y1"), (b(0) + b(2)).alias("x2"), (b(1) + b(3)).alias("y2"))


def normalised_predictions(arrays: DataFrame) -> DataFrame:
    """One row for each detection of (image_id, class_ids, confidences, boxes), with dense ids over image, class, falling confidence, box.

    Arrays of unequal length are an error; with columns width and height, so are boxes beyond them.

    Ids come from counts of images, summed in order, and ranks within an image, so no global sort meets in one task.
    """
    even = (F.size("class_ids") == F.size("confidences")) & (F.size("class_ids") == F.size("boxes"))
    if {"width", "height"} <= set(arrays.columns):
        x = lambda b, i: F.get(b, F.lit(i))
        inside = lambda b: F.coalesce((x(b, 0) >= 0) & (x(b, 0) < x(b, 2)) & (x(b, 2) <= F.col("width")) & (x(b, 1) >= 0) & (x(b, 1) < x(b, 3)) & (x(b, 3) <= F.col("height")), F.lit(False))
        even = even & F.forall("boxes", inside)
    arrays = arrays.withColumn("boxes", F.when(even, F.col("boxes")).otherwise(F.raise_error(F.lit("uneven arrays or a box beyond its picture"))))
    rows = arrays.select("image_id", F.explode(F.arrays_zip("class_ids", "confidences", "boxes")).alias("d")).select("image_id", F.col("d.class_ids").alias("class_id"), F.col("d.confidences").alias("confidence"), F.col("d.boxes").alias("box"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("class_id", F.col("confidence").desc(), "box")))
    counts = rows.groupBy("image_id").agg(F.count("*").alias("n"))
    bucketed = counts.repartitionByRange("image_id").sortWithinPartitions("image_id").select("image_id", "n", F.spark_partition_id().alias("p"))
    bucketed = cut(bucketed)
    before = bucketed.groupBy("p").agg(F.sum("n").alias("s")).select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("p0"))
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("image_id")) - F.col("n")
    starts = bucketed.withColumn("in_p", inside).join(before, "p").select("image_id", (F.col("p0") + F.col("in_p")).alias("start"))
    return rows.join(starts, "image_id").select(F.format_string("prediction-%09d", F.col("start") + F.col("k") - 1).alias("id"), "image_id", "class_id", "confidence", "box")


def export_state(defects: DataFrame, path: str) -> None:
    defects.write.mode("errorifexists").json(path)


def import_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def inventory(spark: SparkSession, root: str, hashed: DataFrame | None = None) -> DataFrame:
    """(path, size, modified, sha256) of every file below root; contents are read only of the paths in `hashed` (path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if hashed is None:
        return out.withColumn("sha256", F.lit(None).cast("string"))
    own = [r.path for r in hashed.select("path").distinct().collect()]  # the files to read, named one by one
    sums = spark.read.format("binaryFile").load(own).select("path", F.sha2("content", 256).alias("sha256")) if own else out.select("path", F.lit(None).cast("string").alias("sha256")).limit(0)
    return out.join(sums, "path", "left")


def ragged_rows(values: DataFrame, offsets: DataFrame) -> DataFrame:
    """(image, k, value) of ragged arrays: values (position, value) and offsets (image, start, stop), half open.

    Slices that overlap or leave positions out are allowed; empty ones give no row.
    A slice is listed position by position, so the join is one by equality.
    """
    wanted = offsets.where("stop > start").select("image", "start", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("position"))
    return wanted.join(values, "position").select("image", (F.col("position") - F.col("start")).alias("k"), "value")


def reconciled_annotations(documents: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, regions, boxes, status): annotated documents against label rows of the same images.

    Status: equal, count_differs, class_differs (equal numbers, other classes), or only_documents and only_labels.
    documents: (image_id, annotations); boxes: (image_id, class_id).
    """
    d = documents.select("image_id", F.size("annotations").alias("regions"), F.array_sort(F.transform("annotations", lambda a: a["category"])).alias("dc"))
    b = boxes.groupBy("image_id").agg(F.count("*").cast("int").alias("boxes"), F.array_sort(F.collect_list("class_id")).alias("bc"))
    both = d.join(b, "image_id", "full_outer")
    status = F.when(F.col("bc").isNull(), "only_documents").when(F.col("dc").isNull(), "only_labels").when(F.col("regions") != F.col("boxes"), "count_differs").when(F.col("dc") != F.col("bc"), "class_differs").otherwise("equal")
    return both.select("image_id", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("boxes", F.lit(0)).alias("boxes"), status.alias("status"))


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Long rows of one batch, in a folder of its own below path; a batch that comes again replaces itself, others stay."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): one row that tells whether two tables hold the same rows in any order, repeated ones counted; columns are taken by name."""
    parts = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in sorted(df.columns)]
    whole = F.sha2(F.concat_ws("\x1f", *parts), 256)
    halves = [F.conv(F.substring(whole, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16)]
    sums = [F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string") for h in halves]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("/", *sums), 256).alias("digest"))


def bundle(predictions: DataFrame, regions: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(kind, image_id, id, class_ids, confidence, x1, y1, x2, y2): predictions and regions as one table, once their digests are those of the contract (names 'predictions' and 'regions')."""
    for name, rows in (("predictions", predictions), ("regions", regions)):
        if table_digest(rows).first().digest != expected[name]:
            raise ValueError(f"{name} aren't those of the contract")
    box = ("x1", "y1", "x2", "y2")
    p = predictions.select(F.lit("prediction").alias("kind"), "image_id", F.col("id").cast("string").alias("id"), F.array("class_id").alias("class_ids"), "confidence", *box)
    r = regions.select(F.lit("region").alias("kind"), "image_id", F.col("id").cast("string").alias("id"), F.col("labels").alias("class_ids"), F.lit(None).cast("double").alias("confidence"), *box)
    return p.unionByName(r)

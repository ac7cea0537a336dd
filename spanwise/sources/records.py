"""Inspection records kept in a folder: versioned Parquet tables with keys, parents and rules, changed one version at a time.

Every change writes the table's next version whole and then claims its number
by creating a marker file that must not exist yet. A reader takes the
highest claimed version, so it sees a change wholly or not at all; of
two writers that started from one version the second fails and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanwise.operators import store, validate
from spanwise.session import cut

#: The four tables and what they hold.
SCHEMAS = {
    "structures": "structure_id bigint, name string, description string, location_text string, created_at timestamp",
    "inspections": "inspection_id bigint, structure_id bigint, started_at timestamp, completed_at timestamp, status string, system_version string, notes string",
    "defects": (
        "defect_id string, inspection_id bigint, track_id string, class_name string, confidence double, x_m double, y_m double, z_m double, coordinate_frame string, observation_count int, "
        "first_seen timestamp, last_seen timestamp, model_version string, review_status string, review_notes string, created_at timestamp, updated_at timestamp"
    ),
    "evidence": "evidence_id bigint, defect_id string, frame_id string, timestamp timestamp, confidence double, x1 double, y1 double, x2 double, y2 double",
}
KEYS = {"structures": "structure_id", "inspections": "inspection_id", "defects": "defect_id", "evidence": "evidence_id"}
PARENTS = {"inspections": ("structures", "structure_id"), "defects": ("inspections", "inspection_id"), "evidence": ("defects", "defect_id")}
STATES = ("PLANNED", "RUNNING", "PROCESSING", "REVIEW", "COMPLETED", "FAILED")
#: What a detector may change; all else is human review or identity.
MACHINE = ("track_id", "class_name", "confidence", "x_m", "y_m", "z_m", "observation_count", "first_seen", "last_seen", "model_version", "updated_at")


class VersionConflict(RuntimeError):
    """Another writer changed the table meanwhile."""


def dense_ids(rows: DataFrame, order: list[str], column: str, start: int = 0) -> DataFrame:
    """Adds whole numbers from `start` on in the given order, which is total: rows are range-sorted and counted by partition, never sorted in one task."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.join(F.broadcast(before), "__p").withColumn(column, (F.lit(start - 1) + F.col("__before") + own).cast("bigint")).drop("__p", "__before")


class RecordStore:
    """Structures, inspections, defects and evidence below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claimed(self, table: str) -> list[int]:
        path, fs = self._fs(f"{self.root}/_versions/{table}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self, table: str) -> int:
        """The highest version that is claimed and in place, 0 before the first."""
        for n in reversed(self._claimed(table)):
            path, fs = self._fs(f"{self.root}/{table}/v{n}")
            if fs.exists(path):
                return n
        return 0

    def abandon(self, table: str) -> None:
        """Give up a version that its writer claimed but never put in place (it was lost in between)."""
        for n in self._claimed(table):
            if n > self.version(table):
                path, fs = self._fs(f"{self.root}/_versions/{table}/{n}")
                fs.delete(path, False)

    def table(self, name: str) -> DataFrame:
        n = self.version(name)
        if not n:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{n}")

    def _commit(self, name: str, rows: DataFrame, base: int) -> None:
        """Write the version after `base`; fails if it has been claimed, be it in place or not."""
        if max(self._claimed(name), default=0) != base:
            raise VersionConflict(name)
        n = base + 1
        token = self.spark._jvm.java.util.UUID.randomUUID().toString()
        draft = f"{self.root}/{name}/.draft-{token}"
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("errorifexists").parquet(draft)
        path, fs = self._fs(f"{self.root}/_versions/{name}/{n}")
        try:
            fs.create(path, False).close()
        except Exception as e:
            self._fs(draft)[1].delete(self._fs(draft)[0], True)
            raise VersionConflict(name) from e
        fs.rename(self._fs(draft)[0], self._fs(f"{self.root}/{name}/v{n}")[0])

    def _add(self, name: str, rows: DataFrame, rules: dict) -> None:
        validate.split_valid(rows, rules, strict=True)
        base, old = self.version(name), self.table(name)
        new = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMAS[name].split(", "))))
        parent = PARENTS.get(name)
        self._commit(name, store.insert(old, new, KEYS[name], self.table(parent[0]) if parent else None, parent[1] if parent else None), base)

    def _numbered(self, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        last = self.table(name).agg(F.max(KEYS[name])).first()[0] or 0
        return dense_ids(rows, order, KEYS[name], last + 1)

    # Structures and inspections: ids go on from the highest.
    def create_structures(self, rows: DataFrame) -> DataFrame:
        """rows: (name, description, location_text), names unique among them; returns them with their ids."""
        new = cut(self._numbered("structures", rows, ["name"]).withColumn("created_at", F.current_timestamp()))
        self._add("structures", new, validate.structure_rules())
        return new

    def create_inspections(self, rows: DataFrame) -> DataFrame:
        """rows: (structure_id, started_at, ...), a structure's starts unique among them; returns them with their ids."""
        new = cut(self._numbered("inspections", rows, ["structure_id", "started_at"]))
        self._add("inspections", new, validate.inspection_rules(STATES))
        return new

    def get_structure(self, structure_id: int) -> DataFrame:
        return store.get(self.table("structures"), "structure_id", structure_id)

    def get_inspection(self, inspection_id: int) -> DataFrame:
        return store.get(self.table("inspections"), "inspection_id", inspection_id)

    def list_inspections(self) -> DataFrame:
        return store.recent_inspections(self.table("inspections"))

    # Defects: new ones are unreviewed; updates leave what people decided.
    def ingest_defects(self, rows: DataFrame) -> None:
        now = F.current_timestamp()
        self._add("defects", rows.withColumn("review_status", F.lit("UNREVIEWED")).withColumn("created_at", now).withColumn("updated_at", now), validate.defect_rules())

    def update_defects(self, rows: DataFrame) -> None:
        """New machine fields of known defects; unknown ones and a change of inspection are errors."""
        base, old = self.version("defects"), self.table("defects")
        validate.require_empty(rows.join(old.select("defect_id", F.col("inspection_id").alias("__i")), "defect_id", "left").where("__i is null or __i <> inspection_id"), "unknown defects or another inspection")
        new = store.upsert_machine_fields(old, rows.withColumn("updated_at", F.current_timestamp()), "defect_id", list(MACHINE))
        validate.split_valid(new, validate.defect_rules(), strict=True)
        self._commit("defects", new, base)

    def set_review(self, decisions: DataFrame) -> None:
        """(defect_id, status, notes): known defects and statuses only."""
        base, old = self.version("defects"), self.table("defects")
        validate.require_empty(decisions.where(~F.coalesce(F.col("status").isin(*store.REVIEW_STATUSES), F.lit(False))), "unknown statuses")
        validate.require_empty(decisions.join(old, "defect_id", "left_anti"), "unknown defects")
        self._commit("defects", store.set_review(old, decisions), base)

    def get_defect(self, defect_id: str) -> DataFrame:
        return store.get(self.table("defects"), "defect_id", defect_id)

    def list_defects(self, **conditions) -> DataFrame:
        return store.find_defects(self.table("defects"), **conditions)

    def add_evidence(self, rows: DataFrame) -> DataFrame:
        """rows: (defect_id, frame_id, timestamp, confidence, x1, y1, x2, y2), a frame's boxes of a defect unique, also against those kept."""
        same = ["defect_id", "frame_id", "x1", "y1", "x2", "y2"]
        validate.require_empty(validate.duplicate_keys(rows.select(*same).unionByName(self.table("evidence").select(*same)), *same), "repeated evidence")
        new = cut(self._numbered("evidence", rows, same))
        self._add("evidence", new, validate.evidence_rules())
        return new

    def list_evidence(self, defect_id: str) -> DataFrame:
        return store.evidence_of(self.table("evidence"), defect_id)

    def delete_inspections(self, ids: DataFrame) -> None:
        """Inspections with their defects and evidence, children first, so that no child is ever without its parent."""
        versions = {t: self.version(t) for t in ("inspections", "defects", "evidence")}
        inspections, defects = store.delete_cascade(self.table("inspections"), self.table("defects"), "inspection_id", ids)
        doomed = self.table("defects").join(ids.select("inspection_id").distinct(), "inspection_id", "left_semi")
        kept = self.table("evidence").join(doomed.select("defect_id").distinct(), "defect_id", "left_anti")
        for name, rows in (("evidence", kept), ("defects", defects), ("inspections", inspections)):
            self._commit(name, cut(rows), versions[name])

    def delete_structures(self, ids: DataFrame) -> None:
        """Structures without inspections; others are kept back by an error."""
        base = self.version("structures")
        self._commit("structures", store.delete_restrict(self.table("structures"), self.table("inspections"), "structure_id", ids), base)

    def report(self) -> tuple[DataFrame, DataFrame]:
        """Reports and what stands in their way; see store.full_report."""
        return store.full_report(*(self.table(t) for t in SCHEMAS))

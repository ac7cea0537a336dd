"""Known answers and refusals of the audits, validators, camera, stores and streams."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise import session
from spanwise.functions import scalars as X
from spanwise.operators import camera as C, detection as D, fusion as U, graph, inventory as I, proximity as P, stats as S, store, trajectory as T, validate as V
from spanwise.sources import files
from spanwise.streaming import fusion_stream as FS


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_pairing_keeps_every_file(spark):
    images = spark.createDataFrame([("train", "a", "a.jpg"), ("train", "b", "b.jpg"), ("train", "b", "B.jpg"), ("train", "c", "c.jpg"), ("train", "c", "C.jpg"), ("valid", None, "x.jpg")], "split string, key string, image string")
    labels = spark.createDataFrame([("train", "a", "a.txt"), ("train", "b", "b.txt"), ("valid", "c", "c.txt")], "split string, key string, label string")
    got = {(r.image or r.label, r.status) for r in I.pair_unique(images, labels, ["split", "key"]).collect()}
    assert got == {("a.jpg", "exact_pair"), ("b.jpg", "ambiguous"), ("B.jpg", "ambiguous"), ("b.txt", "ambiguous"), ("c.jpg", "image_without_label"), ("C.jpg", "image_without_label"), ("x.jpg", "image_without_label"), ("c.txt", "label_without_image")}
    free = spark.createDataFrame([("train", "c", "c.jpg"), ("train", "z", "z.jpg")], "split string, key string, name string")
    told = I.found_elsewhere(free, labels.withColumnRenamed("label", "name"))
    assert {(r.key, r.elsewhere) for r in told.collect()} == {("c", "valid/c.txt"), ("z", "")}
    assert {(r.key, r.classification) for r in I.classify_unmatched(told, spark.createDataFrame([("train", "z")], "split string, key string")).collect()} == {("c", "unexplained_missing_label"), ("z", "expected_negative_external_evidence")}
    assert I.pair_unique(images.limit(0), labels.limit(0), ["split", "key"]).count() == 0


def test_fuzzy_scopes_and_blocks(spark):
    left = spark.createDataFrame([(1, "train", "12"), (2, "valid", None)], "left_id long, left_split string, left_name string")
    right = spark.createDataFrame([(7, "train", "13"), (8, "valid", "12"), (9, "train", "99"), (10, "test", None)], "right_id long, right_split string, right_name string")
    for block in (1_000, 1):
        got = {(r.scope, r["rank"], r.right_id) for r in I.fuzzy_candidates(left, right, 2, block).collect()}
        assert got == {("all_splits", 1, 8), ("all_splits", 2, 7), ("same_split", 1, 7), ("same_split", 2, 9)}
    cached = spark.createDataFrame([(1, "train", "99", 0)], "left_id long, right_split string, right_name string, distance int")
    taken = spark.createDataFrame([], "split string, key string")
    got = [(r.right_id, r.distance, r.reason) for r in I.rerank_unmatched(left, right, taken, cached, top=1).orderBy("rank").collect()]
    assert got == [(9, 0, "top"), (7, 1, "numeric_neighbour")]  # the known distance counts
    assert I.fuzzy_candidates(left.limit(0), right).count() == 0


LABELS = "record long, split string, path string, eligible boolean, duplicate string, ids array<int>"


@pytest.mark.parametrize(
    "labels, verdict",
    [([None, None], "NO_LABELS"), ([[1], None], "ONLY_ONE_LABELED_COPY"), ([[1, 2], [1, 2]], "IDENTICAL_ANNOTATIONS"), ([[1, 2], [2, 1], None], "REORDERED_EQUIVALENT_ANNOTATIONS"), ([[1], [2], None], "CONFLICTING_ANNOTATIONS"), ([[1]], "IDENTICAL_ANNOTATIONS")],
)
def test_annotation_verdicts(spark, labels, verdict):
    df = spark.createDataFrame([("g", x) for x in labels], "g string, ids array<int>")
    assert [r.verdict for r in graph.annotation_consistency(df, "g", F.col("ids")).collect()] == [verdict]


def test_linked_groups_around_a_hub(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 320)] + [(199, 300)]
    got = dict(graph.linked_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b", hot_rows=20).collect())
    assert got == {k: 0 for k in [*range(200), *range(300, 321)]}


def test_split_proposal_rules(spark):
    data = [
        (1, "train", "b", True, "D1", [1]), (2, "test", "c", True, "D1", [1]), (3, "valid", "a", False, "D1", [1]),  # the test copy stays
        (4, "train", "d", True, "D2", [1]), (5, "train", "e", True, "D2", [2]),  # conflict: both are held
        (6, "train", "f", True, None, None), (7, "valid", "g", True, None, None), (8, "test", "h", False, None, None),  # linked through 8, which doesn't count
        (9, "other", "i", True, None, None), (10, "train", "j", True, None, None),
    ]
    links = spark.createDataFrame([(6, 8), (8, 7), (2, 10)], "a long, b long")
    got = {r.record: (r.included, r.proposed_split, r.reason) for r in graph.propose_split(spark.createDataFrame(data, LABELS), links, F.col("ids")).collect()}
    dup, other, held = "EQUIVALENT_EXACT_DUPLICATE_REDUNDANT", "APPROVED_LEAKAGE_GROUP_OTHER_SPLIT_RETAINED", "ANNOTATION_CONFLICT_HUMAN_REVIEW_REQUIRED"
    assert got == {
        1: (False, None, dup), 2: (True, "test", None), 3: (False, None, None), 4: (False, None, held), 5: (False, None, held), 6: (False, None, other), 7: (True, "valid", None), 8: (False, None, None),
        9: (False, None, None), 10: (False, None, other),
    }
    members = spark.createDataFrame([(1, "b"), (1, "a")], "component long, member string")
    import hashlib

    assert graph.component_names(members).first().name == "LG_" + hashlib.sha256(b"a\nb").hexdigest()[:16]
    safe = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "train"), (None, "test")], "g string, s string")
    assert rows(graph.divided_groups(safe, "g", "s")) == {("x", 2)}


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=301) * 10.0 ** rng.integers(-6, 6, 301), np.zeros(40), np.full(30, 2.5)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 7.0), ("c", -1.0), ("c", 3.0)], "k string, v double")
    got = {r.k: r for r in S.exact_quantiles(df, ["k"], "v", {"low": 0.01, "mid": 0.5, "high": 0.95}).collect()}
    want = np.quantile(values, [0.01, 0.5, 0.95])
    assert np.allclose([got["a"].low, got["a"].mid, got["a"].high], want, rtol=1e-12) and got["b"].mid == 7.0 and got["c"].mid == 1.0
    assert S.exact_quantiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0
    order = [float("-inf"), -3.0, -1e-300, 0.0, 1e-300, 0.1, 0.100001, 5e300, float("inf"), float("nan")]
    b = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v double").select("i", X.magnitude_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b)


def test_summaries_keep_empty_groups(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None)], "s string, v double")
    got = {(r.grain, r.s): (r["count"], r.mean, r.median) for r in S.eleven_numbers(df, [[], ["s"]], ["v"]).collect()}
    assert got == {("all", None): (2, 2.0, 2.0), ("s", "x"): (2, 2.0, 2.0), ("s", "y"): (0, None, None)}
    tags = spark.createDataFrame([(["a", "a", "b"],), ([],), (None,)], "t array<string>")
    assert rows(S.category_counts(tags, "t", ["a", "b", "c"])) == {("a", 1), ("b", 1), ("c", 0)}


def test_interpolated_curve_equals_numpy(spark):
    rng = np.random.default_rng(2)
    conf = np.round(rng.random(60), 2)
    hit = rng.random(60) < 0.6
    pred = spark.createDataFrame([("k", i, i, float(c), bool(h)) for i, (c, h) in enumerate(zip(conf, hit))], "k string, image_id long, prediction_id long, confidence double, correct boolean")
    truths = spark.createDataFrame([("k", 50), ("none", 3)], "k string, truths long")
    got = {(r.k, r.point): (r.precision, r.recall) for r in D.interpolated_curves(pred, truths, ["k"]).collect()}
    order = np.lexsort((np.arange(60), -conf))
    tp = hit[order].cumsum()
    x = np.arange(1000) / 999
    recall = np.interp(-x, -conf[order], tp / 50, left=0)
    precision = np.interp(-x, -conf[order], tp / np.arange(1, 61), left=1)
    assert np.allclose([got["k", i] for i in range(1000)], np.stack([precision, recall], 1)) and set(got["none", i] for i in range(1000)) == {(0.0, 0.0)}
    near = D.nearest_points(D.interpolated_curves(pred, truths, ["k"]), ["k"], [0.25]).where("k = 'k'").first()
    assert near.point == 250


def test_confusions(spark):
    m = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("b", "a", 1), ("a", "background", 3), ("background", "b", 4)], "truth string, predicted string, n long")
    assert rows(D.confusion_summary(m).select("class_name", "truths", "correct", "missed", "confused", "false_alarms")) == {("a", 10, 5, 3, 2, 0), ("b", 1, 0, 0, 1, 4)}
    assert [(r.truth, r.predicted, r.n, r.share) for r in D.top_confusions(m, 1).collect()] == [("a", "b", 2, 0.2)]
    box = "id long, image_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 4.0, 4.0), (2, 1, 1, 0.8, 0.0, 0.0, 4.0, 3.0), (3, 2, 1, 0.5, 0.0, 0.0, 1.0, 1.0)], box)
    r = p.drop("confidence").where("id < 3").withColumn("class_id", F.lit(1))
    assert rows(D.confusion(p, r)) == {("1", "0", 1), ("1", "1", 1), ("background", "1", 1)}


def test_reliability_refuses_bad_rows_and_keeps_empty_bins(spark):
    kind = "k int, confidence double, correct boolean"
    got = D.reliability(spark.createDataFrame([(1, 0.05, True)], kind), ["k"]).orderBy("bin").collect()
    assert [r.n for r in got] == [1] + [0] * 9 and got[1].accuracy is None and got[0].ece_part == pytest.approx(0.95)
    for bad in ((1, 1.5, True), (1, None, True), (1, float("nan"), False), (1, 0.5, None)):
        with pytest.raises(Exception, match="calibration row"):
            D.reliability(spark.createDataFrame([bad], kind), ["k"]).collect()


def test_detection_and_export_rules(spark):
    images = spark.createDataFrame([(1,)], "image_id long")
    p = spark.createDataFrame([(1, 1, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 9, 7, 2.0, 3.0, 0.0, 1.0, 1.0)], "id long, image_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([(5, 1, [0], 0.0, 0.0, 1.0, 1.0), (6, 1, [0, 0], 0.0, 0.0, 1.0, 1.0), (7, 1, [], 0.0, 0.0, 1.0, 1.0)], "id long, image_id long, labels array<int>, x1 double, y1 double, x2 double, y2 double")
    got = rows(V.detection_issues(images, p, r, [0, 1]))
    assert got == {("prediction", 1, "id_repeats"), ("prediction", 2, "unknown_image"), ("prediction", 2, "box"), ("prediction", 2, "class"), ("prediction", 2, "confidence"), ("region", 6, "labels"), ("region", 7, "labels")}
    q = p.select("*", F.lit("a").alias("class_name"), F.lit(4).alias("original_width"), F.lit(1).alias("original_height"))
    meta = spark.createDataFrame([(1, 4, 4)], "image_id long, original_width int, original_height int")
    got = rows(V.export_issues(q, meta, {0: "a"}, 1, 0.6))
    assert got == {(1, "1", "size_differs"), (1, "1", "below_floor"), (1, None, "too_many"), (9, "2", "unknown_image"), (9, "2", "class_name")}


def test_joins_with_assertions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "z")], "id long, v string")
    b = spark.createDataFrame([(1, "x", 10), (2, "q", 20), (4, "w", 40)], "id long, v string, more int")
    good, issues = I.join_once(a, b, ["id"], ["v"])
    assert rows(good) == {(1, "x", 10)} and rows(issues) == {(2, "differs:v"), (3, "right_missing"), (3, "left_repeats"), (4, "left_missing")}
    listed = spark.createDataFrame([(1, "b"), (2, "a"), (3, "gone"), (4, "out"), (5, "a")], "position int, path string")
    manifest = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("out", None)], "path string, sha string")
    found, issues = I.listed_rows(listed, manifest, spark.createDataFrame([("out",)], "path string"), ["sha"])
    assert [r.path for r in found.collect()] == ["b", "a", "out", "a"]
    assert rows(issues.select("position", "code")) == {(3, "unknown"), (4, "excluded"), (2, "listed_twice"), (5, "listed_twice"), (1, "repeats:sha"), (2, "repeats:sha"), (5, "repeats:sha")}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(I.partition_issues(ids(1, 2, 3), [ids(1, 2), ids(2, 9)], "id")) == {(2, "overlap"), (3, "missing"), (9, "foreign")}
    assert V.same_rows(ids(1, 2), ids(2, 1)) and not V.same_rows(ids(1, 1), ids(1))
    assert rows(V.duplicate_keys(ids(1, 1, 2), "id")) == {(1, 2)}
    status = spark.createDataFrame([([("a", "warning")],), ([("a", "error"), ("b", "warning")],), ([],)], "i array<struct<code:string,severity:string>>")
    assert [r[0] for r in status.select(V.issue_status(F.col("i"))).collect()] == ["warning", "invalid", "valid"]


def test_label_mapping(spark):
    df = spark.createDataFrame([(["b", "a", "a", "?"],), ([],)], "labels array<string>")
    table = spark.createDataFrame([("a", 3, "approved"), ("b", 1, "rejected")], "label string, class_id int, status string")
    got = [(r.class_ids, r.excluded, r.unknown) for r in V.mapped_labels(df, table, ["c"]).collect()]
    assert got == [([3], ["b"], ["?"]), ([], [], [])]


CAMERA = "stamp long, depth_stamp long, info_stamp long, frame string, depth_frame string, info_frame string, mode int, u int, v int, left int, top int, right int, bottom int, depth array<float>, width int, height int, info_width int, info_height int, k array<double>, d array<double>, binning_x int, binning_y int"


def request(mode=0, u=0, v=0, box=(0, 0, 4, 2), depth=None, stamp=1, frame=C.FRAME, k=None):
    depth = [2.0] * 8 if depth is None else depth
    k = k or [10.0, 0.0, 1.5, 0.0, 20.0, 0.5, 0.0, 0.0, 1.0]
    return (stamp, 1, 1, frame, C.FRAME, C.FRAME, mode, u, v, *box, depth, 4, 2, 4, 2, k, [0.0], 0, 0)


def test_projection_statuses(spark):
    nan = float("nan")
    cases = [
        (request(u=3, v=1), "SUCCESS", (0.3, 0.05, 2.0)), (request(stamp=2), "TIMESTAMP_MISMATCH", None), (request(frame="map"), "FRAME_MISMATCH", None), (request(k=[0.0] * 9), "INVALID_CAMERA_MODEL", None),
        (request(depth=[1.0]), "INVALID_DEPTH_IMAGE", None), (request(mode=2), "INVALID_REQUEST", None), (request(u=4), "OUT_OF_BOUNDS", None), (request(depth=[nan] + [1.0] * 7), "NO_VALID_DEPTH", None),
        (request(mode=1, box=(2, 0, 2, 2)), "INVALID_REQUEST", None), (request(mode=1, box=(0, 0, 5, 2)), "OUT_OF_BOUNDS", None), (request(mode=1, depth=[-1.0] * 8), "NO_VALID_DEPTH", None),
        (request(mode=1, box=(0, 0, 4, 2), depth=[9.0, nan, 3.0, 9.0, 9.0, 9.0, 9.0, 9.0]), "SUCCESS", (0.0, 0.0, 3.0)), (request(mode=1, box=(0, 0, 4, 2), depth=[9.0, -1.0, 5.0, 9.0, 9.0, 9.0, 9.0, 9.0]), "SUCCESS", (0.0, 0.0, 5.0)),
    ]
    got = C.project(spark.createDataFrame([c[0] for c in cases], CAMERA)).collect()
    assert [r.status_name for r in got] == [c[1] for c in cases]
    for r, (_, _, place) in zip(got, cases):
        assert np.allclose((r.x, r.y, r.z), place) if place else all(np.isnan(x) for x in (r.x, r.y, r.z, r.sample_u))
    strict = C.project(spark.createDataFrame([cases[11][0]], CAMERA), least_valid=0.9).first()
    assert strict.status_name == "INSUFFICIENT_DEPTH" and strict.status == 2
    assert {r.status_name: r.n for r in C.outcomes(C.project(spark.createDataFrame([c[0] for c in cases], CAMERA))).collect()}["OUT_OF_BOUNDS"] == 2


def test_depth_decoding(spark):
    rows_ = [[1.0, 2.0], [3.0, float("nan")]]
    little = b"".join(struct.pack("<2f", *r) + b"\0\0" for r in rows_)
    big = b"".join(struct.pack(">2f", *r) for r in rows_)
    df = spark.createDataFrame([(bytearray(little), 2, 2, 10, 0, "32FC1"), (bytearray(big), 2, 2, 8, 1, "32FC1"), (bytearray(big), 2, 2, 8, 1, "16UC1"), (bytearray(b"x"), 2, 2, 8, 0, "32FC1"), (None, 2, 2, 8, 0, "32FC1")], "d binary, w int, h int, s int, b int, e string")
    got = [r[0] for r in df.select(C.decode_depth(*(F.col(c) for c in "dwhsbe"))).collect()]
    assert got[0][:3] == got[1][:3] == [1.0, 2.0, 3.0] and np.isnan(got[0][3]) and got[2:] == [None, None, None]


def test_small_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    text = "header { stamp { sec: 3 nanosec: 7 } } header { stamp { sec: 4 } }"
    assert one(X.stamps_in(F.lit(text))) == ([3_000_000_007, 4_000_000_000],)
    assert one(X.integral_text(F.lit(2.0)), X.integral_text(F.lit(2.5)), X.integral_text(F.lit(float("nan")))) == ("2", "2.5", None)
    assert [(b.start, b.stop) for b in one(X.batch_ranges(F.lit(5), 2))[0]] == [(0, 2), (2, 4), (4, 5)] and one(X.batch_ranges(F.lit(0), 2)) == ([],)
    assert one(X.shown_if(F.lit("ACCEPTED"), F.lit(1)), X.shown_if(F.lit("PENDING"), F.lit(1))) == (1, None)
    assert one(X.minimum_jerk(F.lit(0.5)), X.minimum_jerk(F.lit(-1.0)), X.minimum_jerk(F.lit(2.0))) == (0.5, 0.0, 1.0)
    assert one(X.annotation_rows(F.lit("0 0.50 1e-1\n\n1 .5 2"))) == ([["0", "0.5", "0.1"], ["1", "0.5", "2"]],)
    ts = F.timestamp_micros(F.lit(1_500_000).cast("bigint"))
    assert one(X.utc_seconds(ts), X.utc_micros(ts)) == ("1970-01-01T00:00:01Z", "1970-01-01T00:00:01.500000Z")
    wide, tall = [[float(x) for x in range(9)] * 8], [[0.0] * 72]
    df = spark.createDataFrame([(wide[0], tall[0])], "w array<double>, t array<double>")
    assert df.select(X.difference_hash(F.col("w"), F.col("t"))).first()[0] == "f" * 16 + "0" * 16
    assert df.select(X.difference_hash(F.col("t"), F.array(*(F.lit(float(y)) for y in range(9) for _ in range(8))))).first()[0] == "0" * 16 + "f" * 16
    assert one(X.distance_severity(F.lit(0)), X.orientation(F.lit(3), F.lit(2)), X.digest_ok(F.lit("a" * 64)), X.digest_ok(F.lit("A"))) == ("identical_perceptual_hash", "landscape", True, False)
    assert one(*X.exif_size(F.lit(4), F.lit(3), F.lit(6)), X.safe_relative_path(F.lit("a/../b")), X.safe_relative_path(F.lit("a/b"))) == (3, 4, False, True)
    assert one(*X.pixel_roi([F.lit(x) for x in (-0.5, 1.2, 3.1, 9.0)], F.lit(8), F.lit(6))) == (0, 1, 4, 6)
    assert one(X.low_information(F.lit(8)), X.low_information(F.lit(64)), X.low_information(F.lit(64), F.lit(1.0))) == (True, False, True)


def test_rotations_and_links(spark):
    T.require_rotation(np.eye(3).tolist())
    for bad in (np.diag([1, 1, -1]), 2 * np.eye(3), np.eye(2)):
        with pytest.raises(ValueError):
            T.require_rotation(bad.tolist())
    r, t = T.require_rigid([[0, -1, 0, 5], [1, 0, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]])
    with pytest.raises(ValueError):
        T.require_rigid([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 1, 1]])
    e = spark.createDataFrame([("e1", "Crack", 5.0, 7.0, 7.5), ("e2", "Hole", 0.0, 0.0, 0.0)], "estimated_id string, class_name string, x double, y double, z double")
    g = spark.createDataFrame([("g1", "Crack", 1.0, 0.0, 0.0), ("g2", "Crack", 0.0, 0.0, 0.0)], "truth_id string, class_name string, x double, y double, z double")
    link = lambda *x: spark.createDataFrame(x, "estimated_id string, truth_id string")
    d = T.locate_errors(e, g, link(("e1", "g1")), r.tolist(), t.tolist())
    assert d.first().error == pytest.approx(0.5)
    s = T.localisation_summary(d, e, g, link(("e1", "g1"))).first()
    assert (s.matched, s.unmatched_estimates, s.unmatched_truths) == (1, 1, 1) and s.rmse == pytest.approx(0.5) and s.mean_abs_dz == pytest.approx(0.5)
    empty = T.localisation_summary(d.limit(0), e, g, link(("e1", "g1"))).first()
    assert empty.matched == 0 and empty.rmse is None
    assert rows(T.link_issues(e, g, link(("e2", "g1"), ("e9", "g1"), ("e1", "g8"))).select("estimated_id", "code")) == {("e2", "class_differs"), ("e2", "truth_repeats"), ("e9", "unknown_estimate"), ("e9", "truth_repeats"), ("e1", "unknown_truth")}
    with pytest.raises(V.ValidationError):
        T.locate_errors(e, g, link(("e2", "g1")), r.tolist(), t.tolist())
    depth = spark.createDataFrame([("a", 2.0), ("b", 2.2), ("c", float("nan"))], "key string, depth_m double")
    assert {r.key for r in T.plane_check(depth, 2.0, 0.1).collect()} == {"b", "c"}
    stamps = [spark.createDataFrame([(i,) for i in x], "stamp long") for x in ((1, 2, 3), (2, 3), (3, 3, 4))]
    assert rows(T.common_stamps(*stamps)) == {(3,)}


def test_relative_errors_known_answer(spark):
    h = np.sqrt(0.5)
    pose = lambda t, x, q, gx: ("r", t, t, float(x), 0.0, 0.0, *q, float(gx), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    kind = "run string, t long, sample_id long, x_m double, y_m double, z_m double, qx double, qy double, qz double, qw double, gt_x_m double, gt_y_m double, gt_z_m double, gt_qx double, gt_qy double, gt_qz double, gt_qw double"
    still, turned, s = (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, float(h), float(h)), 1_000_000_000
    df = spark.createDataFrame([pose(0, 0, still, 0), pose(s - 10, 9, still, 9), pose(s + 10, 1, turned, 2), pose(2 * s + 60_000_011, 5, still, 5)], kind)
    got = T.relative_errors(df).orderBy("t").collect()
    assert [(r.t, r.end_t) for r in got] == [(0, s - 10)] and got[0].translation == pytest.approx(0.0)
    got = T.relative_errors(df.where(F.col("t") != s - 10)).first()
    assert got.end_t == s + 10 and got.translation == pytest.approx(1.0) and got.rotation == pytest.approx(90.0)


def test_store_operations(spark):
    d = spark.createDataFrame([("a", "UNREVIEWED", "keep"), ("b", "UNREVIEWED", None)], "defect_id string, review_status string, review_notes string")
    decided = spark.createDataFrame([("a", "CONFIRMED", None), ("b", "REJECTED", "why")], "defect_id string, status string, notes string")
    assert rows(store.set_review(d, decided)) == {("a", "CONFIRMED", "keep"), ("b", "REJECTED", "why")}
    parents, children = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    p, c = store.delete_cascade(parents, children, "id", parents.where("id = 1"))
    assert rows(p) == {(2,)} and rows(c) == {(2, "y")}
    assert store.get(d, "defect_id", " a ").count() == 1 and store.get(d, "defect_id", "z").count() == 0
    with pytest.raises(V.ValidationError):
        store.insert(children, spark.createDataFrame([(9, "z")], "id long, v string"), "v", parents, "id")
    good, bad = V.split_valid(spark.createDataFrame([("d", "f", datetime(2026, 1, 1), 0.5, 0.0, 0.0, 1.0, 1.0), (" ", "f", None, 2.0, 1.0, 0.0, 1.0, 1.0)], "defect_id string, frame_id string, timestamp timestamp, confidence double, x1 double, y1 double, x2 double, y2 double"), V.evidence_rules())
    assert good.count() == 1 and bad.first().codes == ["defect_id", "timestamp", "confidence", "box"]
    ev = spark.createDataFrame([("a", 2, datetime(2026, 1, 1)), ("a", 1, datetime(2026, 1, 1)), ("b", 0, datetime(2025, 1, 1))], "defect_id string, evidence_id long, timestamp timestamp")
    assert [r.evidence_id for r in store.evidence_of(ev, "a").collect()] == [1, 2]
    shown = spark.createDataFrame([("a", 1, None, " ", 0.12349, 1.0, float("nan"), None, 1, "X")], "defect_id string, inspection_id long, track_id string, class_name string, confidence double, x_m double, y_m double, z_m double, observation_count int, review_status string")
    r = store.dashboard_rows(shown).first()
    assert (r.track_id, r.class_name, r.confidence, r.x_m, r.y_m, r.z_m) == ("N/A", "N/A", "0.123", "1.00", "N/A", "N/A")


def test_registry_and_fusion_agree(spark):
    t0 = datetime(2026, 9, 16)
    o = spark.createDataFrame([(s, 1, f"o{s}", 0, None, 0.5, s * 0.1, 0.0, 0.0, t0 + timedelta(seconds=s)) for s in range(6)], "seq long, inspection_id long, observation_id string, class_id int, track_id string, confidence double, x_m double, y_m double, z_m double, ts timestamp")
    decisions, defects = U.fuse(o, naming=U.Naming("X-", "urn:x"))
    members = o.join(decisions.select("seq", "defect_id"), "seq")
    assert V.aggregate_issues(defects, members).count() == 0 and all(r.defect_id.startswith("X-") for r in defects.collect())
    wrong = defects.withColumn("observation_count", F.lit(99)).withColumn("x_m", F.lit(7.0))
    assert {r.code for r in V.aggregate_issues(wrong, members).collect()} == {"observation_count", "position"}
    reg = spark.createDataFrame([(1, "o", "D", "a" * 64), (1, "o", "D", "a" * 64), (1, "p", "gone", "zz")], "inspection_id long, observation_id string, defect_id string, fingerprint string")
    known = spark.createDataFrame([("D",)], "defect_id string")
    assert rows(V.registry_issues(known, reg).select("observation_id", "code")) == {("o", "repeats"), ("p", "unknown_defect"), ("p", "fingerprint")}
    records, proof = store.fused_records(decisions, defects, o, {0: "Crack"})
    assert proof.count() == 6 and {r.class_name for r in records.collect()} == {"Crack"}
    with pytest.raises(ValueError):
        U.State.from_json('{"defects":{},"seen":{"o":["f","D"]}}')


def test_grid_finds_what_a_scan_finds():
    rng = np.random.default_rng(9)
    state, plain = U.State(), []
    for i, at in enumerate(np.round(rng.random((400, 3)) * 1.5, 2)):
        near = [d for d in state.defects.values() if np.linalg.norm(np.array(d.centre) - at) <= 0.25 + 1e-12]
        decision, _ = state.ingest({"observation_id": f"o{i}", "inspection_id": 1, "fingerprint": "f", "confidence": 0.5, "x_m": at[0], "y_m": at[1], "z_m": at[2], "track_id": None, "ts": datetime(2026, 1, 1)}, 0.25)
        plain.append((decision == "ASSOCIATED") == bool(near))
    assert np.mean(plain) > 0.99  # edges may differ in the last bit


def test_independent_units_change_nothing(spark):
    rng = np.random.default_rng(4)
    t0 = datetime(2026, 1, 1)
    at = np.round(np.concatenate([rng.normal(size=(60, 3)) * 0.3 + c for c in ([0, 0, 0], [4, 0, 0], [0, -5, 2])]), 3)
    order = rng.permutation(len(at))
    data = [(int(s), 1 + int(s) % 2, f"o{s}", int(s) % 3 % 2, f"t{s % 5}" if s % 4 else None, 0.5, *map(float, at[i]), t0 + timedelta(seconds=int(s))) for s, i in enumerate(order)]
    o = spark.createDataFrame(data, "seq long, inspection_id long, observation_id string, class_id int, track_id string, confidence double, x_m double, y_m double, z_m double, ts timestamp")
    units = U.independent_units(o, 0.25)
    assert units.select("unit").distinct().count() > 6 and units.count() == len(data)
    whole, parts = U.fuse(o)[0], U.fuse(o, unit_rows=1)[0]
    assert rows(whole.select("seq", "decision", "defect_id")) == rows(parts.select("seq", "decision", "defect_id"))


def test_radius_join_chunks_and_levels(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.random((900, 2)) * 20, rng.normal(size=(300, 2)) * 0.3 + 5, np.full((20, 2), 7.0)])
    df = spark.createDataFrame([(i, "g", float(x), float(y)) for i, (x, y) in enumerate(points)], "k long, g string, x double, y double")
    want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.sqrt(((points[i] - points) ** 2).sum(1)) <= 0.4).tolist() if i < j}
    for kw in ({"cell_points": 20, "task_points": 30}, {"cell_points": 400, "task_points": 100}, {}):
        got = [(r.k_a, r.k_b) for r in P.radius_join(df, "k", "g", ("x", "y"), 0.4, **kw).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_streams_synchronise_with_bounded_state(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    data = lambda n, off: spark.createDataFrame([(i, t0 + timedelta(seconds=100 * i + off), f"{n}{i}") for i in range(6)], f"stamp long, ts timestamp, {n} string")
    sides = {n: data(n, off) for n, off in (("r", 0), ("d", 1), ("i", 9))}
    batch = FS.synchronise(sides["r"], sides["d"], sides["i"], bound_seconds=20)
    assert rows(batch.select("stamp", "r", "d", "i")) == {(k, f"r{k}", f"d{k}", f"i{k}") for k in range(6)}
    assert FS.synchronise(sides["r"], sides["d"], sides["i"], bound_seconds=5).count() == 0
    streams = []
    for n, df in sides.items():
        for k in range(6):
            df.where(F.col("stamp") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / n))
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)))
    q = FS.synchronise(*streams, bound_seconds=20).select("stamp", "r", "d", "i").writeStream.format("memory").queryName("synced").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    kept = max((s["numRowsTotal"] for s in q.lastProgress["stateOperators"]), default=0)
    q.stop()
    assert spark.table("synced").count() == 6 and kept < 12  # old rows have left the state


def test_stream_restart_keeps_state(spark, tmp_path):
    t0 = datetime(2026, 9, 16)
    kind = "seq long, inspection_id long, observation_id string, class_id int, track_id string, confidence double, x_m double, y_m double, z_m double, ts timestamp"
    bad = [(8, 1, "n", 0, None, 0.5, float("nan"), 0.0, 0.0, t0), (9, None, None, None, None, None, None, None, None, None)]
    obs = spark.createDataFrame([(s, 1, f"o{s}", 0, "t", 0.5, 0.1 * s, 0.0, 0.0, t0) for s in range(4)] + bad, kind).where("seq >= 0")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("seq < 2", "seq >= 2"):
        obs.where(part).coalesce(1).write.mode("append").parquet(src)
        q = FS.fuse_stream(spark.readStream.schema(obs.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    got = {r.observation_id: r.decision for r in spark.read.parquet(out).collect()}
    assert got == {r.observation_id: r.decision for r in U.fuse(obs)[0].collect()}
    assert rows(FS.outcome_counts(spark.read.parquet(out))) == {("CREATED", 1), ("ASSOCIATED", 3), ("REJECTED", 2)}
    ticks = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("a", 31, "z")], "k string, t long, v string")
    assert rows(FS.sampled(ticks, "k", "t", 10)) == {("a", 5, "x"), ("a", 31, "z")}


def test_more_files(spark, tmp_path):
    m = spark.createDataFrame([("train", "b.jpg"), ("test", "a.jpg")], "processed_split string, image_relative_path string")
    files.write_manifest(m, str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m")).select("image_relative_path", "processed_split")) == {("b.jpg", "train"), ("a.jpg", "test")}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_once(m, str(tmp_path / "m"))
    state = spark.createDataFrame([("d", 1.5)], "id string, x double")
    files.export_state(state, str(tmp_path / "s"))
    assert rows(files.import_state(spark, str(tmp_path / "s"), "id string, x double")) == {("d", 1.5)}
    with pytest.raises(Exception):
        files.import_state(spark, str(tmp_path / "s"), "id string, x int").collect()
    odd = spark.createDataFrame([(1, float("nan"))], "b long, a double")
    assert state.select(files.canonical_json(state, ["x", "id"])).first()[0] == '{"id":"d","x":1.5}'
    with pytest.raises(Exception, match="NaN"):
        odd.select(files.canonical_json(odd, ["b", "a"])).collect()
    root = tmp_path / "root/train/images"
    root.mkdir(parents=True)
    (root / "B.JPG").write_bytes(b"xy")
    (root / "a.txt").write_bytes(b"z")
    assert [(r.split, r.kind, r.filename, r.size) for r in files.directory(spark, str(tmp_path / "root"), (".jpg",)).collect()] == [("train", "images", "B.JPG", 2)]
    one = files.directory(spark, str(tmp_path / "root"), (".jpg", ".txt"))
    assert one.count() == 2
    paths = files.inventory(spark, str(tmp_path / "root"))
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.inventory(spark, str(tmp_path / "root"), paths.where("path like '%JPG'")).collect()}
    import hashlib

    assert sums == {"B.JPG": hashlib.sha256(b"xy").hexdigest(), "a.txt": None}
    (tmp_path / "d.json").write_text('{"a": 5}')
    r = files.read_json_with_hash(spark, str(tmp_path / "d.json"), "a int").first()
    assert r.document.a == 5 and r.sha256 == hashlib.sha256(b'{"a": 5}').hexdigest()
    values = spark.createDataFrame([(i, 10.0 * i) for i in range(6)], "position long, value double")
    offsets = spark.createDataFrame([("p", 0, 2), ("q", 2, 2), ("r", 4, 6)], "image string, start long, stop long")
    assert rows(files.ragged_rows(values, offsets)) == {("p", 0, 0.0), ("p", 1, 10.0), ("r", 0, 40.0), ("r", 1, 50.0)}
    docs = spark.createDataFrame([("p", [(0, [1.0, 2.0, 3.0, 4.0]), (1, [0.0, 0.0, 1.0, 1.0])]), ("q", []), ("s", [(2, [0.0, 0.0, 1.0, 1.0])])], "image_id string, annotations array<struct<category:int,bbox:array<double>>>")
    boxes = spark.createDataFrame([("p", 1), ("p", 0), ("s", 1), ("x", 1)], "image_id string, class_id int")
    assert {(r.image_id, r.status) for r in files.reconciled_annotations(docs, boxes).collect()} == {("p", "equal"), ("q", "only_documents"), ("s", "class_differs"), ("x", "only_labels")}
    assert rows(files.annotated_regions(docs).where("image_id = 'p' and position = 0").select("x1", "y1", "x2", "y2")) == {(1.0, 2.0, 4.0, 6.0)}
    arrays = spark.createDataFrame([("a", [0], [0.5], [[0.0, 0.0, 9.0, 1.0]], 4, 4)], "image_id string, class_ids array<int>, confidences array<double>, boxes array<array<double>>, width int, height int")
    with pytest.raises(Exception, match="beyond its picture"):
        files.normalised_predictions(arrays).collect()


def test_batches_digests_and_bundles(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(2, "y")], "id long, v string")
    for df, batch in ((a, "b1"), (b, "b2"), (b, "b1")):
        files.write_batch(df, str(tmp_path / "batches"), batch)
    assert rows(spark.read.parquet(str(tmp_path / "batches")).select("id", "batch")) == {(2, "b1"), (2, "b2")}
    digest = lambda df: files.table_digest(df).first()
    t = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, v string")
    assert digest(t) == digest(t.select("v", "id").orderBy(F.desc("id"))) and digest(t) != digest(t.distinct()) and digest(t) != digest(t.fillna("null"))
    assert digest(t.limit(0)).rows == 0
    p = spark.createDataFrame([(1, 1, 0, 0.5, 0.0, 0.0, 1.0, 1.0)], "id long, image_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([(5, 1, [0, 1], 0.0, 0.0, 1.0, 1.0)], "id long, image_id long, labels array<int>, x1 double, y1 double, x2 double, y2 double")
    names = {"predictions": digest(p).digest, "regions": digest(r).digest}
    assert {(x.kind, tuple(x.class_ids)) for x in files.bundle(p, r, names).collect()} == {("prediction", (0,)), ("region", (0, 1))}
    with pytest.raises(ValueError):
        files.bundle(p.withColumn("confidence", F.lit(0.6)), r, names)


def test_contracts_and_gates(spark):
    contract = {"seed": 7, "name": str, "on": bool}
    assert V.contract_issues({"seed": 7, "name": "x", "on": True}, contract) == []
    assert V.contract_issues({"seed": True, "name": 1, "more": 0}, contract) == ["differs:name", "differs:seed", "missing:on", "unknown:more"]
    checks = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None)], "section string, ok boolean")
    assert rows(V.gates(checks, "section", F.col("ok"))) == {("a", 2, True), ("b", 2, False), ("all", 4, False)}
    table = spark.createDataFrame([("x", 3, "approved"), ("y", 1, "approved"), ("z", 3, "approved"), ("w", 2, "rejected")], "label string, class_id int, status string")
    assert [r.class_id for r in V.scored_classes(table).collect()] == [1, 3]


def test_checkpoints_need_a_shared_folder(spark, tmp_path):
    d = session.cut(spark.range(3))
    path = d._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().replace("file:", "")
    import os

    assert os.path.exists(path)
    session.release(d)
    assert not os.path.exists(path)
    session.release(spark.range(3))  # no checkpoint, nothing happens
    for master, local in (("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("spark://x:1", False), ("yarn", False)):
        assert bool(session._LOCAL.match(master)) == local


def test_review_samples(spark):
    t = spark.createDataFrame([(1, "train", "B"), (2, "test", "a"), (3, "train", "a")], "id long, split string, name string")
    assert [r.id for r in I.canonical_order(t, "split", "name").collect()] == [3, 1, 2]
    e = S.extreme_examples(spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, v double"), "v", "id", 2, {"odd": F.col("id") % 2 == 1})
    assert rows(e) == {("smallest", 0, 0.0), ("smallest", 1, 1.0), ("largest", 4, 4.0), ("largest", 3, 3.0), ("odd", 1, 1.0), ("odd", 3, 3.0)}
    n = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long")
    assert rows(S.count_issues(n, {"a": 1, "b": 3, "c": 0})) == {("b", 2, 3), ("c", None, 0)}
    assert rows(I.numeric_neighbours(spark.createDataFrame([(1, "train", 5), (2, "test", 7), (3, "test", 8), (4, None, 5)], "id long, split string, number long"))) == {(1, 2, 2)}
    deltas = D.metric_deltas(spark.createDataFrame([("x", 1.0)], "metric string, value double"), spark.createDataFrame([("x", 1.5), ("y", 2.0)], "metric string, value double"))
    assert rows(deltas) == {("x", 1.0, 1.5, 0.5), ("y", None, 2.0, None)}
    det = C.detection_requests(spark.createDataFrame([(1, -1.0, 0.5, 3.2, 9.0, 8, 6)], "stamp long, x1 double, y1 double, x2 double, y2 double, width int, height int")).first()
    assert (det.left, det.top, det.right, det.bottom, det.mode) == (0, 0, 4, 6, 1)


def test_record_store_survives_a_restart(spark, tmp_path):
    from spanwise.sources.records import RecordStore, VersionConflict, dense_ids

    kept = RecordStore(spark, str(tmp_path / "db"))
    assert kept.table("defects").count() == 0 and kept.version("defects") == 0
    s = kept.create_structures(spark.createDataFrame([("Pier B", "d", None), ("Pier A", "d", "Kelmoor")], "name string, description string, location_text string"))
    assert {(r.structure_id, r.name) for r in s.collect()} == {(1, "Pier A"), (2, "Pier B")}
    with pytest.raises(V.ValidationError):
        kept.create_structures(spark.createDataFrame([(" ", "d", None)], "name string, description string, location_text string"))
    t = datetime(2026, 1, 1)
    kind = "structure_id long, started_at timestamp, completed_at timestamp, status string, system_version string, notes string"
    kept.create_inspections(spark.createDataFrame([(1, t, None, "RUNNING", "v1", None), (1, t + timedelta(1), None, "PLANNED", "v1", None)], kind))
    with pytest.raises(V.ValidationError):
        kept.create_inspections(spark.createDataFrame([(9, t, None, "RUNNING", "v1", None)], kind))
    defect = lambda i, c, d="D1": spark.createDataFrame([(d, i, "t", "Crack", c, 0.0, 0.0, 0.0, "map", 1, t, t, "m")], "defect_id string, inspection_id long, track_id string, class_name string, confidence double, x_m double, y_m double, z_m double, coordinate_frame string, observation_count int, first_seen timestamp, last_seen timestamp, model_version string")
    kept.ingest_defects(defect(1, 0.5))
    with pytest.raises(V.ValidationError):
        kept.ingest_defects(defect(1, 0.5))
    kept.set_review(spark.createDataFrame([("D1", "CONFIRMED", "seen")], "defect_id string, status string, notes string"))
    with pytest.raises(V.ValidationError):
        kept.set_review(spark.createDataFrame([("D1", "MAYBE", None)], "defect_id string, status string, notes string"))
    kept.update_defects(defect(1, 0.9))
    with pytest.raises(V.ValidationError):
        kept.update_defects(defect(2, 0.9))
    proof = spark.createDataFrame([("D1", "f", t, 0.5, 0.0, 0.0, 1.0, 1.0)], "defect_id string, frame_id string, timestamp timestamp, confidence double, x1 double, y1 double, x2 double, y2 double")
    kept.add_evidence(proof)
    with pytest.raises(V.ValidationError):
        kept.add_evidence(proof)

    again = RecordStore(spark, str(tmp_path / "db"))  # a new process
    r = again.get_defect(" D1 ").first()
    assert (r.confidence, r.review_status, r.review_notes) == (0.9, "CONFIRMED", "seen")
    assert [x.inspection_id for x in again.list_inspections().collect()] == [2, 1] and again.list_evidence("D1").count() == 1
    assert again.list_defects(inspection_id=1, min_confidence=0.8).count() == 1 and again.get_structure(2).first().name == "Pier B" and again.get_inspection(3).count() == 0
    report, issues = again.report()
    assert {(x.inspection_id, len(x.defects)) for x in report.collect()} == {(1, 1), (2, 0)} and issues.count() == 0
    with pytest.raises(V.ValidationError):
        again.delete_structures(spark.createDataFrame([(1,)], "structure_id long"))
    again.delete_structures(spark.createDataFrame([(2,)], "structure_id long"))
    base = again.version("inspections")
    again.delete_inspections(spark.createDataFrame([(1,)], "inspection_id long"))
    assert [again.table(n).count() for n in ("structures", "inspections", "defects", "evidence")] == [1, 1, 0, 0]
    with pytest.raises(VersionConflict):
        again._commit("inspections", again.table("inspections"), base)
    (tmp_path / "db/_versions/structures/9").write_text("")  # a writer was lost
    with pytest.raises(VersionConflict):
        again.create_structures(spark.createDataFrame([("Pier C", "d", None)], "name string, description string, location_text string"))
    again.abandon("structures")
    assert again.create_structures(spark.createDataFrame([("Pier C", "d", None)], "name string, description string, location_text string")).count() == 1
    ids = dense_ids(spark.range(50).select((F.lit(100) - F.col("id")).alias("v")), ["v"], "n", 5).orderBy("v").collect()
    assert [x.n for x in ids] == list(range(5, 55))

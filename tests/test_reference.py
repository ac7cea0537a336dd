import math
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import geometry as G, scalars as X
from spanwise.operators import detection as D, fusion as U, graph, inventory as I, store, trajectory as T, validate as V
from spanwise.plans import reference
from spanwise.sources import files
from spanwise.streaming import fusion_stream as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    names = ["urn:a:1", "ß/é", ""]
    got = [one(spark, X.uuid5(F.lit(n)))[0] for n in names]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert one(spark, X.pairing_key(F.lit(" Straße.v2.JPG ")), X.numeric_stem(F.lit("0012.jpg")).cast("int"), X.numeric_stem(F.lit("a12.jpg"))) == ("strasse.v2", 12, None)
    assert one(spark, X.canonical_decimal(F.lit("1.500")), X.canonical_decimal(F.lit("-0.0")), X.canonical_decimal(F.lit("1e-2")), X.canonical_decimal(F.lit("x"))) == ("1.5", "0", "0.01", None)
    assert one(spark, X.label_path(F.lit("a/images/images/b.c.jpg")), X.split_pair(F.lit("test"), F.lit("train"))) == ("a/images/labels/b.c.txt", "train/test")
    assert one(spark, X.size_category(F.lit(0.001)), X.size_category(F.lit(0.1)), X.annotation_bin(F.lit(-1)), X.annotation_bin(F.lit(20))) == ("small", "large", None, "11-20")
    assert one(spark, *X.back_project(F.lit(3.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(4.0), F.lit(2.0), F.lit(2.0))) == (1.0, -1.0, 2.0)


def test_slerp_and_angles(spark):
    h = math.sqrt(0.5)
    q0, q1 = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)], [F.lit(x) for x in (0.0, 0.0, -h, -h)]
    mid = one(spark, *G.slerp(q0, q1, F.lit(0.5)))
    assert np.allclose(mid, (0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)))
    assert math.isclose(one(spark, G.rotation_angle(q1))[0], math.pi / 2)
    assert np.allclose(one(spark, *G.rotate(q1, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])), (0, 1, 0))


def test_average_precision_known_answers(spark):
    truths = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "k string, truths long")
    rows = spark.createDataFrame([("a", 1, 1, 0.9, False), ("a", 1, 2, 0.8, True), ("c", 1, 3, 0.5, False)], "k string, image_id long, prediction_id long, confidence double, correct boolean")
    got = {r.k: r.ap for r in D.average_precision(rows, truths, ["k"]).collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == 0.0 and got["c"] is None


def test_reliability_known_answer(spark):
    rows = spark.createDataFrame([(1, 0.0, False), (1, 1.0, True), (1, 0.5, False)], "k int, confidence double, correct boolean")
    got = D.reliability(rows, ["k"], 2).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 2] and sum(r.ece_part for r in got) == pytest.approx(1 / 6)


def test_greedy_match_takes_the_best_unused(spark):
    p = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (3, 2, 0, 0.8, 0.0, 0.0, 1.0, 1.0)], "id long, image_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([(7, 1, 0, 0.0, 0.0, 10.0, 10.0), (8, 1, 0, 0.0, 0.0, 10.0, 8.0)], "id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(m.threshold, m.prediction_id, m.region_id) for m in D.greedy_match(p, r, [0.5, 0.9]).collect()}
    assert got == {(0.5, 1, 7), (0.5, 2, 8), (0.9, 1, 7)}


def test_average_precision_at_all_ten_thresholds(spark, tmp_path):
    rng = np.random.default_rng(7)
    lines = [(int(o), int(n), int(rng.integers(0, 50)), int(rng.integers(0, 50)), float(rng.integers(1, 9))) for o in range(120) for n in range(1, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    boxes = [(o * 10 + n, o // 40, s % 3, (p % 7, s % 5, p % 7 + 4 + q % 8, s % 5 + 4 + q % 6), p % 1000 / 1000) for o, n, p, s, q in lines]
    guesses, truths = [b for b in boxes if b[0] % 10 % 2], [b for b in boxes if b[0] % 10 % 2 == 0]

    def overlap(a, b):
        both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    want = {}
    for t in [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]:
        for c in range(3):
            regions, used, curve, tp = [r for r in truths if r[2] == c], set(), [], 0
            for k, p in enumerate(sorted((p for p in guesses if p[2] == c), key=lambda p: (-p[4], p[1], p[0])), 1):
                best = min(((-overlap(p[3], r[3]), r[0]) for r in regions if r[1] == p[1] and r[0] not in used), default=(0, 0))
                if -best[0] >= t:
                    used.add(best[1])
                    tp += 1
                curve.append((tp / len(regions), tp / k))
            want[c, t] = sum(max((p for r, p in curve if r >= k / 100), default=0.0) for k in range(101)) / 101
    run = reference.queries()
    got = {(r.class_id, r.threshold): r.ap for r in run["average_precision_50_95"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-8) and len(got) == 30
    m = run["mean_average_precision"](spark, str(tmp_path)).first()
    assert m.map50 == pytest.approx(np.mean([want[c, 0.5] for c in range(3)]), abs=1e-7) and m.map50_95 == pytest.approx(np.mean(list(want.values())), abs=1e-7)


def test_class_scores_count_the_images(spark, tmp_path):
    lines = [(40 * image, n, 1000 * image, 0, 1.0) for image in range(3) for n in (1, 3)] + [(0, 2, 0, 0, 1.0), (120, 2, 0, 0, 1.0)]  # the last image has a region only
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = reference.queries()["class_scores"](spark, str(tmp_path)).collect()
    assert {(r.threshold, r.tp, r.fp, r.fn, r.fp_per_image) for r in got} == {(0.5, 1, 5, 1, 1.25), (0.75, 1, 5, 1, 1.25)}


POSE = "run string, t long, sample_id long, x_m double, y_m double, z_m double, qx double, qy double, qz double, qw double"


def test_association_and_rigid_fit(spark):
    ms = 1_000_000
    pose = lambda t, x, i: ("r", t * ms, i, float(x), float(x * x % 7), float(i % 3), 0.0, 0.0, 0.0, 1.0)
    g = spark.createDataFrame([pose(t, t / 10, t) for t in (0, 50, 100, 151)], POSE)
    e = spark.createDataFrame([pose(t, 0, t) for t in (0, 25, 100, 120, 151, 160)], POSE)
    got = {r.t // ms: (r.exact, round(r.gt_x_m, 6)) for r in T.associate(e, g).collect()}
    assert got == {0: (True, 0.0), 25: (False, 2.5), 100: (True, 10.0), 151: (True, 15.1)}
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 3))
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r *= np.sign(np.linalg.det(r))
    b = a @ r.T + [1, 2, 3]
    rows = [("r", i, i, *map(float, a[i]), *map(float, b[i])) for i in range(40)] + [("line", i, i, float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(5)]
    al = spark.createDataFrame(rows, "run string, t long, sample_id long, x_m double, y_m double, z_m double, gt_x_m double, gt_y_m double, gt_z_m double")
    fits = {f.run: f for f in T.rigid_fit(al).collect()}
    assert np.allclose(np.reshape(fits["r"].r, (3, 3)), r) and np.allclose(fits["r"].t, [1, 2, 3]) and fits["line"].r is None
    assert T.error_summary(T.absolute_errors(al, T.rigid_fit(al)), ["run"]).first().rmse < 1e-9


def test_linked_groups_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = dict(graph.linked_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_hamming_neighbours_brute_force(spark):
    rng = np.random.default_rng(17)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(15)]
    vals = base + [b ^ sum(1 << int(k) for k in rng.choice(128, size=int(rng.integers(1, 16)), replace=False)) for b in base for _ in range(2)]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, sign(v >> 64), sign(v & (2**64 - 1))) for i, v in enumerate(vals)], "id long, hi long, lo long")
    got = {tuple(r) for r in I.hamming_neighbours(df).collect()}
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(vals) for j, b in enumerate(vals) if i < j and (a ^ b).bit_count() <= 12}
    assert got == want


@pytest.mark.parametrize("shard, chunk", [(131_072, 400_000), (8, 5)])
def test_near_pairs_brute_force(spark, shard, chunk):
    rng = np.random.default_rng(18)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(25)]
    vals = base + [b ^ sum(1 << int(k) for k in rng.choice(128, size=int(rng.integers(1, 16)), replace=False)) for b in base for _ in range(6)]
    vals += [base[0] ^ (0b11 << k) for k in range(0, 127, 3)]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, sign(v >> 64), sign(v & (2**64 - 1))) for i, v in enumerate(vals)] + [(9999, None, 1)], "id long, hi long, lo long")
    for radius in (12, 5):
        got = I.near_pairs(df, radius, shard, chunk).collect()
        want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(vals) for j, b in enumerate(vals) if i < j and (a ^ b).bit_count() <= radius)
        assert sorted(map(tuple, got)) == want
    assert I.near_pairs(df.limit(0)).count() == 0


def test_near_hashes_12_keeps_pairs_beyond_4_bits(spark, tmp_path):
    v = 0x0123456789ABCDEF0123456789ABCDEF
    rows = [(i, f"{v ^ ((1 << n) - 1):032x}") for i, n in enumerate((0, 4, 12, 25))]
    spark.createDataFrame(rows, "image_id long, perceptual_hash string").write.parquet(str(tmp_path / "manifest.parquet"))
    got = reference.queries()["near_hashes_12"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(0, 1, 4), (0, 2, 12), (1, 2, 8)}


def observations(spark, rows):
    t0 = datetime(2026, 9, 16, 16)
    full = [(s, 1, o, 0, track, 0.5, x, 0.0, 0.0, t0 + timedelta(seconds=s)) for s, o, track, x in rows]
    return spark.createDataFrame(full, "seq long, inspection_id long, observation_id string, class_id int, track_id string, confidence double, x_m double, y_m double, z_m double, ts timestamp")


def test_fusion_batch_equals_stream(spark, tmp_path):
    rows = [(1, "a", "t1", 0.0), (2, "b", None, 0.25), (3, "c", "t2", 0.6), (4, "d", "t2", 0.36), (5, "e", None, 9.0)]
    obs = observations(spark, rows)
    decisions, defects = U.fuse(obs)
    got = {r.observation_id: (r.decision, r.defect_id) for r in decisions.collect()}
    assert [got[o][0] for o in "abcde"] == ["CREATED", "ASSOCIATED", "CREATED", "ASSOCIATED", "CREATED"]
    assert got["d"][1] == got["c"][1]
    assert {r.track_id for r in defects.collect()} == {"t1", "t2", None}
    src = tmp_path / "in"
    for s in range(1, 6):
        obs.where(F.col("seq") == s).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = S.fuse_stream(stream).writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.observation_id: (r.decision, r.defect_id) for r in spark.table("fused").collect()} == got


def test_fusion_replay_and_conflict(spark):
    rows = [(1, "a", "t1", 0.0), (2, "b", None, 0.1)]
    obs = observations(spark, rows)
    again = obs.where("seq = 1").withColumn("seq", F.lit(9).cast("long"))
    assert {(r.seq, r.decision) for r in U.fuse(obs.unionByName(again))[0].collect()} == {(1, "CREATED"), (2, "ASSOCIATED"), (9, "REPLAY")}
    other = again.withColumn("x_m", F.lit(5.0))
    assert U.conflicts(obs.unionByName(other)).count() == 1
    with pytest.raises(Exception, match="other content"):
        U.fuse(obs.unionByName(other))[0].collect()


def test_buffer_evicts(spark):
    m = [("c", i, "put", i, float(i)) for i in range(5)] + [("c", 10, "get", 1, None), ("c", 11, "get", 4, None)]
    got = {r.seq: r.status for r in S.lookup_buffered(spark.createDataFrame(m, "camera string, seq long, kind string, stamp long, value double"), 3).collect()}
    assert got == {10: "TIMESTAMP_MISMATCH", 11: "SUCCESS"}


def test_store(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, note string")
    with pytest.raises(V.ValidationError):
        store.insert(t, t.limit(1), "id")
    new = spark.createDataFrame([(2, "B")], "id long, v string")
    assert sorted(map(tuple, store.upsert_machine_fields(t, new, "id", ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y")]
    with pytest.raises(V.ValidationError):
        store.delete_restrict(t, t, "id", t.limit(1))


def test_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.txt").write_text("0 0.5 0.5 0.1 0.1\n0 0.5 0.5 0.1 0.1\n9 0.5 0.5 0.1 0.1\n")
    (tmp_path / "l/b.txt").write_text("1 0.5 0.5 0.1 0.1\n\n")
    boxes, issues = files.parse_labels(files.label_rows(spark, str(tmp_path / "l")), 6)
    assert boxes.count() == 3 and {(r.row, r.code) for r in issues.collect()} == {(2, "duplicate"), (3, "class_id")}
    assert files.strict_files(boxes, issues).count() == 1
    arrays = spark.createDataFrame([("b", [1, 0], [0.5, 0.9], [[1.0], [2.0]]), ("a", [0], [0.1], [[3.0]])], "image_id string, class_ids array<int>, confidences array<double>, boxes array<array<double>>")
    assert [(r.id[-1], r.image_id, r.class_id) for r in files.normalised_predictions(arrays).orderBy("id").collect()] == [("0", "a", 0), ("1", "b", 0), ("2", "b", 1)]
    d = spark.createDataFrame([(2, [1, 2]), (1, [])], "id long, a array<int>")
    files.write_csv(d, str(tmp_path / "out"), ["id"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ["id", "a"]).collect()] == [("1", "[]"), ("2", "[1,2]")]
    with pytest.raises(ValueError):
        files.write_csv(d.limit(0), str(tmp_path / "none"), ["id"])

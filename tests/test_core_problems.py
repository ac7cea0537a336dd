import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import proximity as P, quarantine as Q

LINES = "line_id long, feed string, file_name string, line_no int, line string"
GOOD = "3,10.5,1,1,1,0.5,0.5,0.5,0.5,1,1,1,0.1,0.1,1e-3,ok"


def judged(spark, *lines):
    rows = [(i, feed, "f", 2, line) for i, (feed, line) in enumerate(lines)]
    got = {r.line_id: r.reason for r in Q.rejected(spark.createDataFrame(rows, LINES)).collect()}
    return [got.get(i) for i in range(len(lines))]


def test_results_reasons(spark):
    r = lambda s: ("results", s)
    swap = lambda i, v: ",".join(v if k == i else x for k, x in enumerate(GOOD.split(",")))
    cases = {
        GOOD: None, GOOD + "\r": None, swap(0, " +3 "): None, swap(1, '"10.5"'): None, swap(15, '"a, b ""c"""'): None, swap(15, '""'): None, swap(15, ""): None,
        swap(15, 'a"b'): "broken_quoting", swap(15, '"a'): "broken_quoting", swap(15, '"a"b'): "broken_quoting", swap(15, 'a""b'): "broken_quoting", GOOD + '"': "broken_quoting",
        GOOD + ",x": "column_count", "1,2": "column_count", swap(0, "0"): "invalid_value", swap(0, "1.0"): "invalid_value", swap(0, "-1"): "invalid_value",
        swap(2, "1_0"): "invalid_value", swap(2, "nan"): "invalid_value", swap(2, "Infinity"): "invalid_value", swap(2, "1e999"): "invalid_value", swap(2, "-0.1"): "invalid_value", swap(5, "1.01"): "invalid_value",
        swap(2, ""): "invalid_value", "   ": None, "": None,
    }
    assert judged(spark, *map(r, cases)) == list(cases.values())


def test_box_reasons(spark):
    cases = {
        "1 0.5 0.5 0.1 0.1": None, "1\t0.5  0.5 0.1 1\r": None, " 5 0 1 1 .5 ": None, "6 0.5 0.5 0.1 0.1": "invalid_value", "01 0.5 0.5 0.1 0.1": "invalid_value",
        "1 0.5 0.5 0 0.1": "invalid_value", "1 1.1 0.5 0.1 0.1": "invalid_value", "1 0.5 0.5 0.1": "column_count", "1;0.5;0.5;0.1;0.1": "column_count", "1 0,5 0.5 0.1 0.1": "invalid_value",
    }
    assert judged(spark, *(("boxes", c) for c in cases)) == list(cases.values())


def test_quarantine_edges(spark):
    rows = [(1, "results", "f", 1, "epoch,..."), (2, None, "f", 2, "x"), (3, "boxes", "f", 1, None), (4, "boxes", "f", 1, "x" * 200_000), (5, "results", "f", 2, '"' * 100_001), (6, "results", "f", 2, "epoch\x01," + "," * 14)]
    df = spark.createDataFrame(rows, LINES).withColumn("f", F.lit(1)).withColumn("v", F.lit(2))
    assert {(r.line_id, r.reason) for r in Q.rejected(df).collect()} == {(4, "column_count"), (5, "broken_quoting"), (6, "invalid_value")}
    empty = spark.createDataFrame([], LINES)
    assert Q.rejected(empty).count() == Q.load_results(empty).count() == Q.load_boxes(empty).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "great_circle"])
def test_radius_join_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    n, dims = 900, 3 if metric == "euclidean" else 2
    p = rng.normal(0, 1, (n, dims)) if dims == 3 else rng.normal((50, 8), 0.05, (n, 2))
    p[:60] = p[0]  # many on one spot
    g = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n))
    radius = 0.3 if dims == 3 else 900.0
    rows = [(f"k{i:04d}", int(g[i]), *map(float, p[i])) for i in range(n)]
    names = ["x", "y", "z"][:dims]
    df = spark.createDataFrame(rows, "key string, grp int, " + ", ".join(f"{c} double" for c in names))
    got = {(r.key_a, r.key_b) for r in P.radius_join(df, "key", "grp", tuple(names), radius, metric, cell_points=40).collect()}
    d = P.METRICS[metric]
    want = {(rows[i][0], rows[j][0]) for i in range(n) for j in np.flatnonzero((d(p, p[i]) <= radius) & (g == g[i])) if i < j}
    assert got == want


def test_radius_join_edges(spark):
    schema = "key string, grp int, x double, y double, z double, cell int"
    rows = [("a", 1, 0.0, 0.0, 1.0, 0), ("b", 1, 0.0, 0.25, 1.0, 0), ("b", 1, 0.0, 0.25, 1.0, 0), ("c", 1, None, 0.0, 1.0, 0), ("d", 1, float("nan"), 0.0, 1.0, 0), ("e", None, 0.0, 0.0, 1.0, 0), (None, 1, 0.0, 0.0, 1.0, 0), ("f", 2, 0.0, 0.0, 1.0, 0)]
    join = lambda r: [tuple(x)[:2] for x in P.radius_join(spark.createDataFrame(r, schema), "key", "grp", ("x", "y", "z"), 0.25).collect()]
    assert join(rows) == [("a", "b")]
    assert join([]) == []


def test_tree_join_is_complete():
    random.seed(1)
    p = np.round(np.random.default_rng(5).random((500, 3)), 1)
    hits = {(a, b) for q, o in P.tree_join(p, p, 0.2, P.euclidean, leaf=8) for a, b in zip(q.tolist(), o.tolist())}
    want = {(i, j) for i in range(500) for j in np.flatnonzero(P.euclidean(p, p[i]) <= 0.2).tolist()}
    assert hits == want


def test_lookup_spreads_hot_keys(spark):
    from spanwise.operators import skew

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(900, None), (901, "gone")], "id long, k string")
    right = spark.createDataFrame([("hot", 1, None), ("k3", None, "x")] + [(f"k{i}", i, "y") for i in range(6, 300, 3)], "k string, v int, w string")
    hot = skew.hot_keys(left.groupBy("k").count(), ["k"], "count", 302, least=50)
    assert [r.k for r in hot.collect()] == ["hot"]
    got = {r.id: (r.v, r.w) for r in skew.lookup(left, right, ["k"], hot, F.col("id")).collect()}
    assert len(got) == 302 and got[1] == (1, None) and got[3] == (None, "x") and got[9] == (9, "y") and got[900] == got[901] == (None, None)
    assert skew.hot_keys(left.groupBy("k").count(), ["k"], "count", 302) is None
    assert {r.id: (r.v, r.w) for r in skew.lookup(left, right, ["k"], None, F.col("id")).collect()} == got

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import components, cross_split, eval_leaks, grouped_splits, mixture, nearest_time, survivors, truncation

MANIFEST = "image_id long, split string, source string, image_sha256 string, perceptual_hash string, file_size_bytes long"


def test_bands_cover_every_bit_once():
    for radius in (1, 2, 5, 12):
        bands = cross_split.plan_bands(radius)
        assert sum(b.slack + 1 for b in bands) == radius + 1
        bits = [h * 64 + s + i for b in bands for h, s, w in b.pieces for i in range(w)]
        assert len(bits) == len(set(bits))


def images(rng, n):
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(n)]
    out = []
    for i, b in enumerate(base):
        out.append((i, "train", b))
        for k in range(3):
            flips = rng.choice(128, size=int(rng.integers(0, 16)), replace=False)
            out.append((1000 * (k + 1) + i, ["VALID ", "testing", "Train"][k], b ^ sum(1 << int(f) for f in flips)))
    return out


def test_cross_split_brute_force(spark):
    rng = np.random.default_rng(17)
    rows = images(rng, 25) + [(9001, "train", 0), (9002, "test", 0), (9003, "train", 2**128 - 1), (9004, "test", 2**128 - 1)]
    data = [(i, s, "A b", None, f" 0x{v:032X} " if i % 3 == 0 else f"{v:032x}", 5) for i, s, v in rows]
    data += [(9100, "train", "q", "AB" * 32, None, 5), (9101, "val", "q", "ab" * 32, None, 5), (9102, "test", "q", "ab" * 32, None, 0), (9103, "test", None, None, "xyz", 5), (9104, None, None, "ab" * 32, None, 5)]
    df = spark.createDataFrame(data, MANIFEST).withColumn("hi", F.lit("clash")).withColumn("shard", F.lit(1))
    side = {i: "t" if s.strip().lower().startswith("train") else "e" for i, s, _ in rows}
    want = {(min(a, b), max(a, b)) for a, _, x in rows for b, _, y in rows if side[a] == "t" and side[b] == "e" and (x ^ y).bit_count() <= 12 and all(8 < v.bit_count() < 120 for v in (x, y))}
    got = cross_split.cross_split_pairs(df).collect()
    assert {(r.image_id_a, r.image_id_b) for r in got} == want | {(9100, 9101)}
    assert all(r.covered_bits for r in got if not r.sha256_equal)
    assert cross_split.cross_split_pairs(df.limit(0)).count() == 0


def test_hot_shard_is_chunked(spark):
    rng = np.random.default_rng(5)
    tail = [int.from_bytes(rng.bytes(8), "big") for _ in range(120)]
    rows = [((7 << 64) | t) for t in tail]  # one half in common
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(sign(v >> 64), sign(v & (2**64 - 1)), i % 3 > 0, i % 3 == 0) for i, v in enumerate(rows)], "hi long, lo long, in_train boolean, in_eval boolean")
    got = cross_split.hash_overlaps(df, passages_per_shard=10, texts_per_chunk=9)
    want = sum((a ^ b).bit_count() <= 12 for i, a in enumerate(rows) for j, b in enumerate(rows) if i % 3 == 0 and j % 3 > 0)
    assert got.count() == want


TIMES = "id long, run string, t long"


def nearest(spark, left, right, tolerance=10, **kw):
    l, r = spark.createDataFrame(left, TIMES), spark.createDataFrame(right, TIMES)
    return {x.left_id: x.right_id for x in nearest_time.nearest_in_time(l.withColumn("slot", F.lit(1)), r.withColumn("bucket", F.lit(1)), "run", "t", "id", tolerance, **kw).collect()}


def test_nearest_time_brute_force(spark):
    rng = np.random.default_rng(4)
    left = [(i, f" R{i % 2} ", int(t)) for i, t in enumerate(rng.integers(-400, 400, 150))]
    right = [(i, f"r{i % 2}", int(t)) for i, t in enumerate(rng.integers(-400, 400, 90))]
    want = {}
    for i, run, t in left:
        c = [(abs(u - t), u, j) for j, r, u in right if r == run.strip().lower() and u != 0 and abs(u - t) <= 10]
        if c and t != 0:
            want[i] = min(c)[2]
    assert nearest(spark, left, right, slot_widths=2) == want
    assert nearest(spark, left, right, first_width=1) == want


def test_nearest_time_edges(spark):
    left = [(1, "a", 100), (2, "a", 100), (3, None, 100), (4, "a", None), (5, "a", 0), (6, "b", 100), (7, "a", 2**63 - 1), (8, "a", 111), (9, "z", 2**63 - 1), (10, "z", -(2**63)), (11, "z", 2**63 - 30)]
    right = [(1, "A", 95), (2, "a", 105), (3, "a ", 95), (4, "a", None), (5, "c", 100), (6, "z", 2**63 - 5), (7, "z", -(2**63) + 9)]
    assert nearest(spark, left, right) == {1: 1, 2: 1, 8: 2, 9: 6, 10: 7}
    assert nearest(spark, left, right, tolerance=3) == {}
    assert nearest(spark, [], right) == {} and nearest(spark, left, []) == {}


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 90)] + [(500, 501), (501, 500), (500, 502), (7, 7), (None, 3)] + [(1000, k) for k in range(1001, 1100)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 10 for i in range(10, 91)} | {500: 500, 501: 500, 502: 500} | {k: 1000 for k in range(1000, 1100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hot_labels_and_hubs(spark):
    edges = [(1, k) for k in range(2, 400)] + [(k, k + 1) for k in range(400, 460)] + [(399, 400), (1000, 1001)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), hot_rows=20).collect())
    assert got == {k: 1 for k in range(1, 461)} | {1000: 1000, 1001: 1000}


def test_consensus_votes_and_priority():
    assert survivors.consensus(["a/b.txt", "a/c.txt", "a/c.txt"], [1.0, 1.0, 1.0]) == ["a", "/", "c", ".", "txt"]
    assert survivors.closest(["a/b.txt", "a/c.txt", "x"], [0.5, 0.25, 0.125]) == 0
    assert survivors.closest(["x y", "x z", "x z"], [1.0, 1.0, 1.0]) == 1
    assert survivors.distance(list("kitten"), list("sitting")) == 3


RECORDS = "record_id long, duplicate_group_id string, inclusion_reason string, exclusion_reason string, recorded_at timestamp, label_relative_path string, annotation_count int, class_ids string, width int, height int"


def test_image_survivors(spark):
    rows = [
        (1, " dg_1", "IN", " ", None, "n/a", -1, "[1]", 5, 5), (2, "DG_1", "IN", "OUT", None, "p", 3, "[1]", 5, 5), (3, "DG_1 ", "IN", None, None, "q", None, "?", 0, 5),
        (4, "DG_2", None, None, None, None, None, None, None, None), (5, "DG_2", "", "", None, "", None, "", 0, -1), (6, "DG_3", "IN", None, None, "p", 1, "[]", 1, 1), (7, " ", "IN", None, None, "p", 1, "[]", 1, 1), (8, None, "IN", None, None, "p", 1, "[]", 1, 1),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("rank", F.lit("clash")).withColumn("value", F.lit(1))
    got = {(r.group_id, r.field_name): r.record_id for r in survivors.image_survivors(df).collect()}
    assert got == {("DG_1", "record"): 1, ("DG_1", "label_relative_path"): 3, ("DG_1", "annotation_count"): 2, ("DG_1", "class_ids"): 1, ("DG_1", "width"): 1, ("DG_1", "height"): 1, ("DG_2", "record"): 4}
    assert survivors.image_survivors(df.limit(0)).count() == 0


def test_weighted_vote_of_all_values(spark):
    rows = [("g", "f", "x/a.txt", i, 1.0) for i in range(3)] + [("g", "f", f"y/b{i}.txt", 10 + i, 0.1) for i in range(8)] + [("g", "f", "x/c.txt", 30 + i, 1.0) for i in range(5)]
    long = spark.createDataFrame(rows, "group_id string, field_name string, value string, record_id long, w double")
    order = [F.col("record_id").asc()]
    for chunk, hot in ((200, 100_000), (3, 2)):
        assert [tuple(r) for r in survivors.consensus_survivors(long, order, F.col("w"), chunk, hot).collect()] == [("g", "f", "x/c.txt", 30, 10)]
    assert [tuple(r)[2:4] for r in survivors.ranked_survivors(long, order).collect()] == [("x/a.txt", 0)]
    assert survivors.consensus_survivors(long.limit(0), order, F.col("w")).count() == 0


def test_ranked_survivors_hold_no_vote(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{rng.integers(40)}", f"f{rng.integers(3)}", "/".join(rng.choice(list("abc"), 4)), i, int(rng.integers(5))) for i in range(2000)]
    long = spark.createDataFrame(rows, "group_id string, field_name string, value string, record_id long, age int")
    order = [F.col("age").desc(), F.col("record_id").asc()]
    first = {}
    for g, f, v, i, a in sorted(rows, key=lambda r: (-r[4], r[3])):
        first.setdefault((g, f), (v, i))
    got = survivors.ranked_survivors(long, order)
    assert {(r.group_id, r.field_name): (r.value, r.record_id) for r in got.collect()} == first and got.columns == long.columns[:4]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()  # a vote that the order has decided isn't held
    raw = long.withColumn("value", F.unhex(F.concat(F.lit("FF"), F.hex("value"))).cast("string"))  # bytes that are no text pass through
    assert {(r[0], r[1]): r[2] for r in survivors.ranked_survivors(raw, order).select("group_id", "field_name", F.hex("value")).collect()} == {k: "FF" + v.encode().hex().upper() for k, (v, _) in first.items()}


def test_consensus_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):  # no value has all the winning tokens but one
        parts = [p if rng.random() < 0.7 else f"q{rng.integers(50)}" for p in ("data", "north", "bridge", "pier")]
        rows.append(("g", "f", "/".join([*parts, f"{i}"]), i, 1.0))
    rows.append(("g", "f", "data/north/bridge/pier", 900, 0.01))
    long = spark.createDataFrame(rows, "group_id string, field_name string, value string, record_id long, w double")
    got = survivors.consensus_survivors(long, [F.col("record_id").asc()], F.col("w"), 50, 10).first()
    assert got.value.startswith("data/north/bridge/pier") and got.voters == 701


def test_very_long_values_align():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(30_000)]
    other = [w if rng.random() > 0.001 else f"x{i}" for i, w in enumerate(base)]
    del other[500:510]
    got = survivors.align([{w: 1.0} for w in base], other)
    assert [i for i, _ in got if i >= 0] == list(range(len(base))) and [j for _, j in got if j >= 0] == list(range(len(other)))
    assert sum(i >= 0 and j >= 0 for i, j in got) > 29_900
    assert survivors.distance(base, other) < 60 and survivors.distance(base, base) == 0 and survivors.distance(["a"] * 40_000, ["b"] * 40_000) == 40_000
    assert survivors.closest([" ".join(base), " ".join(other), " ".join(other)], [1.0, 1.0, 1.0]) == 1
    for _ in range(200):  # small tables: the exact distance
        a, b = (list(rng.choice(list("abc"), int(rng.integers(0, 8)))) for _ in range(2))
        table = np.arange(len(b) + 1)[None, :] + np.arange(len(a) + 1)[:, None]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert survivors.distance(a, b) == table[-1, -1]


def test_consensus_of_empty_and_long_records(spark):
    df = spark.createDataFrame([(1, "G", None, None, None, "x " * 30_000, None, None, None, None), (2, "G", None, None, None, "y " * 30_000, None, None, None, None)], RECORDS)
    assert {(r.field_name, r.record_id) for r in survivors.image_consensus(df).collect()} == {("label_relative_path", 1)}
    assert survivors.image_survivors(df).count() == 2 and survivors.image_consensus(df.limit(0)).count() == 0


def test_image_consensus_outvotes_the_best_record(spark):
    t = "2026-01-01 00:00:00"
    rows = [(1, "G", "IN", None, t, "a/x.txt", 9, "[1]", 5, 5)] + [(i, "g", "IN", None, t, "a/y.txt", 3, "[2]", 5, None) for i in (2, 3, 4)]
    df = spark.createDataFrame(rows, RECORDS.replace("recorded_at timestamp", "recorded_at string")).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    got = {r.field_name: r.value for r in survivors.image_consensus(df).collect()}
    assert got == {"label_relative_path": "a/y.txt", "annotation_count": "3", "class_ids": "[2]", "width": "5", "height": "5"}
    first = {r.field_name: r.record_id for r in survivors.image_survivors(df).collect()}
    assert set(first.values()) == {1}


def test_grouped_splits(spark):
    rows = [(i, "Hot " if i < 600 else (f"g{i % 97}" if i < 1500 else None), ["train", "val", " TEST", "excluded", None][i % 5], f"[{i % 6}]" if i % 7 else "?") for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id long, leakage_group_id string, processed_split string, class_ids string")
    got = grouped_splits.record_splits(df).collect()
    assert len(got) == 3000 and len({r.component for r in got}) == len({(r.component, r.split) for r in got})
    share = {s: sum(r.split == s for r in got) / 3000 for s in grouped_splits.SHARES}
    assert all(abs(share[s] - v) < 0.02 for s, v in grouped_splits.SHARES.items()), share
    assert grouped_splits.record_splits(df.limit(0)).count() == 0
    divided = grouped_splits.image_splits(df).where("grouped and size(present_splits) > 1")
    assert divided.count() == 98


def test_labels_are_balanced_in_small_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i // int(rng.integers(2, 9))}", "train", f"[{int(rng.integers(0, 6))}]") for i in range(1200)]
    df = spark.createDataFrame(rows, "record_id long, leakage_group_id string, processed_split string, class_ids string")
    balance = grouped_splits.split_balance(grouped_splits.image_splits(df)).collect()
    off = {(r.split, r.label): abs(r.share - grouped_splits.SHARES[r.split]) for r in balance}
    assert len(off) == 21 and max(v for (_, label), v in off.items() if label == "size") < 0.005 and max(off.values()) < 0.03, off


def test_one_huge_component_and_many_of_middle_size(spark):
    parts = [("g:0", 40_000, [0])] + [(f"g:{i}", 300, [300 if i % 3 else 0]) for i in range(1, 201)] + [(f"r:{i}", 1, [i % 2]) for i in range(2_000)]
    df = spark.createDataFrame(parts, "component string, size long, labels array<long>")
    got = grouped_splits.assign_components(df, block=60).collect()
    size = {s: sum(r["size"] for r in got if r.split == s) / 102_000 for s in grouped_splits.SHARES}
    label = {s: sum(r["labels"][0] for r in got if r.split == s) / sum(x[2][0] for x in parts) for s in grouped_splits.SHARES}
    assert len(got) == 2_201 and all(abs(size[s] - v) < 0.01 and abs(label[s] - v) < 0.05 for s, v in grouped_splits.SHARES.items()), (size, label)


def test_search_grows_with_the_components():
    n = 20_000
    start = np.zeros(n, int)
    at = grouped_splits._search(np.ones(n, np.int64), np.zeros((n, 0)), np.full((3, 1), n / 3), start, 2, 6_000)
    assert np.abs(np.bincount(at, minlength=3) - n / 3).max() < 0.01 * n


def test_giants_are_balanced_on_labels(spark):
    giants = [(f"g:{i}", 100, [100 if i % 2 else 0]) for i in range(40)]
    loose = [(f"r:{i}", 1, [0]) for i in range(600)]
    parts = spark.createDataFrame(giants + loose, "component string, size long, labels array<long>")
    got = grouped_splits.assign_components(parts, {"a": 0.5, "b": 0.5}).collect()
    share = sum(r["labels"][0] for r in got if r["split"] == "a") / 2000
    size = sum(r["size"] for r in got if r["split"] == "a") / 4600
    assert abs(share - 0.5) < 0.01 and abs(size - 0.5) < 0.01 and len(got) == 640


ITEM = "Pump 12 lifts 40 mm of silt in Kelmoor while the crew of Ardvale waits near bay 7 for the second boat to come back"


def test_eval_leaks(spark):
    docs = [
        (1, "x. " + ITEM.upper() + " y"), (2, "Pump 77 lifts 90 cm of silt in Kelmoor while the crew of Ardvale waits near bay 3 for the second boat"), (3, " ".join(ITEM.split()[:12])), (4, None), (5, ""),
        (6, "crew of\nArdvale -- waits near: bay 7 for the second boat to come back tomorrow"), (7, "word " * 50_000), (8, "Pump 12 lifts 40 mm of silt in Selden while the crew of Marley waits near bay 7 for the second boat to come back"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("window", F.lit(1))
    items = spark.createDataFrame([(9, ITEM), (10, "short"), (11, None)], "item_id long, text string")
    for bound in (500_000, 3):  # one block and several
        got = {(r.doc_id, r.item_id): r.kind for r in eval_leaks.eval_leaks(df, items, block_windows=bound).collect()}
        assert got == {(1, 9): "verbatim", (6, 9): "verbatim", (2, 9): "reparameterised", (8, 9): "reparameterised"}
    assert eval_leaks.eval_leaks(df.limit(0), items).count() == 0


def judged(doc, item):
    coder = eval_leaks.Coder()
    return eval_leaks.judge(*coder.of([doc])[:2], *coder.of([item])[:2], 0, 13)


def test_slots_must_be_consistent():
    item = "move 5 from a to b then 5 from c to d and stop here now please"
    good = item.replace("5", "8")
    bad = item.replace("5", "8", 1)
    assert judged(good, item)[1] >= 13
    assert judged(bad, item)[1] < 13


def test_units_follow_numbers():
    item = "the crew put a new pipe in the old wall for the boats to pass"
    assert judged(item.replace(" in ", " a "), item)[2] == 0
    item = "the crew put a new pipe of 40 mm in the old wall for the boats"
    assert judged(item.replace("40 mm", "70 cm"), item)[1:] == (16, 2)


def test_copies_of_items_and_texts_of_capitals(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM.upper().replace("12", "31"))], "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM), (6, ITEM), (7, ITEM.lower())], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in eval_leaks.eval_leaks(docs, items).collect()}
    assert got == {(1, i): "verbatim" for i in (5, 6, 7)} | {(2, i): "verbatim" for i in (5, 6, 7)}


def test_tables_of_numbers_are_no_templates(spark):
    table = " ".join(str(i) for i in range(100, 4_000))
    items = spark.createDataFrame([(1, " ".join(str(7 * i) for i in range(40))), (2, " ".join(str(i) for i in range(500, 520)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, table), (2, "word " * 20_000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind, r.verbatim_words) for r in eval_leaks.eval_leaks(docs, items).collect()} == {(1, 2, "verbatim", 20)}
    same = spark.createDataFrame([(9, "word " * 60)], "item_id long, text string")
    assert {(r.doc_id, r.verbatim_words) for r in eval_leaks.eval_leaks(docs, same).collect()} == {(2, 60)}


def longest_consistent(doc, item):
    """Brute force on one diagonal: the words of the longest run with replaced slots that map one-to-one."""
    coder = eval_leaks.Coder()
    (a, ka, _), (b, kb, _), best = coder.of([doc]), coder.of([item]), 0
    for s in range(len(b)):
        for e in range(s + 1, min(len(a), len(b)) + 1):
            pairs = list(zip(b[s:e].tolist(), a[s:e].tolist(), kb[s:e].tolist(), ka[s:e].tolist()))
            slots = {(k, x, y) for x, y, k, o in pairs if k and k == o}
            fits = all(x == y or k == o and k for x, y, k, o in pairs)
            one = len(slots) == len({(k, x) for k, x, _ in slots}) == len({(k, y) for k, _, y in slots})
            if fits and one and any(x != y for x, y, _, _ in pairs):
                best = max(best, e - s)
    return best


def test_a_conflict_drops_only_what_is_before_it(spark):
    words = "5 crew men lift long beams over old piers and wait until 5 more boats come back here with sand for all the walls".split()
    other = ["8", *words[1:12], "9", *words[13:]]
    assert judged(" ".join(other), " ".join(words))[1:] == (len(words) - 1, 1)
    rng = np.random.default_rng(6)
    for _ in range(300):
        item = [str(rng.choice(["1", "2", "3", "mm", "cm", "the", "pier"])) for _ in range(24)]
        doc = [str(rng.choice(["1", "2", "mm", "km"])) if rng.random() < 0.4 else w for w in item]
        got = judged(" ".join(doc), " ".join(item))
        want = longest_consistent(" ".join(doc), " ".join(item))
        assert (got[1], got[2] > 0) == (want, True) if want >= 13 else got[1] < 13 or got[2] == 0
    item = "5 crew men lift long beams over old piers and wait until 5 more boats come back here with sand for all the walls"
    docs = spark.createDataFrame([(1, item.replace("5", "8", 1).replace("5", "9", 1))], "doc_id long, text string")
    items = spark.createDataFrame([(2, item)], "item_id long, text string")
    assert [tuple(r)[:3] for r in eval_leaks.eval_leaks(docs, items).collect()] == [(1, 2, "reparameterised")]


def test_mixture(spark):
    docs = [(i, ["Big Src", "big-src", "small"][0 if i < 300 else 1 if i < 500 else 2], "word " * (1 + i % 9)) for i in range(560)] + [(900, "small", None), (901, "small", ""), (902, "other", "x"), (903, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("bucket", F.lit(0))
    targets = spark.createDataFrame([("big_src", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    plan, shares = mixture.mixture(df, targets, bucket_rows=50, slopes={"small": 0.5})
    rows = plan.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    uses = {}
    for r in rows:
        uses[r.source, r.doc_id] = uses.get((r.source, r.doc_id), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "small") <= 3 and max(n for (s, _), n in uses.items() if s == "big_src") == 1
    got = {r.source: r for r in shares.collect()}
    assert got["small"].actual_share == pytest.approx(0.4, abs=0.01) and got["gone"].uses == 0
    late = [r.position for r in rows if r.source == "small"]
    assert sum(late) / len(late) > 0.55  # its weight grows
    assert mixture.mixture(df.limit(0), targets)[0].count() == 0


def test_schedules_balance():
    targets = np.array([0.5, 0.3, 0.2])
    times, weights = mixture.schedule_weights(targets, [[], [(0, 1), (0.5, 4), (1, 1)], [(0, 3), (1, 0.2)]])
    assert np.allclose(weights.sum(0), 1) and np.allclose(((weights[:, 1:] + weights[:, :-1]) / 2 * np.diff(times)).sum(1), targets, atol=1e-9)
    assert weights[1, 1] > 1.5 * weights[1, 0] and weights[2, 0] > weights[2, -1]


def test_curriculum_follows_its_schedules(spark):
    docs = [(i, "abc"[i % 3], "word " * 4) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    schedules = {"b": [(0.0, 1.0), (0.5, 4.0), (1.0, 1.0)], "c": [(0.0, 3.0), (1.0, 0.2)]}
    rows = mixture.mixture(df, targets, schedules=schedules, bucket_rows=100)[0].collect()
    tokens, whole = 0, sum(r.tokens for r in rows)
    for r in rows:  # the position is the part of the training that lies before it
        assert abs(r.position - tokens / whole) < 0.01
        tokens += r.tokens
    for lo, hi in ((0.0, 0.25), (0.375, 0.625), (0.75, 1.0)):
        part = [r.source for r in rows if lo <= r.position < hi]
        times, weights = mixture.schedule_weights(np.array([0.5, 0.3, 0.2]), [[], schedules["b"], schedules["c"]])
        x = np.linspace(lo, hi, 101)
        for i, s in enumerate("abc"):
            assert abs(part.count(s) / len(part) - np.interp(x, times, weights[i]).mean()) < 0.02
    passes = {p: [r.doc_id for r in rows if r.source == "a" and r["pass"] == p] for p in (0, 1)}
    assert passes[1] and passes[0][: len(passes[1])] != passes[1]


def test_mixture_without_tokens_of_a_source(spark):
    docs = [(i, "a" if i < 40 else "b", "word " * 5) for i in range(100)] + [(200, "blank", ""), (201, "unused", "word " * 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("gone", 0.2, 3), ("blank", 0.1, 3), ("unused", 0.1, 0)], "source string, target_share double, max_repeats int")
    plan, shares = mixture.mixture(df, targets)
    got = {r.source: r for r in shares.collect()}
    assert got["a"].uses == 40 and got["b"].uses == pytest.approx(40, abs=1) and got["a"].actual_share == pytest.approx(0.5, abs=0.01)
    assert all(got[s].uses == got[s].tokens == 0 and got[s].actual_share == 0 for s in ("gone", "blank", "unused"))
    assert plan.count() == got["a"].uses + got["b"].uses


def test_token_count_round_trip(spark):
    encoding = mixture._encoding(mixture.TOKENIZER)
    text = "Crack 0.3 mm — Überbau, señal!\n\n  two  spaces"
    ids = encoding.encode_ordinary(text)
    assert encoding.decode(ids) == text
    assert spark.range(1).select(mixture.token_count(F.lit(text))).first()[0] == len(ids)


def test_truncation(spark):
    whole = ["The deck is dry. The pier is wet.", "The pier is wet. The deck is dry.", "The deck is dry.\nwill do", "The pier is wet. will do", "A wall is dry\n- pier cap: a crack\n- wall: a crack", "- wall: a crack\n- deck: a crack", "Is the deck dry?", "The pier is wet\n", "“The deck is dry.”"] * 3
    cut = ["The deck is dry. The pier", "The deck is d", "The deck is dry. The pi...", "The pier is wet. The deck is\n", "The deck is dry,", "- wall: a cr"]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(1000 + i, "s", t) for i, t in enumerate(cut)] + [(2000, None, None), (2001, None, " "), (2002, None, ""), (2003, None, "The deck " * 20_000 + "is dry.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("token", F.lit(1))
    assert {r.doc_id for r in truncation.truncated(df).collect()} == {1000 + i for i in range(len(cut))}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_length_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "Lim ited", "x" * int(rng.integers(20, 99))) for i in range(400)] + [(500 + i, "lim_ited", "y" * 100) for i in range(40)]
    rows += [(i, "free", "x" * int(rng.integers(20, 120))) for i in range(400)]
    rows += [(i, "bytes", "x" * int(rng.integers(20, 90))) for i in range(400)] + [(i, "bytes", "é" * 50 if i % 2 else "é" * 49 + "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {(r.source, r.unit, r.limit) for r in truncation.length_limits(df).collect()}
    assert ("lim_ited", "chars", 100) in got and ("bytes", "bytes", 100) in got and not any(s == "free" for s, _, _ in got)


def test_limits_hold_below_a_few_longer_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "s", "x" * int(rng.integers(20, 99))) for i in range(400)] + [(500 + i, "s", "y" * 100) for i in range(40)] + [(900, "s", "z" * 140), (901, "s", "z" * 103)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {(r.unit, r.limit) for r in truncation.length_limits(df).collect()} == {("chars", 100), ("bytes", 100)}


def test_limit_rows_need_no_ending_model(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    whole = [" ".join(word(5) for _ in range(int(rng.integers(3, 14)))) + "." for _ in range(300)]
    cut = [(" ".join(word(5) for _ in range(20)))[:90] for _ in range(30)]
    kept = [(" ".join(word(5) for _ in range(20)))[:89] + "." for _ in range(5)]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(1000 + i, "s", t) for i, t in enumerate(cut)] + [(2000 + i, "s", t) for i, t in enumerate(kept)]
    got = truncation.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("by_limit").collect()
    assert {r.doc_id for r in got} == {1000 + i for i in range(30)}


@pytest.mark.parametrize("hot, bits", [(100_000, 24), (2, 8)])
def test_hot_endings_and_a_full_sieve_change_nothing(spark, hot, bits):
    rows = [(i, "s", f"The deck {i % 7} is dry.\nwill do") for i in range(60)] + [(100 + i, "s", f"The deck {i} is") for i in range(40)] + [(200, "s", "The deck is d"), (201, "s", "x" * 50), (202, "s", "A " + "x" * 60 + ".")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.truncated(df, hot_rows=hot, sieve_bits=bits).collect()} == {100 + i for i in range(40)} | {200, 201}


def test_last_unit_is_the_last_of_all():
    for text in ("One. Two 3.5 m wide", "a\n\nb c\n", "v1.2.3", "no end", "x. 4.5", "end.5", "...", "", "a.1 b.2"):
        units, now = [], []
        for t in truncation._TOKEN.findall(text):
            if t[0] in truncation.ENDS:
                units.append(now)
                now = []
            else:
                now.append("9" if t[0].isdigit() else t.lower())
        want = next((u for u in reversed([*units, now]) if u), [])
        assert truncation.last_unit(text) == want, text

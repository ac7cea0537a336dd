"""Inventories of images and labels: pairing, unmatched files, fuzzy candidates, duplicates, neighbours, snapshots."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanwise.functions import scalars as X
from spanwise.session import cut


def pair_unique(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, image, label, status): every image and label, paired by keys that are unique on both sides.

    exact_pair: the key occurs once on each side; image_without_label and
    label_without_image: the other side lacks the key, however often it repeats here;
    ambiguous: both sides have it and one repeats it; such files are told one by one, never paired.
    Needs columns image and label; rows with a null key pair with nothing.
    """
    shape = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    ni, nl = shape(images.where(known), "n_image"), shape(labels.where(known), "n_label")
    sizes = ni.join(nl, keys, "full_outer").fillna(0, ["n_image", "n_label"])
    i = images.join(sizes, keys, "left").withColumn("single", F.coalesce((F.col("n_image") == 1) & (F.col("n_label") == 1), F.lit(False)))
    l = labels.join(sizes, keys, "left").withColumn("single", F.coalesce((F.col("n_image") == 1) & (F.col("n_label") == 1), F.lit(False)))
    none = F.lit(None).cast("string")
    pairs = i.where("single").select(*keys, "image").join(l.where("single").select(*keys, "label"), keys).select(*keys, "image", "label", F.lit("exact_pair").alias("status"))
    rest = lambda n, alone: F.when(F.coalesce(F.col(n), F.lit(0)) == 0, alone).otherwise("ambiguous").alias("status")
    left = i.where("not single").select(*keys, "image", none.alias("label"), rest("n_label", "image_without_label"))
    right = l.where("not single").select(*keys, none.alias("image"), "label", rest("n_image", "label_without_image"))
    return pairs.unionByName(left).unionByName(right)


def duplicate_names(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose key occurs more than once, with the number of times."""
    many = entries.groupBy(*keys).agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
    return entries.join(many, keys)


def found_elsewhere(unmatched: DataFrame, opposite: DataFrame) -> DataFrame:
    """Adds `elsewhere`: the names with the same key in other splits of the opposite side, as sorted 'split/name' joined by commas; empty for none.

    Both: (split, key, name). The names of one key meet as one text.
    """
    met = unmatched.select("split", "key").distinct().join(opposite.select(F.col("split").alias("s"), "key", F.col("name").alias("n")), "key").where("s <> split")
    names = met.groupBy("split", "key").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "s", "n"))), ",").alias("elsewhere"))
    return unmatched.join(names, ["split", "key"], "left").fillna("", ["elsewhere"])


def classify_unmatched(unmatched: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds `classification`: expected_negative_external_evidence for (split, key) in `expected`, else unexplained_missing_label."""
    known = expected.select("split", "key", F.lit(True).alias("hit")).distinct()
    cell = F.when(F.col("hit"), "expected_negative_external_evidence").otherwise("unexplained_missing_label")
    return unmatched.join(known, ["split", "key"], "left").withColumn("classification", cell).drop("hit")


def pairing_summary(pairs: DataFrame, split: str = "split") -> DataFrame:
    """Per split: files of each status, from pair_unique."""
    n = lambda status, side: F.count_if((F.col("status") == status) & F.col(side).isNotNull())
    return pairs.groupBy(split).agg(
        F.count("image").alias("images"), F.count("label").alias("labels"), n("exact_pair", "image").alias("exact_pairs"), n("image_without_label", "image").alias("images_without_labels"),
        n("label_without_image", "label").alias("labels_without_images"), n("ambiguous", "image").alias("ambiguous_images"), n("ambiguous", "label").alias("ambiguous_labels"),
    )


def _scored(met: DataFrame) -> DataFrame:
    gap = F.abs(X.numeric_stem(F.col("left_name")) - X.numeric_stem(F.col("right_name"))).cast("bigint")
    return met.withColumn("distance", F.levenshtein("left_name", "right_name")).withColumn("similarity", X.similarity(F.col("left_name"), F.col("right_name"))).withColumn("numeric_gap", gap)


def _closeness() -> list[Column]:
    """Edit distance, then similarity, then the difference of numbers (null last), then the right side's split and name."""
    return [F.col("distance"), F.col("similarity").desc(), F.col("numeric_gap").asc_nulls_last(), X.split_rank(F.col("right_split")), F.lower("right_name"), F.col("right_name"), F.col("right_id")]


def fuzzy_candidates(left: DataFrame, right: DataFrame, top: int = 10, block: int = 1_000) -> DataFrame:
    """Per left name the `top` closest right names, in two scopes: same_split and all_splits.

    left: (left_id, left_split, left_name), a stated query set (the names that
    found no partner); right: (right_id, right_split, right_name), all rows. Columns: left_id, scope,
    right_id, right_split, distance, similarity, numeric_gap, rank; see _closeness for the order. The query set goes
    through the right side in blocks of `block` names, held in the plan; the best
    of each task are kept before anything is shuffled. Null names have and are no candidates.
    """
    asked = left.where("left_name is not null").select("left_id", "left_split", "left_name").distinct().orderBy("left_id").collect()  # the query set
    out = None
    kinds = dict(left.dtypes)
    for k in range(0, max(len(asked), 1), block):
        own = [F.struct(F.lit(r.left_id).cast(kinds["left_id"]).alias("left_id"), F.lit(r.left_split).cast("string").alias("left_split"), F.lit(r.left_name).alias("left_name")) for r in asked[k : k + block]]
        if not own:
            own_rows = right.sparkSession.createDataFrame([], f"left_id {kinds['left_id']}, left_split string, left_name string")
            met = right.where("false").select("right_id", "right_split", "right_name").join(own_rows, F.lit(False), "inner")
        else:
            met = right.where("right_name is not null").select("right_id", "right_split", "right_name", F.explode(F.array(*own)).alias("x")).select("x.*", "right_id", "right_split", "right_name")
        scored = _scored(met)
        for scope, rows in (("all_splits", scored), ("same_split", scored.where("left_split = right_split"))):
            rank = F.row_number().over(Window.partitionBy("left_id").orderBy(*_closeness()))
            best = rows.withColumn("rank", rank).where(F.col("rank") <= top).select("left_id", F.lit(scope).alias("scope"), "right_id", "right_split", "distance", "similarity", "numeric_gap", "rank")
            out = best if out is None else out.unionByName(best)
    return out


def rerank_unmatched(left: DataFrame, unmatched: DataFrame, matched: DataFrame, cached: DataFrame, top: int = 5, near: int = 2, block: int = 1_000) -> DataFrame:
    """Per left name the unmatched right names of its split: the `top` closest and those whose number is at most `near` off.

    left and unmatched as for fuzzy_candidates; names whose (split, key) is
    in `matched` are occupied and left out; equal names of one split count once. Distances in `cached` (left_id, right_split,
    right_name, distance) are taken from there, others worked out. Adds rank and reason (top or numeric_neighbour).
    """
    free = unmatched.withColumn("key", X.pairing_key(F.col("right_name"))).join(matched.select(F.col("split").alias("right_split"), "key").distinct(), ["right_split", "key"], "left_anti")
    free = free.groupBy("right_split", "right_name").agg(F.min("right_id").alias("right_id"))
    asked = left.where("left_name is not null").select("left_id", "left_split", "left_name").distinct()
    met = asked.join(free, F.col("left_split") == F.col("right_split"))  # unmatched names of one split, a query set against a query set
    known = cached.groupBy("left_id", "right_split", "right_name").agg(F.min("distance").alias("known"))
    scored = _scored(met.join(known, ["left_id", "right_split", "right_name"], "left")).withColumn("distance", F.coalesce("known", "distance"))
    longest = F.greatest(F.length("left_name"), F.length("right_name"), F.lit(1))
    scored = scored.withColumn("similarity", 1 - F.col("distance") / longest)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(*_closeness()))
    reason = F.when(F.col("rank") <= top, "top").when(F.col("numeric_gap") <= near, "numeric_neighbour")
    return scored.withColumn("rank", rank).withColumn("reason", reason).where("reason is not null").select("left_id", "right_id", "distance", "similarity", "numeric_gap", "rank", "reason")


def pair_features(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, distance) with what their images have in common.

    images: (id, split, filename, sha, width, height, make, model, taken, digitised, telling). Adds split_pair,
    sha256_equal, dimensions_match, severity (exact_content_cross_split without a distance), numeric_gap,
    same_camera, same_capture_time (the original time, else the other), low_information. Blanks count as missing.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    taken = F.coalesce(text("taken"), text("digitised"))
    one = images.select("id", "split", "sha", "width", "height", X.numeric_stem(F.col("filename")).alias("number"), text("make").alias("make"), text("model").alias("model"), taken.alias("time"), "telling")
    side = lambda s: one.select(*(F.col(c).alias(f"{c}_{s}") for c in one.columns))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    same = lambda c: F.coalesce(a(c) == b(c), F.lit(False))
    camera = (a("make").isNotNull() | a("model").isNotNull()) & a("make").eqNullSafe(b("make")) & a("model").eqNullSafe(b("model"))
    return both.select(
        "id_a", "id_b", "distance", X.split_pair(a("split"), b("split")).alias("split_pair"), same("sha").alias("sha256_equal"), (same("width") & same("height")).alias("dimensions_match"),
        F.when(F.col("distance").isNull(), "exact_content_cross_split").otherwise(X.distance_severity(F.col("distance"))).alias("severity"),
        F.abs(a("number") - b("number")).cast("bigint").alias("numeric_gap"), camera.alias("same_camera"), same("time").alias("same_capture_time"), (~a("telling") | ~b("telling")).alias("low_information"),
    )


def join_once(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of a one-to-one join: rows of keys that occur once on both sides with equal `equal` columns (null equals null).

    issues: (keys, code), code being left_missing, right_missing, left_repeats, right_repeats or differs:column.
    Columns of the right side other than keys and `equal` are added to the left's.
    """
    more = [c for c in right.columns if c not in left.columns]
    l = left.groupBy(*keys).agg(F.count("*").alias("nl"), F.first(F.struct(*[c for c in left.columns if c not in keys])).alias("l"))
    r = right.groupBy(*keys).agg(F.count("*").alias("nr"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("r"))
    both = l.join(r, keys, "full_outer")
    codes = {"left_missing": F.col("nl").isNull(), "right_missing": F.col("nr").isNull(), "left_repeats": F.col("nl") > 1, "right_repeats": F.col("nr") > 1}
    codes |= {f"differs:{c}": F.col("nl").isNotNull() & F.col("nr").isNotNull() & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in equal}
    coded = both.withColumn("codes", F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items()))))
    rows = coded.where(F.size("codes") == 0).select(*keys, *(F.col(f"l.{c}").alias(c) for c in left.columns if c not in keys), *(F.col(f"r.{c}").alias(c) for c in more))
    return rows, coded.select(*keys, F.explode("codes").alias("code"))


def listed_rows(listed: DataFrame, manifest: DataFrame, excluded: DataFrame, unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows in the list's order, issues) of a list (position, path) against a manifest.

    issues: (position, path, code): unknown (no manifest row), several (more than one), excluded, listed_twice,
    and repeats:column where two entries share a non-null value of a `unique` column.
    """
    found = listed.join(manifest.groupBy("path").agg(F.count("*").alias("hits")), "path", "left").join(excluded.select("path", F.lit(True).alias("out")).distinct(), "path", "left")
    times = listed.groupBy("path").agg(F.count("*").alias("times"))
    rows = listed.join(manifest, "path")
    issues = found.join(times, "path").select("position", "path", F.explode(F.array_compact(F.array(
        F.when(F.col("hits").isNull(), "unknown"), F.when(F.col("hits") > 1, "several"), F.when(F.col("out"), "excluded"), F.when(F.col("times") > 1, "listed_twice"),
    ))).alias("code"))
    for c in unique:
        many = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("path").alias("n")).where("n > 1")
        issues = issues.unionByName(rows.join(many.select(c), c, "left_semi").select("position", "path", F.lit(f"repeats:{c}").alias("code")))
    return rows.orderBy("position"), issues


def partition_issues(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, code): keys of the whole that no part has (missing) or several have (overlap), and keys of parts that the whole lacks (foreign)."""
    all_ = None
    for i, part in enumerate(parts):
        one = part.select(key).distinct().withColumn("part", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one)
    n = all_.groupBy(key).agg(F.count("*").alias("n"))
    both = whole.select(key).distinct().withColumn("own", F.lit(True)).join(n, key, "full_outer")
    code = F.when(F.col("own").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "overlap")
    return both.select(key, code.alias("code")).where("code is not null")


def canonical_order(rows: DataFrame, split: str, name: str) -> DataFrame:
    """Rows by split (train, valid, test), the name without case, then as it is."""
    return rows.orderBy(X.split_rank(F.col(split)), F.lower(name), name)


def duplicate_classes(df: DataFrame, content: Column, key: str, split: Column) -> DataFrame:
    """One row for each repeated content: members, splits it spans, whether it crosses splits, smallest member."""
    rows = df.select(content.alias("content"), F.col(key).alias("k"), split.alias("s")).where("content is not null")
    out = rows.groupBy("content").agg(F.count("*").alias("members"), F.count_distinct("s").alias("splits"), F.min("k").alias("representative"))
    return out.where("members > 1").withColumn("cross_split", F.col("splits") > 1)


def numeric_neighbours(names: DataFrame, reach: int = 2) -> DataFrame:
    """Pairs (id_a, id_b, gap) of different splits whose numbers lie within `reach`; names: (id, split, number).

    Numbers fall into buckets of reach + 1, and a row meets its own and the next
    bucket, so this is an equi-join; equal ids never pair; null numbers pair with nothing.
    """
    width = reach + 1
    rows = names.where("number is not null and split is not null").withColumn("bucket", F.floor(F.col("number") / width))
    a = rows.select(F.col("id").alias("id_a"), F.col("split").alias("split_a"), F.col("number").alias("n_a"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = rows.select(F.col("id").alias("id_b"), F.col("split").alias("split_b"), F.col("number").alias("n_b"), "bucket")
    gap = F.abs(F.col("n_a") - F.col("n_b"))
    return a.join(b, "bucket").where((F.col("id_a") < F.col("id_b")) & (F.col("split_a") != F.col("split_b")) & (gap <= reach)).select("id_a", "id_b", gap.cast("bigint").alias("gap"))


def hamming_neighbours(hashes: DataFrame, radius: int = 12, pieces: int = 13) -> DataFrame:
    """Pairs (id_a, id_b, distance) within `radius` of 128 bits; hashes: (id, hi, lo), distinct ids.

    Exact by the pigeonhole principle: `radius` flips leave one of radius + 1
    bands untouched, so pairs meet on a band and are told once, by the first band they share.
    """
    if pieces <= radius:
        raise ValueError("more bands than the radius")
    cuts = [round(i * 128 / pieces) for i in range(pieces + 1)]

    def band(hi: Column, lo: Column, i: int) -> Column:
        out = F.lit(0).cast("bigint")
        for half, base in ((hi, 0), (lo, 64)):
            start, end = max(cuts[i], base), min(cuts[i + 1], base + 64)
            if start < end:
                bits = F.shiftrightunsigned(half, start - base).bitwiseAND(F.lit((1 << (end - start)) - 1).cast("bigint"))
                out = F.shiftleft(out, end - start).bitwiseOR(bits)
        return out

    bands = [F.struct(F.lit(i).alias("band"), band(F.col("hi"), F.col("lo"), i).alias("value")) for i in range(pieces)]
    rows = hashes.where("hi is not null and lo is not null").select("id", "hi", "lo", F.explode(F.array(*bands)).alias("x")).select("id", "hi", "lo", "x.*")
    a, b = (rows.select(F.col("id").alias(f"id_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"), "band", "value") for s in "ab")
    met = a.join(b, ["band", "value"]).where("id_a < id_b").withColumn("distance", X.hamming(F.col("hi_a"), F.col("lo_a"), F.col("hi_b"), F.col("lo_b"))).where(F.col("distance") <= radius)
    earlier = reduce(lambda x, y: x | y, ((F.col("band") > i) & (band(F.col("hi_a"), F.col("lo_a"), i) == band(F.col("hi_b"), F.col("lo_b"), i)) for i in range(pieces - 1)))
    return met.where(~earlier).select("id_a", "id_b", "distance")


def slack_bands(radius: int, narrow: int = 14) -> list[tuple[int, int, int]]:
    """(first bit, width, slack) of bands of 128 bits; slack + 1 adds up to radius + 1, so two hashes within it agree in a band but for its slack."""
    near, exact = divmod(radius + 1, 2)
    if not 1 <= near <= 20:
        raise ValueError("radius from 1 to 40")
    first, rest = exact * narrow, 128 - exact * narrow
    cuts = [first + round(i * rest / near) for i in range(near + 1)]
    # At most 20 bits of a band are used, which bounds a task's table of places.
    return [(0, narrow, 0)] * exact + [(a, min(b - a, 20), 1) for a, b in zip(cuts, cuts[1:])]


def near_pairs(hashes: DataFrame, radius: int = 12, rows_per_shard: int = 131_072, rows_per_chunk: int = 400_000) -> DataFrame:
    """Pairs (id_a, id_b, distance) within `radius` of 128 bits, as `hamming_neighbours`, for large radii; hashes: (id, hi, lo), distinct ids.

    Bands of up to 20 bits that may differ in one bit meet far fewer pairs by
    chance than radius + 1 exact ones. A hash travels to the shard of each band's
    leading bits, its one-bit variants only by leading bit; those of the other
    bits are looked up inside the task. Hot shards are split after counting.
    """
    bands = slack_bands(radius)
    hashes = cut(hashes.where("id is not null and hi is not null and lo is not null").select("id", "hi", "lo"))
    lead = min(max(1, math.ceil(math.log2(max(1, hashes.count()) / rows_per_shard))), min(w for _, w, _ in bands) - 4)

    def prefix(start: int, width: int) -> Column:
        """The leading bits of the band: its last `lead` bits, counted from the lowest of hi and then of lo."""
        out = F.lit(0).cast("bigint")
        for k in range(start + width - lead, start + width):
            bit = F.shiftrightunsigned("hi" if k < 64 else "lo", k % 64).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(bit, k - (start + width - lead)))
        return out

    def routed(bent: bool) -> DataFrame:
        keys = []
        for i, (start, width, slack) in enumerate(bands):
            key = prefix(start, width).bitwiseOR(F.lit(i << lead).cast("bigint"))
            # Of two hashes that differ in a leading bit, the one without it travels to the other.
            bits = [F.lit(1 << j).cast("bigint") for j in range(lead if bent and slack else 0)]
            keys += [key, *(F.when(key.bitwiseAND(b) == 0, key.bitwiseOR(b)) for b in bits)]
        return hashes.select("id", "hi", "lo", F.explode(F.array_compact(F.array(*(k.cast("int") for k in keys)))).alias("shard"))

    # One row for each shard: a few hundred at most.
    sizes = {r.shard: r["count"] for r in routed(True).groupBy("shard").count().collect()}
    chunks = [max(1, math.ceil(sizes.get(s, 0) / rows_per_chunk)) for s in range(len(bands) << lead)]
    count = F.element_at(F.array(*map(F.lit, chunks)), F.col("shard") + 1)
    n = 2 * sum(chunks)
    left = routed(True).withColumn("chunk", F.pmod(F.xxhash64("hi", "lo"), count).cast("int")).repartition(n, "shard", "chunk")
    right = routed(False).withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    # Both sides come from one table: fresh names keep a cogroup from mixing their columns.
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in ("id", "hi", "lo", "shard", "chunk"))).repartition(n, "r_shard", "r_chunk")
    return left.groupBy("shard", "chunk").cogroup(right.groupBy("r_shard", "r_chunk")).applyInPandas(_shard_pairs(bands, lead, radius), f"id_a {dict(hashes.dtypes)['id']}, id_b {dict(hashes.dtypes)['id']}, distance int")


def _band_of(start: int, width: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << width) - 1)
    if start >= 64:
        return (lo >> np.uint64(start - 64)) & mask
    out = hi >> np.uint64(start)
    if start + width > 64:
        out = out | (lo << np.uint64(64 - start))
    return out & mask


def _shard_pairs(bands: list[tuple[int, int, int]], lead: int, radius: int, block_pairs: int = 2_000_000):
    def pairs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            number = int(key[0]) >> lead
            start, width, slack = bands[number]
            tail = width - lead
            split = lambda pdf, p: [pdf[f"{p}{c}"].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo")]
            (ah, al), (bh, bl) = split(left, ""), split(right, "r_")
            ai, bi = left["id"].to_numpy(), right["r_id"].to_numpy()
            low = np.uint64((1 << tail) - 1)
            values = _band_of(start, width, bh, bl) & low  # the shard's hashes all have its leading bits
            order = np.argsort(values, kind="stable")
            bh, bl, bi = bh[order], bl[order], bi[order]
            begin = np.append(0, np.cumsum(np.bincount(values.astype(np.int64), minlength=1 << tail)))
            own = _band_of(start, width, ah, al)
            straight = (own >> np.uint64(tail)) == np.uint64(int(key[0]) & ((1 << lead) - 1))
            own = own & low

            def check(a: np.ndarray, b: np.ndarray) -> None:
                once = ~straight[a] | (ai[a] < bi[b])  # a hash from another shard meets the other one here only
                a, b = a[once], b[once]
                gap_hi, gap_lo = ah[a] ^ bh[b], al[a] ^ bl[b]
                distance = np.bitwise_count(gap_hi).astype(np.int32) + np.bitwise_count(gap_lo)
                for i, (s, w, may) in enumerate(bands[:number]):  # a pair found by several bands is told once, by the first
                    distance[np.bitwise_count(_band_of(s, w, gap_hi, gap_lo)) <= may] = 129
                near = distance <= radius
                x, y = ai[a[near]], bi[b[near]]
                found.append(pd.DataFrame({"id_a": np.where(x < y, x, y), "id_b": np.where(x < y, y, x), "distance": distance[near]}))

            for flip in [0, *(1 << j for j in range(tail))] if slack else [0]:
                rows = np.arange(len(ai)) if flip == 0 else np.flatnonzero(straight)  # a leading bit flipped is the one that may
                at = (own[rows] ^ np.uint64(flip)).astype(np.int64)
                size = begin[at + 1] - begin[at]
                rows, at, size = rows[size > 0], at[size > 0], size[size > 0]
                ends, i = np.cumsum(size), 0
                while i < len(rows):
                    done = int(ends[i] - size[i])
                    to = max(i + 1, int(np.searchsorted(ends, done + block_pairs, "right")))
                    if size[i] > block_pairs:  # one value with very many hashes
                        for k in range(int(begin[at[i]]), int(begin[at[i] + 1]), block_pairs):
                            b = np.arange(k, min(k + block_pairs, int(begin[at[i] + 1])))
                            check(np.full(len(b), rows[i]), b)
                    else:
                        n = size[i:to]
                        check(np.repeat(rows[i:to], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[i:to]], n))
                    i = to
        return pd.concat(found) if found else pd.DataFrame({"id_a": left["id"][:0], "id_b": left["id"][:0], "distance": np.zeros(0, np.int32)})

    return pairs


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed): added, removed or changed rows, with the names of changed fields; keys are unique."""
    a = before.select(key, F.struct(*fields).alias("was"))
    b = after.select(key, F.struct(*fields).alias("now"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), f) for f in fields)))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(changed) > 0, "changed")
    names = F.when(change == "changed", F.array_join(changed, ",")).otherwise("")
    return both.select(key, change.alias("change"), names.alias("changed")).where("change is not null")

"""Same or nearly the same records across splits.

Every evaluation record is a set of passages: the bit bands of its perceptual
hash, canonically spelt. By the generalised pigeonhole principle, two hashes
within the radius agree in one band exactly or in one of the others with at
most one flipped bit, so bands of 14 to 20 bits suffice without losing a pair.
Passages are sharded by (band, leading bits); each shard's passages become one
Aho-Corasick automaton, which scans the training texts (the bands of each
training hash, each with its one-bit variants). Matched bands of a pair are
merged into covered bits, and the pair is checked exactly; over all training
texts they are merged into the coverage of each evaluation record. A content
digest is a passage of its own, found whole or not at all.

Training hashes travel only to the shards that can match them, hot shards are
split into chunks on both sides, and everything before the final pairs works on
distinct hashes, so copies are never multiplied: pairs of hashes and the
numbers of their copies are all that the report needs.

A pair of unrelated hashes meets in a band by chance with 4.7 / 16,384 at a
radius of 12; so candidates grow with the product of both sides' distinct
hashes, at some 50 million checked per second and core.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanwise.functions.text import hex_long, hex_text, plain, unify_split
from spanwise.session import cut

BITS = 128


@dataclass(frozen=True)
class Band:
    """`width` bits of the hash, as (half, shift, width) pieces; `slack` flips are allowed."""

    pieces: tuple[tuple[int, int, int], ...]
    width: int
    slack: int


def plan_bands(radius: int) -> list[Band]:
    """Bands whose slacks plus one add up to radius + 1: none can be missed by a pair within the radius."""
    if not 0 <= radius <= 40:
        raise ValueError("radius from 0 to 40")
    near, exact = divmod(radius + 1, 2)
    narrow = 14 if near else BITS
    widths = []
    if exact:
        widths.append((narrow if near else BITS, 0))
    rest = BITS - sum(w for w, _ in widths)
    widths += [(rest // near + (i < rest % near), 1) for i in range(near)]
    bands, at = [], 0
    for width, slack in widths:
        pieces, left, pos = [], min(width, 60), at
        while left:
            half, offset = divmod(pos, 64)
            take = min(left, 64 - offset)
            pieces.append((half, offset, take))
            pos, left = pos + take, left - take
        bands.append(Band(tuple(pieces), min(width, 60), slack))
        at += width
    return bands


def _band_column(band: Band, hi: Column, lo: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for half, shift, width in band.pieces:
        bits = F.shiftrightunsigned(hi if half == 0 else lo, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        out = F.shiftleft(out, width).bitwiseOR(bits)
    return out


def _band_values(band: Band, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hi), np.uint64)
    for half, shift, width in band.pieces:
        bits = ((hi if half == 0 else lo) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | bits
    return out


def _spell(values: np.ndarray, digits: int) -> str:
    """Values as words of `digits` letters; each place has its own 32 letters, so a word is only found in its place."""
    shifts = np.arange(digits - 1, -1, -1, dtype=np.uint64) * np.uint64(5)
    letters = (values[:, None] >> shifts) & np.uint64(31)
    letters = letters.astype(np.uint32) + (np.arange(digits, dtype=np.uint32) * 32 + 0x100)
    return letters.astype("<u4").tobytes().decode("utf-32-le")


def _scanner(bands: list[Band], lead: int, radius: int, block_pairs: int = 2_000_000) -> Callable:
    def scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        columns = ["t_hi", "t_lo", "e_hi", "e_lo", "distance", "bands"]
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        number, prefix = divmod(int(key[0]), 1 << lead)
        band = bands[number]
        eh, el = (right[c].to_numpy(np.int64).view(np.uint64) for c in ("e_hi", "e_lo"))
        values = _band_values(band, eh, el)
        order = np.argsort(values, kind="stable")
        eh, el, values = eh[order], el[order], values[order]
        words, starts = np.unique(values, return_index=True)
        ends = np.append(starts[1:], len(values))
        digits = math.ceil(band.width / 5)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        spelt = _spell(words, digits)
        for i in range(len(words)):
            automaton.add_word(spelt[i * digits : (i + 1) * digits], i)
        automaton.make_automaton()

        th, tl = (left[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        own = _band_values(band, th, tl)
        tail = np.uint64(band.width - lead)
        off = (own >> tail) ^ np.uint64(prefix)
        found: list[np.ndarray] = []

        def check(t: np.ndarray, e: np.ndarray) -> None:
            gap_hi, gap_lo = th[t] ^ eh[e], tl[t] ^ el[e]
            distance = np.bitwise_count(gap_hi).astype(np.int64) + np.bitwise_count(gap_lo)
            near = distance <= radius
            t, e, distance, gap_hi, gap_lo = t[near], e[near], distance[near], gap_hi[near], gap_lo[near]
            covered, first = np.zeros(len(t), np.int64), np.full(len(t), -1)
            for i in reversed(range(len(bands))):
                hit = np.bitwise_count(_band_values(bands[i], gap_hi, gap_lo)) <= bands[i].slack
                covered |= hit.astype(np.int64) << i
                first[hit] = i
            mine = first == number  # a pair found by several bands is told once, by the first
            if mine.any():
                t, e = t[mine], e[mine]
                found.append(np.stack([th[t].view(np.int64), tl[t].view(np.int64), eh[e].view(np.int64), el[e].view(np.int64), distance[mine], covered[mine]]))

        def match(rows: np.ndarray, variants: np.ndarray) -> None:
            """rows: training rows; variants: their words, one line for each row."""
            per = variants.shape[1]
            text = _spell(variants.ravel(), digits)
            hits = np.fromiter((x for pair in automaton.iter(text) for x in pair), np.int64).reshape(-1, 2)
            if not len(hits):
                return
            t, word = rows[hits[:, 0] // digits // per], hits[:, 1]
            size = ends[word] - starts[word]
            begin = np.append(0, np.cumsum(size))
            at = 0
            while at < len(t):
                to = max(at + 1, int(np.searchsorted(begin, begin[at] + block_pairs, "right")) - 1)
                if to == at + 1 and size[at] > block_pairs:  # one word with very many records
                    for s in range(int(starts[word[at]]), int(ends[word[at]]), block_pairs):
                        e = np.arange(s, min(s + block_pairs, int(ends[word[at]])))
                        check(np.full(len(e), t[at]), e)
                else:
                    n = size[at:to]
                    e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[word[at:to]], n)
                    check(np.repeat(t[at:to], n), e)
                at = to

        straight = np.flatnonzero(off == 0)
        flips = np.append(np.uint64(0), np.uint64(1) << np.arange(int(tail), dtype=np.uint64)) if band.slack else np.zeros(1, np.uint64)
        for i in range(0, len(straight), 8192):
            rows = straight[i : i + 8192]
            match(rows, own[rows][:, None] ^ flips)
        if band.slack:
            bent = np.flatnonzero(np.bitwise_count(off) == 1)
            for i in range(0, len(bent), 65536):
                rows = bent[i : i + 65536]
                match(rows, (own[rows] ^ (off[rows] << tail))[:, None])
        out = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
        return pd.DataFrame(dict(zip(columns, out)))

    return scan


def covered_bits(bands: Column, radius: int) -> Column:
    """The bits of the bands in a set of bands (bit i for band i)."""
    return sum((F.when(bands.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, b.width).otherwise(0) for i, b in enumerate(plan_bands(radius))), F.lit(0))


def hash_overlaps(hashes: DataFrame, radius: int = 12, passages_per_shard: int = 131_072, texts_per_chunk: int = 400_000) -> DataFrame:
    """Pairs of different or equal hashes, one of the training side and one of the evaluation side, within `radius` bits.

    `hashes`: distinct (hi, lo, in_train, in_eval). Returns (t_hi, t_lo, e_hi, e_lo, distance, bands), bands being the set of bands that match.
    """
    bands = plan_bands(radius)
    hashes = cut(hashes)
    evals = hashes.where("in_eval").select("hi", "lo")
    trains = hashes.where("in_train").select("hi", "lo")
    lead = min(max(1, math.ceil(math.log2(max(1, evals.count()) / passages_per_shard))), min(b.width for b in bands) - 4)

    def routed(df: DataFrame, bent: bool) -> DataFrame:
        keys = []
        for i, band in enumerate(bands):
            prefix = F.shiftrightunsigned(_band_column(band, F.col("hi"), F.col("lo")), band.width - lead)
            base = F.lit(i << lead).cast("bigint")
            keys.append(prefix.bitwiseOR(base))
            if bent and band.slack:
                keys += [prefix.bitwiseXOR(F.lit(1 << j).cast("bigint")).bitwiseOR(base) for j in range(lead)]
        return df.select("hi", "lo", F.explode(F.array(*(k.cast("int") for k in keys))).alias("shard"))

    # One row for each shard: with at most ten leading bits, some thousands.
    count = lambda df, name: df.groupBy("shard").agg(F.count("*").alias(name))
    sizes = count(routed(trains, True), "t").join(count(routed(evals, False), "e"), "shard").collect()
    parts = [(r.shard, math.ceil(r.t / texts_per_chunk), math.ceil(r.e / texts_per_chunk)) for r in sizes]
    plan = F.broadcast(hashes.sparkSession.createDataFrame(parts, "shard int, t_chunks int, e_chunks int"))
    n = max(1, 2 * sum(t * e for _, t, e in parts))
    # Each chunk of a shard's texts meets each chunk of its passages; shards with one side only meet nothing.
    drawn = lambda chunks: F.pmod(F.xxhash64("hi", "lo"), chunks).cast("int")
    each = lambda chunks: F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    texts = routed(trains, True).join(plan, "shard").withColumn("t_chunk", drawn(F.col("t_chunks"))).withColumn("e_chunk", each("e_chunks"))
    passages = routed(evals, False).join(plan, "shard").withColumn("e_chunk", drawn(F.col("e_chunks"))).withColumn("t_chunk", each("t_chunks"))
    texts = texts.select("hi", "lo", "shard", "t_chunk", "e_chunk").repartition(n, "shard", "t_chunk", "e_chunk")
    # Both sides come from one table: fresh names keep a cogroup from mixing their columns.
    own = ("shard", "t_chunk", "e_chunk")
    passages = passages.select(F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"), *(F.col(c).alias(f"own_{c}") for c in own)).repartition(n, *(f"own_{c}" for c in own))
    schema = "t_hi long, t_lo long, e_hi long, e_lo long, distance long, bands long"
    return texts.groupBy(*own).cogroup(passages.groupBy(*(f"own_{c}" for c in own))).applyInPandas(_scanner(bands, lead, radius), schema)


def prepared(manifest: DataFrame) -> DataFrame:
    """(image_id, split, source, sha, hi, lo, telling) of images with content and a known split.

    sha (32 bytes) and hi/lo are null where the hash is missing or malformed; `telling`
    is false for hashes of (nearly) one colour, which match nothing.
    """
    ones = F.bit_count("hi") + F.bit_count("lo")
    # Step by step: an expression used twice is not worked out twice.
    return (
        manifest.where("file_size_bytes > 0")
        .select("image_id", unify_split(F.col("split")).alias("split"), plain(F.col("source")).alias("source"), hex_text(F.col("image_sha256"), 64).alias("sha"), hex_text(F.col("perceptual_hash"), 32).alias("perceptual"))
        .where("split is not null")
        .select("image_id", "split", "source", F.unhex("sha").alias("sha"), hex_long(F.col("perceptual"), 1).alias("hi"), hex_long(F.col("perceptual"), 17).alias("lo"))
        .withColumn("telling", F.coalesce((ones > 8) & (ones < 120), F.lit(False)))
    )


def _train() -> Column:
    return F.col("split") == "train"


def _near(images: DataFrame, radius: int) -> DataFrame:
    """Pairs of distinct telling hashes across the sides; see hash_overlaps."""
    return hash_overlaps(images.where("telling").groupBy("hi", "lo").agg(F.max(_train()).alias("in_train"), F.max(~_train()).alias("in_eval")), radius)


def _head(c: Column) -> list[Column]:
    """The first 128 bits of a digest as two numbers."""
    return [hex_long(F.hex(F.substring(c, 1, 16)), 1).alias("hi"), hex_long(F.hex(F.substring(c, 1, 16)), 17).alias("lo")]


def _equal(images: DataFrame) -> DataFrame:
    """(hi, lo): heads of digests found on both sides by the automaton; the rest of the digest is compared where they meet."""
    heads = images.where("sha is not null").select(*_head(F.col("sha")), _train().alias("train"))
    heads = heads.groupBy("hi", "lo").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    return hash_overlaps(heads, 0).select(F.col("t_hi").alias("hi"), F.col("t_lo").alias("lo"))


def _by_digest(images: DataFrame, *columns: str) -> DataFrame:
    """Pairs of equal digests across the sides, columns prefixed t_ and e_; the heads that the automaton found come first."""
    rows = images.where("sha is not null").select(*images.columns, *(c.alias(f"head_{n}") for n, c in zip(("hi", "lo"), _head(F.col("sha")))))
    met = rows.join(_equal(images).select(F.col("hi").alias("head_hi"), F.col("lo").alias("head_lo")), ["head_hi", "head_lo"], "left_semi").select("split", "sha", *columns)
    t, e = _side(met, True), _side(met, False)
    return t.join(e, t.t_sha == e.e_sha)


def _side(images: DataFrame, train: bool) -> DataFrame:
    """One side's columns, prefixed t_ or e_."""
    p = "t" if train else "e"
    return images.where(_train() if train else ~_train()).select(*(F.col(c).alias(f"{p}_{c}") for c in images.columns))


def _gap() -> Column:
    return F.bit_count(F.col("t_hi").bitwiseXOR(F.col("e_hi"))) + F.bit_count(F.col("t_lo").bitwiseXOR(F.col("e_lo")))


def cross_split_pairs(manifest: DataFrame, radius: int = 12) -> DataFrame:
    """All pairs of a training image and a valid or test image with equal SHA-256 or near perceptual hashes.

    Columns: image_id_a < image_id_b, eval_image_id, split_pair (train first),
    sha256_equal, hamming_distance (null without two hashes),
    covered_bits (null where only the SHA-256 matched).
    Null, malformed and one-colour hashes never match; empty files are left
    out; an empty manifest gives no row; repeated image ids count once for a pair.
    """
    images = cut(prepared(manifest).select(F.col("image_id").alias("id"), "split", "sha", "hi", "lo", "telling"))
    keep = ("t_id", "e_id", "e_split")
    hashed = images.where("telling").select("id", "split", "hi", "lo")
    by_hash = _near(images, radius).join(_side(hashed, True), ["t_hi", "t_lo"]).join(_side(hashed, False), ["e_hi", "e_lo"])
    by_hash = by_hash.select(*keep, "distance", "bands", F.lit(False).alias("same"))
    by_sha = _by_digest(images, "id", "hi", "lo").select(*keep, _gap().cast("bigint").alias("distance"), F.lit(None).cast("bigint").alias("bands"), F.lit(True).alias("same"))
    merged = by_hash.unionByName(by_sha).groupBy(*keep).agg(F.min("distance").alias("distance"), F.max("bands").alias("bands"), F.max("same").alias("same"))
    return merged.select(
        F.least("t_id", "e_id").alias("image_id_a"),
        F.greatest("t_id", "e_id").alias("image_id_b"),
        F.col("e_id").alias("eval_image_id"),
        F.concat(F.lit("train/"), "e_split").alias("split_pair"),
        F.col("same").alias("sha256_equal"),
        F.col("distance").cast("int").alias("hamming_distance"),
        F.when(F.col("bands").isNotNull(), covered_bits(F.col("bands"), radius)).cast("int").alias("covered_bits"),
    )


def coverage(manifest: DataFrame, radius: int = 12) -> DataFrame:
    """(image_id, split, training_hashes, nearest, covered_bits) of each evaluation image near some training image.

    training_hashes: distinct training hashes within the radius; nearest: the
    smallest distance; covered_bits: the bits of its hash that lie in matched
    bands, merged over all of them.
    """
    images = cut(prepared(manifest).select("image_id", "split", "hi", "lo", "telling"))
    merged = _near(images, radius).groupBy(F.col("e_hi").alias("hi"), F.col("e_lo").alias("lo")).agg(
        F.count("*").alias("training_hashes"), F.min("distance").cast("int").alias("nearest"), F.bit_or("bands").alias("bands")
    )
    evals = images.where(~_train() & F.col("telling")).select("image_id", "split", "hi", "lo").distinct()
    return evals.join(merged, ["hi", "lo"]).select("image_id", "split", "training_hashes", "nearest", covered_bits(F.col("bands"), radius).cast("int").alias("covered_bits"))


def overlap_report(manifest: DataFrame, radius: int = 12) -> DataFrame:
    """Per split pair and source of the evaluation image: pairs, equal and near, and evaluation images touched.

    Counted from pairs of hashes and the numbers of their copies; no pair of copies is ever made.
    """
    images = cut(prepared(manifest).groupBy("image_id", "split", "source", "sha", "hi", "lo", "telling").agg(F.lit(1).alias("one")))
    kinds = cut(images.groupBy("split", "source", "sha", "hi", "lo", "telling").agg(F.count("*").alias("n")))
    t, e = _side(kinds, True), _side(kinds, False)
    copies = t.where("t_telling").groupBy("t_hi", "t_lo").agg(F.sum("t_n").alias("t_n"))
    near = cut(_near(kinds, radius))
    met = near.join(copies, ["t_hi", "t_lo"]).groupBy("e_hi", "e_lo").agg(F.sum("t_n").alias("t_n"))
    by_hash = e.where("e_telling").join(met, ["e_hi", "e_lo"])
    hashes = by_hash.groupBy("e_split", "e_source").agg(F.sum(F.col("t_n") * F.col("e_n")).alias("near"))
    both = cut(_by_digest(kinds, "source", "hi", "lo", "telling", "n"))
    also = F.coalesce(F.col("t_telling") & F.col("e_telling") & (_gap() <= radius), F.lit(False))
    n = F.col("t_n") * F.col("e_n")
    digests = both.groupBy("e_split", "e_source").agg(F.sum(n).alias("equal"), F.sum(F.when(also, n).otherwise(0)).alias("also"))
    # An evaluation class counts once, however it was touched.
    touched = e.join(near.select("e_hi", "e_lo", F.lit(True).alias("e_telling")).distinct(), ["e_hi", "e_lo", "e_telling"], "left_semi").select(*e.columns)
    touched = touched.unionByName(e.join(both.select("e_sha").distinct(), "e_sha", "left_semi").select(*e.columns)).distinct()
    seen = touched.groupBy("e_split", "e_source").agg(F.sum("e_n").alias("eval_images"))
    keys = [F.col("e_split"), F.coalesce("e_source", F.lit("\x00")).alias("e_source")]
    out = None
    for part in (hashes, digests, seen):
        part = part.select(*keys, *part.columns[2:])
        out = part if out is None else out.join(part, ["e_split", "e_source"], "full_outer")
    out = out.fillna(0, ["near", "equal", "also", "eval_images"])
    pairs = F.col("near") + F.col("equal") - F.col("also")
    return out.select(
        F.concat(F.lit("train/"), "e_split").alias("split_pair"), F.nullif("e_source", F.lit("\x00")).alias("eval_source"), pairs.alias("pairs"),
        F.col("equal").alias("equal_pairs"), (pairs - F.col("equal")).alias("near_pairs"), "eval_images",
    )
